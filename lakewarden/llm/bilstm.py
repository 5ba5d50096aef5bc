"""A small bidirectional LSTM block labeller in numpy: forward, backward, training."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class BiLSTM:
    """Labels every step of a sequence from context on both sides: P(keep)."""

    def __init__(self, width: int, hidden: int, seed: int):
        dice = np.random.default_rng(seed)
        self.hidden = hidden
        self.weights: dict[str, np.ndarray] = {}
        for side in "fb":
            self.weights[f"W{side}"] = (dice.standard_normal((width, 4 * hidden)) / np.sqrt(width)).astype(np.float32)
            self.weights[f"U{side}"] = (dice.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1.0  # keep memory at first
            self.weights[f"B{side}"] = bias
        self.weights["V"] = (dice.standard_normal((2 * hidden + width, 1)) * 0.1).astype(np.float32)
        self.weights["c"] = np.zeros(1, np.float32)

    def _inner(self, x: np.ndarray, side: str) -> np.ndarray:
        return x @ self.weights[f"W{side}"] + self.weights[f"B{side}"]

    def _scan(self, inner: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """inner: (steps, pages, 4 * hidden), padded at the end; mask: (steps, pages, 1)."""
        steps, pages, _ = inner.shape
        n, w = self.hidden, self.weights
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        out, tape = np.zeros((steps, pages, n), np.float32), []
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = inner[t] + h @ w[f"U{side}"]
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            fresh = f * c + i * g
            squeezed = np.tanh(fresh)
            if keep:
                tape.append((t, i, f, o, g, c, squeezed, h))
            c = np.where(mask[t], fresh, c)
            h = np.where(mask[t], o * squeezed, h)
            out[t] = h
        return out, tape

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        ahead, tape_f = self._scan(self._inner(x, "f"), mask, "f", keep)
        back, tape_b = self._scan(self._inner(x, "b"), mask, "b", keep)
        seen = np.concatenate([ahead, back, x], axis=2)
        p = _sigmoid(seen @ self.weights["V"] + self.weights["c"])[..., 0]
        return p, (seen, tape_f, tape_b)

    def read(self, pieces: Iterable[np.ndarray]) -> np.ndarray:
        """P(keep) of every step of one sequence whose features come in pieces: as :meth:`forward`, but they are never held together."""
        inner: dict[str, list[np.ndarray]] = {"f": [], "b": []}
        own, n = [], self.hidden
        for x in pieces:
            for side, parts in inner.items():
                parts.append(self._inner(x, side))
            own.append(x @ self.weights["V"][2 * n :] + self.weights["c"])
        z, mask = np.concatenate(own), np.ones((sum(map(len, own)), 1, 1), bool)
        for k, side in enumerate("fb"):
            out, _ = self._scan(np.concatenate(inner.pop(side))[:, None], mask, side, False)
            z += out[:, 0] @ self.weights["V"][k * n : (k + 1) * n]
        return _sigmoid(z)[:, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, (seen, tape_f, tape_b) = self.forward(x, mask, keep=True)
        m, total = mask[..., 0], max(float(mask.sum()), 1.0)
        loss = -float((m * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum()) / total
        dz = ((p - y) * m / total)[..., None].astype(np.float32)
        n, w = self.hidden, self.weights
        grads = {"V": np.einsum("tpk,tpo->ko", seen, dz), "c": dz.sum(axis=(0, 1))}
        into = dz @ w["V"].T
        for side, tape, dout in (("f", tape_f, into[..., :n]), ("b", tape_b, into[..., n : 2 * n])):
            du, dinner = np.zeros_like(w[f"U{side}"]), np.zeros((*x.shape[:2], 4 * n), np.float32)
            dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
            for t, i, f, o, g, c, squeezed, h in reversed(tape):
                on = mask[t]
                dh_all = dh + dout[t]
                here = np.where(on, dh_all, 0)
                dcell = np.where(on, dc, 0) + here * o * (1 - squeezed**2)
                step = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), here * squeezed * o * (1 - o), dcell * i * (1 - g**2)], axis=1)
                dinner[t] = step
                du += h.T @ step
                dh = np.where(on, step @ w[f"U{side}"].T, dh_all)
                dc = np.where(on, dcell * f, dc)
            grads[f"U{side}"] = du
            grads[f"W{side}"] = np.einsum("tpk,tpo->ko", x, dinner)
            grads[f"B{side}"] = dinner.sum(axis=(0, 1))
        return loss, grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int, rate: float, batch: int, seed: int) -> float:
        """Adam over (features, labels) of pages; returns the last mean loss."""
        dice = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, mean = 0, 0.0
        for _ in range(epochs):
            order, losses = dice.permutation(len(pages)), []
            for at in range(0, len(order), batch):
                some = [pages[k] for k in order[at : at + batch]]
                x, mask = pad([s[0] for s in some])
                y = np.zeros(mask.shape[:2], np.float32)
                for k, (_, labels) in enumerate(some):
                    y[: len(labels), k] = labels
                loss, grads = self.gradients(x, mask, y)
                losses.append(loss)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = (self.weights[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            mean = float(np.mean(losses))
        return mean


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Features as (steps, pages, width) and the mask of real steps."""
    steps, width = max(len(p) for p in pages), pages[0].shape[1]
    x, mask = np.zeros((steps, len(pages), width), np.float32), np.zeros((steps, len(pages), 1), bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = True
    return x, mask
