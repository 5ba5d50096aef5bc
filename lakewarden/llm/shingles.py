"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

from lakewarden.llm.blocks import ASCII_LOWER

SEED = 42


def shingle_hashes(text: bytes | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``width`` words, space-joined, repeats included; fewer words are one run, none give none.

    ASCII letters are folded; words part at ASCII white space.
    """
    words = (text or b"").translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = memoryview(b" ".join(words))
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = len(words) - width + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())), np.uint64, n)
