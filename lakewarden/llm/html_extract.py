"""Main text of web pages: every leaf block is kept or left by a recurrent labeller.

A page becomes a sequence of leaf blocks; each is a vector of its tag path
(tags and class words, hashed), its words (hashed) and a few measures; a
bidirectional LSTM reads the whole sequence, so that a block is judged in the
context of the document. The labeller is trained here, on ``PAGES`` labelled
pages drawn from a grammar of page layouts by a fixed seed: a bounded sample
that does not depend on the corpus.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewarden.llm.bilstm import BiLSTM, pad
from lakewarden.llm.htmlblocks import Block, Path, blocks
from lakewarden.sources.tables import table

PATH_SLOTS, LEAF_SLOTS, WORD_SLOTS, MEASURES = 96, 32, 16, 6
WIDTH = PATH_SLOTS + LEAF_SLOTS + WORD_SLOTS + MEASURES
HIDDEN, EPOCHS, BATCH, RATE, SEED = 12, 9, 24, 0.01, 11
#: Labelled pages of the training sample.
PAGES = 1000
#: Blocks that go through the labeller at a time.
STEP_BLOCKS = 4096


@lru_cache(maxsize=1 << 16)
def _slot(name: str, slots: int) -> int:
    return zlib.crc32(name.encode()) % slots


def path_slots(path: Path | None) -> int:
    """The slots of a whole path as bits; each element adds its own to those of the elements around it."""
    todo = []
    while path and path.marks is None:
        todo.append(path)
        path = path.outer
    marks = path.marks if path else 0
    for path in reversed(todo):
        if path.label not in ("html", "body"):
            for part in path.label.split("."):
                marks |= 1 << _slot(part, PATH_SLOTS)
        path.marks = marks
    return marks


def features(page: Sequence[Block]) -> np.ndarray:
    """One row a block. The innermost tag has slots of its own, beside those of the whole path."""
    out = np.zeros((len(page), WIDTH), np.float32)
    bits = b"".join(path_slots(b.path).to_bytes(PATH_SLOTS // 8, "little") for b in page)
    out[:, :PATH_SLOTS] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").reshape(len(page), PATH_SLOTS)
    for k, b in enumerate(page):
        row = out[k]
        if b.path:
            row[PATH_SLOTS + _slot(b.path.label.split(".")[0], LEAF_SLOTS)] = 1.0
        words = b.text.split(" ")
        hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_SLOTS for w in words), np.int64, len(words))
        at = PATH_SLOTS + LEAF_SLOTS
        row[at : at + WORD_SLOTS] = np.bincount(hashed, minlength=WORD_SLOTS) / len(words)
        n, depth = len(b.text), b.path.depth if b.path else 0
        row[at + WORD_SLOTS :] = (min(np.log1p(n) / 8, 1.5), min(b.n_link / n, 1.0), len(words) < 6, b.text[-1] in ".!?…:\"”", min(depth / 16, 4.0), b.text.count(",") / len(words))
    return out


# Class words of page parts, for the layouts below.
MAIN_CLASSES = ("content", "post", "entry", "article", "story", "main", "body text", "page content", "post body", "")
OTHER_PARTS = {
    "nav": ("menu", "nav", "navbar", "breadcrumb", "toc", ""),
    "header": ("header", "masthead", "site header", "top", ""),
    "footer": ("footer", "site footer", "bottom", "copyright", ""),
    "aside": ("sidebar", "related", "widget", ""),
    "form": ("newsletter", "signup", "search", "login", "contact", ""),
    "div": ("ad", "ads", "advert", "banner", "sponsor", "promo", "cookie", "notice", "alert", "consent", "popup", "sidebar", "menu", "share", "social", "related", "comments", "comment", "widget", "footer", "header", "subscribe", "tags", "pagination", "legal", "breadcrumbs"),
    "section": ("comments", "related", "sidebar", "newsletter", "ads", "share"),
    "ul": ("menu", "nav", "links", "tags", "comments", "social"),
    "ol": ("breadcrumb", "comments", "commentlist"),
}


class Layouts:
    """Random labelled pages. Text carries no label: words are random alike everywhere."""

    def __init__(self, seed: int):
        self.dice = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        d = self.dice
        n = int(low * (high / low) ** d.random())
        return " ".join("".join(d.choice(("en", "th", "er", "st", "ing", "an", "on", "re", "ti", "é", "ß", "ou", "a", "ch")) for _ in range(d.randrange(1, 5))) for _ in range(n))

    def tagged(self, tag: str, names: str, inside: str) -> str:
        d = self.dice
        if not names:
            return f"<{tag}>{inside}</{tag}>"
        kind = d.choice(("class", "class", "class", "id", "role"))
        return f'<{tag} {kind}="{names}">{inside}</{tag}>'

    def inline(self, text: str) -> str:
        d = self.dice
        wrap = d.choice(("", "", "b", "em", "a"))
        if not wrap:
            return text
        head, _, rest = text.partition(" ")
        return f"<{wrap}{' href=/x' if wrap == 'a' else ''}>{head}</{wrap}> {rest}"

    def paragraph(self) -> str:
        d = self.dice
        text = self.words(2, 160) + d.choice((".", ".", ".", "!", "", "?"))
        return d.choice((f"<p>{self.inline(text)}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}"))

    def main(self) -> str:
        d, parts = self.dice, []
        if d.random() < 0.8:
            parts.append(f"<h1>{self.words(2, 14)}</h1>")
        for _ in range(int(2 ** (d.random() * 5.3))):
            x = d.random()
            if x < 0.7:
                parts.append(self.paragraph())
            elif x < 0.78:
                parts.append(f"<div>{self.inline(self.words(5, 120))}.</div>")
            elif x < 0.84:
                parts.append(f"<h{d.choice('234')}>{self.words(1, 8)}</h2>")
            elif x < 0.89:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 25)}</li>" for _ in range(d.randrange(1, 6))) + "</ul>")
            elif x < 0.93:
                parts.append(f"<blockquote>{self.words(3, 40)}</blockquote>")
            elif x < 0.95:
                parts.append(f"<pre>{self.words(3, 20)}</pre>")
            elif x < 0.97:
                parts.append(f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>")
            else:
                parts.append("\0" + self.other(inside=True) + "\1")
        return "".join(parts)

    def other(self, inside: bool = False) -> str:
        d = self.dice
        tag = d.choice(("div", "aside", "form", "section", "nav") if inside else tuple(OTHER_PARTS))
        names = d.choice(OTHER_PARTS[tag])
        parts = []
        for _ in range(d.randrange(1, 6)):
            x = d.random()
            item = "li" if tag in ("ul", "ol") else ""
            if item or x < 0.3:
                cells = "".join(f"<li><a href='/{k}'>{self.words(1, 4)}</a></li>" if d.random() < 0.75 else f"<li>{self.words(1, 30)}</li>" for k in range(d.randrange(1, 7)))
                parts.append(cells if item else f"<ul>{cells}</ul>")
            elif x < 0.55:
                parts.append(f"<p>{self.words(2, 60)}.</p>")
            elif x < 0.65:
                parts.append(f"<h{d.choice('1234')}>{self.words(1, 6)}</h3>")
            elif x < 0.75:
                parts.append(f"<div>{self.words(2, 40)}</div>")
            else:
                parts.append(self.words(2, 25) + d.choice((".", "", " &copy;")))
        return self.tagged(tag, names, "".join(parts))

    def page(self) -> list[tuple[Block, int]]:
        """Blocks with 1 for main text. The zero and one bytes mark parts inside the main text that are none of it."""
        d = self.dice
        before, after = ("".join(self.other() for _ in range(d.randrange(0, 4))) for _ in range(2))
        if d.random() < 0.35:
            before = self.tagged("nav", d.choice(OTHER_PARTS["nav"]), "<ul>" + "".join(f"<li><a href=/x>{self.words(1, 2)}</a></li>" for _ in range(d.randrange(2, 9))) + "</ul>") + self.tagged("div", d.choice(OTHER_PARTS["div"]), self.words(3, 20))
            after = self.tagged("footer", "", "&copy; " + self.words(2, 20))
        tag = d.choice(("article", "article", "article", "main", "div", "section"))
        names = d.choice(MAIN_CLASSES)
        if tag in ("div", "section") and not names:
            names = "content"
        inside = self.tagged(tag, names, self.main())
        if d.random() < 0.06:
            inside = inside[inside.index(">") + 1 : inside.rindex("<")]  # right below the body
        elif d.random() < 0.3:
            inside = self.tagged(d.choice(("div", "main")), d.choice(("wrapper", "container", "page", "content", "site")), inside)
        made = []
        for part, label in ((before, 0), (inside, 1), (after, 0)):
            # Parts are parsed apart to know their labels, then read as one sequence.
            if label and "\0" in part:
                made += self._mixed(part)
            else:
                made += [(b, label) for b in blocks("<html><body>" + part)]
        return made

    @staticmethod
    def _mixed(part: str) -> list[tuple[Block, int]]:
        other = set()
        for piece in part.split("\0")[1:]:
            other |= {b.text for b in blocks(piece.split("\1")[0])}
        return [(b, 0 if b.text in other else 1) for b in blocks("<html><body>" + part.replace("\0", "").replace("\1", ""))]


@lru_cache(maxsize=2)
def labeller(pages: int = PAGES, seed: int = SEED) -> BiLSTM:
    """Trained on the driver from the bounded sample; the same weights every time."""
    layouts = Layouts(seed)
    sample = [p for p in (layouts.page() for _ in range(pages)) if p]
    model = BiLSTM(WIDTH, HIDDEN, seed)
    model.fit([(features([b for b, _ in p]), np.array([y for _, y in p], np.float32)) for p in sample], EPOCHS, RATE, BATCH, seed)
    return model


def label(model: BiLSTM, pages: list[list[Block]]) -> list[np.ndarray]:
    """Whether each block of each page is main text. Pages of like length go together; sequences are whole."""
    kept: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        if len(pages[order[at]]) > STEP_BLOCKS:  # a long page goes by itself, its features a piece at a time
            whole = pages[order[at]]
            kept[order[at]] = model.read(features(whole[a : a + STEP_BLOCKS]) for a in range(0, len(whole), STEP_BLOCKS)) > 0.5
            at += 1
            continue
        n = max(1, min(len(order) - at, STEP_BLOCKS // len(pages[order[at]])))
        while n > 1 and n * len(pages[order[at + n - 1]]) > 2 * STEP_BLOCKS:
            n //= 2
        some = order[at : at + n]
        p, _ = model.forward(*pad([features(pages[k]) for k in some]))
        for j, k in enumerate(some):
            kept[k] = p[: len(pages[k]), j] > 0.5
        at += n
    return kept


def main_texts(model: BiLSTM, pages: list[str | None]) -> list[str]:
    parsed = [blocks(p) for p in pages]
    return ["\n".join(b.text for b, on in zip(page, keep) if on) for page, keep in zip(parsed, label(model, parsed))]


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text`` of every row, whole pages whatever their length or depth.

    Null or textless pages give the empty string, repeated rows each their own;
    null keys pass; an empty table gives an empty result; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = main_texts(shared.value, batch.column(0).to_pylist())
                yield pa.record_batch([*batch.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "text"])

    named = pages.select(F.col(html_col).cast("string").alias("_html"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name != "_html")
    return named.mapInArrow(run, f"{kinds}, text string")


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op8_html": op8_html}
ORACLES: dict[str, str] = {}
