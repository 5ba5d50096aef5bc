"""Language identification by bit-sliced Bloom filters of n-grams.

*Learning.* Byte 4-grams of folded training texts are counted for each language
over all training documents; a language keeps those that make up at least
``LEAST_SHARE`` of its grams, which bounds what reaches the driver to
1 / LEAST_SHARE grams a language whatever the corpus.

*Filters.* All languages share one array of slots; a slot is a word of bits, one
for each language. A gram sets its languages' bits in ``HASHES`` slots; looking
one up is the AND of those slots, so one look returns all languages that hold
it. The number of slots follows the number of grams kept.

*Deciding.* A text's hits are counted for each language, corrected for the rate
at which its filter answers yes by accident, and divided by the share of its
own grams that the language kept. The largest wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakewarden.llm.blocks import text_bytes
from lakewarden.llm.scratch import discard, stage
from lakewarden.sources.tables import table

GRAM = 4
LEAST_SHARE = 1 / 20_000
HASHES = 3
SLOTS_PER_GRAM = 16
UNKNOWN = "und"
#: Bytes of text handled at a time.
PIECE = 1 << 20
#: Bytes that separate: all of ASCII but letters. Letters are lower-cased, other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LETTER = re.compile(rb"[a-z]")
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def fold(text: bytes | None) -> bytes:
    """Lower-cased runs of letters with one space between and around; empty without any."""
    words = (text or b"").translate(FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def has_letter(folded: bytes) -> bool:
    return bool(LETTER.search(folded)) or any(c.isalpha() for c in folded.decode("utf-8", "replace") if c != "�")


def grams(folded: bytes) -> np.ndarray:
    """Codes of all windows of GRAM bytes."""
    a = np.frombuffer(folded, np.uint8).astype(np.uint32)
    if len(a) < GRAM:
        return np.zeros(0, np.uint32)
    return a[:-3] << 24 | a[1:-2] << 16 | a[2:-1] << 8 | a[3:]


def pieces(folded: bytes) -> Iterator[bytes]:
    """Parts of bounded size whose windows together are those of the whole."""
    for at in range(0, max(len(folded) - GRAM + 1, 0), PIECE):
        yield folded[at : at + PIECE + GRAM - 1]


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # (slots, words of 64 languages)
    false_rate: np.ndarray
    coverage: np.ndarray
    default: int

    @classmethod
    def build(cls, kept: dict[str, np.ndarray], coverage: dict[str, float], sizes: dict[str, int]) -> Filters:
        """kept: gram codes by language; coverage: share of a language's grams that they make up; sizes: its grams in all."""
        languages = sorted(coverage)
        most = max((len(kept.get(name, ())) for name in languages), default=1)
        bits = max(10, int(np.ceil(np.log2(SLOTS_PER_GRAM * max(most, 1)))))
        slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
        for k, name in enumerate(languages):
            for at in cls._places(kept.get(name, np.zeros(0, np.uint32)), bits):
                np.bitwise_or.at(slots[:, k // 64], at, np.uint64(1 << k % 64))
        filled = np.array([np.count_nonzero(slots[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(languages))]) / len(slots)
        default = max(range(len(languages)), key=lambda k: sizes[languages[k]], default=-1)
        return cls(languages, slots, filled**HASHES, np.array([max(coverage[name], 1e-9) for name in languages]), default)

    @staticmethod
    def _places(codes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        wide = codes.astype(np.uint64) + np.uint64(1)
        for factor in FACTORS[:HASHES]:
            mixed = wide * factor
            yield ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)

    def masks(self, codes: np.ndarray) -> np.ndarray:
        """Languages that hold each gram, as bits: (grams, words)."""
        bits = int(np.log2(len(self.slots)))
        found = None
        for at in self._places(codes, bits):
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def hits(self, folded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) hits and (texts,) windows."""
        hits, windows = np.zeros((len(folded), len(self.languages)), np.int64), np.array([max(len(f) - GRAM + 1, 0) for f in folded])
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            whole = b"".join(p for _, p in held)
            starts = np.cumsum([0] + [len(p) for _, p in held])
            masks = self.masks(grams(whole))
            owners = [k for k, _ in held]
            for k in range(len(self.languages)):
                on = (masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(np.int32)
                total = np.concatenate(([0], np.cumsum(on)))
                np.add.at(hits[:, k], owners, total[starts[1:] - GRAM + 1] - total[starts[:-1]])

        for k, text in enumerate(folded):
            for piece in pieces(text):
                held.append((k, piece))
                size += len(piece)
                if size >= PIECE:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return hits, windows

    def decide(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        folded = [fold(t) for t in texts]
        hits, windows = self.hits(folded)
        share = hits / np.maximum(windows, 1)[:, None]
        points = np.maximum((share - self.false_rate) / (1 - self.false_rate), 0) / self.coverage
        out = []
        for k, text in enumerate(folded):
            if not self.languages or not text or not has_letter(text):
                out.append((UNKNOWN, 0.0))
            elif (total := float(points[k].sum())) > 0:
                best = int(points[k].argmax())
                out.append((self.languages[best], float(points[k, best]) / total))
            else:
                out.append((self.languages[self.default], 0.0))
        return out


def count_grams(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language. A task adds up its own rows first, a bounded number of windows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def settle(lang: str) -> None:
            codes, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            sizes[lang] = 0
            if lang in totals:
                old, m = totals[lang]
                codes, where = np.unique(np.concatenate([old, codes]), return_inverse=True)
                n = np.bincount(where, np.concatenate([m, n])).astype(np.int64)
            totals[lang] = codes, n

        for batch in batches:
            for text, lang in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                for piece in pieces(fold(text)):
                    waiting.setdefault(lang, []).append(grams(piece))
                    sizes[lang] = sizes.get(lang, 0) + len(piece)
                    if sizes[lang] > 2 * PIECE:
                        settle(lang)
        for lang in list(waiting):
            settle(lang)
        for lang, (codes, n) in totals.items():
            yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    named = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    return named.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


#: The totals of so many languages are broadcast; more meet the grams in an ordinary join.
BROADCAST_LANGUAGES = 10_000


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least_share: float = LEAST_SHARE) -> Filters:
    """Filters from all rows with a language. Starts jobs; what it collects is bounded by languages / least_share rows.

    Grams stay where they were counted: only the totals of the languages go to
    them, and what is frequent goes to the driver as it is. Rows without a
    language teach nothing, nor do null texts; repeated rows count each; an
    empty table teaches no language.
    """
    counted = stage(count_grams(docs, text_col=text_col, lang_col=lang_col), "language-grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("size"))
    named = totals.withColumnRenamed("lang", "of")
    if totals.count() <= BROADCAST_LANGUAGES:
        named = F.broadcast(named)
    frequent = counted.join(named, F.col("lang") == F.col("of")).filter(F.col("n") >= F.col("size") * least_share)
    found = frequent.select("lang", "gram", "n").toArrow().combine_chunks()
    sizes = {r.lang: int(r["size"]) for r in totals.collect()}
    discard(counted)
    langs, codes, n = found.column("lang").to_numpy(), found.column("gram").to_numpy(), found.column("n").to_numpy()
    kept, covered = {}, {}
    for lang in sizes:
        own = langs == lang
        if own.any():
            kept[lang], covered[lang] = np.sort(codes[own]).astype(np.uint32), float(n[own].sum()) / sizes[lang]
    return Filters.build(kept, covered, sizes)


def predict(docs: DataFrame, filters: Filters, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (the winner's part of all points, 0 to 1) of every row.

    The text alone decides. A null text, or one without a letter, is ``und``
    with score 0; one whose grams no language holds gets the language learned
    from most text, with score 0; ties go to the first language in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = shared.value.decide(list(text_bytes(batch.column(0))))
                yield pa.record_batch([*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score"])

    named = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in named.schema if f.name != "_text")
    return named.mapInArrow(run, kinds + "lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by the checksum of the id; none without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    return predict(docs, learn(docs.filter("not held_out")), keep=("doc_id", "held_out"))


QUERIES = {"op6_language": op6_language}
ORACLES: dict[str, str] = {}
