"""Stupid-backoff scores from n-gram counts of the whole corpus.

The relational plan is the plain one: explode n-grams, count them in tables
partitioned by hash, join the counts back to the exploded n-grams and sum by
document. Its rows are packed, so that neither shuffle nor disk holds a row for
every word of the corpus:

* *blocks*: documents are coded in blocks of about ``BLOCK_WORDS`` words - the
  hashes of the block's different words, and word numbers;
* *count tables*: a block sends each hash partition one row with the sorted
  hashes and counts of the different n-grams, of all orders, that it holds there.
  A partition adds them up, an n-gram that is frequent everywhere being one entry
  a block, and answers every block in the order it asked;
* *join*: a block and its answers meet by block number and give one row a
  document.

The number of partitions follows the corpus, so that a partition holds about
``PART_GRAMS`` entries at any size. Rows are blocks times partitions, so the
entries of a row get fewer as the corpus grows. Where they would be fewer than
``LEAST_ENTRIES``, packing gains nothing, and the tables are made of plain rows,
one for each different n-gram of a block, which grow with the words only. The
scores are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewarden.llm.scratch import stage
from lakewarden.sources.tables import table

BACKOFF = 0.4
#: N-grams of two or more words seen less often than this count as unseen.
LEAST_COUNT = 2
BLOCK_WORDS = 500_000
PART_GRAMS = 1_000_000
#: Entries of a packed row at least; below, n-grams are counted as rows of their own.
LEAST_ENTRIES = 16
ORDER = 2
#: Bytes of text coded at a time.
SLICE_BYTES = 4 << 20

BLOCK_FIELDS = "block long, doc_ids array<long>, sizes array<long>, words binary, numbers binary, n long"


def _mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of an n-gram from that of all but its last word and that of its last; order counts."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ second >> np.uint64(31)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Block:
    """Documents gathered until there are words enough for a row."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.coded: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.n = 0

    def add(self, ids: list[int | None], texts: pa.StringArray) -> None:
        """ASCII letters are folded; words part at ASCII white space; a null has none."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.numbers
        own = np.fromiter((known.setdefault(w, len(known)) if w else -1 for w in words), np.int64, len(words))
        numbers = own[coded.indices.to_numpy()]
        real = numbers >= 0  # white space at either end leaves an empty string
        at = np.concatenate(([0], np.cumsum(real)))
        bounds = split.offsets.to_numpy()
        self.ids += ids
        self.sizes += (at[bounds[1:]] - at[bounds[:-1]]).tolist()
        self.coded.append(numbers[real].astype(np.uint32))
        self.n += int(at[-1])

    def row(self, number: int) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.numbers), np.uint64, len(self.numbers))
        values = [[number], [self.ids], [self.sizes], [hashes.tobytes()], [zstandard.compress(np.concatenate([np.zeros(0, np.uint32), *self.coded]).tobytes(), 1)], [self.n]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names=["block", "doc_ids", "sizes", "words", "numbers", "n"])


def code_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of coded documents, staged (numbers of blocks depend on the run; what they hold does not matter to the scores)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, made, task = _Block(), 0, TaskContext.get().partitionId()
        for batch in batches:
            held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                block.add(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a))
                if block.n >= block_words:
                    yield block.row(task << 32 | made)
                    block, made = _Block(), made + 1
        if block.ids:
            yield block.row(task << 32 | made)

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(named.mapInArrow(run, BLOCK_FIELDS), "lm-blocks")


class _Grams:
    """The different n-grams of a block, those of each order numbered, with their hashes and counts."""

    def __init__(self, row: dict, order: int):
        self.sizes = np.array(row["sizes"], np.int64)
        words, numbers = np.frombuffer(row["words"], np.uint64), np.frombuffer(zstandard.decompress(row["numbers"]), np.uint32).astype(np.int64)
        starts = np.cumsum(self.sizes) - self.sizes
        place = np.arange(len(numbers)) - np.repeat(starts, self.sizes)  # of a word in its document
        #: For each order, where its n-grams end and the number of the n-gram that ends there.
        self.ends, self.own = [np.arange(len(numbers))], [numbers]
        hashes, counts = [words], [np.bincount(numbers, minlength=len(words))]
        number = numbers
        for k in range(1, order):
            ends = np.flatnonzero(place >= k)
            unique, own, n = np.unique(number[ends - 1] * max(len(words), 1) + numbers[ends], return_inverse=True, return_counts=True)
            first, second = np.divmod(unique, max(len(words), 1))
            hashes.append(_mix(hashes[-1][first], words[second]))
            counts.append(n)
            number = np.full(len(numbers), -1, np.int64)
            number[ends] = own
            self.ends.append(ends)
            self.own.append(own)
        self.starts = np.cumsum([0, *map(len, hashes)])
        whole = np.concatenate(hashes)
        self.by_hash = np.argsort(whole, kind="stable")
        self.hashes, self.counts = whole[self.by_hash], np.concatenate(counts)[self.by_hash]

    def log_scores(self, totals: np.ndarray, words: int, backoff: float, least_count: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 score and number of steps back of every word; ``totals`` are the corpus counts by ascending hash."""
        ordered = np.empty(len(totals), np.int64)
        ordered[self.by_hash] = totals
        count = [ordered[a:b] for a, b in zip(self.starts, self.starts[1:])]
        n = len(self.own[0])
        score, steps = np.log10(count[0][self.own[0]] / max(words, 1)), np.zeros(n, np.int64)
        before = np.zeros(n, np.int64)  # counts of the n-grams of the order below by where they end
        before[:] = count[0][self.own[0]]
        for k in range(1, len(self.own)):
            ends, found = self.ends[k], count[k][self.own[k]]
            seen = found >= least_count
            steps[ends] += 1
            score[ends] += np.log10(backoff)
            score[ends[seen]], steps[ends[seen]] = np.log10(found[seen] / before[ends[seen] - 1]), 0
            before = np.zeros(n, np.int64)
            before[ends] = found
        return score, steps


def _pack(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.astype(np.int64).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.int64)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Ascends with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def count_tables(blocks: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """(block, part, totals): counts over the whole corpus of the n-grams a block holds in a partition, by ascending hash."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, grams in _each_block(batches, order):
            part = _part(grams.hashes, parts)
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(cuts[1:], len(part))
            hashes = pa.array([grams.hashes[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())
            counts = pa.array([_pack(grams.counts[a:b]) for a, b in zip(cuts, ends)], pa.binary())
            yield pa.record_batch([pa.array(part[cuts]), pa.array([number] * len(cuts), pa.int64()), hashes, counts], names=["part", "block", "hashes", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, np.uint64) for h in asked.column("hashes").to_pylist()]
        counts = np.concatenate([_unpack(c) for c in asked.column("counts").to_pylist()])
        _, where = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(where, counts).astype(np.int64)[where]
        ends = np.cumsum([len(h) for h in hashes])
        packed = [_pack(totals[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return pa.table([asked.column("block"), asked.column("part"), pa.array(packed, pa.binary())], names=["block", "part", "totals"])

    asked = blocks.select("block", "sizes", "words", "numbers").mapInArrow(ask, "part long, block long, hashes binary, counts binary")
    return asked.groupBy("part").applyInArrow(answer, "block long, part long, totals binary")


def _each_block(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[int, _Grams]]:
    for batch in batches:
        for k in range(batch.num_rows):  # a block at a time
            row = batch.slice(k, 1).to_pylist()[0]
            yield row["block"], _Grams(row, order)


#: Entries of a piece of a block where n-grams are rows.
PIECE = 65_536


def plain_count_tables(blocks: DataFrame, order: int = ORDER) -> DataFrame:
    """As :func:`count_tables`, by rows: each different n-gram of a block is one, counted by an ordinary aggregate and joined back."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, grams in _each_block(batches, order):
            for a in range(0, len(grams.hashes), PIECE):
                hashes = grams.hashes[a : a + PIECE].view(np.int64)
                place = np.arange(len(hashes), dtype=np.int32)
                columns = [np.full(len(hashes), number), np.full(len(hashes), a // PIECE), place, hashes, grams.counts[a : a + PIECE]]
                yield pa.record_batch([pa.array(c) for c in columns], names=["block", "part", "place", "hash", "n"])

    def pack(found: pa.Table) -> pa.Table:
        totals = np.empty(found.num_rows, np.int64)
        totals[found.column("place").to_numpy()] = found.column("n").to_numpy()
        return pa.table([found.column("block").slice(0, 1), found.column("part").slice(0, 1), pa.array([_pack(totals)], pa.binary())], names=["block", "part", "totals"])

    grams = blocks.select("block", "sizes", "words", "numbers").mapInArrow(rows, "block long, part long, place int, hash long, n long")
    totals = grams.groupBy("hash").agg(F.sum("n").alias("n"))
    return grams.drop("n").join(totals, "hash").groupBy("block", "part").applyInArrow(pack, "block long, part long, totals binary")


def scores(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, block_words: int = BLOCK_WORDS, part_grams: int = PART_GRAMS, backoff: float = BACKOFF, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """Per row: doc_id, n_words, n_backoff (steps back), log_score (sum of log10 scores of its words).

    A word scores the share of the longest n-gram of up to ``order`` words that
    ends with it among those that begin alike, if it was seen ``least_count``
    times in the corpus, else ``backoff`` times what one word less of context
    gives; without context its share of all words. N-grams do not reach over the
    beginning of a document. A row without words, null ones too, scores 0 over 0
    words; repeated rows count and are scored each; an empty table gives an empty
    result; other columns are ignored.
    """
    blocks = code_blocks(docs, id_col=id_col, text_col=text_col, block_words=block_words)
    found = blocks.agg(F.sum("n").alias("words"), F.count("*").alias("blocks")).first()
    words = found.words or 0
    parts = max(1, -(-words * order // (2 * part_grams)))
    packed = parts == 1 or found.blocks * parts * LEAST_ENTRIES <= words * order
    answers = stage(count_tables(blocks, parts, order) if packed else plain_count_tables(blocks, order), "lm-counts")

    def join(key, block: pa.Table, answered: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        grams = _Grams(row, order)
        totals = np.concatenate([np.zeros(0, np.int64), *(_unpack(t) for _, t in sorted((r["part"], r["totals"]) for r in answered.to_pylist()))])
        each, steps = grams.log_scores(totals, words, backoff, least_count)
        ends = np.cumsum(grams.sizes)
        back = np.concatenate(([0], np.cumsum(steps)))
        sums = [float(each[a:b].sum()) for a, b in zip((ends - grams.sizes).tolist(), ends.tolist())]
        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(grams.sizes), pa.array(back[ends] - back[ends - grams.sizes]), pa.array(sums, pa.float64())], names=["doc_id", "n_words", "n_backoff", "log_score"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, "doc_id long, n_words long, n_backoff long, log_score double")


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Mean log10 score of a word, null without words."""
    found = scores(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_backoff", F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("score"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT b AS w, count(*) AS n FROM t GROUP BY b),
p AS (SELECT a, b, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b),
z AS (SELECT count(*)::DOUBLE AS total FROM t),
s AS (SELECT t.doc_id, CASE WHEN t.a IS NULL THEN log10(u.n / total) WHEN p.n >= 2 THEN log10(p.n / v.n) ELSE log10(u.n / total) + log10(0.4::DOUBLE) END AS s, t.a IS NOT NULL AND p.n < 2 AS back
      FROM t JOIN u ON t.b = u.w LEFT JOIN u v ON t.a = v.w LEFT JOIN p ON t.a = p.a AND t.b = p.b, z),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE back) AS k, sum(s) AS s FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_backoff, round(s / n, 6) AS score FROM d LEFT JOIN g USING (doc_id)
"""

QUERIES = {"op3_lm_scoring": op3_lm_scoring}
ORACLES = {"op3_lm_scoring": ORACLE}
