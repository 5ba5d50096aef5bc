"""Benchmark decontamination with a generalised suffix automaton of the items.

Automata are built on the driver from the benchmark only and sent to the
executors. Their size is proven first: words are counted and, beyond
``block_words``, items are dealt to blocks; each block gets a pass over the
corpus, and the spans are united before anything is judged or cut. So neither
driver nor executors ever hold more than one block. A block is built as automata
of ``SEGMENT_WORDS`` words, one after another, since one that grows takes some
fifteen times the memory of a finished one.

Texts are streamed as bytes. Only stretches in which every word and every word
pair occurs in the items can hold a window, so the automaton walks those alone;
the pair test is a bitmap lookup and never misses a pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewarden.llm.automaton import SuffixAutomaton
from lakewarden.llm.blocks import text_bytes, unused
from lakewarden.llm.scratch import discard, stage
from lakewarden.sources.tables import table

WINDOW = 10
#: Items of more words in all are dealt to blocks.
BLOCK_WORDS = 2_000_000
#: A new automaton is begun after so many words.
SEGMENT_WORDS = 200_000
#: A document goes as a whole if more than this share of its words is hit.
COVERAGE_LIMIT = 0.5
PAIR_BITS = 22
#: States of a document between rounds of cutting.
OPEN, GONE = 1, 2

#: Bytes of a word: 0-9, a-z after lower-casing, everything beyond ASCII; others part words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - PAIR_BITS)


@dataclass
class Matcher:
    """One block of items, ready to search texts."""

    numbers: dict[bytes, int]
    automata: list[SuffixAutomaton]
    pairs: np.ndarray
    shortest: int

    @classmethod
    def build(cls, items: list[tuple[object, bytes | None]], window: int = WINDOW) -> Matcher:
        numbers: dict[bytes, int] = {}
        automata, pairs, shortest, held = [SuffixAutomaton(window)], np.zeros(1 << PAIR_BITS, bool), window, 0
        for item, text in items:
            ids = [numbers.setdefault(w, len(numbers)) for w in words_of(text)]
            if held and held + len(ids) > SEGMENT_WORDS:
                automata[-1].finish()
                automata.append(SuffixAutomaton(window))
                held = 0
            automata[-1].add(item, ids)
            held += len(ids)
            if ids:
                shortest = min(shortest, len(ids))
                codes = np.array(ids, np.int64)
                pairs[_pair_codes(codes[:-1], codes[1:])] = True
        automata[-1].finish()
        return cls(numbers, automata, pairs, shortest)

    def _walk(self, ids: list[int], at: int) -> tuple[list[tuple[int, int]], set]:
        spans, found = [], set()
        for automaton in self.automata:
            some, items = automaton.find(ids)
            spans += [(at + x, at + y) for x, y in some]
            found |= items
        return spans, found

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words and the items whose windows occur."""
        if not self.numbers or len(words) < self.shortest:
            return [], set()
        get = self.numbers.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        if self.shortest < 2:
            spans, found = self._walk(ids.tolist(), 0)
            return _merge(spans), found
        joined = (ids[:-1] >= 0) & (ids[1:] >= 0)
        joined[joined] = self.pairs[_pair_codes(ids[:-1][joined], ids[1:][joined])]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
        spans, found = [], set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + 1 >= self.shortest:
                some, items = self._walk(ids[a : b + 1].tolist(), a)
                spans += some
                found |= items
        return _merge(spans), found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[object, bytes | None]]]:
    """Items dealt by hash to blocks of ``block_words`` / 2 words on average, each read when its turn comes. Starts jobs."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)) + 1
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    blocks = 1 if total <= block_words else -(-2 * total // block_words)
    for block in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)) == block).select(F.col(id_col).alias("item"), F.col(text_col).cast("binary").alias("t")).collect()
        yield [(r.item, None if r.t is None else bytes(r.t)) for r in rows]


ARROW = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


def _per_text(docs: DataFrame, column: str, matchers: list, visit: Callable, fields: str) -> DataFrame:
    """mapInArrow that replaces ``column`` by the ``fields`` that ``visit(value, matchers)`` returns."""
    made = [f.split(" ", 1) for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = [m.value for m in matchers]
        for batch in batches:
            at = batch.schema.get_field_index(column)
            values = batch.column(at)
            values = text_bytes(values) if pa.types.is_string(values.type) else values.to_pylist()
            found = [visit(v, loaded) for v in values]
            others = [i for i in range(batch.num_columns) if i != at]
            columns = [batch.column(i) for i in others] + [pa.array([f[k] for f in found], ARROW[kind]) for k, (_, kind) in enumerate(made)]
            yield pa.record_batch(columns, names=[batch.schema.names[i] for i in others] + [name for name, _ in made])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != column)
    return docs.mapInArrow(run, kept + fields)


def _united(flat: list[int], _: list) -> tuple:
    """Spans of several blocks, merged."""
    return ([x for span in _merge(list(zip(flat[::2], flat[1::2]))) for x in span],)


def _search(text: bytes | None, matchers: list[Matcher]) -> tuple:
    words = words_of(text)
    spans, found = [], set()
    for m in matchers:
        some, items = m.find(words)
        spans += some
        found |= items
    return len(words), [x for span in _merge(spans) for x in span], [None if i is None else str(i) for i in found]


FOUND = "n_words long, spans array<long>, items array<string>"


def _each_block(blocks: Iterable, rows: DataFrame, column: str, window: int) -> Iterator[DataFrame]:
    """What each block finds in ``column`` of ``rows``, one after another; the block's automata are dropped when the next is asked for."""
    for block in blocks:
        shared = rows.sparkSession.sparkContext.broadcast(Matcher.build(block, window))
        yield _per_text(rows, column, [shared], _search, FOUND)
        shared.destroy()


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per row: doc_id, n_words, spans (flat [start, end) word places, merged), items (ids as strings, unordered).

    Null and wordless texts have no words and no spans; repeated rows are
    searched each; an item without an id is one item whose id is null; empty
    tables on either side work; other columns are ignored.
    """
    spark = docs.sparkSession
    blocks = item_blocks(benchmark, id_col=item_col, text_col=item_text_col, block_words=block_words)
    first, second = next(blocks, []), next(blocks, None)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    if second is None:
        return _per_text(named, "_text", [spark.sparkContext.broadcast(Matcher.build(first, window))], _search, FOUND)
    # Texts are written once, with a number; of the blocks only numbers and what they hit.
    rows = stage(named.withColumn("_row", F.monotonically_increasing_id()), "contamination-texts")
    parts: list[DataFrame] = []
    for found in _each_block(chain([first, second], blocks), rows, "_text", window):
        found = found if not parts else found.filter("size(spans) > 0").withColumns({"doc_id": F.lit(None).cast(named.schema["doc_id"].dataType), "n_words": F.lit(None).cast("long")})
        parts.append(stage(found, "contamination"))
    discard(rows)
    united = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return _per_text(united.drop("_row"), "_spans", [], _united, "spans array<long>").select("doc_id", "n_words", "spans", "items")


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    pieces, at = [], 0
    for a, b in spans:
        pieces.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*pieces, text[at:]])


def _cut(text: bytes | None, matchers: list[Matcher], limit: float) -> tuple[bytes | None, int]:
    """The text without its hit spans, 1 if the document stays. Cutting can bring words together, so it is done until nothing is hit."""
    if text is None:
        return None, 1
    total = hit = 0
    while True:
        words = words_of(text)
        spans = _merge([span for m in matchers for span in m.find(words)[0]])
        total = total or len(words)
        if not spans:
            return text, 1
        hit += sum(b - a for a, b in spans)
        if hit > limit * total:
            return text, 0
        text = _without(text, spans)


def _cut_once(row: dict, limit: float) -> tuple[bytes, int, int, int]:
    """One round of ``_cut`` with the spans of all blocks: text, words at first, words hit so far, and OPEN if cut, GONE if beyond the limit."""
    text, total, hit = bytes(row["text"]), row["total"], row["hit"]
    spans = _merge(list(zip(row["spans"][::2], row["spans"][1::2])))
    total = total or len(words_of(text))
    hit += sum(b - a for a, b in spans)
    return (text, total, hit, GONE) if hit > limit * total else (_without(text, spans), total, hit, OPEN)


def _cut_by_blocks(docs: DataFrame, read_blocks: Callable[[], Iterable], text_col: str, window: int, limit: float) -> DataFrame:
    """As with one automaton: each round unites the spans of all blocks and cuts once; documents that were cut come again until nothing is hit.

    Texts are written once a round; blocks write the numbers of hit rows and
    their spans, which meet the rows in a join that Spark plans by their size.
    """
    own = docs.columns
    number, total, hit, spans, state, text, row = unused(own, "row", "total", "hit", "spans", "state", "after", "cut")
    done, rows = [], docs.withColumns({total: F.lit(0).cast("long"), hit: F.lit(0).cast("long")})
    while True:
        rows = stage(rows.withColumn(number, F.monotonically_increasing_id()), "cut")
        searched = rows.select(F.col(number).alias("_row"), F.col(text_col).alias("_text"))
        parts = [stage(found.filter("size(spans) > 0").select("_row", "spans"), "cut-spans") for found in _each_block(read_blocks(), searched, "_text", window)]
        hits = reduce(DataFrame.union, parts).groupBy(F.col("_row").alias(number)).agg(F.flatten(F.collect_list("spans")).alias(spans))
        hits = stage(hits, "cut-hits")
        for part in parts:
            discard(part)
        done.append(rows.join(hits, number, "left_anti").select(*own))
        met = F.struct(F.col(text_col).cast("binary").alias("text"), F.col(total).alias("total"), F.col(hit).alias("hit"), F.col(spans).alias("spans"))
        open_ = rows.join(hits, number).withColumn(row, met).drop(text_col, total, hit, spans, number)
        cut = _per_text(open_, row, [], lambda r, _: _cut_once(r, limit), f"{text} binary, {total} long, {hit} long, {state} long")
        rows = cut.filter(F.col(state) == OPEN).withColumn(text_col, F.col(text).cast("string")).select(*own, total, hit)
        if hits.isEmpty():
            return reduce(DataFrame.union, done)


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", length_col: str | None = None, window: int = WINDOW, coverage_limit: float = COVERAGE_LIMIT,
    item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without benchmark spans, columns unchanged; documents hit beyond ``coverage_limit`` of their words at first go.

    ``length_col``, if named, gets the length in code points of every text. The
    result does not depend on how items are dealt to blocks. A null or empty
    text stays as it is; repeated rows are cut each; an empty table gives an
    empty result, an empty benchmark leaves all as it is; other columns, of
    whatever name, are passed on.
    """
    spark, own = docs.sparkSession, docs.columns

    def read_blocks() -> Iterator:
        return item_blocks(benchmark, id_col=item_col, text_col=item_text_col, block_words=block_words)

    blocks = read_blocks()
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        before, after, stays = unused(own, "before", "after", "stays")
        shared = spark.sparkContext.broadcast(Matcher.build(first, window))
        renamed = docs.withColumn(before, F.col(text_col).cast("string")).drop(text_col)
        docs = _per_text(renamed, before, [shared], lambda t, m: _cut(t, m, coverage_limit), f"{after} binary, {stays} long")
        docs = docs.filter(F.col(stays) == 1).drop(stays).withColumn(text_col, F.col(after).cast("string"))
    else:
        first = second = None
        docs = _cut_by_blocks(docs.withColumn(text_col, F.col(text_col).cast("string")), read_blocks, text_col, window, coverage_limit)
    if length_col:
        docs = docs.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.char_length(text_col)).cast("long"))
    return docs.select(*own)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hits = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH u AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT item_id, w[i:i + least(len(w), 10) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM u WHERE len(w) > 0)),
k AS (SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM v),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT p.doc_id, p.i, s.n, array_to_string(p.w[p.i:p.i + s.n - 1], ' ') AS g FROM p, (SELECT DISTINCT n FROM k) s WHERE p.i + s.n - 1 <= len(p.w)),
f AS (SELECT m.doc_id, m.i, m.n, k.item_id FROM m JOIN k ON m.g = k.g AND m.n = k.n),
h AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM f)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

QUERIES = {"op2_decontamination": op2_decontamination}
ORACLES = {"op2_decontamination": ORACLE}
