"""SimHash near-duplicates by ball hashing on variants that meet in the middle.

Fingerprints at 3 or fewer differing bits are linked. One row stands for all
documents of a fingerprint, so exact copies never meet each other.

*Balls.* Every fingerprint emits its ball of radius 1, half the radius rounded
down: two balls share a variant exactly when the fingerprints differ in at most
2 bits. A difference of 3 bits needs radius 1 on one side and 2 on the other;
such pairs have opposite parity, so only fingerprints of even parity add an
outer shell of two flipped bits. Of any three bits two lie in the same half of
the word, so the shell holds pairs within a half only. Members of a variant
whose flips are at most 1 (its core) are all linked to each other and to every
member of its shell, so a star on the smallest core member carries all links of
the variant: no pairs are made, and nothing is left to verify.

*Sieve.* Most fingerprints have no neighbour, and a shell has 992 variants, so a
first round looks for fingerprints that may have one. It hides one third of
the bits at a time: of at most 3 differing bits some third holds one or none at
worst, and hiding a third that holds a difference leaves at most 2, so radius-1
balls on the remaining bits meet. Only fingerprints that met another go on.

*Groups.* Stars are joined to components by large-star and small-star rounds
over written tables; nothing about the corpus reaches the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lakewarden.llm.blocks import text_bytes, unused
from lakewarden.llm.scratch import discard, stage
from lakewarden.llm.shingles import SEED, shingle_hashes
from lakewarden.llm.similarity import PIVOTS, alike, band_groups, band_keys, first_pairs, group_links, shingle_sets
from lakewarden.sources.tables import table

BITS = 64
RADIUS = 3
SHINGLE = 3
#: A fingerprint of more than one row in so many is joined apart.
HOT = 1000
#: Shingles whose bits are counted at a time, so that long texts need no more memory.
CHUNK = 1 << 14


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text as a signed long; no words give 0."""
    return simhash(shingle_hashes(text, width, seed))


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed long; 0 of none."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, n, CHUNK):
        piece = hashes[at : at + CHUNK]
        bits = np.unpackbits(piece.view(np.uint8).reshape(len(piece), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    packed = np.packbits(2 * ones > n, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED, sketch: bool = False) -> DataFrame:
    """(doc_id, fp) for every row; null and wordless texts have fingerprint 0.

    With ``sketch`` also ``mark``, a hash of the text, ``node``, a hash of its
    set of shingles, and the band keys of ``similarity``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, nodes, keys = [], [], []
            for text in text_bytes(batch.column(1)):
                hashes = shingle_hashes(text, width, seed)
                found.append(simhash(hashes))
                if sketch:
                    nodes.append(set_hash(hashes))
                    keys += band_keys([hashes])
            more = [batch.column(2), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))] if sketch else []
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64()), *more], names=["doc_id", "fp", "mark", "node", "keys"][: 2 + 3 * sketch])

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[text_mark(text_col)] * sketch)
    return named.mapInArrow(run, "doc_id long, fp long" + ", mark long, node long, keys array<long>" * sketch)


def text_mark(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string")).alias("mark")


def set_hash(hashes: np.ndarray) -> int:
    """A signed long of the set of ``hashes``, the same for texts of the same shingles."""
    return signed(xxhash.xxh64_intdigest(np.unique(hashes).tobytes()))


def spread(df: DataFrame, column: str) -> DataFrame:
    """Dealt by hash to as many tasks as the session shuffles into, so that few small files do not mean few tasks for many variants."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)


def _array(values: list[int]) -> Column:
    return F.array(*[F.lit(signed(v)) for v in values])


def _flips(fp: Column, masks: list[int]) -> Column:
    return F.transform(_array(masks), lambda m: fp.bitwiseXOR(m))


def _thirds() -> list[list[int]]:
    return [[b for b in range(BITS) if b % 3 == part] for part in range(3)]


def possible_neighbours(fps: DataFrame) -> DataFrame:
    """Fingerprints (column ``fp``, distinct) that share a variant with another once a third of the bits is hidden.

    None that has a neighbour within the radius is missed; a few others pass.
    """
    balls = []
    for part, hidden in enumerate(_thirds()):
        seen = ~sum(1 << b for b in hidden) & (2**64 - 1)
        masks = [0] + [1 << b for b in range(BITS) if b not in hidden]
        # The hidden bits tell the thirds apart; should two still agree by chance, a fingerprint more passes.
        mark = sum(1 << b for b in hidden[: part * 5])
        balls.append(_flips(F.col("fp").bitwiseAND(F.lit(signed(seen))).bitwiseOR(F.lit(signed(mark))), masks))
    emitted = spread(fps, "fp").select("fp", F.explode(F.concat(*balls)).alias("v"))
    beside = Window.partitionBy("v").orderBy("fp")
    met = emitted.select("fp", (F.lag("fp").over(beside).isNotNull() | F.lead("fp").over(beside).isNotNull()).alias("met"))
    return met.filter("met").select("fp").distinct()


def star_links(fps: DataFrame) -> DataFrame:
    """Links (src, dst) between distinct fingerprints whose closure is that of all pairs within the radius."""
    halves = [range(BITS // 2), range(BITS // 2, BITS)]
    core = [0] + [1 << b for b in range(BITS)]
    shell = [1 << a | 1 << b for half in halves for a in half for b in half if a < b]
    fp = F.col("fp")
    outer = F.when(F.bit_count("fp") % 2 == 0, _flips(fp, shell)).otherwise(F.array().cast("array<long>"))
    ball = F.concat(
        F.transform(_flips(fp, core), lambda v: F.struct(v.alias("v"), F.lit(True).alias("core"))),
        F.transform(outer, lambda v: F.struct(v.alias("v"), F.lit(False).alias("core"))),
    )
    emitted = spread(fps, "fp").select("fp", F.explode(ball).alias("at")).select("fp", "at.*")
    # At most 2,081 fingerprints can lie within 2 bits of a variant, so a group is bounded.
    groups = emitted.groupBy("v").agg(F.min(F.when(F.col("core"), fp)).alias("src"), F.collect_list("fp").alias("members"))
    linked = groups.filter("src is not null and size(members) > 1").select("src", F.explode("members").alias("dst"))
    return linked.filter("src != dst").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of ``links`` (src, dst), for nodes that have a link.

    Alternates large-star and small-star until nothing changes. Each round is
    staged, so lineage stays short and a lost executor costs one task.
    """
    edges = stage(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        after = stage(small.filter("u != v").distinct(), "stars")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(edges)
        edges = after
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark


def similar_links(docs: DataFrame, rows: DataFrame, *, text_col: str, width: int, similarity: float) -> DataFrame:
    """Links (src, dst) between nodes of ``rows`` (``fingerprints`` with ``sketch``) whose shingle sets are ``similarity`` alike.

    Near and equal fingerprints are candidates like shared bands: each component of near fingerprints is a group
    whose members meet in full unless they are linked already.
    """
    marks = rows.groupBy("node").agg(F.min("mark").alias("mark"), F.min("keys").alias("keys"))
    met = band_groups(marks.select("node", "keys"))
    held = stage(rows.select("fp", "node").distinct(), "held")
    near = components(star_links(stage(possible_neighbours(held.select("fp").distinct()), "neighbours"))).withColumnRenamed("node", "fp")
    near = held.join(near, "fp", "left").select(F.coalesce("root", "fp").alias("key"), "node").distinct()
    near = stage(near.join(near.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key").select("key", "node"), "near")
    involved = met.select("node").union(near.select("node")).distinct().join(marks.select("node", "mark"), "node")
    texts = docs.select(text_mark(text_col), F.col(text_col).cast("string").alias("text")).join(involved, "mark")
    sets = shingle_sets(texts.groupBy("node").agg(F.first("text").alias("text")), width)
    known = components(alike(first_pairs(met), sets, similarity))
    groups = met.filter(F.col("size") > PIVOTS + 1).select("key", "node").union(near)
    links = known.filter("node != root").select(F.col("node").alias("src"), F.col("root").alias("dst"))
    return links.union(group_links(groups, known, sets, similarity))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED, similarity: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own
    included. Rows without text share fingerprint 0 and are linked like others;
    repeated rows stay; a null doc_id is never the smallest; an empty table
    gives an empty result; other columns are ignored.

    With ``similarity``, near fingerprints are only candidates, beside those of
    ``similarity``: texts are linked if their shingle sets are that much alike.
    There one node stands for all texts of the same set.
    """
    rows = stage(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, seed=seed, sketch=similarity is not None), "fingerprints")
    unit = "fp" if similarity is None else "node"
    classes = stage(rows.groupBy(unit).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "classes")
    if similarity is None:
        links = star_links(stage(possible_neighbours(classes.select("fp")), "neighbours"))
    else:
        links = similar_links(docs, rows, text_col=text_col, width=width, similarity=similarity)
    roots = components(links).withColumnRenamed("node", unit)
    grouped = classes.join(roots, unit, "left").withColumn("root", F.coalesce("root", unit))
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # Only classes with a link need the second join; the rest answer for themselves.
    linked = grouped.join(roots.select(unit), unit, "left_semi").join(least, "root").select(unit, "component_id")
    ids = classes.join(linked, unit, "left").select(unit, "copies", F.coalesce("component_id", "least_id").alias("component_id"))
    # A fingerprint or set may hold a third of all rows. Those of more than one row in HOT number fewer than HOT and are
    # broadcast, so that their rows stay where they are; the others meet in an ordinary join.
    least = rows.count() / HOT
    hot, others = F.broadcast(ids.filter(F.col("copies") > least).drop("copies")), ids.filter(F.col("copies") <= least).drop("copies")
    rows = rows.select("doc_id", "fp", *[unit] * (unit != "fp"))
    return rows.join(hot, unit).union(rows.join(hot.select(unit), unit, "left_anti").join(others, unit)).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with one document left of each component, the one with the smallest id; columns unchanged.

    A row that repeats the surviving id goes too: of several the one with the
    least hash of all columns stays, once. Rows without an id stay if no row of
    their component has one. Null and wordless texts are one component; an
    empty table gives an empty result; other columns, of whatever name, are
    passed on.
    """
    own, key = docs.columns, options.get("id_col", "doc_id")
    kept, copies, first_row = unused(own, "kept", "copies", "first_row")
    survives = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = near_duplicates(docs, **options).groupBy(F.col("doc_id").alias(kept)).agg(F.count("*").alias(copies), survives.alias(first_row)).filter(F.col(first_row)).drop(first_row)
    left = docs.join(keep, F.col(key).cast("long").eqNullSafe(F.col(kept)))
    # Ids that do not repeat, and rows without one, are done; of the others only those that repeat meet, by partial minima.
    single = (F.col(copies) == 1) | F.col(kept).isNull()
    done, rest = left.filter(single).select(*own), left.filter(~single)
    first = rest.groupBy(F.col(kept)).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias(first_row)).select(f"{first_row}.*")
    return done.unionByName(first)


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
