"""Links between texts whose shingle sets are at least ``similarity`` alike (Jaccard).

Used beside ball hashing where near copies must be found down to a Jaccard
similarity of 0.8. There, 64-bit fingerprints differ in 10 bits in the median
(measured on the test tables), and a ball of half that radius has more than
eight million variants, so ball hashing alone cannot find them.

Candidates share a band of MinHash values. At first every member of a band's
group meets the ``PIVOTS`` members that collide most over all bands - copies of
one text look more like it than like each other, and it collides most - and the
``NEXT`` members after it in an order that differs from band to band. Groups of
up to ``PIVOTS`` + 1 members so meet in full. What these links leave in several
components of a larger group then meets in full as well: the group is cut into
blocks of bounded size, and each two blocks that are not of one component
together count all their common shingles by matrix products. So every pair that
shares a band is verified or already in one component. A pair of blocks returns
a spanning forest only, so pairs are never written; a text is shuffled once for
every block that its own meets.
Every link is verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from lakewarden.llm.blocks import text_bytes
from lakewarden.llm.scratch import stage
from lakewarden.llm.shingles import shingle_hashes

BANDS, ROWS = 24, 5
PIVOTS, NEXT = 4, 3
SEED = 7
CHUNK = 1024
#: Texts whose sets go to the JVM at a time.
SET_ROWS = 128
#: A block of a group holds so many shingles, a text counting as LEAST_SET of them at least.
BLOCK_SHINGLES, LEAST_SET = 1 << 18, 256
#: Shingles that a matrix product counts at a time.
COLUMNS = 2048


def _band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key a band: the smallest values of its ROWS permutations, mixed."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[at : at + CHUNK, None] * a + b).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    dice = np.random.default_rng(SEED)
    a = dice.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, dice.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def band_keys(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of the bands of each text from its shingle hashes; none without words."""
    a, b = _permutations()
    return [_band_keys(h, a, b) if len(h) else np.zeros(0, np.int64) for h in hashes]


def band_groups(sketched: DataFrame) -> DataFrame:
    """(key, node, size) of the groups of two or more of ``sketched`` (node long, unique; keys), staged."""
    banded = sketched.select("node", F.explode("keys").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return stage(banded.join(sizes, "key"), "similar-bands")


def first_pairs(met: DataFrame) -> DataFrame:
    """Pairs (src, dst) of members of ``band_groups`` that meet at first, staged."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("node", "key"), "node")
    after = met.select("node", F.array(*[F.lag("node", k).over(order) for k in range(1, NEXT + 1)]).alias("others"))
    pairs = after.select("node", F.explode("others").alias("other")).filter("other is not null")
    ranked = met.join(met.groupBy("node").agg(F.sum("size").alias("degree")), "node")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("degree").desc(), "node"))
    pivots = ranked.withColumn("place", place).filter(F.col("place") <= PIVOTS).select("key", F.col("node").alias("other"))
    pairs = pairs.union(met.join(pivots, "key").select("node", "other").filter("node != other"))
    return stage(pairs.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).distinct(), "similar-pairs")


def candidates(sketched: DataFrame) -> DataFrame:
    """Pairs (src, dst) of ``sketched`` (node long, unique; keys) that meet in a band at first, staged."""
    return first_pairs(band_groups(sketched))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, shingles) of ``texts`` (node, text): the distinct shingle hashes and their number, staged."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SET_ROWS):
                batch = whole.slice(at, SET_ROWS)
                found = [np.unique(shingle_hashes(t, width)).view(np.int64) for t in text_bytes(batch.column(1))]
                sizes = pa.array([len(x) for x in found], pa.int32())
                yield pa.record_batch([batch.column(0), sizes, pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "shingles"])

    return stage(texts.select("node", "text").mapInArrow(sets, "node long, n int, shingles array<long>"), "similar-sets")


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose ``shingle_sets`` are at least ``similarity`` alike."""
    sets = sets.select("node", "shingles")
    both = pairs.join(sets.withColumnsRenamed({"node": "src", "shingles": "x"}), "src").join(sets.withColumnsRenamed({"node": "dst", "shingles": "y"}), "dst")
    # Counted row by row in the JVM: sets of long texts would make large Arrow batches.
    common = F.size(F.array_intersect("x", "y"))
    return both.select("src", "dst", (F.size("x") + F.size("y")).alias("n"), common.alias("common")).filter(F.col("common") >= (F.col("n") - F.col("common")) * similarity).select("src", "dst")


def verified(pairs: DataFrame, texts: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets are at least ``similarity`` alike; ``texts`` has (node, text) of all their nodes."""
    return alike(pairs, shingle_sets(texts, width), similarity)


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The number of common values of each set of ``x`` and each of ``y``."""
    sizes = np.array([len(s) for s in [*x, *y]])
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    # Values of a single set are in no intersection.
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[column]
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    counts = np.zeros((len(x), len(y)), np.float32)
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        a, b = np.searchsorted(place, [at, at + COLUMNS])
        present = np.zeros((len(sizes), COLUMNS), np.float32)
        present[row[a:b], place[a:b] - at] = 1
        counts += present[: len(x)] @ present[len(x) :].T
    return counts.astype(np.int64)


def forest(src: np.ndarray, dst: np.ndarray) -> list[tuple[int, int]]:
    """Links of ``src`` and ``dst`` enough for the same closure."""
    above: dict[int, int] = {}

    def top(i: int) -> int:
        while (up := above.get(i, i)) != i:
            above[i] = above.get(up, up)
            i = up
        return i

    out = []
    for i, j in zip(src.tolist(), dst.tolist()):
        a, b = top(i), top(j)
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def group_links(groups: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) that join all pairs of a group (key, node) at least ``similarity`` alike, staged.

    ``roots`` (node, root) are the components known so far, of nodes that have a link: pairs of one component
    are left alone, and the links are between roots.
    """
    member = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mark = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"mark{k}") for k in range(2)]
    open_ = member.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"), *mark)
    # Bands of the same members would only repeat each other.
    open_ = open_.filter("lo != hi").groupBy("members", "mark0", "mark1").agg(F.min("key").alias("key")).select("key")
    member = stage(member.join(open_, "key"), "open-groups").join(sets.select("node", "n"), "node")
    weight = F.greatest("n", F.lit(LEAST_SET)).cast("long")
    before = F.sum(weight).over(Window.partitionBy("key").orderBy("root", "node").rowsBetween(Window.unboundedPreceding, -1))
    member = stage(member.select("key", "node", "root", F.floor(F.coalesce(before, F.lit(0)) / BLOCK_SHINGLES).cast("int").alias("block")), "blocks")
    blocks = member.groupBy("key", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    x, y = blocks.withColumnsRenamed({"block": "i"}), blocks.select("key", F.col("block").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    meet = x.join(y, "key").filter("i <= j and not (lo = hi and lo2 = hi2 and lo = lo2)").select("key", "i", "j")
    sides = meet.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = sides.join(member, ["key", "block"]).join(sets.select("node", "shingles"), "node").select("key", "i", "j", "block", "node", "root", "shingles")

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        block, root = table.column("block").to_numpy(), table.column("root").to_numpy()
        listed = table.column("shingles").combine_chunks()
        at, values = listed.offsets.to_numpy(), listed.values.to_numpy()
        found = [values[a:b] for a, b in zip(at[:-1], at[1:])]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        x, y = [found[k] for k in left], [found[k] for k in right]
        common = common_counts(x, y)
        n = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
        hit = (common >= (n - common) * similarity) & (root[left][:, None] != root[right][None, :])
        a, b = np.nonzero(hit)
        links = forest(root[left[a]], root[right[b]])
        return pa.table({"src": pa.array([s for s, _ in links], pa.int64()), "dst": pa.array([d for _, d in links], pa.int64())})

    return stage(dealt.groupBy("key", "i", "j").applyInArrow(link, "src long, dst long"), "group-links")
