"""SimHash: fingerprints against the definition, links against all pairs."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from lakewarden.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: list of (doc_id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least[find(i)]) for i, (d, _) in enumerate(fps)]


def test_documents(spark):
    dice = random.Random(5)
    base = [" ".join(f"w{dice.randrange(400)}" for _ in range(300)) for _ in range(12)]
    texts = [None, "", "A", "a b", "A b\tC\x0bd", "É ÀB c d", "x " * 20000] + base
    for t in base[:6]:
        for _ in range(6):
            w = t.split()
            w[dice.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    docs = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs += docs[7:9]
    frame = spark.createDataFrame(docs, SCHEMA).withColumn("fp", F.lit("own")).withColumn("root", F.lit(1))
    want = [(i, plain_fingerprint(t)) for i, t, *_ in docs]
    out = simhash.near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.fp % 2**64) for r in out) == sorted(want)
    assert sorted((r.doc_id, r.component_id) for r in out) == sorted(plain_components(want))
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in plain_components(want)})
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_links_of_fingerprints(spark):
    dice = random.Random(9)
    fps = set()
    for _ in range(60):
        x = dice.getrandbits(64)
        fps.add(x)
        for k in (1, 2, 3, 3, 3, 4, 5):
            y = x
            for b in dice.sample(range(64), k):
                y ^= 1 << b
            fps.add(y)
    chain = dice.getrandbits(64)
    for k in range(0, 60, 3):  # a long chain, three bits a step
        fps.add(chain)
        chain ^= 0b111 << k
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    near = {r.fp % 2**64 for r in simhash.possible_neighbours(frame).collect()}
    assert near >= {x for x in fps for y in fps if x != y and (x ^ y).bit_count() <= 3}
    roots = {r.node % 2**64: r.root for r in simhash.components(simhash.star_links(frame)).collect()}
    want = dict(plain_components([(x, x) for x in fps]))
    same = {}
    for x in fps:
        same.setdefault(roots.get(x, x), set()).add(want[x])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(want.values()))


def test_similarity_and_clashing_columns(spark):
    dice = random.Random(11)
    words = [f"w{dice.randrange(999)}" for _ in range(200)]
    near = list(words)
    near[100] = near[50] = "new"
    texts = [" ".join(words), " ".join(near), " ".join(reversed(words)), None]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    frame = frame.withColumns({c: F.lit("own") for c in ("fp", "node", "keys", "least_id", "component_id", "src")})
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, width=5, similarity=0.8).collect()}
    assert out == {0: 0, 1: 0, 2: 2, 3: 3}
    assert simhash.drop_near_duplicates(frame, width=5, similarity=0.8).columns == frame.columns
    assert simhash.near_duplicates(frame.limit(0), width=5, similarity=0.8).count() == 0


def test_similarity_of_other_texts_of_a_fingerprint_and_of_null_ids(spark):
    dice = random.Random(12)
    words = [f"w{dice.randrange(9999)}" for _ in range(300)]
    near = [*words[:297], "n1", "n2", "n3"]
    other, copy = " ".join(words), " ".join(near)
    rows = [(None, other, "en", "s", 0), (5, copy, "en", "s", 0), (None, None, "en", "s", 0)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=5, similarity=0.8).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (-1, 5), (5, 5)]
    # a: one edit from b, which has its fingerprint; c: similar to b only
    while True:
        a = [f"w{dice.getrandbits(30)}" for _ in range(300)]
        b = list(a)
        b[dice.randrange(20, 280)] = f"n{dice.getrandbits(30)}"
        if simhash.fingerprint(" ".join(a).encode(), 5) == simhash.fingerprint(" ".join(b).encode(), 5):
            break
    sets = lambda w: set(simhash.shingle_hashes(" ".join(w).encode(), 5).tolist())
    alike = lambda x, y: len(sets(x) & sets(y)) >= 0.8 * len(sets(x) | sets(y))
    c, at = list(b), 0
    while alike(a, c):
        c[at] = f"m{dice.getrandbits(30)}"
        at += 1
    texts = [" ".join(x) for x in (a, b, c)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame, width=5, similarity=0.8).collect()}
    assert alike(b, c) and out == {0: 0, 1: 0, 2: 0}


def test_every_pair_of_edited_copies_at_the_similarity_is_caught(spark):
    dice, rows = random.Random(13), []
    for at in range(60):
        words = [f"t{dice.randrange(400)}" for _ in range(dice.randint(20, 120))]
        rows.append((len(rows), " ".join(words), "en", "s", 0))
        for edits in range(5):
            copy = list(words)
            for _ in range(edits):
                copy[dice.randrange(len(copy))] = f"z{dice.getrandbits(30)}"
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    sets = [frozenset(simhash.shingle_hashes(r[1].encode(), 5).tolist()) for r in rows]
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=5, similarity=0.8).collect()}
    above = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = above[i], above[j]
                above = [min(a, b) if k in (a, b) else k for k in above]
    assert len(set(above)) not in (60, len(rows)) and out == dict(enumerate(above))
