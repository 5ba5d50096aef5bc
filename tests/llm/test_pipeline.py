"""The pipeline against a brute-force version of every stage, each on its own input."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lakewarden.llm import mixing, similarity, simhash
from lakewarden.llm.shingles import shingle_hashes
from lakewarden.sources import staging
from tests.llm.test_decontaminate import plain_hits, words
from tests.llm.test_mixing import plain_targets
from tests.llm.test_quality import plain
from tests.llm.test_simhash import plain_components

FOLDER = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) > width else {" ".join(w)} if w else set()


def test_similar_links(spark):
    dice, texts = random.Random(2), []
    for _ in range(25):
        w = [f"w{dice.randrange(5000)}" for _ in range(dice.randrange(30, 250))]
        texts.append(" ".join(w))
        for _ in range(dice.choice([0, 1, 3, 12])):
            v = list(w)
            for _ in range(dice.choice([1, 1, 2, 3, 9])):
                v[dice.randrange(len(v))] = f"n{dice.randrange(99)}"
            texts.append(" ".join(v))
    texts += [None, "", "one", "one two"]
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    keys = similarity.band_keys([shingle_hashes((t or "").encode(), 5) for t in texts])
    sketched = spark.createDataFrame([(i, k.tolist()) for i, k in enumerate(keys)], "node long, keys array<long>")
    got = {(r.src, r.dst) for r in similarity.verified(similarity.candidates(sketched), frame, width=5, similarity=0.8).collect()}
    sets = [shingles(t) for t in texts]
    alike = lambda x, y: bool(x) and len(x & y) >= 0.8 * len(x | y)
    want = {(i, j) for j in range(len(sets)) for i in range(j) if alike(sets[i], sets[j])}
    assert got <= want
    def groups(links):
        root = list(range(len(sets)))
        def find(i):
            while root[i] != i:
                i = root[i]
            return i
        for i, j in links:
            root[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(len(sets))]
    assert groups(got) == groups(want)


def test_template_family_meets_in_full(spark):
    """Documents that share most shingles fill groups of every band; only the planted pairs are alike enough."""
    dice = random.Random(3)
    new = lambda n: [f"x{dice.getrandbits(40)}" for _ in range(n)]
    template, texts = new(784), []
    for _ in range(150):
        own = new(16)
        texts += [" ".join([*template, *own, *new(90)]) for _ in range(2)]
    hashes = [np.unique(shingle_hashes(t.encode(), 5)) for t in texts]
    common = similarity.common_counts(hashes, hashes)
    whole = [set(x.tolist()) for x in hashes]
    assert common.tolist() == [[len(x & y) for y in whole] for x in whole]
    n = common.diagonal()
    met = common >= (n[:, None] + n - common) * 0.8
    assert all(met[i, j] == (i // 2 == j // 2) for i in range(len(texts)) for j in range(len(texts)))
    keys = [k.tolist() for k in similarity.band_keys(hashes)]
    pairs = {(k, k + 1) for k in range(0, len(texts), 2) if set(keys[k]) & set(keys[k + 1])}
    assert len(pairs) > 145
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    groups = similarity.band_groups(spark.createDataFrame(list(enumerate(keys)), "node long, keys array<long>"))
    sets = similarity.shingle_sets(frame, 5)
    first = similarity.alike(similarity.first_pairs(groups), sets, 0.8)
    rest = similarity.group_links(groups.select("key", "node"), simhash.components(first), sets, 0.8)
    at_first = {(r.src, r.dst) for r in first.collect()}
    assert at_first < pairs
    assert at_first | {(min(r), max(r)) for r in rest.collect()} == pairs
    # near fingerprints are no links: none but the planted pairs are one document
    docs = frame.withColumnRenamed("node", "doc_id")
    fps = [simhash.fingerprint(t.encode(), 5) % 2**64 for t in texts]
    near = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert near - pairs
    roots = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=5, similarity=0.8).collect()}
    alone = {(k, k + 1) for k in range(0, len(texts), 2)} - pairs - near
    assert roots == {i: i if (i // 2 * 2, i // 2 * 2 + 1) in alone else i // 2 * 2 for i in range(len(texts))}


def test_group_links_over_blocks(spark, monkeypatch):
    dice = random.Random(8)
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 1500)
    sets = [sorted(dice.sample(range(40), dice.choice([30, 34, 36]))) for _ in range(60)] + [[]]
    frame = spark.createDataFrame([(i, len(x), x) for i, x in enumerate(sets)], "node long, n int, shingles array<long>")
    groups = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(len(sets))], "key long, node long")
    roots = spark.createDataFrame([(i, 3) for i in (3, 7, 11)], "node long, root long")
    links = [(r.src, r.dst) for r in similarity.group_links(groups, roots, frame, 0.8).collect()]
    top = {i: 3 if i in (7, 11) else i for i in range(len(sets))}
    want = [(top[i], top[j]) for j in range(len(sets)) for i in range(j) if sets[i] and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]

    def closure(pairs):
        root = dict(top)
        for i, j in pairs:
            a, b = root[i], root[j]
            root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
        return root

    assert closure(links) == closure(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    # quality: no source of the table fails as a whole
    kept = corpus_pipeline.quality_stage(spark, docs, FOLDER)
    assert kept.columns == columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, r in rows.items() if not plain(r.text)[-1]}
    # near duplicates
    docs = spark.createDataFrame(kept.collect(), docs.schema)
    kept = corpus_pipeline.dedup_stage(spark, docs, FOLDER)
    assert kept.columns == columns
    left = sorted(r.doc_id for r in kept.collect())
    fps = [(i, simhash.fingerprint(rows[i].text.encode(), 5) % 2**64) for i in sorted(ids)]
    roots = dict(plain_components(fps))
    sets = {i: shingles(rows[i].text) for i in ids}
    change = True
    while change:
        change = False
        for i in ids:
            for j in ids:
                if roots[i] < roots[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    old, change = roots[j], True
                    roots = {k: roots[i] if v == old else v for k, v in roots.items()}
    assert left == sorted(set(roots.values()))
    # decontamination
    docs = spark.createDataFrame(kept.collect(), docs.schema)
    kept = corpus_pipeline.decontamination_stage(spark, docs, FOLDER)
    assert kept.columns == columns
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    after = {r.doc_id: r for r in kept.collect()}
    for i in left:
        hit, _ = plain_hits(words(rows[i].text), items, 10)
        if not hit:
            assert after[i] == rows[i]
        elif i in after:
            assert not plain_hits(words(after[i].text), items, 10)[0] and after[i].n_chars == len(after[i].text)
            assert [w for k, w in enumerate(words(rows[i].text)) if k not in hit][: len(words(after[i].text))][:5] == words(after[i].text)[:5]
    # mixing
    docs = spark.createDataFrame(kept.collect(), docs.schema)
    kept = corpus_pipeline.mixing_stage(spark, docs, FOLDER)
    assert kept.columns == columns
    mixed = kept.collect()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sizes, taken, largest = {}, {}, max(size(r) for r in after.values())
    for r in after.values():
        sizes[r.source] = sizes.get(r.source, 0) + size(r)
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + size(r)
        assert r == after[r.doc_id]
    for source, target in plain_targets(sizes).items():
        assert taken.get(source, 0) == pytest.approx(target, abs=largest)
    # tokens
    out = corpus_pipeline.token_stage(spark, spark.createDataFrame(mixed, docs.schema), FOLDER).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(r.doc_id, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for r in mixed for x in [encode.encode(r.text, add_special_tokens=False).ids]]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == sorted(want)


def test_run(spark, tmp_path, monkeypatch):
    """Of all tables that a run stages only the token files and their list stay."""
    monkeypatch.setattr(staging, "shared_folder", lambda spark: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    assert {p.name.rpartition("-")[0] for p in (tmp_path / "lakewarden").iterdir()} <= {"tokens", "token-files"}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "mixing", "tokens"]


def test_token_files_keep_the_training_order(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("text is not null")
    corpus_pipeline.mixing_stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.token_stage(spark, spark.read.parquet(f"{tmp_path}/mixed"), FOLDER).orderBy("start").collect()
    placed = mixing.tape(docs).selectExpr("doc_id", "explode(positions) as position").orderBy("position").collect()
    assert [r.doc_id for r in out] == [r.doc_id for r in placed] and len({r.doc_id for r in out}) < len(out)
