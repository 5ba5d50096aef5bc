"""Token files: exact round trip, random access, damage, edge cases."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakewarden.llm import tokens
from lakewarden.llm.tokenfile import TokenFileReader, TokenFileWriter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " ", "a", "a  b", " a", "a ", "Hello, world! It's 10's.", "tab\t x", "x  y", "x\u0085 y z", "é ß 日本語 テスト 😀 ok", "a\x1c b", "!\x1cb c", "<|endoftext|> in text", "it's we'll 'll ' s", "don 't", "a\n b\n\nc", "᠎ x", "word " * 30000, "é ́x", "½ ² x²", "a​ b", "x × y ÷z ɏa ɐb ǀ", "a\n\n b\n  c \n d  ", "  \n", "\n", "12a 3.4, é1 1é", "x\0y", "ß-ß--ß", "a <|endoftext|><|endoftext|>b  c", "a <|endoftext b"]


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def want(texts):
    return [TOKENIZER.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_encoder_is_exact(spark):
    dice = random.Random(1)
    alphabet = list("ab'sdt.,!? \n\t0é日😀") + [" ", "'ll", " "]
    more = ["".join(dice.choice(alphabet) for _ in range(dice.randrange(40))) for _ in range(3000)]
    encoder = tokens.PieceEncoder.get(public_tokenizers.path("byte_bpe_50k.json"))

    def encode(texts, end_id=0):
        flat, sizes = encoder.encode(texts, end_id)
        assert len(flat) == sum(sizes) and len(sizes) == len(texts)
        return [ids.tolist() for ids in np.split(flat, np.cumsum(sizes)[:-1])] if len(sizes) else []

    got = encode(pa.array(TEXTS + more, pa.string()).slice(0))
    assert got == want(TEXTS + more)
    assert encode(pa.array(TEXTS + more, pa.string()).slice(5, 40)) == got[5:45]
    assert encode(pa.array([], pa.string())) == [] and encode(pa.array([None, ""], pa.string())) == [[0], [0]]
    assert encode(pa.array(["a b", None], pa.string()), None) == [want(["a b"])[0][:-1], []]
    for text in TEXTS + more[:300]:  # nothing depends on what stands beside a text
        assert encode(pa.array([text], pa.string())) == want([text])


def test_what_is_remembered_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(5):
        texts = [f"word{chr(97 + i)}{chr(97 + k)} again, {'x' * 200}" for i in range(26)]
        flat, sizes = encoder.encode(pa.array(texts, pa.string()), 0)
        assert [ids.tolist() for ids in np.split(flat, np.cumsum(sizes)[:-1])] == want(texts)
        assert len(encoder.known) == len(encoder.ids) <= 80
        assert max(len(p) for p in encoder.known.to_pylist()) <= tokens.LONGEST


def test_round_trip(spark):
    rows = [(i * 3 % 23, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(5, "again", "en", "s", 0), (None, "no id", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("start", F.lit("own"))
    out = sorted(tokens.tokenize(docs).collect(), key=lambda r: r.start)
    ids = want([r[1] for r in rows])
    sizes = sorted((r[0] if r[0] is not None else -1, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in out) == sizes
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in out] == sorted((r[0] for r in rows), key=lambda d: -1 if d is None else d)
    assert tokens.tokenize(docs.limit(0)).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_file(width):
    dice, out = random.Random(2), io.BytesIO()
    docs = [(i if i % 7 else None, np.array([dice.randrange(60000) for _ in range(dice.choice([0, 1, 50, 3000]))], "<u4")) for i in range(200)]
    writer = TokenFileWriter(out, width, frame_bytes=4096)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = TokenFileReader(io.BytesIO(out.getvalue()))
    back = list(reader.rows())
    assert [d for d, _, _ in back] == [d for d, _ in docs]
    assert all((a == b).all() and len(a) == len(b) for (_, _, a), (_, b) in zip(back, docs))
    opened = []
    frame = reader.frame
    reader.frame = lambda k: opened.append(k) or frame(k)
    assert (reader.find(44)[0] == docs[44][1]).all() and len(opened) == 1
    import zstandard

    assert zstandard.ZstdDecompressor().decompressobj().decompress(out.getvalue()[: int(reader.at[1])]) == frame(0)
    damaged = bytearray(out.getvalue())
    damaged[20] ^= 255
    with pytest.raises(Exception):
        list(TokenFileReader(io.BytesIO(bytes(damaged))).rows())


def test_order_of_the_files(spark, tmp_path):
    """Token files follow ``order_by``; a row of equal keys is in no task of its own."""
    docs = spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text", "(id * 7) % 40 as place")
    files = tokens.write_tokens(docs, f"file://{tmp_path}/out", order_by=[F.col("place")])
    out = sorted(tokens.read_tokens(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [r.doc_id for r in docs.orderBy("place").collect()]
    same = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'same text' as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = tokens.write_tokens(same, f"file://{tmp_path}/same")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1 and files.agg(F.max("n_docs")).first()[0] < 4000
    assert tokens.read_tokens(files).count() == 4000
