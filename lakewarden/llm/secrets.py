"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Base patterns are searched as bytes, each only where a cheap test says it may
occur. The method adds spans: in every maximal run of token characters that no
base span touches, characters are scored by two models of order 1, one of random
strings and one of ordinary identifiers, and the part whose log-likelihood ratio
is greatest is reported if it says random surely enough. Base spans are scored
too. Both models are fitted on the driver to a bounded, labelled sample drawn by
a fixed seed (``SAMPLE`` strings of either kind).
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lakewarden.llm.blocks import text_bytes
from lakewarden.sources.tables import table

KINDS = ("assign", "access", "hex", "markov")
# The base patterns. Matched on bytes, so only ASCII letters fold.
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
STEMS = (b"passw", b"secret", b"token", b"api")

#: Shortest string the models report, and how sure they must be: total nats, nats a character, and what a character must bring.
RUN_LEAST, SURE, SURE_EACH, DRIFT = 12, 15.0, 0.45, 0.2
#: Separators that are no part of a string at its ends.
EDGES = b"=-_/"
#: Labelled strings of either kind that the models are fitted to.
SAMPLE, SEED = 6000, 17
TOKEN_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % RUN_LEAST)
HEX_MASK = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))
HEX_RUN = re.compile(rb"1{%d,}" % HEX_LEAST)
RUN_MASK = bytes(49 if c in TOKEN_CHARS else 48 for c in range(256))

# Parts of ordinary identifiers and words in four languages.
STEM_WORDS = """get set is has to from with make read write open close load save list item items value values name names index count size length total first last next
previous current default config option options param params request response handler manager service client server user account session message error result
data table column row field record document text word line page file path folder image button label window event listener controller component state update
delete insert select create remove append parse format print render encode decode compress extract transform validate convert compute calculate initialize
international responsibility understanding organization communication administration characteristics environment information development performance
geschwindigkeit verantwortung wissenschaft entwicklung gesellschaft unternehmen bundesregierung zusammenarbeit moeglichkeit freundschaft arbeitnehmer
heit keit lich ung schaft einer der die das und nicht mit auf auch sich responsabilidad conocimiento desarrollo administracion gobierno universidad
comunicacion internacional importante ciudad trabajo tiempo siempre cion idad mente para como pero gouvernement developpement responsabilite connaissance
aujourdhui beaucoup toujours travail temps monde ment tion eau elle que pour dans avec sur des les une est the and of in that for with this are was on by it
ing er st th an or re nt ti es on at ed nd ha en to ou ea he is ly ble wh sh""".split()


def ordinary(dice: random.Random) -> str:
    """One identifier or long word: snake, camel, kebab, path or compound."""
    parts: list[str] = []
    while sum(map(len, parts)) < RUN_LEAST + dice.randrange(12):
        parts.append(dice.choice(STEM_WORDS))
    style = dice.randrange(6)
    if style == 0:
        return "_".join(parts)
    if style == 1:
        return parts[0] + "".join(p.capitalize() for p in parts[1:])
    if style == 2:
        return "-".join(parts)
    if style == 3:
        return "/".join(parts)
    text = "".join(parts)
    return dice.choice((text, text.capitalize(), text.upper(), text + str(dice.randrange(2030)), "=" * len(text), "-" * len(text), "_".join(parts).upper()))


def randomised(dice: random.Random) -> str:
    """One random string over an alphabet that secrets use."""
    letters, digits = string.ascii_letters, string.digits
    alphabet = dice.choice(("0123456789abcdef", "0123456789ABCDEF", letters + digits, letters + digits, letters + digits + "+/", letters + digits + "-_", string.ascii_uppercase + digits))
    return "".join(dice.choice(alphabet) for _ in range(dice.randrange(RUN_LEAST, 65)))


def _fit(samples: list[str]) -> np.ndarray:
    """log P(next | previous) over bytes, add-one smoothed over the token alphabet; row 0 starts a string."""
    counts = np.zeros((256, 256))
    for s in samples:
        codes = np.frombuffer(s.encode(), np.uint8)
        np.add.at(counts, (np.concatenate(([0], codes[:-1])), codes), 1)
    allowed = np.frombuffer(TOKEN_CHARS, np.uint8)
    counts[:, allowed] += 1.0
    return np.log(np.maximum(counts, 1e-9) / counts.sum(axis=1, keepdims=True))


@lru_cache(maxsize=1)
def ratio() -> np.ndarray:
    """log of P(next | previous) as a random string over that as an identifier."""
    dice = random.Random(SEED)
    plain = [ordinary(dice) for _ in range(SAMPLE)]
    return _fit([randomised(dice) for _ in range(SAMPLE)]) - _fit(plain)


def ratios(run: bytes, table_: np.ndarray) -> np.ndarray:
    """The log ratio of every character of a run, given the one before it."""
    codes = np.frombuffer(run, np.uint8)
    return table_[np.concatenate(([0], codes[:-1])), codes]


def best_part(run: bytes, table_: np.ndarray) -> tuple[int, int, float] | None:
    """Start, end and score of the part of a run that most surely is a random string, if it is sure enough.

    Characters count by their log ratio less ``DRIFT``; the part of greatest sum
    is the one between two prefix sums, so a key inside a longer ordinary run is
    found, and a run is read once. Separators at its ends are left out.
    """
    each = ratios(run, table_)
    sums = np.concatenate(([0.0], np.cumsum(each - DRIFT)))
    end = int(np.argmax(sums - np.minimum.accumulate(sums)))
    start = int(np.argmin(sums[: end + 1]))
    part = run[start:end]
    start, end = start + len(part) - len(part.lstrip(EDGES)), end - len(part) + len(part.rstrip(EDGES))
    score = float(each[start:end].sum())
    return (start, end, score) if end - start >= RUN_LEAST and score >= SURE and score >= SURE_EACH * (end - start) else None


def scan(text: bytes | None, table_: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score) in code points, sorted: base spans of the whole text and spans that the models add.

    The score is the log-likelihood ratio of the span, of an assignment that of
    its value. Runs that no base span touches are looked at; both are in order,
    so a text is read once however many there are.
    """
    text = text or b""
    found: list[tuple[int, int, int, float]] = []
    low = text.lower()
    score = lambda value: float(ratios(value, table_).sum())
    if any(s in low for s in STEMS):
        found += [(m.start(), 0, m.end(), score(m[1])) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), score(m[0])) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    hexes = text.translate(HEX_MASK)
    if b"1" * HEX_LEAST in hexes:
        found += [(m.start(), 2, m.end(), score(text[m.start() : m.end()])) for m in HEX_RUN.finditer(hexes)]
    if b"1" * RUN_LEAST in text.translate(RUN_MASK):
        base, at, reached = sorted((s, e) for s, _, e, _ in found), 0, 0
        for m in RUN.finditer(text):
            while at < len(base) and base[at][0] < m.end():
                reached = max(reached, base[at][1])
                at += 1
            # Spans that begin before the run's end are behind; one of them touches the run if any reaches beyond its start.
            if reached <= m.start() and (part := best_part(m[0], table_)):
                found.append((m.start() + part[0], 3, m.start() + part[1], part[2]))
    if found and not text.isascii():
        marks = sorted({x for s, _, e, _ in found for x in (s, e)})
        at_ = dict(zip(marks, _points(text, marks)))
        found = [(at_[s], k, at_[e], x) for s, k, e, x in found]
    return sorted(found)


def _points(text: bytes, marks: list[int]) -> list[int]:
    """Code points before each of the ascending byte offsets."""
    starts = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [int(starts[m - 1]) if m else 0 for m in marks]


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and spans, an array of (kind, start, end, score) by start, then kind.

    A null or empty text has no span; repeated rows are scanned each; texts are
    scanned whole; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in scan(t, shared.value)] for t in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>")


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_spans(table(spark, folder, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"], 2).cast("string")), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), scores.alias("scores"))


QUERIES = {"op4_secrets": op4_secrets}
ORACLES: dict[str, str] = {}
