"""Quality rules against a plain version on awkward texts."""

import random
import re

from lakewarden.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), failed


def texts():
    dice = random.Random(3)
    yield from (None, "", " \t\n", "a", "é😀 " * 30, "one two three four five six seven eight " * 3, "\n".join(["same line here"] * 9 + ["", "", " "]))
    for n in (7, 8, 9, 19, 20, 300):
        yield " ".join(f"w{dice.randrange(n)}" for _ in range(n))
        yield " ".join(f"w{i}#" for i in range(n)) + "\x0b\x0c\r x"
    base = [f"u{i}" for i in range(60)]
    yield " ".join(base + base[10:22] + ["z"] + base[5:14])
    yield " ".join(["long"] * 20000)


def test_measures(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows + rows[:2], SCHEMA).withColumn("n_words", quality.F.lit("own"))
    out = quality.judge(docs).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(rows[r.doc_id][1]), rows[r.doc_id]
    assert quality.judge(docs.limit(0)).count() == 0


def test_hosts(spark):
    good = " ".join(f"g{i}" for i in range(40))
    rows = [(i, good if i % 20 else "bad", "en", "good", 0) for i in range(200)] + [(200 + i, "bad" if i % 20 else good, "en", "awful", 0) for i in range(200)] + [(400, good, "en", "tiny", 0), (401, "bad", "en", "tiny bad", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.source: r["count"] for r in kept.groupBy("source").count().collect()} == {"good": 190, "tiny": 1}
