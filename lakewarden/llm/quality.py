"""Quality rules for documents and their hosts (DataFrame functions only).

Every document gets counts from its whole text and a verdict by the base rules.
Failures are then summed by host (``documents`` carry no address, so their
``source`` stands for it), failure rates are shrunk with a beta prior fitted to
the hosts themselves, and a host whose shrunk rate passes ``host_limit`` takes
its remaining documents with it.

Hosts can be very large: sums are partial aggregates, and the verdict is joined
back on (host, salt), so that no task holds a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakewarden.llm.scratch import stage
from lakewarden.llm.text_rules import SPACE
from lakewarden.sources.tables import table

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A host goes if more than this share of its documents would fail, after shrinking.
HOST_LIMIT = 0.7
#: Pieces into which every host is cut for the join back.
SALTS = 32


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", whole_row: bool = False) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed for every row.

    Whole texts, whatever their length; a null or empty text has no word and
    fails. Repeated rows are measured each; other columns are ignored, or kept
    together in the struct ``row`` with ``whole_row``.

    Repeats: all windows are hashed; only where some hash repeats are they
    sorted with their places, equal neighbours mark places, and a marked window
    adds those of its words that the marked one before it has not covered.
    """
    row = [F.struct(*docs.columns).alias("row")] if whole_row else []
    kept = ["row"] * whole_row
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("t"), *row)
    words = F.filter(F.split("t", SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    step = base.select("doc_id", "host", "t", F.transform(words, lambda w: F.xxhash64(w)).alias("w"), lines.alias("lines"), *kept)
    at = [F.lit(k) for k in range(WINDOW)]
    windows = F.when(
        F.size("w") > WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in at])),
    ).otherwise(F.array().cast("array<long>"))
    step = step.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        (F.char_length("t") - F.regexp_count("t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("v"),
        *kept,
    )
    step = step.withColumn("v", F.when(F.size(F.array_distinct("v")) < F.size("v"), F.col("v")))
    step = step.withColumn("v", F.sort_array(F.transform("v", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    last = F.size("v") - 1
    twice = F.filter(
        F.transform("v", lambda p, j: F.when(((j > 0) & (F.get("v", j - 1)["h"] == p["h"])) | ((j < last) & (F.get("v", j + 1)["h"] == p["h"])), p["i"])),
        lambda i: i.isNotNull(),
    )
    step = step.withColumn("v", F.sort_array(twice))
    gaps = F.transform("v", lambda i, j: F.when(j == 0, WINDOW).otherwise(F.least(i - F.get("v", j - 1), F.lit(WINDOW))))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("v")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return step.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """host_key, n_docs, n_failed, host_rate (shrunk), host_failed: one row a host.

    The prior beta(a, b) has the mean and variance of the hosts' rates (moments
    over hosts, the variance less what sampling alone would give); where the
    variance leaves nothing, the prior weighs as much as a mean host.
    """
    hosts = measured.groupBy("host_key").agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n"), F.count("*").alias("k"),
        F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("var"), F.avg(1.0 / F.col("n_docs")).alias("inv"),
    )
    mean = F.greatest(F.least(F.col("f") / F.col("n"), F.lit(1 - 1e-6)), F.lit(1e-6))
    spread = F.col("var") - mean * (1 - mean) * F.col("inv")
    weight = F.when(spread > 0, F.greatest(mean * (1 - mean) / spread - 1, F.lit(1e-3))).otherwise(F.col("n") / F.col("k"))
    prior = prior.select(mean.alias("mean"), weight.alias("weight"))
    # The prior is one row.
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return hosts.crossJoin(F.broadcast(prior)).select("host_key", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > host_limit).alias("host_failed"))


def _host_key() -> Column:
    return F.coalesce(F.concat(F.lit("0"), F.col("host")), F.lit("1"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The measures of every row, its host's shrunk rate and ``kept``. A null host is a host of its own; an empty table gives an empty result."""
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    measured = measure(docs, id_col=id_col, text_col=text_col, host_col=host_col)
    measured = stage(measured.withColumns({"host_key": _host_key(), "salt": salt}), "quality")
    verdicts = host_verdicts(measured, host_limit).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = measured.join(verdicts, ["host_key", "salt"])
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("host_key", "salt")


#: So many failed hosts at most are broadcast to where the rows are; more are joined by shuffle.
BROADCAST_HOSTS = 10_000


def keep_good(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged.

    A row's own verdict is computed where the row is, and of the hosts only
    those that failed are looked up, so whole rows are neither staged nor - while
    failed hosts are few, which is counted - shuffled. Measuring twice costs less
    than moving the texts.
    """
    named = {"id_col": id_col, "text_col": text_col, "host_col": host_col}
    measured = stage(measure(docs, **named).select(_host_key().alias("host_key"), "base_failed"), "quality")
    failed = stage(host_verdicts(measured, host_limit).filter("host_failed").select("host_key"), "failed-hosts")
    # A row number is no function of its row, so the filter that mentions it stays above the measures. Pushed below
    # them it would be written out with every measure at every mention, more than planning can bear.
    rows = measure(docs, **named, whole_row=True).withColumn("number", F.monotonically_increasing_id())
    rows = rows.filter((F.col("number") >= 0) & ~F.col("base_failed")).select("row", _host_key().alias("host_key"))
    failed = F.broadcast(failed) if failed.count() <= BROADCAST_HOSTS else failed
    return rows.join(failed, "host_key", "left_anti").select("row.*")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = judge(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM d),
n AS (SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, w FROM w),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM n)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM v) WHERE c > 1),
g AS (SELECT doc_id, sum(least(8, coalesce(i - p, 8)))::BIGINT AS r FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM m) GROUP BY doc_id),
b AS (SELECT n.*, coalesce(r, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(r, 0) > 30 * n_words AS base_failed FROM n LEFT JOIN g USING (doc_id)),
h AS (SELECT host, count(*) AS nd, count(*) FILTER (WHERE base_failed) AS nf FROM b GROUP BY host),
p AS (SELECT greatest(least(sum(nf) / sum(nd), 1 - 1e-6), 1e-6) AS mean, coalesce(var_samp(nf / nd), 0) AS var, avg(1 / nd) AS inv, sum(nd) / count(*) AS size FROM h),
q AS (SELECT mean, CASE WHEN var - mean * (1 - mean) * inv > 0 THEN greatest(mean * (1 - mean) / (var - mean * (1 - mean) * inv) - 1, 1e-3) ELSE size END AS weight FROM p),
f AS (SELECT host, (nf + mean * weight) / (nd + weight) > 0.7 AS host_failed FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept FROM b JOIN f USING (host)
"""

QUERIES = {"op10_quality": op10_quality}
ORACLES = {"op10_quality": ORACLE}
