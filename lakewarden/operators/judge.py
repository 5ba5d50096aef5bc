"""Model judging as tables: prompts and requests out, verdicts in, reconciliation, merging, retries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lakewarden.functions.bind import bind
from lakewarden.functions.text import joined_labels, strip

# Result columns, identity columns, and texts that requests carry.
RESULT_COLUMNS = ("example_num", "node_id", "node_type", "verdict", "severity", "risk_taxonomies", "owasp_risk_codes", "harmful_intent", "cached_tokens", "input_tokens", "output_tokens", "reasoning_tokens", "model", "reasoning_effort", "ok")
IDENTITY = ("example_num", "node_id", "node_type")
TRUNCATED = "\n[note: this text was truncated during sampling]"
CLOSING, SAFE_CLOSING = "</sample>", "<⁄sample>"
TAXONOMIES = (
    "prompt_injection", "jailbreak_or_safety_bypass", "sensitive_information_extraction_or_leakage", "engagement_manipulation", "behavior_or_memory_poisoning", "social_engineering_attacks",
    "harmful_or_abusive_content", "financial_scams_or_fraud", "misinformation_or_hallucination_cascade", "unsafe_execution_directive", "other",
)


def _field(df: DataFrame, name: str) -> Column:
    return F.coalesce(strip(F.col(name).cast("string")), F.lit("")) if name in df.columns else F.lit("")


def render(df: DataFrame) -> Column:
    """A node as the judge reads it."""
    kind, title = _field(df, "node_type"), _field(df, "title")
    return F.concat_ws(
        "\n", F.concat(F.lit("node_type: "), F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown"))), F.when(title != "", F.concat(F.lit("title: "), title)), F.lit("text:"), _field(df, "text"),
        F.when(F.lower(_field(df, "is_truncated")) == "true", F.lit(TRUNCATED)),
    )


def wrap(content: Column) -> Column:
    """Between sample tags; a closing tag inside is made harmless."""
    return F.concat(F.lit("<sample>\n"), F.replace(content, F.lit(CLOSING), F.lit(SAFE_CLOSING)), F.lit("\n</sample>"))


def request_line(df: DataFrame, prompt: str, model: str, effort: str, url: str = "/v1/responses", max_output_tokens: int = 4096) -> Column:
    """One JSON request: custom_id is the node id."""
    say = lambda content: F.struct(F.lit("user").alias("role"), content.alias("content"))
    body = F.struct(
        F.lit(model).alias("model"), F.struct(F.lit(effort).alias("effort")).alias("reasoning"), F.array(say(F.lit(prompt)), say(wrap(render(df)))).alias("input"), F.lit(max_output_tokens).alias("max_output_tokens"),
        F.struct(F.struct(F.lit("json_object").alias("type")).alias("format")).alias("text"),
    )
    return F.to_json(F.struct(F.col("node_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")))


def review_block(df: DataFrame) -> Column:
    """A judged node as reviewers read it."""
    val = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    pair = lambda label, c: F.concat(F.lit(label), val(c))
    return F.concat_ws(
        "\n", pair("example_num: ", "example_num"), pair("node_id:     ", "node_id"), pair("node_type:   ", "node_type"), F.concat(pair("verdict:     ", "verdict"), pair("  |  severity: ", "severity")),
        pair("risk_taxonomies: ", "risk_taxonomies"), pair("owasp_risk_codes: ", "owasp_risk_codes"), pair("harmful_intent:  ", "harmful_intent"), F.when(val("title") != "", pair("title: ", "title")), F.lit(""), val("text"),
    )


def _object(text: Column) -> Column:
    """The text as a JSON object, or what stands from its first to its last brace as one; else null."""
    is_object = lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)
    start, end = F.locate("{", text), F.char_length(text) - F.locate("}", F.reverse(text)) + 1
    inner = F.when((F.locate("{", text) > 0) & (F.locate("}", text) > 0) & (end > start), F.substring(text, start, end - start + 1))
    # A whole text that parses decides, even if it is no object.
    return bind(F.try_parse_json(text), lambda whole: F.when(whole.isNotNull(), is_object(whole)).otherwise(bind(F.try_parse_json(inner), is_object)))


def _value(obj: Column, key: str) -> Column:
    """The member as a variant; SQL null if absent, a null variant if null."""
    return F.try_variant_get(obj, f"$.{key}", "variant")


def _as_text(v: Column) -> Column:
    """A member as text; absent is empty, JSON null is the text None, booleans have a capital, other values their JSON."""
    kind = F.schema_of_variant(v)
    text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind == "BOOLEAN", F.initcap(F.to_json(v))).otherwise(F.to_json(v))
    return F.when(v.isNull(), "").when(F.is_variant_null(v), "None").otherwise(text)


def _labels(v: Column) -> Column:
    """A list as ``a; b``; another value as its stripped text; absent or null as nothing."""
    items = F.try_variant_get(v, "$", "array<variant>")
    many = joined_labels(F.transform(items, _as_text))
    return F.when(v.isNull() | F.is_variant_null(v), "").when(F.schema_of_variant(v).startswith("ARRAY"), many).otherwise(strip(_as_text(v)))


def parse_verdict(content: Column) -> Column:
    """Struct verdict, severity (text), risk_taxonomies, owasp_risk_codes, harmful_intent from a judge's answer.

    Keys decide by presence: a null list still hides its other name. Severity
    is cut to an integer; text that is no integer gives nothing. An answer
    without an object is ``unparseable``, with its first 500 characters.
    """
    return bind(strip(F.coalesce(content, F.lit(""))), lambda text: bind(_object(text), lambda obj: F.when(obj.isNull(), _unparseable(text)).otherwise(_verdict(obj))))


def _unparseable(text: Column) -> Column:
    none = F.lit("")
    return F.struct(F.lit("unparseable").alias("verdict"), none.alias("severity"), none.alias("risk_taxonomies"), none.alias("owasp_risk_codes"), F.substring(text, 1, 500).alias("harmful_intent"))


def _verdict(obj: Column) -> Column:
    verdict, label = _value(obj, "verdict"), _value(obj, "label")
    listed, other = _value(obj, "risk_taxonomy_categories"), _value(obj, "risk_taxonomies")
    raw = _value(obj, "severity")
    whole = F.when(F.schema_of_variant(raw).isin("STRING"), strip(F.try_variant_get(raw, "$", "string")).try_cast("bigint")).otherwise(F.try_variant_get(raw, "$", "bigint"))
    return F.struct(
        F.substring(F.when(verdict.isNull(), _as_text(label)).otherwise(_as_text(verdict)), 1, 100).alias("verdict"), F.coalesce(whole.cast("string"), F.lit("")).alias("severity"),
        F.when(listed.isNull(), _labels(other)).otherwise(_labels(listed)).alias("risk_taxonomies"), _labels(_value(obj, "OWASP_risk_codes")).alias("owasp_risk_codes"), F.substring(_as_text(_value(obj, "harmful_intent")), 1, 500).alias("harmful_intent"),
    )


RESPONSE = """custom_id string, response struct<status_code: int, body: struct<output: array<struct<type: string, content: array<struct<type: string, text: string>>>>,
usage: struct<input_tokens: bigint, output_tokens: bigint, input_tokens_details: struct<cached_tokens: bigint>, output_tokens_details: struct<reasoning_tokens: bigint>>>>, error string"""


def parse_responses(lines: DataFrame, value: str = "value") -> DataFrame:
    """Batch output lines to node_id, status_code, output_text, token counts (text, empty if absent), line_error; blank lines go."""
    rows = lines.filter(strip(F.col(value)) != "").select(F.from_json(value, RESPONSE).alias("r")).select("r.*")
    parts = F.flatten(F.transform(F.filter("response.body.output", lambda o: o["type"] == "message"), lambda o: F.filter(o["content"], lambda c: c["type"] == "output_text")["text"]))
    usage = F.col("response.body.usage")
    count = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select(
        F.col("custom_id").alias("node_id"), F.col("response.status_code").alias("status_code"), F.coalesce(F.array_join(parts, ""), F.lit("")).alias("output_text"), count(usage["input_tokens"]).alias("input_tokens"),
        count(usage["output_tokens"]).alias("output_tokens"), count(usage["input_tokens_details"]["cached_tokens"]).alias("cached_tokens"), count(usage["output_tokens_details"]["reasoning_tokens"]).alias("reasoning_tokens"), F.col("error").alias("line_error"),
    )


def reconcile(asked: DataFrame, success: DataFrame, errors: DataFrame, key: str = "node_id") -> DataFrame:
    """Every outcome once: successes as they are (repeats too), errors of ids without success, and ids without either as ``missing``."""
    ok = success.withColumn("outcome", F.lit("success"))
    failed = errors.join(success.select(key).distinct(), key, "left_anti").withColumn("outcome", F.lit("error"))
    seen = success.select(key).union(errors.select(key)).distinct()
    missing = asked.select(key).distinct().join(seen, key, "left_anti").withColumn("outcome", F.lit("missing"))
    return ok.unionByName(failed, allowMissingColumns=True).unionByName(missing, allowMissingColumns=True)


def outcomes(asked: DataFrame, output: DataFrame, errors: DataFrame) -> DataFrame:
    """Every asked id of a batch: ``output`` and ``errors`` are parsed lines (``parse_responses``) of the two result files.

    A line with status 200 and a text is a success; other lines of either file
    are errors, unless the id also succeeded; ids in neither file are missing.
    """
    good = (F.coalesce("status_code", F.lit(0)) == 200) & F.col("line_error").isNull()
    bad = output.filter(~good).select("node_id", F.coalesce("line_error", F.concat(F.lit("status "), F.coalesce(F.col("status_code").cast("string"), F.lit("none")))).alias("reason"))
    bad = bad.unionByName(errors.select("node_id", F.coalesce("line_error", F.lit("in the error file")).alias("reason")))
    bad = bad.groupBy("node_id").agg(F.min("reason").alias("reason"))
    return reconcile(asked.select("node_id"), output.filter(good).select("node_id", "output_text"), bad)


def batch_ready(state: str) -> bool:
    """Whether a batch's results can be fetched; a state that has not ended, or ended badly, is an error."""
    if state == "completed":
        return True
    raise ValueError(f"the batch is {state}")


def pending(asked: DataFrame, done: DataFrame | None, key: str = "node_id", order: str = "example_num", limit: int | None = None) -> DataFrame:
    """Asked rows without a result, the first ``limit`` in order."""
    left = asked if done is None else asked.join(done.select(key), key, "left_anti")
    return left if limit is None else left.orderBy(order, key).limit(limit)


def merge_retry(base: DataFrame, retry: DataFrame, key: str = "node_id", identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Base rows with every column but the identity taken from the retry where the retry has the row - empty values too.

    An id that the retry repeats is an error when the rows are computed; ids that
    the base lacks are found by ``unknown_retries``.
    """
    if list(base.columns) != list(retry.columns):
        raise ValueError("base and retry have different columns")
    own = [c for c in base.columns if c not in identity]
    grouped = retry.groupBy(key).agg(F.count("*").alias("_n"), F.max(F.struct(*own)).alias("_r"))
    once = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("repeated retry id: "), F.col(key).cast("string"))).cast("boolean"))
    fresh = grouped.select(F.col(key), once.alias("_hit"), *[F.col(f"_r.{c}").alias(f"_{c}") for c in own])
    joined = base.join(fresh, key, "left")
    return joined.select(*[F.col(c) if c in identity else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in base.columns])


def unknown_retries(base: DataFrame, retry: DataFrame, key: str = "node_id") -> DataFrame:
    return retry.join(base, key, "left_anti").select(key)


def retry_input(results: DataFrame, source: DataFrame, verdicts: Sequence[str], key: str = "node_id") -> DataFrame:
    """Source rows of results with one of the verdicts: each id once, in numeric order of example_num, renumbered from 1.

    Ids that the source lacks are left out; is_truncated is added if absent.
    """
    wanted = results.filter(F.col("verdict").isin(list(verdicts))).groupBy(key).agg(F.min(F.col("example_num").try_cast("bigint")).alias("_order"))
    rows = source.drop("example_num").join(wanted, key)
    rows = rows if "is_truncated" in rows.columns else rows.withColumn("is_truncated", F.lit(False))
    return rows.withColumn("example_num", F.row_number().over(Window.orderBy(F.col("_order").asc_nulls_last(), key))).drop("_order")


def reparse(results: DataFrame, raw: DataFrame, key: str = "node_id", order: str = "example_num") -> DataFrame:
    """Results with verdict columns parsed anew from the last raw answer of each id; other rows stay."""
    last = raw.groupBy(key).agg(F.max_by("output_text", order).alias("_text")).select(key, parse_verdict(F.col("_text")).alias("_v"))
    names = ("verdict", "severity", "risk_taxonomies", "owasp_risk_codes", "harmful_intent")
    joined = results.join(last, key, "left")
    return joined.select(*[F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in results.columns])


def unknown_labels(taxonomies: Column) -> Column:
    """Labels outside the promised domain."""
    return F.array_except(F.filter(F.split(taxonomies, "; "), lambda x: x != ""), F.array(*[F.lit(t) for t in TAXONOMIES]))


# Codes and severities that the judge may give, and how many labels of a kind.
OWASP = tuple(f"LLM{k:02d}" for k in range(1, 11))
SEVERITIES = tuple("012345")
MOST_LABELS = 3


def label_faults(taxonomies: Column, codes: Column, severity: Column) -> Column:
    """What breaks the domain that judges are told, as names: none for a row that keeps to it."""
    listed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "; "), lambda x: x != "")
    known = lambda names: F.array(*[F.lit(n) for n in names])
    faults = [
        ("taxonomy", F.size(F.array_except(listed(taxonomies), known(TAXONOMIES))) > 0), ("owasp", F.size(F.array_except(listed(codes), known(OWASP))) > 0), ("severity", ~F.coalesce(severity, F.lit("")).isin(*SEVERITIES)),
        ("many_taxonomies", F.size(listed(taxonomies)) > MOST_LABELS), ("many_codes", F.size(listed(codes)) > MOST_LABELS), ("other_with_more", F.array_contains(listed(taxonomies), "other") & (F.size(listed(taxonomies)) > 1)),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in faults]))


def severity_text(value: Column) -> Column:
    """Any spelling of a whole number as its digits, else empty; a number that is not whole is an error."""
    number = value.try_cast("double")
    whole = F.coalesce(number.try_cast("bigint").cast("string"), F.lit(""))
    return F.when(number != F.floor(number), F.raise_error(F.concat(F.lit("severity is no whole number: "), value))).otherwise(whole)


def binary_label(severity: Column, strict: bool = False) -> Column:
    """1 for severities 3, 4, 5; with ``strict`` anything but these and 0 is an error, as training data must be."""
    label = severity.isin("3", "4", "5").cast("long")
    if not strict:
        return label
    return F.when(F.coalesce(severity, F.lit("")).isin("0", "3", "4", "5"), label).otherwise(F.raise_error(F.concat(F.lit("severity outside 0, 3, 4, 5: "), F.coalesce(severity, F.lit("null")))).cast("long"))
