"""Chat formatting: tool calls and results linked by identifier, ordered, checked, written as canonical JSON.

A message's tool calls stand in its text as ``<tool_call>{...}</tool_call>``
with ``id``, ``name`` and ``arguments`` (an object, or its JSON text) and
optionally ``after``: ids of calls whose results it needs. A result is a
``<tool_result>{...}</tool_result>`` with ``id`` and ``content``; the whole text
of a message of role ``tool`` may be that object bare.

Calls and results are exploded to rows of their own and meet in a hash join on
(conversation, id). What a call needs makes a graph; its levels are found by
rounds of joins in which a call that needs one other call takes over what that
one needs, so a chain halves in every round. No conversation is ever gathered:
every message is serialised where it is, with its place in the conversation
beside it, so one conversation may hold any share of all rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakewarden.llm.scratch import stage
from lakewarden.sources.tables import table

OPENING = re.compile("<tool_(call|result)>")
SURROGATE = re.compile("[\ud800-\udfff]")
#: JSON nested deeper than this stays text.
MOST_DEPTH = 200
#: Edges of one call while levels are found.
MOST_EDGES = 1024
#: Pieces into which the rows of a repeated id are dealt.
SALTS = 16
EVENT = "struct<kind: string, place: int, id: string, name: string, body: string, after: array<string>, valid: boolean>"

# Argument schemas of known tools (a subset of JSON Schema). Tools beside them take any object.
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False},
    "calculator": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"], "additionalProperties": False},
    "get_weather": {"type": "object", "properties": {"city": {"type": "string"}, "unit": {"enum": ["celsius", "fahrenheit"]}}, "required": ["city"]},
}
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def sound(text: str) -> str:
    """The text with halves of surrogate pairs, which no UTF-8 can hold, replaced."""
    return SURROGATE.sub("\ufffd", text)


def shallow(value: object) -> bool:
    """Whether JSON is nested no deeper than ``MOST_DEPTH``."""
    layer, depth = [value], 0
    while layer and depth <= MOST_DEPTH:
        layer = [x for v in layer if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        depth += 1
    return not layer


def canonical(value: object) -> str:
    """One text for equal JSON: sorted keys, no spaces, whole floats as integers, no NaN, sound text."""

    def clean(x: object) -> object:
        if isinstance(x, float):
            return (int(x) if x.is_integer() else x) if math.isfinite(x) else None
        if isinstance(x, str):
            return sound(x)
        if isinstance(x, dict):
            return {sound(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, list) else x

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fits(value: object, schema: dict) -> bool:
    """Whether a value meets a schema (type, enum, properties, required, additionalProperties, items, minLength, minimum, maximum)."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number" and not number or kind == "integer" and not (number and (isinstance(value, int) or value.is_integer())):
        return False
    if kind in KINDS and not isinstance(value, KINDS[kind]):
        return False
    if "enum" in schema and not any(canonical(value) == canonical(e) for e in schema["enum"]):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or schema.get("additionalProperties") is False and set(value) - set(known):
            return False
        return all(fits(v, known[k]) for k, v in value.items() if k in known)
    if isinstance(value, list) and "items" in schema:
        return all(fits(v, schema["items"]) for v in value)
    if isinstance(value, str):
        return len(value) >= schema.get("minLength", 0)
    return not number or schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf)


def _loads(text: str) -> object:
    """The JSON, or None where it is none, has a number of over 4,300 digits or is nested too deep."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if shallow(value) else None


def _is_id(value: object) -> bool:
    return isinstance(value, (str, int)) and not isinstance(value, bool)


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str, list[dict]]:
    """The text without its marks, and its calls and results in order. What is no valid object stays text."""
    text = text or ""
    events: list[dict] = []

    def take(kind: str, raw: str) -> bool:
        body = _loads(raw)
        if not isinstance(body, dict) or not _is_id(body.get("id")):
            return False
        event = {"kind": kind, "place": len(events), "id": sound(str(body["id"])), "name": None, "after": [], "valid": True}
        if kind == "call":
            given = body.get("arguments", {})
            given = _loads(given) if isinstance(given, str) else given
            name = sound(body["name"]) if isinstance(body.get("name"), str) else None
            after = body["after"] if isinstance(body.get("after"), list) else []
            valid = name is not None and isinstance(given, dict) and fits(given, schemas.get(name, {"type": "object"}))
            event |= {"name": name, "after": sorted({sound(str(a)) for a in after if _is_id(a)}), "valid": valid, "body": canonical(given)}
        else:
            event["body"] = canonical(body.get("content"))
        events.append(event)
        return True

    if role == "tool" and text.lstrip()[:1] == "{" and take("result", text):
        return "", events
    last = {kind: text.rfind(f"</tool_{kind}>") for kind in ("call", "result")}
    kept, at, seen = [], 0, 0
    while m := OPENING.search(text, at):
        at = m.end()
        if at <= last[m[1]]:
            end = text.index(f"</tool_{m[1]}>", at)
            at = end + len(m[1]) + len("</tool_>")
            if take(m[1], text[m.end() : end]):
                kept.append(text[seen : m.start()])
                seen = at
    return "".join([*kept, text[seen:]]).strip(), events


def parse_messages(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, role, content, events, mark) of every message; mark tells different messages of one turn apart."""
    schemas = SCHEMAS if schemas is None else schemas
    kind = pa.list_(pa.struct([("kind", pa.string()), ("place", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("body", pa.string()), ("after", pa.list_(pa.string())), ("valid", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(r, t, schemas) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch([*batch.columns[:3], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], kind)], names=["conv_id", "turn", "role", "content", "events"])

    named = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    parsed = named.mapInArrow(run, f"conv_id long, turn long, role string, content string, events array<{EVENT}>")
    return parsed.withColumn("mark", F.xxhash64("role", "content", "events"))


def same(left: str, right: str, *, on: tuple[str, str] = ("id", "id")) -> Column:
    """Rows of one conversation, null meeting null, with equal ids."""
    return F.col(f"{left}.conv_id").eqNullSafe(F.col(f"{right}.conv_id")) & (F.col(f"{left}.{on[0]}") == F.col(f"{right}.{on[1]}"))


def numbered(events: DataFrame) -> DataFrame:
    """Adds ``first``: whether an event is the first (turn, place) of its id and kind in its conversation.

    An id may be repeated any number of times: the first is an ordinary minimum,
    and only repeated ids meet it again, dealt by salt.
    """
    place = F.struct("turn", "place", "body", "mark")
    least = events.groupBy("conv_id", "kind", "id").agg(F.min(place).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = events.withColumn("salt", F.pmod(F.xxhash64("turn", "place", "mark"), F.lit(SALTS)).cast("int"))
    met = salted.alias("e").join(least.alias("l"), same("e", "l") & (F.col("e.kind") == F.col("l.kind")) & (F.col("e.salt") == F.col("l.salt")), "left")
    mine = F.struct("e.turn", "e.place", "e.body", "e.mark")
    return met.select("e.*", (F.col("l.least").isNull() | (mine == F.col("l.least"))).alias("first")).drop("salt")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level) of ``calls`` (conv_id, id, after; ids unique in a conversation): 0, or one above the highest of the calls it comes after.

    Calls in or behind a ring have level null. A call is a row with what it still
    needs as edges (need, w): its level is the greatest of ``base`` and the levels
    of its needs plus w. A round first takes edges to calls of known level into
    the base, so that edges lead to open calls only, then replaces an edge to a
    call by that call's edges, w added up, unless a call would get more than
    ``MOST_EDGES`` by that. So what is left of a path halves; where call after
    call needs several open calls, steps double until they are some
    ``MOST_EDGES`` ** 0.5 calls long, and then a round settles a step. A path
    longer than the calls of a conversation goes round in a ring, and so do rows
    that a round leaves as they are. Each round is staged, with the rows that
    were open before it.
    """
    edge = F.struct(F.col("need"), F.lit(1).cast("long").alias("w"))
    asked = calls.select("conv_id", "id", F.explode("after").alias("need")).alias("n").join(calls.select("conv_id", "id").alias("c"), same("n", "c", on=("need", "id"))).select("n.*")
    needs = asked.groupBy("conv_id", "id").agg(F.collect_set(edge).alias("edges"))
    none = F.array().cast("array<struct<need: string, w: bigint>>")
    start = calls.alias("c").join(needs.alias("n"), same("c", "n"), "left")
    now = stage(start.select("c.conv_id", "c.id", F.lit(0).cast("long").alias("base"), F.coalesce("n.edges", none).alias("edges"), F.lit(False).alias("ring")), "chat-levels")
    most = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    done = []
    while True:
        done.append(now.filter("ring or size(edges) = 0").select("conv_id", "id", F.when(~F.col("ring"), F.col("base")).cast("int").alias("level")))
        open_ = now.filter("not ring and size(edges) > 0")
        if open_.isEmpty():
            break
        fed = stage(_follow(open_, now, most, jump=False), "chat-fed")
        still = fed.filter("not ring and size(edges) > 0")
        after = stage(fed.filter("ring or size(edges) = 0").unionByName(_follow(still, fed, most, jump=True)), "chat-levels")
        mark = lambda rows: rows.agg(F.count("*"), F.sum(F.xxhash64("conv_id", "id", "base", "edges", "ring").cast("decimal(38,0)"))).first()
        if mark(after) == mark(open_):
            done.append(open_.select("conv_id", "id", F.lit(None).cast("int").alias("level")))
            break
        now = after
    return reduce(DataFrame.unionByName, done)


def _follow(open_: DataFrame, now: DataFrame, most: int, jump: bool) -> DataFrame:
    """The rows ``open_`` with what their edges lead to in ``now`` taken in: known levels, and, to ``jump``, edges."""
    asked = open_.select("conv_id", "id", "base", F.size("edges").alias("n"), F.explode("edges").alias("e")).select("conv_id", "id", "base", "n", "e.*")
    met = asked.alias("a").join(now.alias("t"), same("a", "t", on=("need", "id")))
    left = F.size("t.edges")
    over = F.lit(jump) & (left > 0) & ((left == 1) | (left * F.col("a.n") <= MOST_EDGES))
    rest = F.when(left == 0, F.col("t.edges")).when(over, F.transform("t.edges", lambda x: F.struct(x["need"].alias("need"), (x["w"] + F.col("a.w")).alias("w")))).otherwise(F.array(F.struct("a.need", "a.w")))
    met = met.select("a.conv_id", "a.id", "a.base", F.when((left == 0) | over, F.col("t.base") + F.col("a.w")).otherwise(0).alias("reach"), F.col("t.ring").alias("ring"), rest.alias("rest"))
    ring = F.col("ring") | F.exists("rest", lambda x: (x["w"] > most) | (x["need"] == F.col("id")))
    summed = met.groupBy("conv_id", "id").agg(F.greatest(F.max("base"), F.max("reach")).alias("base"), F.max(ring).alias("ring"), F.flatten(F.collect_list("rest")).alias("found"))
    summed = summed.withColumn("found", F.sort_array(F.transform("found", lambda x: F.struct(x["need"].alias("need"), (-x["w"]).alias("less")))))
    longest = F.filter("found", lambda x, i: (i == 0) | (F.get("found", i - 1)["need"] != x["need"]))
    edges = F.transform(longest, lambda x: F.struct(x["need"].alias("need"), (-x["less"]).alias("w")))
    return summed.select("conv_id", "id", "base", edges.alias("edges"), "ring")


def link(messages: DataFrame) -> DataFrame:
    """Calls and results with level and status, one row each; a message that repeats as a whole counts once.

    Of calls with the same id in a conversation the first (turn, place) counts,
    the others are ``duplicate``; results likewise. A call with a result is
    ``linked``, another ``unanswered``, a result without a call ``orphan``.
    level orders them topologically: a call is one above the highest of the
    calls it comes after, and a result follows its call; calls in or behind a
    ring of dependence have level null and status ``cyclic``.
    """
    spoken = messages.filter(F.size("events") > 0).dropDuplicates(["conv_id", "turn", "mark"])
    events = spoken.select("conv_id", "turn", "mark", F.explode("events").alias("e")).select("conv_id", "turn", "mark", "e.*")
    events = stage(numbered(events), "chat-events")
    calls, results = events.filter("kind = 'call' and first"), events.filter("kind = 'result' and first")
    calls = calls.alias("c").join(levels(calls.select("conv_id", "id", "after")).alias("d"), same("c", "d")).select("c.*", "d.level")
    answered = calls.alias("c").join(results.select("conv_id", "id", F.lit(True).alias("hit")).alias("r"), same("c", "r"), "left")
    status = F.when(F.col("c.level").isNull(), "cyclic").when(F.col("r.hit"), "linked").otherwise("unanswered")
    answered = answered.select("c.*", status.alias("status"), F.col("c.turn").alias("call_turn"))
    heard = results.alias("r").join(calls.select("conv_id", "id", "name", "turn", "level", F.lit(True).alias("hit")).alias("c"), same("r", "c"), "left")
    status = F.when(F.col("c.hit").isNull(), "orphan").when(F.col("c.level").isNull(), "cyclic").otherwise("linked")
    own = [F.col(f"r.{c}") for c in events.columns if c != "name"]
    heard = heard.select(*own, F.col("c.name"), F.col("c.level"), status.alias("status"), F.col("c.turn").alias("call_turn"))
    copies = events.filter("not first").withColumns({"level": F.lit(None).cast("int"), "status": F.lit("duplicate"), "call_turn": F.lit(None).cast("long")})
    return answered.unionByName(heard).unionByName(copies)


def message_text(role: str | None, content: str, events: list[dict] | None) -> str:
    """Canonical JSON of a message; bodies of events are canonical JSON already."""
    calls, results = [], []
    for e in events or ():
        own = {"id": e["id"], "name": e["name"], "status": e["status"]}
        if e["kind"] == "call":
            calls.append(f'{{"arguments":{e["body"]},' + canonical(own | {"level": e["level"], "valid": e["valid"]})[1:])
        else:
            results.append(f'{{"content":{e["body"]},' + canonical(own)[1:])
    whole = canonical({"content": content, "role": role})[:-1]
    lists = [f'"{name}":[{",".join(found)}]' for name, found in (("tool_calls", calls), ("tool_results", results)) if found]
    return ",".join([whole, *lists]) + "}"


def format_chats(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row a message: conv_id, turn, n_calls, n_results, n_linked, n_invalid, place, message.

    message is canonical JSON: content, role, tool_calls and tool_results with
    their link status. Messages of a conversation in order of (place, turn) are
    in topological order: place is the turn, or, where it holds results of
    later calls, the last of those turns. Null or empty texts give an empty
    content, a null conversation or turn stays null and links only within
    itself, repeated messages stay, each as if it stood alone, other columns are
    ignored.
    """
    own = turns.select("conv_id", "turn", "role", "text")
    messages = stage(parse_messages(own, schemas), "chat")
    linked = link(messages)
    entry = F.struct("kind", "place", "id", "name", "body", "valid", "status", "level", "call_turn")
    # Events of one message only are gathered: as many as its text holds.
    held = linked.groupBy("conv_id", "turn", "mark").agg(F.sort_array(F.collect_list(entry)).alias("held"))
    with_events = messages.filter(F.size("events") > 0).alias("m").join(held.alias("h"), F.col("m.conv_id").eqNullSafe(F.col("h.conv_id")) & F.col("m.turn").eqNullSafe(F.col("h.turn")) & (F.col("m.mark") == F.col("h.mark")), "left").select("m.conv_id", "m.turn", "m.role", "m.content", "h.held")
    plain = messages.filter(F.size("events") == 0).select("conv_id", "turn", "role", "content", F.lit(None).cast(with_events.schema["held"].dataType).alias("held"))
    rows = with_events.unionByName(plain)
    count = lambda test: F.coalesce(F.size(F.filter("held", test)), F.lit(0)).cast("long")
    counted = rows.select(
        "conv_id", "turn", count(lambda e: e["kind"] == "call").alias("n_calls"), count(lambda e: e["kind"] == "result").alias("n_results"), count(lambda e: e["status"] == "linked").alias("n_linked"),
        count(lambda e: ~e["valid"]).alias("n_invalid"), F.greatest("turn", F.array_max(F.transform("held", lambda e: F.when(e["kind"] == "result", e["call_turn"])))).alias("place"), "role", "content", "held",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [message_text(*m) for m in zip(*(batch.column(k).to_pylist() for k in (7, 8, 9)))]
            yield pa.record_batch([*batch.columns[:7], pa.array(made, pa.string())], names=[*batch.schema.names[:7], "message"])

    return counted.mapInArrow(run, "conv_id long, turn long, n_calls long, n_results long, n_linked long, n_invalid long, place long, message string")


def with_tools(turns: DataFrame) -> DataFrame:
    """Every turn with tool calls and results derived from what it is, as the table has none: even turns call, odd ones answer.

    Calls name three known tools and an unknown one, some with arguments beyond
    the schema, and come after earlier calls, in some conversations in a ring;
    results are left out, repeated or without a call in others.
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    call_id = F.concat(F.lit("c"), turn)
    kind = F.pmod(conv + turn / 2, F.lit(4)).cast("int")
    role = F.to_json(F.struct(F.col("role"))).substr(F.lit(9), F.char_length(F.to_json(F.struct(F.col("role")))) - 9)
    arguments = (
        F.when(kind == 0, F.concat(F.lit('{"query":'), role, F.lit(',"limit":'), turn, F.lit("}"))).when(kind == 1, F.concat(F.lit('{"expression":"1+'), turn, F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"city":'), role, F.lit(',"unit":"'), F.when(turn % 3 == 0, "kelvin").otherwise("celsius"), F.lit('"}'))).otherwise("{}")
    )
    name = F.get(F.array(*[F.lit(n) for n in ("search", "calculator", "get_weather", "other")]), kind)
    earlier = F.concat_ws(",", F.when((turn >= 2) & ((conv + turn) % 5 != 0), F.concat(F.lit('"c'), turn - 2, F.lit('"'))), F.when(turn >= 4, F.concat(F.lit('"c'), turn - 4, F.lit('"'))), F.when((turn == 0) & (conv % 9 == 4), F.lit('"c2"')))
    call = F.concat(F.lit('<tool_call>{"id":"'), call_id, F.lit('","name":"'), name, F.lit('","arguments":'), arguments, F.lit(',"after":['), earlier, F.lit("]}</tool_call>"))
    result = lambda i, content: F.concat(F.lit('<tool_result>{"id":"'), i, F.lit('","content":'), content, F.lit("}</tool_result>"))
    asked = F.concat(F.lit("c"), turn - 1)
    results = F.concat_ws(
        "", F.when((conv % 4 != 1) | (turn % 4 != 3), result(asked, F.concat(F.lit('{"turn":'), turn, F.lit(',"ok":true}')))), F.when((conv % 6 == 2) & (turn % 3 == 0), result(asked, F.lit('"again"'))),
        F.when(conv % 8 == 5, result(F.concat(F.lit("x"), turn), F.lit("[1.0,null]"))),
    )
    return turns.withColumn("text", F.concat_ws(" ", "text", F.when(turn % 2 == 0, call).otherwise(results)))


def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(with_tools(table(spark, folder, "conversations")))


_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ORACLE = rf"""
WITH RECURSIVE t AS (SELECT conv_id AS c, turn AS t, role, regexp_replace(coalesce(text, ''), '^{_BLANK}+|{_BLANK}+$', '', 'g') AS content FROM conversations),
calls AS (SELECT c, t, (c + t // 2) % 4 AS k, list_filter([CASE WHEN t >= 2 AND (c + t) % 5 != 0 THEN t - 2 END, CASE WHEN t >= 4 THEN t - 4 END, CASE WHEN t = 0 AND c % 9 = 4 THEN 2 END], lambda x: x IS NOT NULL) AS after,
  CASE k WHEN 0 THEN '{{"limit":' || t || ',"query":' || to_json(role) || '}}' WHEN 1 THEN '{{"expression":"1+' || t || '"}}'
    WHEN 2 THEN '{{"city":' || to_json(role) || ',"unit":"' || CASE WHEN t % 3 = 0 THEN 'kelvin' ELSE 'celsius' END || '"}}' ELSE '{{}}' END AS arguments,
  ['search', 'calculator', 'get_weather', 'other'][k + 1] AS name, CASE k WHEN 0 THEN t >= 1 AND role != '' WHEN 2 THEN t % 3 != 0 ELSE true END AS valid FROM t WHERE t % 2 = 0),
results AS (SELECT c, t, 0 AS p, t - 1 AS call, 'c' || (t - 1) AS id, '{{"ok":true,"turn":' || t || '}}' AS content FROM t WHERE t % 2 = 1 AND (c % 4 != 1 OR t % 4 != 3)
  UNION ALL SELECT c, t, 1, t - 1, 'c' || (t - 1), '"again"' FROM t WHERE t % 2 = 1 AND c % 6 = 2 AND t % 3 = 0
  UNION ALL SELECT c, t, 2, NULL, 'x' || t, '[1,null]' FROM t WHERE t % 2 = 1 AND c % 8 = 5),
needs AS (SELECT n.c, n.t, n.need FROM (SELECT c, t, unnest(after) AS need FROM calls) n JOIN calls o ON n.c = o.c AND n.need = o.t),
walk AS (SELECT c, t, t AS at, 0 AS n FROM calls UNION SELECT walk.c, walk.t, needs.need, n + 1 FROM walk JOIN needs ON walk.c = needs.c AND walk.at = needs.t WHERE n <= (SELECT max(n) FROM (SELECT count(*) AS n FROM calls GROUP BY c))),
level AS (SELECT c, t, CASE WHEN max(n) <= (SELECT max(n) FROM (SELECT count(*) AS n FROM calls GROUP BY c)) THEN max(n) END AS level FROM walk GROUP BY c, t),
first AS (SELECT c, id, min((t, p)) AS f FROM results GROUP BY c, id),
cs AS (SELECT calls.*, level, CASE WHEN level IS NULL THEN 'cyclic' WHEN f IS NOT NULL THEN 'linked' ELSE 'unanswered' END AS status FROM calls JOIN level USING (c, t) LEFT JOIN first ON first.c = calls.c AND first.id = 'c' || calls.t),
rs AS (SELECT r.c, r.t, r.p, r.id, r.content, CASE WHEN f != (r.t, r.p) THEN 'duplicate' WHEN k.t IS NULL THEN 'orphan' WHEN k.level IS NULL THEN 'cyclic' ELSE 'linked' END AS status, CASE WHEN f = (r.t, r.p) THEN k.name END AS name, CASE WHEN f = (r.t, r.p) THEN k.t END AS call
  FROM results r JOIN first ON r.c = first.c AND r.id = first.id LEFT JOIN cs k ON k.c = r.c AND k.t = r.call),
rm AS (SELECT c, t, count(*) AS n, count(*) FILTER (WHERE status = 'linked') AS linked, max(call) AS call,
  string_agg('{{"content":' || content || ',"id":"' || id || '","name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"status":"' || status || '"}}', ',' ORDER BY p) AS text FROM rs GROUP BY c, t)
SELECT t.c AS conv_id, t.t AS turn, CASE WHEN cs.t IS NULL THEN 0 ELSE 1 END::BIGINT AS n_calls, coalesce(rm.n, 0)::BIGINT AS n_results, (coalesce(rm.linked, 0) + CASE WHEN cs.status = 'linked' THEN 1 ELSE 0 END)::BIGINT AS n_linked,
  CASE WHEN NOT cs.valid THEN 1 ELSE 0 END::BIGINT AS n_invalid, greatest(t.t, rm.call)::BIGINT AS place,
  '{{"content":' || to_json(t.content) || ',"role":' || to_json(t.role)
  || CASE WHEN cs.t IS NULL THEN '' ELSE ',"tool_calls":[{{"arguments":' || arguments || ',"id":"c' || cs.t || '","level":' || coalesce(level::VARCHAR, 'null') || ',"name":"' || cs.name || '","status":"' || cs.status || '","valid":' || valid || '}}]' END
  || CASE WHEN rm.t IS NULL THEN '' ELSE ',"tool_results":[' || rm.text || ']' END || '}}' AS message
FROM t LEFT JOIN cs ON cs.c = t.c AND cs.t = t.t LEFT JOIN rm ON rm.c = t.c AND rm.t = t.t
"""

QUERIES = {"op9_chat": op9_chat}
ORACLES = {"op9_chat": ORACLE}
