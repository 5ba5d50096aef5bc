"""Chat formatting: links, order, schemas and JSON against a plain version."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lakewarden.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def call(i, name="search", args=None, after=()):
    return f"<tool_call>{json.dumps({'id': i, 'name': name, 'arguments': {'query': 'x'} if args is None else args, 'after': list(after)})}</tool_call>"


def result(i, content="ok"):
    return f"<tool_result>{json.dumps({'id': i, 'content': content})}</tool_result>"


def test_schemas():
    s = chat.SCHEMAS["search"]
    assert chat.fits({"query": "x", "limit": 3}, s) and chat.fits({"query": "x", "limit": 3.0}, s)
    assert not any(chat.fits(v, s) for v in ({}, {"query": ""}, {"query": 1}, {"query": "x", "limit": 0}, {"query": "x", "limit": True}, {"query": "x", "more": 1}, [], None))
    assert chat.fits({"city": "B", "unit": "celsius", "x": 1}, chat.SCHEMAS["get_weather"]) and not chat.fits({"city": "B", "unit": "k"}, chat.SCHEMAS["get_weather"])
    assert chat.fits([1, 2], {"type": "array", "items": {"type": "number", "maximum": 2}}) and not chat.fits([1, 3], {"type": "array", "items": {"maximum": 2}})


def test_canonical():
    assert chat.canonical({"b": 1.0, "a": [float("nan"), "é", {"z": None, "y": 0.5}]}) == '{"a":[null,"é",{"y":0.5,"z":null}],"b":1}'


def plain_levels(calls):
    """calls: id -> after; level of each, None in or behind a ring."""
    level = {}
    while True:
        ready = {i: 1 + max((level[a] for a in after if a in calls), default=-1) for i, after in calls.items() if i not in level and all(a in level for a in after if a in calls)}
        if not ready:
            return {i: level.get(i) for i in calls}
        level |= ready


def test_links_and_levels(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "see " + call("a") + " and " + call("b", after=["a", "zz"]) + call("c", after=["b", "a"])), (1, 2, "tool", json.dumps({"id": "a", "content": {"k": 1.0}})),
        (1, 3, "tool", result("b") + result("a", "again")), (1, 4, "assistant", call("x", after=["y"]) + call("y", after=["x"]) + call("w", after=["y"])), (1, 5, "tool", result("nobody")),
        (2, 0, "tool", result("late")), (2, 1, "assistant", call("late", args='{"query": ""}') + call("late")), (3, 0, "user", None), (3, 1, None, ""), (3, 2, "assistant", "<tool_call>no json</tool_call>"),
        (None, None, "assistant", call("a")), (3, 0, "user", None), (4, 0, "assistant", call("r")), (4, 0, "assistant", call("r")), (4, 0, "assistant", "other " + call("s")), (4, 1, "tool", result("r")),
    ]
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("events", F.lit("own"))
    out = {}
    for r in chat.format_chats(turns).collect():
        out.setdefault((r.conv_id, r.turn), []).append((r, json.loads(r.message)))
    assert sum(map(len, out.values())) == len(rows) and len(out[3, 0]) == 2
    r, m = out[1, 1][0]
    assert m["content"] == "see  and" and (r.n_calls, r.n_linked, r.n_invalid) == (3, 2, 0)
    assert [(c["id"], c["status"], c["level"]) for c in m["tool_calls"]] == [("a", "linked", 0), ("b", "linked", 1), ("c", "unanswered", 2)]
    assert out[1, 2][0][1]["tool_results"] == [{"id": "a", "name": "search", "content": {"k": 1}, "status": "linked"}] and out[1, 2][0][1]["content"] == ""
    assert [(c["id"], c["status"]) for c in out[1, 3][0][1]["tool_results"]] == [("b", "linked"), ("a", "duplicate")]
    assert {(c["id"], c["status"], c["level"]) for c in out[1, 4][0][1]["tool_calls"]} == {("x", "cyclic", None), ("y", "cyclic", None), ("w", "cyclic", None)}
    assert out[1, 5][0][1]["tool_results"][0]["status"] == "orphan"
    assert out[2, 0][0][0].place == 1 and out[2, 1][0][0].place == 1 and out[2, 1][0][0].n_invalid == 1
    assert [c["status"] for c in out[2, 1][0][1]["tool_calls"]] == ["linked", "duplicate"]
    assert out[3, 2][0][1]["content"] == "<tool_call>no json</tool_call>" and out[3, 1][0][1] == {"role": None, "content": ""}
    assert out[None, None][0][0].n_calls == 1
    assert sorted((m["content"], [(c["id"], c["status"]) for c in m["tool_calls"]]) for _, m in out[4, 0]) == [("", [("r", "linked")])] * 2 + [("other", [("s", "unanswered")])]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_random_dependence(spark):
    dice, rows, want = random.Random(3), [], {}
    for conv in range(12):
        ids = [f"c{k}" for k in range(dice.randrange(1, 9))]
        calls = {i: dice.sample([*ids, "none"], dice.choice([0, 0, 1, 1, 2]) if len(ids) > 1 else 0) for i in ids}
        want |= {(conv, i): v for i, v in plain_levels(calls).items()}
        rows += [(conv, k, "assistant", call(i, after=calls[i])) for k, i in enumerate(ids)]
    linked = chat.link(chat.parse_messages(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {(r.conv_id, r.id): r.level for r in linked} == want


DEEP = "[" * 3000 + "]" * 3000


@pytest.mark.parametrize("text, content, ids", [
    (f'a <tool_result>{{"id":"x","content":{DEEP}}}</tool_result>', None, []), ('<tool_call>{"id":"x","name":"search","arguments":' + '{"a":' * 5000 + "1" + "}" * 5001 + "</tool_call>", None, []),
    ('<tool_call>{"id":"\\ud800","name":"n\\udfff","arguments":{"\\ud800":"\\udc00"}}</tool_call>', "", ["\ufffd"]), ('<tool_call>{"id":1,"name":"search","arguments":{"query":"x","limit":' + "9" * 400 + "}}</tool_call>", "", ["1"]),
    ('<tool_call>{"id":' + "9" * 5000 + "}</tool_call>", None, []), ('<tool_call>{"id":"e","name":"search","arguments":{"query":"x","limit":1e999}}</tool_call>', "", ["e"]),
    ("<tool_call>" * 200_000, None, []), ("<tool_call>" * 200_000 + "</tool_call>", None, []), ("<tool_call></tool_result>" * 100_000, None, []), ('<tool_call>{"id":true}</tool_call>', None, []),
    ('<tool_call>{"id":"a","after":[["b"],"c",true,2]}</tool_call>', "", ["a"]),
])
def test_odd_messages(text, content, ids):
    """What no JSON parser should be asked to do stays text or becomes sound; nothing raises, nothing takes long."""
    began = time.perf_counter()
    got, events = chat.parse("assistant", text, chat.SCHEMAS)
    assert time.perf_counter() - began < 5
    assert got == (text if content is None else content) and [e["id"] for e in events] == ids
    json.dumps([got, events], ensure_ascii=False).encode()
    held = [e | {"status": "linked", "level": 0} for e in events]
    assert json.loads(chat.message_text("assistant", got, held))["content"] == got


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of calls, one with a ring at its end, a comb and a ladder; repeated ids by the thousand."""
    n = 1500
    rows = [(1, f"c{k}", [f"c{k - 1}"] if k else []) for k in range(n)]
    rows += [(2, f"c{k}", [f"c{k - 1}"] if k else ["c2"]) for k in range(n)]
    rows += [(3, f"c{k}", [f"c{k - 1}", f"r{k}"] if k else []) for k in range(n)] + [(3, f"r{k}", []) for k in range(n)]
    rows += [(4, f"{s}{k}", [f"a{k - 1}", f"b{k - 1}"] if k else []) for k in range(12) for s in "ab"]
    rows += [(6, f"c{k}", [f"c{k - j}" for j in (1, 2, 3) if k >= j]) for k in range(200)]
    rows += [(5, "p", ["q", "s"]), (5, "q", ["p", "s"]), (5, "s", ["p", "q"]), (None, "c0", []), (None, "c1", ["c0", "c5"])]
    want = {}
    for conv in (1, 2, 3, 4, 5, 6, None):
        want |= {(conv, i): v for i, v in plain_levels({i: a for c, i, a in rows if c == conv}).items()}
    rounds = []
    whole = chat._follow
    monkeypatch.setattr(chat, "_follow", lambda *a, **k: rounds.append(1) or whole(*a, **k))
    out = chat.levels(spark.createDataFrame(rows, "conv_id long, id string, after array<string>")).collect()
    assert {(r.conv_id, r.id): r.level for r in out} == want and len(out) == len(rows)
    assert len(rounds) <= 2 * 16


def test_repeated_ids(spark):
    rows = [(1, t, "assistant", call("same", args={"query": f"q{t}"}) + result("same", t)) for t in range(300)]
    linked = chat.link(chat.parse_messages(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(linked) == 600 and {(r.kind, r.turn, r.status) for r in linked if r.status != "duplicate"} == {("call", 0, "linked"), ("result", 0, "linked")}
