import json
import random

from lorekeep.llm import chat_tools as ct

SCHEMAS = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["integer", "null"]}, "tag": {"type": "string", "maxLength": 3, "enum": ["x", "y"]}}, "additionalProperties": False}}


def brute_levels(calls):
    """Levels by repeated relaxation; calls: id -> needs (known ids only), places in order."""
    order = {c: k for k, c in enumerate(calls)}
    if all(order[n] < order[c] for c, ns in calls.items() for n in ns):
        return dict.fromkeys(calls, 0)
    level, left = {}, dict(calls)
    while True:
        ready = [c for c, ns in left.items() if all(n in level for n in ns)]
        if not ready:
            return {c: level.get(c) for c in calls}
        new = {c: 1 + max((level[n] for n in left[c]), default=-1) for c in ready}
        level |= new
        for c in ready:
            del left[c]


def test_links_levels_and_records(spark):
    rnd = random.Random(13)
    calls, results, want = [], [], {}
    for conv in range(40):
        ids = [f"c{i}" for i in range(rnd.randint(1, 7))]
        needs = {c: sorted({rnd.choice(ids[: max(1, k)] if conv % 2 else ids) for _ in range(rnd.randint(0, 2))} - {c}) for k, c in enumerate(ids)}
        levels = brute_levels(needs)
        for k, c in enumerate(ids):
            args = {"b": None, "a": k, **{f"r{i}": {"$ref": n} for i, n in enumerate(needs[c])}}
            calls.append((conv, k, 0, c, "add", json.dumps(args), needs[c]))
            if rnd.random() < 0.7:
                results.append((conv, k, 1, c, json.dumps({"é": [1, k]})))
                if rnd.random() < 0.3:
                    results.append((conv, k + 9, 0, c, '"late"'))
            has = [r for r in results if r[0] == conv and r[3] == c]
            want[(conv, c)] = (levels[c], has[0][1] if has else None, len(has), not needs[c], ct.canonical({"id": c, "name": "add", "arguments": args, "result": json.loads(has[0][4]) if has else None}))
    odd = [(100, 0, 0, None, "add", '{"a":1,"b":2}', []), (100, 1, 0, "z", None, None, None), (None, 0, 0, "c0", "add", '{"a":-1,"b":1.5,"tag":"long"}', ["nowhere"]), (100, 2, 0, "q", "sub", "{}", ["gone"])]
    results += [(100, 3, 0, "lonely", "1"), (100, 4, 0, None, "2"), (None, 0, 0, "c0", "3")]
    c = spark.createDataFrame(calls + odd, ct.CALLS)
    r = spark.createDataFrame(results, ct.RESULTS)
    rows = ct.link_tool_calls(c, r, SCHEMAS).collect()
    got = {(x["conv_id"], x["call_id"]): (x["level"], x["result_turn"], x["n_results"], x["valid"], x["record"]) for x in rows if x["conv_id"] is not None and x["conv_id"] < 100}
    assert got == want
    rest = {(x["conv_id"], x["call_id"], x["turn"]): x for x in rows if x["conv_id"] is None or x["conv_id"] == 100}
    assert rest[(100, "lonely", None)]["problems"] == ["no call"] and rest[(100, "lonely", None)]["level"] is None
    assert rest[(100, None, 0)]["problems"] == ["no id"] and rest[(100, "z", 1)]["problems"] == ["unknown tool"]
    assert rest[(100, "q", 2)]["problems"] == ["unknown tool", "needs gone"]
    assert rest[(None, "c0", 0)]["problems"] == ["$.a: bounds", "$.b: type", "$.tag: enum", "$.tag: length"]
    assert ct.link_tool_calls(c.limit(0), r.limit(0), SCHEMAS).count() == 0


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    n = 700
    calls = [(1, k, 0, f"c{k}", "add", "{}", [f"c{k + 1}"] if k < n - 1 else []) for k in range(n)]
    calls += [(2, 0, 0, "a", "add", "{}", ["b"]), (2, 1, 0, "b", "add", "{}", ["a"]), (2, 2, 0, "behind", "add", "{}", ["a"]), (2, 3, 0, "own", "add", "{}", ["own"]), (2, 4, 0, "free", "add", "{}", [])]
    tables = []
    real = ct.settle
    monkeypatch.setattr(ct, "settle", lambda df, label: tables.append(label) or real(df, label))
    rows = ct.link_tool_calls(spark.createDataFrame(calls, ct.CALLS), spark.createDataFrame([], ct.RESULTS), SCHEMAS).collect()
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in rows}
    assert all(got[(1, f"c{k}")] == n - 1 - k for k in range(n))
    assert [got[(2, c)] for c in ("a", "b", "behind", "own", "free")] == [None, None, None, None, 0]
    assert len(tables) < 50


def test_extract_and_plain_turns(spark):
    call = '<tool_call>{"id":"a","name":"add","arguments":{"b":{"$ref":"z"},"a":1}}</tool_call>'
    rows = [(1, 0, f"hi {call} and <tool_call>no json</tool_call>", "user"), (1, 1, '<tool_result>{"id":"a","content":[1, 2]}</tool_result>', "tool"), (2, 0, None, "user"), (2, 1, 'q"\n\\é', "assistant"), (2, 2, "", "user"), (3, 5, "alone", "assistant")]
    m = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, text string, role string, call_id string")
    calls, results = ct.extract(m)
    assert sorted(map(tuple, calls.collect()), key=str) == sorted([(1, 0, 0, "a", "add", '{"a":1,"b":{"$ref":"z"}}', ["z"]), (1, 0, 1, None, None, "null", [])], key=str)
    assert [tuple(r) for r in results.collect()] == [(1, 1, 0, "a", "[1,2]")]
    calls, results = ct.turns_as_calls(m.where("conv_id > 1"))
    out = {(r["conv_id"], r["call_id"]): r for r in ct.link_tool_calls(calls, results, {"reply": {"type": "object"}}).collect()}
    assert out[(2, "u0")]["record"] == ct.canonical({"arguments": {"text": ""}, "id": "u0", "name": "reply", "result": 'q"\n\\é'})
    assert out[(2, "u2")]["record"] == ct.canonical({"arguments": {"after": {"$ref": "u0"}, "text": ""}, "id": "u2", "name": "reply", "result": None})
    assert out[(3, "u4")]["problems"] == ["no call"]
