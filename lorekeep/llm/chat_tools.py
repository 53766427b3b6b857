"""Tool-call linking for chat data: join calls and results by identifier, order, validate, serialise."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import arrow_rows, release, settle

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_RESULT = re.compile(r"<tool_result>(.*?)</tool_result>", re.S)
CALLS = "conv_id long, turn long, k int, call_id string, name string, arguments string, needs array<string>"
RESULTS = "conv_id long, turn long, k int, call_id string, content string"


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces and plain UTF-8: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def references(value: Any) -> list[str]:
    """Identifiers of the calls whose results a value asks for: {"$ref": id} anywhere in it."""
    if isinstance(value, dict):
        own = [value["$ref"]] if isinstance(value.get("$ref"), str) else []
        return own + [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violations(value: Any, schema: dict, path: str = "$") -> list[str]:
    """Where a value breaks a JSON schema: type, enum, required, properties, additionalProperties, items, bounds, lengths, pattern."""
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not any(number and (k == "number" or k == "integer" and float(value).is_integer()) or k in _TYPES and isinstance(value, _TYPES[k]) for k in kinds):
            return [f"{path}: type"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                # A reference is filled in by another call's result.
                out += [] if isinstance(v, dict) and set(v) == {"$ref"} else violations(v, known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: additional")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += violations(v, schema.get("items", {}), f"{path}[{i}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", float("inf")):
            out.append(f"{path}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: pattern")
    elif isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", float("-inf")) <= value <= schema.get("maximum", float("inf")):
        out.append(f"{path}: bounds")
    return out


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results written into the text of messages (conv_id, turn, text).

    <tool_call>{"id", "name", "arguments"}</tool_call> and
    <tool_result>{"id", "content"}</tool_result>; what is no such JSON becomes a
    call or result without id, which links with nothing.
    """
    arrow_rows(messages.sparkSession)
    source = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("text").cast("string"))

    def found(pattern: re.Pattern, text: str | None) -> Iterator[tuple[int, dict]]:
        for k, m in enumerate(pattern.finditer(text or "")):
            try:
                value = json.loads(m[1])
            except ValueError:
                value = {}
            yield k, value if isinstance(value, dict) else {}

    def text_of(value: Any) -> str | None:
        return value if isinstance(value, str) else None

    def run(kind: str):
        def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns)):
                    for k, v in found(_CALL if kind == "call" else _RESULT, text):
                        if kind == "call":
                            arguments = v.get("arguments")
                            rows.append((conv, turn, k, text_of(v.get("id")), text_of(v.get("name")), canonical(arguments), references(arguments)))
                        else:
                            rows.append((conv, turn, k, text_of(v.get("id")), canonical(v.get("content"))))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.string()] + ([pa.string(), pa.string(), pa.list_(pa.string())] if kind == "call" else [pa.string()])
                names = ["conv_id", "turn", "k", "call_id"] + (["name", "arguments", "needs"] if kind == "call" else ["content"])
                columns = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        return batches_of

    return source.mapInArrow(run("call"), CALLS), source.mapInArrow(run("result"), RESULTS)


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations in the same form: a user's turn calls "reply", the assistant's next turn is its result.

    The call's id is "u" and its turn.  In conversations with an even number it
    needs, from turn 2 on, the result of the call two turns before; in those with
    an odd one each call needs the one two turns later, so that they have to be
    put in order.  Other roles are neither.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lit(0).alias("k"), "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    calls = rows.where("role = 'user'")
    later = F.coalesce(F.col("conv_id") % 2 != 0, F.lit(False))
    after = F.concat(F.lit("u"), F.when(later, F.col("turn") + 2).otherwise(F.col("turn") - 2).cast("string"))
    # Keys in order and no spaces: this is canonical() of the same value.
    first = (F.col("turn") < 2) & ~later
    arguments = F.concat(F.when(first, F.lit("{")).otherwise(F.concat(F.lit('{"after":{"$ref":"'), after, F.lit('"},'))), F.lit('"text":'), _json_string(F.col("text")), F.lit("}"))
    calls = calls.select("conv_id", "turn", "k", F.concat(F.lit("u"), F.col("turn").cast("string")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(first, F.array().cast("array<string>")).otherwise(F.array(after)).alias("needs"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", "k", F.concat(F.lit("u"), (F.col("turn") - 1).cast("string")).alias("call_id"), _json_string(F.col("text")).alias("content"))
    return calls, results


def _json_string(text: Column) -> Column:
    """A text as a JSON string."""
    return F.substring(F.to_json(F.array(text)), 2, 2**31 - 1).substr(F.lit(1), F.length(F.to_json(F.array(text))) - 2)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and one per result that has no call.

    Columns: conv_id, call_id, name, turn, k, result_turn, n_results, level,
    valid, problems, record.  Calls and results meet by a hash join on
    (conv_id, call_id); of several results the first by (turn, k) counts, and of
    several calls with one id each takes it.  (level, turn, k) orders a
    conversation so that every call follows the calls it needs: where needs
    only look back, all levels are 0; else a call's level is one over its
    needs' highest, and calls on or behind a cycle have a null level.  Needs
    that name no call of the conversation are listed as problems, like schema
    violations and unknown tools.  record is canonical JSON: arguments, id,
    name, result.  Null ids never link.  Empty tables give no rows.

    Nothing is gathered by conversation: levels come from joins, so one
    conversation may hold any share of the rows.
    """
    arrow_rows(calls.sparkSession)
    calls = settle(calls.select("conv_id", "turn", "k", "call_id", "name", "arguments", F.array_distinct("needs").alias("needs")), "calls")
    answers = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "k", "content")).alias("r"), F.count("*").alias("n_results"))
    nodes = calls.where("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "k")).alias("at"))
    wants = calls.where("conv_id is not null").select("conv_id", "call_id", F.struct("turn", "k").alias("from"), F.explode("needs").alias("need"))
    edges = wants.join(nodes.withColumnsRenamed({"call_id": "need"}), ["conv_id", "need"], "left")
    dangling = edges.where("at is null").groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set("need")).alias("missing"))
    levels = _levels(nodes, edges.where("at is not null and call_id is not null"))
    joined = calls.join(answers, ["conv_id", "call_id"], "full").join(levels, ["conv_id", "call_id"], "left").join(dangling, ["conv_id", "call_id"], "left")
    # A result without a call has no arguments; its own place is in result_turn.
    rows = joined.select("conv_id", "call_id", "name", "turn", "k", F.col("r.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.when(F.col("turn").isNotNull(), F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level"))).alias("level"), "arguments", F.col("r.content").alias("content"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))
    shared = calls.sparkSession.sparkContext.broadcast(schemas)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, problems, records = [], [], []
            for call_id, name, turn, arguments, content, missing in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 8, 9, 10))):
                result = None if content is None else json.loads(content)
                if turn is None:
                    found = ["no call"]
                    record = {"id": call_id, "result": result}
                else:
                    value = json.loads(arguments) if arguments is not None else None
                    schema = shared.value.get(name)
                    found = ["unknown tool"] if schema is None else violations(value, schema)
                    found += [f"needs {m}" for m in missing]
                    if call_id is None:
                        found.append("no id")
                    record = {"arguments": value, "id": call_id, "name": name, "result": result}
                valid.append(not found)
                problems.append(found)
                records.append(canonical(record))
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(valid), pa.array(problems, pa.list_(pa.string())), pa.array(records, pa.string())], names=["conv_id", "call_id", "name", "turn", "k", "result_turn", "n_results", "level", "valid", "problems", "record"])

    return rows.mapInArrow(check, "conv_id long, call_id string, name string, turn long, k int, result_turn long, n_results long, level int, valid boolean, problems array<string>, record string")


def _levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls with a level; see link_tool_calls.

    A round settles the calls whose needs are settled.  Needs of a call that
    itself waits for one call only are passed on to that one, so a chain of any
    length takes a number of rounds that grows with its logarithm.  A round
    that settles nothing leaves only calls on or behind cycles.
    """
    forward = settle(edges.where("at >= from").select("conv_id").distinct(), "forward")
    if forward.isEmpty():
        return nodes.select("conv_id", "call_id", F.lit(0).alias("level"))
    plain = nodes.join(forward, "conv_id", "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"))
    left = settle(edges.join(forward, "conv_id", "left_semi").select("conv_id", "call_id", "need").distinct().withColumn("w", F.lit(1)), "edges")
    done = settle(nodes.join(forward, "conv_id", "left_semi").join(left, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level")), "levels")
    while True:
        known = left.join(done.withColumnsRenamed({"call_id": "need", "level": "of_need"}), ["conv_id", "need"], "left")
        state = known.groupBy("conv_id", "call_id").agg(F.max(F.col("of_need") + F.col("w")).alias("level"), F.count_if(F.col("of_need").isNull()).alias("open"), F.count("*").alias("needs"), F.min("need").alias("next"), F.min("w").alias("step"))
        state = settle(state, "states")
        fresh = state.where("open = 0").select("conv_id", "call_id", "level")
        if fresh.isEmpty():
            break
        waiting = left.join(state.where("open > 0").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
        through = state.where("open = 1 and needs = 1").select("conv_id", F.col("call_id").alias("need"), "next", "step")
        passed = waiting.join(through, ["conv_id", "need"], "left").select("conv_id", "call_id", F.coalesce("next", "need").alias("need"), (F.col("w") + F.coalesce("step", F.lit(0))).alias("w"))
        old = left, done, state
        left = settle(passed.groupBy("conv_id", "call_id", "need").agg(F.max("w").alias("w")), "edges")
        done = settle(done.unionByName(fresh), "levels")
        release(*old)
    return plain.unionByName(done)


def record_digest(record: str) -> str:
    return hashlib.sha256(record.encode()).hexdigest()
