"""Operator 5: tool calls linked with their results, ordered, validated and written as canonical JSON.

Calls and results are joined by conversation and identifier. Calls may refer to
results of other calls ("$ref:<id>" as a string in their arguments); such calls are
put after those, in rounds over the edges alone: a round follows all chains as far
as they lie in one range of turns, so that long chains take few rounds. Each event
becomes one line of canonical JSON: sorted keys, no white space, no needless
escapes. Events are ordered by ranges of the whole table, so that no conversation is
gathered in one row or sorted in one task.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..io import global_position
from .common import prepare, row_batches, union_all, written

_KEY = ["conv_id", "call_id"]


# -- validation --------------------------------------------------------------------------------

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return (isinstance(value, int) and not isinstance(value, bool)) or (isinstance(value, float) and value.is_integer())
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, const, required, properties, additionalProperties, items, bounds, lengths, pattern."""
    out = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(value[k], schema["additionalProperties"], f"{path}.{k}")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            out.append(f"{path}: length")
        for i, x in enumerate(value if "items" in schema else []):
            out += violations(x, schema["items"], f"{path}[{i}]")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            out.append(f"{path}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: pattern")
    if _is(value, "number"):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            out.append(f"{path}: out of bounds")
    return out


def canonical(value) -> str:
    """JSON with sorted keys and no white space; whole floats as integers."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _plain(x):
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53 else x


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


# -- linking -----------------------------------------------------------------------------------


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, level, cyclic): the turn at which each call can be made, and how many calls it waits for in a row."""
    own = calls.groupBy(*_KEY).agg(F.min_by("arguments", F.struct("turn", "seq", "name", "arguments")).alias("arguments"), F.min("turn").alias("at"))
    edges = own.select(*_KEY, "at", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$ref:([^"]+)"'), 1))).alias("ref"))
    edges = written(edges.join(own.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_semi"), "refs")
    state = own.select(*_KEY, "at")
    if edges.isEmpty():
        return state.withColumns({"level": F.lit(0), "cyclic": F.lit(False)})
    new = written(state.join(edges.select(*_KEY).distinct(), _KEY, "left_anti").withColumn("level", F.lit(0)), "levels")
    done = [new]
    open_ = edges.withColumns({"ref_at": F.lit(None).cast("long"), "ref_level": F.lit(None).cast("int")})
    while True:
        known = new.select("conv_id", F.col("call_id").alias("ref"), F.col("at").alias("_at"), F.col("level").alias("_level"))
        open_ = open_.join(known, ["conv_id", "ref"], "left").withColumns({"ref_at": F.coalesce("ref_at", "_at"), "ref_level": F.coalesce("ref_level", "_level")}).drop("_at", "_level")
        open_ = written(open_.select("conv_id", "call_id", "at", "ref", "ref_at", "ref_level"), "open")
        new = written(open_.repartitionByRange("conv_id", "at", "call_id").mapInArrow(_follow, "conv_id long, call_id string, at long, level int"), "levels")
        if new.isEmpty():
            break
        done.append(new)
        open_ = open_.join(new.select(*_KEY), _KEY, "left_anti")
    left = open_.groupBy(*_KEY).agg(F.max("at").alias("at")).withColumns({"level": F.lit(0), "cyclic": F.lit(True)})
    return union_all([*(x.withColumn("cyclic", F.lit(False)) for x in done), left])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The calls of a range of turns that can be made: all they refer to is known, or becomes known here."""
    at: dict[tuple, int | None] = {}
    level: dict[tuple, int] = {}
    missing: dict[tuple, int] = defaultdict(int)
    waiting: dict[tuple, list] = defaultdict(list)
    later = lambda a, b: b if a is None else a if b is None else max(a, b)
    for batch in batches:
        for conv, call, own_at, ref, ref_at, ref_level in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = (conv, call)
            at[key], level[key] = later(at.get(key), own_at), level.get(key, 0)
            if ref_level is None:
                missing[key] += 1
                waiting[conv, ref].append(key)
            else:
                at[key], level[key] = later(at[key], ref_at), max(level[key], ref_level + 1)
    ready, out = [k for k in at if not missing[k]], []
    while ready:
        key = ready.pop()
        out.append((*key, at[key], level[key]))
        for k in waiting.pop(key, ()):
            at[k], level[k] = later(at[k], at[key]), max(level[k], level[key] + 1)
            missing[k] -= 1
            if not missing[k]:
                ready.append(k)
    yield from row_batches(out, [pa.int64(), pa.string(), pa.int64(), pa.int32()], ["conv_id", "call_id", "at", "level"])


def link_tool_calls(events: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, position, turn, seq, kind, call_id, linked, valid, errors, json) for each event.

    events has conv_id, turn, seq (order within a turn), role, text, call_id, name
    and arguments (JSON). A row with a name and a call_id is a call; else one of
    role "tool" is a result; all others are messages. Of calls (or results) with one
    identifier in a conversation, the first by (turn, seq) is linked; later ones
    stay, not linked, as "duplicate id". A result comes after its call, a call
    after those it refers to; apart from that, events keep their turns. Calls
    that wait for each other are "cyclic" and keep their place. Errors: "no
    result", "no call", "duplicate id", "cyclic", "arguments: not JSON", "unknown tool", and
    violations of the tool's schema. Null texts are written as null; null turns come
    first; a null conv_id links nothing. Repeated rows stay, the later as
    duplicates; extra columns are left out; an empty table gives no rows.
    """
    prepare(events.sparkSession)
    e = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("seq").cast("int").alias("seq"), "role", "text", "call_id", "name", "arguments")
    is_call = F.col("name").isNotNull() & F.col("call_id").isNotNull()
    e = e.withColumn("kind", F.when(is_call, "call").when(F.col("role") == "tool", "result").otherwise("message"))
    calls, results = e.where("kind = 'call'"), e.where("kind = 'result' AND call_id IS NOT NULL")
    levels = _levels(calls)
    calls = calls.join(levels, _KEY, "left").join(results.select(*_KEY).distinct().withColumn("other", F.lit(True)), _KEY, "left")
    results = results.join(levels.withColumn("other", F.lit(True)), _KEY, "left")
    both = calls.unionByName(results).withColumns({"other": F.coalesce("other", F.lit(False)), "cyclic": F.coalesce("cyclic", F.lit(False)) & (F.col("kind") == "call")})
    rank = F.when(F.col("kind") == "call", 2 * F.col("level")).when(F.col("turn") > F.col("at"), 0).otherwise(2 * F.col("level") + 1)
    both = both.select(*e.columns, F.greatest("turn", F.coalesce("at", "turn")).alias("at"), F.coalesce(rank, F.lit(0)).alias("rank"), "cyclic", "other")
    rest = e.where("kind = 'message' OR (kind = 'result' AND call_id IS NULL)")
    no = F.lit(False)
    rest = rest.select(*e.columns, F.col("turn").alias("at"), F.lit(0).alias("rank"), no.alias("cyclic"), no.alias("other"))
    order = ["conv_id", F.col("at").asc_nulls_first(), "rank", "turn", "seq", "kind", "call_id", F.xxhash64("text", "name", "arguments", "role")]
    placed = written(global_position(both.unionByName(rest), order, "place"), "placed")
    # where each conversation begins, and the first event of each kind and identifier
    begins = placed.groupBy(F.col("conv_id").alias("conv")).agg(F.min("place").alias("begin"))
    firsts = placed.where("kind <> 'message' AND call_id IS NOT NULL AND conv_id IS NOT NULL").groupBy(*_KEY, "kind").agg(F.min("place").alias("first"))
    placed = placed.join(begins, F.col("conv_id").eqNullSafe(F.col("conv"))).join(firsts, [*_KEY, "kind"], "left")
    is_first = F.coalesce(F.col("place") == F.col("first"), F.lit(False))
    placed = placed.withColumns({"position": F.col("place") - F.col("begin") + 1, "linked": is_first & F.col("other"), "repeat": F.coalesce(F.col("place") > F.col("first"), F.lit(False))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                errors = []
                if r["kind"] == "message":
                    line = {"content": r["text"], "role": r["role"]}
                elif r["kind"] == "result":
                    line = {"content": r["text"], "id": r["call_id"], "role": "tool", "type": "tool_result"}
                    errors += ["no call"] * (not r["other"])
                else:
                    line = {"arguments": None, "id": r["call_id"], "name": r["name"], "role": "assistant", "type": "tool_call"}
                    errors += ["no result"] * (not r["other"]) + ["cyclic"] * r["cyclic"]
                    try:
                        line["arguments"] = json.loads(r["arguments"] if r["arguments"] is not None else "{}", parse_constant=_no_constant)
                        errors += violations(line["arguments"], schemas[r["name"]]) if r["name"] in schemas else ["unknown tool"]
                    except (ValueError, RecursionError):
                        line["arguments"] = r["arguments"]
                        errors.append("arguments: not JSON")
                errors += ["duplicate id"] * r["repeat"]
                out.append((r["conv_id"], r["position"], r["turn"], r["seq"], r["kind"], r["call_id"], r["linked"], not errors, errors, canonical(line)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 10
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "position", "turn", "seq", "kind", "call_id", "linked", "valid", "errors", "json"])

    needed = ["conv_id", "position", "turn", "seq", "kind", "role", "text", "call_id", "name", "arguments", "linked", "repeat", "cyclic", "other"]
    return placed.select(*needed).mapInArrow(run, "conv_id long, position long, turn long, seq int, kind string, call_id string, linked boolean, valid boolean, errors array<string>, json string")


#: The tool by which the query over plain conversations sees turns: a user's turn calls it, the assistant's next turn is the result; it refers to the call two turns before.
REPLY = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"after": {"type": "string"}, "prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Events of plain conversations (conv_id, turn, role, text).

    User turns are calls of `reply` that refer to the call two turns before, if
    there is one, so that a conversation is a chain; assistant turns are the
    results of the turn before. Rows without a turn are messages.
    """
    user, reply = (F.col("turn").isNotNull() & F.col("role").eqNullSafe(r) for r in ("user", "assistant"))
    as_json = lambda *c: F.to_json(F.struct(*c, F.col("text").alias("prompt"), F.col("turn").alias("turn")), {"ignoreNullFields": "false"})
    arguments = F.when(F.col("turn") > 1, as_json(F.concat(F.lit("$ref:turn-"), F.col("turn") - 2).alias("after"))).otherwise(as_json())
    return conversations.select(
        "conv_id", "turn", F.lit(0).alias("seq"), F.when(reply, "tool").otherwise(F.col("role")).alias("role"), F.when(~user, F.col("text")).alias("text"),
        F.when(user, F.concat(F.lit("turn-"), F.col("turn"))).when(reply, F.concat(F.lit("turn-"), F.col("turn") - 1)).alias("call_id"),
        F.when(user, "reply").alias("name"), F.when(user, arguments).alias("arguments"),
    )


#: The query over conversations in DuckDB's dialect.
ORACLE_SQL = r"""
WITH e AS (
  SELECT conv_id, turn, role, text, CASE WHEN turn IS NULL THEN 'message' WHEN role = 'user' THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN 'turn-' || turn WHEN 'assistant' THEN 'turn-' || (turn - 1) END AS call_id
  FROM conversations
), f AS (
  SELECT *, EXISTS (SELECT 1 FROM e o WHERE o.conv_id = e.conv_id AND o.call_id = e.call_id AND o.kind <> e.kind AND e.kind <> 'message' AND o.kind <> 'message') AS other FROM e
)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS position, turn, kind, call_id, other AS linked, kind = 'message' OR other AS valid,
  CASE WHEN kind = 'message' OR other THEN '' WHEN kind = 'call' THEN 'no result' ELSE 'no call' END AS errors,
  CASE kind WHEN 'message' THEN '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '"}'
    WHEN 'result' THEN '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"id":"' || call_id || '","role":"tool","type":"tool_result"}'
    ELSE '{"arguments":{' || CASE WHEN turn > 1 THEN '"after":"$ref:turn-' || (turn - 2) || '",' ELSE '' END || '"prompt":' || CAST(to_json(text) AS VARCHAR) || ',"turn":' || turn || '},"id":"' || call_id || '","name":"reply","role":"assistant","type":"tool_call"}' END AS json
FROM f
"""
