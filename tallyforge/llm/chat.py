"""Chat formatting with linked tool calls.

Calls and results meet in a hash join by (conversation, call id). The first result of a call
counts, in turn order; a call without one and a result without a call are kept as such. Calls of
a conversation are put in a topological order: a call may name calls it depends on, and stands
after them; its level is found by joins that double the steps they take along a chain, so a
conversation of any length is never gathered. Calls on a cycle, or behind one, or behind an unknown id, have no level.
Arguments are validated against a schema per tool, and every message is written as canonical JSON:
keys sorted, no spaces, no escapes but those JSON needs.

Defined results: null and unparsable arguments are invalid with reason ``json``; so are those that
nest deeper than the parser follows, hold a number that is not finite (NaN, Infinity, 1e999) or half
of a surrogate pair, none of which canonical JSON can carry. Their line has them as the text they
came as. Texts of any length are read whole; other columns are ignored. A tool without a
schema is invalid with reason ``tool``. Repeated ids of one conversation are one call, the first
by turn and arguments. Rows with a null conversation or id link with nothing; ``format_calls`` with
``unlinked`` keeps each as a row of its own with reason ``id``, and leaves them out by default.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage, with_package

KINDS = {
    "string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None),
}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"not a JSON number: {text[:40]}")
    return value


def parsed(arguments: str | None):
    """Value of a JSON text; ValueError if it is none, or one that canonical JSON cannot carry."""
    if arguments is None:
        raise ValueError("no arguments")
    try:
        value = json.loads(arguments, parse_constant=_finite, parse_float=_finite)
        canonical([[value]]).encode()  # a line nests it deeper; half a surrogate pair has no UTF-8
    except RecursionError:
        raise ValueError("nested too deep") from None
    return value


def violation(value, schema: dict, path: str = "$") -> str | None:
    """First violation of ``type``, ``enum``, ``minimum``, ``maximum``, ``minLength``,
    ``maxLength``, ``required``, ``additionalProperties``, ``properties`` and ``items``."""
    kind = schema.get("type")
    if kind and (not isinstance(value, KINDS[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return f"{path}: {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{path}: range"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"{path}: length"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}.{name}: required"
        for name in sorted(value):
            if name in known:
                if found := violation(value[name], known[name], f"{path}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := violation(x, schema["items"], f"{path}[{i}]"):
                return found
    return None


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (conv_id, call_id, turn, tool, arguments, needs) with the turn and text of their
    result (conv_id, call_id, turn, text); results without a call have a null ``turn``."""
    own = Window.partitionBy("conv_id", "call_id")
    usable = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first_call = (
        calls.where(usable)
        .select("conv_id", "call_id", "turn", "tool", "arguments", "needs")
        .withColumn("_tf_rank", F.row_number().over(own.orderBy("turn", "arguments", "tool")))
        .where("_tf_rank = 1")
        .drop("_tf_rank")
    )
    first_result = (
        results.where(usable)
        .select("conv_id", "call_id", F.col("turn").alias("result_turn"), F.col("text").alias("result"))
        .withColumn("_tf_rank", F.row_number().over(own.orderBy("result_turn", "result")))
        .where("_tf_rank = 1")
        .drop("_tf_rank")
    )
    return first_call.join(first_result, ["conv_id", "call_id"], "full")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that need nothing, else one more than the largest
    level among the needed calls; calls without a level are left out.

    An open call keeps the level that its settled needs ask for and, of the others, how many steps
    above them it stands. In a round, needs on calls settled last are settled, calls without open
    needs get their level, and a call with one open need on a call that has one open need itself
    moves on to that one, adding the steps. So a chain takes as many rounds as the logarithm of its
    length; only where several open needs meet again and again are there more. A round that settles
    nothing is the last: what is left hangs on a cycle or an unknown id.
    """
    need = F.transform(F.array_distinct("needs"), lambda n: F.struct(n.alias("need"), F.lit(1).alias("steps")))
    none = F.array().cast("array<struct<need:string,steps:int>>")
    nodes = calls.select("conv_id", "call_id", F.lit(0).alias("level"), F.coalesce(need, none).alias("open"))
    nodes = stage(nodes, "calls")
    fresh = stage(nodes.where(F.size("open") == 0).select("conv_id", "call_id", "level"), "level")
    rest, done = nodes.where(F.size("open") > 0), fresh
    while not fresh.isEmpty():
        met = fresh.select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("found"))
        edges = rest.select("conv_id", "call_id", "level", F.explode("open").alias("e")).select("conv_id", "call_id", "level", "e.need", "e.steps")
        settled = edges.join(met, ["conv_id", "need"], "left").groupBy("conv_id", "call_id").agg(
            F.greatest(F.max("level"), F.max(F.col("found") + F.col("steps"))).alias("level"),
            F.collect_list(F.when(F.col("found").isNull(), F.struct("need", "steps"))).alias("open"),
        )
        settled = stage(settled, "settled")
        fresh = settled.where(F.size("open") == 0).select("conv_id", "call_id", "level")
        done = done.unionByName(fresh)
        one = settled.where(F.size("open") == 1).select(
            "conv_id", F.col("call_id").alias("via"), F.col("level").alias("via_level"), F.col("open")[0].alias("onward")
        )
        rest = settled.where(F.size("open") > 0).withColumn("via", F.when(F.size("open") == 1, F.col("open")[0]["need"]))
        moved = F.struct(F.col("onward.need").alias("need"), (F.col("onward.steps") + F.col("open")[0]["steps"]).alias("steps"))
        rest = rest.join(one, ["conv_id", "via"], "left").select(
            "conv_id",
            "call_id",
            F.when(F.col("onward").isNull(), F.col("level"))
            .otherwise(F.greatest("level", F.col("via_level") + F.col("open")[0]["steps"]))
            .alias("level"),
            F.when(F.col("onward").isNull(), F.col("open")).otherwise(F.array(moved)).alias("open"),
        )
        rest = stage(rest, "open")
    return done


CHECKED = "conv_id bigint, call_id string, turn bigint, tool string, level int, result_turn bigint, valid boolean, reason string, line string"


def _checked(schemas: dict[str, dict]):
    names = [c.split()[0] for c in CHECKED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string()]

    def one(row: dict) -> tuple:
        reason, arguments = None, row["arguments"]
        if row["conv_id"] is None or row["call_id"] is None:
            reason = "id"
        elif row["turn"] is None:
            reason = "call"
        else:
            try:
                arguments = parsed(row["arguments"])
            except ValueError:
                reason = "json"
            else:
                schema = schemas.get(row["tool"])
                reason = "tool" if schema is None else violation(arguments, schema)
        if reason is None and row["level"] is None:
            reason = "order"
        line = canonical(
            {
                "call": row["call_id"], "tool": row["tool"], "arguments": arguments,
                "result": row["result"], "valid": reason is None,
            }
        )
        return (row["conv_id"], row["call_id"], row["turn"], row["tool"], row["level"], row["result_turn"], reason is None, reason, line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(one, batch.to_pylist()))) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def unlinked_rows(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls and results with a null conversation or id, in the columns of ``linked`` with a null level."""
    null = F.col("conv_id").isNull() | F.col("call_id").isNull()
    rows = calls.where(null).select("conv_id", "call_id", "turn", "tool", "arguments")
    answers = results.where(null).select("conv_id", "call_id", F.col("turn").alias("result_turn"), F.col("text").alias("result"))
    return rows.unionByName(answers, allowMissingColumns=True).withColumn("level", F.lit(None).cast("int"))


def format_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], unlinked: bool = False) -> DataFrame:
    """One row a call or orphan result, with its level, validity, reason and canonical line; with
    ``unlinked`` also one row a call or result whose conversation or id is null."""
    joined = stage(linked(calls, results), "linked-calls")
    placed = joined.join(levels(joined.where("turn is not null")), ["conv_id", "call_id"], "left")
    if unlinked:
        placed = placed.drop("needs").unionByName(unlinked_rows(calls, results))
    rows = placed.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "call_id", F.col("turn").cast("bigint").alias("turn"), "tool", "arguments",
        "level", F.col("result_turn").cast("bigint").alias("result_turn"), "result",
    )
    return with_package(rows).mapInArrow(_checked(schemas), CHECKED)
