"""Tool calls: found in answers, checked against the catalogue."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.functions.tool_json import argument_map, balanced_candidates, candidates, is_call, parsed
from chatprep.rules import HIDDEN_IN_SAFE_MODE, TIMEOUT_BOUNDS, TOOLS, UNKNOWN_TOOL

CATALOGUE_SCHEMA = (
    "array<struct<name:string,description:string,"
    "params:array<struct<name:string,type:string,default_value:string>>,required:array<string>>>"
)


def tool_catalogue(spark: SparkSession, safe_mode: bool = False) -> DataFrame:
    """The catalogue as a table; safe mode leaves out the shell tool.

    Eleven fixed rows inside the plan, so Spark knows the size and broadcasts them
    by its own threshold; a larger catalogue of the user's joins by shuffle.
    """
    rows = [
        {
            "name": name,
            "description": description,
            "params": [
                {"name": p, "type": kind, "default_value": None if default is None else _plain(default)}
                for p, kind, default in params
            ],
            "required": [p for p, _, default in params if default is None],
        }
        for name, (description, params) in TOOLS.items()
    ]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), CATALOGUE_SCHEMA)))
    return table.where(F.col("name") != HIDDEN_IN_SAFE_MODE) if safe_mode else table


def _plain(default: str) -> str:
    value = json.loads(default)
    return value if isinstance(value, str) else default


def _found(responses: DataFrame, mode: str) -> DataFrame:
    find = {"compat": candidates, "balanced": balanced_candidates}[mode]
    parsed_calls = F.transform(find(F.col("text")), lambda c: F.struct(c.alias("raw"), parsed(c).alias("value")))
    return responses.select(
        "conv_id", "turn", F.posexplode(parsed_calls).alias("position", "found")
    ).select("conv_id", "turn", "position", "found.raw", "found.value")


def call_fields(found: DataFrame) -> DataFrame:
    """Name and arguments of a parsed call.

    An absent name is empty and absent arguments are ``{}``. A null that the call
    states stays: the name is null, the arguments are the JSON text ``null``.
    """
    given = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    return found.select(
        "conv_id",
        "turn",
        "position",
        F.coalesce("value.call.name", F.when(~F.array_contains(given, "name"), F.lit(""))).alias("tool"),
        F.coalesce(
            "value.call.arguments", F.when(F.array_contains(given, "arguments"), F.lit("null")), F.lit("{}")
        ).alias("arguments"),
    )


def extract_tool_calls(responses: DataFrame, mode: str = "compat") -> DataFrame:
    """Every call in the answers, with its position among the answer's candidates.

    ``compat`` takes the shortest text in braces, ``balanced`` the whole object.
    """
    return call_fields(_found(responses, mode).where(is_call(F.col("value"), F.col("raw"))))


def failed_tool_calls(responses: DataFrame, mode: str = "compat") -> DataFrame:
    """Candidates that are not one JSON object."""
    return _found(responses, mode).where(~is_call(F.col("value"), F.col("raw"))).drop("value")


def count_calls(text: Column, mode: str = "compat") -> Column:
    """Number of calls in one answer."""
    find = {"compat": candidates, "balanced": balanced_candidates}[mode]
    return F.size(F.filter(find(text), lambda c: is_call(parsed(c), c)))


def resolve_calls(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls with the catalogue's verdict on their name."""
    names = tools.select(F.col("name").alias("tool"), F.lit(True).alias("known"))
    message = F.concat(F.lit(UNKNOWN_TOOL), F.coalesce("tool", F.lit("None")))
    return (
        calls.join(names, "tool", "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
        .withColumn("message", F.when(~F.col("known"), message))
    )


def unknown_calls(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls of tools that the catalogue does not have."""
    return calls.join(tools.select(F.col("name").alias("tool")), "tool", "left_anti")


def unsafe_calls(calls: DataFrame, tools: DataFrame, safe_tools: DataFrame) -> DataFrame:
    """Calls of tools that exist but that safe mode hides."""
    known = tools.select(F.col("name").alias("tool"))
    shown = safe_tools.select(F.col("name").alias("tool"))
    return calls.join(known, "tool", "left_semi").join(shown, "tool", "left_anti")


def check_arguments(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls of known tools with their missing and unexpected argument names.

    Arguments that are no JSON object have ``is_object`` false and never fit.
    """
    spec = tools.select(
        F.col("name").alias("tool"), "required", F.transform("params", lambda p: p["name"]).alias("accepted")
    )
    given = F.json_object_keys("arguments")
    names = F.coalesce(given, F.array().cast("array<string>"))
    return (
        calls.join(spec, "tool", "inner")
        .withColumns(
            {
                "is_object": given.isNotNull(),
                "missing": F.array_except("required", names),
                "unexpected": F.array_except(names, "accepted"),
            }
        )
        .drop("required", "accepted")
        .withColumn(
            "valid", F.col("is_object") & (F.size("missing") == 0) & (F.size("unexpected") == 0)
        )
    )


def effective_arguments(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """One row per call and parameter: the value given, else the default, as text.

    A parameter that is neither given nor has a default comes out null. Timeouts
    are held between their bounds.
    """
    params = tools.select(F.col("name").alias("tool"), "params")
    keys = [c for c in calls.columns if c != "arguments"]
    rows = calls.withColumn("given", argument_map(F.col("arguments"))).join(params, "tool", "inner")
    rows = rows.select(*keys, "given", F.inline("params").alias("argument", "type", "default_value"))
    given = F.coalesce(F.map_contains_key("given", F.col("argument")), F.lit(False))
    value = F.when(given, F.col("given")[F.col("argument")]).otherwise(F.col("default_value"))
    return rows.select(
        *keys,
        "argument",
        F.when(F.col("argument") == "timeout", bounded_timeout(F.col("tool"), value)).otherwise(value).alias("value"),
        (~given).alias("is_default"),
    )


def bounded_timeout(tool: Column, value: Column) -> Column:
    """A timeout held between the bounds of its tool, as text."""
    seconds = value.try_cast("long")
    held = value
    for name, (low, high) in TIMEOUT_BOUNDS.items():
        inside = F.least(F.greatest(seconds, F.lit(low)), F.lit(high)).cast("string")
        held = F.when(tool == name, F.when(seconds.isNotNull(), inside)).otherwise(held)
    return held


def effective_timeout(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Seconds that each call of a tool with a timeout may take."""
    timed = tools.withColumn("params", F.filter("params", lambda p: p["name"] == "timeout"))
    rows = effective_arguments(calls, timed).drop("argument")
    return rows.withColumn("timeout", F.col("value").try_cast("long")).drop("value")
