"""Safety rules over logged calls: what would be refused, and why."""

from __future__ import annotations

import operator
import posixpath
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep import rules as fixed
from chatprep.functions.frames import with_once
from chatprep.operators.links import resolve_links, with_resolved
from chatprep.rules import (
    DANGEROUS_COMMANDS,
    FORBIDDEN_CODE,
    FORBIDDEN_FRAGMENTS,
    PIPE_WORDS,
    SUBSHELL_MARKS,
    SYSTEM_REDIRECT,
)

PATH_TOOLS = ["read_file", "write_file", "delete_file", "create_directory"]
FOLDER_TOOLS = ["list_directory", "search_files", "grep_search"]
TRANSFER_TOOLS = ["copy_file", "move_file"]


# An empty, one-dot or two-dot segment, other than the one before a first slash.
REMOVABLE = r"//|(^|/)\.{1,2}(/|$)|/$|^$"

# Arguments that a check reads.
SCREENED = "path STRING, source STRING, destination STRING, command STRING, working_dir STRING, code STRING"

Rules = list[tuple[Column, str, Column]]


def _hits(text: Column, patterns: list[str]) -> Column:
    """The patterns that a text holds, in the order of the list."""
    return F.filter(F.array(*[F.lit(p) for p in patterns]), lambda p: F.contains(text, p))


def _holds_any(text: Column, patterns: list[str]) -> Column:
    return reduce(operator.or_, [F.contains(text, F.lit(p)) for p in patterns])


def _first(rules: Rules) -> tuple[Column, Column]:
    """Name and message of the first rule that holds; null where none does."""
    rule, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for holds, name, message in reversed(rules):
        rule = F.when(holds, F.lit(name)).otherwise(rule)
        reason = F.when(holds, message).otherwise(reason)
    return rule, reason


def resolve_path(path: Column, cwd: str) -> Column:
    """Absolute path without ``.`` and ``..``; links on disk are not followed."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), path))
    names = F.filter(F.split(full, "/"), lambda name: (name != "") & (name != "."))
    kept = F.aggregate(
        names,
        F.array().cast("array<string>"),
        lambda done, name: F.when(
            name == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        ).otherwise(F.concat(done, F.array(name))),
    )
    walked = F.concat(F.lit("/"), F.array_join(kept, "/"))
    # Most paths have no segment to remove and skip the walk.
    return F.when(path == ".", F.lit(cwd)).when(F.rlike(path, F.lit(REMOVABLE)), walked).otherwise(full)


def _path_rules(
    path: Column, hits: Column, resolved: Column, allowed_roots: list[str], loop: Column | None = None
) -> Rules:
    """Empty, a forbidden fragment, a circle of links, outside the allowed roots."""
    circle = []
    if loop is not None:
        circle = [(loop.isNotNull(), "link_loop", F.concat(F.lit(fixed.PATH_LOOP), loop, F.lit("'")))]
    inside = F.lit(False)
    for root in map(posixpath.normpath, allowed_roots):
        inside |= (resolved == root) | resolved.startswith(root.rstrip("/") + "/")
    fragment = F.concat(F.lit(fixed.PATH_FRAGMENT), F.get(hits, F.lit(0)))
    return [
        (path == "", "empty", F.lit(fixed.EMPTY_PATH)),
        (path.isNotNull() & (F.size(hits) > 0), "fragment", fragment),
        (F.contains(path, F.lit("\0")), "invalid", F.lit(fixed.PATH_NULL_BYTE)),
        *circle,
        (~inside, "outside_roots", F.lit(f"{fixed.PATH_OUTSIDE}{allowed_roots}")),
    ]


def _command_rules(command: Column, dangerous: Column, fragments: Column) -> Rules:
    """Rules over a shell command, in the order in which they are tried."""
    found = F.concat(F.lit(fixed.COMMAND_DANGEROUS), F.get(dangerous, F.lit(0)))
    fragment = F.concat(F.lit(fixed.COMMAND_FRAGMENT), F.get(fragments, F.lit(0)))
    piped = F.contains(command, F.lit("|")) & _holds_any(command, PIPE_WORDS)
    redirect = F.rlike(command, F.lit("(?U)" + SYSTEM_REDIRECT))
    return [
        (command == "", "empty", F.lit(fixed.EMPTY_COMMAND)),
        (F.size(dangerous) > 0, "dangerous", found),
        (command.isNotNull() & (F.size(fragments) > 0), "fragment", fragment),
        (piped, "pipe", F.lit(fixed.COMMAND_PIPE)),
        (redirect, "redirect", F.lit(fixed.COMMAND_REDIRECT)),
        (_holds_any(command, SUBSHELL_MARKS), "subshell", F.lit(fixed.COMMAND_SUBSHELL)),
    ]


def _code_rules(hits: Column) -> Rules:
    """The code holds a forbidden text."""
    reason = F.concat(F.lit(fixed.CODE_DANGEROUS), F.get(hits, F.lit(0)))
    return [(F.size(hits) > 0, "code", reason)]


def _judged(
    df: DataFrame, columns: list[str], text: Column, rules: Rules, matched: Column, argument: Column | None = None
) -> DataFrame:
    rule, reason = _first(rules)
    there = text.isNotNull()
    return df.withColumns({"_rule": rule, "_reason": reason}).select(
        *columns,
        F.when(there, F.col("_rule").isNull()).alias("allowed"),
        F.when(there, F.col("_rule")).alias("rule"),
        F.when(there, F.col("_reason")).alias("reason"),
        F.when(there, matched).alias("matched"),
        *([] if argument is None else [F.when(there, argument).alias("argument")]),
        *[c for c in df.columns if c == "_resolved"],
    )


def _real_roots(links: DataFrame, roots: list[str], cwd: str) -> list[str]:
    """The allowed roots, resolved through links as paths are; one that is in a circle allows nothing."""
    spark = links.sparkSession
    found = resolve_links(spark.createDataFrame([(root,) for root in roots], "path string"), links, cwd)
    # As many rows as there are roots.
    return sorted(row.resolved for row in found.collect() if row.resolved is not None)


def screen_paths(
    df: DataFrame,
    allowed_roots: list[str],
    cwd: str | None = None,
    path_col: str = "path",
    links: DataFrame | None = None,
) -> DataFrame:
    """Add the verdict on a path column and the resolved path of allowed ones.

    ``links`` (``path``, ``target``) is a listing of the links on disk: paths and roots
    are then followed through them, see ``resolve_links``, and a link that leads out of
    the roots is refused. Without it paths are resolved by name.
    """
    cwd = posixpath.normpath(cwd or allowed_roots[0])
    path = F.col(path_col)
    roots, loop = allowed_roots, None
    if links is None:
        facts = with_once(df, _hits=_hits(path, FORBIDDEN_FRAGMENTS), _resolved=resolve_path(path, cwd))
    else:
        roots, loop = _real_roots(links, allowed_roots, cwd), F.col("_resolved_loop")
        followed = with_resolved(df, {"_resolved": path_col}, links, cwd)
        facts = with_once(followed, _hits=_hits(path, FORBIDDEN_FRAGMENTS))
    rules = _path_rules(path, F.col("_hits"), F.col("_resolved"), roots, loop)
    rules[-1] = (*rules[-1][:2], F.lit(f"{fixed.PATH_OUTSIDE}{allowed_roots}"))
    judged = _judged(facts, df.columns, path, rules, F.col("_hits"))
    return judged.withColumn("resolved", F.when(F.col("allowed"), F.col("_resolved"))).drop("_resolved")


def screen_commands(df: DataFrame, command_col: str = "command") -> DataFrame:
    """Add the verdict on a column of shell commands."""
    command = F.col(command_col)
    lowered = F.lower(command)
    facts = with_once(df, _dangerous=_hits(lowered, DANGEROUS_COMMANDS), _hits=_hits(lowered, FORBIDDEN_FRAGMENTS))
    rules = _command_rules(command, F.col("_dangerous"), F.col("_hits"))
    return _judged(facts, df.columns, command, rules, F.concat("_dangerous", "_hits"))


def screen_code(df: DataFrame, code_col: str = "code") -> DataFrame:
    """Add the verdict on a column of Python code."""
    facts = with_once(df, _hits=_hits(F.col(code_col), FORBIDDEN_CODE))
    return _judged(facts, df.columns, F.col(code_col), _code_rules(F.col("_hits")), F.col("_hits"))


def screen_calls(calls: DataFrame, allowed_roots: list[str], cwd: str | None = None) -> DataFrame:
    """Add the first refusal of each call, by the checks its tool makes, and its ``argument``.

    Copying and moving check the source, then the destination; the shell checks the
    command, then the folder. A call of an unknown tool, or without an argument to
    check, is not screened: ``allowed`` is null.
    """
    cwd = posixpath.normpath(cwd or allowed_roots[0])
    tool = F.col("tool")
    names = ["_" + field.split()[0] for field in SCREENED.split(", ")]
    given = F.inline(F.array(F.from_json("arguments", SCREENED))).alias(*names)
    # A null that the call states is an empty text; a default is for what it leaves out.
    stated = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    transfer = tool.isin(TRANSFER_TOOLS)
    here = F.lit(".")
    stated_texts = {
        name: F.when(F.array_contains(stated, name.removeprefix("_")), F.coalesce(name, F.lit(""))) for name in names
    }
    asked = calls.select("*", given).withColumns(stated_texts).select(
        *calls.columns,
        F.when(tool.isin(PATH_TOOLS), F.col("_path"))
        .when(tool.isin(FOLDER_TOOLS), F.coalesce("_path", here))
        .when(transfer, F.col("_source"))
        .alias("_path"),
        F.when(transfer, F.col("_destination"))
        .when(tool == "run_shell", F.coalesce("_working_dir", here))
        .alias("_second"),
        F.when(tool == "run_shell", F.col("_command")).alias("_command"),
        F.when(tool == "run_python", F.col("_code")).alias("_code"),
    )
    lowered = F.lower("_command")
    # A call has a path or a command, so one search for fragments serves both.
    facts = with_once(
        asked,
        _fragments=_hits(F.coalesce("_path", lowered), FORBIDDEN_FRAGMENTS),
        _resolved=resolve_path(F.col("_path"), cwd),
        _dangerous=_hits(lowered, DANGEROUS_COMMANDS),
        _code_hits=_hits(F.col("_code"), FORBIDDEN_CODE),
        _second_hits=_hits(F.col("_second"), FORBIDDEN_FRAGMENTS),
        _second_resolved=resolve_path(F.col("_second"), cwd),
    )
    by_argument = [
        (
            F.when(transfer, "source").otherwise("path"),
            _path_rules(F.col("_path"), F.col("_fragments"), F.col("_resolved"), allowed_roots),
        ),
        (F.lit("command"), _command_rules(F.col("_command"), F.col("_dangerous"), F.col("_fragments"))),
        (F.lit("code"), _code_rules(F.col("_code_hits"))),
        (
            F.when(transfer, "destination").otherwise("working_dir"),
            _path_rules(F.col("_second"), F.col("_second_hits"), F.col("_second_resolved"), allowed_roots),
        ),
    ]
    rules = [rule for _, own in by_argument for rule in own]
    argument = F.coalesce(
        *[F.when(reduce(operator.or_, [F.coalesce(r[0], F.lit(False)) for r in own]), name) for name, own in by_argument]
    )
    asked_for = F.coalesce("_path", "_command", "_code")
    complete = F.when(~transfer | F.col("_second").isNotNull(), asked_for)
    matched = F.concat("_dangerous", "_fragments", "_code_hits", "_second_hits")
    return _judged(facts, calls.columns, complete, rules, matched, argument).drop("_resolved")


def policy_summary(screened: DataFrame) -> DataFrame:
    """Refused calls by tool and rule."""
    return (
        screened.where(~F.col("allowed"))
        .groupBy("tool", "rule")
        .agg(F.count("*").alias("n_calls"), F.count_distinct("session_id").alias("n_sessions"))
    )
