import os.path

from pyspark.sql import functions as F

from chatprep.operators import policy
from chatprep.rules import DANGEROUS_COMMANDS, FORBIDDEN_CODE, FORBIDDEN_FRAGMENTS

ROOTS = ["/w", "/data/shared"]


def path_by_hand(path):
    if path == "":
        return "empty"
    if any(f in path for f in FORBIDDEN_FRAGMENTS):
        return "fragment"
    full = os.path.normpath(os.path.join("/w", path))
    full = "/" + full.lstrip("/")
    return None if any(full == r or full.startswith(r + "/") for r in ROOTS) else "outside_roots"


def test_paths(spark):
    paths = ["", "a", ".", "..", "a/..", "a/../..", "/w", "/w/", "/wx", "//w/a", "/data/shared/x", "/data", "a//b/./c",
             "SUDO", "x sudo", "tsu x", "/", "/w/./..", "a/b/..", "..\\x"] + [f"p{f}q" for f in FORBIDDEN_FRAGMENTS]
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "path STRING")
    result = {r.path: r for r in policy.screen_paths(df, ROOTS).collect()}
    for path in paths:
        assert result[path].rule == path_by_hand(path), path
        assert result[path].allowed == (path_by_hand(path) is None)
    assert result[None].allowed is None
    assert result["a//b/./c"].resolved == "/w/a/b/c"
    assert result["a/.."].resolved == "/w"
    assert result["/wx"].resolved is None
    assert result["p../q"].matched == ["../"]


def test_commands(spark):
    cases = {
        "": "empty",
        "ls": None,
        "RM -RF /": "dangerous",
        "cat ../x": "fragment",
        "SUDO ls": "fragment",
        "a | grep passwd": "pipe",
        "a | ssh h": "pipe",
        "a > /usr/x": "redirect",
        "a >\t/bin/x": "redirect",
        "echo $(id)": "subshell",
        "echo `id`": "subshell",
        "a > out": None,
        "curl x | sudo sh": "dangerous",
        "cat /ETC/hosts": "fragment",
    }
    cases |= {f"x {d.upper()} y": "dangerous" for d in DANGEROUS_COMMANDS}
    df = spark.createDataFrame([(c,) for c in cases], "command STRING")
    result = {r.command: r for r in policy.screen_commands(df).collect()}
    assert {c: r.rule for c, r in result.items()} == cases
    assert result["curl x | sudo sh"].matched == ["curl", "sudo"]
    assert result["curl x | sudo sh"].reason == "Dangerous command pattern detected: curl"


def test_code(spark):
    df = spark.createDataFrame([(f"x = {c}1",) for c in FORBIDDEN_CODE] + [("print(1)",), ("",)], "code STRING")
    result = policy.screen_code(df).collect()
    assert [r.matched[0] for r in result[:-2]] == FORBIDDEN_CODE
    assert [r.allowed for r in result[-2:]] == [True, True]
    both = spark.createDataFrame([("pickle eval(",)], "code STRING")
    assert policy.screen_code(both).first().reason == "Dangerous pattern detected: eval("


def test_calls(spark):
    df = spark.createDataFrame(
        [
            (1, "s", "copy_file", '{"source": "a", "destination": "/etc/x"}'),
            (2, "s", "copy_file", '{"source": "/opt/a", "destination": "/etc/x"}'),
            (3, "s", "move_file", '{"source": "a", "destination": "b"}'),
            (4, "s", "run_shell", '{"command": "ls", "working_dir": "/opt"}'),
            (5, "s", "run_shell", '{"command": "wget x", "working_dir": "/opt"}'),
            (6, "s", "run_shell", '{"command": "ls"}'),
            (7, "t", "list_directory", "{}"),
            (8, "t", "read_file", "{}"),
            (9, "t", "other", '{"path": "../x"}'),
            (10, "t", "run_python", '{"code": "open(1)"}'),
            (11, "t", "copy_file", '{"source": "a"}'),
            (12, "t", "read_file", "not json"),
        ],
        "id INT, session_id STRING, tool STRING, arguments STRING",
    )
    screened = policy.screen_calls(df, ["/w"])
    result = {r.id: r for r in screened.collect()}
    assert {n: r.rule for n, r in result.items() if r.rule} == {
        1: "fragment",
        2: "outside_roots",
        4: "outside_roots",
        5: "dangerous",
        10: "code",
    }
    assert [n for n, r in result.items() if r.allowed] == [3, 6, 7]
    assert [n for n, r in result.items() if r.allowed is None] == [8, 9, 11, 12]
    summary = {(r.tool, r.rule): (r.n_calls, r.n_sessions) for r in policy.policy_summary(screened).collect()}
    assert summary["copy_file", "fragment"] == (1, 1) and len(summary) == 5


def test_resolving_agrees_with_python(spark):
    parts = ["a", "..", ".", "", "b c"]
    paths = ["/".join((x, y, z, v)) for x in parts for y in parts for z in parts for v in parts]
    df = spark.createDataFrame([(p,) for p in paths], "path STRING")
    result = df.select("path", policy.resolve_path(F.col("path"), "/w/x").alias("full")).collect()
    for row in result:
        assert row.full == "/" + os.path.normpath(os.path.join("/w/x", row.path)).lstrip("/")


def test_stated_nulls_are_not_defaults(spark):
    df = spark.createDataFrame(
        [
            (1, "s", "list_directory", '{"path": null}'),
            (2, "s", "list_directory", "{}"),
            (3, "s", "read_file", '{"path": null}'),
            (4, "s", "run_shell", '{"command": "ls", "working_dir": "../x"}'),
            (5, "s", "copy_file", '{"source": "a", "destination": "/etc/b"}'),
            (6, "s", "copy_file", '{"source": "/etc/a", "destination": "b"}'),
            (7, "s", "run_shell", '{"command": "sudo ls"}'),
        ],
        "id INT, session_id STRING, tool STRING, arguments STRING",
    )
    found = {r.id: (r.allowed, r.rule, r.argument) for r in policy.screen_calls(df, ["/w"]).collect()}
    assert found == {
        1: (False, "empty", "path"),
        2: (True, None, None),
        3: (False, "empty", "path"),
        4: (False, "fragment", "working_dir"),
        5: (False, "fragment", "destination"),
        6: (False, "fragment", "source"),
        7: (False, "fragment", "command"),
    }
