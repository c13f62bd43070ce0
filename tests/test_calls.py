import json

import pytest
from pyspark.sql import functions as F

from chatprep.functions.tool_json import args_hash
from chatprep.operators import calls
from tests.helpers import plan, rows

ANSWER = "conv_id BIGINT, turn BIGINT, text STRING"
TEXTS = [
    '```json\n{"name": "a", "arguments": {"k": 1}}\n```',
    'I call {"name": "a", "arguments": {"k": 1}}',
    'Listing. {"name": "list"} done',
    "All done.",
    '```\n{"a": 1}, {"b": 2}\n```',
    '{"name": "a", "note": "x, ]"}',
    '{"name": "a", "name": "b"}',
    '{"name": "n", "arguments": {"v": NaN}}',
    "{'name': 'x'}",
    "",
    '```json\n{"name": "a", "list": [1, 2,], }\n``` and {"name": "z"}',
    '[{"name": "a"}, {name: "b"}]',
    '{"a": 1}} {"name": "after"}',
    "{ { {",
    '```json\n{"name": "a"\n} trailing ```',
    '```json\n{"name": "run_shell"},"end":"end of call","x":{}\n```',
    '```json\n{"name": "run_shell"},"x":{}\n```',
    '```json\n{"name": "a"},"call":{"name":"run_shell"}\n```',
    'odd {"name": null}',
    'odd {"name": "q", "arguments": null}',
]


# What each text holds, written out: a call, or None for a candidate that is no JSON object.
EXPECTED = [
    [{"name": "a", "arguments": {"k": 1}}],
    [None],
    [{"name": "list"}],
    [],
    [None],
    [{"name": "a", "note": "x]"}],
    [{"name": "b"}],
    [None],
    [None],
    [],
    [{"name": "a", "list": [1, 2]}, {"name": "z"}],
    [{"name": "a"}, None],
    [{"a": 1}, {"name": "after"}],
    [],
    [{"name": "a"}],
    [None],
    [None],
    [None],
    [{"name": None}],
    [{"name": "q", "arguments": None}],
]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.createDataFrame([(1, n, t) for n, t in enumerate(TEXTS)], ANSWER)


def test_compat_calls_agree_with_python(spark, answers):
    got = {(r.turn, r.position): r for r in calls.extract_tool_calls(answers).collect()}
    failed = {(r.turn, r.position) for r in calls.failed_tool_calls(answers).collect()}
    for turn, text in enumerate(TEXTS):
        for position, value in enumerate(EXPECTED[turn]):
            if value is None:
                assert (turn, position) in failed
                continue
            row = got.pop((turn, position))
            assert row.tool == value.get("name", "")
            if "NaN" not in text:
                assert json.loads(row.arguments) == value.get("arguments", {})
    assert not got


def test_count_calls(spark, answers):
    counted = {r.turn: r.n for r in answers.select("turn", calls.count_calls(F.col("text")).alias("n")).collect()}
    assert counted == {n: sum(v is not None for v in found) for n, found in enumerate(EXPECTED)}


def test_balanced_calls(spark):
    texts = [
        'I call {"name": "a", "arguments": {"k": {"deep": [1, {"x": 2}]}}} now',
        'say "{ {"name": "q"} and {"name": "r", "arguments": {"s": "a } b { c"}}',
        '{"name": "c", "note": "x, ]", "list": [1, 2, ],}',
        '{ unclosed {"name": "in"}',
        None,
        'quote " then {"name": "d", "arguments": {"t": "say \\"hi\\" }"}}',
    ]
    df = spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], ANSWER)
    found = calls.extract_tool_calls(df.repartition(3), "balanced")
    assert [(t, n) for t, n in rows(found, "turn", "tool")] == [
        (0, "a"),
        (1, "q"),
        (1, "r"),
        (2, "c"),
        (3, "in"),
        (5, "d"),
    ]
    arguments = {r.tool: r.arguments for r in found.collect()}
    assert json.loads(arguments["a"]) == {"k": {"deep": [1, {"x": 2}]}}
    assert json.loads(arguments["d"]) == {"t": 'say "hi" }'}


def test_balanced_scan_is_linear(spark):
    text = "{" * 200_000 + '{"name": "x"}'
    df = spark.createDataFrame([(1, 1, text)], ANSWER)
    assert rows(calls.extract_tool_calls(df, "balanced"), "tool") == [("x",)]


CALL = "id INT, tool STRING, arguments STRING"


def test_catalogue(spark):
    tools = calls.tool_catalogue(spark)
    assert tools.count() == 11
    assert calls.tool_catalogue(spark, safe_mode=True).where("name = 'run_shell'").count() == 0
    required = {r.name: r.required for r in tools.collect()}
    assert required["write_file"] == ["path", "content"] and required["list_directory"] == []


def test_checks_against_the_catalogue(spark):
    df = spark.createDataFrame(
        [
            (1, "read_file", '{"path": "a"}'),
            (2, "read_file", "{}"),
            (3, "read_file", '{"path": "a", "depth": 1}'),
            (4, "nothing", "{}"),
            (5, "run_shell", '{"command": "ls", "timeout": 500}'),
            (6, "run_shell", '{"command": "ls", "timeout": -3}'),
            (7, "run_python", '{"code": "1", "timeout": 90}'),
            (8, "run_python", '{"code": "1"}'),
            (9, "list_directory", "[1]"),
            (10, "run_shell", '{"command": "ls", "timeout": "soon"}'),
        ],
        CALL,
    )
    tools = calls.tool_catalogue(spark)
    resolved = calls.resolve_calls(df, tools)
    assert rows(resolved.where("not known"), "id", "message") == [(4, "❌ Unknown tool: nothing")]
    assert "BroadcastHashJoin" in plan(resolved)
    assert rows(calls.unknown_calls(df, tools), "id") == [(4,)]
    hidden = calls.unsafe_calls(df, tools, calls.tool_catalogue(spark, safe_mode=True))
    assert rows(hidden, "id") == [(10,), (5,), (6,)]
    checked = {r.id: r for r in calls.check_arguments(df, tools).collect()}
    assert checked[2].missing == ["path"] and checked[3].unexpected == ["depth"]
    assert [n for n, r in checked.items() if r.valid] == [1, 5, 6, 7, 8, 10]
    assert not checked[9].is_object
    timeouts = rows(calls.effective_timeout(df, tools), "id", "timeout")
    assert timeouts == [(10, None), (5, 120), (6, 1), (7, 30), (8, 10)]
    effective = {(r.id, r.argument): (r.value, r.is_default) for r in calls.effective_arguments(df, tools).collect()}
    assert effective[1, "max_lines"] == ("1000", True)
    assert effective[1, "path"] == ("a", False)
    assert effective[2, "path"] == (None, True)
    assert effective[9, "path"] == (".", True)


def test_args_hash_ignores_key_order(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"d": 2, "c": 3}}',), ('{"a":{"c":3,"d":2},"b":1}',), ("no",)], "a STRING")
    first, second, broken = [r[0] for r in df.select(args_hash(F.col("a"))).collect()]
    assert first == second and len(first) == 16 and broken is None
