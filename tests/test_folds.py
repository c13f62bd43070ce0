"""Braces, JSON texts and links in column functions, against plain loops and Python itself."""

import json
import random
import re

import pytest
from tests.helpers import plan, rows
from tests.plain import outermost_objects, random_tree, real_path
from pyspark.sql import functions as F

from chatprep.functions.python_json import python_args_hash, python_json
from chatprep.functions.tool_json import balanced_candidates, without_trailing_commas
from chatprep.operators import audit, calls, policy
from chatprep.operators.links import resolve_links

OBJECTS = [
    '{"a": {"b": 1}}',
    'He said "hi { there" {"a":1}',
    '{ "x } y\\" { "z" } \n }',
    '{"open": {"in": 1} {"two": 2}',
    '{"s": "a, }", "t": [1, 2, ], }',
    '{"s": "unclosed, ]\n , } }',
    '}{"a":"}"}{',
    '{\\"a\\"}',
    '{"a\\\\": "b\\\\"}',
    '{"k": "' + "x\\n" * 3000 + '", }',
    '{"é": "漢",  }',
    "no braces",
    "",
    "{" * 300 + "}" * 299,
]


def _table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(4)


def test_balanced_objects(spark):
    pick = random.Random(3)
    atoms = ["{", "}", '"', "\\", "\n", ",", "]", " ", "a", '{"a": 1}', ", }", '\\"', " ", "\x1f"]
    texts = [*OBJECTS, *("".join(pick.choices(atoms, k=pick.randint(1, 14))) for _ in range(1500))]
    found = _table(spark, texts).select("k", balanced_candidates(F.col("text")).alias("c"))
    assert "ArrowEvalPython" not in plan(found) and "BatchEvalPython" not in plan(found)
    got = {r.k: r.c for r in found.collect()}
    wrong = [(t, got[k], outermost_objects(t)) for k, t in enumerate(texts) if got[k] != outermost_objects(t)]
    assert not wrong, wrong[:3]


def test_balanced_of_null(spark):
    found = spark.createDataFrame([(None,)], "text string").select(balanced_candidates(F.col("text")).alias("c"))
    assert found.first().c is None


def test_commas_in_strings_stay(spark):
    table = _table(spark, ['[1, ]', '{"a": ", }", }', '", ]'])
    got = table.select("k", without_trailing_commas(F.col("text")).alias("t"))
    assert rows(got) == [(0, "[1]"), (1, '{"a": ", }"}'), (2, '"]')]


def test_balanced_calls_without_python(spark):
    turns = spark.createDataFrame([(1, 1, 'x {"name": "a", "arguments": {"p": "}"}} {"name": "b"}')], "conv_id int, turn int, text string")
    found = calls.extract_tool_calls(turns, "balanced")
    assert rows(found, "position", "tool", "arguments") == [(0, "a", '{"p":"}"}'), (1, "b", "{}")]
    assert turns.select(calls.count_calls(F.col("text"), "balanced").alias("n")).first().n == 2


def python(text):
    try:
        return json.dumps(json.loads(text), sort_keys=True)
    except ValueError:
        return None


JSON_TEXTS = [
    '{"b": 1, "a": [1, 2.0, 1e5, -0, -0.0, 1e16, 1e-5, 123456789012345678901234567890, 0.1, 1E400, NaN, -Infinity]}',
    '{"é":"ü\\n\\u0041\\/\\ud83d\\ude00😀\\u007f","A":"\\\\"}',
    '{"a":1,"a":{"z":[{"y":1,"x":{"b":[],"a":{}}}],"c":"d"}}',
    '[1.5e300,1e22,1e23,9007199254740993.0,5e-324,1.7976931348623157e308,6.516258245586579e+18]',
    *['{"a":1,}', '{"a" 1}', "[1 2]", "[1,,2]", '{"a":1}x', '{"a":1} {"b":2}', '{"a":"b\\x"}', "{'a':1}", '{"a":"l\nb"}'],
    *["tru", "01", "-", "1.", ".5", "+1", "1e", "{1:2}", "[1]]", '{"a":[}', "", " ", '"open', "﻿{}", "null", " [ ] "],
    "9" * 4301,
]


def test_json_as_python_writes_it(spark):
    pick = random.Random(5)

    def value(depth=0):
        kind = pick.random()
        if depth > 3 or kind < 0.3:
            return pick.choice([1, -5, 2.5, 1e-7, 1e20, True, None, 'é"\\', "z\n", "", pick.uniform(-1, 1) * 10 ** pick.randint(-320, 300)])
        if kind < 0.65:
            return [value(depth + 1) for _ in range(pick.randint(0, 3))]
        return {pick.choice("abcdé") + str(pick.randint(0, 3)): value(depth + 1) for _ in range(pick.randint(0, 4))}

    texts = [*JSON_TEXTS, *(json.dumps(value(), ensure_ascii=k % 2 == 0, indent=k % 3 or None) for k in range(80))]
    atoms = ["{", "}", "[", "]", ",", ":", '"a"', '"b"', "1", "2.5", " ", '"', '\\"', "\\n", "null"]
    texts += ["".join(pick.choices(atoms, k=pick.randint(1, 9))) for _ in range(150)]
    found = {r.k: r.j for r in _table(spark, texts).select("k", python_json(F.col("text")).alias("j")).collect()}
    assert {k: python(t) for k, t in enumerate(texts)} == found


def test_text_and_hash_are_made_at_once(spark):
    """Bytes that are no UTF-8, deep texts, halves of pairs; one pass in Python for both columns."""
    texts = ['{"a": "\\ud800"}', '{"a": "\\uD83D\\uDE00"}', '{"a": "\\\\ud800"}', "[" * 3000 + "]" * 3000, "[" * 10**5]
    table = _table(spark, texts).unionByName(_table(spark, ["x"]).select((F.col("k") + 9).alias("k"), F.expr("cast(X'22FF22' as string)").alias("text")))
    both = table.select("k", python_json(F.col("text")).alias("j"), python_args_hash(F.col("text")).alias("h"))
    got = {r.k: (r.j, r.h is None) for r in both.collect()}
    assert got == {
        0: (None, True), 1: ('{"a": "\\ud83d\\ude00"}', False), 2: ('{"a": "\\\\ud800"}', False),
        3: (texts[3], False), 4: (None, True), 9: ('"\\ufffd"', False),
    }
    assert re.findall(r"ArrowEvalPython \[([^\]]*)\]", plan(both))[0].count("_python_json") == 1


def test_hashes_are_pythons(spark):
    """Digests of texts that Python wrote."""
    table = _table(spark, ['{"path": "a.txt", "max_lines": 1000}', '{"path":"é"}', "{}", None, "{no}", '"\\ud800"'])
    got = dict(rows(table.select("k", python_args_hash(F.col("text")).alias("h"))))
    assert got == {0: "9ed3008bfbe37b96", 1: "4df12debf5fde73f", 2: "44136fa355b3678a", 3: None, 4: None, 5: None}


def test_audit_hash_of_a_python_log(spark):
    call = [("s", 1, 1, None, "read_file", '{"path": "é.txt"}', True, "")]
    log = spark.createDataFrame(call, "session_id string, turn int, call_no int, ts timestamp, tool string, arguments string, success boolean, result string")
    own, compat = (audit.audit_log(log, compat=c).first().args_hash for c in (False, True))
    import hashlib

    assert compat == hashlib.sha256(json.dumps({"path": "é.txt", "max_lines": 1000}, sort_keys=True).encode()).hexdigest()[:16]
    assert own != compat


@pytest.mark.parametrize("seed", range(3))
def test_links_as_name_by_name(spark, seed):
    links, paths = random_tree(seed)
    table = spark.createDataFrame([*links.items(), (None, "/x"), ("/y", None)], "path string, target string")
    asked = spark.createDataFrame([(p,) for p in [*paths, *paths[:3], None]], "path string")
    got = {r.path: (r.resolved, r.loop) for r in resolve_links(asked, table, "/a/b").collect()}
    want = {}
    for path in paths:
        try:
            want[path] = (real_path(path, links, "/a/b"), None)
        except LookupError as circle:
            want[path] = (None, circle.args[0])
    assert got == want


def test_links_as_on_disk(spark, tmp_path):
    """Chains, a circle, a link out of the root and dots behind a link, as the file system has them."""
    root = tmp_path / "root"
    (root / "d/e").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    made = {"one": "two", "two": "d", "d/up": "../d/e", "away": "../out", "c1": "c2", "c2": "c1", "abs": str(root / "d")}
    for name, target in made.items():
        (root / name).symlink_to(target)
    links = spark.createDataFrame([(str(root / k), v) for k, v in made.items()], "path string, target string")
    names = ["one/e", "one/up/x", "d/up/../f", "away/x", "away/../root/d", "c1/x", "abs/e", "none/y", "one"]
    asked = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: r for r in policy.screen_paths(asked, [str(root)], links=links).collect()}
    for name in names:
        if name.startswith("c1"):
            assert got[name].rule == "link_loop" and got[name].reason.endswith(f"loop from '{root}/c1'")
            continue
        if "../" in name:
            assert got[name].rule == "fragment"
            continue
        real = (root / name).resolve()
        inside = real.is_relative_to(root.resolve())
        assert got[name].allowed == inside and got[name].rule == (None if inside else "outside_roots")
        assert got[name].resolved == (str(real) if inside else None)
    followed = {r.path: r.resolved for r in resolve_links(asked, links, str(root)).collect()}
    assert followed == {n: None if n.startswith("c1") else str((root / n).resolve()) for n in names}


def test_roots_are_followed_too(spark):
    links = spark.createDataFrame([("/w", "/srv/w"), ("/srv/w/in", "../x")], "path string, target string")
    asked = spark.createDataFrame([("a",), ("in/b",), ("/srv/w/c",), ("",), (None,), ("../a",)], "path string")
    got = {r.path: (r.allowed, r.rule, r.resolved) for r in policy.screen_paths(asked, ["/w"], links=links).collect()}
    assert got == {
        "a": (True, None, "/srv/w/a"), "in/b": (False, "outside_roots", None), "/srv/w/c": (True, None, "/srv/w/c"),
        "": (False, "empty", None), None: (None, None, None), "../a": (False, "fragment", None),
    }
