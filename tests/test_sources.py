import json
import os
import random
import re
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatprep.operators import search
from chatprep.operators.running import running_totals
from chatprep.plans import corpus_search
from chatprep.session import new_path
from chatprep.sources import corpus, pairs, store, tables
from chatprep.sources.store import Entry, located, open_store
from chatprep.sources.walk import walk
from checks import queries
from tests.helpers import plan, rows

PAIR = ("instruction", "response", "input")


def test_json_lists_follow_the_text_not_the_keys(spark, tmp_path, monkeypatch):
    """Conversations far apart and rows that come twice: files by their bytes, all rows in them."""
    turns = [(k * 10_001, t, ("user", "assistant")[t % 2], f"{k} {t} é") for k in range(60) for t in range(4)]
    turns += [(70, t % 2, ("user", "assistant")[t % 2], "again") for t in range(8)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    want = rows(queries.src_jsonl(spark, str(tmp_path)))
    for limit, files in ((queries.LIST_BYTES, (1, 1)), (2000, (5, 20))):
        monkeypatch.setattr(queries, "LIST_BYTES", limit)
        got = queries.src_json(spark, str(tmp_path))
        assert rows(got) == want and len(want) == 136
        assert files[0] <= len(got.inputFiles()) <= files[1]


def test_csv_reads_as_pandas_does(spark, tmp_path):
    path = tmp_path / "pairs.CSV"
    path.write_text(
        'instruction,response,input\n"two\nlines","say ""hi""",NA\nnull,x,\n none ,None,"NA"\n" NaN ",n/a,5\nüñ,é,""\n',
        encoding="utf-8",
    )
    want = pd.read_csv(path, dtype=str)
    got = pairs.read_pairs(spark, str(path)).select(*PAIR)
    assert rows(got) == sorted(
        (tuple(None if pd.isna(v) else v for v in row) for row in want[list(PAIR)].itertuples(index=False)), key=repr
    )


def test_tsv_keeps_two_fields_and_marks_the_rest(spark, tmp_path):
    path = tmp_path / "pairs.txt"
    path.write_text('q1\ta1\nq2\nq3\ta3\tmore\n"q\n4"\tNA\n')
    got = pairs.read_pairs(spark, str(path))
    assert rows(got) == [("q1", "a1", False), ("q2", None, False), ("q3", "a3", True), ("q\n4", None, False)]
    assert pairs.malformed_count(got).first()[0] == 1
    named = pairs.read_pairs(spark, str(path), "question", "answer")
    assert named.columns[:2] == ["question", "answer"]


def test_json_list_and_object(spark, tmp_path):
    many, one = tmp_path / "many.json", tmp_path / "one.json"
    many.write_text(json.dumps([{"instruction": "a\nb", "response": "c"}, {"instruction": "d", "response": 5}], indent=1))
    one.write_text(json.dumps({"instruction": "é", "response": None, "extra": {"x": 1}}, ensure_ascii=False))
    assert rows(pairs.read_pairs(spark, str(many)), "instruction", "response") == [("a\nb", "c"), ("d", "5")]
    assert rows(pairs.read_pairs(spark, str(one)), "instruction", "response") == [("é", None)]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "pairs.jsonl"
    lines = [{"instruction": "a"}, {"instruction": "b", "response": "é\n", "id": 3}]
    path.write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    got = pairs.read_pairs(spark, str(path), input_col="input", keep=("id",))
    assert rows(got, "id", "instruction", "response", "input") == [("3", "b", "é\n", None), (None, "a", None, None)]
    assert pairs.read_jsonl(spark, str(path)).columns == ["id", "instruction", "response"]


def test_missing_columns_and_extensions_are_errors(spark, tmp_path):
    for name, text in (("a.csv", "instruction,other\nx,y\n"), ("a.jsonl", '{"instruction": "x", "other": "y"}\n')):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError, match="'response' not found, available: \\['instruction', 'other'\\]"):
            pairs.read_pairs(spark, str(tmp_path / name))
    with pytest.raises(ValueError, match="unsupported extension"):
        pairs.read_pairs(spark, str(tmp_path / "a.parquet"))


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "é"), (2, "test", None), (3, "train", "x")], "id INT, split STRING, t STRING")
    path = str(tmp_path / "deep" / "er" / "table")
    tables.write_table(df, path)
    tables.write_table(df, path, append=True)
    assert spark.read.parquet(path).count() == 6
    tables.write_table(df, path)
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "plain").write_text("x")
    with pytest.raises(ValueError, match="not a table"):
        tables.write_table(df, str(tmp_path / "plain"))
    assert (tmp_path / "plain").read_text() == "x"
    tables.land_raw(df, str(tmp_path / "landed"))
    lines = [line for part in (tmp_path / "landed").glob("part-*") for line in part.read_text("utf-8").splitlines()]
    assert sorted(lines) == ['{"id":1,"t":"é"}', '{"id":3,"t":"x"}']


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = new_path(spark, "x"), new_path(spark, "x")
    assert first != second
    if base:
        assert first.startswith(base.rstrip("/"))


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.py": "import os\nThe end\n",
        "b.txt": "the start\r\nno\rthe last",
        "sub/c.py": "x = 1\n" * 4,
        "sub/deep/d.md": "\n",
        "sub/deep/e f.py": "the  \n\n" + "the " * 60,
        "sudo-tools/x.py": "the hidden\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.bin").write_bytes(b"ok \xff\xfe the\n")
    return tmp_path


def test_corpus(spark, folder):
    texts, refused = corpus.read_corpus(spark, str(folder), max_bytes=24, max_lines=3)
    got = {r.path: r for r in texts.collect()}
    assert rows(refused) == [("sub/deep/e f.py", 247, "too large")]
    assert got["sub/c.py"].text == "x = 1\nx = 1\nx = 1\n\n... (truncated after 3 lines)"
    assert got["sub/c.py"].truncated and got["sub/c.py"].n_lines == 3
    assert (got["a.py"].n_lines, got["a.py"].truncated) == (2, False)
    assert got["b.txt"].text == "the start\nno\nthe last" and got["b.txt"].n_lines == 3
    assert got["sub/deep/d.md"].n_lines == 1
    assert got["bad.bin"].text == b"ok \xff\xfe the\n".decode("utf-8", "replace")
    one, _ = corpus.read_corpus(spark, str(folder / "a.py"))
    assert rows(one, "path", "n_lines") == [("a.py", 2)]


def test_listing(spark, folder):
    files = corpus.corpus_files(spark, str(folder))
    listed = search.list_files(files.drop("content"))
    assert "content" not in plan(listed.select("path", "length")).split("ReadSchema")[-1]
    assert rows(listed, "path", "kind") == [
        ("a.py", "file"), ("b.txt", "file"), ("bad.bin", "file"), ("sub", "folder"), ("sudo-tools", "folder")
    ]
    deep = search.list_files(files, recursive=True, pattern="*.py")
    assert rows(deep, "path") == [("a.py",), ("sub/c.py",), ("sub/deep/e f.py",)]
    assert rows(search.list_files(files, pattern="[!a]*.*"), "path") == [("b.txt",), ("bad.bin",)]
    assert deep.where("path = 'a.py'").first().entry == "a.py (18 bytes)"
    report = corpus_search.listing(spark, str(folder), recursive=True, pattern="*", report=True)
    assert report.count() == 6 and report.first().n_more == 0


def test_all_files_are_listed(spark, tmp_path):
    names = ["a.py", "__init__.py", ".env", "empty.py", "_priv/x.py", ".git/y", "d/z"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.py" else "the end\n")
    files = corpus.corpus_files(spark, str(tmp_path))
    assert rows(files, "path") == sorted((name,) for name in names)
    got = {r.path for r in corpus_search.search_folder(spark, str(tmp_path), "the").collect()}
    assert got == set(names) - {"empty.py"}
    texts, refused = corpus.read_corpus(spark, str(tmp_path))
    assert {r.path: r.n_lines for r in texts.collect()} == {name: int(name != "empty.py") for name in names}
    assert refused.isEmpty() and corpus.unread_files(spark, str(tmp_path)).isEmpty()
    assert rows(corpus.corpus_files(spark, str(tmp_path / ".git")), "path") == [("y",)]
    assert rows(corpus.corpus_files(spark, str(tmp_path / ".env")), "path", "length") == [(".env", 8)]
    with pytest.raises(FileNotFoundError):
        corpus.corpus_files(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("at_once", [1, 3, 10_000])
def test_walk_level_by_level(spark, tmp_path, at_once):
    """Every name once, empty folders too, whatever a task lists at once; a circle of links ends."""
    for folder in ("a/b/c/d", "a/empty", ".h/i", "wide"):
        (tmp_path / folder).mkdir(parents=True)
    for name in ("a/x", "a/b/c/d/y z", ".h/i/.j", *(f"wide/{k}" for k in range(30))):
        (tmp_path / name).write_text("1")
    (tmp_path / "a/b/back").symlink_to(tmp_path / "a")
    (tmp_path / "a/to_file").symlink_to(tmp_path / "a/x")
    (tmp_path / "a/broken").symlink_to("nowhere")
    found = rows(walk(spark, str(tmp_path), at_once), "path", "kind", "length")
    want = {("a/b/back", "folder", None)}
    for folder, folders, files in os.walk(tmp_path):
        for names, kind in ((folders, "folder"), (files, "file")):
            for path in (Path(folder, name) for name in names):
                if path.exists():
                    want.add((str(path.relative_to(tmp_path)), kind, path.stat().st_size if kind == "file" else None))
    assert found == sorted(want, key=repr)
    folders = corpus_search.found(spark, str(tmp_path), "**").where("kind = 'folder'")
    assert ("a/empty", "a/empty/") in rows(folders, "path", "entry")


def test_unread_files_are_told(spark, tmp_path):
    """What vanishes between listing and opening, as what may not be opened, has a reason and stops nothing."""
    (tmp_path / "here").write_text("x")
    entries = spark.createDataFrame([("here", "file", 1), ("gone", "file", 1)], "path string, kind string, length long")
    store = located(spark, str(tmp_path))
    read = corpus._read(corpus._ranges(entries, 5), store, 5).collect()
    assert {r.path: (r.content, r.reason is None) for r in read} == {"here": (b"x", True), "gone": (None, False)}
    assert list(store.entries("nowhere")) == [Entry("nowhere", "unread", reason="no such file or directory")]


def _python_lines(path, pattern):
    with open(path, encoding="utf-8", errors="ignore") as file:
        return [(n, line.rstrip()) for n, line in enumerate(file, 1) if re.search(pattern, line, re.IGNORECASE)]


@pytest.mark.parametrize("size", [1, 7, 1000, 1 << 20])
def test_ranges_of_bytes(spark, tmp_path, size):
    """Lines and their numbers don't depend on where a file is cut."""
    texts = {
        "lines": "".join(f"line {k} the é\n" for k in range(200)),
        "crlf": "the\r\nend\rthe\r\n" * 20,
        "long": "the " * 500 + "\n" + "x" * 3000 + "the\nthe",
        "open": "a\n\n\nthe",
        "blank": "\n" * 50 + "the",
        "empty": "",
        "one": "the",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bytes").write_bytes(b"the\xff\xfe\n\xc3the\n" * 9)
    got = corpus_search.search_folder(spark, str(tmp_path), "the", range_bytes=size)
    want = [(p.name, n, line) for p in tmp_path.iterdir() for n, line in _python_lines(p, "the")]
    assert rows(got) == sorted(want, key=repr)
    first = corpus_search.search_folder(spark, str(tmp_path), "the", range_bytes=size, line_chars=3).collect()
    assert len(first) == len(want) and {len(r.line) for r in first} == {3}


def test_runs_of_ranges(spark, tmp_path, monkeypatch):
    """Runs are cut in their tasks: what is joined has a row for each run of a long file, not for each range."""
    joined = []

    def seen(df, *how):
        joined.append(df)
        return running_totals(df, *how)

    monkeypatch.setattr(corpus, "running_totals", seen)
    texts = ["line the é\n" * 400, "the\r\nend\rthe\r\n" * 40, "a\n\n" + "the " * 90 + "\nthe", "x" * 300 + "the\nthe", "", "the\n" * 20]
    for k, text in enumerate(texts):
        (tmp_path / f"f{k}").write_bytes(text.encode())
    (tmp_path / "bytes").write_bytes(b"the\xff\xfe\n\xc3the\r\xff\n\xff" * 30)
    want = sorted(((p.name, n, line) for p in tmp_path.iterdir() for n, line in _python_lines(p, "the")), key=repr)
    sizes = [p.stat().st_size for p in tmp_path.iterdir()]
    # Runs of the whole file, of 64 bytes, and of ranges that don't fit them.
    for limit in (corpus.RANGE_BYTES, 64, 2):
        monkeypatch.setattr(corpus, "RANGE_BYTES", limit)
        assert rows(corpus_search.search_folder(spark, str(tmp_path), "the", range_bytes=3)) == want
        runs = [-(-size // (3 * max(1, limit // 3))) for size in sizes]
        assert joined.pop().count() == sum(n for n in runs if n > 1)
        parts = corpus.text_parts(spark, str(tmp_path), range_bytes=3)
        assert parts.count() == parts.select("path", "part").distinct().count() == sum(max(1, -(-size // 3)) for size in sizes)


@pytest.mark.parametrize("step", [1, 5, 1 << 20])
def test_pieces_however_a_file_is_read(spark, tmp_path, monkeypatch, step):
    """Ranges in a row, from any start, have the lines that begin in them."""
    monkeypatch.setattr(store, "STEP_BYTES", step)
    pick = random.Random(step)
    for k in range(40):
        data = bytes(pick.choices(b"ab\n", weights=[5, 5, pick.choice([0, 1, 9])], k=pick.randint(0, 60)))
        (tmp_path / f"f{k}").write_bytes(data)
        starts = [0, *(n + 1 for n, char in enumerate(data) if char == 10)]
        size = pick.randint(1, 9)
        first = size * pick.randint(0, 3)
        end = min(first + size * pick.randint(1, 5), len(data))
        if first >= len(data) > 0:
            continue
        with open_store(located(spark, str(tmp_path))) as opener:
            got = list(opener.pieces(f"f{k}", first, end, size, len(data)))
        want = []
        for at in range(first, max(end, first + 1), size):
            begun = [s for s in starts if at <= s < min(at + size, end)]
            after = [s for s in starts if s > begun[-1]] if begun else []
            want.append(data[begun[0] : after[0] if after else len(data)] if begun else b"")
        assert got == want


def test_a_range_is_read_by_itself(spark, tmp_path):
    """No read is longer than its range, but for the end of its last line."""
    (tmp_path / "f").write_bytes(b"x" * 100 + b"\n" + b"y" * 10 + b"\nz")
    with open_store(located(spark, str(tmp_path))) as opener:
        got = [opener.lines("f", k, min(k + 8, 113), 113) for k in range(0, 113, 8)]
    assert [len(piece) for piece in got] == [101] + [0] * 11 + [11, 0, 1] and b"".join(got) == (tmp_path / "f").read_bytes()


def test_files_too_large_for_a_row(spark, tmp_path):
    (tmp_path / "big").write_text("the\n" * 100)
    (tmp_path / "small").write_text("the\n")
    files = corpus.corpus_files(spark, str(tmp_path), max_bytes=10)
    assert {r.path: (r.content, r.reason) for r in files.collect()} == {
        "big": (None, "too large for one row"), "small": (b"the\n", None)
    }
    _, refused = corpus.limit_texts(files.withColumn("text", F.col("content").cast("string")))
    assert rows(refused) == [("big", 400, "too large for one row")]
    assert corpus_search.search_folder(spark, str(tmp_path), "the").count() == 101


def test_large_and_long_texts_are_read_whole(spark, tmp_path):
    lines = 10_300
    (tmp_path / "big.txt").write_text(("x" * 1023 + "\n") * lines + "needle\n")
    assert corpus_search.search_folder(spark, str(tmp_path), "needle").first().line_num == lines + 1
    texts, refused = corpus.read_corpus(spark, str(tmp_path))
    assert texts.first().n_lines == lines + 1 and not texts.first().truncated and refused.isEmpty()


def test_bytes_that_are_no_text_are_left_out_of_a_search(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"foo\xffbar\n")
    assert corpus_search.search_folder(spark, str(tmp_path), "foobar").count() == 1


def test_broken_json_lines_are_set_apart(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"instruction": "a", "response": "b"}\n{"instruction": "c\n\n[1]\n{"response": "d"}\n')
    good, bad = pairs.read_jsonl_checked(spark, str(tmp_path / "p.jsonl"), "instruction STRING, response STRING")
    assert rows(good) == [("a", "b"), (None, "d")]
    assert {r.reason for r in bad.collect()} == {"no JSON object"} and bad.count() == 2
    assert pairs.read_pairs(spark, str(tmp_path / "p.jsonl")).count() == 2


@pytest.mark.parametrize("pattern", ["*", "*.py", "**/*.py", "sub/*", "*/*", "sub/**/*.md", "**/deep", "s?b/c.*", "**/[cd].*"])
def test_globs_agree_with_pathlib(spark, folder, pattern):
    files = corpus.corpus_files(spark, str(folder)).drop("content")
    want = sorted((str(p.relative_to(folder)),) for p in folder.glob(pattern))
    assert rows(search.search_files(files, pattern), "path") == want


def test_found_is_capped(spark):
    files = spark.range(120).select(F.format_string("d/%03d.py", "id").alias("path"), F.lit(1).cast("long").alias("length"))
    report = search.cap_found(search.search_files(files, "d/*.py"))
    got = report.orderBy("path").collect()
    assert len(got) == 50 and got[0].path == "d/000.py" and {r.n_more for r in got} == {70}


def test_grep(spark, folder):
    got = corpus_search.search_folder(spark, str(folder), r"\bthe\b")
    assert rows(got) == [
        ("a.py", 2, "The end"),
        ("b.txt", 1, "the start"),
        ("b.txt", 3, "the last"),
        ("bad.bin", 1, "ok  the"),
        ("sub/deep/e f.py", 1, "the"),
        ("sub/deep/e f.py", 3, ("the " * 60).rstrip()),
    ]
    exact = corpus_search.search_folder(spark, str(folder), "The", case_sensitive=True)
    assert rows(exact, "path") == [("a.py",)]
    at_end = corpus_search.search_folder(spark, str(folder), r"end\n", include="*.py")
    assert rows(at_end, "path") == [("a.py",)]
    report = corpus_search.search_folder(spark, str(folder), "the", report=True)
    assert report.count() == 6 and max(len(r.line) for r in report.collect()) == 150
    with pytest.raises(ValueError, match="Invalid regex pattern"):
        corpus_search.search_folder(spark, str(folder), "(open")


@pytest.mark.parametrize(
    "pattern",
    [r"(?P<w>\w+) (?P=w)", r"end\Z", r"^x", r"x$", r"é\b", r"\(\?P<", r"\\Z", r"[^\W\d]+\d", r"STRASSE|ÉTÉ", r"a.b", r"\s\Z"],
)
def test_patterns_read_as_in_python(spark, pattern):
    lines = ["the the", "the then", "end", "x", "ax", "été", "étés", "(?P<", "a\\Z", "é1", "a\u2028b", "a\x85b", "x "]
    text = "\n".join(lines) + "\n"
    files = spark.createDataFrame([("f", text)], "path STRING, text STRING")
    want = [(n,) for n, line in enumerate(lines, 1) if re.search(pattern, line + "\n", re.IGNORECASE)]
    assert rows(search.grep(files, pattern), "line_num") == sorted(want, key=repr)


def test_grep_caps(spark):
    files = spark.range(1200).select(F.format_string("%04d.txt", "id").alias("path"), F.lit("x\nx\nno\n").alias("text"))
    everything = search.grep(files, "x")
    assert everything.count() == 2400
    first = search.grep_report(files, "x").collect()
    assert len(first) == 50 and tuple(first[2]) == ("0001.txt", 1, "x", 2350)
    long = spark.createDataFrame([("f", "y" * 400)], "path STRING, text STRING")
    assert [len(search.grep(long, "y", line_chars=n).first().line) for n in (150, 7, None)] == [150, 7, 400]
    summary = search.grep_summary(files, everything).first()
    assert tuple(summary) == (2400, 1200, 1200)
    none = search.grep_summary(files, search.grep(files, "absent")).first()
    assert tuple(none) == (0, 0, 1200)


def test_a_shared_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace

    from chatprep.session import shared_dir

    def session(master, given, warehouse=False):
        settings = SimpleNamespace(contains=lambda name: warehouse)
        values = {"spark.sql.warehouse.dir": "file:/w/"} | given
        context = SimpleNamespace(master=master, getConf=lambda: settings)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, other="": values.get(name, other)), sparkContext=context)

    assert shared_dir(session("yarn", {"spark.checkpoint.dir": "hdfs://x/c/"})) == "hdfs://x/c"
    assert shared_dir(session("yarn", {}, warehouse=True)) == "file:/w/work"
    assert shared_dir(session("local[8]", {})) == "file:/w/work"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master, {}))


def test_work_is_dropped(spark, tmp_path):
    from chatprep import session

    path = session.new_path(spark, "t")
    spark.range(3).write.parquet(path)
    session.drop_work(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path).count()
