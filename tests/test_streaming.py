import datetime as dt

from pyspark.sql import functions as F

from checks.derived import unnumbered_calls
from checks.queries import ROOTS
from chatprep.operators.audit import audited_arguments, audit_log, error_history, session_metrics
from chatprep.operators.policy import screen_calls
from chatprep.streaming import audit as streams
from tests.helpers import rows

SF = "/root/testdata/sf0.001"


def arriving(spark, table):
    return spark.readStream.schema(table.schema).parquet


def test_closed_windows_equal_the_batch_form(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    cuts = events.approxQuantile("event_id", [0.5], 0)[0]
    source = str(tmp_path / "events")
    query_out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    # Two arrivals, the second after a restart from the same checkpoint.
    for arrival in (events.where(F.col("event_id") <= cuts), events.where(F.col("event_id") > cuts)):
        arrival.coalesce(1).write.mode("append").parquet(source)
        stream = streams.audit_stream_metrics(unnumbered_calls(arriving(spark, events)(source)))
        streams.write_stream(stream, query_out, progress).awaitTermination()
    last = events.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    batch = streams.audit_stream_metrics(unnumbered_calls(events))
    closed = batch.where(F.col("window_end") <= F.lit(last))
    assert rows(spark.read.parquet(query_out).select(*batch.columns)) == rows(closed)
    assert closed.count() > 100


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts TIMESTAMP, tool STRING, success BOOLEAN"
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    arrivals = [
        [("2024-01-01 00:30:00", "a", True), ("2024-01-01 05:00:00", "a", True)],
        [("2024-01-01 00:40:00", "a", False), ("2024-01-01 09:00:00", "a", True)],
    ]
    for arrival in arrivals:
        made = [(dt.datetime.fromisoformat(t), tool, ok) for t, tool, ok in arrival]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        stream = streams.audit_stream_metrics(spark.readStream.schema(schema).parquet(source))
        streams.write_stream(stream, out, progress).awaitTermination()
    got = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.n_calls, r.n_failures) for r in got] == [(0, 1, 0), (5, 1, 0)]


def test_policy_stream_equals_the_batch_form(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    events.write.parquet(source)
    stream = streams.policy_stream(unnumbered_calls(arriving(spark, events)(source)), ROOTS)
    streams.write_policy_stream(stream, out, str(tmp_path / "progress")).awaitTermination()
    got = spark.read.parquet(out)
    batch = screen_calls(unnumbered_calls(events), ROOTS)
    assert rows(got, "event_id", "allowed", "rule") == rows(batch, "event_id", "allowed", "rule")
    refused = spark.read.parquet(f"{out}/verdict=refused")
    assert refused.count() == batch.where("NOT allowed").count() > 0


def test_audit(spark):
    made = [
        (1, 1, 1, "2024-01-01 00:00:00", "a", '{"x": 1}', True, "fine"),
        (1, 1, 2, "2024-01-01 00:00:05", "a", '{"x":1}', False, ""),
        (1, 2, 3, "2024-01-01 00:01:00", "b", "{}", True, "r" * 300),
    ]
    schema = "session_id BIGINT, turn INT, call_no INT, ts STRING, tool STRING, arguments STRING, success BOOLEAN, result STRING"
    calls = spark.createDataFrame(made, schema).withColumn("ts", F.to_timestamp("ts"))
    log = audit_log(calls)
    got = log.orderBy("call_no").collect()
    assert got[0].args_hash == got[1].args_hash
    assert got[1].result_preview is None and len(got[2].result_preview) == 200
    usage = spark.createDataFrame(
        [(1, 0, 5, 2, 7), (1, 1, 9, 3, 19)],
        "conv_id BIGINT, turn BIGINT, input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT",
    )
    metrics = session_metrics(log, usage).first()
    assert (metrics.n_turns, metrics.n_calls, metrics.n_ok, metrics.n_errors) == (2, 3, 2, 1)
    assert metrics.elapsed_us == 60_000_000 and metrics.success_rate == 2 / 3
    assert (metrics.output_tokens, metrics.context_tokens, metrics.total_tokens) == (5, 12, 19)
    assert rows(error_history(log), "call_no") == [(2,)]


def test_audited_arguments(spark):
    calls = [
        ("read_file", '{"path": "a"}', '{"max_lines":1000,"path":"a"}'),
        ("read_file", '{"max_lines": 1000, "path": "a"}', '{"max_lines":1000,"path":"a"}'),
        ("read_file", '{"path": "a", "other": 1}', '{"other":1,"path":"a"}'),
        ("write_file", '{"path": "a", "content": "xyz"}', '{"append":false,"content_len":3,"path":"a"}'),
        ("run_shell", '{"command": "ls", "timeout": 900, "working_dir": "d"}', '{"command":"ls","timeout":120}'),
        ("run_shell", '{"command": "ls"}', '{"command":"ls","timeout":30}'),
        ("run_python", '{"code": "1+1"}', '{"code_len":3,"timeout":10}'),
        ("grep_search", '{"pattern": "x", "case_sensitive": true}', '{"path":".","pattern":"x"}'),
        ("no_tool", '{"b": 1, "a": 2}', '{"a":2,"b":1}'),
        ("read_file", "no json", None),
    ]
    df = spark.createDataFrame(calls, "tool STRING, arguments STRING, wanted STRING")
    for row in df.select("*", audited_arguments(F.col("tool"), F.col("arguments")).alias("got")).collect():
        assert row.got == row.wanted
