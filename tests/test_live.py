"""Keyed state and several sinks: streams against their batch forms, after restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from chatprep.operators import usage
from chatprep.streaming import sessions
from chatprep.streaming.sessions import STATE_STORE, live_sessions
from chatprep.streaming.sinks import read_sink, write_sinks

CALLS = "session_id long, call_no long, ts timestamp, success boolean, tokens long"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def state_store(spark):
    # Few partitions: each has a store of its own.
    settings = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.shuffle.partitions": "2"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def _arrive(spark, rows, source):
    spark.createDataFrame(rows, CALLS).coalesce(1).write.mode("append").parquet(source)


def _run(spark, tmp_path, source):
    stream = live_sessions(spark.readStream.schema(CALLS).parquet(source), "1 hour", max_total=200)
    query = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "progress")).start(str(tmp_path / "out")).awaitTermination()


def test_live_sessions_equal_the_batch_form(spark, tmp_path, state_store):
    """Three arrivals out of order, a restart before each, and rows that come too late."""
    pick = random.Random(1)
    calls = []
    for session in range(6):
        at = START
        for n in range(1, 25):
            at += dt.timedelta(seconds=pick.randint(0, 90))
            calls.append((session, n, at, pick.random() < 0.6, pick.randint(0, 20)))
    cut = [START + dt.timedelta(minutes=m) for m in (8, 16)]
    arrivals = [[c for c in calls if c[2] < cut[0]], [c for c in calls if cut[0] <= c[2] < cut[1]], [c for c in calls if c[2] >= cut[1]]]
    # Within the watermark any order will do.
    moved = [c for c in arrivals[0] if pick.random() < 0.3]
    arrivals[0] = [c for c in arrivals[0] if c not in moved]
    arrivals[1] += moved
    source = str(tmp_path / "in")
    for arrival in arrivals:
        pick.shuffle(arrival)
        _arrive(spark, arrival, source)
        _run(spark, tmp_path, source)
    # The end of time lets all calls out; what comes for times before it is late.
    _arrive(spark, [(99, 1, START + dt.timedelta(days=2), True, 0)], source)
    _run(spark, tmp_path, source)
    _arrive(spark, [(0, 500, START, False, 1000), (99, 2, START + dt.timedelta(days=4), True, 0)], source)
    _run(spark, tmp_path, source)

    found = spark.read.parquet(str(tmp_path / "out"))
    table = spark.createDataFrame(calls, CALLS)
    runs = usage.failure_streaks(table)
    last = table.groupBy("session_id").agg(F.max("call_no").alias("end"))
    # A streak ends with a success; one at the end of a session stays open.
    closed = runs.join(last, "session_id").where("last_call < end").select("session_id", "first_call", "last_call", "length")
    streaks = found.where("kind = 'streak'").select("session_id", "first_call", "last_call", "length")
    assert sorted(map(tuple, streaks.collect())) == sorted(map(tuple, closed.collect())) and streaks.count() > 10
    whole = {r.session_id: r for r in table.groupBy("session_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("success")).alias("errors"), F.sum("tokens").alias("tokens"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("us")).collect()}
    metrics = found.where("kind = 'metrics' AND session_id < 99")
    ends = {r.session_id: r for r in metrics.collect() if r.n_calls == whole[r.session_id].n}
    assert ends.keys() == whole.keys() and metrics.agg(F.max("n_calls")).first()[0] == 24
    for k, row in ends.items():
        assert (row.n_errors, row.total_tokens, row.elapsed_us) == (whole[k].errors, whole[k].tokens, whole[k].us)
    breaches = {r.session_id: r.first_call for r in found.where("kind = 'breach'").collect()}
    for session in range(6):
        total, first = 0, None
        for _, n, _, _, tokens in (c for c in calls if c[0] == session):
            total += tokens
            first = first or (n if total > 200 else None)
        assert breaches.get(session) == first
    assert len(breaches) > 1


class _State:
    """Stands for a session's state and counts the messages to it."""

    def __init__(self):
        self.items, self.one, self.timers, self.n, self.ms = [], None, set(), 0, 0

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        state = self

        class Value:
            def get(self):
                return state.one

            def update(self, value):
                state.one, state.n = value, state.n + 1

        return Value()

    def get(self):
        self.n += 1
        return iter(self.items)

    def appendValue(self, value):
        self.items, self.n = [*self.items, value], self.n + 1

    def put(self, values):
        self.items, self.n = values, self.n + 1

    def clear(self):
        self.items, self.n = [], self.n + 1

    def registerTimer(self, ms):
        self.timers.add(ms)
        self.n += 1

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_messages_to_the_state_do_not_grow_with_calls():
    """Calls are kept many in a value and come out at one timer, in order, the last of a place, up to the watermark."""
    pick, state = random.Random(3), _State()
    calls = [Row(us=us, call_no=k % 7, success=pick.random() < 0.5, tokens=k % 9) for k, us in enumerate(pick.choices(range(40_000_000), k=10_000))]
    calls += [Row(us=c.us, call_no=c.call_no, success=not c.success, tokens=20) for c in calls[:50]]
    session = sessions._sessions(500)
    session.init(state)
    list(session.handleInputRows((1,), iter(calls[:6000]), state))
    list(session.handleInputRows((1,), iter(calls[6000:]), state))
    got = []
    for state.ms in (10_000, 30_000, 50_000):
        # The timers of both arrivals go off at one watermark.
        for _ in range(2):
            got += [tuple(row) for row in session.handleExpiredTimer((1,), state, state)]
    assert state.n < 30 and not state.items
    last = {(c.us, c.call_no): c for c in calls}
    want, n, errors, total, first, run, breached = [], 0, 0, 0, min(last)[0], [], False
    order = [last[place] for place in sorted(last)]
    for k, c in enumerate(order):
        n, errors, total, elapsed = n + 1, errors + (not c.success), total + c.tokens, c.us - first
        if not c.success:
            run.append(c.call_no)
        elif run:
            want.append((1, "streak", run[0], run[-1], len(run), None, None, None, None))
            run = []
        if total > 500 and not breached:
            breached = True
            want.append((1, "breach", c.call_no, c.call_no, 1, n, errors, total, elapsed))
        if k + 1 == len(order) or order[k + 1].us // 1000 != c.us // 1000:
            want.append((1, "metrics", None, None, len(run), n, errors, total, elapsed))
    assert got == want and len(want) > 9000


ROWS = "id long, ok boolean"


def _sinks(spark, tmp_path):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sinks = {"all": F.lit(True), "bad": ~F.col("ok")}
    return write_sinks(stream, sinks, str(tmp_path / "out"), str(tmp_path / "progress"))


def _put(spark, tmp_path, ids):
    spark.createDataFrame([(k, k % 3 != 0) for k in ids], ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def _ids(spark, tmp_path, sink):
    return sorted(r.id for r in read_sink(spark, str(tmp_path / "out" / sink), ROWS).collect())


def test_a_repeated_batch_writes_nothing_twice(spark, tmp_path):
    """The second sink fails after the first one was written; the batch is repeated."""
    _put(spark, tmp_path, range(10))
    _sinks(spark, tmp_path).awaitTermination()
    _put(spark, tmp_path, range(10, 20))
    # A file where the sink's folder was stops its next batch.
    (tmp_path / "out/bad").rename(tmp_path / "aside")
    (tmp_path / "out/bad").write_text("in the way")
    with pytest.raises(Exception):
        _sinks(spark, tmp_path).awaitTermination()
    assert _ids(spark, tmp_path, "all") == list(range(20))
    (tmp_path / "out/bad").rename(tmp_path / "gone")
    (tmp_path / "aside").rename(tmp_path / "out/bad")
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/all").rglob("*.parquet")}
    _sinks(spark, tmp_path).awaitTermination()
    assert _ids(spark, tmp_path, "all") == list(range(20))
    assert _ids(spark, tmp_path, "bad") == [k for k in range(20) if k % 3 == 0]
    # The sink that had the batch was not touched.
    assert first == {p: p.stat().st_mtime_ns for p in (tmp_path / "out/all").rglob("*.parquet")}
    assert len({r.batch for r in read_sink(spark, str(tmp_path / "out/all"), ROWS).collect()}) == 2


def test_half_a_batch_is_replaced_and_not_read(spark, tmp_path):
    _put(spark, tmp_path, range(4))
    _sinks(spark, tmp_path).awaitTermination()
    (folder,) = (tmp_path / "out/all").glob("batch=*")
    (folder / "_SUCCESS").unlink()
    assert _ids(spark, tmp_path, "all") == []
    # The progress of the batch is taken back, as if the run had stopped before it was noted.
    for note in (tmp_path / "progress/commits").glob("*0*"):
        note.unlink()
    _sinks(spark, tmp_path).awaitTermination()
    assert _ids(spark, tmp_path, "all") == list(range(4)) and _ids(spark, tmp_path, "bad") == [0, 3]


def test_another_checkpoint_adds_its_own_batches(spark, tmp_path):
    _put(spark, tmp_path, range(3))
    for name in ("progress", "other"):
        stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
        write_sinks(stream, {"all": F.lit(True)}, str(tmp_path / "out"), str(tmp_path / name)).awaitTermination()
    assert _ids(spark, tmp_path, "all") == [0, 0, 1, 1, 2, 2]
    assert read_sink(spark, str(tmp_path / "out/none"), ROWS).count() == 0
