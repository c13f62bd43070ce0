import random

import pytest
from pyspark.sql import functions as F

from chatprep.operators import usage
from chatprep.operators.running import running_totals
from tests.helpers import final_plan, rows

TURN = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


@pytest.fixture(scope="module")
def skewed(spark):
    """Fifty conversations, one of them with most of the turns."""
    pick = random.Random(5)
    lengths = {c: 3000 if c == 7 else pick.randint(1, 60) for c in range(50)}
    made = [
        (c, t, pick.choice(["user", "assistant", "tool"]), "w " * pick.randint(0, 9))
        for c, n in lengths.items()
        for t in range(n)
    ]
    return spark.createDataFrame(made, TURN).repartition(6), made


def usage_by_hand(made):
    out, seen, totals = [], {}, {}
    for conv, turn, role, text in made:
        n = len(text.split())
        if role == "assistant":
            totals[conv] = totals.get(conv, 0) + seen.get(conv, 0) + n
            out.append((conv, turn, seen.get(conv, 0), n, totals[conv]))
        seen[conv] = seen.get(conv, 0) + n
    return out


@pytest.mark.parametrize("part_turns", [1, 7, 100, 10_000])
def test_context_usage_of_a_long_conversation(skewed, part_turns):
    df, made = skewed
    assert rows(usage.context_usage(df, part_turns=part_turns)) == sorted(usage_by_hand(made), key=repr)


def test_context_usage_shuffles_the_turns_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
        text = final_plan(usage.context_usage(df, part_turns=3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("FileScan") == 1
    assert "ReusedExchange" in text


def test_running_totals_of_a_hot_key(spark):
    pick = random.Random(6)
    made = [("hot" if pick.random() < 0.6 else f"k{pick.randint(0, 20)}", n, pick.randint(0, 9)) for n in range(5000)]
    df = spark.createDataFrame(made, "key STRING, at BIGINT, v BIGINT").repartition(5)
    for width in (1, 13, 1000, 10_000):
        chunk = F.expr(f"at div {width}")
        result = running_totals(df, ["key"], ["at"], chunk, {"total": F.col("v"), "number": F.lit(1)})
        sums, counts, want = {}, {}, []
        for key, at, v in made:
            sums[key] = sums.get(key, 0) + v
            counts[key] = counts.get(key, 0) + 1
            want.append((key, at, v, sums[key], counts[key]))
        assert rows(result, "key", "at", "v", "total", "number") == sorted(want, key=repr)


USED = "conv_id BIGINT, turn BIGINT, input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT"


def test_limit_breach_at_and_above_the_limit(spark):
    df = spark.createDataFrame(
        [(1, 0, 100, 50, 150), (1, 1, 200, 10, 360), (2, 0, 101, 50, 151), (3, 0, 99, 1, 100), (3, 1, 1, 1, 102)], USED
    )
    # Used 0 + input 100 + new 50 is the limit itself and passes.
    got = rows(usage.limit_breach(df, max_total=150, max_new=50))
    assert got == [(1, 1, 150, 400), (2, 0, 0, 151), (3, 1, 100, 151)]


def test_context_status(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, t) for t in (599, 600, 849, 850, 851, 1200)], USED)
    got = usage.context_status(df, 1000).orderBy("total_tokens").collect()
    assert [r.status for r in got] == ["Healthy", "Getting Full", "Getting Full"] + ["DANGER: Near OOM"] * 3
    assert [r.warning for r in got] == [False] * 4 + [True] * 2
    assert [r.percent for r in got][-1] == 100.0


def test_session_outcome(spark):
    cases = {1: [1, 1, 0, 1], 2: [1] * 12, 3: [0], 4: [1, 1], 5: [1, 0], 6: [1] * 10}
    answers = [(c, t * 2 + 1, n) for c, calls in cases.items() for t, n in enumerate(calls)]
    df = spark.createDataFrame(answers, "conv_id BIGINT, turn BIGINT, n_calls BIGINT").repartition(4)
    ended = {r.conv_id: (r.outcome, r.n_turns) for r in usage.session_outcome(df).collect()}
    assert ended == {
        1: ("final_answer", 3),
        2: ("max_turns", 10),
        3: ("final_answer", 1),
        4: ("unfinished", 2),
        5: ("final_answer", 2),
        6: ("max_turns", 10),
    }
    breaches = spark.createDataFrame([(1, 3), (2, 1), (5, 3), (6, 99)], "conv_id BIGINT, turn BIGINT")
    limited = usage.session_outcome(df, breaches=breaches)
    ended = {r.conv_id: (r.outcome, r.n_turns) for r in limited.collect()}
    assert ended[1] == ("failed", 2) and ended[2] == ("failed", 1) and ended[5] == ("failed", 2)
    assert ended[6] == ("max_turns", 10)


def test_session_outcome_keeps_few_rows_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS conv_id", "id AS turn", "1L AS n_calls")
    text = final_plan(usage.session_outcome(df))
    assert text.index("Final") < text.index("Exchange") < text.index("row_number(), 10, Partial")


def test_calls_over_cap(spark):
    df = spark.createDataFrame([(1, 1)] * 5 + [(1, 2)] * 6 + [(2, 1)] * 9, "session_id BIGINT, turn BIGINT")
    assert rows(usage.calls_over_cap(df)) == [(1, 2, 6, 1), (2, 1, 9, 4)]


def test_failure_streaks(spark):
    pick = random.Random(8)
    patterns = {1: "FFFF", 2: "SSS", 3: "FSFSF", 4: "SFFSFFF", 5: "".join(pick.choice("FFFS") for _ in range(2000))}
    made = [(s, n, c == "S") for s, p in patterns.items() for n, c in enumerate(p)]
    df = spark.createDataFrame(made, "session_id INT, call_no INT, success BOOLEAN").repartition(4)
    got = usage.failure_streaks(df, ordered=True).collect()
    assert got == usage.failure_streaks(df, part_calls=3, ordered=True).collect()
    want = []
    for session, pattern in patterns.items():
        at = 0
        for run in pattern.split("S"):
            if run:
                want.append((session, len(run), at, at + len(run) - 1))
            at += len(run) + 1
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert [r.length for r in got] == sorted((r.length for r in got), reverse=True)


def test_running_totals_read_wide_rows_once(spark, tmp_path):
    wide = spark.range(1000).select(F.col("id") % 3, F.col("id").alias("at"), F.repeat(F.lit("x"), 50).alias("payload"))
    wide.toDF("key", "at", "payload").write.parquet(str(tmp_path / "wide"))
    rows_ = spark.read.parquet(str(tmp_path / "wide"))
    result = running_totals(rows_, ["key"], ["at"], F.expr("at div 100"), {"n": F.lit(1)})
    text = final_plan(result.select("key", "at", "payload", "n"))
    schemas = [line for line in text.split("\n") if "FileScan" in line]
    assert len(schemas) == 2 and sum("payload" in line.split("ReadSchema")[1] for line in schemas) == 1
    assert text.count("Window ") == 2
