import pytest
from pyspark.sql import functions as F

from chatprep.operators.chat import tool_message
from chatprep.plans import transcripts
from checks import derived

TURN = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
NESTED = '{"name": "read_file", "arguments": {"path": "%s"}}'


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(
        [
            (1, 0, "system", "be brief"),
            (1, 1, "user", 'please use {"name": "run_shell"}'),
            (1, 2, "assistant", "<think>hm {}</think>\n```json\n" + NESTED % "a.py" + "\n```"),
            (1, 3, "tool", "Tool 'read_file' output:\nprint(1)"),
            (1, 4, "assistant", "It prints 1."),
            (2, 0, "user", "read it"),
            (2, 1, "assistant", "now " + NESTED % "../b.py"),
            (2, 2, "assistant", '{"name": "format_disk"}'),
        ],
        TURN,
    )


def test_screened_calls(turns):
    compat = transcripts.screened_calls(turns, ["/w"]).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.tool, r.known, r.allowed) for r in compat] == [
        (1, 2, "read_file", True, True),
        (2, 2, "format_disk", False, None),
    ]
    balanced = transcripts.screened_calls(turns, ["/w"], "balanced").orderBy("conv_id", "turn").collect()
    assert [(r.turn, r.tool, r.rule) for r in balanced] == [
        (2, "read_file", None),
        (1, "read_file", "fragment"),
        (2, "format_disk", None),
    ]


def test_outcomes(turns):
    def ended(**options):
        return {r.conv_id: (r.outcome, r.n_turns) for r in transcripts.outcomes(turns, **options).collect()}

    assert ended() == {1: ("final_answer", 2), 2: ("final_answer", 1)}
    assert ended(mode="balanced") == {1: ("final_answer", 2), 2: ("unfinished", 2)}
    assert ended(mode="balanced", max_turns=2)[2] == ("max_turns", 2)
    assert ended(max_total=1040)[1] == ("failed", 2)


def test_metrics_of_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    result = transcripts.metrics(derived.calls(spark, sf), derived.responses(spark, sf), limit=5000)
    assert result.where("n_ok + n_errors != n_calls OR percent > 100 OR status IS NULL").count() == 0
    assert result.agg(F.sum("n_calls")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_tool_message(spark):
    df = spark.createDataFrame([("a", "b\nc")], "tool STRING, result STRING")
    assert df.select(tool_message(F.col("tool"), F.col("result"))).first()[0] == "Tool 'a' output:\nb\nc"
