import json

import pytest
from pyspark.sql import functions as F

from chatprep.functions.text import clean_text, strip_reasoning
from chatprep.operators import chat
from chatprep.plans.training_set import conversation_set, format_file, packed_part, pair_set, set_size, split_file, text_of_splits
from chatprep.operators.pack import count_tokens
from chatprep.operators.split import split_hash
from chatprep.rules import PYTHON_SPACE
from tests.helpers import rows

PAIR = "instruction STRING, response STRING, input STRING"


def test_python_space_is_complete():
    assert sorted(PYTHON_SPACE) == [chr(c) for c in range(0x110000) if chr(c).isspace()]


@pytest.mark.parametrize(
    "text", [" a b　", "\t a\n", "", None, "\x1f x\x85", "a​", "  ", "\n\n"]
)
def test_clean_text(spark, text):
    result = spark.createDataFrame([(text,)], "t STRING").select(clean_text(F.col("t"))).first()[0]
    assert result == (None if text is None else text.strip())


def test_strip_reasoning(spark):
    texts = [
        ("<think>a\nb</think>\n\n x ", "x"),
        ("<THINK>a</Think>x<think>b</think> y", "xy"),
        ("<think>open", "<think>open"),
        ("a </think> b", "a </think> b"),
    ]
    df = spark.createDataFrame(texts, "text STRING, want STRING")
    assert df.where(strip_reasoning(F.col("text")) != F.col("want")).count() == 0


def test_valid_and_rejected_pairs(spark):
    rows = [
        ("ok", " fine ", None),
        (" NaN ", "x", None),
        ("None", "x", None),
        ("NONE", "x", None),
        (" ", "x", None),
        (None, "x", None),
        ("q", None, None),
        ("q", "\t", None),
        ("q", "None", None),
        ("nancy", "nan", None),
    ]
    df = spark.createDataFrame(rows, PAIR)
    kept = [(r.instruction, r.response) for r in chat.valid_pairs(df).collect()]
    assert kept == [("ok", "fine"), ("q", "None"), ("nancy", "nan")]
    compat = [(r.instruction, r.response) for r in chat.valid_pairs(df, compat=True).collect()]
    assert compat == [("ok", "fine"), ("q", "nan"), ("q", "None"), ("nancy", "nan")]
    assert chat.rejected_pairs(df).count() + len(kept) == len(rows)
    reasons = [r.reason for r in chat.rejected_pairs(df).collect()]
    assert reasons.count("empty response") == 2 and reasons.count("missing instruction") == 3


def test_to_messages(spark):
    df = spark.createDataFrame([("q", "a", " ctx "), ("q", "a", None), ("q", "a", "")], PAIR)
    made = chat.to_messages(df, input_col="input").collect()
    assert [m.role for m in made[0].messages] == ["system", "user", "assistant"]
    assert made[0].messages[1].content == "q\n\nInput:\nctx"
    assert made[1].messages[1].content == "q"
    assert made[2].messages[1].content == "q\n\nInput:\n"
    bare = chat.to_messages(df, system_prompt="", input_col="absent").first()
    assert [m.role for m in bare.messages] == ["user", "assistant"]
    assert bare.messages[0].content == "q"


def test_long_conversation_is_cut_into_parts(spark):
    turns = spark.range(2500).select(
        F.lit(7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id")).alias("text"),
    )
    parts = chat.collect_messages(turns.repartition(5)).orderBy("part").collect()
    assert [len(p.messages) for p in parts] == [1000, 1000, 500]
    assert [m.content for p in parts for m in p.messages] == [f"t{n}" for n in range(2500)]
    assert [p.is_last for p in parts] == [False, False, True]


def test_part_turns_change_nothing(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = []
    for part_turns in (3, 1000):
        parts = chat.collect_messages(turns, part_turns)
        text = parts.select("conv_id", "part", chat.render_chat(F.col("messages"), F.col("is_last")).alias("text"))
        whole = {}
        for r in text.orderBy("conv_id", "part").collect():
            whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
        sized = set_size(count_tokens(split_hash(chat.to_training_text(parts), "conv_id")))
        found.append((whole, rows(sized)))
    assert found[0] == found[1]


def test_split_file_is_reproducible(spark, tmp_path):
    """The same samples in other files and tasks give the same parts."""
    lines = [json.dumps({"messages": [{"role": "user", "content": f"q{n % 97}"}]}) for n in range(1000)]
    texts = []
    for k, files in enumerate((1, 7)):
        folder = tmp_path / f"in{k}"
        folder.mkdir()
        order = lines if k else lines[::-1]
        for f in range(files):
            (folder / f"{f}.json").write_text("".join(line + "\n" for line in order[f::files]))
        split_file(spark, str(folder), str(tmp_path / f"out{k}"), str(tmp_path / f"work{k}"), seed=3)
        named = {name: str(tmp_path / f"out{k}" / f"split={name}") for name in ("train", "validation")}
        texts.append(rows(text_of_splits(spark, named), "split", "text"))
    assert texts[0] == texts[1] and sum(s == "validation" for s, _ in texts[0]) == 50
    (tmp_path / "in0" / "x.json").write_text('{"messages": [\n')
    with pytest.raises(ValueError, match="no JSON object"):
        split_file(spark, str(tmp_path / "in0"), str(tmp_path / "o"), str(tmp_path / "w"))


def test_render_chat(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")],)], "messages ARRAY<STRUCT<role: STRING, content: STRING>>")
    text = "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert df.select(chat.render_chat(F.col("messages"))).first()[0] == text
    assert df.select(chat.render_chat(F.col("messages"), True)).first()[0] == text + "<|im_start|>assistant\n"
    own = chat.render_chat(F.col("messages"), True, "[{role}] {content}\n", "> ")
    assert df.select(own).first()[0] == "[user] hi\n[assistant] yo\n> "


def test_training_sets(spark, tmp_path):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    made = conversation_set(turns, train_ratio=0.7)
    assert made.count() == turns.select("conv_id").distinct().count()
    assert {r.split for r in set_size(made).collect()} == {"train", "validation"}
    pairs = spark.range(200).select(
        "id", F.concat(F.lit("question "), F.col("id")).alias("instruction"), F.lit("an answer").alias("response")
    )
    ready = pair_set(pairs, "id", str(tmp_path / "curated"))
    assert {r.split: r.n_samples for r in set_size(ready).collect()} == {"train": 190, "validation": 10}
    packed = packed_part(ready, "id", max_len=64).agg(F.sum("n_tokens")).first()[0]
    assert packed == ready.where("split = 'train'").agg(F.sum("n_tokens")).first()[0]


def test_files_from_raw_to_text(spark, tmp_path):
    # A third of the samples are copies of one; sizes stay exact all the same.
    raw = tmp_path / "raw.csv"
    lines = [f"question {n if n % 3 else 0},answer" for n in range(300)]
    raw.write_text("\n".join(["instruction,response", *lines, "NA,x", "q,"]) + "\n")
    formatted, parts, work = (str(tmp_path / n) for n in ("formatted", "parts", "work"))
    format_file(spark, str(raw), formatted)
    split_file(spark, formatted, parts, work, train_ratio=0.9)
    named = {name: f"{parts}/split={name}" for name in ("train", "validation")}
    texts = text_of_splits(spark, named)
    assert {r.split: r.n_samples for r in set_size(texts).collect()} == {"train": 270, "validation": 30}
    first = texts.where("split = 'train'").first().text
    assert first.startswith("<|im_start|>system\nYou are a helpful AI assistant.<|im_end|>\n<|im_start|>user\nquestion ")
    assert texts.select("text").distinct().count() == 201


@pytest.mark.parametrize("path, text", [("a.csv", "nan"), ("a.txt", "nan"), ("a.json", "None"), ("d/a.jsonl/", "None")])
def test_missing_values_as_text(spark, path, text):
    df = spark.createDataFrame([("q", None, None)], PAIR)
    assert chat.null_text(path) == text
    assert chat.valid_pairs(df, compat=chat.null_text(path)).first().response == text
