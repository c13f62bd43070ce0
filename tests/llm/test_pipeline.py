"""The pipeline's stages against loops, and the registered queries against their SQL."""

import random

import pytest
from loops import fingerprint, linked, shingles
from loops import mixed as loop_mix
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from chatprep.llm import pii, quality
from chatprep.llm.oracle import ORACLE
from chatprep.llm.queries import QUERIES
from checks import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.duck(SF)


def test_registered():
    names = driver.queries()
    assert {*QUERIES, "pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, connection, monkeypatch):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLE", ORACLE)
    assert compare.difference(name, spark, connection, SF) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        kept[name] = (before, {r.doc_id: r for r in docs.collect()})
    before, after = kept["quality rules"]
    rows = quality.judge(spark.createDataFrame(list(before.values())), "doc_id", "text", "lang").where("kept")
    assert set(after) == {r.row.doc_id for r in rows.collect()}
    before, after = kept["SimHash near-dedup"]
    prints = [(k, fingerprint(r.text)) for k, r in sorted(before.items())]
    assert set(after) == set(linked(prints))
    before, after = kept["benchmark decontamination"]
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {k for k, r in before.items() if any(i and len(i & shingles(r.text)) >= 0.8 * len(i) for i in items)}
    assert set(after) == set(before) - leaks
    before, after = kept["PII"]
    assert set(after) == set(before)
    for k, row in after.items():
        assert row.text == pii.masked(before[k].text, pii.personal_spans(before[k].text))
        assert row.n_chars == len(row.text)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.columns == [*columns, "copies"]
    wanted = loop_mix([(k, r.text, r.source) for k, r in after.items()])
    copies = {k: taken // size for k, (size, _, _, taken) in wanted.items() if taken}
    assert {r.doc_id: r.copies for r in mixed.collect()} == copies


def test_null_and_repeated_ids(spark):
    """Each row is judged for itself: a leak takes no other document of its id along."""
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    pick = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [r for r in docs.where("lang = 'en'").collect() if 60 < len(r.text.split()) < 500]
    texts = {f"clean {k}": " ".join(pick.sample(r.text.split(), 60)) for k, r in enumerate(clean[:4])}
    texts["leak"] = f"{texts['clean 0'][:50]} {leak}"
    rows = [(None, texts["clean 0"]), (None, texts["clean 1"]), (None, texts["leak"]), (7, texts["clean 2"]), (7, texts["clean 3"])]
    rows += [(7, texts["leak"]), (7, texts["clean 2"]), (None, None), (8, "")]
    table = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], docs.schema)
    name, stage = corpus_pipeline.STAGES[2]
    kept = sorted(((r.doc_id, r.text) for r in stage(spark, table, SF).collect()), key=str)
    assert kept == sorted(((k, t) for k, t in rows if t != texts["leak"]), key=str)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, table, SF)
        assert found.count() <= len(rows)
        if name == "SimHash near-dedup":
            assert found.where("doc_id IS NULL").count() > 0 or found.count() < len(rows)
        if name == "PII":
            assert found.count() == len(rows)


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
