"""A corpus from raw documents to a weighted mix, one stage per operator.

Each stage takes the documents that the one before it kept and returns documents; its
result is written and read again as the next one's input. The last one adds how often
the mix takes each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.llm import decontaminate, mixing, pii, quality, simhash
from chatprep.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    judged = quality.judge(docs, "doc_id", "text", "lang", keep=docs.columns)
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return simhash.first_of_groups(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark.

    A document is an id and a text, since ids may be null or repeated: rows that are
    alike in both stay or go together, others each for themselves.
    """
    items = table(spark, sf_dir, "benchmark")
    own = simhash.row_key(F.col("doc_id"), F.col("text"))
    found = decontaminate.contained_items(docs.select(own.alias("own"), "text"), "own", "text", items, "item_id", "text")
    leaks = written(found.select(F.col("own").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, own == F.col("_leak"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each finding in its place; ``n_chars`` follows the text."""
    found = pii.find_personal(docs, "text")
    changed = F.size("_pii.spans") > 0
    n_chars = F.when(changed, F.length("_pii.masked")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("_pii.masked"), "n_chars": n_chars}
    return found.select(*[new[name].alias(name) if name in new else F.col(name) for name in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``: how often it takes them."""
    return mixing.taken(docs, "doc_id", "text", "source")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
]

#: Fingerprints, spans and masked texts are beyond SQL; the pipeline is tested against loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
