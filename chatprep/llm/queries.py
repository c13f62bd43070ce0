"""One query per corpus operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.llm import (
    decontaminate,
    html_text,
    mixing,
    pii,
    prefix_trie,
    quality,
    secret_scan,
    simhash,
    suffix_dedup,
    token_count,
    url_filter,
    warc,
    whitening,
)
from chatprep.llm.common import table, written
from chatprep.session import new_path

RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]
#: Host names that put a URL on the list.
LISTED = ["spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track"]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = url_filter.listed_by_host(pages, "url", LISTED)
    found = url_filter.judge_urls(pages, "page_id", "url", listed, RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = token_count.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return found.withColumn("over_limit", F.col("n_tokens") > 1024)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal(docs, "text")
    return found.select("doc_id", *pii.spans_digest(F.col("_pii.spans"), pii.BASE_KINDS, pii.KINDS))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("row.doc_id", *counts, "base_failed", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans through one ledger: a part of the documents with the base rules, then all of them with all rules."""
    docs = table(spark, sf_dir, "documents")
    first = docs.where(F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False)))
    ledger = written(secret_scan.scan_unseen(first, "text", rules=secret_scan.RULES[:3]), "ledger")
    ledger = written(ledger.unionByName(secret_scan.scan_unseen(docs, "text", ledger)), "ledger")
    found = secret_scan.findings_of(docs, ["doc_id"], "text", ledger)
    kinds = [rule.kind for rule in secret_scan.RULES]
    return found.select("doc_id", *pii.spans_digest(F.col("found"), secret_scan.BASE_KINDS, kinds))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), "doc_id", "text").drop("spans")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(
        table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text"
    )


#: The header field that names a page.
PAGE = "X-Page-Id"


def op11_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a crawl's archives, these without repeated payloads, and what those then say of each page."""
    crawl, out = new_path(spark, "crawl"), new_path(spark, "archive")
    warc.write_archive(warc.page_records(table(spark, sf_dir, "pages"), "url", "html", {PAGE: "page_id"}), crawl)

    def page(fields: str) -> Column:
        return F.try_element_at(F.col(fields), F.lit(PAGE)).cast("long")

    warc.deduplicate(spark, crawl, out, page("fields"))
    headers = warc.read_records(spark, out, payload=False).drop("head", "payload")
    found = warc.with_originals(written(headers, "headers"))
    return found.select(
        page("fields").alias("page_id"),
        F.coalesce("payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        page("original.fields").alias("refers_to"),
    )


def shared_openings(convs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Sequences whose first turns, a number by their id, are those of every fifth one."""
    own = F.col("conv_id")
    h = (F.crc32(own.cast("string")) % most).cast("int")
    heads = convs.select(own.alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    rows = convs.withColumn("_base", own - own % every).join(heads, "_base", "left")
    # A conversation that is not there has no turns to lend.
    head = F.coalesce("_head", F.slice("turns", 1, 0))
    turns = F.concat(F.slice(head, F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return rows.select("conv_id", turns.alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    convs = written(prefix_trie.sequences(turns, "conv_id", "turn", "role", "text"), "sequences")
    nodes = prefix_trie.prefix_trie(shared_openings(convs))
    return nodes.withColumn("depth", F.col("depth").cast("long")).withColumnRenamed("saved_bytes", "saved_tokens")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    # Beyond a long, at about three million vectors, there is no value that the column could hold.
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_url_filter,
        op2_token_counts,
        op3_pii,
        op4_quality_rules,
        op5_secret_scan,
        op6_simhash,
        op7_mixing,
        op8_suffix_dedup,
        op9_html_text,
        op10_decontamination,
        op11_warc_revisits,
        op12_prefix_trie,
        op13_whitening,
    )
}
