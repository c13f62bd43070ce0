"""Secrets by an incremental blob ledger.

Every version of a text is a blob, addressed by the hash of its content. The ledger
says which blob was read under which version of which rule, and what was found. Only
pairs of blob and rule version that it does not have are scanned, each blob once
however many paths and versions hold it, and the findings are joined back to all of
them. Scanning is done by Spark's own text functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A character that no rule matches, set around findings; where a text has it, a
#: neighbour of the same length stands in during the scan.
_MARK, _STAND_IN = "\ue000", "\ue001"


@dataclass(frozen=True)
class SecretRule:
    """What a kind of secret looks like. Raise ``version`` with any change.

    Of each match of ``pattern``, ``group`` must have ``least`` characters or more.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules come first. Order breaks ties between spans.
RULES = [
    SecretRule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    SecretRule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    SecretRule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
    SecretRule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    SecretRule("signed", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    SecretRule("key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]++(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
]
BASE_KINDS = ["assign", "access", "hex"]

#: A finding carries the version of the rule that made it.
SPANS = "array<struct<kind:string,version:int,start:long,end:long>>"


def spans_of(text: Column, rule: SecretRule) -> Column:
    """(kind, version, start, end) of a rule's matches, leftmost first and not overlapping, in code points."""
    marked = F.regexp_replace(text, f"(?:{rule.pattern})", f"{_MARK}$0{_MARK}")
    # Pieces outside and inside matches take turns.
    pieces = F.split(marked, _MARK, -1)
    place = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("found"))

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece["text"])
        ok = piece["inside"] & (F.length(F.regexp_extract(piece["text"], rule.pattern, rule.group)) >= rule.least)
        rule_of = [F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version")]
        span = F.struct(*rule_of, state["at"].alias("start"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(ok, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"),
        )

    numbered = F.transform(pieces, lambda x, k: F.struct(x.alias("text"), (k % 2 == 1).alias("inside")))
    spans = F.aggregate(numbered, place, step, lambda state: state["found"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(F.array().cast(SPANS))


def content_address(text: Column) -> Column:
    """The blob that a text is; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def scan_unseen(
    versions: DataFrame, text_col: str, ledger: DataFrame | None = None, rules: list[SecretRule] | None = None
) -> DataFrame:
    """New ledger rows (blob, scanned, found) for the blobs with a rule version not in ``ledger``.

    ``scanned`` has the names of the rule versions that ran, ``found`` their spans.
    Each blob is read once; a blob that the ledger has under all rules, not at all. An
    empty table gives no rows, null is the empty text, repeated rows are one blob.
    """
    rules = RULES if rules is None else rules
    every = F.array(*[F.lit(rule.name) for rule in rules])
    rows = versions.select(
        content_address(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    # One row for each blob; repeats meet in the map tasks before the shuffle.
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("todo", every)
    else:
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("done"))
        blobs = blobs.join(done, "blob", "left")
        blobs = blobs.withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("todo") > 0)
    text = F.translate(F.col("text"), _MARK, _STAND_IN)
    text = F.when(F.col("text").contains(_MARK), text).otherwise(F.col("text"))
    blobs = blobs.select("blob", "todo", text.alias("text"))
    nothing = F.array().cast(SPANS)
    found = [
        F.when(F.array_contains("todo", rule.name), spans_of(F.col("text"), rule)).otherwise(nothing)
        for rule in rules
    ]
    return blobs.select("blob", F.col("todo").alias("scanned"), F.concat(*found).alias("found"))


def findings_of(
    versions: DataFrame,
    id_cols: list[str],
    text_col: str,
    ledger: DataFrame,
    rules: list[SecretRule] | None = None,
) -> DataFrame:
    """One row for each version row: its id columns, ``blob`` and ``found``.

    ``ledger`` has rows of one or more scans; findings of rules, or of versions of a rule,
    that are not asked for are left out, and a pair that was scanned twice counts once.
    A version whose blob it does not have has no findings. Repeated rows stay; an empty
    table gives an empty result.
    """
    rules = RULES if rules is None else rules
    names = [rule.name for rule in rules]
    known = ledger.groupBy("blob").agg(F.flatten(F.collect_list("found")).alias("found"))
    rows = versions.select(*id_cols, content_address(F.col(text_col)).alias("_blob"))
    known = known.select(F.col("blob").alias("_known"), F.col("found").alias("_found"))
    # Joined by a struct, which the grouping above has not dealt out by: so both sides are
    # dealt anew, and a blob that very many versions hold can be split over tasks.
    rows = rows.join(known, F.struct(F.col("_blob").alias("b")) == F.struct(F.col("_known").alias("b")), "left")
    asked = F.filter("_found", lambda s: F.concat_ws("@", s["kind"], s["version"]).isin(names))
    found = F.coalesce(F.array_distinct(asked), F.array().cast(SPANS))
    return rows.select(*id_cols, F.col("_blob").alias("blob"), found.alias("found"))
