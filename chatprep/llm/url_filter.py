"""URL filter: a blocked Bloom filter in front of an exact hash join.

The listed canonical URLs set bits in a filter of a fixed number of 256-bit blocks.
Each URL looks at one block; those whose bits are not all set are not listed, and
leave without a shuffle. The rest, hits and false positives, meet the list itself in
an exact join, which alone decides. The filter is a table of at most ``n_blocks``
rows of 40 bytes, however long the list is, so it can be broadcast; a list too long
for it lets more URLs through to the exact join and changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import ascii_lower

#: 65,536 blocks of 256 bits: 2 MB of bits, for about 1.6 million listed URLs at ten bits each.
N_BLOCKS = 1 << 16
_LANES = 4


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def canonical_url(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, port and last dot, and path without slashes at its end."""
    bare = F.regexp_replace(F.regexp_replace(host, r"\.?(:[0-9]*)?$", ""), r"^(www|m)\.", "")
    return F.concat(bare, F.regexp_replace(path, r"/+$", ""))


def first_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, the first of equally long ones; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last of the chain is asked first, so the longest comes last, the first of equals after the others.
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _block(url: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(n_blocks))


def _lanes(url: Column) -> list[Column]:
    """Two bits in each of the four 64-bit lanes of a block."""
    bits = F.xxhash64(url, F.lit("bits"))

    def bit(k: int) -> Column:
        place = F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return [bit(2 * lane).bitwiseOR(bit(2 * lane + 1)) for lane in range(_LANES)]


def block_filter(listed: DataFrame, n_blocks: int = N_BLOCKS) -> DataFrame:
    """The filter of a list with a column ``canonical``: a row for each block with a bit set."""
    url = F.col("canonical")
    rows = listed.where(url.isNotNull()).select(
        _block(url, n_blocks).alias("_block"), *[lane.alias(f"_lane{k}") for k, lane in enumerate(_lanes(url))]
    )
    return rows.groupBy("_block").agg(*[F.bit_or(f"_lane{k}").alias(f"_lane{k}") for k in range(_LANES)])


def judge_urls(
    urls: DataFrame,
    id_col: str,
    url_col: str,
    listed: DataFrame,
    rules: list[Rule],
    n_blocks: int = N_BLOCKS,
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, canonical, possible, listed.

    The longest fitting rule decides; where none fits, a URL in ``listed`` (column
    ``canonical``, repeats and nulls allowed) is blocked and any other allowed.
    A null URL, or one without ``://``, has an empty host and path, fits no rule and
    is never listed. Repeated rows are judged one by one, an empty table gives an
    empty result, and other columns of the input play no part. A long URL is read
    whole. ``rules`` is a short list kept in the plan; ``listed`` may have any size.
    """
    rows = urls.select(
        F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    )
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select(
        "id",
        "host",
        "path",
        rule.alias("rule"),
        verdict.alias("_verdict"),
        F.when(F.col("host") != "", canonical_url(F.col("host"), F.col("path"))).alias("canonical"),
    )
    known = listed.select("canonical").where("canonical is not null").distinct()
    url = F.col("canonical")
    rows = rows.withColumn("_block", _block(url, n_blocks))
    # At most n_blocks rows of five numbers, whatever the list's length.
    rows = rows.join(F.broadcast(block_filter(known, n_blocks)), "_block", "left")
    hit = F.lit(True)
    for k, lane in enumerate(_lanes(url)):
        hit = hit & (F.col(f"_lane{k}").bitwiseAND(lane) == lane)
    rows = rows.select("id", "host", "path", "rule", "_verdict", "canonical", F.coalesce(hit, F.lit(False)).alias("possible"))
    away = rows.where(~F.col("possible")).withColumn("listed", F.lit(False))
    near = rows.where("possible").join(
        known.withColumn("_known", F.lit(True)).hint("shuffle_hash"), "canonical", "left"
    )
    near = near.select(*rows.columns, F.coalesce("_known", F.lit(False)).alias("listed"))
    return away.unionByName(near).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("_verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical",
        "possible",
        "listed",
    )


def listed_by_host(urls: DataFrame, url_col: str, labels: list[str]) -> DataFrame:
    """The canonical URLs on hosts that have one of ``labels`` among their names."""
    host = host_of(F.col(url_col))
    names = F.split(host, r"\.")
    on_list = F.arrays_overlap(names, F.array(*[F.lit(label) for label in labels]))
    return (
        urls.where(F.col(url_col).isNotNull() & on_list)
        .select(canonical_url(host, path_of(F.col(url_col))).alias("canonical"))
        .distinct()
    )
