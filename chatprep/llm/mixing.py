"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, passed through again as often as its
target asks. A document's virtual finish time is the source's tokens up to and with it
over the source's target. The mix is all queues by finish time, cut where the total
budget is used up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from chatprep.llm.common import BLANKS, written

#: Weights of the sources in order, repeated, and the most passes.
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
SEED = "mix"
#: Ranges of the shuffle order that running sums are cut into: one task sums one range
#: of one source. More ranges suit more documents; results don't depend on it.
RANGES = 4096
#: Cells that finish times are counted in, per round of the search for the cut.
CELLS = 4096


def count_words(text: Column) -> Column:
    """Runs without blanks; none for null."""
    # Blanks at the ends make an empty piece each.
    pieces = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.size(F.filter(pieces, lambda piece: piece != "")).cast("long")


def targets(sizes: DataFrame, budget: Column | None = None, passes: int = MAX_PASSES) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each row of (source, source_size).

    Sources by code point, null last, weigh 5, 2, 1 and again. They share the budget
    (all sizes if not given) by weight; none gets more than ``passes`` times its size,
    and what it leaves goes to the others by weight until none is above. There is one
    row for each source here, however many documents it has.
    """
    nulls_last = [F.col("source").isNull(), F.col("source")]
    place = F.row_number().over(Window.orderBy(*nulls_last))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place - 1) % len(WEIGHTS) + 1).cast("long")
    # Wide decimals: products of all tokens and all weights may exceed a long.
    size = F.col("source_size").cast("decimal(20,0)")
    rows = sizes.withColumn("_weight", weight.cast("decimal(3,0)"))
    rows = rows.withColumn("_limit", (size * passes).cast("decimal(20,0)"))
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) if budget is None else budget
    rows = rows.withColumn("_total", total.cast("decimal(20,0)"))
    # Those with the least limit for their weight are filled first. A source is full if
    # the level at which all sources from it on would be filled alike is above its own.
    ratio = F.col("_limit").cast("double") / F.col("_weight")
    order = Window.orderBy(ratio, *nulls_last).rowsBetween(Window.unboundedPreceding, -1)
    before = {name: F.coalesce(F.sum(name).over(order), F.lit(0)) for name in ("_limit", "_weight")}
    rows = rows.withColumn("_given", before["_limit"].cast("decimal(20,0)"))
    rows = rows.withColumn("_left", (F.sum("_weight").over(whole) - before["_weight"]).cast("decimal(12,0)"))
    full = F.col("_limit") * F.col("_left") <= F.col("_weight") * (F.col("_total") - F.col("_given"))
    rows = rows.withColumn("_full", full)
    given = F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))).over(whole), F.lit(0))
    left = F.sum(F.when(~F.col("_full"), F.col("_weight"))).over(whole)
    share = (F.col("_weight") * (F.col("_total") - given)).cast("double") / left.cast("double")
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(share).alias("target"),
    )


def _place_of(name: Column) -> Column:
    """A long that orders documents at random by their id, the same in every run."""
    row = F.coalesce(name.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.sha2(F.concat(F.lit(SEED + ":"), row), 256), 1, 15), 16, 10).cast("long")


def _queued(rows: DataFrame, ranges: int) -> DataFrame:
    """Adds ``upto``: the source's tokens up to and with the row, in shuffled order.

    Sums run inside a range of a source; the sums of the ranges before, one row for
    each, are joined back. A source with a third of all rows is cut like any other.
    """
    width = (1 << 60) // ranges
    rows = rows.withColumn("_range", F.floor(F.col("place") / width))
    parts = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_range").orderBy("place", "id", "size")
    rows = rows.withColumn("_inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    same = rows["source"].eqNullSafe(parts["source"]) & (rows["_range"] == parts["_range"])
    return rows.join(parts, same).select(
        *[rows[name] for name in rows.columns if name not in ("_range", "_inside")],
        (F.col("_inside") + F.col("_before")).alias("upto"),
    )


def _offers(queued: DataFrame, passes: int) -> DataFrame:
    """One row for each pass through a row: its finish time, with what breaks ties."""
    rows = queued.where("size > 0 and target > 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    return rows.withColumn("finish", _finish(F.col("pass")))


def _finish(number: Column) -> Column:
    return (F.col("upto") + number * F.col("source_size")).cast("double") / F.col("target")


_ORDER = ["finish", "place", "id", "pass"]


def _in_mix(number: int, last: Row) -> Column:
    """Whether a pass through a row is up to the last offer taken; nulls come first."""
    own = {"finish": _finish(F.lit(number)), "place": F.col("place"), "id": F.col("id"), "pass": F.lit(number)}
    upto = F.lit(True)
    for name in reversed(_ORDER):
        bound = F.lit(last[name])
        if last[name] is None:
            upto = own[name].isNull() & upto
        else:
            upto = own[name].isNull() | (own[name] < bound) | ((own[name] == bound) & upto)
    return upto


def _last_taken(offers: DataFrame, budget: int) -> Row | None:
    """The last offer, by finish time, up to which all together are within the budget.

    The offers are counted into ranges of finish time; the range in which the budget
    ends is counted into ranges again, until it has few rows, which are sorted.
    """
    ends = offers.agg(F.min("finish"), F.max("finish")).first()
    if ends[0] is None:
        return None
    low, high, spent = ends[0], ends[1], 0
    while True:
        width = (high - low) / CELLS
        if width <= 0 or low + width == low:
            break
        here = offers.where(F.col("finish").between(low, high))
        cell = F.least(F.floor((F.col("finish") - low) / width), F.lit(CELLS - 1))
        # At most CELLS rows come to the driver.
        cells = here.groupBy(cell.alias("cell")).agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")
        ).orderBy("cell").collect()
        for found in cells:
            if spent + found["size"] > budget:
                break
            spent += found["size"]
        else:
            # All of them fit.
            return _latest(offers)
        low, high = found["low"], found["high"]
        if found["n"] <= CELLS:
            break
    # Few rows: at most CELLS, or offers of different sources with one and the same finish time.
    upto = F.sum("size").over(Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0))
    here = offers.where(F.col("finish").between(low, high)).select(*_ORDER, upto.alias("upto"))
    if last := _latest(here.where(F.col("upto") + spent <= budget)):
        return last
    return _latest(offers.where(F.col("finish") < low))


def _latest(offers: DataFrame) -> Row | None:
    return offers.select(*_ORDER).orderBy(*[F.desc(name) for name in _ORDER]).limit(1).first()


def mix(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, passes: int = MAX_PASSES, ranges: int = RANGES
) -> DataFrame:
    """One row per input row: the id, ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    ``taken`` is ``copies`` times the size: the words that the mix takes from the row.
    The budget is the words of all documents. A null text has no words; a document
    without words is never taken. A null source is a source of its own, the last.
    Rows with the same id and size follow each other in either order. An empty table
    gives an empty result; other columns play no part.
    """
    rows = docs.select(F.col(id_col).alias("id"), _source(source_col), count_words(F.col(text_col)).alias("size"))
    # Texts are read once; ids and sizes go on.
    mixed = _mixed(written(rows, "sizes"), passes, ranges)
    return mixed.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "copies")


def taken(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, passes: int = MAX_PASSES, ranges: int = RANGES
) -> DataFrame:
    """The rows that the mix takes, all columns kept, and ``copies``, how often it takes each.

    Cases are as in ``mix``, but rows alike in id, source and size are taken alike. A column of the input that is called ``copies`` stays as
    it is; the new one then is ``copies_`` with as many underscores as it takes.
    """
    columns = docs.columns
    rows = docs.select(F.col(id_col).alias("id"), _source(source_col), count_words(F.col(text_col)).alias("size"))
    mixed = _mixed(written(rows, "sizes"), passes, ranges)
    # Within a source the mix takes, in each pass, the rows up to some last one; so a row
    # can be judged by itself, and texts stay where they are. One row for each source.
    here = F.struct(_place_of(F.col("id")), F.col("id"), F.col("size"))
    lasts = mixed.groupBy("source").agg(
        *[F.max(F.when(F.col("copies") > k, here)).alias(f"last{k}") for k in range(passes)]
    )
    lasts = written(lasts.select(F.struct("source").alias("_key"), *[f"last{k}" for k in range(passes)]), "lasts")
    every = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    own = {name: F.col(f"c{columns.index(name)}") for name in (id_col, text_col, source_col)}
    every = every.withColumns(
        {"_size": count_words(own[text_col]), "_key": F.struct(own[source_col].cast("string").alias("source"))}
    ).where("_size > 0")
    mine = F.struct(_place_of(own[id_col]), own[id_col], F.col("_size"))
    copies = F.lit(0)
    for k in range(passes):
        copies = copies + F.coalesce((mine <= F.col(f"last{k}")).cast("int"), F.lit(0))
    name = "copies"
    while name in columns:
        name += "_"
    kept = [F.col(f"c{k}").alias(column) for k, column in enumerate(columns)]
    return every.join(lasts, "_key").select(*kept, copies.alias(name)).where(F.col(name) > 0)


def _source(source_col: str) -> Column:
    return F.col(source_col).cast("string").alias("source")


def _mixed(rows: DataFrame, passes: int, ranges: int) -> DataFrame:
    """All columns of rows (id, source, size) with sizes, targets, ``copies`` and ``taken``."""
    columns = rows.columns
    rows = rows.withColumn("place", _place_of(F.col("id")))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), passes=passes)
    queued = _queued(rows, ranges)
    own = goals.withColumnRenamed("source", "_source")
    queued = queued.join(own, queued["source"].eqNullSafe(own["_source"])).drop("_source")
    queued = written(queued, "queues")
    budget = rows.agg(F.sum("size")).first()[0] or 0
    last = _last_taken(_offers(queued, passes), budget)
    copies = F.lit(0)
    if last is not None:
        for number in range(passes):
            copies = copies + F.when(_in_mix(number, last), 1).otherwise(0)
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0)
    return queued.select(
        *columns,
        "source_size",
        "target",
        (F.col("size") * copies).alias("taken"),
        copies.cast("int").alias("copies"),
    )
