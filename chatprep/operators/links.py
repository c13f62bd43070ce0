"""Paths resolved through links, as a file system resolves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.session import written

#: A path on its way: its names that are done, those still to come, and the links whose
#: targets are being read, each with the number of names that come after it.
_OPEN = "array<struct<at:string,left:int>>"


def _names(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda name: (name != "") & (name != "."))


def _walked(done: Column, names: Column) -> Column:
    """Names after others, with two dots taking one back."""
    return F.aggregate(
        names,
        done,
        lambda known, name: F.when(
            name == "..", F.slice(known, F.lit(1), F.greatest(F.size(known) - 1, F.lit(0)))
        ).otherwise(F.concat(known, F.array(name))),
    )


def _path(names: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(names, "/"))


def _next_links(state: DataFrame, links: DataFrame) -> DataFrame:
    """For each path that meets a link: the first one on its way, where it is, and its target."""
    count = F.size("rest")
    steps = F.transform(
        F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(
            k.alias("k"),
            F.when(F.get("rest", k - 1) != "..", _path(_walked(F.col("done"), F.slice("rest", F.lit(1), k)))).alias("at"),
        ),
    )
    prefixes = state.select("path", F.inline(steps).alias("k", "at"))
    met = prefixes.join(links, "at").groupBy("path").agg(F.min(F.struct("k", "at", "target")).alias("link"))
    return met.select(F.col("path").alias("_path"), "link")


def resolve_links(paths: DataFrame, links: DataFrame, cwd: str) -> DataFrame:
    """Distinct ``path`` with ``resolved``, absolute and free of links and dots, and ``loop``.

    ``links`` holds ``path``, absolute and itself without links on the way, and
    ``target``, absolute or relative to the link's folder. Names are read from left to
    right, so that two dots behind a link lead to the folder above its target. Each round
    joins the names on the way of all paths with the links, and follows the first link
    of each; paths that meet none are done. There are as many rounds as the longest
    chain of links. A link that is met again while its own target is being read is a
    loop: ``resolved`` is null and ``loop`` names it. Of several targets the least
    counts. Null paths, and links without a path or target, are left out.
    """
    known = links.where("path IS NOT NULL AND target IS NOT NULL")
    known = known.groupBy(_path(_names(F.col("path"))).alias("at")).agg(F.min("target").alias("target"))
    path = F.col("path")
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), path))
    none = F.array().cast("array<string>")
    state = paths.select("path").where("path IS NOT NULL").distinct()
    state = state.select("path", none.alias("done"), _names(full).alias("rest"), F.array().cast(_OPEN).alias("open"))
    found = None
    while True:
        state = written(state, "paths")
        met = written(_next_links(state, known), "links")
        ended = state.join(met, F.col("path") == F.col("_path"), "left_anti")
        ended = ended.select(
            "path", _path(_walked(F.col("done"), F.col("rest"))).alias("resolved"), F.lit(None).cast("string").alias("loop")
        )
        found = ended if found is None else found.unionByName(ended)
        if met.isEmpty():
            return found
        k, at, target = F.col("link.k"), F.col("link.at"), F.col("link.target")
        left = F.size("rest") - k
        still = F.filter("open", lambda o: o["left"] <= left)
        above = _walked(F.col("done"), F.slice("rest", F.lit(1), k))
        moved = state.join(met, F.col("path") == F.col("_path")).select(
            "path",
            F.exists(still, lambda o: o["at"] == at).alias("looped"),
            at.alias("at"),
            F.when(target.startswith("/"), none)
            .otherwise(F.slice(above, F.lit(1), F.size(above) - 1))
            .alias("done"),
            F.concat(_names(target), F.slice("rest", k + 1, F.size("rest"))).alias("rest"),
            F.concat(still, F.array(F.struct(at.alias("at"), left.alias("left")))).alias("open"),
        )
        moved = written(moved, "moved")
        looped = moved.where("looped").select("path", F.lit(None).cast("string").alias("resolved"), F.col("at").alias("loop"))
        found = found.unionByName(looped)
        state = moved.where("NOT looped").select("path", "done", "rest", "open")


def with_resolved(df: DataFrame, columns: dict[str, str], links: DataFrame, cwd: str) -> DataFrame:
    """Add, for each path column, what it resolves to and its loop: ``{"_resolved": "path"}`` gives ``_resolved``, ``_resolved_loop``.

    Each distinct path is resolved once. A path that very many rows have is split when it
    is joined back.
    """
    for name, path in columns.items():
        seen = resolve_links(df.select(F.col(path).alias("path")), links, cwd)
        seen = written(seen, "resolved").toDF("_seen", name, f"{name}_loop")
        df = df.join(seen.hint("merge"), F.col(path) == F.col("_seen"), "left").drop("_seen")
    return df
