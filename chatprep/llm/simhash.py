"""Near-duplicates by SimHash and covering locality-sensitive hashing.

Fingerprints that differ in at most ``radius`` bits are linked. Each bit is given a
vector over two elements of ``radius + 1`` places, and for each vector but zero there
is a mask of the bits whose vector has an odd product with it. The vectors of up to
``radius`` differing bits never span the space, so some mask is orthogonal to all of
them: under that mask the two fingerprints are equal. Every pair within the radius
meets in some table, with certainty.

Equal fingerprints are one row from the start. A bucket with many different ones is
cut again by the masks over the bits it leaves free, and once more if need be; after
that a bucket can't have more rows than its few free bits have values. Within a bucket
only a spanning forest of its links leaves the task, so groups of near copies cost
rows, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import written
from chatprep.llm.components import components

BITS = 64
SEED = 42
SHINGLE = 4
RADIUS = 4
#: Different fingerprints in a bucket from which on it is cut again.
BUCKET = 2048
LEVELS = 3


def fingerprint(sequence: list[str], size: int) -> int:
    """A bit is one if it is set in over half of the hashes of the word shingles."""
    if not sequence:
        return 0
    if len(sequence) <= size:
        shingles = [" ".join(sequence)]
    else:
        shingles = map(" ".join, zip(*(sequence[k:] for k in range(size)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += part.sum(0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * set_bits > len(hashes)))


_BLANKS = " \t\n\v\f\r"
_TO_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_TO_SPACE = {ord(c): " " for c in _BLANKS}


def _split(text: str) -> list[str]:
    return [word for word in text.translate(_TO_SPACE | _TO_LOWER).split(" ") if word]


def fingerprints(docs: DataFrame, text_col: str, size: int = SHINGLE) -> DataFrame:
    """All columns of the input, in place, with ``_fingerprint``, a signed long; null text has none set."""
    columns = docs.columns
    text_at = columns.index(text_col)
    schema = ", ".join([f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema)] + ["fingerprint long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [
                fingerprint(_split(text), size) if text else 0
                for text in (value.as_py() for value in batch.column(text_at))
            ]
            found = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, found], [*(f"c{k}" for k in range(len(columns))), "fingerprint"]
            )

    out = docs.toDF(*[f"c{k}" for k in range(len(columns))]).mapInArrow(run, schema)
    return out.select(
        *[F.col(f"c{k}").alias(name) for k, name in enumerate(columns)], F.col("fingerprint").alias("_fingerprint")
    )


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks over ``bits``; any ``radius`` of the bits are missed by one of them.

    Vectors that begin with one are given out first: then a mask has about half of the
    bits also where there are fewer bits than vectors.
    """
    space = [vector for vector in product((1, 0), repeat=radius + 1) if any(vector)]
    vector_of = {bit: space[k % len(space)] for k, bit in enumerate(bits)}
    return [
        sum(1 << bit for bit, own in vector_of.items() if sum(a & b for a, b in zip(own, way, strict=True)) % 2)
        for way in space
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (a < b) that join what the pairs within the radius join, one fewer than is joined."""
    values = np.sort(values)
    unsigned = values.view(np.uint64)
    group = np.arange(len(values))
    links = []
    for k in range(len(values) - 1):
        near = np.flatnonzero(np.bitwise_count(unsigned[k + 1 :] ^ unsigned[k]) <= radius) + k + 1
        # One link to each group that is not yet joined with this one.
        others, first = np.unique(group[near], return_index=True)
        for other, at in zip(others.tolist(), near[first].tolist(), strict=True):
            if other != group[k]:
                links.append((int(values[k]), int(values[at])))
                group[group == other] = group[k]
    return links


def _keys(fingerprint: Column, masks: list[int]) -> Column:
    """One struct (table, key) for each mask; the key is what the mask leaves of the fingerprint."""
    return F.array(
        *[
            F.struct(F.lit(k).alias("table"), fingerprint.bitwiseAND(F.lit(_signed(mask))).alias("key"))
            for k, mask in enumerate(masks)
        ]
    )


def _links_in(buckets: DataFrame, radius: int) -> DataFrame:
    """Forests of the buckets, given as arrays ``_members``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            members, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
            offsets = offsets - offsets[0]
            found = [
                link
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                for link in _forest(members[a:b], radius)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"]
            )

    return buckets.select("_members").mapInArrow(run, "a long, b long")


def links_within(values: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a < b) whose components are those of all pairs of ``fp`` within the radius.

    ``values`` has distinct longs ``fp``, and is read several times.
    """
    masks = covering_masks(list(range(BITS)), radius)
    rows = values.select("fp", F.explode(_keys(F.col("fp"), masks)).alias("at")).select("fp", "at.table", "at.key")
    keys, links = ["table", "key"], []
    for level in range(LEVELS):
        # Sizes first: only buckets with company are gathered, and only those below the bound.
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
        if level + 1 < LEVELS:
            sizes = written(sizes, "sizes")
            small = sizes.where(F.col("_size") <= bucket)
        else:
            small = sizes
        members = rows.join(small, keys).groupBy(*keys).agg(F.collect_list("fp").alias("_members"))
        links.append(_links_in(members, radius))
        if level + 1 == LEVELS or (large := sizes.where(F.col("_size") > bucket)).isEmpty():
            break
        # What is equal so far stays equal; the masks of the next level cut the other bits.
        rows = rows.join(large.drop("_size"), keys)
        rows = _cut(rows, keys, masks, radius, level)
        keys = [*keys, f"table{level}", f"key{level}"]
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _cut(rows: DataFrame, keys: list[str], masks: list[int], radius: int, level: int) -> DataFrame:
    """Rows of large buckets, once for each mask over the bits that their buckets leave free.

    The free bits are given ranks, and the masks are over ranks, so that they are the
    same plan for every bucket: a key is the fingerprint under the mask of its table.
    """
    if level == 0:
        options = [[m for m in covering_masks(_free(mask), radius)] for mask in masks]
        chosen = F.lit(None).cast("array<bigint>")
        for table, ways in enumerate(options):
            chosen = F.when(F.col("table") == table, _longs(ways)).otherwise(chosen)
        widened = rows.select(*keys, "fp", F.posexplode(chosen).alias("table0", "_mask"))
        return widened.select(*keys, "fp", "table0", F.col("fp").bitwiseAND(F.col("_mask")).alias("key0"))
    chosen = F.lit(None).cast("array<bigint>")
    for table, mask in enumerate(masks):
        inner = F.lit(None).cast("array<bigint>")
        for table0, mask0 in enumerate(covering_masks(_free(mask), radius)):
            inner = F.when(F.col("table0") == table0, _longs(covering_masks(_free(mask | mask0), radius))).otherwise(inner)
        chosen = F.when(F.col("table") == table, inner).otherwise(chosen)
    widened = rows.select(*keys, "fp", F.posexplode(chosen).alias("table1", "_mask"))
    return widened.select(*keys, "fp", "table1", F.col("fp").bitwiseAND(F.col("_mask")).alias("key1"))


def _free(mask: int) -> list[int]:
    return [bit for bit in range(BITS) if not mask >> bit & 1]


def _longs(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(mask)).cast("long") for mask in masks])


def _components(fingerprints: DataFrame, radius: int) -> DataFrame:
    """``fp`` and ``component`` of every fingerprint in a column ``fp``."""
    values = fingerprints.select("fp").distinct()
    found = components(links_within(values, radius))
    labelled = values.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    # The smallest of each component, and those without links, are their own.
    return labelled.select("fp", F.coalesce("component", "fp").alias("component"))


def near_groups(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id among all documents that links reach, the
    document's own included; it is null only where all of them have a null id. A null
    or empty text has fingerprint zero and is linked like any other. Repeated rows
    stay, an empty table gives an empty result, other columns play no part. Texts are
    read whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Long texts are read once: only ids and fingerprints go on.
    rows = written(fingerprints(rows, "text", size).select("id", F.col("_fingerprint").alias("fp")), "fingerprints")
    values = rows.groupBy("fp").agg(F.min("id").alias("_least"))
    labelled = written(values.join(_components(rows, radius), "fp"), "components")
    least = labelled.groupBy("component").agg(F.min("_least").alias("component_id"))
    labels = labelled.join(least, "component").select("fp", "component_id")
    return rows.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_groups(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component of linked documents: the one with the smallest id, all columns kept.

    Where several rows have that id, one of them stays; null ids come last. Clashing
    and further columns, nulls, empty texts and empty tables are as in ``near_groups``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = row_key(F.col(id_col), text)
    # Ids, hashes and fingerprints are written, texts are not.
    rows = fingerprints(docs.select(own.alias("own"), text.alias("text")), "text", size)
    rows = written(rows.select("own", F.col("_fingerprint").alias("fp")), "fingerprints")
    labels = _components(rows, radius)
    best = F.min(F.struct(F.col("own.id").isNull(), "own"))
    # Equal fingerprints first, within the map tasks; then components.
    by_fp = rows.groupBy("fp").agg(best.alias("best")).join(labels, "fp")
    kept = by_fp.groupBy("component").agg(F.min("best").alias("best")).select(F.col("best.own").alias("own"))
    kept = written(kept, "kept")
    # The one shuffle of the texts. Of rows alike in id and text the first stays.
    columns = docs.columns
    every = docs.toDF(*[f"c{k}" for k in range(len(columns))])
    text = F.coalesce(F.col(f"c{columns.index(text_col)}"), F.lit(""))
    every = every.withColumn("own", row_key(F.col(f"c{columns.index(id_col)}"), text))
    stay = every.join(kept.hint("merge"), "own", "left_semi").dropDuplicates(["own"])
    return stay.select(*[F.col(f"c{k}").alias(name) for k, name in enumerate(columns)])


def row_key(name: Column, text: Column) -> Column:
    """What a row is, by id and text: structs compare nulls as equal, a null text is an empty one."""
    return F.struct(name.alias("id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("hash"))
