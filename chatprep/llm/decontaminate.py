"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so containment is what counts: the share of
an item's five-word shingles that a document has. Items are partitioned by their
number of shingles. Each partition has a sketch size: one more shingle than an item of
the partition may miss at the threshold. A document that contains an item misses too few
shingles to miss the whole sketch, whichever shingles it has, so it shares a sketch value
with the item for certain. A sketch has the shingles with the least hashes, of those that
few documents have: by powers of two of their number, so that a phrase that very many
documents share is in no sketch while an item has rarer ones. Only the candidates found
that way are verified, by counting their items' shingles in the document exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.arrow import bytes_of, slices
from chatprep.llm.common import written
from chatprep.llm.rolling import Ranges, spread

SHINGLE = 5
THRESHOLD = 0.8
#: Bits of the filter that documents' shingles pass before they leave a task: 4 MB,
#: whatever the number of items. More items let more shingles through.
FILTER_BITS = 1 << 25
#: Bytes that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 21
_MULTIPLIER = 0xD6E8FEB86659FD93


def _word_bytes() -> np.ndarray:
    """Letters and digits, and all bytes of characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
    table[128:] = True
    return table


_IS_WORD = _word_bytes()


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


_LOWER = _lowered()


class Shingles:
    """The shingles of several texts, given as one array of bytes and the texts' ends in it."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, size: int) -> None:
        self.data = _LOWER[data]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _IS_WORD[data]
        change = np.diff(inside.astype(np.int8))
        self.starts, self.ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        # A word ends with its text.
        cuts = ends[:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]]) if len(cuts) else cuts
        if len(cuts):
            self.starts = np.sort(np.concatenate([self.starts, cuts]))
            self.ends = np.sort(np.concatenate([self.ends, cuts]))
        owner = np.searchsorted(ends, self.starts, "right")
        last = len(self.starts) - size
        words = Ranges(self.data)(self.starts, self.ends) if last >= 0 else np.empty(0, np.uint64)
        if last < 0:
            self.first, self.owner, self.hashes = (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
            return
        out = words[: last + 1].copy()
        for k in range(1, size):
            out *= np.uint64(_MULTIPLIER)
            out += words[k : last + 1 + k]
        whole = np.flatnonzero(owner[: last + 1] == owner[size - 1 :])
        self.first, self.owner, self.hashes = whole, owner[whole], spread(out[whole])
        self._size = size

    def text(self, at: int) -> str:
        words = range(self.first[at], self.first[at] + self._size)
        return " ".join(self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace") for k in words)


def _passing(rows: DataFrame, size: int, bits: np.ndarray | None) -> DataFrame:
    """``id``, ``hash`` and ``shingle`` of each different shingle of a row (id, text) that passes the filter."""
    id_type = rows.schema["id"].dataType.simpleString()
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared is not None else None
        for batch in slices(batches, 1, SLICE_BYTES):
            data, ends = bytes_of(batch.column(1))
            found = Shingles(data, ends, size)
            at = np.arange(len(found.hashes))
            if wanted is not None:
                place = found.hashes & np.uint64(FILTER_BITS - 1)
                mask = np.left_shift(np.uint8(1), (place & np.uint64(7)).astype(np.uint8))
                at = np.flatnonzero(wanted[(place >> np.uint64(3)).astype(np.intp)] & mask)
            order = np.lexsort((found.hashes[at], found.owner[at]))
            at = at[order]
            if len(at):
                same = (found.hashes[at][1:] == found.hashes[at][:-1]) & (found.owner[at][1:] == found.owner[at][:-1])
                at = at[np.concatenate([[True], ~same])]
            ids = batch.column(0).take(pa.array(found.owner[at]))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(found.hashes[at].view(np.int64)), pa.array([found.text(k) for k in at], pa.string())],
                ["id", "hash", "shingle"],
            )

    return rows.mapInArrow(run, f"id {id_type}, hash long, shingle string")


def _filter_bits(shingles: DataFrame) -> np.ndarray:
    """The filter of the items' shingles. Its words of 64 bits are all that comes to the driver."""
    place = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    word = F.shiftrightunsigned(place, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    # At most FILTER_BITS / 64 rows.
    rows = shingles.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def least_shared(n: Column, threshold: float) -> Column:
    """Shingles that must be shared of ``n``."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("long")


def sketch_size(part: int, threshold: float) -> int:
    """Of items with 2 ** part to 2 ** (part + 1) - 1 shingles: one more than any of them may miss."""
    most = 2 ** (part + 1) - 1
    return max(n - math.ceil(n * threshold - 1e-9) + 1 for n in range(2**part, most + 1)) if part < 12 else math.floor(
        most * (1 - threshold)
    ) + 2


def item_shingles(rows: DataFrame, size: int) -> DataFrame:
    """``item``, ``hash``, ``shingle`` and ``n_shingles`` of each different shingle of rows (id, text)."""
    found = _passing(rows, size, None).distinct()
    counts = found.groupBy(F.col("id").alias("item")).agg(F.count(F.lit(1)).alias("n_shingles"))
    return found.join(counts, F.col("id").eqNullSafe(F.col("item"))).drop("id")


def _sketches(wanted: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """``item`` and ``shingle`` of each item's sketch: the rarest of its shingles, and of those the least hashes."""
    part = F.floor(F.log2("n_shingles")).cast("int")
    # Items have at most 2 ** 31 words.
    most = F.element_at(F.array(*[F.lit(sketch_size(k, threshold)) for k in range(31)]), part + 1)
    held = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("_docs"))
    ranked = wanted.join(held, "shingle", "left").withColumn("most", most)
    rarity = F.ceil(F.log2(F.coalesce("_docs", F.lit(0)) + 1)).alias("rarity")
    ranked = ranked.groupBy("item", "most").agg(
        F.sort_array(F.collect_list(F.struct(rarity, F.xxhash64("shingle").alias("order"), "shingle"))).alias("all")
    )
    return ranked.select("item", F.explode(F.slice("all", F.lit(1), F.col("most"))).alias("s")).select("item", "s.shingle")


def contained_items(
    docs: DataFrame,
    doc_id: str,
    doc_text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    size: int = SHINGLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each document and item that it contains: ids, ``n_shingles``, ``n_shared``, ``containment``.

    ``n_shingles`` counts the item's different shingles, ``n_shared`` those of them that
    the document has. Words are runs of letters, digits and characters beyond ASCII,
    A-Z lower-cased. An item with fewer than ``size`` words has no shingle and is
    found nowhere; neither is a null or empty one. A null document contains nothing.
    Documents or items with the same id, null included, are taken as one, with the
    shingles of all. Empty tables give an empty result, other columns play no part,
    documents are read whole.
    """
    doc_rows = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("text"))
    item_rows = items.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    wanted = written(item_shingles(item_rows, size), "items")
    hits = written(_passing(doc_rows, size, _filter_bits(wanted)).distinct(), "hits")
    hits = hits.select(F.col("id").alias("doc"), "shingle")
    sketches = written(_sketches(wanted, hits, threshold), "sketches")
    candidates = written(hits.join(sketches, "shingle").select("doc", "item").distinct(), "candidates")

    # Verified are candidates alone: their items' shingles, looked up among the document's.
    asked = candidates.withColumnRenamed("item", "_item").join(
        wanted.select("item", "shingle", "n_shingles"), F.col("_item").eqNullSafe(F.col("item"))
    )
    there = hits.toDF("_doc", "_shingle")
    shared = asked.join(
        there, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("shingle") == F.col("_shingle")), "left_semi"
    )
    shared = shared.groupBy("doc", "item", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"))
    found = shared.where(F.col("n_shared") >= least_shared(F.col("n_shingles"), threshold))
    return found.select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        "n_shingles",
        "n_shared",
        (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
    )
