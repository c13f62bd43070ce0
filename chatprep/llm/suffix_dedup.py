"""Repeated byte strings by column-wise suffix sorting of many documents.

A byte goes if it lies in a string of ``SPAN`` bytes that also starts earlier in the
corpus. Equal strings have the same minimizer: the position in them with the least
hash of ``ANCHOR`` bytes. So every pair of equal strings meets in the class of an
anchor that stands at the same place in both, and only what surrounds anchors that
occur twice has to be compared:

1. The anchors of all texts are grouped by their hash, and within it by the hash of
   all that a string around the anchor can reach, its context. Of equal contexts all
   but the first are covered, and one is left.
2. The different contexts of an anchor are sorted as a collection of short texts. One
   symbol of each is inserted per round, from the right: the order of the suffixes is
   kept, the symbols in that order are the round's column of the collection's
   Burrows-Wheeler transform, and sorting by them stably gives the next order. The
   common prefixes of neighbours are carried along. Neighbours that have ``SPAN``
   symbols in common are equal strings, and all but the earliest of them are covered.

A class with many contexts is cut first: a string reaches so far to the left of its
anchor or so far to the right, so contexts that share it also share what lies between
the nearest such bounds, and meet in a smaller class. Anchors that very many texts have
are counted in a first pass; their occurrences are dealt by context and text.

Inserting whole documents that way would take as many rounds over the corpus as the
longest one has bytes; contexts take a fixed number of rounds. What the external files
of a round are elsewhere, sorted runs of the shuffle are here, read once, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatprep.llm.arrow import bytes_of, slices
from chatprep.llm.common import written
from chatprep.llm.rolling import Ranges

SPAN = 100
ANCHOR = 32
#: Bytes that are worked on at once, and contexts that are sorted at once.
PIECE = 1 << 18
CONTEXTS = 1 << 16
#: Contexts of an anchor from which on its class is cut, and ways in which it is; a part
#: that is still as large has its strings compared by their hashes in a join. A task
#: sorts ``CONTEXTS`` at once in any case, so smaller classes gain nothing by a cut.
CLASS = 1 << 15
CUTS = 8
#: An anchor is frequent that has more occurrences than so many full classes and than
#: one part in ``FREQUENT`` of all. A class of such an anchor is dealt in ``DEALS`` ways.
CLASSES = 2
FREQUENT = 1 << 16
DEALS = 16
#: Contexts whose bytes are put into columns at once.
ROWS = 1 << 12
#: Not a byte of any UTF-8 text.
_PAD = 255


class Sizes:
    """Lengths that follow from the span and the anchor."""

    def __init__(self, span: int, anchor: int) -> None:
        if not 0 < anchor <= span:
            raise ValueError("an anchor has at least one byte and at most those of a span")
        self.span, self.anchor = span, anchor
        #: How far a string that holds the anchor can reach beyond it.
        self.reach = span - anchor
        self.context = anchor + 2 * self.reach


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """Least or largest of each ``size`` neighbours, by doubling."""
    out, done = values, 1
    while 2 * done <= size:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = size - done
    return pick(out[:-rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, Ranges]:
    """Positions in ``data`` that are the minimizer of a string of the span, and their hashes."""
    ranges = Ranges(data)
    hashes = ranges.every(sizes.anchor)
    window = sizes.reach + 1
    if len(hashes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), ranges
    # The high half orders, the whole identifies; equal halves are all taken.
    order = (hashes >> np.uint64(32)).astype(np.uint32)
    least = _sliding(order, window, np.minimum)
    # A position is one if it is as small as the least of some window that has it.
    edge = np.zeros(window - 1, np.uint32)
    best = _sliding(np.concatenate([edge, least, edge]), window, np.maximum)
    at = np.flatnonzero(best == order)
    return at, hashes[at], ranges


def _pieces(ends: np.ndarray, sizes: Sizes) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """Parts of texts to work on together: row, and where the part and its surroundings begin and end."""
    group: list[tuple[int, int, int, int, int]] = []
    waiting, before = 0, 0
    for row, end in enumerate(ends.tolist()):
        n = end - before
        before = end
        if n < sizes.span:
            continue
        for core in range(0, n, PIECE):
            stop = min(core + PIECE, n)
            low, high = max(0, core - sizes.context), min(n, stop + sizes.context)
            if group and waiting + high - low > PIECE:
                yield group
                group, waiting = [], 0
            group.append((row, low, core, stop, high))
            waiting += high - low
    if group:
        yield group


class Frequent:
    """The most frequent of many values, in bounded memory.

    A value that is one part in ``size`` of all is among ``counts``; a count is short by
    at most that part.
    """

    def __init__(self, size: int) -> None:
        self._size = size
        self._values, self._times = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._waiting: list[np.ndarray] = []
        self._held, self.total = 0, 0

    def add(self, values: np.ndarray) -> None:
        self._waiting.append(values)
        self._held += len(values)
        self.total += len(values)
        if self._held >= 8 * self._size:
            self._merge()

    def _merge(self) -> None:
        values, times = np.unique(np.concatenate([*self._waiting, np.empty(0, np.uint64)]), return_counts=True)
        self._waiting, self._held = [], 0
        every, at = np.unique(np.concatenate([self._values, values]), return_inverse=True)
        sums = np.zeros(len(every), np.int64)
        np.add.at(sums, at, np.concatenate([self._times, times]))
        if len(every) > self._size:
            # What is taken from one is taken from each of the more frequent ones.
            sums -= np.partition(sums, len(sums) - self._size - 1)[len(sums) - self._size - 1]
        self._values, self._times = every[sums > 0], sums[sums > 0]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Values and counts, without those that are too rare to matter."""
        self._merge()
        some = self._times > self.total // self._size
        return self._values[some], self._times[some]


def _frequent(texts: DataFrame, sizes: Sizes, largest: int, part: int) -> DataFrame:
    """``anchor`` and ``_hot``, true: at most ``part`` anchors that occur very often in the texts (key, id, text).

    What is found only decides how the occurrences are dealt, never what is covered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = Frequent(part)
        for batch in slices(batches, 0, 8 * PIECE):
            data, ends = bytes_of(batch.column(0))
            begins = np.concatenate([[0], ends[:-1]])
            for group in _pieces(ends, sizes):
                parts = [data[begins[row] + low : begins[row] + high] for row, low, _, _, high in group]
                counted.add(anchors(np.concatenate(parts), sizes)[1])
        values, times = counted.counts()
        names = pa.array([*values.view(np.int64).tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([names, pa.array([*times.tolist(), counted.total], pa.int64())], ["anchor", "times"])

    counts = texts.select("text").mapInArrow(run, "anchor long, times long")
    # A row for each task and frequent anchor, then one for each anchor; the one without is all.
    counts = written(counts.groupBy("anchor").agg(F.sum("times").alias("times")), "anchors")
    total = counts.where("anchor is null").agg(F.max("times")).first()[0] or 0
    least = max(CLASSES * largest, total // part)
    return counts.where(F.col("anchor").isNotNull() & (F.col("times") > least)).select("anchor", F.lit(True).alias("_hot"))


def _seen_before(row: np.ndarray, hashes: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Whether an anchor with the same context stands further left in the same part of a text."""
    order = np.lexsort((contexts, hashes, row))
    same = np.ones(max(len(order) - 1, 0), bool)
    for values in (row, hashes, contexts):
        same &= values[order[1:]] == values[order[:-1]]
    out = np.zeros(len(order), bool)
    # The sort is stable: of equal ones, the leftmost comes first.
    out[order[1:][same]] = True
    return out


def _occurrences(texts: DataFrame, sizes: Sizes) -> DataFrame:
    """Each anchor of a text (key, id, text): its hash, the hash of its context, and where it stands.

    A place below zero, -1 - ``at``, marks those that are known to be covered, since
    their context stands further left in the same text. They need no class, so that a
    line that a text repeats over and over is one row in its anchor's class.
    """
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 8 * PIECE):
            data, ends = bytes_of(batch.column(2))
            begins = np.concatenate([[0], ends[:-1]])
            for group in _pieces(ends, sizes):
                parts = [data[begins[row] + low : begins[row] + high] for row, low, _, _, high in group]
                lengths = np.array([len(part) for part in parts])
                firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                at, hashes, ranges = anchors(np.concatenate(parts), sizes)
                part = np.searchsorted(firsts, at, "right") - 1
                rows, lows, cores, stops, highs = np.array(group, np.int64).T
                place = at - firsts[part] + lows[part]
                inside = (place >= cores[part]) & (place < stops[part]) & (place + sizes.anchor <= highs[part])
                at, hashes, part, place = at[inside], hashes[inside], part[inside], place[inside]
                whole = (ends - begins)[rows[part]]
                left = np.minimum(place, sizes.reach)
                right = np.minimum(whole - place - sizes.anchor, sizes.reach)
                contexts = ranges(at - left, at + sizes.anchor + right)
                # Where a text ends, a context is shorter, and another one than a longer one.
                contexts ^= (left * (sizes.context + 1) + right).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                again = _seen_before(part, hashes, contexts)
                # Each in a class of its own.
                alone = (hashes ^ ((place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) ^ contexts
                hashes = np.where(again, alone, hashes)
                taken = pa.array(rows[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        pa.array(contexts.view(np.int64)),
                        batch.column(1).take(taken),
                        batch.column(0).take(taken),
                        pa.array(np.where(again, -1 - place, place).astype(np.int32)),
                    ],
                    ["anchor", "context", "id", "key", "at"],
                )

    return texts.mapInArrow(run, f"anchor long, context long, id {id_type}, key binary, at int")


def _contexts(wanted: DataFrame, sizes: Sizes) -> DataFrame:
    """The bytes around each wanted anchor (key, id, text, places: array of (anchor, at))."""
    id_type = wanted.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 8 * PIECE):
            data, ends = bytes_of(batch.column(2))
            begins = np.concatenate([[0], ends[:-1]])
            places = batch.column(3)
            counts = np.diff(places.offsets.to_numpy())
            flat = places.flatten()
            row = np.repeat(np.arange(len(batch)), counts)
            at = flat.field("at").to_numpy().astype(np.int64)
            left = np.minimum(at, sizes.reach)
            low = begins[row] + at - left
            high = begins[row] + np.minimum(at + sizes.anchor + sizes.reach, (ends - begins)[row])
            raw = data.tobytes()
            found = [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("anchor"),
                    batch.column(1).take(taken),
                    batch.column(0).take(taken),
                    pa.array(at.astype(np.int32)),
                    pa.array(left.astype(np.int32)),
                    pa.array(found, pa.binary()),
                ],
                ["anchor", "id", "key", "at", "left", "bytes"],
            )

    return wanted.mapInArrow(run, f"anchor long, id {id_type}, key binary, at int, left int, bytes binary")


class Collection:
    """Suffixes of texts of one length, in order, with the common prefixes of neighbours.

    ``columns`` has a row for each column of the texts. ``insert`` adds the symbols of
    one column on the left of all suffixes.
    """

    def __init__(self, columns: np.ndarray) -> None:
        self._columns = columns
        n = columns.shape[1]
        self.order = np.arange(n)
        #: Entry k: what the suffixes k - 1 and k have in common. Empty suffixes, nothing.
        self.common = np.zeros(n, np.int32)

    def insert(self, column: int) -> np.ndarray:
        """The column's symbols in the order so far, its part of the transform."""
        symbols = self._columns[column][self.order]
        moved = np.argsort(symbols, kind="stable")
        ordered = symbols[moved]
        same = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
        common = np.zeros(len(moved), np.int32)
        if len(same):
            # New neighbours with one symbol: it, and the least that stood between them.
            ends = np.column_stack([moved[same - 1] + 1, moved[same] + 1]).ravel()
            padded = np.append(self.common, np.int32(0))
            common[same] = np.minimum.reduceat(padded, ends)[::2] + 1
        self.order, self.common = self.order[moved], common
        return symbols


def covered_spans(matrix: np.ndarray, valid: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """First and last start, as columns, of strings that an earlier row has at the same column.

    Rows are contexts in order of their occurrence, ``valid`` the first and last column
    that a string may start at. The last is below the first where there is none.
    """
    n = len(matrix)
    first, last = np.full(n, sizes.context, np.int64), np.full(n, -1, np.int64)
    suffixes = Collection(np.ascontiguousarray(matrix.T))
    for column in range(sizes.context - 1, -1, -1):
        suffixes.insert(column)
        if column > sizes.reach:
            continue
        heads = np.flatnonzero(np.append(True, suffixes.common[1:] < sizes.span))
        if len(heads) == n:
            continue
        earliest = np.minimum.reduceat(suffixes.order, heads)
        group = np.zeros(n, np.int64)
        group[heads[1:]] = 1
        rows = suffixes.order[suffixes.order != earliest[np.cumsum(group)]]
        rows = rows[(valid[rows, 0] <= column) & (column <= valid[rows, 1])]
        first[rows] = column
        last[rows] = np.maximum(last[rows], column)
    return first, last


def _compare(batch: pa.Table, sizes: Sizes) -> pa.RecordBatch:
    """Covered parts of the contexts of whole classes."""
    order = pc.sort_indices(
        batch, [("id", "ascending"), ("key", "ascending"), ("at", "ascending")], null_placement="at_end"
    )
    batch = batch.take(order).combine_chunks()
    at = batch.column("at").to_numpy().astype(np.int64)
    left = batch.column("left").to_numpy().astype(np.int64)
    found = batch.column("bytes").to_pylist()
    lengths = np.array([len(each) for each in found])
    # Contexts stand with their anchors below each other.
    matrix = np.full((len(found), sizes.context), _PAD, np.uint8)
    for begin in range(0, len(found), ROWS):
        size = lengths[begin : begin + ROWS]
        flat = np.frombuffer(b"".join(found[begin : begin + ROWS]), np.uint8)
        row = np.repeat(np.arange(begin, begin + len(size)), size)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + (sizes.reach - left)[row]
        matrix[row, column] = flat
    valid = np.column_stack([sizes.reach - left, sizes.reach - left + lengths - sizes.span])
    first, last = covered_spans(matrix, valid, sizes)
    some = np.flatnonzero(last >= first)
    start = (at - sizes.reach)[some]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("key").combine_chunks().take(pa.array(some)),
            pa.array((start + first[some]).astype(np.int32)),
            pa.array((start + last[some] + sizes.span).astype(np.int32)),
        ],
        ["key", "start", "stop"],
    )


def _sorted_classes(contexts: DataFrame, sizes: Sizes) -> DataFrame:
    """Covered parts, class by class; a class ends up in one task, in bounded numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += len(batch)
            if waiting < CONTEXTS:
                continue
            # The last class may go on in the next batch.
            table = pa.Table.from_batches(held)
            names = table.column("anchor").to_numpy()
            whole = int(np.searchsorted(names, names[-1], "left"))
            if whole:
                yield _compare(table.slice(0, whole), sizes)
                held = table.slice(whole).to_batches()
                waiting = len(table) - whole
        if waiting:
            yield _compare(pa.Table.from_batches(held), sizes)

    rows = contexts.repartition("anchor").sortWithinPartitions("anchor")
    return rows.select("anchor", "id", "key", "at", "left", "bytes").mapInArrow(run, "key binary, start int, stop int")


def _cut_classes(contexts: DataFrame, sizes: Sizes, ways: int) -> DataFrame:
    """Each context once for each way in which a string can lie around its anchor.

    A string begins ``low`` to ``high`` bytes before the anchor, so it holds the ``low``
    bytes before it and those after it that even the furthest start leaves. The hash of
    these is the class, still named ``anchor``; two that meet by chance do no harm, since
    bytes are compared. Of the bytes those go on that such a string can reach: no string
    is in two ways, and an occurrence never meets itself.
    """
    ways = min(ways, sizes.reach + 1)
    edges = [k * (sizes.reach + 1) // ways for k in range(ways + 1)]
    way = F.explode(
        F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b - 1).alias("high")) for a, b in zip(edges, edges[1:], strict=False)])
    )
    rows = contexts.select("id", "key", "at", "left", "bytes", way.alias("_way"))
    after = sizes.reach - F.col("_way.high")
    right = F.length("bytes") - F.col("left") - sizes.anchor
    rows = rows.where((F.col("left") >= F.col("_way.low")) & (right >= after))
    shared = F.substring("bytes", F.col("left") - F.col("_way.low") + 1, F.col("_way.low") + sizes.anchor + after)
    left = F.least("left", "_way.high")
    reached = left + sizes.anchor + F.least(right, sizes.reach - F.col("_way.low"))
    return rows.select(
        F.xxhash64("_way.low", shared).alias("anchor"),
        "id",
        "key",
        "at",
        left.alias("left"),
        F.substring("bytes", F.col("left") - left + 1, reached).alias("bytes"),
    )


def _large_classes(contexts: DataFrame, sizes: Sizes, largest: int) -> DataFrame:
    """Covered parts of classes with many contexts, cut to smaller ones."""
    rows = _cut_classes(contexts, sizes, CUTS)
    # Sums before the shuffle; a class of its own compares with nothing.
    company = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    rows = rows.join(company, "anchor")
    return _sorted_classes(rows.where(F.col("_size") <= largest), sizes).unionByName(
        _joined_classes(rows.where(F.col("_size") > largest), sizes)
    )


def _joined_classes(contexts: DataFrame, sizes: Sizes) -> DataFrame:
    """Covered parts of classes that are large when cut: strings by their hash, the earliest found by aggregation."""
    starts = F.sequence(F.lit(0), F.length("bytes") - sizes.span)
    rows = contexts.where(F.length("bytes") >= sizes.span).select("*", F.explode(starts).alias("_n"))
    string = F.sha2(F.substring("bytes", F.col("_n") + 1, sizes.span), 256)
    start = F.col("at") - F.col("left") + F.col("_n")
    place = F.struct(F.col("id").isNull(), "id", "key", start.alias("start"))
    rows = rows.select(string.alias("_string"), "key", start.alias("start"), place.alias("_place"))
    first = rows.groupBy("_string").agg(F.min("_place").alias("_first"))
    late = rows.join(first, "_string").where(F.col("_place") > F.col("_first"))
    return late.select("key", "start", (F.col("start") + sizes.span).cast("int").alias("stop"))


def _kept(texts: DataFrame) -> DataFrame:
    """What is left of each text (key, id, text, starts, stops): sizes and the hash of the rest."""
    id_type = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 8 * PIECE):
            data, ends = bytes_of(batch.column(2))
            before, out, rests = 0, [], []
            for row, end in enumerate(ends.tolist()):
                text = data[before:end].tobytes()
                spans = merged(batch.column(3)[row].as_py(), batch.column(4)[row].as_py())
                rest, at = hashlib.sha256(), 0
                kept = []
                for start, stop in spans:
                    kept.append(text[at:start])
                    at = stop
                kept.append(text[at:])
                for part in kept:
                    rest.update(part)
                out.append((len(text), sum(b - a for a, b in spans), len(spans), spans))
                rests.append(rest.hexdigest())
                before = end
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    *[pa.array([row[k] for row in out], pa.int64()) for k in range(3)],
                    pa.array(rests, pa.string()),
                    pa.array([[{"start": a, "stop": b} for a, b in row[3]] for row in out], _SPANS),
                ],
                ["key", "first", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return texts.mapInArrow(
        run,
        f"key binary, first {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start:int,stop:int>>",
    )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def merged(starts: list[int] | None, stops: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(zip(starts or [], stops or [], strict=True)):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = (out[-1][0], stop)
        else:
            out.append((start, stop))
    return out


def remove_repeats(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    span: int = SPAN,
    anchor: int = ANCHOR,
    largest: int = CLASS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans``.

    Texts are UTF-8 bytes; null is empty. A byte is removed if a string of ``span``
    bytes of its text covers it that also starts earlier, in a text with a smaller id
    or further left in the same text. ``spans`` are the maximal removed runs, by byte.
    Null ids come last. Texts with the same id follow each other by their hash; of
    rows alike in id and text one comes first, the others are copies of it. An empty
    table gives an empty result, other columns play no part, texts are read whole.
    """
    sizes = Sizes(span, anchor)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Never null, and known not to be: else joins would filter some uses of the texts
    # and not others, and the shuffle would not be shared.
    key = F.coalesce(F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), key.alias("key"))
    # Copies of a text are one row from here on. All that follows hangs on this one
    # shuffle of the texts: each use of them joins by the same key.
    place = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("place")
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), place)
    texts = texts.select("key", F.col("place.id").alias("id"), "text")

    # At most ``frequent`` rows. Their classes are dealt by context, and a context by text:
    # the first of each part goes on, and of these again the earliest covers the rest.
    hot = _frequent(rows, sizes, largest, frequent)
    found = _occurrences(texts, sizes)
    deal = F.when(F.col("_hot"), F.xxhash64("context", F.pmod(F.xxhash64("key"), F.lit(DEALS))))
    found = found.join(F.broadcast(hot), "anchor", "left").select(*found.columns, deal.alias("_deal"))
    is_hot = F.col("_deal").isNotNull()
    in_class = Window.partitionBy("anchor", "_deal")
    in_order = in_class.orderBy("context", F.asc_nulls_last("id"), "key", "at")
    found = found.select(
        "*", F.lag("context").over(in_order).alias("_before"), F.max("context").over(in_class).alias("_last")
    )
    # Another occurrence of the same context is covered by the first as far as a string reaches.
    again = (F.col("at") < 0) | F.coalesce(F.col("_before") == F.col("context"), F.lit(False))
    alone = ~is_hot & F.col("_before").isNull() & (F.col("_last") == F.col("context"))
    found = found.withColumn("_again", again).withColumn("_alone", alone)
    size = F.count(F.when(~F.col("_again"), True)).over(in_class)
    found = found.withColumn("_large", is_hot | (size > largest)).where("_again or not _alone")
    place = F.struct(
        F.when(~F.col("_again"), F.col("anchor")).alias("anchor"),
        F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("at"),
        F.when(~F.col("_again"), F.col("_large")).alias("large"),
    )
    # All uses of the places are of this one table, so that classes are sorted once.
    places = found.groupBy("key").agg(F.collect_list(place).alias("places"))
    placed = texts.join(places, "key", "left").select("key", "id", "text", "places")

    def wanted(large: bool) -> DataFrame:
        """Contexts of the classes that are large, or of all others; a covered place is in no class."""
        chosen = F.filter("places", lambda p: p["large"] == F.lit(large))
        chosen = F.transform(chosen, lambda p: F.struct(p["anchor"].alias("anchor"), p["at"].alias("at")))
        some = placed.select("key", "id", "text", chosen.alias("chosen")).where(F.size("chosen") > 0)
        return _contexts(some, sizes)

    spans = _sorted_classes(wanted(False), sizes).unionByName(_large_classes(wanted(True), sizes, largest))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    covered = F.filter("places", lambda p: p["large"].isNull())
    whole = F.transform(
        covered,
        lambda p: F.struct(
            F.greatest(p["at"] - sizes.reach, F.lit(0)).alias("start"),
            F.least(p["at"] + sizes.anchor + sizes.reach, F.octet_length("text")).alias("stop"),
        ),
    )
    none = F.array().cast("array<struct<start:int,stop:int>>")
    every = F.concat(F.coalesce(whole, none), F.coalesce("spans", none))
    ends = placed.join(spans, "key", "left")
    ends = ends.select("key", "id", "text", every.alias("spans"))
    kept = _kept(
        ends.select("key", "id", "text", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    )
    # All but the first row of a text are covered whole, if a string fits in at all.
    each = rows.groupBy("key", "id").agg(F.count(F.lit(1)).alias("rows"))
    each = each.join(kept, "key").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    copy = (F.col("n_bytes") >= span) & ~((F.col("row") == 1) & F.col("id").eqNullSafe(F.col("first")))
    nothing = hashlib.sha256().hexdigest()
    all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("stop")))
    return each.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, all_of_it).otherwise(F.col("spans")).alias("spans"),
    )
