"""Token counts and packing of samples into blocks of a fixed length."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatprep.functions.text import token_count
from chatprep.operators.running import running_totals
from chatprep.operators.split import shuffle_hash
from chatprep.rules import MAX_SEQUENCE, SPLIT_SEED
from chatprep.session import written

CHUNK_DIGITS = 4


def count_tokens(
    df: DataFrame,
    text_col: str = "text",
    tokenizer: Callable[[str], list] | None = None,
) -> DataFrame:
    """Add ``n_tokens``: runs without white space, or the length of ``tokenizer(text)``.

    The default is a stand-in, since a model's tokenizer is a file of its own. A
    tokenizer runs in Python over Arrow batches.
    """
    if tokenizer is None:
        return df.withColumn("n_tokens", token_count(F.col(text_col)))

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda text: None if text is None else len(tokenizer(text)))

    return df.withColumn("n_tokens", lengths(F.col(text_col)))


def pack_sequences(
    samples: DataFrame,
    key: str,
    max_len: int = MAX_SEQUENCE,
    shards: int = 1,
    seed: int = SPLIT_SEED,
    carry: str | None = None,
) -> DataFrame:
    """Pieces of samples that fill blocks of ``max_len`` tokens.

    ``samples`` holds the key and ``n_tokens``. Each shard is one stream of samples
    in seeded order, cut every ``max_len`` tokens, so that only its last block is
    short. One row per sample and block: where the piece starts in the sample
    (``sample_from``), where in the block (``block_from``), and its tokens. The
    stream is numbered by hash ranges, 65,536 per shard, so one shard is no
    bottleneck. Samples without tokens have no piece. ``carry`` names a column of the
    samples that each piece keeps.
    """
    more = [carry] if carry else []
    hashed = shuffle_hash(F.col(key), seed)
    rows = samples.select(
        F.pmod(F.col(key), F.lit(shards)).alias("shard"), key, hashed.alias("hash"), "n_tokens", *more
    )
    chunk = F.substring("hash", 1, CHUNK_DIGITS)
    placed = running_totals(rows, ["shard"], ["hash", key], chunk, {"end": F.col("n_tokens")})
    placed = placed.where(F.col("n_tokens") > 0)
    begin = F.col("end") - F.col("n_tokens")
    blocks = F.expr(f"explode(sequence(begin div {max_len}, (end - 1) div {max_len}))")
    pieces = placed.withColumn("begin", begin).select("shard", key, "begin", "end", *more, blocks.alias("block"))
    block_start = F.col("block") * max_len
    start = F.greatest("begin", block_start)
    stop = F.least("end", block_start + max_len)
    return pieces.select(
        "shard",
        "block",
        key,
        (start - F.col("begin")).alias("sample_from"),
        (start - block_start).alias("block_from"),
        (stop - start).alias("n_tokens"),
        *more,
    )


def pack_fill(pieces: DataFrame, max_len: int = MAX_SEQUENCE) -> DataFrame:
    """Samples and tokens of each block, and the share of it that is filled."""
    return (
        pieces.groupBy("shard", "block")
        .agg(F.count("*").alias("n_samples"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("fill", F.col("n_tokens") / F.lit(max_len))
    )


def pack_tokens(
    samples: DataFrame, key: str, max_len: int = MAX_SEQUENCE, shards: int = 1, seed: int = SPLIT_SEED
) -> DataFrame:
    """The tokens of each block: shard, block, tokens.

    ``samples`` holds the key and an array ``tokens``, read once: tokens travel with
    the row that is given a place, pieces are cut there, and only cut pieces go on to
    their block. A block collects at most ``max_len`` tokens.
    """
    sized = samples.select(key, "tokens", F.size("tokens").cast("long").alias("n_tokens"))
    pieces = pack_sequences(sized, key, max_len, shards, seed, carry="tokens")
    part = F.slice("tokens", (F.col("sample_from") + 1).cast("int"), F.col("n_tokens").cast("int"))
    return _joined(pieces.select("shard", "block", F.struct("block_from", part.alias("tokens")).alias("piece")))


def _joined(pieces: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list("piece"))
    return pieces.groupBy("shard", "block").agg(
        F.flatten(F.transform(ordered, lambda piece: piece["tokens"])).alias("tokens")
    )


def fill_blocks(pieces: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """The tokens of blocks whose pieces are given; ``pack_tokens`` makes both at once.

    ``samples`` holds the key and an array ``tokens``, of the length that
    ``n_tokens`` had. A block collects at most ``max_len`` tokens.
    """
    part = F.slice("tokens", F.col("sample_from") + 1, F.col("n_tokens"))
    joined = pieces.join(samples.select(key, "tokens"), key)
    return _joined(joined.select("shard", "block", F.struct("block_from", part.alias("tokens")).alias("piece")))


class Room:
    """Blocks by what is free in them: runs of block numbers, and the least room that is enough."""

    def __init__(self) -> None:
        self._sizes: list[int] = []
        self._runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, size: int, first: int, stop: int) -> None:
        if size > 0 and first < stop:
            if size not in self._runs:
                self._runs[size] = []
                insort(self._sizes, size)
            heappush(self._runs[size], (first, stop))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """The lowest run of blocks with the smallest room that is enough, which is then gone."""
        at = bisect_left(self._sizes, least)
        if at == len(self._sizes):
            return None
        size = self._sizes[at]
        run = heappop(self._runs[size])
        if not self._runs[size]:
            del self._runs[size]
            self._sizes.pop(at)
        return size, *run


def best_fit(counts: list[tuple[int, int]], max_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places of samples, given how many there are of each length.

    The longest come first, and each goes where it leaves the least room (of equal ones
    the lowest block), else into a new block. Samples of one length are alike, so whole
    runs of blocks are filled at once: the work grows with the lengths, not the samples.
    Rows are (length, first rank, rank behind the last, samples of it in a block, first
    block, place of the first one in the block).
    """
    room, places, blocks = Room(), [], 0
    for length, count in sorted(counts, reverse=True):
        rank = 0
        while rank < count:
            found = room.take(length)
            if found is None:
                needed = -(-(count - rank) // (max_len // length))
                found, blocks = (max_len, blocks, blocks + needed), blocks + needed
            size, first, stop = found
            each = size // length
            used = min(count - rank, each * (stop - first))
            places.append((length, rank, rank + used, each, first, max_len - size))
            full, part = divmod(used, each)
            room.put(size - each * length, first, first + full)
            if part:
                room.put(size - part * length, first + full, first + full + 1)
            room.put(size, first + full + bool(part), stop)
            rank += used
    return places


PLACES = "_length long, _from long, _to long, _each long, _first long, _start long"


def pack_whole(
    samples: DataFrame, key: str, max_len: int = MAX_SEQUENCE, seed: int = SPLIT_SEED, carry: str | None = None
) -> DataFrame:
    """Samples in blocks of at most ``max_len`` tokens, none cut: key, ``n_tokens``, ``block``, ``block_from``.

    Best fit, the longest first, see ``best_fit``. Only the number of samples of each
    length, ``max_len`` rows at most, comes to the driver. Samples of one length are
    ranked in seeded order, by hash ranges, and a rank says the block and the place in
    it; a length that very many samples have is no bottleneck. Samples that are longer
    than a block, have no tokens or no length, or no key, have a null block. ``carry``
    names a column that is kept.
    """
    more = [carry] if carry else []
    rows = samples.select(key, F.col("n_tokens").cast("long").alias("n_tokens"), *more)
    if not more:
        # Two numbers a row, read several times.
        rows = written(rows, "lengths")
    fits = F.col(key).isNotNull() & F.coalesce(F.col("n_tokens").between(1, max_len), F.lit(False))
    there = rows.where(fits)
    counts = there.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()
    places = samples.sparkSession.createDataFrame(best_fit([tuple(row) for row in counts], max_len), PLACES)
    hashed = there.withColumn("_hash", shuffle_hash(F.col(key), seed))
    chunk = F.substring("_hash", 1, CHUNK_DIGITS)
    ranked = running_totals(hashed, ["n_tokens"], ["_hash", key], chunk, {"_rank": F.lit(1)})
    rank = F.col("_rank") - 1
    at = rank - F.col("_from")
    found = ranked.join(
        places, (F.col("n_tokens") == F.col("_length")) & (rank >= F.col("_from")) & (rank < F.col("_to"))
    ).select(
        key,
        "n_tokens",
        (F.col("_first") + F.floor(at / F.col("_each"))).alias("block"),
        (F.col("_start") + at % F.col("_each") * F.col("n_tokens")).alias("block_from"),
        *more,
    )
    none = F.lit(None).cast("long")
    return found.unionByName(
        rows.where(~fits).select(key, "n_tokens", none.alias("block"), none.alias("block_from"), *more)
    )


def whole_fill(placed: DataFrame, max_len: int = MAX_SEQUENCE) -> DataFrame:
    """Samples and tokens of each block of ``pack_whole``, and the share of it that is filled."""
    return (
        placed.where(F.col("block").isNotNull())
        .groupBy("block")
        .agg(F.count("*").alias("n_samples"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("fill", F.col("n_tokens") / F.lit(max_len))
    )


def whole_tokens(samples: DataFrame, key: str, max_len: int = MAX_SEQUENCE, seed: int = SPLIT_SEED) -> DataFrame:
    """The tokens of each block, samples whole, and where its samples end: block, tokens, ends.

    ``samples`` holds the key and an array ``tokens``, which travels with the row that is
    given a place. A block collects at most ``max_len`` tokens.
    """
    sized = samples.select(key, "tokens", F.size("tokens").cast("long").alias("n_tokens"))
    placed = pack_whole(sized, key, max_len, seed, carry="tokens").where(F.col("block").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("block_from", "n_tokens", "tokens")))
    return placed.groupBy("block").agg(ordered.alias("_s")).select(
        "block",
        F.flatten(F.transform("_s", lambda s: s["tokens"])).alias("tokens"),
        F.transform("_s", lambda s: s["block_from"] + s["n_tokens"]).alias("ends"),
    )


def length_report(samples: DataFrame, max_len: int = MAX_SEQUENCE) -> DataFrame:
    """Lengths of samples, how many pass the limit, and what packing saves.

    Unpacked, a sample takes as many blocks as its length needs; packed, all
    tokens share blocks.
    """
    length = F.lit(max_len)
    # Exact: the first length with at least half of the samples up to it. One row per length.
    counted = samples.where(F.col("n_tokens").isNotNull()).groupBy("n_tokens").agg(F.count("*").alias("n"))
    counted = counted.withColumn("upto", F.sum("n").over(Window.orderBy("n_tokens")))
    half = samples.agg((F.count("n_tokens") / 2).alias("half")).scalar()
    median = counted.where(F.col("upto") >= half).agg(F.min("n_tokens").alias("median_tokens")).scalar()
    report = samples.agg(
        F.count("*").alias("n_samples"),
        F.count_if(F.col("n_tokens") > length).alias("n_over"),
        F.sum("n_tokens").alias("n_tokens"),
        F.max("n_tokens").alias("max_tokens"),
        F.sum(F.ceil(F.col("n_tokens") / length)).alias("blocks_unpacked"),
    ).withColumns({"blocks_packed": F.ceil(F.col("n_tokens") / length), "median_tokens": median})
    return report.withColumn("share_saved", 1 - F.col("blocks_packed") / F.col("blocks_unpacked"))
