import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chatprep.functions.text import tokens_of
from chatprep.operators import pack, split
from tests.helpers import plan, rows
from tests.plain import best_fit_blocks


@pytest.mark.parametrize(
    ("n", "ratio", "held"), [(100, 0.95, 5), (101, 0.95, 6), (1, 0.95, 1), (50, 1.0, 0), (50, 0.0, 50), (3000, 0.9, 300)]
)
def test_split_exact_sizes(spark, n, ratio, held):
    df = spark.range(n).withColumnRenamed("id", "key")
    got = split.split_exact(df, "key", ratio)
    assert got.count() == n
    assert got.where("split = 'validation'").count() == held


def test_split_exact_takes_the_smallest_hashes(spark):
    df = spark.range(2000).withColumnRenamed("id", "key")
    ranked = sorted(range(2000), key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest())
    for spread in (1, 9):
        got = split.split_exact(df.repartition(spread), "key", 0.9, seed=7)
        assert {r.key for r in got.where("split = 'validation'").collect()} == set(ranked[:200])
    other = split.split_exact(df, "key", 0.9, seed=8).where("split = 'validation'")
    assert {r.key for r in other.collect()} != set(ranked[:200])


def test_split_exact_of_nothing(spark):
    assert split.split_exact(spark.range(0), "id").count() == 0


def test_split_exact_does_not_move_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    main = plan(split.split_exact(df, "doc_id")).split("Subquery")[0]
    assert "Exchange" not in main


def test_split_hash_is_stable(spark):
    small = split.split_hash(spark.range(1000), "id", 0.8).where("split = 'validation'")
    large = split.split_hash(spark.range(5000).repartition(7), "id", 0.8).where("split = 'validation' AND id < 1000")
    assert rows(small) == rows(large)
    assert 150 < small.count() < 250
    assert split.split_hash(spark.range(10), "id", 0.0).where("split = 'train'").count() == 0
    assert split.split_hash(spark.range(10), "id", 1.0).where("split = 'validation'").count() == 0


@pytest.mark.parametrize("shards", [1, 4])
def test_pack_against_a_plain_loop(spark, shards):
    pick = random.Random(3)
    sizes = {k: pick.choice([0, 1, 5, 40, 700]) for k in range(600)}
    df = spark.createDataFrame(list(sizes.items()), "key BIGINT, n_tokens BIGINT").repartition(5)
    pieces = pack.pack_sequences(df, "key", max_len=64, shards=shards, seed=1)
    want = []
    order = sorted(sizes, key=lambda k: (hashlib.md5(f"1:{k}".encode()).hexdigest(), k))
    for shard in range(shards):
        at = 0
        for key in (k for k in order if k % shards == shard):
            done = 0
            while done < sizes[key]:
                take = min(64 - at % 64, sizes[key] - done)
                want.append((shard, at // 64, key, done, at % 64, take))
                done += take
                at += take
    assert rows(pieces) == sorted(want, key=repr)
    fill = pack.pack_fill(pieces, 64).collect()
    assert sum(r.n_tokens for r in fill) == sum(sizes.values())
    assert max(r.n_tokens for r in fill) == 64
    assert sum(r.n_tokens < 64 for r in fill) <= shards


def test_fill_blocks(spark):
    texts = [(k, " ".join(f"{k}.{n}" for n in range(k % 50))) for k in range(1, 120)]
    df = spark.createDataFrame(texts, "key BIGINT, text STRING")
    samples = df.withColumn("tokens", tokens_of(F.col("text"))).withColumn("n_tokens", F.size("tokens").cast("long"))
    pieces = pack.pack_sequences(samples, "key", max_len=16)
    blocks = [r.tokens for r in pack.fill_blocks(pieces, samples, "key").orderBy("block").collect()]
    assert all(len(b) == 16 for b in blocks[:-1])
    at_once = pack.pack_tokens(samples.select("key", "tokens"), "key", max_len=16)
    assert [r.tokens for r in at_once.orderBy("block").collect()] == blocks
    stream = [t for b in blocks for t in b]
    order = sorted((k for k, _ in texts), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    assert stream == [f"{k}.{n}" for k in order for n in range(k % 50)]


def test_count_tokens(spark):
    df = spark.createDataFrame([("a b\n c",), ("",), (None,)], "text STRING")
    assert [r.n_tokens for r in pack.count_tokens(df).collect()] == [3, 0, None]
    by_letter = pack.count_tokens(df, tokenizer=list)
    assert [r.n_tokens for r in by_letter.collect()] == [6, 0, None]


def test_length_report(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 20)], "n_tokens BIGINT")
    got = pack.length_report(df, 10).first()
    assert (got.n_samples, got.n_over, got.n_tokens, got.max_tokens, got.median_tokens) == (5, 1, 36, 20, 3)
    assert (got.blocks_unpacked, got.blocks_packed) == (6, 4)
    assert got.share_saved == 1 - 4 / 6


def test_median_is_exact(spark):
    lengths = spark.range(400_000).select((F.col("id") * 7 % 400_000).alias("n_tokens"))
    assert pack.length_report(lengths).first().median_tokens == 199_999


def test_null_keys_belong_to_no_part(spark):
    df = spark.range(100).select(F.when(F.col("id") >= 10, F.col("id")).alias("key"))
    found = split.split_exact(df, "key", 0.9)
    assert {r.split: r.n for r in found.groupBy("split").agg(F.count("*").alias("n")).collect()} == {
        None: 10, "train": 81, "validation": 9
    }


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_over_lengths_is_best_fit_over_samples(seed):
    """Runs of blocks that are filled at once hold what one sample after the other would fill."""
    pick = random.Random(seed)
    max_len = pick.choice([7, 20, 64])
    lengths = sorted((pick.randint(1, max_len) for _ in range(pick.randint(0, 400))), reverse=True)
    counts = [(n, lengths.count(n)) for n in set(lengths)]
    got = []
    for length, start, stop, each, first, place in pack.best_fit(counts, max_len):
        got += [(first + k // each, place + k % each * length) for k in range(stop - start)]
    assert got == best_fit_blocks(lengths, max_len)


def test_best_fit_does_not_grow_with_the_samples():
    places = pack.best_fit([(n, 10**9) for n in range(1, 513)], 512)
    assert len(places) < 20_000 and sum(stop - start for _, start, stop, *_ in places) == 512 * 10**9


def test_pack_whole(spark):
    """No sample is cut or lost; those that have no place say so."""
    sizes = [(k, [64, 63, 40, 24, 12, 7, 7, 7, 3, 1][k * k % 10]) for k in range(500)]
    odd = [(600, 65), (601, 0), (602, None), (None, 5), (603, -1)]
    table = spark.createDataFrame([*sizes, *odd], "key long, n_tokens long").repartition(7)
    placed = pack.pack_whole(table, "key", max_len=64).cache()
    assert placed.count() == 505
    assert {r.key for r in placed.where("block IS NULL").collect()} == {600, 601, 602, 603, None}
    order = sorted(sizes, key=lambda r: (-r[1], hashlib.md5(f"42:{r[0]}".encode()).hexdigest()))
    want = {k: place for (k, _), place in zip(order, best_fit_blocks([n for _, n in order], 64))}
    got = {r.key: (r.block, r.block_from) for r in placed.where("block IS NOT NULL").collect()}
    assert got == want
    fill = pack.whole_fill(placed, 64).agg(F.max("n_tokens").alias("most"), F.avg("fill").alias("fill")).first()
    assert fill.most <= 64 and fill.fill > 0.99
    # The same in any layout, and none at all for an empty table.
    assert rows(pack.pack_whole(table.coalesce(1), "key", max_len=64)) == rows(placed)
    assert pack.pack_whole(table.limit(0), "key").count() == 0


def test_whole_tokens(spark):
    texts = [(k, " ".join(f"{k}.{n}" for n in range(k % 17))) for k in range(120)]
    samples = spark.createDataFrame(texts, "key long, text string").select("key", tokens_of(F.col("text")).alias("tokens"))
    blocks = pack.whole_tokens(samples, "key", max_len=16).collect()
    seen = []
    for row in blocks:
        assert len(row.tokens) == row.ends[-1] <= 16
        for start, stop in zip([0, *row.ends[:-1]], row.ends):
            sample = row.tokens[start:stop]
            assert {t.split(".")[0] for t in sample} == {sample[0].split(".")[0]}
            seen.append(" ".join(sample))
    assert sorted(seen) == sorted(text for _, text in texts if text)
