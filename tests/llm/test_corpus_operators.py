"""Operators that compare rows with each other, against plain loops."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from loops import SCHEMA, contained, fingerprint, linked, mixed, odd_documents, without_repeats
from pyspark.sql import functions as F

from chatprep.llm import components, decontaminate, mixing, simhash, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.mark.parametrize("bits", [64, 31, 17, 9])
def test_masks_cover(bits):
    pick = random.Random(bits)
    masks = simhash.covering_masks(list(range(bits)), 4)
    for _ in range(3000):
        differing = sum(1 << bit for bit in pick.sample(range(bits), 4))
        assert any(not mask & differing for mask in masks)


def _near(seed=3, n=400):
    pick = random.Random(seed)
    values = [pick.getrandbits(64) for _ in range(30)]
    while len(values) < n:
        values.append(pick.choice(values) ^ sum(1 << pick.randrange(64) for _ in range(pick.randint(1, 4))))
    return sorted(set(values))


@pytest.mark.parametrize("bucket", [2048, 3, 1])
def test_links_within(spark, bucket):
    """Also where every bucket is cut again at every level."""
    values = _near()
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links_within(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, bucket)
    found = {r.node: r.component for r in components.components(links).collect()}
    wanted = linked([(s, v) for s, v in zip(signed, values)])
    assert [found.get(s, s) for s in signed] == wanted


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(1, 70)] + [(100, 100 + k) for k in range(1, 300)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 1 for k in range(2, 71)} | {100 + k: 100 for k in range(1, 300)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_groups(docs):
    found = sorted(map(tuple, simhash.near_groups(docs, "doc_id", "text").collect()))
    rows = odd_documents()
    prints = [(k, fingerprint(text)) for k, text, *_ in rows]
    assert found == sorted((k, f"{fp:016x}", least) for (k, fp), least in zip(prints, linked(prints)))
    assert simhash.near_groups(docs.limit(0), "doc_id", "text").count() == 0


def test_first_of_groups(docs):
    stay = simhash.first_of_groups(docs, "doc_id", "text")
    assert stay.columns == docs.columns
    prints = [(k, fingerprint(text)) for k, text, *_ in odd_documents()]
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(linked(prints)))


def test_mix(docs, spark):
    rows = [(r[0], r[1], r[3]) for r in odd_documents()[:-1]]
    unique = spark.createDataFrame(odd_documents()[:-1], SCHEMA)
    found = mixing.mix(unique, "doc_id", "text", "source")
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in found.collect()}
    wanted = mixed(rows)
    assert got.keys() == wanted.keys()
    for k in wanted:
        assert got[k] == pytest.approx(wanted[k])
    # Ranges and cells change nothing.
    again = mixing.mix(unique, "doc_id", "text", "source", ranges=3)
    assert sorted(found.collect()) == sorted(again.collect())
    assert mixing.mix(docs, "doc_id", "text", "source").count() == len(odd_documents())
    assert mixing.mix(docs.limit(0), "doc_id", "text", "source").count() == 0


def test_mix_in_few_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELLS", 2)
    rows = [(k, "w " * (k % 13), ["a", "b", "c", None][k * k % 4]) for k in range(200)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source")
    assert {r.doc_id: r.taken for r in found.collect()} == {k: v[3] for k, v in mixed(rows).items()}


def test_mix_taken_keeps_columns(docs):
    found = mixing.taken(docs, "doc_id", "text", "source")
    assert found.columns == [*docs.columns, "copies_"]
    assert 0 < found.count() <= len(odd_documents())


@pytest.mark.parametrize(("largest", "frequent"), [(1 << 20, 64), (20, 64), (2, 64), (2, 1)])
@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_in_small_alphabets(spark, largest, frequent, seed):
    pick = random.Random(seed)
    rows = [(k, "".join(pick.choices("ab", k=pick.randint(0, 50)))) for k in range(150)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_dedup.remove_repeats(table, "doc_id", "text", span=8, anchor=3, largest=largest, frequent=frequent)
    wanted = without_repeats(rows, 8)
    for r in found.collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wanted[r.doc_id]


def test_repeats_of_passages(spark, monkeypatch):
    pick = random.Random(5)
    prose = ["".join(pick.choices("abcdefgh é", k=n)) for n in (90, 99, 100, 101, 150, 400, 3000)]
    rows = [(k, "".join(pick.choices(prose, k=pick.randint(1, 3)))) for k in range(60)] + [(98, None), (99, ""), (100, "x" * 1000)]
    wanted = without_repeats(rows)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 20)
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in found:
        k = r.doc_id if r.doc_id < 98 else r.doc_id - 38
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wanted[k]


@pytest.mark.parametrize("frequent", [1 << 16, 1])
def test_repeats_of_one_line(spark, monkeypatch, frequent):
    pick = random.Random(9)
    line = "".join(pick.choices("abcdefgh ", k=140))
    rows = [(k, "".join(pick.choices("abcdefgh ", k=30)) + line + "".join(pick.choices("xyz", k=30))) for k in range(120)]
    monkeypatch.setattr(suffix_dedup, "CLASSES", 2)
    sizes = suffix_dedup.Sizes(suffix_dedup.SPAN, suffix_dedup.ANCHOR)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hot = suffix_dedup._frequent(table, sizes, 8, frequent)
    # A line in all texts is found; with one anchor at most, none has more than all occurrences.
    assert (hot.count() > 0) == (frequent > 1)
    found = suffix_dedup.remove_repeats(table, "doc_id", "text", largest=8, frequent=frequent)
    wanted = without_repeats(rows)
    for r in found.collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == wanted[r.doc_id]


def test_cut_classes_meet(spark):
    """Contexts that share a string of the span around their anchor are in one part of the class at least."""
    pick = random.Random(3)
    sizes = suffix_dedup.Sizes(20, 4)
    rows, shared = [], "".join(pick.choices("abc", k=16))
    for k in range(17):
        # One string of 20 bytes, its anchor k bytes from its start, with other bytes around it.
        string = shared[:k] + "ANCH" + shared[k:]
        for n in range(2):
            before, after = "".join(pick.choices("xyz", k=16 - k)), "".join(pick.choices("xyz", k=k))
            rows.append((k, f"{k}-{n}".encode(), 100, 16, (before + string + after).encode()))
    table = spark.createDataFrame(rows, "id long, key binary, at int, left int, bytes binary")
    cut = suffix_dedup._cut_classes(table, sizes, 5)
    pairs = cut.alias("a").join(cut.alias("b"), "anchor").where("a.id = b.id and a.key < b.key")
    assert {r[0] for r in pairs.select("a.id").collect()} == set(range(17))
    assert cut.count() <= 5 * len(rows)


def test_frequent_values_in_bounded_memory():
    pick = random.Random(4)
    values = [7] * 3000 + [11] * 1500 + [pick.getrandbits(60) for _ in range(20_000)]
    pick.shuffle(values)
    counted = suffix_dedup.Frequent(32)
    for at in range(0, len(values), 100):
        counted.add(np.array(values[at : at + 100], np.uint64))
    found = dict(zip(*(part.tolist() for part in counted.counts()), strict=True))
    assert set(found) >= {7, 11} and len(found) <= 32
    assert all(values.count(v) - len(values) / 32 <= n <= values.count(v) for v, n in found.items())
    empty = suffix_dedup.Frequent(4)
    assert [len(part) for part in empty.counts()] == [0, 0]


def test_large_class_in_bounded_memory():
    sizes = suffix_dedup.Sizes(suffix_dedup.SPAN, suffix_dedup.ANCHOR)
    n = 1 << 16
    pick = np.random.default_rng(1)
    found = [pick.integers(97, 122, sizes.context, np.uint8).tobytes() for _ in range(n)]
    batch = pa.table({
        "id": pa.array(range(n), pa.int64()), "key": pa.array([b"k"] * n), "at": pa.array([sizes.reach] * n, pa.int32()),
        "left": pa.array([sizes.reach] * n, pa.int32()), "bytes": pa.array(found, pa.binary()),
    })
    tracemalloc.start()
    assert suffix_dedup._compare(batch, sizes).num_rows == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_repeats_of_odd_rows(docs):
    found = suffix_dedup.remove_repeats(docs, "doc_id", "text")
    rows = sorted(((r[0], r[1]) for r in odd_documents()), key=lambda r: r[0])
    wanted = sorted((rows[k][0], *v) for k, v in without_repeats(rows).items())
    assert sorted(map(tuple, found.drop("spans").collect())) == wanted
    assert suffix_dedup.remove_repeats(docs.limit(0), "doc_id", "text").count() == 0
    assert suffix_dedup.remove_repeats(docs.withColumn("doc_id", F.lit(None).cast("long")), "doc_id", "text").count() == docs.count()


def _items(seed=2):
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(pick.choices(vocabulary, k=pick.choice([3, 5, 8, 20, 45])))) for k in range(40)]
    items += [(50, None), (51, ""), (52, items[0][1]), (52, items[0][1])]
    documents = []
    for k in range(120):
        text = pick.choices(vocabulary, k=pick.randint(0, 400))
        for _ in range(pick.randint(0, 3)):
            own = (pick.choice(items)[1] or "").split()
            if own and pick.random() < 0.5:
                own[pick.randrange(len(own))] = "changed"
            at = pick.randint(0, len(text))
            text[at:at] = own
        documents.append((k, pick.choice([" ", ", "]).join(text).upper() if k % 2 else " ".join(text)))
    return [*documents, (200, None), (201, "")], items


def test_contained_items(spark, monkeypatch):
    documents, items = _items()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in documents], "doc_id long, text string, shingle string, item int")
    table = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 900)
    found = decontaminate.contained_items(docs, "doc_id", "text", table, "item_id", "text").collect()
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in found}
    assert got == contained(documents, items) and len(found) == len(got) > 20
    for a, b in ((docs.limit(0), table), (docs, table.limit(0))):
        assert decontaminate.contained_items(a, "doc_id", "text", b, "item_id", "text").count() == 0


def test_a_phrase_that_all_share_is_in_no_sketch(spark):
    """Documents and items with one phrase in common, and few real matches: no pairs of all with all."""
    phrase = "the same five words here"
    items = [(k, f"{phrase} " + " ".join(f"i{k}x{j}" for j in range(30))) for k in range(300)]
    documents = [(k, f"{phrase} " + " ".join(f"d{k}x{j}" for j in range(30))) for k in range(300)]
    documents += [(1000 + k, "before " + items[k][1] + " after") for k in range(5)]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    wanted = decontaminate.item_shingles(table.toDF("id", "text"), 5)
    hits = decontaminate._passing(docs.toDF("id", "text"), 5, None).select(F.col("id").alias("doc"), "shingle")
    sketches = decontaminate._sketches(wanted, hits, 0.8)
    assert sketches.where(F.col("shingle") == phrase).count() == 0
    assert hits.join(sketches, "shingle").select("doc", "item").distinct().count() == 5
    found = decontaminate.contained_items(docs, "doc_id", "text", table, "item_id", "text").collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1000 + k, k) for k in range(5)}


def test_sketch_is_large_enough():
    """An item of n shingles may miss n - ceil(0.8 n); its sketch has more than that."""
    import math

    for n in range(1, 5000):
        assert decontaminate.sketch_size(int(math.log2(n)), 0.8) > n - math.ceil(n * 0.8 - 1e-9)
