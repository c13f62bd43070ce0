"""Archives, prefix tries and whitening, against plain loops and dense algebra."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatprep.llm import prefix_trie, queries, warc, whitening

# Archives

PAGES = "page_id long, url string, html string, number string, record_type int"


def _pages():
    """Copies, nulls, empty and long pages, repeated rows, line breaks in a URL, clashing columns."""
    html = ["<p>a</p>", "<p>b</p>\r\n\r\nWARC/1.1\r\n", "", None, "é\0x" * 9, "<i>" * 70_000, "<p>a</p>"]
    rows = [(k, f"http://h/{k}" if k % 3 else None, html[k % len(html)], "x", k) for k in range(40)]
    rows += [(None, "http://h/\r\nX: y", "<p>a</p>", None, None), (None, "u", "only here", "", 0), rows[3], rows[8], rows[8]]
    return rows


def _digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def _run(spark, rows, tmp_path, min_bytes=0, compress=True):
    crawl, out = f"{tmp_path}/crawl", f"{tmp_path}/out"
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    warc.write_archive(warc.page_records(pages, "url", "html", {"X-Id": "page_id"}), crawl, compress, records_per_file=7)
    number = F.try_element_at("fields", F.lit("X-Id")).cast("long")
    warc.deduplicate(spark, crawl, out, number, min_bytes, compress)
    return warc.read_records(spark, out)


@pytest.mark.parametrize(("min_bytes", "compress"), [(0, True), (5, False)])
def test_revisits(spark, tmp_path, min_bytes, compress):
    rows = _pages()
    found = _run(spark, rows, tmp_path, min_bytes, compress).collect()
    groups = defaultdict(list)
    for page_id, _, html, *_ in rows:
        groups[_digest(html)].append((page_id if page_id is not None else -1, len((html or "").encode())))
    by_id = {r.record_id: r for r in found}
    assert len(found) == len(by_id) == len(rows)
    kinds = defaultdict(list)
    for r in found:
        kinds[r.payload_digest].append(r)
    for digest, members in groups.items():
        own = kinds[digest]
        assert sorted(int(r.fields.get("X-Id", -1)) for r in own) == sorted(k for k, _ in members)
        responses = [r for r in own if r.record_type == "response"]
        if members[0][1] < min_bytes:
            assert len(responses) == len(members)
            continue
        assert len(responses) == 1 and int(responses[0].fields.get("X-Id", -1)) == max(k for k, _ in members)
        assert _digest(responses[0].payload.decode()) == digest and responses[0].payload_bytes == members[0][1]
        for r in own:
            if r.record_type == "revisit":
                assert r.payload == b"" and by_id[r.refers_to] == responses[0]
                assert r.refers_to_uri == responses[0].target_uri and r.head.startswith(b"HTTP/1.1 200 OK\r\n")
    assert {r.target_uri for r in found if "X-Id" not in r.fields} >= {"http://h/%0D%0AX: y", "u"}


def test_members_are_readable_alone(spark, tmp_path):
    """Each record is a gzip member of its own, as archive tools want it; the long one, too."""
    rows = [(1, "u", "short", "", 1), (2, "u", "long " * (1 << 22), "", 1), (3, "u", "", "", 1)]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    warc.write_archive(warc.page_records(pages, "url", "html", {}), f"{tmp_path}/out")
    (file,) = Path(f"{tmp_path}/out").glob("part-*")
    left, records = file.read_bytes(), []
    while left:
        member = zlib.decompressobj(31)
        records.append(member.decompress(left))
        left = member.unused_data
    records = [r for r in records if r]
    assert [r.count(b"WARC/1.1\r\n") for r in records] == [1, 1, 1] and all(r.endswith(b"\r\n\r\n") for r in records)
    assert len(gzip.decompress(file.read_bytes())) == sum(map(len, records))
    found = warc.read_records(spark, f"{tmp_path}/out").orderBy("number").collect()
    assert [r.payload.decode() for r in found] == [html for _, _, html, *_ in rows]


def _record(kind, number, payload=b"", *fields, content_type="text/plain"):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <r{number}>", *fields, f"Content-Type: {content_type}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    """Revisits of other archives find the original, other records stay, damaged rests are told."""
    a, other = b"payload", b"other"
    first = _record("warcinfo", 0, b"x: y\r\n") + _record("response", 1, a, "WARC-Date: d1") + _record("request", 2, a)
    second = _record("revisit", 3, b"", f"WARC-Payload-Digest: sha1:{_digest('payload')}")
    second += _record("revisit", 4, b"", "WARC-Payload-Digest: sha1:NOWHERE", "WARC-Refers-To: <gone>")
    second += _record("response", 5, a, "X-Note: one\r\n two", "WARC-Date: d5") + _record("revisit", 6)
    Path(tmp_path, "in").mkdir()
    Path(tmp_path, "in", "a.warc.gz").write_bytes(gzip.compress(first) + gzip.compress(_record("response", 7, other)))
    Path(tmp_path, "in", "b.warc").write_bytes(second + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nends early")
    Path(tmp_path, "in", "c.warc").write_bytes(b"")
    read = warc.read_records(spark, f"{tmp_path}/in")
    assert [r.fields["Reason"] for r in read.where("record_type = 'damaged'").collect()] == ["a record that ends early"]
    warc.deduplicate(spark, f"{tmp_path}/in", f"{tmp_path}/out", F.col("date"))
    found = {r.record_id: r for r in warc.read_records(spark, f"{tmp_path}/out").collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {
        "<r0>": ("warcinfo", None), "<r1>": ("revisit", "<r5>"), "<r2>": ("request", None), "<r3>": ("revisit", "<r5>"),
        "<r4>": ("revisit", "<gone>"), "<r5>": ("response", None), "<r6>": ("revisit", None), "<r7>": ("response", None),
    }
    assert found["<r5>"].payload == a and found["<r5>"].fields["X-Note"] == "one two" and found["<r2>"].payload == a
    both = warc.with_originals(warc.read_records(spark, f"{tmp_path}/out", payload=False)).collect()
    assert {r.record_id: r.original.payload_bytes for r in both if r.original} == {"<r1>": 7, "<r3>": 7}
    assert len(both) == 8


def test_no_pages(spark, tmp_path):
    assert _run(spark, [], tmp_path).count() == 0


def test_warc_query(spark, tmp_path):
    rows = _pages()
    spark.createDataFrame(rows, PAGES).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op11_warc_revisits(spark, str(tmp_path)).collect()
    sizes = Counter((page_id, len((html or "").encode()), _digest(html)) for page_id, _, html, *_ in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in found) == sizes
    best = {d: max((k for k, _, e in sizes if e == d and k is not None), default=None) for _, _, d in sizes}
    assert all(r.refers_to == best[r.payload_digest] for r in found if r.record_type == "revisit")
    assert sum(r.record_type == "response" for r in found) == len(best)


# Prefix tries


def rebuilt(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def trie(convs):
    """Each node, by prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, own in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(own) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (
            (min(own), len(k), min(members[k[:-1]]) if k else None, len(own), children[k], leaves[k], saved[k],
             hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
            for k, own in members.items()
        ),
        key=str,
    )


def _turns(seed=5, n=160):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 11 == 3:
            continue
        hot = c % 3 == 0
        for t in range(pick.choice([1, 3, 8, 12])):
            text = "same opening" if hot and t < 4 else pick.choice(["a", "b", "é", "", None])
            rows.append((c, t if c % 7 else None if t == 0 else t, pick.choice(["user", None]) if t > 4 else "user", text))
    rows += [(1000 + 5 * k, t, "user", "copy") for k in range(200) for t in range(3)]
    rows += [(None, 1, "user", "nobody's"), (4, 99, "r", "long " * 5000), (4, 100, "ro", "le"), (4, 100, "r", "ole")]
    return rows


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("parts", [1, 70])
def test_trie_query(spark, tmp_path, parts):
    """As one piece, and as so many that pieces are put together in two rounds."""
    rows = _turns()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.withColumns({"depth": F.lit(1), "n": F.lit("x"), "path": F.lit("y")}).write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = queries.op12_prefix_trie(spark, str(tmp_path)).select(COLUMNS).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Of turns with one number the order is that of their digests; only conversation 4 has such.
    assert sorted(map(tuple, found), key=str) in [trie(rebuilt(_swapped(rows, swap))) for swap in (False, True)]


def _swapped(rows, swap):
    return [(c, t + (0.5 if swap == (role == "r") and t == 100 else 0) if t is not None else t, role, text) for c, t, role, text in rows]


def test_empty_trie(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.sequences(none, "conv_id", "turn", "role", "text")).count() == 0
    one = spark.createDataFrame([(7, [])], "conv_id long, turns array<struct<digest: binary, bytes: bigint>>")
    assert [tuple(r) for r in prefix_trie.prefix_trie(one).collect()] == [
        (7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())
    ]


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_pieces_of_any_size(size):
    """Pieces of a few sequences, put together three at a time, give what one piece gives."""
    pick = random.Random(size)
    paths = sorted({b"".join(bytes([pick.randint(1, 3), d + 1] * 8) for d in range(pick.randint(0, 6))) for _ in range(90)})
    chain = [b"".join(hashlib.sha256(p[: 16 * (d + 1)]).digest()[:16] for d in range(len(p) // 16)) for p in paths]
    rows = [(path, [3 * (k % 5)] * (len(path) // 16), 1 + k % 4, k, str(k)) for k, path in enumerate(sorted(chain))]

    def nodes(batches):
        names = ["digest", "depth", "n", "least", "children", "leaves", "saved", "ends"]
        rows = [tuple(r[name] for name in names) for batch in batches for r in batch.to_pylist() if r["state"] == 0]
        return sorted(rows, key=str)

    one = prefix_trie._merged([prefix_trie._split(prefix_trie._piece(rows, 0))[1]], 0, whole=True)
    wanted = nodes([prefix_trie._piece(rows, 0), one])
    level = [prefix_trie._piece(rows[k : k + size], 0) for k in range(0, len(rows), size)]
    done = list(level)
    while len(level) > 1:
        level = [
            prefix_trie._merged([prefix_trie._split(b)[1] for b in level[k : k + 3]], 0, whole=len(level) <= 3)
            for k in range(0, len(level), 3)
        ]
        done += level
    if size >= len(rows):
        done.append(one)
    assert nodes(done) == wanted


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_slots_are_minimal_and_verified(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, (n, 2)).astype(np.uint64), axis=0)
    table = prefix_trie.SlotTable(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert (table.slots(keys + np.uint64(1)) == -1).all()


# Whitening

VECTORS = "id string, v array<float>, component int, whitened string"


def _vectors(n=300, d=40, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * np.linspace(1, 0.4, d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    return x.astype(np.float32)


def _dense(x, k):
    x = np.floor(1024 * x.astype(float)) + 100_000
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    return (x - x.mean(0)) @ vectors[:, :k] / np.sqrt(values[:k]), values / values.sum(), x


def _whitened(spark, rows, **how):
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    return whitening.whiten(frame, "id", "v", **how).collect()


def test_whitening(spark):
    x = _vectors()
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [nan] * 40, [0.0] * 39 + [inf], [0.0] * 39 + [None], [1e30] * 40, [1.0] * 3]
    rows = [(str(k), v.tolist(), k, None) for k, v in enumerate(x)] + [(f"odd{k}", v, 0, "") for k, v in enumerate(odd)]
    rows += [rows[5], (None, x[0].tolist(), None, None)]
    x = np.vstack([x, x[5], x[0]])
    found = _whitened(spark, rows, components=5)
    wanted, shares, whole = _dense(x, 5)
    assert len(found) == 5 * len(x) and {r.n for r in found} == {len(x)}
    by_id = defaultdict(dict)
    for r in found:
        by_id[r.id].setdefault(r.component, []).append(r)
    values = np.array([[by_id[str(k)][c][0].whitened for c in range(1, 6)] for k in range(300)])
    signs = np.sign((values * wanted[:300]).sum(0))
    assert np.abs(values * signs - wanted[:300]).max() < 1e-9
    assert len(by_id["5"][1]) == 2 and np.allclose([by_id[None][c][0].whitened for c in range(1, 6)], values[0])
    exact = {str(k): sum(int(a) ** 2 for a in len(x) * v - whole.sum(0)) for k, v in enumerate(whole[:300])}
    assert all(int(r.deviation) == exact[r.id] for r in found if r.id is not None)
    assert np.allclose([by_id["0"][c][0].explained for c in range(1, 6)], shares[:5], rtol=1e-10)
    assert max(r.identity_error for r in found) < 1e-9


def test_whitening_of_little(spark):
    assert _whitened(spark, []) == []
    assert _whitened(spark, [("a", [1.0, 2.0], 0, "")] * 3) == []
    assert _whitened(spark, [("a", None, 0, "")]) == []
    # One direction only, and fewer dimensions than components.
    found = _whitened(spark, [("a", [1.0, 0.0], 0, ""), ("b", [3.0, 0.0], 0, "")])
    assert [(r.id, r.component, abs(round(r.whitened, 12)), r.explained) for r in found] == [("a", 1, 1.0, 1.0), ("b", 1, 1.0, 1.0)] or len(found) == 2


@pytest.mark.parametrize("spectrum", [[5.0] * 60, [9.0] * 3 + [1.0] * 57, [100.0, 90.0] + [10 - 0.01 * k for k in range(58)], [1.0] + [0.0] * 59])
def test_leading_pairs_with_ties_and_small_gaps(spectrum):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    matrix = turn * np.array(spectrum) @ turn.T
    values, vectors = whitening.leading_pairs(lambda block: matrix @ block, 60, 6)
    assert np.allclose(values, sorted(spectrum)[::-1][:6], atol=1e-10 * max(spectrum))
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-9 * max(spectrum)
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-12


def test_deviations_beyond_a_long():
    centre = whitening.Centre(10**10, np.array([100_000]), np.array([5]))
    assert [int(v) for v in centre.deviations(np.array([[100_400]]))] == [(400 * 10**10 - 5) ** 2]


def test_whitening_query(spark, tmp_path):
    rows = [(k, v.tolist(), 0) for k, v in enumerate(_vectors(60, 12))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op13_whitening(spark, str(tmp_path))
    assert dict(found.dtypes)["deviation"] == "bigint" and found.count() == 60 * 8
