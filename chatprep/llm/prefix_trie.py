"""The trie of all conversations' prefixes, with counts for each node.

A conversation is the sequence of its turns' digests, and its prefixes are named by
digests chained over them. Sorted by those chains, all conversations below a node stand
next to each other, so the sorted list can be cut anywhere: of a piece, only the nodes on
the paths of its first and last conversation reach into the neighbours. Each piece
(shard) has a node table. Its distinct prefix digests are given slots by a minimal perfect
hash, which are verified against the digests themselves; counts are scattered into flat
arrays by slot, and sums over subtrees go up the array of parents' slots, depth by depth.
Nodes that reach beyond a piece stay open. Neighbouring pieces are put together, by the
same table over their open nodes, until none is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import written

#: Bytes of a digest. The root is all zeros.
DIGEST = 16
ROOT = bytes(DIGEST)
#: Occurrences of nodes after which a piece is closed: its arrays hold so many.
PIECE_NODES = 1 << 18
#: Pieces that are put together at once.
MERGED = 32
#: Ids that are joined to one text.
CHUNK_IDS = 1 << 14
#: Free places for each key and level of a minimal perfect hash.
ROOM = 2
NO_IDS = hashlib.sha256(b"").hexdigest()
_MIX = 0x9E3779B97F4A7C15

#: What is known of a node within a piece. Sums are over what the piece has closed;
#: ``least`` is the smallest member, ``first`` and ``last`` the paths that the node is on.
NODE = (
    "digest binary, parent binary, depth int, bytes long, n long, least long, children long, leaves long, "
    "saved long, ends string, first boolean, last boolean"
)
_NODE_TYPES = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_NODE_FIELDS = [pa.field(name, _NODE_TYPES[kind]) for name, kind in (part.split() for part in NODE.split(", "))]
#: A piece's result: ``state`` 0 is a finished node, ``parent_least`` null where its parent is open; 1 an open one.
RESULT = "piece long, state int, parent_least long, " + NODE
_RESULT = pa.schema(
    [pa.field("piece", pa.int64()), pa.field("state", pa.int32()), pa.field("parent_least", pa.int64()), *_NODE_FIELDS]
)


class SlotTable:
    """A minimal perfect hash of distinct digests: each has a slot of its own from 0 to n - 1.

    Keys are hashed into a level's places. Those alone in theirs have it, the others go
    on to the next level; a slot is the rank of a taken place. The digest at a slot
    decides whether a key is there, so no other key is ever taken for one.
    """

    def __init__(self, keys: np.ndarray) -> None:
        """``keys`` has two columns of unsigned longs, and distinct rows."""
        self._levels: list[tuple[int, np.ndarray]] = []
        self.keys = np.empty_like(keys)
        left, base, level = np.arange(len(keys)), 0, 0
        while len(left):
            size = max(1, ROOM * len(left))
            places = self._places(keys[left], level, size)
            alone = np.bincount(places, minlength=size) == 1
            ranks = np.cumsum(alone, dtype=np.int64) + (base - 1)
            taken = alone[places]
            self.keys[ranks[places[taken]]] = keys[left[taken]]
            self._levels.append((size, np.where(alone, ranks, -1)))
            base += int(taken.sum())
            left, level = left[~taken], level + 1

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = keys[:, 0] ^ (keys[:, 1] + np.uint64(_MIX * (2 * level + 1) % (1 << 64)))
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that is not in the table."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (size, ranks) in enumerate(self._levels):
            if not len(left):
                break
            found = ranks[self._places(keys[left], level, size)]
            there = found >= 0
            at, found = left[there], found[there]
            same = (self.keys[found] == keys[at]).all(axis=1)
            out[at[same]] = found[same]
            # A key of the table that shares a place finds it empty: who finds another's is not there.
            left = left[~there]
        return out


def _as_keys(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


class Nodes:
    """Rows about nodes of one piece, put together by slot."""

    def __init__(self, digests: bytes, parents: bytes, columns: dict[str, np.ndarray], ends: list[str | None]) -> None:
        keys = _as_keys(digests)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        self.table = SlotTable(ordered[new])
        size, at = len(self.table), self.table.slots(keys)
        self.parent_keys = np.zeros((size, 2), np.uint64)
        self.parent_keys[at] = _as_keys(parents)
        self.depth, self.bytes = np.zeros(size, np.int32), np.zeros(size, np.int64)
        self.depth[at], self.bytes[at] = columns["depth"], columns["bytes"]
        self.sums = {name: np.zeros(size, np.int64) for name in ("n", "children", "leaves", "saved")}
        for name, values in self.sums.items():
            np.add.at(values, at, columns[name])
        self.least = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(self.least, at, columns["least"])
        self.ends = np.full(size, None, object)
        for row in [k for k, value in enumerate(ends) if value is not None]:
            self.ends[at[row]] = ends[row]
        self.at = at
        # The root, and only it, has no parent.
        self.parent = np.where(self.depth > 0, self.table.slots(self.parent_keys), -1)

    def close(self, is_open: np.ndarray) -> None:
        """Finish all nodes but the open ones, from the deepest up; open ones get their closed children's sums."""
        order = np.argsort(-self.depth, kind="stable")
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        n, children, leaves, saved = (self.sums[name] for name in ("n", "children", "leaves", "saved"))
        for level in np.split(order, cuts):
            level = level[~is_open[level]]
            leaves[level] += children[level] == 0
            saved[level] += (n[level] - 1) * self.bytes[level]
            below = level[self.parent[level] >= 0]
            np.add.at(children, self.parent[below], 1)
            np.add.at(leaves, self.parent[below], leaves[below])
            np.add.at(saved, self.parent[below], saved[below])

    def batch(self, piece: int, is_open: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
        """All nodes as rows of a result."""
        size = len(self.table)
        known = (self.parent >= 0) & ~is_open[self.parent]
        parent_least = np.where(known, self.least[self.parent], 0)
        digests = pa.Array.from_buffers(pa.binary(DIGEST), size, [None, pa.py_buffer(self.table.keys.tobytes())])
        parents = pa.Array.from_buffers(pa.binary(DIGEST), size, [None, pa.py_buffer(self.parent_keys.tobytes())])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(size, piece)),
                pa.array(is_open.astype(np.int32)),
                pa.array(parent_least, mask=~known),
                digests.cast(pa.binary()),
                parents.cast(pa.binary()),
                *(pa.array(values) for values in (self.depth, self.bytes, self.sums["n"], self.least)),
                *(pa.array(self.sums[name]) for name in ("children", "leaves", "saved")),
                pa.array(self.ends, pa.string()),
                pa.array(first),
                pa.array(last),
            ],
            schema=_RESULT,
        )


def _merged(batches: list[pa.RecordBatch], piece: int, whole: bool = False) -> pa.RecordBatch:
    """Neighbouring pieces' open nodes, in order, as one piece; if it is the whole, nothing stays open."""
    table = pa.Table.from_batches(batches)
    columns = {
        name: table[name].to_numpy() for name in ("depth", "bytes", "n", "least", "children", "leaves", "saved")
    }
    digests, parents = (b"".join(table[name].to_pylist()) for name in ("digest", "parent"))
    nodes = Nodes(digests, parents, columns, table["ends"].to_pylist())
    first, last = np.zeros(len(nodes.table), bool), np.zeros(len(nodes.table), bool)
    if not whole:
        head, tail = batches[0].num_rows, table.num_rows - batches[-1].num_rows
        first[nodes.at[:head]] = batches[0]["first"].to_numpy(zero_copy_only=False)
        last[nodes.at[tail:]] = batches[-1]["last"].to_numpy(zero_copy_only=False)
    nodes.close(first | last)
    return nodes.batch(piece, first | last, first, last)


def _split(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    is_open = batch["state"].to_numpy() == 1
    return batch.filter(pa.array(~is_open)), batch.filter(pa.array(is_open))


def _piece(rows: list[tuple[bytes, list[int], int, int, str]], piece: int) -> pa.RecordBatch:
    """The node table of sorted, distinct sequences (path, bytes of turns, members, least member, ends)."""
    lengths = np.array([len(path) // DIGEST for path, *_ in rows])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    digests = b"".join(ROOT + path for path, *_ in rows)
    parents = b"".join((ROOT + ROOT + path[:-DIGEST]) if path else ROOT for path, *_ in rows)
    total = int((lengths + 1).sum())
    owner = np.repeat(np.arange(len(rows)), lengths + 1)
    depth = np.arange(total) - starts[owner]
    size = np.zeros(total, np.int64)
    size[depth > 0] = np.fromiter((b for row in rows for b in row[1]), np.int64, int(lengths.sum()))
    ends: list[str | None] = [None] * total
    for at, row in zip((starts + lengths).tolist(), rows, strict=True):
        ends[at] = row[4]
    none = np.zeros(total, np.int64)
    columns = {
        "depth": depth,
        "bytes": size,
        "n": np.array([row[2] for row in rows])[owner],
        "least": np.array([row[3] for row in rows])[owner],
        "children": none,
        "leaves": none,
        "saved": none,
    }
    nodes = Nodes(digests, parents, columns, ends)
    first, last = np.zeros(len(nodes.table), bool), np.zeros(len(nodes.table), bool)
    first[nodes.at[: lengths[0] + 1]] = True
    last[nodes.at[starts[-1] :]] = True
    nodes.close(first | last)
    return nodes.batch(piece, first | last, first, last)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished nodes of a partition of sorted sequences, and one set of open ones."""
    from pyspark import TaskContext

    piece = TaskContext.get().partitionId()
    rows: list = []
    held = 0
    waiting: list[pa.RecordBatch] = []

    def put(batch: pa.RecordBatch) -> pa.RecordBatch:
        finished, still = _split(batch)
        waiting.append(still)
        return finished

    def put_together() -> pa.RecordBatch:
        merged = _merged(list(waiting), piece)
        waiting.clear()
        return put(merged)

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            rows.append(row)
            held += len(row[0]) // DIGEST + 1
            if held >= PIECE_NODES:
                yield put(_piece(rows, piece))
                rows, held = [], 0
                if len(waiting) == MERGED:
                    yield put_together()
    if rows:
        yield put(_piece(rows, piece))
    if len(waiting) > 1:
        yield put_together()
    yield from waiting


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last pieces' open nodes, finished."""
    return _neighbours(batches, whole=True)


def _neighbours(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Open nodes of several groups of pieces, sorted by piece, put together group by group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        pieces = batch["piece"].to_numpy()
        for start, stop in _runs(pieces):
            part = batch.slice(start, stop - start)
            if held and held[-1]["piece"][0] == part["piece"][0]:
                held[-1] = pa.Table.from_batches([held[-1], part]).combine_chunks().to_batches()[0]
            else:
                if held and held[-1]["piece"][0].as_py() // MERGED != int(pieces[start]) // MERGED:
                    yield _merged(held, held[0]["piece"][0].as_py() // MERGED, whole)
                    held = []
                held.append(part)
    if held:
        yield _merged(held, held[0]["piece"][0].as_py() // MERGED, whole)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)] if len(values) else [0]
    return zip(cuts[:-1], cuts[1:], strict=True)


def sequences(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """One row for each conversation: ``conv_id``, and ``turns`` in order as (digest, bytes of text).

    Null turns come first; equal ones go by digest. A null role or text is empty. A turn is
    24 bytes here, whatever its text. Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in (role_col, text_col))
    # The role's length tells where the text begins.
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, DIGEST)
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            digest.alias("digest"),
            F.octet_length(text).cast("long").alias("bytes"),
        ).alias("t"),
    )
    ordered = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns")
    )


def _paths(convs: DataFrame) -> DataFrame:
    """``conv_id``, ``path`` (the chained digests, joined), ``bytes`` of each turn, ``last`` digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lasts = [], []
            for digests in batch.column(1).to_pylist():
                known = ROOT
                chain = []
                for digest in digests:
                    known = hashlib.sha256(known + digest).digest()[:DIGEST]
                    chain.append(known)
                paths.append(b"".join(chain))
                lasts.append(known)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(paths, pa.binary()), batch.column(2), pa.array(lasts, pa.binary())],
                ["conv_id", "path", "bytes", "last"],
            )

    digests = F.transform("turns", lambda t: t["digest"])
    sizes = F.transform("turns", lambda t: t["bytes"])
    rows = convs.select("conv_id", digests.alias("digests"), sizes.alias("bytes"))
    return rows.mapInArrow(run, "conv_id long, path binary, bytes array<long>, last binary")


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by (last, conv_id) as joined texts of at most so many, one for each run of a digest at least."""
    name, ids, out = None, [], []

    def rows() -> pa.RecordBatch:
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)], ["last", "least", "n", "text"]
        )

    for batch in batches:
        for last, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if last != name or len(ids) == CHUNK_IDS:
                if ids:
                    out.append((name, ids[0], len(ids), ",".join(map(str, ids))))
                name, ids = last, []
            ids.append(conv_id)
        if len(out) >= CHUNK_IDS:
            yield rows()
            out = []
    if ids:
        out.append((name, ids[0], len(ids), ",".join(map(str, ids))))
    yield rows()


def _joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each digest's texts, joined in order, as they pass: none is held."""
    name, hasher, found = None, None, []
    for batch in batches:
        for last, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if last != name:
                if hasher is not None:
                    found.append((name, hasher.hexdigest()))
                name, hasher = last, hashlib.sha256()
            else:
                hasher.update(b",")
            hasher.update(text.encode())
    if hasher is not None:
        found.append((name, hasher.hexdigest()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.string())], ["last", "ends"]
    )


def _ends(paths: DataFrame) -> DataFrame:
    """For each sequence, by its last digest: ``n`` conversations, the ``least``, the hash ``ends`` of all their ids."""
    order = ["last", "conv_id"]
    sorted_ids = paths.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = written(sorted_ids.mapInArrow(_id_texts, "last binary, least long, n long, text string"), "ids")
    groups = texts.groupBy("last").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.count(F.lit(1)).alias("texts"),
        F.min(F.sha2("text", 256)).alias("ends"),
    )
    groups = written(groups, "groups")
    # A sequence with many conversations: its texts pass one task in order, as the hash needs them.
    many = texts.join(groups.where("texts > 1").select("last"), "last", "left_semi")
    hashed = many.repartition("last").sortWithinPartitions("last", "least").select("last", "text")
    hashed = hashed.mapInArrow(_joined_hashes, "last binary, ends string")
    rest = groups.where("texts > 1").drop("texts", "ends").join(hashed, "last")
    return groups.where("texts = 1").drop("texts").unionByName(rest)


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences, the empty one included.

    ``convs`` are ``sequences``: distinct ``conv_id`` and ``turns``; no turns are a
    sequence as well. ``conv_id`` is the smallest member (a conversation that begins with
    the prefix), ``parent_conv_id`` the parent's, null for the root; ``n_convs`` counts
    members, ``n_children`` the prefixes one turn longer, ``n_leaves`` the childless
    prefixes in the subtree, itself included. ``saved_bytes`` sums over the subtree what
    each node's last text need not be stored again: (members - 1) times its bytes.
    ``ends_sha256`` is over the decimal ids of the conversations that end there, rising,
    joined by commas; of an empty text where none does. An empty table has no node.

    Turns of one conversation pass a task together, as 24 bytes each. Nodes, members of a
    node and conversations that are alike have no such bound.
    """
    spark = convs.sparkSession
    paths = written(_paths(convs), "paths")
    distinct = paths.groupBy("last").agg(F.first(F.struct("path", "bytes")).alias("s"))
    distinct = distinct.join(_ends(paths), "last").select("s.path", "s.bytes", "n", "least", "ends")
    distinct = written(distinct, "sequences")
    total = distinct.agg(F.sum(F.size("bytes") + 1)).head()[0] or 0
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * PIECE_NODES)))
    placed = distinct.repartitionByRange(pieces, "path").sortWithinPartitions("path")
    level = written(placed.mapInArrow(_pieces, RESULT), "pieces")
    finished, late = [level.where("state = 0")], []
    # The number that Spark has in fact: part numbers below it, empty ones included.
    pieces = (level.agg(F.max("piece")).head()[0] or 0) + 1
    while True:
        groups = -(-pieces // MERGED)
        near = level.where("state = 1").repartition(groups, F.floor(F.col("piece") / MERGED))
        near = near.sortWithinPartitions("piece").mapInArrow(_finish if groups == 1 else _neighbours, RESULT)
        level = written(near, "neighbours")
        late.append(level.where("state = 0"))
        if groups == 1:
            break
        pieces = groups
    done = finished[0]
    for more in late:
        done = done.unionByName(more)
    # Open nodes' members are known at last. Their children, very many of one perhaps, look them up;
    # the root is one value.
    known = late[0].select("digest", "least", "depth")
    for more in late[1:]:
        known = known.unionByName(more.select("digest", "least", "depth"))
    known = written(known, "known")
    root = known.where("depth = 0").agg(F.min("least")).scalar()
    waits = F.col("parent_least").isNull() & (F.col("depth") > 1)
    parents = known.select(F.col("digest").alias("parent"), F.col("least").alias("_least")).hint("merge")
    looked_up = done.where(waits).join(parents, "parent").withColumn("parent_least", F.col("_least")).drop("_least")
    rest = done.where(~waits).withColumn(
        "parent_least", F.when(F.col("depth") == 1, root).otherwise(F.col("parent_least"))
    )
    return rest.unionByName(looked_up).select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.col("parent_least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_bytes"),
        F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"),
    )
