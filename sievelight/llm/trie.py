"""The prefix trie of conversations: which opening turns conversations share, and what storing each once would save.

A turn is a 128-bit digest of role and text and a conversation the sequence of its digests, so texts are read once and never shuffled.
Conversations of one sequence are folded first. The distinct sequences are dealt by range into shards of a counted size. A shard
numbers its turns in the order of their digests (its dictionary) and inserts its sequences into a ternary search tree, each range by its median
first, which keeps the search among the next turns of a node logarithmic. Nodes are made after their parents, so one pass from the
last node to the first adds up members, leaves and savings.

Ranges are contiguous, so shards share only nodes above their first or last sequence, down to where the neighbour's
nearest sequence departs. Of these boundary nodes each belongs to the first shard that has it, which counts it once; all other
figures are sums over shards, and one group-by of the boundary nodes merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.llm.tables import written

SHARD_TURNS = 400_000  # turns of distinct sequences per shard
PIECE_IDS = 512  # ids per row of a sorted list that is hashed
DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODES = pa.schema([("shard", pa.int32()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()),
                    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                    ("saved_tokens", pa.int64()), ("ends", pa.binary())])
_NODE_COLUMNS = ("shard int, depth long, key binary, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, "
                 "n_leaves long, saved_tokens long, ends binary")


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its ``turns`` (digest, code points) in the order of ``turn``, null first and equal ones by digest.

    A null role or text counts as empty. Rows without a conversation take no part. One conversation is one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    one = F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("size"))
    each = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("_turn"))
    return each.groupBy("conv_id").agg(F.transform(
        F.sort_array(F.collect_list("_turn")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(found: DataFrame) -> DataFrame:
    """``found`` with its first turns taken from the conversation at the next lower hundred: as many as the crc32 of the id modulo 6."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    base = found.where("conv_id % 100 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 5).alias("_head"))
    joined = found.join(base, F.col("conv_id") - F.col("conv_id") % 100 == F.col("_base"), "left")
    none = F.array().cast(found.schema["turns"].dataType)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("_head", none), 1, h), rest).alias("turns"))


def _runs(keys: list) -> list[int]:
    return [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]


def ends(paths: DataFrame) -> DataFrame:
    """``key, conv_id`` (the smallest), ``n`` and ``ends`` (SHA-256 of the ascending ids, comma-joined) of each distinct sequence.

    Ids are sorted by ranges of (sequence, id), so the list of one very common sequence is made by many tasks; what
    then meets in one task are its pieces, which are hashed one after the other as they come.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            runs = _runs(keys)
            cut = [(i, min(i + PIECE_IDS, b)) for a, b in zip(runs[:-1], runs[1:], strict=True) for i in range(a, b, PIECE_IDS)]
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[a] for a, _ in cut], pa.binary()), pa.array([ids[a] for a, _ in cut], pa.int64()), pa.array([b - a for a, b in cut], pa.int64()),
                pa.array([",".join(map(str, ids[a:b])) for a, b in cut], pa.string())], ["key", "conv_id", "n", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, state = None, None, 0, None
        for batch in batches:
            out: list[tuple] = []
            for k, i, m, text in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "n", "ids")), strict=True):
                if k != key:
                    if state:
                        out.append((key, first, n, state.digest()))
                    key, first, n, state = k, i, 0, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.encode())
                n += m
            yield _table(out)
        if state:
            yield _table([(key, first, n, state.digest())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], ["key", "conv_id", "n", "ends"])

    order = ["key", "conv_id"]
    cut = paths.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "key binary, conv_id long, n long, ids string")
    return cut.repartition("key").sortWithinPartitions(*order).mapInArrow(hashed, "key binary, conv_id long, n long, ends binary")


def _common(a: bytes | None, b: bytes | None) -> int:
    """Turns with which two sequences begin alike; -1 where there is no neighbour."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // DIGEST
    x, y = (np.frombuffer(s, np.uint64, n * 2) for s in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) // 2 if len(differ) else n


class Tree:
    """A ternary search tree over numbered turns; node 0 is the root of the trie, which has no turn."""

    def __init__(self) -> None:
        self.turn, self.low, self.high, self.next = [-1], [-1], [-1], [-1]
        self.up, self.depth, self.size = [-1], [0], [0]

    def _new(self, turn: int, up: int, size: int) -> int:
        self.turn.append(turn)
        for links in (self.low, self.high, self.next):
            links.append(-1)
        self.up.append(up)
        self.depth.append(self.depth[up] + 1)
        self.size.append(size)
        return len(self.turn) - 1

    def insert(self, turns: list[int], sizes: list[int]) -> list[int]:
        """The nodes of a sequence, root first."""
        node, path = 0, [0]
        for turn, size in zip(turns, sizes, strict=True):
            at, links, slot = self.next[node], self.next, node
            while at >= 0 and self.turn[at] != turn:
                links, slot = (self.low, at) if turn < self.turn[at] else (self.high, at)
                at = links[slot]
            if at < 0:
                at = self._new(turn, node, size)
                links[slot] = at
            node = at
            path.append(node)
        return path


def medians(n: int) -> Iterator[int]:
    """0 .. n-1, the median of each range before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            stack += [(mid + 1, b), (a, mid)]


def _keys(path: bytes, depth: int) -> list[bytes]:
    """Digests of the prefixes of up to ``depth`` turns."""
    state = hashlib.md5(usedforsecurity=False)
    out = [state.digest()]
    for k in range(depth):
        state.update(path[k * DIGEST:(k + 1) * DIGEST])
        out.append(state.copy().digest())
    return out


def shard_nodes(heads: pa.Table, before: bytes | None, after: bytes | None) -> pa.Table:
    """The nodes of one shard; ``before`` and ``after`` are the nearest sequences of the shards next to it.

    Boundary nodes carry a ``key``, and nodes right below one carry its key as ``parent``.
    """
    heads = heads.sort_by("path")
    paths, sizes = heads.column("path").to_pylist(), heads.column("sizes").to_pylist()
    halves = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
    distinct, code = np.unique(halves.astype(np.uint64), axis=0, return_inverse=True) if len(halves) else (halves, np.zeros(0, np.int64))
    code = code.reshape(-1).tolist()
    at = np.concatenate([[0], np.cumsum([len(s) for s in sizes])]).tolist()
    tree, end, edges = Tree(), {}, {}
    for i in medians(len(paths)):
        path = tree.insert(code[at[i]:at[i + 1]], sizes[i])
        end[path[-1]] = i
        if i in (0, len(paths) - 1):
            edges[i] = path
    first, last = edges[0], edges[len(paths) - 1]
    left, right = _common(before, paths[0]), _common(paths[-1], after)
    foreign = set(first[:left + 1])
    keys = dict(zip(first[:left + 1], _keys(paths[0], left), strict=False)) if left >= 0 else {}
    if right >= 0:
        keys.update(zip(last[:right + 1], _keys(paths[-1], right), strict=False))
    continued = last[-1] if right == len(last) - 1 else -1  # a sequence that the next shard goes on

    n_nodes = len(tree.turn)
    conv_ids, counts, digests = (heads.column(c).to_pylist() for c in ("conv_id", "n", "ends"))
    members, least, children, leaves, saved = [0] * n_nodes, [1 << 63] * n_nodes, [0] * n_nodes, [0] * n_nodes, [0] * n_nodes
    for node, i in end.items():
        members[node], least[node] = counts[i], conv_ids[i]
    for v in range(n_nodes - 1, -1, -1):
        own = v not in foreign
        if tree.next[v] < 0 and v != continued:
            leaves[v] = 1
        saved[v] += (members[v] - own) * tree.size[v]
        if v:
            up = tree.up[v]
            members[up] += members[v]
            least[up] = min(least[up], least[v])
            children[up] += own
            leaves[up] += leaves[v]
            saved[up] += saved[v]
    shard = heads.column("shard")[0].as_py()
    ups = tree.up
    return pa.Table.from_arrays([
        pa.array([shard] * n_nodes, pa.int32()), pa.array(tree.depth, pa.int64()), pa.array([keys.get(v) for v in range(n_nodes)], pa.binary()),
        pa.array([keys.get(u) for u in ups], pa.binary()), pa.array(least, pa.int64()), pa.array([least[u] if u >= 0 else None for u in ups], pa.int64()),
        pa.array(members, pa.int64()), pa.array(children, pa.int64()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()),
        pa.array([digests[end[v]] if v in end else None for v in range(n_nodes)], pa.binary())], schema=_NODES)


def prefix_trie(found: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of ``found (conv_id, turns)``, whose ids are distinct.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    and ``ends_sha256`` of the ids that end at the node. A conversation without turns is a member of the root. Sequences that repeat are
    one path with all their members. A very long sequence is one row and its nodes are made in one task. No conversations give no nodes.
    """
    digests = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    paths = found.select("conv_id", digests.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    paths = written(paths.withColumn("key", F.unhex(F.md5("path"))), "paths")
    known = written(ends(paths), "ends")
    heads = known.drop("key").join(paths.drop("key"), "conv_id")
    turns = heads.agg(F.sum(F.size("sizes"))).first()[0] or 0
    heads = written(heads.repartitionByRange(1 + turns // shard_turns, "path").withColumn("shard", F.spark_partition_id()), "shards")
    in_order = Window.orderBy("shard")  # one row per shard
    edges = heads.groupBy("shard").agg(F.min("path").alias("low"), F.max("path").alias("high")).select(
        "shard", F.lag("high").over(in_order).alias("before"), F.lead("low").over(in_order).alias("after"))

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        return shard_nodes(left, right.column("before")[0].as_py(), right.column("after")[0].as_py())

    nodes = written(heads.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(build, _NODE_COLUMNS), "nodes")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    columns = ["conv_id", "depth", "parent_conv_id", *figures, "ends"]
    shared = nodes.where("key IS NOT NULL")
    whole = written(shared.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"),
        *[F.sum(c).alias(c) for c in figures], F.max("ends").alias("ends")), "boundary")
    smallest = whole.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    boundary = whole.join(smallest, "parent", "left").select(*columns)
    # A boundary node may have very many children; those of one shard are no more than its turns.
    near = shared.select("shard", F.col("key").alias("parent")).join(smallest, "parent")
    below = nodes.where("key IS NULL AND parent IS NOT NULL").drop("parent_conv_id").join(near, ["shard", "parent"]).select(*columns)
    inner = nodes.where("key IS NULL AND parent IS NULL").select(*columns)
    every = inner.unionByName(below).unionByName(boundary)
    return every.select(*columns[:-1], F.coalesce(F.lower(F.hex("ends")), F.lit(NO_ENDS)).alias("ends_sha256"))
