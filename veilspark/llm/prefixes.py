"""The trie of conversations' shared beginnings, built from adaptive radix trees.

A turn's id is fixed in width and big-endian: 16 bytes of the SHA-256 of its role and text, then its number of words.
A conversation is the bytes of its turns' ids, and all conversations are range-partitioned by these bytes and their
numbers over shards whose splitters are sampled; so even copies of one conversation are dealt over several.  Each
shard is an adaptive radix tree: inner nodes have one of four layouts that grow as children come, and paths without
a branch are compressed.  Byte depths between turns are structure only; a node is given out where a turn ends.

What neighbouring shards share is a prefix of a shard's first or last key, known from all shards' first and last
keys alone.  A shard counts a shared node's own part only if no earlier shard has the node, and takes a node for
childless only if no later shard has it, so that all numbers of shared nodes add up over shards.  These few are
merged in a second step; all others are final where they are made.

Defined results: rows without a conversation's number belong to none and are left out; null roles and texts are
empty; turns come by number, null first, and turns of one number by their ids; rows that repeat are turns each;
a tree without conversations has no nodes; other columns are not read.  A conversation's ids are one row (20 bytes a
turn, so at most 100 million turns), and are put in order by one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.store import cut, parallelism

WIDTH = 20  # bytes of a turn's id
SHARD_BYTES = 4 << 20
FEW = 500  # conversations a shard has at least, if they are less than its bytes allow
SAMPLED = 20  # keys sampled for a splitter
SMALL = 1 << 16  # shared nodes up to which they are broadcast: 5 MB
SPREAD = 64  # parts that children of a shared node are dealt into beyond that
SPACES = r"[\x20\x09-\x0D]+"
_NONE = hashlib.sha256(b"").hexdigest()
_NODE = (
    "node binary, parent_node binary, shard int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends string, ends_sha256 string"
)
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# --- the tree


class Sorted:
    """Up to 4, then up to 16 children: their bytes in order, the children beside them."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int = 4):
        self.bytes, self.nodes, self.room = bytearray(), [], room

    def get(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return self.nodes[at] if at >= 0 else None

    def put(self, byte: int, node: Node) -> Sorted | Indexed:
        """With a child more, or in place of the one it has."""
        at = self.bytes.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.bytes) == self.room:
            grown = Sorted(16) if self.room == 4 else Indexed()
            for b, n in self.items():
                grown.put(b, n)
            return grown.put(byte, node)
        at = bisect_right(self.bytes, byte)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.nodes, strict=True)


class Indexed:
    """Up to 48 children: 256 places, each with the child's number from 1, or 0."""

    __slots__ = ("places", "nodes")

    def __init__(self):
        self.places, self.nodes = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        return self.nodes[self.places[byte] - 1] if self.places[byte] else None

    def put(self, byte: int, node: Node) -> Indexed | Full:
        if self.places[byte]:
            self.nodes[self.places[byte] - 1] = node
            return self
        if len(self.nodes) == 48:
            grown = Full()
            for b, n in self.items():
                grown.put(b, n)
            return grown.put(byte, node)
        self.nodes.append(node)
        self.places[byte] = len(self.nodes)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.nodes[i - 1]) for b, i in enumerate(self.places) if i)


class Full:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes: list[Node | None] = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Full:
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Node:
    """``path``: the bytes behind the one that leads here; ``ends``: what ends here; ``below``: a layout, if there are children."""

    __slots__ = ("path", "ends", "below")

    def __init__(self, path: bytes, ends: list[int], below: Sorted | Indexed | Full | None = None):
        self.path, self.ends, self.below = path, ends, below

    def child(self, byte: int) -> Node | None:
        return self.below.get(byte) if self.below is not None else None

    def put(self, byte: int, node: Node) -> None:
        self.below = (self.below or Sorted()).put(byte, node)


def _common(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``path`` the key has at a place."""
    if key.startswith(path, at):
        return len(path)
    return next(i for i, b in enumerate(path) if at + i == len(key) or key[at + i] != b)


class Tree:
    """Keys of whole turns, each with the numbers of the conversations that end there, in the order in which they came."""

    def __init__(self):
        self.root = Node(b"", [])

    def add(self, key: bytes, number: int) -> None:
        node, at, above, led = self.root, 0, None, 0
        while True:
            m = _common(node.path, key, at)
            if m < len(node.path):  # the path is cut where the key leaves it
                upper = Node(node.path[:m], [])
                upper.put(node.path[m], node)
                node.path = node.path[m + 1 :]
                above.put(led, upper)
                node = upper
            at += m
            if at == len(key):
                node.ends.append(number)
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at + 1 :], [number]))
                return
            above, led, node, at = node, key[at], below, at + 1


class Below:
    """What a walk has added up below a place: conversations and their least number, the next turns' nodes (all of
    this shard, and those that count here), childless nodes, tokens saved, and the rows that wait for their parent."""

    __slots__ = ("least", "n", "tops", "own", "leaves", "saved", "waiting")

    def __init__(self):
        self.least, self.n, self.tops, self.own, self.leaves, self.saved, self.waiting = None, 0, 0, 0, 0, 0, []

    def take(self, x: Below) -> None:
        self.least = x.least if self.least is None else min(self.least, x.least)
        self.n += x.n
        self.tops += x.tops
        self.own += x.own
        self.leaves += x.leaves
        self.saved += x.saved
        if len(self.waiting) < len(x.waiting):
            self.waiting, x.waiting = x.waiting, self.waiting
        self.waiting += x.waiting


def walk(tree: Tree, shard: int, before: bytes | None, after: bytes | None) -> list[list]:
    """Rows of ``_NODE`` for a shard. ``before`` and ``after``: what its first key shares with the shard before it, its last
    key with the one behind it; none if there is no such shard."""
    rows: list[list] = []
    path = bytearray()

    def turn(at: int, ends: list[int], x: Below) -> None:
        """The node of the turn that ends at byte ``at``."""
        prefix = bytes(path[:at])
        shared, goes_on = before is not None and before.startswith(prefix), after is not None and after.startswith(prefix)
        words = int.from_bytes(prefix[-4:], "big") if at else 0
        x.leaves += x.tops == 0 and not goes_on
        x.saved += x.n * words - (0 if shared else words)
        node, listed = None, ",".join(map(str, ends))
        if shared or goes_on:
            node = hashlib.sha256(prefix).digest()
        for i in x.waiting:
            rows[i][5 if node is None else 1] = x.least if node is None else node
        digest = None if node is not None else hashlib.sha256(listed.encode()).hexdigest() if ends else _NONE
        x.waiting = [len(rows)]
        rows.append([node, None, shard, x.least, at // WIDTH, None, x.n, x.own, x.leaves, x.saved, listed if node is not None and ends else None, digest])
        x.tops, x.own = 1, int(not shared)

    def leave(node: Node, start: int, x: Below) -> None:
        """All turns that end on a node's way, the last first."""
        if node.ends:
            x.n += len(node.ends)
            x.least = node.ends[0] if x.least is None else min(x.least, node.ends[0])
        for at in range(len(path) // WIDTH * WIDTH, start, -WIDTH):
            turn(at, node.ends if at == len(path) else [], x)
        del path[start:]

    stack = [(tree.root, 0, iter(tree.root.below.items() if tree.root.below else ()), Below())]
    while True:
        node, start, todo, x = stack[-1]
        step = next(todo, None)
        if step is not None:
            byte, child = step
            stack.append((child, len(path), iter(child.below.items() if child.below else ()), Below()))
            path.append(byte)
            path += child.path
            continue
        stack.pop()
        leave(node, start, x)
        if not stack:
            if x.n:
                turn(0, node.ends, x)
            return rows
        stack[-1][3].take(x)


# --- the tables


def turns(conversations: DataFrame) -> DataFrame:
    """Each conversation's turns in order: ``conv_id``, ``turns`` (array of binary ids)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    words = F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.concat(digest, F.lpad(F.hex(words), 8, "0"))).alias("id")
    )
    each = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id"))).alias("ts"))
    return each.select("conv_id", F.transform("ts", lambda t: t["id"]).alias("turns"))


def branched(own: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % ``group``, then its own behind its first h;
    h is the unsigned CRC-32 of the decimal c modulo ``heads``."""
    first = own.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": h}).join(first, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(taken, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _keyed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([b"".join(t) for t in batch.column("turns").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), keys], names=["conv_id", "key"])

    return rows.mapInArrow(run, "conv_id bigint, key binary")


def _splitters(paths: DataFrame) -> list[tuple[bytes, int]]:
    """Where shards end, by a sample of about ``SAMPLED`` keys for each."""
    n, size = paths.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()
    shards = max(-(-size // SHARD_BYTES), min(parallelism(paths.sparkSession), -(-n // FEW)))
    if shards < 2:
        return []
    some = sorted((bytes(r.key), r.conv_id) for r in paths.sample(min(1.0, shards * SAMPLED / n), seed=7).collect())
    return sorted({some[i * len(some) // shards] for i in range(1, shards)}) if some else []


def _sharded(paths: DataFrame, splitters: list[tuple[bytes, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            shards = pa.array([bisect_right(splitters, r) for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shards], names=["conv_id", "key", "shard"])

    return paths.mapInArrow(run, "conv_id bigint, key binary, shard int")


def _shared(a: bytes, b: bytes) -> bytes:
    """The whole turns that two keys have in common."""
    size = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[: size // WIDTH * WIDTH]


def _borders(sharded: DataFrame) -> dict[int, tuple[bytes | None, bytes | None]]:
    """What each shard shares with its neighbours; two keys for each shard come to the driver."""
    edges = sorted((r.shard, bytes(r.first), bytes(r.last)) for r in sharded.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect())
    if not edges:
        return {}
    common = [_shared(a[2], b[1]) for a, b in pairwise(edges)]
    return {e[0]: (b, a) for e, b, a in zip(edges, [None, *common], [*common, None], strict=True)}


def _built(sharded: DataFrame, borders: dict, shards: int) -> DataFrame:
    names = [f.split()[0] for f in _NODE.split(", ")]
    kinds = {"binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _NODE.split(", ")])

    def given(tree: Tree, shard: int) -> Iterator[pa.RecordBatch]:
        rows = walk(tree, shard, *borders[shard])
        for at in range(0, len(rows), 20_000):
            columns = zip(*rows[at : at + 20_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, columns, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree = None, Tree()
        for batch in batches:
            for number, key, shard in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "key", "shard")), strict=True):
                if shard != now:
                    if now is not None:
                        yield from given(tree, now)
                    now, tree = shard, Tree()
                tree.add(key, number)
        if now is not None:
            yield from given(tree, now)

    return sharded.repartition(shards, "shard").sortWithinPartitions("shard", "key", "conv_id").mapInArrow(run, _NODE)


def _ends(nodes: DataFrame) -> DataFrame:
    """The hash of what ends at shared nodes: one pass over the shards' lists in order, so that no list has to be whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if node != now:
                    done += [(now, digest.hexdigest())] if now is not None else []
                    now, digest = node, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    lists = nodes.filter("ends is not null").select("node", "shard", "ends")
    return lists.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(run, "node binary, ends_sha256 string")


def _with_parents(rows: DataFrame, merged: DataFrame, small: bool) -> DataFrame:
    parents = merged.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("__parent"))
    known = F.coalesce("parent_conv_id", "__parent").alias("parent_conv_id")
    if small:
        out = rows.join(F.broadcast(parents), "parent_node", "left")
        return out.select(*[known if c == "parent_conv_id" else c for c in COLUMNS])
    some = rows.filter("parent_node is not null").withColumn("__deal", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SPREAD)))
    copies = parents.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")))
    out = some.join(copies, ["parent_node", "__deal"], "left").select(*[known if c == "parent_conv_id" else c for c in COLUMNS])
    return out.union(rows.filter("parent_node is null").select(*COLUMNS))


def nodes(paths: DataFrame) -> DataFrame:
    """``paths`` (conv_id, turns: array of ids) to one row of ``COLUMNS`` for each distinct beginning."""
    paths = cut(_keyed(paths), "trie_paths")
    splitters = _splitters(paths)
    sharded = _sharded(paths, splitters)
    borders = _borders(sharded)
    made = cut(_built(sharded, borders, len(splitters) + 1), "trie_nodes")
    shared = made.filter("node is not null").groupBy("node").agg(
        F.max("parent_node").alias("parent_node"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    merged = cut(shared.join(_ends(made), "node", "left").fillna(_NONE, ["ends_sha256"]), "trie_shared")
    whole = made.filter("node is null").select("parent_node", *COLUMNS).unionByName(merged.select("parent_node", *COLUMNS))
    number = sum(len(x) // WIDTH + 1 for pair in borders.values() for x in pair if x is not None)
    return _with_parents(whole, merged, number <= SMALL)


def trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are branched."""
    return nodes(branched(cut(turns(conversations), "trie_turns")))
