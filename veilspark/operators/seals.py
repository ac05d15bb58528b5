"""Audit records in sealed segments, for chains that one task cannot fold.

A segment is ``size`` consecutive numbers of a key.  Its records' hashes are the leaves of a Merkle tree, built in Spark
expressions over one row for each segment, so a key with most of all records is verified by many tasks.  Only the
segments' roots are chained, one short row each.  ``anchors`` (key, segments, records, head), kept elsewhere, show what
there was: a chain that lost its newest records is shorter than its anchor.

Leaves and inner nodes are hashed with different first bytes, so that neither can stand for the other; a node without a
neighbour goes up as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.digests import canonical_json
from veilspark.operators import audit
from veilspark.operators.redact import bound

SIZE = 1024
SEALED = ("segment", "n", "first", "last", "root")  # what a head covers, in order


def leaf(seq: str = "seq") -> Column:
    """Hash of a record with its number."""
    fields = {audit.JSON_NAMES.get(c, c): F.col(c) for c in audit.FIELDS} | {"seq": F.col(seq)}
    return F.sha2(F.concat(F.lit("\0"), canonical_json(fields, maps=("entityCounts",))), 256)


def _level(nodes: Column) -> Column:
    """The parents of a row of nodes."""
    two = lambda i: F.sha2(F.concat(F.lit("\1"), F.get(nodes, i * 2), F.get(nodes, i * 2 + 1)), 256)
    return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1)), lambda i: F.when(i * 2 + 1 < F.size(nodes), two(i)).otherwise(F.get(nodes, i * 2)))


def _levels(size: int) -> int:
    return max(size - 1, 0).bit_length()


def root(leaves: Column, size: int = SIZE) -> Column:
    """The root over an array of at most ``size`` leaves, not empty."""

    def up(nodes: Column, left: int) -> Column:
        return bound(_level(nodes), lambda n: up(n, left - 1)) if left else F.get(nodes, F.lit(0))

    return up(leaves, _levels(size))


def segments(records: DataFrame, key: str, size: int = SIZE, seq: str = "seq") -> DataFrame:
    """key, segment, n, first, last, root: one row for each segment that has records. Repeated numbers are leaves each."""
    number = F.floor(F.col(seq) / size).alias("segment")
    leaves = records.select(key, number, F.struct(F.col(seq).alias("seq"), leaf(seq).alias("leaf")).alias("l"))
    each = leaves.groupBy(key, "segment").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    # More than ``size`` only where numbers repeat; counted without hashing a record.
    longest = records.groupBy(key, number).count().agg(F.max("count")).first()[0] or 1
    tree = bound(F.transform("ls", lambda x: x["leaf"]), lambda leaves: root(leaves, longest))  # bound, or each node would list all leaves again
    return each.select(key, "segment", F.size("ls").cast("bigint").alias("n"), F.get("ls", F.lit(0))["seq"].alias("first"), F.element_at("ls", -1)["seq"].alias("last"), tree.alias("root"))


def seal(records: DataFrame, key: str, size: int = SIZE, seq: str = "seq") -> DataFrame:
    """``segments`` with ``head``: each root chained to the head before it."""
    return _headed(segments(records, key, size, seq), key)


def _headed(rows: DataFrame, key: str) -> DataFrame:
    """``head`` beside each segment. A chain is a sequential fold: one pass over a key's segments in order, one short row each, carries the
    head along, so that no chain has to fit in memory and none is copied as it grows."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in SEALED])
    kept = rows.select(key, *SEALED)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = object(), audit.GENESIS
        for batch in batches:
            heads = []
            for k, text in zip(batch.column(key).to_pylist(), batch.column("__line").to_pylist(), strict=True):
                if k != now:
                    now, head = k, audit.GENESIS
                head = hashlib.sha256(f"{head}|{text}".encode()).hexdigest()
                heads.append(head)
            names = [n for n in batch.schema.names if n != "__line"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(heads, pa.string())], names=[*names, "head"])

    ordered = kept.withColumn("__line", line).repartition(key).sortWithinPartitions(key, *SEALED)
    return ordered.mapInArrow(fold, T.StructType(kept.schema.fields).add("head", "string"))


def anchors(sealed: DataFrame, key: str) -> DataFrame:
    """What to keep elsewhere: key, segments, records, head of the newest segment."""
    return sealed.groupBy(key).agg(F.count("*").alias("segments"), F.sum("n").alias("records"), F.max_by("head", "segment").alias("head"))


def verify(records: DataFrame, sealed: DataFrame, anchored: DataFrame, key: str, size: int = SIZE, seq: str = "seq") -> DataFrame:
    """key, ok, reason (of the first segment that is wrong) and ``segment``: records against their seals, seals against their chain, the
    chain against its anchor. A key that is anchored and has nothing left is ``truncated``."""
    now = segments(records, key, size, seq).select(key, "segment", F.col("root").alias("now"))
    sealed_ = sealed.select(key, "segment", "n", "first", "last", "root", "head")
    again = _headed(sealed_.drop("head"), key).select(key, "segment", F.col("head").alias("again"))
    rows = sealed_.join(again, [key, "segment"]).join(now, [key, "segment"], "full")
    why = (
        F.when(F.col("root").isNull(), F.lit("unsealed records")).when(F.col("now").isNull(), F.lit("records missing")).when(F.col("now") != F.col("root"), F.lit("records changed"))
        .when(F.col("again") != F.col("head"), F.lit("seal changed"))
    )
    each = rows.withColumn("why", why).groupBy(key).agg(
        F.min(F.when(F.col("why").isNotNull(), F.struct("segment", "why"))).alias("wrong"), F.count("head").alias("segments"), F.max_by("head", "segment").alias("newest"),
    )
    out = each.join(anchored.select(key, F.col("segments").alias("__segments"), F.col("head").alias("__head")), key, "full")
    shorter = F.when(F.coalesce("segments", F.lit(0)) < F.col("__segments"), F.lit("truncated")).when((F.col("segments") == F.col("__segments")) & (F.col("newest") != F.col("__head")), F.lit("anchor differs"))
    reason = F.coalesce(shorter, F.col("wrong.why"))
    return out.select(key, reason.isNull().alias("ok"), reason.alias("reason"), F.when(shorter.isNull(), F.col("wrong.segment")).alias("segment"))


def proof(leaves: Column, place: Column, size: int = SIZE) -> Column:
    """For the leaf at a place: its path's neighbours from below, array of ``sibling`` and ``left`` (does it stand left); none for a node without one."""
    steps = F.array().cast("array<struct<sibling:string,left:boolean>>")

    def up(nodes: Column, at: Column, left: int, found: Column) -> Column:
        if not left:
            return found
        other = F.when(at % 2 == 0, at + 1).otherwise(at - 1)
        step = F.struct(F.get(nodes, other).alias("sibling"), (at % 2 == 1).alias("left"))
        more = F.when(other < F.size(nodes), F.concat(found, F.array(step))).otherwise(found)
        state = F.struct(_level(nodes).alias("nodes"), F.shiftright(at, 1).alias("at"), more.alias("found"))
        return bound(state, lambda s: up(s["nodes"], s["at"], left - 1, s["found"]))

    return up(leaves, place.cast("int"), _levels(size), steps)


def proves(leaf_hash: str, path: Sequence[tuple[str, bool]], expected: str) -> bool:
    """Does a path lead from a leaf to a root; for whoever holds one record and the root."""
    step: Callable[[str], str] = lambda text: hashlib.sha256(("\1" + text).encode()).hexdigest()
    for sibling, left in path:
        leaf_hash = step(sibling + leaf_hash if left else leaf_hash + sibling)
    return leaf_hash == expected
