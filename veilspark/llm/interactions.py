"""How filters interact: what each removes, at every place in every order of them, and what it removes alone.

Every document gets a mask of the filters it fails.  What happens to it under an order depends on its mask only: it
is removed at the least place that one of its filters has, a product of the mask matrix with the orders' inverse
permutations in which sums are minima.  So documents are counted by part and mask first, in Spark, and the
removal steps are worked out once for all masks and orders; each part's counts are then scattered over them by
weight.  A part takes 32 rows of counts at most, whatever the number of documents.

Whether a text is identical to one with a smaller id is told by its SHA-256.  Documents are counted by text, part,
labels and id before equal texts meet, so a text that a third of the rows share meets itself in a few rows.

Defined results: a null text is an empty one and fails A only (or E); a null part is the empty string; a null id is
neither smaller nor larger than another and has no label; rows that repeat count each, and those that repeat the
smallest id of their text pass E; of several labels of an id, any that says good or toxic counts; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_NEVER = len(FILTERS) + 1
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def failed(text: str) -> int:
    """The filters A to D that a text fails, as bits; words are runs of anything but space and the controls 9 to 13."""
    data = text.encode()
    words = data.split()
    few = len(words) < 50
    plain = 100 * len(set(words)) < 65 * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _CAPITALS))) > 5 * len(text)
    odd = len(data.translate(None, SYMBOLS)) < len(data)
    return few | plain << 1 | loud << 2 | odd << 3


def judged(docs: DataFrame, part: str, text: str, key: str) -> DataFrame:
    """One narrow row per document: ``doc``, ``part``, ``mask`` of A to D and the text's ``hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            masks = pa.array([failed(t) for t in texts], pa.int32())
            hashes = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), masks, hashes], names=["doc", "part", "mask", "hash"])

    given = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("__text"))
    return given.mapInArrow(run, "doc bigint, part string, mask int, hash binary")


def masks(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents by part and mask: n, good and toxic."""
    # Rows that repeat an id and a text become one with its number; null ids are dealt out by their texts' hashes.
    once = judged(docs, part, text, key).groupBy("doc", "part", "mask", "hash").agg(F.count("*").alias("n"))
    once = once.withColumn("deal", F.when(F.col("doc").isNull(), F.xxhash64("hash")).otherwise(0))
    known = labels.groupBy(F.col(key).cast("long").alias("doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.select("doc", F.lit(0).cast("long").alias("deal"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = once.join(known, ["doc", "deal"], "left").fillna(0, ["good", "toxic"])
    # Ids are distinct within a group of these, so min_by has the number of rows with the least id.
    same = rows.groupBy("hash", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc").isNull(), F.col("n")).otherwise(0)).alias("unnumbered"),
        F.min("doc").alias("least"), F.coalesce(F.min_by("n", "doc"), F.lit(0)).alias("of_least"),
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("hash"))
    passing = F.col("unnumbered") + F.when(first, F.col("of_least")).otherwise(0)
    same = same.withColumn("passing", passing)
    split = F.inline(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    each = same.select("part", "good", "toxic", split).groupBy("part", "mask")
    return each.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def removal_steps() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders; the place (from 1) of each filter in each order; and the step at which each mask goes under each order:
    the min-plus product of masks (0 where a filter is failed, else never) with places."""
    orders = list(permutations(range(len(FILTERS))))
    places = np.argsort(np.array(orders), axis=1) + 1  # inverse permutations: order, filter
    bits = np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS)) & 1
    cost = np.where(bits == 1, 0, _NEVER)
    steps = np.minimum((cost[:, None, :] + places[None, :, :]).min(axis=2), _NEVER)  # mask, order
    return ["".join(FILTERS[f] for f in o) for o in orders], places, steps


def report(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Of one part: ``counts`` (mask; n, good, toxic) to the columns of ``COUNTS`` by order and step."""
    orders, places, steps = removal_steps()
    n_orders, n_steps, every = len(orders), len(FILTERS), np.arange(len(orders))
    gone = np.zeros((n_orders, _NEVER + 1, 3), np.int64)
    np.add.at(gone, (np.broadcast_to(every, steps.shape), steps), np.broadcast_to(counts[:, None, :], (*steps.shape, 3)))
    bits = np.arange(1 << n_steps)[:, None] >> np.arange(n_steps) & 1
    total = counts[:, 0].sum()
    failing = (bits * counts[:, :1]).sum(axis=0)  # by filter
    alone = counts[1 << np.arange(n_steps), 0]
    by_filter = np.take_along_axis(gone[:, :, 0], places, axis=1)  # what a filter removes: order, filter
    at = np.argsort(places, axis=1)  # the filter of each step
    removed = gone[:, 1 : n_steps + 1, 0]
    return {
        "kept": total - removed.cumsum(axis=1), "removed": removed, "redundant": failing[at] - removed, "unique_fails": alone[at],
        "good_lost": gone[:, 1 : n_steps + 1, 1], "toxic_lost": gone[:, 1 : n_steps + 1, 2], "shapley": by_filter.sum(axis=0)[at],
    }


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per part, order and step, with ``COUNTS``."""
    names = removal_steps()[0]
    orders = np.repeat(np.array(names, dtype=object), len(FILTERS))
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                counts = np.zeros((1 << len(FILTERS), 3), np.int64)
                for r in rows:
                    counts[r["mask"]] = r["n"], r["good"], r["toxic"]
                columns = [pa.array([name] * len(orders), pa.string()), pa.array(orders, pa.string()), pa.array(steps)]
                made = report(counts)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(made[c].reshape(-1)) for c in COUNTS)], schema=schema)

    schema = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in COUNTS)])
    each = masks(docs, labels, part, text, key).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))  # 32 at most
    return each.mapInArrow(run, OUT)
