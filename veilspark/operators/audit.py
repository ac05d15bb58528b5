"""Audit records of counts, chained by hashes, and their verification.

A chain is a sequential fold, so there is one chain per key (tenant and day, say) and chains are built in
parallel: partitions are sorted by key and number, and one pass over each carries the last hash along, so no
chain has to fit in memory.  Verification needs no fold: every record is checked against the one before it.

    python -m veilspark.operators.audit PATH [KEY]     verifies audit lines; ends with 1 if a chain is broken
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.functions.digests import canonical_json

GENESIS = "0"
_HOLE = "~"
FIELDS = ("ts", "tenant", "provider", "model", "mode", "entity_counts", "sets", "total")
# The names of the fields in the hashed JSON.
JSON_NAMES = {"entity_counts": "entityCounts", "prev_hash": "prevHash"}


def link_hash(prev: Column) -> Column:
    """Hash of a record given the hash before it."""
    fields = {JSON_NAMES.get(c, c): F.col(c) for c in FIELDS} | {"prevHash": prev}
    return F.sha2(F.concat(prev, canonical_json(fields, maps=("entityCounts",))), 256)


def chain(records: DataFrame, key: str, seq: str = "seq", heads: DataFrame | None = None) -> DataFrame:
    """Add ``prev_hash`` and ``hash``; ``heads`` (key, head) continues chains that exist. A null key is a chain of its own."""
    rows = records.withColumn("__json", canonical_json({JSON_NAMES.get(c, c): F.col(c) for c in FIELDS} | {"prevHash": F.lit(_HOLE)}, maps=("entityCounts",)))
    rows = rows.join(heads, key, "left") if heads is not None else rows.withColumn("head", F.lit(None).cast("string"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prev = object(), GENESIS
        for batch in batches:
            prevs, hashes = [], []
            for k, text, head in zip(*(batch.column(n).to_pylist() for n in (key, "__json", "head")), strict=True):
                if k != now:
                    now, prev = k, head or GENESIS
                prevs.append(prev)
                # The field stands once, under its name; a value that looks like it has its quotes escaped.
                prev = hashlib.sha256((prev + text.replace(f'"prevHash":"{_HOLE}"', f'"prevHash":"{prev}"', 1)).encode()).hexdigest()
                hashes.append(prev)
            kept = [n for n in batch.schema.names if n not in ("__json", "head")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=[*kept, "prev_hash", "hash"])

    ordered = rows.repartition(key).sortWithinPartitions(key, seq)
    return ordered.mapInArrow(fold, records.schema.add("prev_hash", "string").add("hash", "string"))


def heads(chained: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    return chained.groupBy(key).agg(F.max_by("hash", seq).alias("head"))


def recover_heads(lines: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """What ``chain`` goes on from after a stop, of lines as ``io.read_audit`` gives them: key, ``head`` and ``last`` (hash and number of the newest whole
    record; none: a new chain) and ``torn`` (lines that could not be read; they stay where they are and show in ``verify``)."""
    whole = F.when(F.col("hash").isNotNull(), F.col(seq))
    return lines.groupBy(key).agg(F.max_by("hash", whole).alias("head"), F.max(whole).alias("last"), F.count_if(F.col("hash").isNull()).alias("torn"))


def verify(chained: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Per chain: records, ok, the place of the first break and why; an unparseable record has a null hash."""
    w = Window.partitionBy(key).orderBy(seq)
    before = F.coalesce(F.lag("hash").over(w), F.when(F.row_number().over(w) == 1, F.lit(GENESIS)))
    reason = (
        F.when(F.col("hash").isNull(), F.lit("unparseable line"))
        .when(~F.col("prev_hash").eqNullSafe(F.col("__before")), F.lit("prevHash mismatch"))
        .when(link_hash(F.col("prev_hash")) != F.col("hash"), F.lit("hash mismatch"))
    )
    rows = chained.withColumns({"__before": before, "__i": F.row_number().over(w) - 1}).withColumn("__why", reason)
    broken = F.col("__why").isNotNull()
    return rows.groupBy(key).agg(
        F.count("*").alias("records"), (F.count_if(broken) == 0).alias("ok"), F.min(F.when(broken, F.col("__i"))).alias("broken_at"),
        F.min_by(F.col("__why"), F.when(broken, F.col("__i"))).alias("reason"),
    )


def main(arguments: Sequence[str]) -> int:
    """Verify the audit lines of a path, by tenant or by another column."""
    from pyspark.sql import SparkSession

    from veilspark.sources import io

    spark = SparkSession.builder.appName("audit").getOrCreate()
    broken = verify(io.read_audit(spark, arguments[0]), arguments[1] if len(arguments) > 1 else "tenant").filter("not ok")
    worst = broken.orderBy("broken_at").limit(20).collect()  # a report of the first few
    for r in worst:
        print(f"{r[0]}: {r['reason']} at {r['broken_at']} of {r['records']}")
    if not worst:
        print("ok")
    return int(bool(worst))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
