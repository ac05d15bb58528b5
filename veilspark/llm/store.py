"""Tables in the shared folder, as the rest of the library writes them, and how widely work is dealt."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.sources.shared import cut, shared_dir

__all__ = ["aside", "back", "cut", "parallelism", "release", "shared_dir"]


def parallelism(spark: SparkSession) -> int:
    """Partitions to deal work into: the session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def aside(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """``docs`` with columns of these names put aside, for steps that add columns of the same names; ``back`` undoes it."""
    return docs.withColumnsRenamed({c: f"__aside_{c}" for c in names if c in docs.columns})


def back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as they were, from what was made of ``aside``."""
    return out.select(*[F.col(c if f"__aside_{c}" not in out.columns else f"__aside_{c}").alias(c) for c in docs.columns])


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now, not when the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
