"""Tables written to the folder that the driver and all executors share, to cut lineage.

A cluster names the folder in ``spark.checkpoint.dir``.  Where that is unset (local tests) a temporary
folder is made once per application and goes with the driver's process; a cluster without the setting is
refused, because a machine-local folder would be invisible to the other executors.  Tables stay until the
application's folder is deleted: results that are not computed yet read them.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new URI below the shared folder; nothing is created there yet."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        base = _LOCAL[app]
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base if base.startswith("/") else base
    return f"{base.rstrip('/')}/{app}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A table whose rows stand in fewer parts than the session has cores, dealt over all of them, for work that costs more than the
    shuffle. Larger tables are left as they are, so nothing large is shuffled. Parts without rows do not count: a file is
    cut by its bytes, but the rows of a row group are all read by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < cores or df.select(F.spark_partition_id()).distinct().count() < cores
    return df.repartition(cores) if few else df


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs a re-read only.

    Written Parquet is used rather than ``checkpoint()``, which would compute the plan twice.  It lies there to the end, so it
    is packed more tightly than by default.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
