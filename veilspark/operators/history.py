"""Policies with a history: which version was in force when a request came.

An as-of join without a join of ranges: requests and versions are put together, sorted by time, and each request
takes the last version before it.  A key's rows are dealt by spans of time (``width`` seconds), so that a tenant with a
third of all requests is many groups; what a span begins with is the last version of the spans before it, worked out
on one narrow row for each key and span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 86_400


def as_of(rows: DataFrame, versions: DataFrame, key: str, ts: str, since: str, width: int = WIDTH, keep: str = "version") -> DataFrame:
    """``rows`` with ``keep``: the struct of the version (its columns but the key) with the latest ``since`` that is not behind ``ts``.

    Of versions of one key and time, the largest counts, by its columns in order.  Rows without a key or a time, and rows before
    the first version, have null; versions without a key or a time are in force never; a column of the rows that is
    named as ``keep`` is replaced."""
    rows = rows.drop(keep)
    span = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / (width * 1_000_000))
    value = F.struct(F.col(since), *[c for c in versions.columns if c not in (key, since)])
    known = versions.filter(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("__key"), span(F.col(since)).alias("__span"), value.alias(keep))
    known = known.withColumn("__at", F.col(f"{keep}.{since}"))
    live = F.col(key).isNotNull() & F.col(ts).isNotNull()
    given = rows.filter(live).select(F.col(key).alias("__key"), span(F.col(ts)).alias("__span"), F.col(ts).alias("__at"), F.struct(*rows.columns).alias("__row"))

    # What each span begins with: the last version of the spans before it.
    last = known.groupBy("__key", "__span").agg(F.max(keep).alias("__last"))
    spans = last.unionByName(given.select("__key", "__span").distinct(), allowMissingColumns=True).groupBy("__key", "__span").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy("__key").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("__key", "__span", F.last("__last", ignorenulls=True).over(before).alias("__carried"))

    every = known.unionByName(given, allowMissingColumns=True)
    order = Window.partitionBy("__key", "__span").orderBy("__at", F.col("__row").isNotNull(), keep).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.withColumn("__found", F.last(keep, ignorenulls=True).over(order)).filter("__row is not null")
    out = found.join(carried, ["__key", "__span"], "left").select("__row.*", F.coalesce("__found", "__carried").alias(keep))
    none: Column = F.lit(None).cast(out.schema[keep].dataType).alias(keep)
    return out.unionByName(rows.filter(~live).select(*rows.columns, none))


def policies_in_force(requests: DataFrame, versions: DataFrame, width: int = WIDTH) -> DataFrame:
    """``requests`` (tenant, ts as timestamp) with the ``policy`` of their time; ``versions``: tenant, since, and a policy's columns."""
    return as_of(requests, versions, "tenant", "ts", "since", width, "policy")
