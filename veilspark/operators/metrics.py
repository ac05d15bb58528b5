"""Operational metrics as aggregations over an outcomes table, and their text form.

``outcomes``: mode, entity_counts (type to number), active_sets, total, bypass_reason, failed_closed,
upstream_error, timing_src, ms.  All are partial aggregations before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("requests"), F.count_if(F.col("total") > 0).alias("redacted_requests"), F.coalesce(F.sum("total"), F.lit(0)).alias("redacted_entities"),
        F.count_if("failed_closed").alias("fail_closed"), F.count_if("upstream_error").alias("upstream_errors"), F.count_if(F.col("bypass_reason").isNotNull()).alias("bypassed"),
    )


def by_mode(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("mode").agg(F.count("*").alias("n"))


def dominant_mode(outcomes: DataFrame) -> DataFrame:
    return by_mode(outcomes).agg(F.max_by("mode", F.struct("n", "mode")).alias("mode"))


def by_type(outcomes: DataFrame) -> DataFrame:
    each = outcomes.select(F.explode("entity_counts").alias("type", "n"))
    return each.groupBy("type").agg(F.sum("n").alias("n"))


def by_set(outcomes: DataFrame) -> DataFrame:
    """A request's total counts for each of its active sets."""
    return outcomes.select(F.explode("active_sets").alias("set"), "total").groupBy("set").agg(F.sum("total").alias("n"))


def bypasses(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("bypass_reason is not null").groupBy(F.col("bypass_reason").alias("reason")).agg(F.count("*").alias("n"))


def latency(outcomes: DataFrame) -> DataFrame:
    timed = outcomes.filter("timing_src is not null").groupBy(F.col("timing_src").alias("source"))
    return timed.agg(F.count("*").alias("n"), F.round(F.avg("ms"), 1).alias("avg_ms"))


def shares(counts: DataFrame, name: str) -> DataFrame:
    """Counts with their share of the total, largest first."""
    whole = counts.agg(F.sum("n").alias("whole")).first()["whole"] or 0
    return counts.select(name, "n", (F.col("n") / F.lit(max(whole, 1))).alias("share")).orderBy(F.desc("n"), name)


def text_lines(counts: DataFrame, metric: str, label: str) -> DataFrame:
    """One exposition line per row."""
    return counts.select(F.concat(F.lit(f'{metric}{{{label}="'), F.col(label), F.lit('"} '), F.col("n").cast("string")).alias("line"))


#: Families of the text form in their order: name, label, what a row adds; counters without a label are there when nothing was counted.
TOTALS = ("requests_total", "redacted_requests_total", "redacted_entities_total", "bypass_total", "fail_closed_total", "upstream_errors_total")
LABELLED = ("requests_by_mode", "redacted_by_type", "redacted_by_set", "bypass_by_reason", "avg_latency_ms")
LABELS = {"requests_by_mode": "mode", "redacted_by_type": "type", "redacted_by_set": "set", "bypass_by_reason": "reason", "avg_latency_ms": "src"}


def exposition(outcomes: DataFrame, prefix: str = "redact") -> DataFrame:
    """The whole text form in one pass over the outcomes: ``place`` (order of lines) and ``line``.

    Every row adds to its families; what it adds is summed before the shuffle.  A label's backslashes, quotes and line ends are
    escaped."""
    one, total = F.lit(1).cast("double"), F.coalesce("total", F.lit(0)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    item = lambda family, label, value: F.struct(F.lit(family).alias("family"), label.cast("string").alias("label"), value.alias("x"))
    none = F.lit(None)
    values = (one, flag(F.col("total") > 0), total, flag(F.col("bypass_reason").isNotNull()), flag(F.col("failed_closed")), flag(F.col("upstream_error")))
    plain = F.array(*[item(n, none, v) for n, v in zip(TOTALS, values, strict=True)])
    single = F.array(item("requests_by_mode", F.col("mode"), one), item("bypass_by_reason", F.col("bypass_reason"), one), item("avg_latency_ms", F.col("timing_src"), F.col("ms").cast("double")))
    by_type = F.transform(F.map_entries("entity_counts"), lambda e: item("redacted_by_type", e["key"], e["value"].cast("double")))
    by_set = F.transform("active_sets", lambda s: item("redacted_by_set", s, total))
    labelled = F.filter(F.flatten(F.filter(F.array(single, by_type, by_set), lambda a: a.isNotNull())), lambda i: i["label"].isNotNull())
    rows = outcomes.select(F.explode(F.concat(plain, labelled)).alias("i")).select("i.*")
    spark = outcomes.sparkSession
    rows = rows.unionByName(spark.createDataFrame([(n, None, 0.0) for n in TOTALS], "family string, label string, x double"))
    sums = rows.groupBy("family", "label").agg(F.sum("x").alias("x"), F.avg("x").alias("mean"))
    order = F.array_position(F.array(*map(F.lit, TOTALS + LABELLED)), F.col("family")).cast("int")
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    escaped = F.regexp_replace(F.regexp_replace("label", r'([\\\\"])', r"\\$1"), "\n", r"\\n")
    shown = F.when(F.col("family") == "avg_latency_ms", F.round("mean", 1).cast("string")).otherwise(F.col("x").cast("bigint").cast("string"))
    label = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("{"), names[F.col("family")], F.lit('="'), escaped, F.lit('"}')))
    return sums.select(F.struct(order.alias("family"), F.coalesce("label", F.lit("")).alias("label")).alias("place"), F.concat(F.lit(prefix + "_"), F.col("family"), label, F.lit(" "), shown).alias("line"))


def document(outcomes: DataFrame, prefix: str = "redact") -> str:
    """The text as a scraper reads it: one line for each family and label."""
    return "".join(r.line + "\n" for r in exposition(outcomes, prefix).orderBy("place").collect())


#: Accuracy of the report's sketches: bits of the distinct counts, size of the quantile sketches.
HLL_BITS, KLL_SIZE = 12, 200
EXACT = ("requests", "entities", "bypassed", "failed_closed")


def hourly(outcomes: DataFrame) -> DataFrame:
    """The smallest groups of a report, as they can be kept: counts and mergeable sketches by hour, mode and tenant.  ``outcomes`` with
    ``ts`` and ``tenant``; null modes and tenants are groups of their own."""
    keys = (F.date_trunc("hour", "ts").alias("hour"), "mode", "tenant")
    return outcomes.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("entities"), F.count("bypass_reason").alias("bypassed"), F.count_if("failed_closed").alias("failed_closed"),
        F.hll_sketch_agg(F.col("tenant"), HLL_BITS).alias("tenants"), F.kll_sketch_agg_bigint(F.col("ms").cast("bigint"), F.lit(KLL_SIZE)).alias("latency"), F.count("ms").alias("timed"),
    )


def report(groups: DataFrame) -> DataFrame:
    """``hourly`` groups rolled up: every hour, every mode of an hour, every tenant of a mode, and all; ``level`` says how many keys a row has.
    Distinct tenants and latencies at the median and the 95th percentile are estimates, from merged sketches."""
    rolled = groups.groupingSets([[], ["hour"], ["hour", "mode"], ["hour", "mode", "tenant"]], "hour", "mode", "tenant").agg(
        (F.lit(3) - F.bit_count(F.grouping_id())).alias("level"), *[F.sum(c).alias(c) for c in EXACT],
        F.hll_sketch_estimate(F.hll_union_agg("tenants")).alias("tenants"), F.kll_merge_agg_bigint("latency").alias("latency"), F.sum("timed").alias("timed"),
    )
    at = lambda q: F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_bigint("latency", F.lit(q)))
    return rolled.select("hour", "mode", "tenant", F.col("level").cast("int").alias("level"), *EXACT, "tenants", at(0.5).alias("median_ms"), at(0.95).alias("p95_ms"))
