"""How far two detectors agree: spans of one that overlap spans of the other.

An interval join by bins: a span stands in every bin of ``width`` characters that it touches, spans meet in equal bins
of their text, and a pair counts in the bin where the later one starts, so once.  No pair of a text's spans meets
unless they share a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 64


def _binned(spans: DataFrame, key: str, side: str, width: int) -> DataFrame:
    """``spans`` (key, start, end, type) as ``{side}_start``, ... once for each bin; empty spans touch nothing."""
    last = F.floor((F.col("end") - 1) / width)
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), last)).alias("bin")
    named = [F.col(c).alias(f"{side}_{c}") for c in ("start", "end", "type")]
    return spans.filter(F.col("end") > F.col("start")).select(F.col(key).alias("__key"), *named, bins)


def overlapping(a: DataFrame, b: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """Pairs of spans of one ``key`` that overlap: key, a_start, a_end, a_type, b_start, b_end, b_type, and ``shared`` characters. Null
    keys meet nothing; spans that repeat are pairs each."""
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    met = _binned(a, key, "a", width).join(_binned(b, key, "b", width), ["__key", "bin"])
    met = met.filter((start < end) & (F.col("bin") == F.floor(start / width)))
    return met.select(F.col("__key").alias(key), "a_start", "a_end", "a_type", "b_start", "b_end", "b_type", (end - start).alias("shared"))


def matrix(a: DataFrame, b: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """By types of both: pairs that overlap, and of these exact ones. What meets nothing of the other stands beside a null type."""
    pairs = overlapping(a, b, key, width)
    exact: Column = (F.col("a_start") == F.col("b_start")) & (F.col("a_end") == F.col("b_end"))
    both = pairs.groupBy("a_type", "b_type").agg(F.count("*").alias("pairs"), F.count_if(exact).alias("exact"))

    def alone(spans: DataFrame, side: str, other: str) -> DataFrame:
        met = pairs.select(key, F.col(f"{side}_start").alias("start"), F.col(f"{side}_end").alias("end"), F.col(f"{side}_type").alias("type")).distinct()
        left = spans.join(met, [key, "start", "end", "type"], "left_anti").groupBy(F.col("type").alias(f"{side}_type")).agg(F.count("*").alias("pairs"))
        return left.select(f"{side}_type", F.lit(None).cast("string").alias(f"{other}_type"), "pairs", F.lit(0).cast("bigint").alias("exact"))

    return both.unionByName(alone(a, "a", "b")).unionByName(alone(b, "b", "a"))
