"""Mixing sources to target weights by temperature.

A source's share of tokens p becomes the weight q, p to the power a, normalised.  The exponent a between 0 and
1 is bisected until the weights reach a target entropy, or until no source is repeated more often than a
limit.  The budget defaults to the least that gives every source at least one whole pass, so no document is
left out; with a given budget, sources with fewer tokens to give than their share are repeated and others cut.

Weights become documents as block permutations.  A source is dealt into blocks of about ``block_docs``
documents by a hash; each pass takes the blocks in an order of its own, and the last pass stops inside one
block once the source's budget is spent.  Only block totals are put in order, and one block per source is
opened, so no task holds a source.

Defined results: a null source is the source '' ; a null text has no tokens; documents without tokens cost
nothing and appear in every whole pass; repeated rows are chosen together; an empty table gives an empty one;
input columns that share a name with an added one are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.llm.store import cut

WORDS = r"[^\x20\x09-\x0D]+"
ADDED = ("epoch", "block", "block_key", "doc_key")


def bisect_exponent(measure: Callable[[list[float]], list[float]], target: float, rounds: int = 6, points: int = 15) -> float:
    """The largest exponent in [0, 1] whose measure, which falls as the exponent grows to 1, is at least
    ``target``; each round asks for ``points`` values at once, that is four halvings."""
    low, high = 0.0, 1.0
    if measure([1.0])[0] >= target:
        return 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points + 1) for i in range(1, points + 1)]
        good = [a for a, m in zip(grid, measure(grid), strict=True) if m >= target]
        edge = max(good, default=low)
        low, high = edge, min([a for a in grid if a > edge], default=high)
    return low


def exponent_for(shares: DataFrame, entropy: float | None, repetition: float | None, budget: float | None) -> float:
    """``shares``: source, tokens. Asks Spark for sums over all sources; only sums come to the driver."""
    total = shares.filter("tokens > 0").agg(
        F.sum("tokens").alias("t"), F.min("tokens").alias("low"), F.max("tokens").alias("high"), F.count("*").alias("n")
    ).first()
    if not total["t"] or total["n"] < 2:
        return 1.0
    p = F.col("tokens") / float(total["t"])

    def sums(grid: list[float], *terms: Callable[[float], Column]) -> list[list[float]]:
        row = shares.filter("tokens > 0").agg(*[F.sum(t(a)) for a in grid for t in terms]).first()
        return [list(row[i * len(terms) : (i + 1) * len(terms)]) for i in range(len(grid))]

    if entropy is not None:

        def nats(grid: list[float]) -> list[float]:
            got = sums(grid, lambda a: F.pow(p, F.lit(a)), lambda a: F.pow(p, F.lit(a)) * F.log(p))
            return [math.log(z) - a * l / z for a, (z, l) in zip(grid, got, strict=True)]

        return bisect_exponent(nats, entropy)
    least, most = total["low"] / total["t"], total["high"] / total["t"]

    def repeats(grid: list[float]) -> list[float]:
        """Passes over the smallest source."""
        if budget is None:
            return [(most / least) ** (1 - a) for a in grid]
        return [budget / total["t"] * least ** (a - 1) / z for a, (z,) in zip(grid, sums(grid, lambda a: F.pow(p, F.lit(a))), strict=True)]

    # The measure falls with the exponent; the smallest exponent that keeps the limit is just above the largest that breaks it.
    return 0.0 if repeats([0.0])[0] <= repetition else min(1.0, bisect_exponent(repeats, repetition) + 16.0**-6)


def weights(shares: DataFrame, exponent: float, budget: float | None) -> DataFrame:
    """source, tokens, docs, weight, goal (tokens to take)."""
    z = shares.filter("tokens > 0").agg(
        F.sum(F.pow("tokens", F.lit(exponent))).alias("z"), F.max(F.pow("tokens", F.lit(1 - exponent))).alias("cover")
    ).first()
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(exponent)) / float(z["z"] or 1)).otherwise(0.0)
    whole = float(budget) if budget is not None else float((z["z"] or 0) * (z["cover"] or 0))
    goal = F.when(F.abs(F.col("weight") * whole - F.col("tokens")) < 0.5, F.col("tokens")).otherwise(F.round(F.col("weight") * whole).cast("long"))
    return shares.withColumn("weight", weight).withColumn("goal", goal)


def mix(
    docs: DataFrame, repetition: float | None = 2.0, entropy: float | None = None, budget: float | None = None,
    tokens: Column | None = None, block_docs: int = 4096, seed: int = 17,
) -> DataFrame:
    """``docs`` (doc_id, source, text, ...), each as often as chosen, with ``ADDED``: the pass, the block, and the
    keys that order blocks within a pass and documents within a block."""
    d = docs.drop(*[c for c in ADDED if c in docs.columns])
    source = F.coalesce("source", F.lit(""))
    count = F.regexp_count("text", F.lit(WORDS)) if tokens is None else tokens
    narrow = cut(d.select(F.col("doc_id").cast("long"), source.alias("source"), F.coalesce(count.cast("long"), F.lit(0)).alias("n")), "mix-docs")
    shares = cut(narrow.groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")), "mix-shares")
    plan = weights(shares, exponent_for(shares, entropy, repetition, budget), budget)
    plan = plan.select(
        "source", F.ceil(F.col("docs") / block_docs).cast("int").alias("blocks"),
        F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens"))).otherwise(1).cast("int").alias("whole"),
        F.when(F.col("tokens") > 0, F.col("goal") % F.col("tokens")).otherwise(0).alias("rest"),
    )
    plan = cut(plan, "mix-plan")
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("blocks")).cast("int")
    block_key = lambda epoch: F.xxhash64(F.lit(seed), F.col("__source"), epoch, F.col("block"))
    doc_key = lambda epoch: F.xxhash64(F.lit(seed), epoch, F.col("doc_id").cast("long"))
    plan = plan.withColumnRenamed("source", "__source")

    placed = narrow.withColumnRenamed("source", "__source").join(plan, "__source").withColumn("block", block)
    totals = placed.groupBy("__source", "block").agg(F.sum("n").alias("n"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    before = Window.partitionBy("__source").orderBy(block_key(F.col("whole")), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = totals.withColumn("left", F.col("rest") - F.sum("n").over(before) + F.col("n"))  # what the budget still has when the block begins
    blocks = cut(blocks.select("__source", "block", "whole", "n", "left"), "mix-blocks")
    opened = blocks.filter("left > 0 and left < n").select("__source", "block", "whole", "left")
    within = Window.partitionBy("__source", "block").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.select("__source", "block", "doc_id", "n").join(opened, ["__source", "block"]).withColumn("key", doc_key(F.col("whole")))
    inside = inside.withColumn("start", F.sum("n").over(within) - F.col("n")).filter("start < left")
    ends = inside.groupBy("__source", "block").agg(F.max(F.struct("key", "doc_id")).alias("end"))
    choice = cut(
        blocks.join(ends, ["__source", "block"], "left").select("__source", "block", "whole", ((F.col("left") >= F.col("n")) & (F.col("left") > 0)).alias("all"), "end"), "mix-choice"
    )

    # Names of this operator's own get a prefix here, so that columns of the input may be called anything else.
    dealt = plan.select("__source", F.col("blocks").alias("__blocks"))
    chosen = choice.select("__source", "block", *[F.col(c).alias(f"__{c}") for c in ("whole", "all", "end")])
    rows = d.withColumn("__source", source).join(dealt, "__source")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.col("__blocks")).cast("int"))
    rows = rows.join(chosen, ["__source", "block"])
    extra = F.col("__all") | F.coalesce(F.struct(doc_key(F.col("__whole")).alias("key"), F.col("doc_id").cast("long").alias("doc_id")) <= F.col("__end"), F.lit(False))
    copies = F.col("__whole") + F.when(extra, 1).otherwise(0)
    rows = rows.withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumns({"block_key": block_key(F.col("epoch")), "doc_key": doc_key(F.col("epoch"))})
    return rows.select(*d.columns, *ADDED)
