"""Sessions: a key's events with no more than ``gap`` seconds between neighbours.

``sessions`` does a table.  Events are put together within spans of time first, so that a key with a third of all events is
many groups, and what is left is one row for each piece of a session.  ``session_stream`` is the same on a stream:
sessions that an event joins are merged in the state, and go out when the watermark has passed them; events that
come behind it and touch no open session go out by themselves, marked ``late``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

OUT = "start timestamp, last timestamp, n bigint, late boolean"
SPAN = 86_400


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sessions(events: DataFrame, key: str, ts: str, gap: int, span: int = SPAN) -> DataFrame:
    """``key``, ``start``, ``last`` (times of the first and the last event) and ``n``. Events without a time are in no session; those without a key
    are one key's."""
    limit = gap * 1_000_000
    rows = events.filter(F.col(ts).isNotNull()).select(F.col(key), _micros(ts).alias("t"), F.floor(_micros(ts) / (span * 1_000_000)).alias("span"))
    inside = Window.partitionBy(key, "span").orderBy("t")
    opens = (F.col("t") - F.lag("t").over(inside) > limit).cast("int")
    pieces = rows.withColumn("opens", F.coalesce(opens, F.lit(0))).withColumn("piece", F.sum("opens").over(inside))
    pieces = pieces.groupBy(key, "span", "piece").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    every = Window.partitionBy(key).orderBy("a")
    joined = pieces.withColumn("opens", F.coalesce((F.col("a") - F.lag("b").over(every) > limit).cast("int"), F.lit(0))).withColumn("session", F.sum("opens").over(every))
    out = joined.groupBy(key, "session").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    return out.select(key, F.timestamp_micros("a").alias("start"), F.timestamp_micros("b").alias("last"), "n")


def merged(held: list[list[int]], times: list[int], limit: int) -> list[list[int]]:
    """Sessions (first, last, number of events) with events added, merged where they touch."""
    out: list[list[int]] = []
    for a, b, n in sorted([*held, *([t, t, 1] for t in times)]):
        if out and a - out[-1][1] <= limit:
            out[-1] = [out[-1][0], max(out[-1][1], b), out[-1][2] + n]
        else:
            out.append([a, b, n])
    return out


def session_stream(events: DataFrame, key: str, ts: str, gap: int, late: str = "10 minutes", check: int = 1000) -> DataFrame:
    """``key`` and ``OUT``. Every ``check`` milliseconds without events, a key's sessions are held against the watermark."""
    limit = gap * 1_000_000
    kind = events.schema[key].dataType.simpleString()

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs() * 1000
        held = json.loads(state.get[0]) if state.exists else []
        times = [int(t) for part in ([] if state.hasTimedOut else parts) for t in part["__t"]]
        behind = {t for t in times if t + limit <= passed and not any(a - limit <= t <= b + limit for a, b, _ in held)}
        held = merged(held, [t for t in times if t not in behind], limit)
        done = [s for s in held if s[1] + limit <= passed]
        held = [s for s in held if s[1] + limit > passed]
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutDuration(check)
        elif state.exists:
            state.remove()
        rows = [(keys[0], a, b, n, False) for a, b, n in done] + [(keys[0], t, t, 1, True) for t in times if t in behind]
        yield pd.DataFrame(rows, columns=[key, "start", "last", "n", "late"])

    timed = events.withColumn("__w", F.col(ts).cast("timestamp")).filter("__w is not null").withWatermark("__w", late).withColumn("__t", F.unix_micros("__w"))
    out = timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start bigint, last bigint, n bigint, late boolean", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(key, F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "n", "late")
