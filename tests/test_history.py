"""Policies by time, agreement of detectors, sealed audit segments, sessions, and replies whose frames wait in the state."""

import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark.operators import agreement, audit, history, metrics, redact, seals
from veilspark.sources import io
from veilspark.streaming import replies, sessions

T0 = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


@pytest.mark.parametrize("width", [60, 1000, 10**9])
def test_as_of_equals_a_search(spark, width):
    rng = random.Random(width)
    keys = ["hot"] * 6 + ["a", "b", None]
    versions = [(rng.choice(keys), rng.choice([None, *range(0, 5000, 7)]), rng.randrange(100)) for _ in range(200)]
    rows = [(i, rng.choice(keys + ["none"]), rng.choice([None, *range(-50, 6000, 7)])) for i in range(600)] + [(1, "hot", 70)] * 3
    df = spark.createDataFrame([(i, k, at(t), "mine") for i, k, t in rows], "id int, tenant string, ts timestamp, policy string").repartition(4)
    vs = spark.createDataFrame([(k, at(t), m) for k, t, m in versions], "tenant string, since timestamp, mode int").repartition(3)
    got = history.policies_in_force(df, vs, width)

    def searched(k, t):
        fits = [(s, m) for v, s, m in versions if v == k and k is not None and s is not None and t is not None and s <= t]
        return max(fits) if fits else None

    out = [(r.id, r.tenant, r.ts, (r.policy.since, r.policy.mode) if r.policy else None) for r in got.collect()]
    want = [(i, k, at(t), (at(v[0]), v[1]) if (v := searched(k, t)) else None) for i, k, t in rows]
    assert sorted(map(str, out)) == sorted(map(str, want))
    assert history.policies_in_force(df, vs.limit(0), width).filter("policy is not null").count() == 0
    assert history.policies_in_force(df.limit(0), vs, width).count() == 0
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(5)
    spans = lambda n: [(rng.choice([1, 1, 1, 2, None]), a := rng.randrange(500), a + rng.choice([0, 1, 5, 63, 64, 200]), rng.choice("XYZ")) for _ in range(n)]
    a, b = spans(80), spans(60)
    make = lambda rows: spark.createDataFrame([(*r, 9) for r in rows], "doc int, start int, end int, type string, bin int")
    want = sorted((x[0], x[1], x[2], x[3], y[1], y[2], y[3], min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2])
    for width in (1, 64, 10_000):
        out = agreement.overlapping(make(a), make(b), "doc", width)
        assert sorted(tuple(r) for r in out.collect()) == want
    plan = out._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert agreement.matrix(make(a).limit(0), make(b), "doc").agg(F.sum("pairs")).first()[0] == len(b)


def records(spark, n=300, tenants=("hot", "hot", "b")):
    rows = [(tenants[i % 3], i, i * 10, "openai", "m", "strip", {"SSN": i % 4, "EMAIL": 1}, ["pii"], i % 4 + 1) for i in range(n)]
    return spark.createDataFrame(rows, "tenant string, seq bigint, ts bigint, provider string, model string, mode string, entity_counts map<string,int>, sets array<string>, total int").repartition(4)


def test_heads_are_folded_row_by_row_and_no_chain_is_gathered(spark):
    r = spark.range(40_000).select(F.when(F.col("id") % 8 == 0, None).otherwise(F.lit("hot")).alias("k"), F.col("id").alias("segment"), F.lit(1).cast("long").alias("n"), F.col("id").alias("first"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("last"), F.sha2(F.col("id").cast("string"), 256).alias("root"))
    headed = seals._headed(r.orderBy(F.desc("id")), "k")
    assert "collect_list" not in headed._jdf.queryExecution().toString()  # one row of a whole chain, and an array of heads copied at each step
    now = {"hot": audit.GENESIS, None: audit.GENESIS}
    for x in sorted(headed.collect(), key=lambda x: x.segment):
        text = "|".join(str(v) for v in x[1:6] if v is not None)
        now[x.k] = hashlib.sha256(f"{now[x.k]}|{text}".encode()).hexdigest()
        assert x.head == now[x.k]
    assert headed.columns == ["k", "segment", "n", "first", "last", "root", "head"]


def test_seals_show_what_was_changed_or_lost(spark, tmp_path):
    r = records(spark)
    sealed = seals.seal(r, "tenant", 16).cache()
    anchored = seals.anchors(sealed, "tenant").cache()
    assert {x.tenant: (x.segments, x.records) for x in anchored.collect()} == {"hot": (19, 200), "b": (19, 100)}
    check = lambda rs, ss=sealed: {x.tenant: (x.ok, x.reason, x.segment) for x in seals.verify(rs, ss, anchored, "tenant", 16).collect()}
    assert check(r) == {"hot": (True, None, None), "b": (True, None, None)}
    assert check(r.withColumn("total", F.when(F.col("seq") == 33, 99).otherwise(F.col("total"))))["hot"] == (False, "records changed", 2)
    assert check(r.filter("seq <> 33"))["hot"] == (False, "records changed", 2)
    assert check(r.filter("seq < 96 or seq >= 112 or tenant = 'b'"))["hot"] == (False, "records missing", 6)
    newest = r.filter("seq < 288"), sealed.filter("segment < 18")
    assert check(*newest) == {"hot": (False, "truncated", None), "b": (False, "truncated", None)}
    assert check(r.filter("tenant = 'b'"), sealed.filter("tenant = 'b'"))["hot"] == (False, "truncated", None)
    assert check(r, sealed.withColumn("n", F.when(F.col("segment") == 3, F.col("n") + 1).otherwise(F.col("n"))))["b"] == (False, "seal changed", 3)
    more = r.unionByName(records(spark, 330).filter("seq >= 320"))
    assert check(more)["hot"] == (False, "unsealed records", 20)
    assert seals.verify(r.limit(0), sealed.limit(0), anchored.limit(0), "tenant").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 16])
def test_inclusion_proofs(spark, n):
    leaves = [f"{i:064x}" for i in range(n)]
    df = spark.range(n).select(F.col("id").alias("place"), F.array(*map(F.lit, leaves)).alias("leaves"))
    got = df.select("place", seals.root(F.col("leaves"), 16).alias("root"), seals.proof(F.col("leaves"), F.col("place"), 16).alias("path")).collect()
    assert len({r.root for r in got}) == 1
    for r in got:
        path = [(s.sibling, s.left) for s in r.path]
        assert seals.proves(leaves[r.place], path, r.root) and not seals.proves("f" * 64, path, r.root)
        assert len(path) <= 4


def by_gaps(rows, gap):
    out, by = [], {}
    for k, t in rows:
        if t is not None:
            by.setdefault(k, []).append(t)
    for k, ts in by.items():
        ts.sort()
        held = [[ts[0], ts[0], 1]]
        for t in ts[1:]:
            held.append([t, t, 1]) if t - held[-1][1] > gap else held.__setitem__(-1, [held[-1][0], t, held[-1][2] + 1])
        out += [(k, at(a), at(b), n) for a, b, n in held]
    return sorted(out, key=str)


def test_sessions_equal_gaps_and_islands(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(0, 20_000, 5)])) for _ in range(900)]
    df = spark.createDataFrame([(k, at(t), 1) for k, t in rows], "k string, ts timestamp, n int").repartition(3)
    for span in (50, 777, 10**9):
        assert sorted((tuple(r) for r in sessions.sessions(df, "k", "ts", 30, span).collect()), key=str) == by_gaps(rows, 30)
    assert sessions.sessions(df.limit(0), "k", "ts", 30).count() == 0


def test_session_stream_equals_the_table_and_marks_late_events(spark, tmp_path):
    rng = random.Random(4)
    first = [(k, rng.randrange(0, 3000)) for k in "ab" for _ in range(60)]
    second = [(k, rng.randrange(3000, 6000)) for k in "ab" for _ in range(60)] + [("z", 9000)]
    third = [("a", 10), ("z", 90_000)]  # the first is behind the watermark by now
    schema = "k string, ts timestamp"
    for i, part in enumerate((first, second, third, [("z", 200_000)])):
        spark.createDataFrame([(k, at(t)) for k, t in part], schema).coalesce(1).write.json(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(f"file://{tmp_path}/in/*")
    query = sessions.session_stream(stream, "k", "ts", 60, "10 minutes", 200).writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").start()
    want = by_gaps([*first, *second], 60)
    want = [w for w in want if w[0] != "z"]
    try:
        for _ in range(60):
            got = spark.table("sessions_out").collect()
            if sum(not r.late and r.k != "z" for r in got) >= len(want) and any(r.late for r in got):
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert sorted(((r.k, r.start, r.last, r.n) for r in got if not r.late and r.k != "z"), key=str) == want
    assert [(r.k, r.start) for r in got if r.late] == [("a", at(10))]


def test_ten_thousand_frames_wait_in_the_state(spark, tmp_path):
    piece = lambda x: f'data: {json.dumps({"choices": [{"index": 0, "delta": {"content": x}}]})}\n\n'
    n = 10_000
    frames = [("r", "openai", i, piece(("<A_", "1> ")[i % 2])) for i in range(n)] + [("r", "openai", n, "data: [DONE]\n\n")]
    schema = "request_id string, provider string, seq bigint, frame string"
    vaults = spark.createDataFrame([("r", json.dumps({"<A_1>": "Ann"})), ("other", "{}")], "request_id string, tokens string")
    for i, part in enumerate((frames[1:], frames[:1])):  # all but the first come first
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
        out = replies.restore_stream(stream, timeout=None, vaults=vaults)
        query = out.writeStream.format("json").option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"file://{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        got = spark.read.schema(replies.OUT).json(f"file://{tmp_path}/out").collect()
        assert bool(got) == bool(i)
    table = replies.restore_frames(spark.createDataFrame(frames, schema), spark.createDataFrame([("r", {"<A_1>": "Ann"})], "request_id string, tokens map<string,string>")).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r) for r in table)
    text = "".join(replies.parse_delta("openai", r.frame[5:].strip())[0] for r in sorted(got, key=lambda r: (r.seq, r.part)))
    assert text == "Ann " * (n // 2)


def test_heads_are_recovered_behind_a_torn_line(spark, tmp_path):
    at = f"file://{tmp_path}/audit"
    chained = audit.chain(records(spark, 30), "tenant")
    rows = sorted((r.tenant, r.seq, r.value) for r in chained.select("tenant", "seq", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).collect())
    last = {t: max(s for u, s, _ in rows if u == t) for t in ("hot", "b")}
    torn = [v[: len(v) - 40] if (t, s) == ("hot", last["hot"]) else v for t, s, v in rows]
    (tmp_path / "audit").mkdir()
    (tmp_path / "audit/x.jsonl").write_text("\n".join(torn) + "\n\n")
    lines = io.read_audit(spark, at)
    assert lines.count() == 30 and lines.columns == [f.split()[0] for f in io.AUDIT.split(", ")]
    heads = {r.tenant: r for r in audit.recover_heads(lines, "tenant").collect()}
    hashes = {(r.tenant, r.seq): r.hash for r in chained.collect()}
    assert heads["b"].head == hashes["b", last["b"]] and heads["b"].torn == 0
    before = max(s for t, s, _ in rows if t == "hot" and s < last["hot"])
    assert (heads["hot"].head, heads["hot"].last, heads["hot"].torn) == (hashes["hot", before], before, 1)
    found = {r.tenant: (r.ok, r.reason, r.broken_at) for r in audit.verify(lines, "tenant").collect()}
    assert found == {"hot": (False, "unparseable line", 19), "b": (True, None, None)}
    more = audit.chain(records(spark, 36).filter("seq >= 30"), "tenant", heads=audit.recover_heads(lines, "tenant").select("tenant", "head"))
    assert all(r.ok for r in audit.verify(lines.filter("hash is not null").unionByName(more.select(*lines.columns)), "tenant").collect())


def test_partial_tokens_over_a_table(spark):
    rng = random.Random(8)
    tokens = [(rng.choice(["a", "a", "b", None]), "<" + "".join(rng.choice("ABCDE") for _ in range(rng.randrange(1, 5))) + ">", i % 9) for i in range(60)]
    tokens = list({(r, t): (r, t, v) for r, t, v in tokens}.values())
    tails = [(rng.choice(["a", "b", "c", None]), rng.choice([None, "", "<", "A", "<>", rng.choice(tokens)[1][: rng.randrange(1, 7)], rng.choice(tokens)[1][: rng.randrange(1, 7)]]), i) for i in range(400)]
    got = redact.resolve_partials(spark.createDataFrame([(*t, "old") for t in tails], "r string, tail string, i int, value string").repartition(3), spark.createDataFrame(tokens + tokens[:3], "r string, token string, value int"), "r")

    def searched(r, tail):
        fits = [v for q, t, v in tokens if q == r and r is not None and tail is not None and tail.startswith("<") and t.startswith(tail)]
        return fits[0] if len(fits) == 1 else None

    out = sorted((x.i, x.r, x.tail, x.value) for x in got.collect())
    assert out == [(i, r, t, searched(r, t)) for r, t, i in tails]
    assert sum(x[3] is not None for x in out) > 10


def test_report_estimates_are_within_their_error(spark):
    n = 40_000
    base = spark.range(n).select(
        (F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 7200)).alias("ts"), F.concat(F.lit("t"), (F.col("id") * 7919 % 3000).cast("string")).alias("tenant"), F.when(F.col("id") % 3 == 0, F.lit("strip")).otherwise(F.lit("off")).alias("mode"),
        F.lit(1).alias("total"), F.lit(None).cast("string").alias("bypass_reason"), F.lit(False).alias("failed_closed"), F.when(F.col("id") % 4 > 0, F.col("id") % 1000).alias("ms"),
    )
    groups = metrics.hourly(base)
    by_level = {}
    for r in metrics.report(groups).collect():
        by_level.setdefault(r.level, []).append(r)
    assert {k: len(v) for k, v in by_level.items() if k < 3} == {0: 1, 1: 2, 2: 4}
    top = by_level[0][0]
    assert top.requests == n == sum(r.requests for r in by_level[3]) and abs(top.tenants - 3000) < 3000 * 0.05
    exact = sorted(r.ms for r in base.filter("ms is not null").select("ms").collect())
    for value, q in ((top.median_ms, 0.5), (top.p95_ms, 0.95)):
        assert abs(sum(x <= value for x in exact) / len(exact) - q) < 0.03
    halves = metrics.hourly(base.filter("total = 1 and ms % 2 = 0")).unionByName(metrics.hourly(base.filter("ms is null or ms % 2 = 1")))
    again = metrics.report(halves).filter("level = 0").first()
    assert again.requests == n and abs(again.tenants - top.tenants) < 150
    assert metrics.report(metrics.hourly(base.filter("ms is null"))).filter("level = 0").first().median_ms is None
