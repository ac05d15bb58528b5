"""Queries over table functions, the data source and its sink, failing rows, and the metrics text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators import agreement, detect, history, metrics, redact, requests, seals, tables
from veilspark.plans import catalog, redaction, sql
from veilspark.sources import bodies, io
from veilspark.sources.shared import cut, shared_dir, spread
from veilspark.streaming import sessions


def body_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the example bodies, listed by the table function in SQL."""
    tables.register(spark)
    given = catalog.bodies(spark, sf_dir).select("request_id", "body", requests.provider_of(F.col("path")).alias("provider"), (F.col("request_id").cast("bigint") % 10 < 8).alias("redact_system"))
    return spark.sql("SELECT r.request_id, s.slot, s.text, s.numeric, s.error FROM {given} r, LATERAL slots(r.body, r.provider, r.redact_system) s", given=given)


def streamed_restoring_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example streams, restored by the table function in SQL."""
    tables.register(spark)
    given = catalog.streams(spark, sf_dir).withColumn("frame", F.coalesce("frame", F.lit(": vault\n\n")))
    return catalog.joined_text(spark.sql("SELECT * FROM restored(TABLE({given}))", given=given))


def bodies_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as JSON lines of requests, read back by the data source; long texts are over its limit."""
    bodies.register(spark)
    c = catalog.table(spark, sf_dir, "conversations")
    tag = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    line = F.struct(tag.alias("request_id"), F.col("turn").alias("ts"), F.lit("/v1/messages").alias("path"), F.create_map(F.lit("X-Tenant"), F.col("role")).alias("headers"), F.col("text").alias("body"))
    at = shared_dir(spark, "lines")
    c.select(F.to_json(line).alias("value")).write.text(at)
    back = spark.read.format("bodies").option("limit", 600).option("range_bytes", 50_000).load(at)
    return back.select("request_id", "ts", F.col("headers")["X-Tenant"].alias("tenant"), F.sha2("body", 256).alias("body_sha256"), "error")


def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted example bodies through the sink, twice under one number, and what it published: audit records and data by tenant."""
    bodies.register(spark)
    rows = catalog.redacted_bodies(spark, sf_dir).withColumn("upstream_base", F.concat(F.lit("https://"), F.col("tenant"), F.lit("/x")))
    at, rows = shared_dir(spark, "sink"), cut(rows.select(*SINK), "redacted")
    for _ in range(2):
        rows.write.format("redacted").option("batch_id", "b/1").mode("append").save(at)
    audit, data = bodies.read_published(spark, at, "audit"), bodies.read_published(spark, at, "data")
    counted = audit.groupBy("tenant").agg(F.count("*").alias("records"), F.sum("total").alias("entities"))
    return counted.join(data.groupBy("tenant").agg(F.count("*").alias("bodies")), "tenant", "full").select("tenant", "records", "entities", "bodies")


SINK = sorted({*bodies.AUDIT_FIELDS, *bodies.DATA_FIELDS})


def row_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies made from the documents that fail in different ways, each in its own row: half a surrogate pair, deep nesting,
    a number that is none, messages that are no list; and such that do not: half a pair outside the text, a header in two spellings."""
    d = catalog.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = F.col("doc_id") % 8
    text = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    message = lambda content: F.concat(F.lit('{"messages":[{"role":"user","content":'), content, F.lit("}]}"))
    body = (
        F.when(kind == 1, message(F.concat(F.lit('"\\ud83d x a@b.co ",'), F.lit('"n":'), text))).when(kind == 2, message(F.concat(F.repeat(F.lit("["), F.lit(20_000)), text, F.repeat(F.lit("]"), F.lit(20_000)))))
        .when(kind == 3, message(F.concat(text, F.lit(',"n":NaN')))).when(kind == 4, F.lit('{"messages":{"content":"a@b.co"}}')).when(kind == 5, message(F.concat(text, F.lit(',"id":"\\udc00"')))).when(kind == 6, F.lit("[1")).otherwise(message(text))
    )
    headers = F.create_map(F.lit("X-Tenant"), F.when(kind == 6, F.lit("open")).otherwise(F.lit("shut")), F.lit("x-tenant"), F.lit("b"))
    headers = F.when(kind.isin(6, 7), headers).otherwise(F.create_map(F.lit("X-Tenant"), F.lit("shut")))
    raw = d.select(F.col("doc_id").alias("request_id"), F.lit(0).cast("bigint").alias("ts"), F.lit("/v1/chat/completions").alias("path"), headers.alias("headers"), body.alias("body"), F.lit("m").alias("model"))
    policies = d.select(F.lit("open, b").alias("tenant"), F.lit("open").alias("fail_mode")).distinct()
    kinds = {f.split()[0]: f.split()[1] for f in io.POLICY.split(", ")}
    policies = policies.select(*[(F.col(n) if n in policies.columns else F.lit(None).cast(t)).alias(n) for n, t in kinds.items()])
    out = redaction.redact_rows(requests.shape(raw, policies), catalog.RUN)
    same = F.col("body_out").eqNullSafe(F.col("body"))
    return out.select("request_id", "tenant", "outcome", "error", "bypass_reason", F.when(F.col("outcome") == "fail-open", same).alias("as_it_came"), F.col("body_out").isNull().alias("held_back"))


def pseudonym_first_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which one value stands under two types: it keeps the one it is minted with first."""
    nine = F.lpad(F.col("o_orderkey").cast("string"), 9, "0")
    texts = catalog.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("MRN "), nine, F.lit(" and aba "), nine).alias("text"))
    return redact.pseudonymise(detect.detect(texts), catalog.SECRET).select("o_orderkey", "redacted")


def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All families of the text form, one line each."""
    return metrics.exposition(catalog.outcomes(spark, sf_dir)).select("line")


def policy_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and purchases set a policy for their user's group from their time on; all other events are requests."""
    e = catalog.table(spark, sf_dir, "events").withColumn("tenant", F.when(F.col("user_id") % 5 < 3, F.lit("big")).otherwise(F.concat(F.lit("t"), F.col("user_id").cast("string"))))
    setting = F.col("event_type").isin("signup", "purchase")
    mode = F.when(F.col("event_type") == "signup", F.lit("strip")).otherwise(F.lit("reversible"))
    versions = e.filter(setting).select("tenant", F.col("ts").alias("since"), F.col("event_id").alias("number"), mode.alias("mode"))
    out = history.policies_in_force(e.filter(~setting).select("event_id", "tenant", "ts"), versions)
    return out.select("event_id", "tenant", F.col("policy.number").alias("policy_number"), F.col("policy.mode").alias("mode"))


def detector_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogs over the documents: that of personal data, and those of health and payment data and secrets."""
    both = spread(catalog.table(spark, sf_dir, "documents").select("doc_id", "text"))
    bare = lambda sets: F.transform(detect.spans(F.col("text"), sets=sets), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type")))
    both = cut(both.select("doc_id", bare(("pii",)).alias("a"), bare(("phi", "pci", "secrets")).alias("b")), "spans")  # places only, no values
    each = lambda c: both.select("doc_id", F.inline(c)).select("doc_id", "start", "end", "type")
    return agreement.matrix(each("a"), each("b"), "doc_id")


def audit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as records of five keys, one of which holds a third, in segments of 64 numbers, sealed."""
    records = catalog.audit_records(spark, sf_dir).withColumn("tenant", F.when(F.col("seq") % 3 == 0, F.lit("hot")).otherwise(F.col("model")))
    return seals.seal(records, "tenant", 64).select("tenant", "segment", "n", "root")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the events of three groups of users, one with most of them: no more than four minutes between neighbours."""
    e = catalog.table(spark, sf_dir, "events").withColumn("tenant", F.when(F.col("user_id") % 5 < 3, F.lit("big")).otherwise(F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string"))))
    return sessions.sessions(e, "tenant", "ts", 240).select("tenant", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


def held_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the orders' customers, and beginnings of them of all lengths, unique, shared and absent."""
    o = catalog.table(spark, sf_dir, "orders")
    request = (F.col("o_custkey") % 100).alias("request_id")
    token = F.concat(F.lit("<EMAIL_"), F.upper(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 6)), F.lit("_1>"))
    tokens = o.select(request, token.alias("token"), F.col("o_orderkey").alias("value"))
    tail = F.when(F.col("o_orderkey") % 7 == 0, F.lit("<NONE_")).otherwise(F.substring(token, F.lit(1), (F.col("o_orderkey") % 17).cast("int")))
    return redact.resolve_partials(o.select(request, "o_orderkey", tail.alias("tail")), tokens, "request_id")


def hourly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by hour, mode and tenant, rolled up; the exact counts, and whether the distinct tenants are within the sketch's error."""
    e = catalog.table(spark, sf_dir, "events")
    o = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tenant"), "event_type", "user_id", "value", "props")
    groups = metrics.hourly(catalog.outcomes_of(o, "ts", "tenant"))
    exact = groups.groupingSets([[], ["hour"], ["hour", "mode"], ["hour", "mode", "tenant"]], "hour", "mode", "tenant").agg(F.countDistinct(groups["tenant"]).alias("n"), F.grouping_id().alias("g"))
    rows = metrics.report(groups)
    near = rows.join(exact.select(F.col("hour").alias("h"), F.col("mode").alias("m"), F.col("tenant").alias("t"), "n", (F.lit(3) - F.bit_count("g")).cast("int").alias("l")),
                     F.col("hour").eqNullSafe(F.col("h")) & F.col("mode").eqNullSafe(F.col("m")) & F.col("tenant").eqNullSafe(F.col("t")) & (F.col("level") == F.col("l")))
    bound = F.col("level") == 3
    within = (F.abs(F.col("tenants") - F.col("n")) <= F.greatest(F.lit(1.0), F.col("n") * (4 * 1.04 / 2 ** (metrics.HLL_BITS / 2)))) | bound
    return near.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "mode", "tenant", "level", *metrics.EXACT, within.alias("within"))


QUERIES = (body_slots, streamed_restoring_in_sql, bodies_source, sink_round_trip, row_failures, pseudonym_first_types, metrics_text, policy_as_of, detector_agreement, audit_segments, event_sessions, held_tails, hourly_report)


def oracle_sql(run_secret: str) -> dict[str, str]:
    known = sql.oracles(catalog.SECRET, run_secret)
    bodies_ = f"with {sql.fields()}, {sql.requests_redacted(run_secret)}"
    line = lambda family, label, n: f"'redact_{family}{{{label}=\"' || {label} || '\"}} ' || {n}"
    totals = " union all ".join(f"select 'redact_{f} ' || {x}::bigint as line from outcomes" for f, x in (
        ("requests_total", "count(*)"), ("redacted_requests_total", "count_if(total > 0)"), ("redacted_entities_total", "sum(total)"), ("bypass_total", "count(bypass_reason)"), ("fail_closed_total", "count_if(failed_closed)"),
        ("upstream_errors_total", "count_if(upstream_error)"),
    ))
    levels = "".join(f"""
            l{k + 1} as (select tenant, segment, i // 2 as i, case when count(*) = 2 then sha256(chr(1) || min(h) filter (i % 2 = 0) || min(h) filter (i % 2 = 1)) else min(h) end as h from l{k} group by tenant, segment, i // 2),""" for k in range(6))  # fmt: skip
    return {
        "event_sessions": """with e as (select case when user_id % 5 < 3 then 'big' else 't' || user_id % 5 end as tenant, epoch_us(ts) as t from events where ts is not null),
            g as (select *, coalesce(t - lag(t) over (partition by tenant order by t) > 240000000, false)::int as opens from e),
            s as (select *, sum(opens) over (partition by tenant order by t) as k from g)
            select tenant, min(t) as start_us, max(t) as last_us, count(*) as n from s group by tenant, k""",
        "held_tails": """with o as (select *, o_custkey % 100 as request_id, '<EMAIL_' || upper(substr(sha256(o_orderkey::varchar), 1, 6)) || '_1>' as token from orders),
            t as (select request_id, o_orderkey, case when o_orderkey % 7 = 0 then '<NONE_' else substr(token, 1, (o_orderkey % 17)::int) end as tail from o)
            select t.request_id, t.o_orderkey, t.tail, case when tail like '<%' and count(o.token) = 1 then min(o.o_orderkey) end as value
            from t left join o on o.request_id = t.request_id and starts_with(o.token, t.tail) group by t.request_id, t.o_orderkey, t.tail""",
        "hourly_report": sql.OUTCOMES.replace("select case event_type", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, 't' || user_id as tenant, case event_type", 1) + """
            select hour, mode, tenant, (3 - bit_count(grouping(hour, mode, tenant)))::int as level, count(*) as requests, sum(total)::bigint as entities, count(bypass_reason) as bypassed, count_if(failed_closed)::bigint as failed_closed, true as within
            from outcomes group by grouping sets ((), (hour), (hour, mode), (hour, mode, tenant))""",
        "policy_as_of": """with e as (select *, case when user_id % 5 < 3 then 'big' else 't' || user_id end as tenant from events),
            v as (select tenant, ts, max(event_id) as number from e where event_type in ('signup', 'purchase') group by tenant, ts),
            r as (select * from e where event_type not in ('signup', 'purchase'))
            select r.event_id, r.tenant, v.number as policy_number, case k.event_type when 'signup' then 'strip' when 'purchase' then 'reversible' end as mode
            from r asof left join v on r.tenant = v.tenant and r.ts >= v.ts left join events k on k.event_id = v.number""",
        "detector_agreement": f"""with {sql.DOCS}, {sql.spans("docs", ("pii",), "a_")}, {sql.spans("docs", ("phi", "pci", "secrets"), "b_")},
            p as (select a.id, a.t as a_type, a.s as a_s, a.e as a_e, b.t as b_type, b.s as b_s, b.e as b_e from a_spans a join b_spans b on a.id = b.id and a.s < b.e and b.s < a.e)
            select a_type, b_type, count(*) as pairs, count_if(a_s = b_s and a_e = b_e)::bigint as exact from p group by a_type, b_type
            union all select t, null, count(*), 0 from a_spans a where not exists (select 1 from b_spans b where a.id = b.id and a.s < b.e and b.s < a.e) group by t
            union all select null, t, count(*), 0 from b_spans b where not exists (select 1 from a_spans a where a.id = b.id and a.s < b.e and b.s < a.e) group by t""",
        "audit_segments": f"""with o as (select *, case when o_orderkey % 3 = 0 then 'hot' else o_orderpriority end as tenant from orders),
            l0 as (select tenant, o_orderkey // 64 as segment, row_number() over (partition by tenant, o_orderkey // 64 order by o_orderkey) - 1 as i,
              sha256(chr(0) || '{{"entityCounts":{{"EMAIL":1,"SSN":' || (o_orderkey % 5) || '}},"mode":"strip","model":"' || o_orderpriority || '","provider":"openai","seq":' || o_orderkey || ',"sets":["pii","phi"],"tenant":"' || tenant
                || '","total":' || (o_orderkey % 5 + 1) || ',"ts":' || (o_orderkey * 1000) || '}}') as h from o),{levels}
            n as (select tenant, segment, count(*) as n from l0 group by tenant, segment)
            select tenant, segment::bigint as segment, n, h as root from l6 join n using (tenant, segment)""",
        "body_slots": f"""with {sql.fields()} select doc_id::varchar as request_id, (row_number() over (partition by doc_id order by slot) - 1)::int as slot, text, numeric, null::varchar as error from f""",
        "streamed_restoring_in_sql": known["streamed_restoring"],
        "bodies_source": """select conv_id || '-' || turn as request_id, turn as ts, role as tenant, case when strlen(text) <= 600 then sha256(text) end as body_sha256,
            case when strlen(text) > 600 then 'body too large' end as error from conversations""",
        "sink_round_trip": f"""{bodies_}, n as (select doc_id, count(*) as total from sp group by doc_id)
            select 't' || (doc_id % 10) as tenant, count(*) as records, coalesce(sum(total), 0)::bigint as entities, count(*) as bodies from d left join n using (doc_id) group by 1""",
        "row_failures": """with k as (select doc_id, doc_id % 8 as k from documents)
            select doc_id as request_id, case k when 6 then 'open, b' when 7 then 'shut, b' else 'shut' end as tenant,
              case when k = 6 then 'fail-open' when k between 1 and 4 then 'fail-closed' else 'redacted' end as outcome,
              case k when 1 then 'UnicodeEncodeError' when 2 then 'RecursionError' when 3 then 'ValueError' when 4 then 'TypeError' when 6 then 'JSONDecodeError' end as error,
              case when k = 6 then 'fail-open:detect' end as bypass_reason, case when k = 6 then true end as as_it_came, k between 1 and 4 as held_back from k""",
        "pseudonym_first_types": sql.redacted(
            f"'<' || kinds.t || '_' || upper(substr({sql.hmac(catalog.SECRET, 'spans.v')}, 1, 8)) || '>'",
            "docs as (select o_orderkey as id, text, text as raw from (select o_orderkey, 'MRN ' || lpad(o_orderkey::varchar, 9, '0') || ' and aba ' || lpad(o_orderkey::varchar, 9, '0') as text from orders))", "o_orderkey"),
        "metrics_text": sql.OUTCOMES + f"""{totals} union all select {line("requests_by_mode", "mode", "count(*)")} from outcomes group by mode
            union all select 'redact_redacted_by_type{{type="EMAIL"}} ' || sum(email)::bigint from outcomes union all select 'redact_redacted_by_type{{type="PHONE"}} ' || sum(phone)::bigint from outcomes
            union all select 'redact_redacted_by_set{{set="' || set || '"}} ' || sum(total)::bigint from (select unnest(sets) as set, total from outcomes) group by set
            union all select 'redact_bypass_by_reason{{reason="' || bypass_reason || '"}} ' || count(*) from outcomes where bypass_reason is not null group by bypass_reason
            union all select 'redact_avg_latency_ms{{src="' || timing_src || '"}} ' || round(avg(ms), 1) from outcomes where timing_src is not null group by timing_src""",
    }
