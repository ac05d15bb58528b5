"""All queries by name: each operator applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import checks, digests
from veilspark.operators import audit, detect, metrics, redact, requests
from veilspark.plans import redaction, sql
from veilspark.sources import io
from veilspark.sources.shared import spread
from veilspark.streaming import replies

SECRET = "a secret of the examples only"
RUN = "a secret of one run"
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _exploded(df: DataFrame, key: str) -> DataFrame:
    return detect.each(df, key).select(key, F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"), "s.type", "s.value")


def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(documents(spark, sf_dir), "doc_id")


def entity_spans_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exploded(detect.detect(spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))), "page_id")


def entity_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.tally(documents(spark, sf_dir))


def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid matches of each pattern by itself, before overlaps are resolved."""
    t = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    each = detect.native_candidates(F.col("text"), digests.SETS, detect.Catalog())
    return detect.each(t, "doc_id", spans_=each).groupBy("doc_id", F.col("s.ord").alias("pattern"), "s.type").agg(F.count("*").alias("n"))


def tally_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each set finds when it is active alone, in one scan."""
    given = spread(table(spark, sf_dir, "documents").select("text"))
    alone = detect.each(given, spans_=detect.spans_alone(F.col("text"), digests.SETS)).select("s.set_name", F.col("s.spans").alias("spans"))
    return detect.each(alone, "set_name").groupBy("set_name", F.col("s.type").alias("type")).agg(F.count("*").alias("n"))


def strip_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.strip(documents(spark, sf_dir)).select("doc_id", "redacted")


def pseudonym_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.pseudonymise(documents(spark, sf_dir), SECRET).select("doc_id", "redacted")


def pseudonym_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.pseudonym_collisions(documents(spark, sf_dir), SECRET)


def minted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents are one request, whose fields are the documents in order."""
    d = documents(spark, sf_dir).withColumn("request_id", F.floor(F.col("doc_id") / 8))
    return redact.minted(d, "request_id", "doc_id").select("request_id", "value", "type", F.col("n").cast("long").alias("n"))


def summary_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).filter("size(spans) > 0").select("doc_id", redact.summary_header(F.col("spans")).alias("header"))


def restore_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after tokenising and restoring: is it what it was, and does no value stand in the redacted text."""
    d = redact.tokenise(documents(spark, sf_dir), "doc_id", RUN)
    back = redact.restore(F.col("redacted"), redact.flipped(F.col("vault")))
    return d.select("doc_id", back.eqNullSafe(F.col("text")).alias("same"), F.size("spans").cast("long").alias("n_spans"))


OPENAI = (
    '{"model":"m","tools":[{"function":{"description":$phone$,"parameters":{"x":[$address$]}}}],"messages":[{"role":"system","content":$system$},'
    '{"role":"user","name":$mail$,"content":[{"type":"text","text":$content$},{"type":"image_url","text":"i@i.example.org"}]},'
    '{"role":"assistant","tool_calls":[{"function":{"arguments":$arguments$}}]}]}'
)
ANTHROPIC = (
    '{"model":"m","system":[{"type":"text","text":$system$}],"tools":[{"description":$phone$,"input_schema":{"x":[$address$]}}],"messages":[{"role":"user","content":['
    '{"type":"tool_result","content":[{"type":"text","text":$content$}]},{"type":"tool_use","input":{"card":$card$,"id":$plain$,"to":$mail$}}]}]}'
)


def _filled(template: str, values: dict[str, Column]) -> Column:
    """A template with every ``$name$`` replaced by a column."""
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(template.split("$"))])


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a request: nested bodies in two dialects, every third one to be stripped, two of ten, one in each dialect, without system text."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    d = d.select("doc_id", *[F.expr(x).alias(n) for n, x in sql.FIELDS.items()])
    quoted = {n: F.regexp_extract(F.to_json(F.array(n)), r"(?s)^\[(.*)\]$", 1) for n in sql.FIELDS} | {n: F.col(n) for n in ("card", "plain")}
    arguments = _filled('{"card":$card$,"id":$plain$,"to":$mail$}', quoted)
    quoted["arguments"] = F.regexp_extract(F.to_json(F.array(arguments)), r"(?s)^\[(.*)\]$", 1)
    openai, anthropic = _filled(OPENAI, quoted), _filled(ANTHROPIC, quoted)
    even = F.col("doc_id") % 2 == 0
    path = F.when(even, F.lit("/v1/chat/completions")).otherwise(F.lit("/v1/messages"))
    headers = F.create_map(F.lit("X-Tenant"), F.concat(F.lit("t"), (F.col("doc_id") % 10).cast("string")), F.lit("X-Redact-Mode"), F.when(F.col("doc_id") % 3 == 0, F.lit("strip")).otherwise(F.lit("")))
    return d.select(F.col("doc_id").cast("string").alias("request_id"), F.lit(0).cast("long").alias("ts"), path.alias("path"), headers.alias("headers"), F.when(even, openai).otherwise(anthropic).alias("body"), F.lit("m").alias("model"))


def redacted_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenants = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("n")).distinct()
    values = {"tenant": F.concat(F.lit("t"), F.col("n").cast("string")), "redact_system": F.col("n") < 8}
    kinds = {f.split()[0]: f.split()[1] for f in io.POLICY.split(", ")}
    policies = tenants.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])
    # Ten rows at most, which Spark takes for as many as there are documents: it would shuffle and sort all bodies by ten tenants.
    return redaction.redact_rows(requests.shape(bodies(spark, sf_dir), F.broadcast(policies)), RUN)


def _content(body: str) -> Column:
    even = F.get_json_object(body, "$.messages[1].content[0].text")
    return F.coalesce(even, F.get_json_object(body, "$.messages[0].content[0].content[0].text"))


def body_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the redacted bodies, one row each."""
    out = redacted_bodies(spark, sf_dir)
    get = lambda path: F.get_json_object("body_out", path)
    arguments = get("$.messages[2].tool_calls[0].function.arguments")
    fields = {
        "phone": F.coalesce(get("$.tools[0].function.description"), get("$.tools[0].description")), "address": F.coalesce(get("$.tools[0].function.parameters.x[0]"), get("$.tools[0].input_schema.x[0]")),
        "system": F.when(F.col("provider") == "openai", get("$.messages[0].content")).otherwise(get("$.system[0].text")), "content": _content("body_out"), "name": get("$.messages[1].name"),
        "card": F.coalesce(F.get_json_object(arguments, "$.card"), get("$.messages[0].content[1].input.card")), "plain": F.coalesce(F.get_json_object(arguments, "$.id"), get("$.messages[0].content[1].input.id")),
        "mail": F.coalesce(F.get_json_object(arguments, "$.to"), get("$.messages[0].content[1].input.to")), "picture": get("$.messages[1].content[1].text"),
    }
    each = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("text")) for n, v in fields.items()])
    out = out.select("request_id", "outcome", F.col("total").cast("long").alias("total"), F.col("headers_out")["X-Redact-Mode"].alias("mode"), F.explode(each).alias("f"))
    return out.select("request_id", "outcome", "total", "mode", "f.field", "f.text").filter("text is not null")


def body_restoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted bodies turned into replies that repeat their document, and restored; stripped ones stay as they are."""
    made = redacted_bodies(spark, sf_dir).withColumn("content", _content("body_out"))
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("content")).alias("message"))).alias("choices")))
    anthropic = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("content")))
    given = made.select("request_id", "provider", F.when(F.col("provider") == "openai", openai).otherwise(anthropic).alias("body"), "tokens", "content")
    out = redaction.restore_rows(given)
    text = F.coalesce(F.get_json_object("body_out", "$.choices[0].message.content"), F.get_json_object("body_out", "$.content[0].text"))
    return out.select("request_id", F.sha2("content", 256).alias("redacted_sha256"), F.sha2(text, 256).alias("text_sha256"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted documents as replies in pieces of 97 characters in two dialects, each behind its vault (a row with tokens as JSON and no
    frame, number -1), so that a document is redacted once for both.
    One dialect has a block of thinking, which goes through as it is, before the text, and ends its block."""
    d = redact.tokenise(documents(spark, sf_dir), "doc_id", RUN).withColumn("request_id", F.col("doc_id").cast("string"))
    d = d.withColumn("redacted", F.coalesce("redacted", F.lit("")))
    n = F.ceil(F.length("redacted") / 97).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(F.col("redacted"), i * 97 + 1, F.lit(97)))
    framed = lambda j: F.concat(F.lit("data: "), F.to_json(j), F.lit("\n\n"))
    openai = F.transform(pieces, lambda x: framed(F.struct(F.array(F.struct(F.struct(x.alias("content")).alias("delta"))).alias("choices"))))
    block = lambda i, kind, text: framed(F.struct(F.lit("content_block_delta").alias("type"), F.lit(i).alias("index"), F.struct(F.lit(f"{kind}_delta").alias("type"), text.alias(kind)).alias("delta")))
    stop = framed(F.struct(F.lit("content_block_stop").alias("type"), F.lit(1).alias("index")))
    anthropic = F.concat(F.array(F.lit("event: ping\n\n"), block(0, "thinking", F.substring("redacted", 1, 200))), F.transform(pieces, lambda x: block(1, "text", x)), F.array(stop))
    even = F.col("doc_id") % 2 == 0
    whole = F.when(even, F.concat(openai, F.array(F.lit("data: [DONE]\n\n")))).otherwise(anthropic)
    provider = F.when(even, F.lit("openai")).otherwise(F.lit("anthropic")).alias("provider")
    d = d.select("request_id", provider, F.to_json(redact.flipped(F.col("vault"))).alias("__tokens"), whole.alias("__whole"))
    rows = d.select("*", F.posexplode_outer(F.concat(F.array(F.lit(None).cast("string")), F.col("__whole"))).alias("at", "frame"))  # outer, as in ``detect.each``
    return rows.select("request_id", "provider", (F.col("at") - 1).cast("long").alias("seq"), "frame", F.when(F.col("at") == 0, F.col("__tokens")).alias("tokens"))


def joined_text(out: DataFrame) -> DataFrame:
    """Hashes of restored replies' text and thinking, put together."""
    kinds = "choices array<struct<delta:struct<content:string>>>, delta struct<text:string,thinking:string>"  # parsed once for all three
    j = out.select("request_id", "seq", "part", F.from_json(io.frame_data("frame"), kinds).alias("j"))
    text = F.coalesce(F.get("j.choices", F.lit(0))["delta"]["content"], F.col("j.delta.text"), F.lit(""))
    parts = j.select("request_id", F.struct("seq", "part", text.alias("text"), F.coalesce("j.delta.thinking", F.lit("")).alias("thought")).alias("p"))
    parts = parts.groupBy("request_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    joined = lambda name: F.sha2(F.array_join(F.transform("ps", lambda p: p[name]), ""), 256)
    return parts.select("request_id", joined("text").alias("text_sha256"), joined("thought").alias("thought_sha256"))


def streamed_restoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example streams, restored frame by frame and put together."""
    return joined_text(replies.restore_listed(streams(spark, sf_dir)))


def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made from the orders in which every type of the catalog occurs, some with zero-width and full-width characters."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", F.expr(sql.order_text("sha2({v}, 256)")).alias("text"))
    return _exploded(detect.detect(o), "o_orderkey")


def check_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validators over numbers made of order keys and dates."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    number = lambda n: F.lpad(k, n, "0")
    return o.select(
        "o_orderkey", checks.luhn(F.concat(F.lit("4000-0"), number(11))).alias("luhn"), checks.iban(F.concat(F.lit("DE"), F.lpad((F.col("o_orderkey") % 97).cast("string"), 2, "0"), number(18))).alias("iban"),
        checks.aba_routing(number(9)).alias("aba"), checks.ssn(F.concat(F.substring(number(9), 7, 3), F.lit("-"), F.substring(number(9), 5, 2), F.lit("-"), F.substring(number(9), 6, 4))).alias("ssn"),
        checks.plausible_date(F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit("/"), (F.col("o_custkey") % 40).cast("string"), F.lit("/"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))).alias("date"),
    )


def _raw_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    user, kind = F.col("user_id"), F.col("event_type")
    entry = lambda name, value: F.struct(F.lit(name).alias("k"), value.alias("v"))
    headers = F.filter(
        F.array(
            entry("X-Tenant", F.when(user % 3 == 0, F.concat(F.lit("t"), user.cast("string")))),
            entry("Authorization", F.when(user % 3 == 1, F.concat(F.lit("Bearer "), user.cast("string")))),
            entry("X-Redact-Mode", F.when(kind == "view", F.lit("STRIP")).when(kind == "error", F.lit("bogus"))),
            entry("X-Redact-Sets", F.when(kind == "click", F.lit("pii, PCI")).when(kind == "signup", F.lit("phi,zzz"))),
        ),
        lambda x: x["v"].isNotNull(),
    )
    paths = F.array(*map(F.lit, ("/v1/chat/completions?x=1", "/v1/messages", "/v1/messages/count_tokens", "/v1/embeddings")))
    model = F.when((kind != "purchase") | (F.col("event_id") % 2 == 0), F.lit("m1"))
    return e.select(F.col("event_id").alias("request_id"), F.get(paths, (F.col("event_id") % 4).cast("int")).alias("path"), F.map_from_entries(headers).alias("headers"), F.col("props").alias("body"), model.alias("model"))


def _policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    nation = F.col("c_nationkey")
    return c.select(
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("tenant"), F.when(nation % 3 == 0, F.lit("off")).when(nation % 3 == 2, F.lit("strip")).alias("mode"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.array().cast("array<string>")).alias("active_sets"), F.when(nation % 4 == 0, F.lit("open")).alias("fail_mode"),
        F.lit(None).cast("boolean").alias("consistent_pseudonyms"), F.lit(None).cast("boolean").alias("redact_system"),
        F.when(nation % 5 == 0, F.create_map(F.lit("openai"), F.lit("https://eu.example"))).alias("upstream_override"),
    )


def request_shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = requests.shape(_raw_requests(spark, sf_dir), _policies(spark, sf_dir))
    return s.select("request_id", "tenant", "bare", "provider", "mode", F.array_join("active_sets", ",").alias("active_sets"), "fail_mode", "upstream_base", F.size("forward_headers").cast("long").alias("n_forwarded"), "rejected")


def policy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' patches to customers' policies."""
    s = table(spark, sf_dir, "supplier")
    patch = s.select(
        F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("tenant"), F.when(F.col("s_nationkey") % 2 == 0, F.lit("reversible")).alias("mode"), F.lit(None).cast("array<string>").alias("active_sets"),
        F.lit("closed").alias("fail_mode"), F.lit(True).alias("consistent_pseudonyms"), F.lit(None).cast("boolean").alias("redact_system"), F.lit(None).cast("map<string,string>").alias("upstream_override"),
    )
    return requests.merge_policy(_policies(spark, sf_dir), patch).select("tenant", "mode", "fail_mode", "consistent_pseudonyms")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes_of(table(spark, sf_dir, "events"))


def outcomes_of(events: DataFrame, *carry: str) -> DataFrame:
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.col("event_type")
    return e.select(
        *carry,
        F.when(kind == "view", F.lit("strip")).when(kind == "error", F.lit("off")).otherwise(F.lit("reversible")).alias("mode"),
        F.create_map(F.lit("EMAIL"), F.col("k") % 3, F.lit("PHONE"), F.col("k") % 2).alias("entity_counts"),
        F.when(kind == "click", F.array(F.lit("pii"), F.lit("pci"))).otherwise(F.array(F.lit("phi"))).alias("active_sets"), (F.col("k") % 3 + F.col("k") % 2).alias("total"),
        F.when(kind == "error", F.lit("mode-off")).when(F.col("user_id") % 7 == 0, F.lit("path")).alias("bypass_reason"), ((kind == "purchase") & (F.col("value") > 200)).alias("failed_closed"),
        ((kind == "signup") & (F.col("value") > 300)).alias("upstream_error"), F.when(kind != "error", F.when(F.col("user_id") % 2 == 0, F.lit("full")).otherwise(F.lit("stream"))).alias("timing_src"), F.floor("value").alias("ms"),
    )


def _metric(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(outcomes(spark, sf_dir))


def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("tenant"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 1000).alias("ts"), F.lit("openai").alias("provider"), F.col("o_orderpriority").alias("model"),
        F.lit("strip").alias("mode"), F.create_map(F.lit("SSN"), (F.col("o_orderkey") % 5).cast("int"), F.lit("EMAIL"), F.lit(1)).alias("entity_counts"), F.array(F.lit("pii"), F.lit("phi")).alias("sets"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("total"),
    )


def audit_first_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of every tenant's chain."""
    return audit.chain(audit_records(spark, sf_dir), "tenant").filter("prev_hash = '0'").select("tenant", "seq", "hash")


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of every tenant's chain."""
    return audit.chain(audit_records(spark, sf_dir), "tenant").select("tenant", "seq", "prev_hash", "hash")


def audit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains per tenant in which some records were edited afterwards."""
    chained = audit.chain(audit_records(spark, sf_dir), "tenant")
    edited = chained.withColumn("total", F.when(F.col("seq") % 97 == 0, F.col("total") + 1).otherwise(F.col("total")))
    return audit.verify(edited, "tenant").withColumn("broken_at", F.col("broken_at").cast("long"))


def metrics_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.shares(metrics.by_mode(outcomes(spark, sf_dir)), "mode").withColumn("share", F.round("share", 6))


def reply_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("event: x\ndata: "), "role", F.lit("\n\ndata:  "), F.regexp_replace("text", "\n", " "), F.lit("\n\n: ping\n\ndata: [DONE]"))
    out = io.frames(c.select("conv_id", "turn", body.alias("body")))
    return out.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), F.length("frame").cast("long").alias("n_chars"), io.frame_data().alias("data"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.windowed_counts(table(spark, sf_dir, "events"))


def queries() -> dict[str, Query]:
    plain = (
        entity_spans, entity_spans_pages, entity_tally, candidate_counts, tally_by_set, strip_redaction, pseudonym_redaction, pseudonym_collisions, minted_tokens, summary_headers, restore_round_trip,
        body_redaction, body_restoring, streamed_restoring, check_digits, request_shaping, policy_merge, audit_first_links, audit_chain, audit_verify, entity_types, metrics_shares, reply_frames, event_windows,
    )
    numbers = {"metrics_" + f.__name__: _metric(f) for f in (metrics.totals, metrics.by_mode, metrics.dominant_mode, metrics.by_type, metrics.by_set, metrics.bypasses, metrics.latency)}
    from veilspark.plans import flows

    return {f.__name__: f for f in (*plain, *flows.QUERIES)} | numbers


def oracle_sql() -> dict[str, str]:
    from veilspark.plans import flows

    return sql.oracles(SECRET, RUN) | flows.oracle_sql(RUN)
