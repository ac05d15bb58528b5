"""Tokens, restoring, bodies, streams, shaping, audit and metrics."""

import hashlib
import hmac as py_hmac
import json
import time

import pytest
from pyspark.sql import functions as F

from veilspark.functions import digests
from veilspark.operators import audit, bodies, detect, redact, requests
from veilspark.plans import catalog, redaction
from veilspark.sources import io
from veilspark.streaming import replies

SECRET = "sixteen letters or more"


def found(spark, *texts):
    return detect.detect(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"))


def test_hmac_and_canonical_json(spark):
    r = spark.createDataFrame([("vé", {"b": 1, "a": 2}, None)], "v string, m map<string,int>, n string")
    got = r.select(digests.hmac_sha256(SECRET, r.v), digests.hmac_sha256("k" * 70, r.v), digests.canonical_json({"z": r.v, "m": r.m, "n": r.n}, maps=("m",))).first()
    assert got[0] == py_hmac.new(SECRET.encode(), "vé".encode(), "sha256").hexdigest() and got[1] == py_hmac.new(b"k" * 70, "vé".encode(), "sha256").hexdigest()
    assert got[2] == '{"m":{"a":2,"b":1},"n":null,"z":"vé"}'


def test_tokens_count_from_right_to_left_and_repeat(spark):
    r = redact.tokenise(found(spark, "a@b.co x@y.zz a@b.co 10.0.0.1"), "id", SECRET).first()
    n = r.vault["a@b.co"][7:13]
    assert r.redacted == f"<EMAIL_{n}_1> <EMAIL_{n}_2> <EMAIL_{n}_1> <IPV4_{n}_1>"


def test_strip_pseudonyms_and_refusal(spark):
    df = found(spark, "a@b.co and a@b.co", "no entity")
    assert redact.strip(df).orderBy("id").first().redacted == "[EMAIL] and [EMAIL]"
    tag = py_hmac.new(SECRET.encode(), b"a@b.co", "sha256").hexdigest()[:8].upper()
    assert [r.redacted for r in redact.pseudonymise(df, SECRET).orderBy("id").collect()] == [f"<EMAIL_{tag}> and <EMAIL_{tag}>", "no entity"]
    with pytest.raises(ValueError):
        redact.pseudonymise(df, "short")


def test_restore_is_one_pass_and_leaves_unknown_tokens(spark):
    df = spark.createDataFrame([("<A_1> <B_2> <C_3> <A", {"<A_1>": "<B_2>", "<B_2>": "b"})], "t string, m map<string,string>")
    got = df.select(redact.restore(df.t, df.m), redact.resolve_partial(F.lit("<A"), df.m), redact.resolve_partial(F.lit("<"), df.m)).first()
    assert list(got) == ["<B_2> b <C_3> <A", "<B_2>", None]


BODIES = [
    ("o1", "openai", {"messages": [{"role": "system", "content": "s@s.co"}, {"role": "user", "name": "n@n.co", "content": [{"type": "text", "text": "a@b.co"}, {"type": "image_url", "image_url": "i@i.co"}, "bare@b.co", None]}, None]}),
    ("o2", "openai", {"tools": [{"function": {"description": "d@d.co", "parameters": {"k@k.co": "p@p.co", "__proto__": "q@q.co"}}}], "messages": [{"role": "assistant", "tool_calls": [{"function": {"arguments": '{"card": 4012888888881881, "id": 1299, "to": "t@t.co"}'}}, {"function": {"arguments": "raw u@u.co"}}]}]}),
    ("a1", "anthropic", {"system": [{"type": "text", "text": "s@s.co"}], "tools": [{"description": "d@d.co", "input_schema": {"x": ["l@l.co"]}}], "messages": [{"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "r@r.co"}]}, {"type": "tool_use", "input": {"n": 4012888888881881, "m": 7350112233}}]}]}),
    ("bad", "openai", {"messages": 5}),
]


def test_fields_of_bodies(spark):
    df = spark.createDataFrame([(i, p, True, json.dumps(b)) for i, p, b in BODIES], "request_id string, provider string, redact_system boolean, body string")
    got = {r.request_id: r for r in bodies.list_fields(df).collect()}
    assert [f.text for f in got["o1"].fields] == ["s@s.co", "a@b.co", "bare@b.co", "n@n.co"]
    assert [f.text for f in got["o2"].fields] == ["d@d.co", "p@p.co", "q@q.co", "4012888888881881", "1299", "t@t.co", "raw u@u.co"]
    assert [f.text for f in got["a1"].fields] == ["s@s.co", "d@d.co", "l@l.co", "r@r.co", "4012888888881881", "7350112233"]
    assert got["bad"].error == "TypeError"
    without = {r.request_id: [f.text for f in r.fields] for r in bodies.list_fields(df.withColumn("redact_system", F.lit(False))).collect()}
    assert "s@s.co" not in without["o1"] + without["a1"]


def test_bodies_end_to_end(spark):
    path = {"openai": "/v1/chat/completions", "anthropic": "/v1/messages"}
    raw = [(i, 1, path[p], {"X-Redact-Mode": "strip"} if i == "a1" else {}, json.dumps(b), "m") for i, p, b in BODIES]
    raw += [("off", 1, path["openai"], {"x-redact-mode": "off"}, '{"messages":[{"content":"a@b.co"}]}', "m"), ("reject", 1, path["openai"], {"x-redact-sets": "pii,what"}, "{}", "m"), ("gate", 1, path["openai"], {"x-redact-sets": "pci"}, '{"messages":[{"content":"a@b.co"}]}', "m")]
    df = spark.createDataFrame(raw, "request_id string, ts bigint, path string, headers map<string,string>, body string, model string")
    made = redaction.redact_bodies(requests.shape(df, spark.createDataFrame([], io.POLICY)), SECRET)
    got = {r.request_id: r for r in made["data"].collect()}
    assert {i: r.outcome for i, r in got.items()} == {"o1": "redacted", "o2": "redacted", "a1": "redacted", "bad": "fail-closed", "off": "off", "reject": "fail-closed", "gate": "redacted"}
    assert got["bad"].body_out is None and got["reject"].body_out is None and "a@b.co" in got["off"].body_out and "a@b.co" in got["gate"].body_out
    o2 = json.loads(got["o2"].body_out)
    arguments = json.loads(o2["messages"][0]["tool_calls"][0]["function"]["arguments"])
    assert arguments["id"] == 1299 and arguments["card"].startswith("<CREDIT_CARD_") and "k@k.co" in got["o2"].body_out and "u@u.co" not in got["o2"].body_out
    a1 = json.loads(got["a1"].body_out)
    assert a1["system"][0]["text"] == "[EMAIL]" and a1["messages"][0]["content"][1]["input"] == {"n": "[CREDIT_CARD]", "m": 7350112233}
    assert "i@i.co" in got["o1"].body_out and got["o1"].total == 4
    audited = made["audit"].collect()
    assert {r.request_id for r in audited} == {"o1", "o2", "a1", "off", "gate"} and not any("@" in str(r) for r in audited)
    vaults = {r.request_id: r.tokens for r in made["vault"].collect()}
    assert "a1" not in vaults
    token = next(k for k, v in vaults["o1"].items() if v == "a@b.co")
    reply = spark.createDataFrame([("o1", "openai", json.dumps({"choices": [{"message": {"content": f"to {token}", "tool_calls": token}}]}))], "request_id string, provider string, body string")
    out = json.loads(redaction.restore_bodies(reply, made["vault"]).first().body_out)["choices"][0]["message"]
    assert out == {"content": "to a@b.co", "tool_calls": token}


def test_rows_with_null_and_repeated_ids_failing_detectors_and_deep_bodies(spark):
    deep = json.dumps({"messages": [{"role": "u", "tool_calls": [{"function": {"arguments": "[" * 20 + '"a@b.co"' + "]" * 20}}]}]})
    text = lambda t: json.dumps({"messages": [{"content": t}]})
    raw = [(None, text("a@b.co")), (None, text("c@d.co")), ("x", text("a@b.co x@y.zz a@b.co")), ("x", text("10.0.0.1")), ("fail", text("force-detector-failure")), ("deep", deep), ("none", None), ("list", "[]")]
    df = spark.createDataFrame([(i, 1, "/v1/messages", {}, b, "m") for i, b in raw], "request_id string, ts bigint, path string, headers map<string,string>, body string, model string")
    shaped = requests.shape(df, spark.createDataFrame([], io.POLICY))
    detect.register_detector("failing", detect.failing)
    got = redaction.redact_rows(shaped, SECRET, detectors=("failing",), strict=True).collect()
    out = {r.body: (r.outcome, r.error, r.total) for r in got}
    assert [out[b][0] for _, b in raw] == ["redacted"] * 4 + ["fail-closed"] * 4
    assert [out[b][1] for _, b in raw[4:]] == ["RuntimeError", "TooDeep", "no body", "TypeError"] and out[raw[2][1]][2] == 3
    assert all("@" not in r.body_out and "10.0.0.1" not in r.body_out for r in got if r.outcome == "redacted")
    assert next(r for r in got if r.body == raw[2][1]).headers_out == {"X-Redacted": "3", "X-Redacted-Types": "EMAIL:3", "X-Redact-Mode": "reversible"}
    weak = redaction.redact_rows(shaped.withColumn("consistent_pseudonyms", F.lit(True)), SECRET).filter("request_id = 'x'").collect()
    assert {(r.outcome, r.error) for r in weak} == {("fail-closed", "weak secret")}
    strong = redaction.redact_rows(shaped.withColumn("consistent_pseudonyms", F.lit(True)), SECRET, secret=SECRET).filter("request_id = 'x'").collect()
    assert {r.outcome for r in strong} == {"redacted"}
    plan = redaction.redact_rows(shaped.drop("rejected").withColumn("rejected", F.lit(None).cast("string")), SECRET)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == shaped._jdf.queryExecution().executedPlan().toString().count("Exchange")  # those of the policies only
    assert requests.Settings.from_env({"DEFAULT_MODE": "strip", "ACTIVE_SETS": "pii, zzz", "REDACT_SYSTEM": "false", "FAIL_MODE": "what"}) == requests.Settings(default_mode="strip", active_sets=("pii",), redact_system=False)
    assert spark.range(1).select(digests.now_ms() > 1_600_000_000_000).first()[0]


def test_registered_dialect_and_stream():
    bodies.register_dialect("plain", lambda body, system, strict: [(body, "prompt", False)], lambda body: [(body, "answer", False)])
    fields, _ = bodies.request_fields({"prompt": "a@b.co"}, bodies.REQUESTS["plain"], True, False)
    assert [h[k] for h, k, _ in fields] == ["a@b.co"]
    replies.register_stream("plain", lambda j: replies.Event(text=j.get("t"), stops=bool(j.get("end")), ends=bool(j.get("end"))), lambda text, _: f'data: {json.dumps({"t": text})}\n\n')
    reply = replies.Reply("plain", {"<A_1>": "Ann"})
    assert reply.frame('data: {"t": "hi <A"}') == ['data: {"t": "hi "}\n\n'] and reply.frame('data: {"end": 1}') == ['data: {"t": "Ann"}\n\n', 'data: {"end": 1}'] and reply.stopped


def test_stream_lets_go_of_ended_replies_and_passes_on_what_waits(spark, tmp_path):
    """``b`` never gets its second frame: after the timeout its third goes on, and the tail it held."""
    piece = lambda x: f'data: {json.dumps({"choices": [{"index": 0, "delta": {"content": x}}]})}\n\n'
    tokens = json.dumps({"<A_1>": "Ann"})
    rows = [("a", "openai", 0, piece("<A_1> ok"), tokens), ("a", "openai", 1, "data: [DONE]\n\n", tokens), ("b", "openai", 0, piece("to "), tokens), ("b", "openai", 2, piece("<A_1"), tokens)]
    frames = spark.createDataFrame(rows, "request_id string, provider string, seq bigint, frame string, tokens string")
    frames.coalesce(1).write.json(f"file://{tmp_path}/in")
    out = replies.restore_stream(spark.readStream.schema(frames.schema).json(f"file://{tmp_path}/in"), timeout=1000)
    query = out.writeStream.format("memory").queryName("restored_waiting").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", f"file://{tmp_path}/state").start()
    try:
        for _ in range(30):
            got = spark.table("restored_waiting").collect()
            if len(got) >= 4:
                break
            query.awaitTermination(1)
        kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        query.stop()
    text = lambda r: "".join(replies.parse_delta("openai", x.frame.split("data:")[-1].strip())[0] for x in sorted((x for x in got if x.request_id == r), key=lambda x: (x.seq, x.part)))
    assert text("a") == "Ann ok" and text("b") == "to Ann" and kept == 0


def test_audit_command_and_policies_that_stay(spark, tmp_path, capsys):
    at = lambda n: f"file://{tmp_path}/{n}"
    chained = audit.chain(records(spark), "tenant")
    io.append_audit(chained, at("good"))
    io.append_audit(chained.withColumn("total", F.col("total") + 1), at("bad"))
    assert audit.main([at("good")]) == 0 and audit.main([at("bad"), "tenant"]) == 1
    assert "hash mismatch" in capsys.readouterr().out
    current = spark.createDataFrame([("t", "strip", ["pii"], None, True, None, None)], io.POLICY)
    (tmp_path / "policy").mkdir()
    (tmp_path / "policy/x.json").write_text('{"tenant":"u","mode":"off"}\n{nonsense\n')
    assert [r.tenant for r in io.read_policies(spark, at("policy"), current).collect()] == ["t"]
    assert [r.tenant for r in io.read_policies(spark, at("absent"), current).collect()] == ["t"]


def test_every_type_of_the_catalog_occurs_in_the_example_texts(spark, small):
    from veilspark.functions.patterns import PATTERNS, SECRETS
    from veilspark.plans import catalog

    found = {r.type for r in catalog.entity_types(spark, f"{small}/../sf0.01").select("type").distinct().collect()}
    assert found == {p.type for p in PATTERNS + SECRETS}


def test_restorer_does_not_depend_on_chunks():
    tokens = {"<EMAIL_7F3A2B_1>": "a@b.co", "<SSN_7F3A2B_1>": "1"}
    text = "x <EMAIL_7F3A2B_1> a < b <EMAIL_9> <<EMAIL_7F3A2B_1> <SSN_7F3A2B_1>"
    for size in range(1, len(text) + 1):
        r = replies.Restorer(tokens)
        out = "".join(r.push(text[i : i + size]) for i in range(0, len(text), size)) + r.end()
        assert out == "x a@b.co a < b <EMAIL_9> <a@b.co 1"
    r = replies.Restorer(tokens)
    assert r.push("to <EMAIL_7F") + r.end() == "to a@b.co"


def anthropic_frames():
    make = lambda **k: f"data: {json.dumps(k)}\n\n"
    yield "event: ping\n\n"
    yield make(type="content_block_delta", index=0, delta={"type": "thinking_delta", "thinking": "<A_1>"})
    for x in ("hi <A", "_1> and", " <A_"):
        yield make(type="content_block_delta", index=1, delta={"type": "text_delta", "text": x})
    yield make(type="content_block_stop", index=1)


def test_streams_by_table_and_by_state(spark, tmp_path):
    tokens = {"<A_1>": "Ann"}
    openai = [f'data: {json.dumps({"choices": [{"index": 0, "delta": {"content": x}}]})}\n\n' for x in ("<A_", "1>", " ok <A")] + ['data: {"choices":[{"delta":{},"finish_reason":"stop"}]}\n\n', "data: [DONE]\n\n"]
    rows = [("o", "openai", i, f) for i, f in enumerate(openai)] + [("a", "anthropic", i, f) for i, f in enumerate(anthropic_frames())]
    frames = spark.createDataFrame(rows, "request_id string, provider string, seq bigint, frame string")
    vaults = spark.createDataFrame([("o", tokens), ("a", tokens)], "request_id string, tokens map<string,string>")

    def text(out, request, provider):
        got = sorted((r for r in out if r.request_id == request), key=lambda r: (r.seq, r.part))
        return "".join(replies.parse_delta(provider, r.frame.split("data:")[-1].strip())[0] for r in got), got

    done = replies.restore_frames(frames, vaults).collect()
    assert text(done, "o", "openai")[0] == "Ann ok Ann" and text(done, "a", "anthropic")[0] == "hi Ann and Ann"
    assert [r.frame for r in text(done, "a", "anthropic")[1]][-1].startswith('data: {"type": "content_block_stop"')
    source = frames.withColumn("tokens", F.lit(json.dumps(tokens)))
    for i, part in enumerate((source.filter("seq >= 2"), source.filter("seq < 2"))):  # the later frames come first
        part.coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(source.schema).json(f"file://{tmp_path}/in")
        query = replies.restore_stream(stream, timeout=None).writeStream.format("json").option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"file://{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(60)
    out = spark.read.schema(replies.OUT).json(f"file://{tmp_path}/out").collect()
    assert {(r.request_id, r.seq, r.part, r.frame) for r in out} == {(r.request_id, r.seq, r.part, r.frame) for r in done if r.part < 1000}


def records(spark, n=7):
    rows = [("t1" if i % 2 else "t2", i, i * 10, "openai", "m", "strip", {"SSN": i, "EMAIL": 1}, ["pii"], i + 1) for i in range(n)]
    return spark.createDataFrame(rows, "tenant string, seq bigint, ts bigint, provider string, model string, mode string, entity_counts map<string,int>, sets array<string>, total int")


def test_audit_chain_and_its_breaks(spark):
    good = audit.chain(records(spark), "tenant").cache()
    assert all(r.ok for r in audit.verify(good, "tenant").collect())
    check = lambda df: {r.tenant: (r.ok, r.broken_at, r.reason) for r in audit.verify(df, "tenant").collect()}["t2"]
    assert check(good.withColumn("total", F.when(F.col("seq") == 2, 99).otherwise(F.col("total")))) == (False, 1, "hash mismatch")
    assert check(good.filter("seq <> 2")) == (False, 1, "prevHash mismatch")
    assert check(good.withColumn("hash", F.when(F.col("seq") != 4, F.col("hash")))) == (False, 2, "unparseable line")
    more = audit.chain(records(spark, 9).filter("seq >= 7"), "tenant", heads=audit.heads(good, "tenant"))
    assert all(r.ok for r in audit.verify(good.unionByName(more), "tenant").collect())
    assert audit.verify(good.limit(0), "tenant").count() == 0


def test_sources_round_trip(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    policies = spark.createDataFrame([("t", "strip", ["pii"], None, True, None, {"openai": "x"})], io.POLICY)
    io.write_policies(policies, at("policies"))
    assert io.read_policies(spark, at("policies")).collect() == policies.collect()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"tenant":"t","mode":"off"}\n{nonsense\n')
    assert [r.tenant for r in io.read_policies(spark, at("bad")).collect()] == ["t"]
    chained = audit.chain(records(spark), "tenant")
    io.append_audit(chained, at("audit"))
    assert all(r.ok for r in audit.verify(io.read_audit(spark, at("audit")), "tenant").collect())
    (tmp_path / "req").mkdir()
    (tmp_path / "req/x.json").write_text(json.dumps({"request_id": "1", "ts": 1, "path": "/v1/messages", "headers": {"A": "b"}, "body": '{"model":"m","stream":true}'}) + "\n")
    r = io.read_requests(spark, at("req")).first()
    assert (r.model, r.stream, r.error) == ("m", True, None)
    big = io.with_limits(spark.createDataFrame([("x" * 20,)], "body string"), limit=10).first()
    assert big.body is None and big.error == "body too large"


def test_entry_imports_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parents[1]
    shutil.copytree(repo / "veilspark", tmp_path / "veilspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'entity_spans' in q and not any(n.startswith('op') for n in q) and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_restoring_looks_for_placeholders_once(spark):
    """Time is what differs: looking again at each of the gaps takes about a minute. The text is not constant, or Spark would look once anyway."""
    n = 8_000
    df = spark.range(1).select(F.repeat(F.concat(F.lit("<A_1> and <B_2>, "), F.col("id").cast("string")), n).alias("text"), F.create_map(F.lit("<A_1>"), F.lit("Ann")).alias("tokens"))
    began = time.time()
    assert df.select(redact.restore(F.col("text"), F.col("tokens")).alias("x")).first().x == "Ann and <B_2>, 0" * n
    assert time.time() - began < 20


@pytest.mark.parametrize("name", ["streamed_restoring", "streamed_restoring_in_sql"])
def test_streams_redact_a_document_once(spark, small, name):
    plan = catalog.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "Join" not in plan


def test_vaults_beside_frames_of_any_kind(spark):
    """Repeated vaults count once, different ones not at all; a reply without one, and one without an id, stay as they are."""
    frame = lambda text: f'data: {{"choices":[{{"delta":{{"content":"{text}"}}}}]}}\n\n'
    frames = [(r, "openai", i, frame(x)) for r in ("a", "b", "c", None) for i, x in enumerate(("<A", "_1> x"))]
    vaults = [("a", {"<A_1>": "Ann"}), ("a", {"<A_1>": "Ann"}), ("a", None), ("b", {"<A_1>": "Bob"}), ("b", {"<A_1>": "Ben"}), (None, {"<A_1>": "Non"}), ("d", {"<A_1>": "Dee"})]
    out = replies.restore_frames(spark.createDataFrame(frames, "request_id string, provider string, seq bigint, frame string"), spark.createDataFrame(vaults, "request_id string, tokens map<string,string>"))
    texts = {r.request_id: r.text for r in catalog.joined_text(out.withColumn("request_id", F.coalesce("request_id", F.lit("none")))).select("request_id", F.col("text_sha256").alias("text")).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert texts == {"a": sha("Ann x"), "b": sha("<A_1> x"), "c": sha("<A_1> x"), "none": sha("<A_1> x")}
