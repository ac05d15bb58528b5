"""Rows that fail by themselves, table functions, the data source and its sink, and the metrics text."""

import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from veilspark.functions import digests
from veilspark.functions.patterns import Catalog
from veilspark.operators import bodies, detect, metrics, redact, requests, tables
from veilspark.plans import catalog, redaction
from veilspark.sources import bodies as source
from veilspark.sources import io
from veilspark.streaming import replies

SECRET = "sixteen letters or more"
RAW = "request_id string, ts bigint, path string, headers map<string,string>, body string, model string"


def shaped(spark, rows, policies=()):
    df = spark.createDataFrame([(i, 1, "/v1/chat/completions", h, b, "m") for i, h, b in rows], RAW)
    return requests.shape(df, spark.createDataFrame(list(policies), io.POLICY))


def test_a_failing_row_fails_alone(spark):
    text = lambda t: json.dumps({"messages": [{"role": "user", "content": t}]})
    rows = [
        ("half", {}, '{"messages":[{"role":"user","content":"\\ud83d x a@b.co"}]}'), ("beside", {}, '{"messages":[{"role":"user","content":"to a@b.co"}],"x":"\\udc00"}'), ("deep", {}, '{"messages":' + "[" * 200_000),
        ("nan", {}, '{"messages":[],"n":NaN}'), ("numbers", {}, '{"messages":[{"role":"user","content":"a@b.co"}],"n":[1e2,1.5,1e400,12345678901234567890]}'), ("two", {"X-Tenant": "a", "x-tenant": "b"}, text("a@b.co")),
    ]
    got = {r.request_id: r for r in redaction.redact_rows(shaped(spark, rows), SECRET).collect()}
    assert {i: r.outcome for i, r in got.items()} == {"half": "fail-closed", "beside": "redacted", "deep": "fail-closed", "nan": "fail-closed", "numbers": "redacted", "two": "redacted"}
    assert got["half"].error == "UnicodeEncodeError" and all(got[i].body_out is None for i in ("half", "deep", "nan"))
    assert json.loads(got["beside"].body_out)["x"] == "\udc00" and json.loads(got["numbers"].body_out)["n"] == [100, 1.5, None, 12345678901234567890]
    assert ",\"n\":[100,1.5,null," in got["numbers"].body_out and got["two"].tenant in ("a, b", "b, a")
    reply = json.dumps({"choices": [{"message": {"content": "\ud83d <A_1>"}}], "x": "\ud83d"})
    rows = [("r", "openai", reply, {"<A_1>": "Ann"}), ("s", "openai", '{"choices":[{"message":{"content":"<A_1>"}}],"x":"\\ud83d"}', {"<A_1>": "Ann"})]
    back = {r.request_id: r.body_out for r in redaction.restore_rows(spark.createDataFrame(rows, "request_id string, provider string, body string, tokens map<string,string>")).collect()}
    assert back["r"] == reply and back["s"] == '{"choices":[{"message":{"content":"Ann"}}],"x":"\\ud83d"}'


@pytest.mark.parametrize("name", ["body_restoring", "body_redaction"])
def test_bodies_are_not_shuffled_by_tenant(spark, small, name):
    """Also where Spark takes the few policies for many: by its own estimate it broadcasts none here."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    given = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = catalog.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, given)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_fail_open_end_to_end(spark):
    policy = ("t", None, None, "open", None, None, None)
    rows = [("bad", {"x-tenant": "t"}, "{"), ("shut", {}, "{"), ("weak", {"x-tenant": "t"}, '{"messages":[]}'), ("off", {"x-redact-mode": "off"}, "{")]
    df = shaped(spark, rows, [policy]).withColumn("consistent_pseudonyms", F.col("request_id") == "weak")
    out = redaction.redact_rows(df, SECRET)
    got = {r.request_id: (r.outcome, r.bypass_reason, r.body_out) for r in out.collect()}
    assert got == {"bad": ("fail-open", "fail-open:detect", "{"), "shut": ("fail-closed", None, None), "weak": ("fail-open", "fail-open:pseudonym-secret", '{"messages":[]}'), "off": ("off", "mode-off", "{")}
    lines = metrics.document(redaction.outcomes(out)).splitlines()
    assert 'redact_bypass_by_reason{reason="fail-open:detect"} 1' in lines and "redact_fail_closed_total 1" in lines and "redact_bypass_total 3" in lines


def test_odd_frames_say_nothing_about_the_text():
    deep = "[" * 200_000
    for data in ('{"choices":[{"delta":"x"}]}', '{"choices":[5]}', '{"choices":{"0":1}}', deep, '{"choices":[{"delta":{"content":{"a":1}}}]}', "null", "5", '"x"'):
        assert replies.event_of("openai", data).text is None
    for data in ('{"type":"content_block_delta","delta":"x","index":"y"}', '{"type":"content_block_delta","index":[],"delta":{"type":"text_delta","text":5}}', deep, '{"type":["content_block_delta"]}'):
        event = replies.event_of("anthropic", data)
        assert not event.text and event.block is None
    reply = replies.Reply("openai", {"<A_1>": "Ann"})
    halves = [reply.frame(f'data: {{"choices":[{{"delta":{{"content":"{x}"}}}}]}}\n\n') for x in ("\\ud83d", "\\ude00 <A_1>")]
    assert "".join(json.loads(f[0][5:])["choices"][0]["delta"]["content"] for f in halves) == "\ud83d\ude00 Ann" and all(f[0].encode() for f in halves)


def test_headers_of_one_name_are_joined(spark):
    df = spark.createDataFrame([({"X-A": "1", "b": None, "x-a": "2", "X-a": "3"},), ({"B": None},), (None,), ({},)], "h map<string,string>")
    got = [r[0] for r in df.select(digests.lower_keys(F.col("h"))).collect()]
    assert sorted(got[0].pop("x-a").split(", ")) == ["1", "2", "3"] and got == [{"b": ""}, {"b": None}, None, {}]
    made = spark.range(1).select(digests.lower_keys(F.create_map(*map(F.lit, ("X-A", "1", "b", "", "x-a", "2")))).alias("h")).first().h
    assert made == {"x-a": "1, 2", "b": ""}


def test_case_is_folded_alike_on_both_paths(spark):
    """Letters that some engines fold into ASCII: every one of them, in every pattern that ignores case."""
    folding = [chr(i) for i in range(0x80, 0x2100) if (chr(i).lower() + chr(i).upper() + chr(i).casefold()).isascii() or any(c.isascii() and c.isalpha() for c in unicodedata.normalize("NFKC", chr(i)).lower() + chr(i).upper() + chr(i).lower())]
    assert "ı" in folding and "ſ" in folding
    shapes = ["12 Oak C{}rcle x", "12 Oak Street{}x", "12 Oak {}treet", "12 Oak Par{}way", "MRN{} 12345", "{}RN: 1234567", "mrn 12345{}", "a{}b@c.co", "12 O{}k Lane"]
    texts = [s.format(c) for s in shapes for c in [*folding, "K", "k", "i", "I"]] + ["12 Oak Cırcle x" + " y" * detect.LONG, "12 Oak Streetıx" + " y" * detect.LONG, "12 Oak Circle x" + " y" * detect.LONG, "12 Oak Cırcle x…", "12 Oak Streetıx…"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in detect.detect(df).collect():
        assert [tuple(s) for s in r.spans] == detect.py_detect(r.text, Catalog(), digests.SETS), r.text[:40]
    short = {t[:15]: [s[2] for s in detect.py_detect(t, Catalog(), digests.SETS)] for t in texts[-5:]}
    assert short["12 Oak Cırcle x"] == [] and short["12 Oak Circle x"] == ["STREET_ADDRESS"]


def test_strict_bodies_leave_no_card_in_clear(spark):
    text = "4012888888881881 415-555-0132 4012-8888-8888-1881"
    df = shaped(spark, [("r", {}, json.dumps({"messages": [{"role": "user", "content": text}]}))])
    content = lambda strict: json.loads(redaction.redact_rows(df, SECRET, strict=strict).first().body_out)["messages"][0]["content"]
    assert "4012-8888-8888-1881" in content(False) and not re.search("[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", content(True))


def test_pseudonyms_keep_the_type_a_value_was_minted_with_first(spark):
    r = redact.pseudonymise(detect.detect(spark.createDataFrame([("MRN 021000021 and aba 021000021",)], "text string")), SECRET).first()
    assert re.fullmatch(r"MRN (<US_ROUTING_[0-9A-F]{8}>) and aba \1", r.redacted)


def test_a_reply_comes_back_once(spark):
    body = lambda t: json.dumps({"messages": [{"role": "user", "content": t}]})
    made = redaction.redact_bodies(shaped(spark, [("x", {}, body("a@b.co")), ("x", {}, body("c@d.co")), ("y", {}, body("e@f.co")), ("y", {}, body("e@f.co"))]), SECRET)
    vaults = made["vault"].collect()
    assert len({v.reply_key for v in vaults}) == 3 and len(vaults) == 4
    token = {v.request_id: next(iter(v.tokens)) for v in vaults}
    reply = lambda i, k: (i, k, "openai", json.dumps({"choices": [{"message": {"content": token[i]}}]}))
    replies_ = spark.createDataFrame([reply(v.request_id, v.reply_key) for v in vaults[:3]] + [("z", None, "openai", "{}")], "request_id string, reply_key string, provider string, body string")
    text = lambda r: json.loads(r.body_out).get("choices", [{"message": {"content": ""}}])[0]["message"]["content"]
    by_id = redaction.restore_bodies(replies_, made["vault"]).collect()
    assert sorted(text(r) for r in by_id) == sorted(["", token["x"], token["x"], "e@f.co"])  # which of the two x it is, is not known
    by_key = redaction.restore_bodies(replies_, made["vault"], key="reply_key").collect()
    assert sorted(text(r) for r in by_key) == ["", "a@b.co", "c@d.co", "e@f.co"]
    piece = 'data: {"choices":[{"delta":{"content":"<A_1>"}}]}\n\n'
    other = 'data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"<A_1>"}}\n\n'
    frames = spark.createDataFrame([("x", "openai", 0, piece), (None, "openai", 0, piece), (None, "anthropic", 0, other)], "request_id string, provider string, seq bigint, frame string")
    twice = spark.createDataFrame([("x", {"<A_1>": "Ann"}), ("x", {"<A_1>": "Ann"})], "request_id string, tokens map<string,string>")
    out = replies.restore_frames(frames, twice).collect()
    assert sorted((r.request_id or "", "Ann" in r.frame, "content_block" in r.frame) for r in out) == [("", False, False), ("", False, True), ("x", True, False)]


# --- table functions


def test_slots_equals_the_list_of_fields(spark):
    tables.register(spark)
    given = [
        ("o", "openai", True, '{"messages":[{"role":"system","content":"s"},{"role":"user","content":[{"type":"text","text":"t"},"bare"],"name":"n"}]}'), ("o2", "openai", False, '{"messages":[{"role":"system","content":"s"}]}'),
        ("a", "anthropic", None, '{"system":"s","messages":[{"role":"user","content":[{"type":"tool_use","input":{"a":[1,"x"]}}]}]}'), ("bad", "openai", True, '{"messages":5}'), ("who", "nobody", True, "{}"), ("null", "openai", True, None),
    ]
    df = spark.createDataFrame(given, "request_id string, provider string, redact_system boolean, body string")
    rows = spark.sql("SELECT r.request_id, s.* FROM {df} r, LATERAL slots(r.body, r.provider, r.redact_system) s", df=df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.request_id, []).append((r.error,) if r.error else (r.slot, r.text, r.numeric))
    want = {r.request_id: [(r.error,)] if r.error else [tuple(f) for f in r.fields] for r in bodies.list_fields(df).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and want["null"] == [] and len(want["o"]) == 4
    deep = json.dumps({"messages": [{"role": "u", "tool_calls": [{"function": {"arguments": "[" * 20 + '"x"' + "]" * 20}}]}]})
    assert [r.error for r in spark.sql("SELECT s.error FROM slots(:body, 'openai', true, true) s", {"body": deep}).collect()] == ["TooDeep"]
    assert [r.text for r in spark.sql("""SELECT s.text FROM reply_slots('{"content":[{"type":"text","text":"hi"}]}', 'anthropic') s""").collect()] == ["hi"]
    for wrong in ("SELECT * FROM slots(5, 'openai')", "SELECT * FROM slots(NULL, 'openai', 'yes')", "SELECT * FROM restored('x')", "SELECT * FROM restored(TABLE({df}))"):
        with pytest.raises(Exception, match="slots takes|booleans|table of frames|lacks"):
            spark.sql(wrong, df=df).collect()


def test_restored_in_sql_equals_restored_frames(spark):
    tables.register(spark)
    piece = lambda x: f'data: {json.dumps({"choices": [{"delta": {"content": x}}]})}\n\n'
    rows = [(str(i), "openai", s, piece(x)) for i in range(40) for s, x in enumerate(["hi <A_", f"{i % 2}> and ", "<A_1> <A"])]
    frames = spark.createDataFrame(rows, "request_id string, provider string, seq bigint, frame string").repartition(5)
    vaults = spark.createDataFrame([(str(i), {"<A_1>": f"Ann{i}"}) for i in range(0, 40, 3)], "request_id string, tokens map<string,string>")
    given = frames.join(vaults, "request_id", "left").select("request_id", "provider", "seq", "frame", F.to_json("tokens").alias("tokens"))
    out = spark.sql("SELECT * FROM restored(TABLE({given}))", given=given)
    assert sorted(out.collect()) == sorted(replies.restore_frames(frames, vaults).collect())
    numbers = spark.sql("SELECT * FROM restored(TABLE({given}))", given=given.withColumn("request_id", F.col("request_id").cast("bigint")))
    assert numbers.schema["request_id"].dataType.simpleString() == "bigint" and numbers.count() == out.count()


# --- source and sink


def line(i, body="{}", **more):
    return json.dumps({"request_id": f"r{i}", "ts": i, "path": "/v1/messages", "headers": {"A": "b"}, "body": body} | more) + "\n"


def test_source_reads_ranges_and_rows_that_are_no_requests(spark, tmp_path):
    source.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [line(i, "é" * (i % 50)) for i in range(500)]
    odd = ["{nonsense\n", "5\n", "\n", '{"request_id":"\\ud83d"}\n', line(900, "x" * 300), line(901, "y" * 1_500_000), '{"request_id":5,"ts":"x","headers":[1],"body":{}}\n', "[" * 100_000 + "\n"]
    (folder / "a.jsonl").write_text("".join(lines[:300]) + "".join(odd))
    (folder / "b.jsonl").write_text("".join(lines[300:]).rstrip("\n"))
    (folder / "_hidden").write_text(line(999))
    for step in (20_011, 1 << 20):
        got = spark.read.format("bodies").option("limit", 200).option("range_bytes", step).load(str(folder)).collect()
        good = {r.request_id: r for r in got if r.error is None and r.request_id}
        assert {r: (x.ts, x.headers, x.body) for r, x in good.items()} == {f"r{i}": (i, {"A": "b"}, "é" * (i % 50)) for i in range(500)}
        assert sorted(r.error for r in got if r.error) == ["body too large", "line too large", *["unparseable line"] * 4]
        assert len(got) == 500 + 6 + 1 and len({(r.file, r.at) for r in got}) == len(got)
    assert spark.read.format("bodies").load(str(folder / "b.jsonl")).count() == 200
    (tmp_path / "none").mkdir()
    assert spark.read.format("bodies").load(str(tmp_path / "none")).count() == 0
    frames = tmp_path / "x.sse"
    frames.write_text("event: x\ndata: 1\n\ndata: 2\n\ndata: 3\n\n")
    assert [r.frame for r in spark.read.format("bodies").option("kind", "frames").load(str(frames)).orderBy("at").collect()] == ["event: x\ndata: 1\n\n", "data: 2\n\n", "data: 3\n\n"]


def test_stream_gives_the_same_rows_and_a_restart_loses_none(spark, tmp_path):
    source.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("bodies").option("range_bytes", 700).load(str(folder))
        query = stream.writeStream.format("json").option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"file://{tmp_path}/out").start()
        query.processAllAvailable()
        query.stop()

    (folder / "a.jsonl").write_text("".join(line(i) for i in range(20)) + line(20)[:30])  # the last line is still being written
    run()
    assert spark.read.json(f"file://{tmp_path}/out").count() == 20
    with (folder / "a.jsonl").open("a") as f:
        f.write(line(20)[30:] + line(21))
    (folder / "b.jsonl").write_text("".join(line(i) for i in range(22, 60)))
    run()
    run()
    got = spark.read.json(f"file://{tmp_path}/out").select("request_id", "ts", "file", "at").collect()
    want = spark.read.format("bodies").load(str(folder)).select("request_id", "ts", "file", "at").collect()
    assert sorted(got) == sorted(want) and len(got) == 60


def redacted_rows(spark, n=30):
    body = lambda i: json.dumps({"messages": [{"role": "user", "content": f"to u{i}@b.co"}]}) if i % 5 else "{"
    rows = redaction.redact_rows(shaped(spark, [(f"r{i}", {}, body(i)) for i in range(n)]), SECRET)
    return rows.select(*sorted({*source.AUDIT_FIELDS, *source.DATA_FIELDS}))


def test_sink_publishes_audit_first_and_each_batch_once(spark, tmp_path):
    source.register(spark)
    rows, at = redacted_rows(spark), f"file://{tmp_path}/sink"
    write = lambda fmt="redacted": rows.write.format(fmt).option("batch_id", "one").mode("append").save(at)
    died = str(tmp_path / "died")

    class Writer(source.BatchWriter):
        def publish(self, part, batch, files):
            if part == "data" and not __import__("os").path.exists(died):
                open(died, "w").close()
                raise RuntimeError("killed between the two")
            super().publish(part, batch, files)

        def abort(self, messages):
            """A driver that dies removes nothing."""

    class Dying(source.Redacted):
        @classmethod
        def name(cls):
            return "dying"

        def writer(self, schema, overwrite):
            return Writer(self.options)

    spark.dataSource.register(Dying)
    with pytest.raises(Exception, match="killed between the two"):
        write("dying")
    assert source.read_published(spark, at, "audit").count() == 24 and source.read_published(spark, at, "data").count() == 0
    write("dying")
    write()
    audit, data = source.read_published(spark, at, "audit"), source.read_published(spark, at, "data")
    assert audit.count() == 24 and audit.select("request_id").distinct().count() == 24 and {r.sets for r in audit.select(F.size("sets").alias("sets")).collect()} == {4}
    assert sorted(r.request_id for r in data.collect()) == sorted(f"r{i}" for i in range(30) if i % 5)
    assert not data.filter("outcome = 'fail-closed' or body_out like '%@%'").count() and not audit.filter("to_json(struct(*)) like '%@%'").count()
    with pytest.raises(Exception, match="never overwritten"):
        rows.write.format("redacted").mode("overwrite").save(at)


def test_sink_writes_no_part_again_that_is_published(spark, tmp_path):
    """A batch tried again takes no disk for what its manifests name already, not even until its end."""
    at, batches = f"file://{tmp_path}/sink", redacted_rows(spark).toArrow().to_batches()
    files = lambda: {p for p in tmp_path.rglob("part-*")}
    writer = source.BatchWriter({"path": at, "batch_id": "b/1"})
    first = writer.write(iter(batches))
    assert len(first.audit) == 1 and first.data
    writer.publish("audit", "b%2F1", first.audit)
    second = writer.write(iter(batches))  # the first attempt's data were never published
    assert second.audit == [] and len(second.data) == len(first.data)
    writer.commit([second])
    there, given = files(), iter(batches)
    assert writer.write(given) == source.Written([], []) and files() == there and next(given, None) is None
    assert source.read_published(spark, at, "audit").count() == 24 == source.read_published(spark, at, "data").count()
    other = source.BatchWriter({"path": at, "batch_id": "b/2"}).write(iter(batches))
    assert len(other.audit) == 1 and len(other.data) == len(first.data)


def test_sink_of_a_stream(spark, tmp_path):
    source.register(spark)
    redacted_rows(spark).coalesce(2).write.json(f"file://{tmp_path}/in")
    schema = redacted_rows(spark).schema
    at = f"file://{tmp_path}/sink"
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        query = stream.writeStream.format("redacted").option("checkpointLocation", f"file://{tmp_path}/state").start(at)
        query.processAllAvailable()
        query.stop()
        assert source.read_published(spark, at, "audit").count() == 24 and source.read_published(spark, at, "data").count() == 24


def test_file_writers_put_audit_before_data(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    rows = redacted_rows(spark)
    audit, data = rows.filter("outcome = 'redacted'").select("request_id", "total"), rows
    io.write_redacted(audit, data, at("audit"), at("data"))
    assert spark.read.json(at("audit")).count() == 24 == spark.read.json(at("data")).count() and (tmp_path / "data").glob("upstream_base=*")
    write = io.batch_writer(at("a2"), at("d2"), lambda batch: (batch.filter("outcome = 'redacted'").select("request_id"), batch))
    for _ in range(2):
        write(rows, 3)
    assert spark.read.json(at("a2")).count() == 24 == spark.read.json(at("d2")).count()


# --- metrics text


def test_metrics_document(spark):
    columns = "mode string, entity_counts map<string,int>, active_sets array<string>, total int, bypass_reason string, failed_closed boolean, upstream_error boolean, timing_src string, ms bigint"
    rows = [("strip", {"EMAIL": 2}, ["pii"], 2, None, False, False, "full", 10), ("strip", {}, ["pii", "phi"], 0, None, False, True, "full", 15), (None, None, None, None, 'a"b\\c\nd', None, None, None, None)]
    text = metrics.document(spark.createDataFrame(rows, columns), "x")
    assert text.splitlines() == [
        "x_requests_total 3", "x_redacted_requests_total 1", "x_redacted_entities_total 2", "x_bypass_total 1", "x_fail_closed_total 0", "x_upstream_errors_total 1", 'x_requests_by_mode{mode="strip"} 2',
        'x_redacted_by_type{type="EMAIL"} 2', 'x_redacted_by_set{set="phi"} 0', 'x_redacted_by_set{set="pii"} 2', 'x_bypass_by_reason{reason="a\\"b\\\\c\\nd"} 1', 'x_avg_latency_ms{src="full"} 12.5',
    ]
    assert metrics.document(spark.createDataFrame([], columns)).count("\n") == 6
    counts = spark.createDataFrame([("strip", 3)], "mode string, n bigint")
    assert metrics.text_lines(counts, "m", "mode").first().line == 'm{mode="strip"} 3'
