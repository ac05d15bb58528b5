"""The operators as queries over the given tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import chat, interactions, lm, media, mixing, neardup, packing, pieces, prefixes, quality, suffixes, urls, warc

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are taken as outcomes of the pages with the same number: bad is low quality or toxic."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, labels, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(_table(spark, sf_dir, "pages"), shard_bytes=32 << 20, roll_bytes=16 << 20)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *neardup.ADDED)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.digests(chat.format_conversations(rows.union(extra)))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_text(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")
    return media.features(stored).select(*columns)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), repetition=2.0).select("doc_id", "source", *mixing.ADDED)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return interactions.audit(documents, _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(_table(spark, sf_dir, "documents"), pieces_path(), carry=("doc_id",), decoded=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filter, op2_suffix_dedup, op3_warc, op4_lm_scoring, op5_near_dedup, op6_chat_format, op7_media_columns, op8_packing, op9_mixing, op10_quality_rules, op11_prefix_trie, op12_filter_interactions, op13_pieces)
    return {f.__name__: f for f in ops}


_SPACE = r"[\x20\x09-\x0D]+"

OP10_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select *, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from d),
k as (select row_number() over () as r, * from w),
grams as (
  select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select r, words, unnest(range(1, len(words) - 1)) as i from k where len(words) >= 3)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from grams) where c > 1),
covered as (select r, count(distinct j) as n from (select r, i + unnest([0, 1, 2]) as j from twice) group by r),
m as (
  select doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '{_SPACE}', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    len(list_filter(words, lambda x: list_contains([{", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))}], x))) as n_stop,
    len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words
  from k left join covered c on c.r = k.r),
b as (select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and n_words >= 50 and word_chars::double / greatest(n_words, 1) between 3 and 10
  and n_symbols::double / greatest(n_words, 1) <= 0.1 and n_stop::double / greatest(n_words, 1) >= 0.02
  and n_dup_lines::double / greatest(n_lines, 1) <= 0.5 as kept
from b
"""

OP6_SQL = r"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked as (
  select *, role is distinct from lag(role) over (partition by conv_id order by turn, role, text) as first,
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as text_chars,
    length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '%', '%25'), chr(10), '%0A')) as role_chars
  from rows_)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(text_chars + case when first then 12 + role_chars + 1 + 11 else 10 end)::bigint as formatted_chars
from marked group by conv_id
"""

OP3_SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
g as (select *, max(page_id) over (partition by html) as leader from p)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((cast('0x' || substr(h, 5 * (i // 4) + 1, 5) as int) >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
  case when page_id = leader then 'response' else 'revisit' end as record_type, case when page_id <> leader then leader end as refers_to
from g
"""

OP11_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
i as (
  select conv_id, turn, substr(sha256(strlen(role) || ':' || role || text), 1, 32) as id, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) as words from t),
own as (select conv_id, list({'id': id, 'words': words} order by turn nulls first, id) as turns from i group by conv_id),
h as (
  select conv_id, turns, xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295) % 4 as h
  from own),
r as (
  select h.conv_id, list_concat(coalesce(own.turns[1:h.h], []), h.turns[h.h + 1:]) as turns from h left join own on own.conv_id = h.conv_id - h.conv_id % 20),
p as (select conv_id, turns, len(turns) as size, unnest(range(0, len(turns) + 1)) as depth from r),
m as (select conv_id, depth, size, array_to_string(list_transform(turns[1:depth], lambda x: x.id), '') as path, coalesce(turns[depth].words, 0) as words from p),
n as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = size), '')) as ends_sha256
  from m group by path, depth),
c as (select substr(path, 1, 32 * (depth - 1)::int) as path, count(*) as n_children from n where depth > 0 group by 1),
k as (select n.*, coalesce(c.n_children, 0) as n_children from n left join c using (path)),
a as (
  select substr(path, 1, 32 * up::int) as path, sum((n_children = 0)::int) as n_leaves, sum((n_convs - 1) * words) as saved_tokens
  from (select *, unnest(range(0, depth + 1)) as up from k) group by 1)
select k.conv_id, k.depth::bigint as depth, u.conv_id as parent_conv_id, k.n_convs, k.n_children, a.n_leaves::bigint as n_leaves, a.saved_tokens::bigint as saved_tokens, k.ends_sha256
from k join a using (path) left join k u on k.depth > 0 and u.path = substr(k.path, 1, 32 * (k.depth - 1)::int)
"""

OP12_SQL = r"""
with k as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
d as (
  select d.doc_id, coalesce(d.source, '') as part, coalesce(d.text, '') as text, coalesce(k.good, 0) as good, coalesce(k.toxic, 0) as toxic,
    list_filter(string_split_regex(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents d left join k on k.doc_id = d.doc_id),
m as (
  select part, good, toxic,
    (len(words) < 50)::int + 2 * (100 * list_unique(words) < 65 * len(words))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as mask
  from d),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from l a, l b, l c, l d, l e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, bits[step] as bit, step, list_sum(bits[1:step - 1]) as before from (select *, unnest(range(1, 6)) as step from o)),
r as (
  select part, filter_order, step, bit, sum(n) filter (mask & (coalesce(before, 0)::int | bit) = 0) as kept,
    sum(n) filter (mask & bit > 0 and mask & coalesce(before, 0)::int = 0) as removed, sum(n) filter (mask & bit > 0 and mask & coalesce(before, 0)::int > 0) as redundant,
    sum(n) filter (mask = bit) as unique_fails, sum(good) filter (mask & bit > 0 and mask & coalesce(before, 0)::int = 0) as good_lost,
    sum(toxic) filter (mask & bit > 0 and mask & coalesce(before, 0)::int = 0) as toxic_lost
  from c, s group by part, filter_order, step, bit)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, bit))::bigint as shapley
from r
"""


def _concentration(name: str, children: str, parent: str) -> str:
    return f"""
{name}_p as (select {parent}, count(*) as c, sum(n) as n, sum(k) as k, sum(n * n) as nn, sum(k * k / n::double) as kk from {children} where n > 0 group by {parent}),
{name}_s as (select sum(c) as c, count(*) as g, sum(n) as n, sum(nn / n::double) as nn, sum(kk - k * k / n::double) as b, sum(k - kk) as w from {name}_p),
{name}_v as (select *, greatest(b, 0) / (c - g) as mb, greatest(w, 0) / (n - c) as mw, (n - nn) / (c - g) as size from {name}_s where n > 0 and c > g and n > c),
{name} as (
  select coalesce(max(round(1 / least(greatest(case when mb + (size - 1) * mw > 0 then (mb - mw) / (mb + (size - 1) * mw) else 0 end, 0.001), 0.9) - 1, 6)), 10.0) as x from {name}_v)"""


def _op1_sql() -> str:
    suffixes_ = ", ".join(f"'{s}'" for s in urls.SUFFIXES)
    rule = verdict = "null"
    for kind, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{host}' or suffix(host, '.{host}')) and starts_with(path, '{path}')"
        rule, verdict = f"case when {fits} then '{host}{path}' else {rule} end", f"case when {fits} then '{kind}' else {verdict} end"
    return f"""
with p as (
  select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{urls.ascii_uppercase}', '{urls.ascii_lowercase}') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
l as (select doc_id, count(*) as n, sum((quality = 0 or toxic = 1)::int) as k from labels where doc_id is not null group by doc_id),
h0 as (select host, coalesce(sum(n), 0)::bigint as n, coalesce(sum(k), 0)::bigint as k, string_split(host, '.') as parts from p left join l on l.doc_id = p.page_id group by host),
h1 as (select *, case when array_to_string(parts[-2:], '.') in ({suffixes_}) then array_to_string(parts[-2:], '.') else parts[-1] end as suffix from h0),
h as (select *, case when contains(suffix, '.') then array_to_string(parts[-3:], '.') else array_to_string(parts[-2:], '.') end as domain from h1),
d as (select domain, suffix, sum(n)::bigint as n, sum(k)::bigint as k from h group by domain, suffix),
s as (select suffix, 0 as root, sum(n)::bigint as n, sum(k)::bigint as k from d group by suffix),
{_concentration("kh", "h", "domain")}, {_concentration("kd", "d", "suffix")}, {_concentration("ks", "s", "root")},
base as (select (sum(k) + 0.5) / (sum(n) + 1.0) as x from s),
s2 as (select suffix, (k + ks.x * base.x) / (n + ks.x) as s_mean from s, ks, base),
r as (
  select h.host, h.k + kh.x * ((d.k - h.k + kd.x * s_mean) / (d.n - h.n + kd.x)) as a,
    h.n - h.k + kh.x * (1 - (d.k - h.k + kd.x * s_mean) / (d.n - h.n + kd.x)) as b
  from h join d using (domain) join s2 on s2.suffix = d.suffix, kh, kd),
v as (select host, case when a / (a + b) - 1.64 * sqrt(a * b / (a + b + 1)) / (a + b) > 0.3 then 'block' else 'allow' end as by_host from r),
j as (select page_id, p.host, path, {rule} as rule, {verdict} as by_rule, by_host from (select * from p) p join v on v.host = p.host)
select page_id, host, path, rule, coalesce(by_rule, by_host) as verdict from j
""".replace("(host = ", "(p.host = ").replace("suffix(host, ", "suffix(p.host, ")


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _op1_sql(), "op3_warc": OP3_SQL, "op6_chat_format": OP6_SQL, "op10_quality_rules": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_filter_interactions": OP12_SQL}
