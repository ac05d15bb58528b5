"""Replacing entities by labels, pseudonyms or counter tokens, and restoring them.

A request is one row (its field's spans), or many rows that share a key and have an order of fields.  The value
to token map of a row stays in the row: nothing here writes values to a table of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.functions.digests import hmac_sha256
from veilspark.operators import detect

PLACEHOLDER = "<[A-Z][A-Z0-9_]*>"
FORMING = "^<[A-Z0-9_]*$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replaced(text: Column, spans: Column, token: Callable[[Column], Column]) -> Column:
    """The text with every span replaced by its token: each token behind the gap before it, then what is left."""
    before = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), token(s)))
    last = F.get(spans, F.size(spans) - 1)["end"]
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))).otherwise(text)


def replaced_by(text: Column, spans: Column, tokens: Column) -> Column:
    """The text with every span replaced by what the map (value to token) says. Maps and spans are bound before the fold:
    Spark would work out a column that a lambda names anew for each element."""
    return bound(F.struct(spans.alias("s"), tokens.alias("t")), lambda b: replaced(text, b["s"], lambda s: F.element_at(b["t"], s["value"])))


def strip_token(kind: Column) -> Column:
    return F.concat(F.lit("["), kind, F.lit("]"))


def pseudonym_token(kind: Column, value: Column, secret: str) -> Column:
    return F.concat(F.lit("<"), kind, F.lit("_"), F.upper(F.substring(hmac_sha256(secret, value), 1, 8)), F.lit(">"))


def nonce(request: Column, run_secret: str) -> Column:
    """Six hex digits per request, the same when a task is run again; unknown without the run's secret."""
    return F.upper(F.substring(hmac_sha256(run_secret, request.cast("string")), 1, 6))


def in_mint_order(fields: Column) -> Column:
    """Spans of a request's fields (array of arrays) in the order in which tokens are minted: fields in order, and from
    right to left within one."""
    return F.flatten(F.transform(fields, F.reverse))


def token_map(minted: Column, token: Callable[[Column, Column, Column], Column]) -> Column:
    """Value to token, for spans in mint order. ``token`` takes type, value and number, counted for each type from 1;
    a value met twice keeps the type it was met with first.

    Keys are texts (type, NUL, value) because Spark tells texts apart by hash but structs one by one."""
    mark = "\0"
    keys = F.array_distinct(F.transform(minted, lambda s: F.concat(s["type"], F.lit(mark), s["value"])))
    kind = lambda k: F.substring_index(k, mark, 1)
    value = lambda k: F.substring(k, F.instr(k, mark) + 1, F.length(k))

    def firsts(ks: Column) -> Column:
        values = F.transform(ks, value)
        several = F.size(F.array_distinct(values)) < F.size(ks)
        return F.when(several, F.filter(ks, lambda k, i: F.array_position(values, value(k)) == i + 1)).otherwise(ks)

    def entries(ks: Column) -> Column:
        kinds = F.array_distinct(F.transform(ks, kind))
        return F.flatten(F.transform(kinds, lambda t: F.transform(F.filter(ks, lambda k: kind(k) == t), lambda k, i: F.struct(value(k), token(t, value(k), i + 1)))))

    return F.map_from_entries(bound(keys, lambda ks: bound(firsts(ks), entries)))


def counter_token(kind: Column, number: Column, request_nonce: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit("_"), request_nonce, F.lit("_"), number.cast("string"), F.lit(">"))


def vault(spans: Column, request_nonce: Column) -> Column:
    """Value to token of a one-field request."""
    return token_map(F.reverse(spans), lambda kind, _, n: counter_token(kind, n, request_nonce))


def strip(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add ``redacted``: labels, which cannot be undone. A value keeps the label of the type it was minted with."""
    names = token_map(F.reverse(F.col(spans)), lambda kind, *_: strip_token(kind))
    return df.withColumn("redacted", replaced_by(F.col(text), F.col(spans), names))


def pseudonymise(df: DataFrame, secret: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add ``redacted``: the same value gets the same token everywhere, with the type it was minted with first in its row.
    A short secret is refused."""
    if len(secret) < 16:
        raise ValueError("consistent pseudonyms need a secret of at least 16 characters")
    names = token_map(F.reverse(F.col(spans)), lambda kind, value, _: pseudonym_token(kind, value, secret))
    return df.withColumn("redacted", replaced_by(F.col(text), F.col(spans), names))


def tokenise(df: DataFrame, request: str, run_secret: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add ``redacted`` and ``vault`` (value to token); one row is one request."""
    df = df.withColumn("vault", vault(F.col(spans), nonce(F.col(request), run_secret)))
    return df.withColumn("redacted", replaced_by(F.col(text), F.col(spans), F.col("vault")))


def minted(df: DataFrame, request: str, field_order: str, spans: str = "spans") -> DataFrame:
    """Tokens of requests that spread over rows: request, value, type and n, counted per (request, type) over fields
    in order and, within a field, from right to left. Windows are partitioned by request."""
    every = detect.each(df, request, field_order, spans_=spans).select(request, field_order, "s.start", "s.type", "s.value")
    order = F.struct(F.col(field_order), -F.col("start"))
    firsts = every.groupBy(request, "value").agg(F.min_by("type", order).alias("type"), F.min(order).alias("o"))
    return firsts.withColumn("n", F.row_number().over(Window.partitionBy(request, "type").orderBy("o"))).drop("o")


def restore(text: Column, tokens: Column) -> Column:
    """Placeholders that the map (token to value) knows are replaced by their values, others stay. One pass: a value
    that looks like a token is not replaced again."""
    value = lambda b, x: F.coalesce(F.try_element_at(b["tokens"], x), x, F.lit(""))
    # Bound before the fold, or every placeholder would be looked for again at each gap.
    given = F.struct(F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})")).alias("found"), F.split(text, PLACEHOLDER).alias("gaps"), tokens.alias("tokens"))
    joined = bound(given, lambda b: F.array_join(F.transform(b["gaps"], lambda g, i: F.concat(g, value(b, F.get(b["found"], i)))), ""))
    return F.when(F.size(tokens) == 0, text).otherwise(joined)


def resolve_partial(tail: Column, tokens: Column) -> Column:
    """The value whose token begins with ``tail``, if there is exactly one."""
    fits = F.filter(F.map_keys(tokens), lambda k: F.startswith(k, tail))
    return F.when(F.startswith(tail, F.lit("<")) & (F.size(fits) == 1), F.element_at(tokens, F.get(fits, F.lit(0))))


def reply_key(parts: Column, run_secret: str) -> Column:
    """Tells requests apart by what they hold, without giving it away: 32 hex digits of an HMAC over the parts (array of string)."""
    return F.substring(hmac_sha256(run_secret, F.to_json(F.transform(parts, lambda p: F.coalesce(F.sha2(p, 256), F.lit(""))))), 1, 32)


def one_vault(vaults: DataFrame, key: str) -> DataFrame:
    """``key`` and ``tokens``, one row for each key; no tokens where a key has different ones, or is null."""
    text = F.to_json("tokens")
    each = vaults.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(text).alias("a"), F.max(text).alias("b"))
    return each.select(key, F.from_json(F.when(F.col("a") == F.col("b"), F.col("a")), "map<string,string>").alias("tokens"))


def resolve_partials(tails: DataFrame, tokens: DataFrame, request: str, tail: str = "tail", token: str = "token") -> DataFrame:
    """``tails`` with ``value``: that of the one token of the request that begins with the tail; null where none or several do.

    A prefix join by order: a request's tokens that begin with a tail stand right behind it, so one sort of both and the next two
    tokens decide. ``tokens``: request, token, value. Tails that do not begin as a token does, and null ones, stand for nothing; a token
    that is listed twice with one value is one."""
    known = tokens.filter(F.col(request).isNotNull() & F.col(token).isNotNull()).select(request, F.col(token).alias("__text"), F.col("value").alias("__value")).distinct()
    following = F.lead("__text").over(Window.partitionBy(request).orderBy("__text", "__value"))
    known = known.select(request, "__text", F.struct("__text", "__value", following.alias("after")).alias("__token"))
    live = F.col(request).isNotNull() & F.startswith(tail, F.lit("<"))
    given = tails.drop("value").filter(live)
    rows = given.select(request, F.col(tail).alias("__text"), F.struct(*given.columns).alias("__row")).unionByName(known, allowMissingColumns=True)
    # From the last to the first, tokens before tails of the same text: the nearest token seen is the next one in order.
    order = Window.partitionBy(request).orderBy(F.desc("__text"), F.col("__row").isNotNull(), F.desc("__token")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__next", F.last("__token", ignorenulls=True).over(order)).filter("__row is not null")
    fits = lambda t: F.coalesce(F.startswith(t, F.col("__text")), F.lit(False))
    one = fits(F.col("__next.__text")) & ~fits(F.col("__next.after"))
    out = found.select("__row.*", F.when(one, F.col("__next.__value")).alias("value"))
    none = F.lit(None).cast(out.schema["value"].dataType).alias("value")
    return out.unionByName(tails.drop("value").filter(~F.coalesce(live, F.lit(False))).select(*given.columns, none))


def flipped(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def counts(spans: Column) -> Column:
    """Type to number of entities, repeats counted."""
    types = F.transform(spans, lambda s: s["type"])
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)))))


def summary_header(spans: Column) -> Column:
    """``TYPE:n`` of each type in order of first appearance, comma-separated."""
    types = F.transform(spans, lambda s: s["type"])
    return F.array_join(F.transform(F.array_distinct(types), lambda t: F.concat(t, F.lit(":"), F.size(F.filter(types, lambda x: x == t)).cast("string"))), ",")


def response_headers(spans: Column, mode: Column) -> Column:
    """What a reply says about its request: number of entities, types if there are any, and mode."""
    every = F.create_map(F.lit("X-Redacted"), F.size(spans).cast("string"), F.lit("X-Redacted-Types"), summary_header(spans), F.lit("X-Redact-Mode"), mode)
    return F.map_filter(every, lambda _, v: v != "")


def pseudonym_collisions(df: DataFrame, secret: str, spans: str = "spans") -> DataFrame:
    """Tokens that more than one value maps to: type, token, values."""
    each = detect.each(df, spans_=spans).select("s.type", "s.value").distinct()
    return each.groupBy("type", pseudonym_token(F.col("type"), F.col("value"), secret).alias("token")).agg(F.count("*").alias("values")).filter("values > 1")
