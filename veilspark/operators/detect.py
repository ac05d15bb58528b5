"""Detection of entities in a text column.

The plain path is one Spark expression.  Each pattern's matches are enclosed in two private-use marks by one
``regexp_replace``; only texts that got marks are split, and the lengths of the pieces give the offsets.
Matches run left to right without overlap and a match that its validator rejects is consumed.  Candidates of
all patterns are put in order of priority, length and start and taken greedily unless they overlap one taken
before.  Offsets count code points.

Texts with characters that compatibility normalisation changes, zero-width characters or the marks
themselves, and texts over ``LONG`` characters, whose matches the expression's folds would copy too often, go
through an Arrow function instead: it detects on a normalised copy and maps offsets back.  The plan sends it
null for all other rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.checks import CHECKS
from veilspark.functions.digests import SETS
from veilspark.functions.patterns import NINE, Catalog, Pattern

OPEN, CLOSE = "\ue000", "\ue001"
SPAN = "start int, end int, type string, value string"
_SPANS = "array<struct<start:int,end:int,type:string,value:string>>"
_CANDIDATES = "array<struct<rank:int,size:int,start:int,ord:int,end:int,type:string,value:string>>"
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
LONG = 1 << 17


def _changed() -> str:
    """A character class of what detection does not see as it stands: changed by normalisation, zero-width, or a mark."""
    odd = [i for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.normalize("NFKC", chr(i)) != chr(i)]
    odd = sorted({*odd, *map(ord, ZERO_WIDTH + OPEN + CLOSE)})
    firsts = [x for x, before in zip(odd, [None, *odd]) if before is None or x != before + 1]
    lasts = [x for x, after in zip(odd, [*odd[1:], None]) if after is None or x != after - 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(firsts, lasts))


#: Ordinary text of any script has none; ASCII and Latin letters with marks are passed over before the class is looked at.
CHANGED = f"(?=[^\x00-\x7f\u00c0-\u00ff])[{_changed()}]"
_CHANGED = re.compile(CHANGED)

#: Detectors added by name: text -> list of (start, end, type, value).
DETECTORS: dict[str, Callable[[str], list[tuple[int, int, str, str]]]] = {}


def failing(text: str) -> list[tuple[int, int, str, str]]:
    """For tests of the error policy: a detector that fails on texts that ask for it."""
    if "force-detector-failure" in text:
        raise RuntimeError("forced")
    return []


def register_detector(name: str, detect: Callable[[str], list[tuple[int, int, str, str]]]) -> None:
    DETECTORS[name] = detect


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body`` of a function that folds what stands before a place of an array (not empty, of int), in two steps of 64: a fold that
    collects its results would copy them at each step."""
    block = lambda b: F.slice(values, b * 64 + 1, F.lit(64))
    sums = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(values) - 1, 6)), lambda b: F.aggregate(block(b), zero, op))
    starts = F.aggregate(sums, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
    before = lambda known, i: F.aggregate(F.slice(values, F.shiftright(i, 6) * 64 + 1, i.bitwiseAND(63)), F.get(known, F.shiftright(i, 6)), op)
    return bind(starts, lambda known: body(lambda i: before(known, i)))


def scan(text: Column, digits: Column, pattern: Pattern, ordinal: int, rank: int, gate: Column | None = None) -> Column:
    """What one pattern finds: its place and precedence, and the text in pieces of which every second is a match; null if there
    is none. ``digits``: does the text hold ``one``, and ``nine`` close together; ``gate``: is the pattern looked for in this row."""
    possible = digits["nine"] if pattern.nine else digits["one"] if pattern.digit else None
    if pattern.needs:
        some = reduce(or_, [F.contains(text, F.lit(x)) for x in pattern.needs])  # on the bytes, which a regex would decode first
        possible = some if possible is None else possible & some
    if gate is not None:  # last, for it costs more than the others
        possible = gate if possible is None else possible & gate
    marked = F.regexp_replace(text, pattern.marked(), f"$1{OPEN}$2{CLOSE}")
    split = F.split(F.when(possible, marked) if possible is not None else marked, f"[{OPEN}{CLOSE}]")
    return F.struct(F.lit(-rank).alias("rank"), F.lit(ordinal).alias("ord"), F.lit(pattern.type).alias("type"), split.alias("pieces"))


def candidates(scans: Sequence[Column], active: Sequence[tuple[int, Pattern]]) -> Column:
    """Valid matches of all scans. What a scan leads to stands once in the plan, whatever the number of patterns."""

    def items(one: Column) -> Column:
        """Offsets are running sums of the pieces' lengths."""

        def item(start: Column, x: Column) -> Column:
            return F.struct(one["rank"].alias("rank"), (-F.length(x)).alias("size"), start.alias("start"), one["ord"].alias("ord"), (start + F.length(x)).alias("end"), one["type"].alias("type"), x.alias("value"))

        def listed(before: Callable[[Column], Column]) -> Column:
            numbers = F.sequence(F.lit(0), F.shiftright(F.size(one["pieces"]) - 1, 1) - 1)
            return F.transform(numbers, lambda k: item(before(k * 2 + 1), F.get(one["pieces"], k * 2 + 1)))

        return bind(F.transform(one["pieces"], lambda x: F.length(x)), lambda sizes: running(sizes, F.lit(0), lambda a, x: a + x, listed))

    def valid(c: Column) -> Column:
        out = c["value"] != ""
        for check in {p.check: None for _, p in active if p.check}:
            of = [i for i, p in active if p.check == check]
            out = out & F.when(c["ord"].isin(of), CHECKS[check][0](c["value"])).otherwise(True)
        return out

    found = F.filter(F.array(*scans), lambda s: F.size(s["pieces"]) > 1)
    return bind(found, lambda f: F.when(F.size(f) > 0, F.filter(F.flatten(F.transform(f, items)), valid)).otherwise(F.array().cast(_CANDIDATES)))


def _greedy(found: Column) -> Column:
    """Choice by precedence among candidates that may all overlap."""
    clash = lambda a, c: (a["start"] < c["end"]) & (c["start"] < a["end"])
    return F.aggregate(
        F.array_sort(found),
        F.array().cast(_CANDIDATES),
        lambda acc, c: F.when(F.exists(acc, lambda a: clash(a, c)), acc).otherwise(F.concat(acc, F.array(c))),
    )


def resolve(found: Column) -> Column:
    """Greedy choice by precedence; the spans taken, by start.

    In order of starts, a candidate that begins behind all before it opens a new cluster; only those of one cluster are
    compared with each other.  So the work grows with the candidates, not with their square."""

    def clusters(cs: Column) -> Column:
        def firsts(before: Callable[[Column], Column]) -> Column:
            return F.filter(F.sequence(F.lit(0), F.size(cs) - 1), lambda i: F.get(cs, i)["start"] >= before(i))

        at = bind(F.transform(cs, lambda c: c["end"]), lambda ends: running(ends, F.lit(0), lambda a, x: F.greatest(a, x), firsts))
        ends = lambda starts, k: F.coalesce(F.get(starts, k + 1), F.size(cs))
        return bind(at, lambda starts: F.transform(starts, lambda i, k: F.slice(cs, i + 1, ends(starts, k) - i)))

    by_start = F.transform(F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), c.alias("c")))), lambda x: x["c"])
    chosen = F.flatten(F.transform(bind(by_start, clusters), lambda held: F.when(F.size(held) < 2, held).otherwise(_greedy(held))))
    spans = lambda taken: F.transform(taken, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["type"].alias("type"), c["value"].alias("value")))
    return F.when(F.size(found) > 1, F.array_sort(spans(chosen))).when(F.size(found) == 1, spans(found)).otherwise(F.array().cast(_SPANS))


def normalised(text: str) -> tuple[str, list[int]]:
    """Zero-width characters dropped, each code point normalised by itself; where each character came from."""
    if not _CHANGED.search(text):
        return text, list(range(len(text) + 1))
    out, origin = [], []
    for i, c in enumerate(text):
        if c not in ZERO_WIDTH:
            n = unicodedata.normalize("NFKC", c)
            out.append(n)
            origin += [i] * len(n)
    return "".join(out), [*origin, len(text)]


def _matches(pattern: Pattern, text: str, strict: bool) -> Iterator[re.Match]:
    """Valid matches; a rejected one is consumed or, if ``strict``, tried with earlier ends and then behind its first character."""
    regex, at = re.compile(pattern.marked(), re.ASCII), 0  # case is folded as in the plain path: ASCII letters only
    valid = lambda m: bool(m[2]) and (pattern.check is None or CHECKS[pattern.check][1](m[2]))
    while m := regex.search(text, at):
        good = valid(m)
        if strict and not good:
            for end in range(m.end() - 1, m.start(), -1):
                if not re.match("[A-Za-z0-9_]", text[end]) and (shorter := regex.match(text, m.start(), end)) and shorter.end() == end and valid(shorter):
                    m, good = shorter, True
                    break
        if good:
            yield m
        at = m.start() + 1 if (strict and not good) or m.end() == m.start() else m.end()


def py_detect(text: str, catalog: Catalog, sets: Sequence[str], detectors: Sequence[Callable] = (), strict: bool = False) -> list[tuple[int, int, str, str]]:
    """The same detection in Python, with normalisation; the twin that tests hold the expression against."""
    plain, origin = normalised(text)
    found = []
    for ordinal, p in catalog.active(tuple(sets)):
        if p.needs and not any(x in plain for x in p.needs):
            continue
        for m in _matches(p, plain, strict):
            found.append((-catalog.priority(p.type), m.start(2) - m.end(2), m.start(2), ordinal, m.end(2), p.type))
    for more in detectors:
        found += [(-catalog.priority(t), a - b, a, len(catalog.patterns), b, t) for a, b, t, _ in more(plain) if a < b]
    taken: list[tuple[int, int, str]] = []  # by start and free of overlaps, so only the neighbours can clash
    for c in sorted(found):
        at = bisect_left(taken, (c[2], c[4]))
        if (at == 0 or taken[at - 1][1] <= c[2]) and (at == len(taken) or c[4] <= taken[at][0]):
            insort(taken, (c[2], c[4], c[5]))
    spans = [(origin[a], origin[b], t) for a, b, t in taken]
    return [(a, b, t, text[a:b]) for a, b, t in spans]


def native_candidates(t: Column, sets: tuple[str, ...], catalog: Catalog, active: Column | None = None) -> Column:
    """Valid matches of the patterns of some sets in a text that needs no normalisation."""
    gate = lambda p: None if active is None else F.arrays_overlap(F.array(*map(F.lit, p.sets)), active)
    chosen = catalog.active(sets)
    one = t.rlike("[0-9]")
    digits = F.struct(one.alias("one"), (one & t.rlike(NINE)).alias("nine"))
    return bind(digits, lambda held: candidates([scan(t, held, p, i, catalog.priority(p.type), gate(p)) for i, p in chosen], chosen))


def _native(t: Column, sets: tuple[str, ...], catalog: Catalog, active: Column | None) -> Column:
    """Spans of a text that needs no normalisation."""
    return bind(native_candidates(t, sets, catalog, active), resolve) if catalog.active(sets) else F.array().cast(_SPANS)


def _plain(t: Column) -> Column:
    return (F.length(t) <= LONG) & ~(t.rlike("[^\\x00-\\x7f\\xc0-\\xff]") & t.rlike(CHANGED))


def _allowed(sets: tuple[str, ...], given: Sequence[str] | None) -> list[str]:
    return list(sets) if given is None else [x for x in sets if x in set(given)]


def spans(
    text: Column, sets: Sequence[str] = SETS, catalog: Catalog | None = None, detectors: Sequence[str] = (), active: Column | None = None, strict: bool = False
) -> Column:
    """Entities of a text: array of start, end, type and value. ``active`` narrows ``sets`` row by row, before overlaps are
    resolved. ``detectors`` names registered ones; they, and ``strict`` (a match that its validator rejects
    hides no shorter or later one), send every row to Python."""
    catalog, sets = catalog or Catalog(), tuple(sets)
    t = F.coalesce(text, F.lit(""))
    plugged = [DETECTORS[name] for name in detectors]  # the workers do not have this process's registry

    def twin(texts: pd.Series, given: pd.Series) -> pd.Series:
        rows = zip(texts, given, strict=True)
        return pd.Series([None if x is None else py_detect(x, catalog, _allowed(sets, g), plugged, strict) for x, g in rows])

    arrow = F.pandas_udf(twin, _SPANS)
    given = F.lit(None).cast("array<string>") if active is None else active
    if detectors or strict:
        return arrow(t, given)
    plain = _plain(t)
    return F.coalesce(arrow(F.when(~plain, t), given), F.when(plain, _native(t, sets, catalog, active)))


def spans_alone(text: Column, sets: Sequence[str] = SETS, catalog: Catalog | None = None) -> Column:
    """What each set finds when it is active alone: array of ``set_name`` and ``spans``. Every pattern is looked for once; only
    overlaps are resolved set by set."""
    catalog, sets = catalog or Catalog(), tuple(sets)
    t = F.coalesce(text, F.lit(""))

    def twin(texts: pd.Series) -> pd.Series:
        names = ("start", "end", "type", "value")
        alone = lambda x: [{"set_name": n, "spans": [dict(zip(names, s)) for s in py_detect(x, catalog, (n,))]} for n in sets]
        return pd.Series([None if x is None else alone(x) for x in texts])

    def native(found: Column) -> Column:
        ords = {n: [i for i, _ in catalog.active((n,))] for n in sets}
        own = lambda n: F.filter(found, lambda c: c["ord"].isin(ords[n]))
        return F.array(*[F.struct(F.lit(n).alias("set_name"), bind(own(n), resolve).alias("spans")) for n in sets])

    plain = _plain(t)
    arrow = F.pandas_udf(twin, f"array<struct<set_name:string,spans:{_SPANS}>>")
    return F.coalesce(arrow(F.when(~plain, t)), F.when(plain, bind(native_candidates(t, sets, catalog), native)))


def field_spans(
    texts: Column, sets: Sequence[str] = SETS, catalog: Catalog | None = None, detectors: Sequence[str] = (), active: Column | None = None, strict: bool = False
) -> Column:
    """Entities of several texts of a row (array of string): struct of ``error`` and ``spans``, an array for each text.
    A detector that raises gives the error's name and no spans. ``strict`` as in ``spans``."""
    catalog, sets = catalog or Catalog(), tuple(sets)
    plugged = [DETECTORS[name] for name in detectors]

    def twin(lists: pd.Series, given: pd.Series) -> pd.DataFrame:
        rows = []
        for each, g in zip(lists, given, strict=True):
            try:
                names = ("start", "end", "type", "value")
                found = None if each is None else [[dict(zip(names, s)) for s in py_detect(x or "", catalog, _allowed(sets, g), plugged, strict)] for x in each]
                rows.append((None, found))
            except Exception as e:  # whatever a detector raises must not let a text through
                rows.append((type(e).__name__, []))
        return pd.DataFrame(rows, columns=["error", "spans"])

    twin.__annotations__ = {"lists": pd.Series, "given": pd.Series, "return": pd.DataFrame}
    arrow = F.pandas_udf(twin, f"struct<error:string,spans:array<{_SPANS}>>")
    given = F.lit(None).cast("array<string>") if active is None else active
    if detectors or strict:
        return arrow(texts, given)
    plain = F.forall(texts, lambda t: _plain(F.coalesce(t, F.lit(""))))
    native = F.transform(texts, lambda t: _native(F.coalesce(t, F.lit("")), sets, catalog, active))
    sent = arrow(F.when(~plain, texts), given)
    return F.struct(sent["error"].alias("error"), F.coalesce(F.when(plain, native), sent["spans"]).alias("spans"))


def detect(df: DataFrame, text: str = "text", sets: Sequence[str] = SETS, **options) -> DataFrame:
    """Add ``spans``."""
    return df.withColumn("spans", spans(F.col(text), sets, **options))


def each(df: DataFrame, *keep: str | Column, spans_: str | Column = "spans") -> DataFrame:
    """``keep`` and ``s``, one row for each span. Of a plain explode Spark infers a filter by the array's size, pushes it below every
    step, spread ones too, and finds all spans there once more for each condition; of an outer one it infers none."""
    return df.select(*keep, F.explode_outer(spans_).alias("s")).filter("s is not null")


def tally(df: DataFrame, spans_: str = "spans") -> DataFrame:
    """Entities by type over the whole table: partial counts before the shuffle."""
    return each(df, spans_=spans_).groupBy(F.col("s.type").alias("type")).agg(F.count("*").alias("n"))
