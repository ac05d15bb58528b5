"""Exact de-duplication of repeated byte strings by a distributed, sparse suffix array.

A window is a string of ``size`` bytes; it is a repeat if the same bytes start earlier, in a smaller document
or earlier in the same one.  Every byte under a repeat is removed.  Sorting the suffix at every byte would
ship a hundred times the input, so windows are taken in rounds:

1. Each window names one suffix inside it, at a token's start: of the tokens that begin behind the window's first
   byte and have ``k`` bytes before its end, the one with the smallest hash of these bytes (of all places, where
   no token begins).  Equal windows name the same one, and neighbouring windows mostly share one, so a run of
   windows travels as one suffix: its leading 16 bytes, the hash of its ``k`` bytes, the hash of all bytes that
   the run spans (the suffix extended to both sides), and its place.  Equal records are equal in all their
   windows.  A suffix whose ``k`` bytes occur nowhere else has no repeats.  What is left, suffixes with equal
   ``k`` bytes and other bytes around them, goes to the next round.
2. The same with more bytes, over those runs only.
3. In the last round each remaining window is a suffix, cut at ``size`` bytes, and is shipped whole.

In every round splitters, sampled from the suffixes themselves, range-partition them by their leading tokens,
buckets sort locally by multikey quicksort, and equal neighbours are found.  Splitters are whole
keys, so equal records meet in one bucket; suffixes are compared with the splitters at both ends of their bucket,
and what goes on beyond one is kept for the next round, which decides it.  Each task combines what it has seen before the shuffle, so of a string with any
number of copies one record per task travels.

Defined results: a null text is empty; texts under ``size`` bytes are left alone; rows that repeat both doc_id
and text are one document and get one result; rows with one doc_id and other texts are documents in the order
of their texts' hashes; a null doc_id is smaller than all others; an empty table gives an empty one; input
columns that share a name with an added one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.rolling import mix, multikey_order, prefix_sums, range_hash
from veilspark.llm.store import aside, back, cut, parallelism, release

SIZE = 100
ROUNDS = (50, 84)  # lengths of the anchor strings
STEP = 1 << 18  # bytes hashed at once: what fits a core's cache
BUFFER = 1 << 20  # records that a task combines before they are shipped
BUCKET = 1 << 21  # records in a bucket, about
SAMPLE = 50_000  # records sampled for the splitters, about; more where there are more buckets
NULL_ID = -(1 << 63)
ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")

_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOUND = "doc bigint, place bigint, windows int, open boolean"


def _batches(docs: list[int], places: list[list[int]], data: list[list[bytes]]) -> Iterator[tuple]:
    """Segments joined to arrays of about ``STEP`` bytes; longer ones are cut so that every window stays whole."""
    held, size = [], 0
    for doc, ps, ds in zip(docs, places, data, strict=True):
        for p, d in zip(ps, ds, strict=True):
            for at in range(0, len(d) - SIZE + 1, STEP):
                piece = d[at : at + STEP + SIZE - 1]
                held.append((doc, p + at, piece))
                size += len(piece)
                if size >= STEP:
                    yield tuple(zip(*held))
                    held, size = [], 0
    if held:
        yield tuple(zip(*held))


def _layout(part: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, and per window start: its start, segment and place in the document; none crosses segments."""
    docs, places, data = part
    joined = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.array([len(d) for d in data])
    begins = np.cumsum(lengths) - lengths
    segment = np.repeat(np.arange(len(data)), lengths - SIZE + 1)
    starts = np.arange(len(segment)) + segment * (SIZE - 1)
    return joined, starts, segment, starts - begins[segment] + np.array(places, np.int64)[segment]


def anchored_runs(part: tuple, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that name one suffix: its leading bytes in two words, its hash, hash of the run's bytes, document,
    place, windows."""
    joined, starts, segment, place = _layout(part)
    sums = prefix_sums(joined)
    inner = np.arange(len(joined) - k + 1)
    hashes = range_hash(sums, inner, inner + k)
    low, high = _U(4 * STEP - 1), _U(1 << 63)
    space = _IS_SPACE[joined]
    token = np.r_[False, space[:-1] & ~space[1:]][: len(inner)]
    # The least hash of each window and its leftmost place, by doubling; the place stands in the low bits, and the highest
    # one tells places without a token's start, which come last. A window's first byte is left out: what stands before it
    # is not the window's.
    best, span, want = (hashes & ~low & ~high) | np.where(token, _U(0), high) | inner.astype(_U), 1, SIZE - k
    while span * 2 <= want:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < want:
        best = np.minimum(best[: len(best) - (want - span)], best[want - span :])
    anchor = (best[starts + 1] & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])])
    last = np.r_[first[1:], len(anchor)] - 1
    begin, end = starts[first], starts[last] + SIZE
    run = range_hash(sums, begin, end) ^ mix((anchor[first] - begin).astype(_U))
    lead = np.lib.stride_tricks.sliding_window_view(joined, 16)[anchor[first]].copy().view(">u8").astype(_U)
    return lead[:, 0], lead[:, 1], hashes[anchor[first]], run, np.array(part[0], np.int64)[segment[first]], place[first], (last - first + 1).astype(np.int32)


def suffix_words(part: tuple) -> tuple[np.ndarray, ...]:
    """Every window as big-endian words of eight bytes, the last one filled up, with document and place."""
    joined, starts, segment, place = _layout(part)
    width = -(-SIZE // 8) * 8
    rows = np.zeros((len(starts), width), np.uint8)
    rows[:, :SIZE] = np.lib.stride_tricks.sliding_window_view(joined, SIZE)[starts]
    words = rows.view(">u8").astype(_U)
    return (*words.T, np.array(part[0], np.int64)[segment], place, np.ones(len(starts), np.int32))


def _records(k: int | None, part: tuple) -> tuple[np.ndarray, ...]:
    return suffix_words(part) if k is None else anchored_runs(part, k)


def _ordered(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns in the order of key words, document and place; where the key without its last word, and the whole key, begin anew."""
    sign = _U(1 << 63)
    order, news = multikey_order([*columns[:-3], columns[-3].view(_U) ^ sign, columns[-2].view(_U)])
    return [c[order] for c in columns], news[len(columns) - 5], news[len(columns) - 4]


def _pack(columns: list[np.ndarray]) -> bytes:
    """Arrays one after another; documents and places as differences, which the shuffle's compression shortens."""
    *keys, doc, place, windows = columns
    return b"".join(np.ascontiguousarray(c).tobytes() for c in [*keys, np.diff(doc, prepend=0), np.diff(place, prepend=0), windows.astype(np.uint8)])


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    keys = (len(data) // n - 17) // 8 if n else 0
    at = lambda i, t, size: np.frombuffer(data, t, n, i)
    out = [at(8 * n * i, _U, 8) for i in range(keys)]
    doc, place = (np.cumsum(at(8 * n * (keys + i), np.int64, 8)) for i in range(2))
    return [*out, doc, place, at(8 * n * (keys + 2), np.uint8, 1).astype(np.int32)]


def _bucket_of(keys: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """How many splitters are not above each row's key; ``splitters`` has one row per splitter."""
    if not len(splitters):
        return np.zeros(len(keys[0]), np.int64)
    first = splitters[:, 0]
    low, high = np.searchsorted(first, keys[0], "left"), np.searchsorted(first, keys[0], "right")
    shared = np.flatnonzero(low < high)  # rows that share their first word with a splitter are compared by whole keys, as bytes
    whole = lambda words: np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * len(keys)}")[:, 0]
    if len(shared):
        low[shared] = np.searchsorted(whole(splitters), whole(np.stack([k[shared] for k in keys], axis=1)), "right")
    return low


def _ship(k: int | None, splitters: np.ndarray, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, turn = 0, 0

        def flush() -> pa.RecordBatch:
            columns, _, new = _ordered([np.concatenate(c) for c in zip(*held, strict=True)])
            rows = []
            seen = [c[~new] for c in columns]  # the same key stands earlier in this task
            if len(seen[0]):
                rows.append((turn % n_buckets, True, len(seen[0]), _pack([*seen[:0], *seen[-3:]])))
            columns = [c[new] for c in columns]
            bucket = _bucket_of(columns[:-3], splitters)
            order = np.lexsort((columns[-2], columns[-3], bucket))
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
            for a, b in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
                rows.append((int(bucket[order[a]]), False, int(b - a), _pack([c[order[a:b]] for c in columns])))
            types = (pa.int32(), pa.bool_(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "seen", "n", "data"])

        for batch in batches:
            for part in _batches(*(c.to_pylist() for c in batch.columns)):
                held.append(_records(k, part))
                size += len(held[-1][0])
                if size >= (BUFFER if k else BUFFER // 8):
                    yield flush()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield flush()

    return run


def _found(columns: list[np.ndarray], open_: bool) -> pa.RecordBatch:
    doc, place, windows = columns[-3:]
    arrays = [pa.array(doc), pa.array(place), pa.array(windows), pa.array(np.full(len(doc), open_))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "place", "windows", "open"])


def _resolve(k: int | None, splitters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for bucket, seen, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen:
                    yield _found(_unpack(data, n), False)
                else:
                    held.setdefault(bucket, []).append(_unpack(data, n))
        while held:
            bucket, parts = held.popitem()
            columns, new_first, new = _ordered([np.concatenate(c) for c in zip(*parts, strict=True)])
            del parts
            yield _found([c[~new] for c in columns], False)
            if k is not None:
                group = np.cumsum(new_first) - 1
                several = np.bincount(group, weights=new)[group] > 1
                for edge in splitters[max(bucket - 1, 0) : bucket + 1]:  # these suffixes may go on in the next bucket
                    several |= np.logical_and.reduce([c == e for c, e in zip(columns, edge[:-1])])
                yield _found([c[new & several] for c in columns], True)

    return run


def _sampled(k: int | None, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for part in _batches(*(c.to_pylist() for c in batch.columns)):
                keys = np.stack(_records(k, part)[:-3], axis=1)
                picked = keys[-at % every :: every]
                at += len(keys)
                if len(picked):
                    yield pa.RecordBatch.from_arrays([pa.array([r.astype(">u8").tobytes() for r in picked], pa.binary())], names=["key"])

    return run


def _round(segments: DataFrame, k: int | None, n_bytes: int, name: str) -> DataFrame:
    """``segments``: doc, places, data. The repeats found, and the runs that stay open."""
    spark = segments.sparkSession
    density = 1.0 if k is None else 2 / (SIZE - k + 2)
    n_buckets = max(parallelism(spark), int(n_bytes * density / BUCKET))
    share = max(1, n_bytes // (64 << 20))
    every = max(1, int(n_bytes / share * density / max(SAMPLE, 4 * n_buckets)))
    sample = segments.filter(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0).mapInArrow(_sampled(k, every), "key binary")
    keys = sorted(bytes(r["key"]) for r in sample.collect())  # about SAMPLE keys, or four for each of many buckets
    picked = sorted({keys[len(keys) * i // n_buckets] for i in range(1, n_buckets)}) if keys else []
    splitters = np.array([np.frombuffer(p, ">u8") for p in picked], _U) if picked else np.zeros((0, 1), _U)
    shipped = segments.mapInArrow(_ship(k, splitters, n_buckets), "bucket int, seen boolean, n bigint, data binary")
    return cut(shipped.repartitionById(n_buckets, F.col("bucket")).mapInArrow(_resolve(k, splitters), _FOUND), name)


def _narrowed(segments: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The bytes of the open runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for doc, places, data, runs in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    ps, ds, begins = [], [], np.array(places)
                    for r in sorted(runs, key=lambda r: r["place"]):
                        i = int(np.searchsorted(begins, r["place"], "right")) - 1
                        a = r["place"] - places[i]
                        ps.append(r["place"])
                        ds.append(data[i][a : a + r["windows"] + SIZE - 1])
                    out.append((doc, ps, ds))
                if out:
                    types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc", "places", "data"])

    runs = found.filter("open").groupBy("doc").agg(F.collect_list(F.struct("place", "windows")).alias("runs"))
    joined = segments.join(runs, "doc")
    return cut(joined.select("doc", "places", "data", "runs").mapInArrow(run, "doc bigint, places array<bigint>, data array<binary>"), name)


def _numbered(docs: DataFrame, text: str) -> tuple[DataFrame, bool]:
    """Add __doc, the number of a doc_id with a text: the doc_id itself unless one has several texts. Numbers are in the order of
    doc_ids, and are dealt out by a sort of all, so no id's texts meet in one task. Do doc_ids repeat?"""
    d = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    whole = F.coalesce(F.col(text), F.lit(""))
    marks = d.select("__doc", F.xxhash64(whole).alias("__mark")).groupBy("__doc")
    marks = marks.agg(F.min("__mark").alias("a"), F.max("__mark").alias("b"), F.count("*").alias("n")).filter("n > 1")
    repeated = marks.agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("several")).first()
    if not repeated["several"]:
        return d, bool(repeated["n"])
    d = d.withColumn("__mark", F.unhex(F.sha2(whole, 256)))
    numbers = d.select("__doc", "__mark").distinct().orderBy("__doc", "__mark").withColumn("__number", F.monotonically_increasing_id())
    numbers = cut(numbers, "numbers")
    return cut(d.join(numbers, ["__doc", "__mark"]).drop("__doc", "__mark").withColumnRenamed("__number", "__doc"), "numbered"), True


def find_repeats(docs: DataFrame, text: str = "text", repeated: bool = False) -> DataFrame:
    """doc, place, windows: runs of windows that start earlier elsewhere; ``docs`` as ``_numbered`` gives them."""
    spark = docs.sparkSession
    docs = docs.dropDuplicates(["__doc"]) if repeated else docs
    data: Column = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    segments = docs.select(F.col("__doc").alias("doc"), F.array(F.lit(0).cast("long")).alias("places"), F.array(data).alias("data"))
    segments = segments.filter(F.octet_length(text) >= SIZE)
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    results = []
    for i, k in enumerate((*ROUNDS, None)):
        found = _round(segments, k, n_bytes, f"repeats-{i}")
        results.append(found.filter("not open"))
        if k is None:
            break
        release(spark)
        segments = _narrowed(segments, found, f"open-{i}")
        n_bytes = segments.agg(F.sum(F.aggregate("data", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
        release(spark)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("doc", "place", "windows")


def _spans(runs: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal removed stretches."""
    out: list[list[int]] = []
    for a, b in sorted((r["place"], r["place"] + r["windows"] + SIZE - 1) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans drawn in to the characters that they cover whole, so that the rest is valid UTF-8."""
    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def dedup(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with ``ADDED``: the length, what was removed, the digest of the bytes left and, if asked for, the
    text left (where a cut falls inside a character, the whole character stays)."""
    docs = docs.drop(*[c for c in ADDED if c in docs.columns])
    numbered, repeated = _numbered(docs, text)
    found = find_repeats(numbered, text, repeated)
    runs = found.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("place", "windows")).alias("__runs"))
    joined = numbered.join(runs, "__doc", "left").drop("__doc")
    kept = [f for f in joined.schema.fields if f.name != "__runs" and (with_text or f.name != text)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for t, found_runs in zip(part.column(text).to_pylist(), part.column("__runs").to_pylist(), strict=True):
                    data = (t or "").encode()
                    spans = _spans(found_runs or [], len(data))
                    left = _without(data, spans)
                    row = (len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest())
                    rows.append((*row, _without(data, _whole_characters(data, spans)).decode() if spans else t) if with_text else row)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                added = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *added], names=[*names, *ADDED[: len(added)]])

    added = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept_text string" if with_text else "")
    schema = joined.select(*names).schema
    for field in docs.sparkSession.createDataFrame([], added).schema:
        schema = schema.add(field)
    return joined.select(*dict.fromkeys([*names, text, "__runs"])).mapInArrow(run, schema)


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the text that is left, ``n_chars`` brought up to date, with the columns of the input."""
    out = dedup(aside(docs, ADDED), text).withColumn(text, F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return back(out, docs)
