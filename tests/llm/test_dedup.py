"""Suffix and near-duplicate operators against brute force."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.llm import components, neardup, suffixes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_repeats(rows):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), from all windows."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest())
    return out


def repeats(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffixes_match_brute_force_on_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert repeats(suffixes.dedup(docs, with_text=False)) == brute_repeats([tuple(r) for r in docs.collect()])


def test_suffixes_on_edge_cases(spark):
    line = "A passage that is shared by many documents and is a good deal longer than one hundred bytes, so that it counts. "
    short = "Words of a common line, under a hundred bytes."
    rows = [
        (1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 1000), (6, "ab" * 400_000), (7, line), (8, "front " + line + "back"),
        (9, line[5:] + line), (10, "é" * 300), (11, "é" * 60), (12, "y" + "é" * 60), (13, "\0" * 150 + "a"), (14, "\0" * 150),
    ]
    rows += [(20 + i, f"{i * 7919} {short} {i * 104729} tail of number {i * i} and words that differ {i * 31} times") for i in range(60)]
    rows += [(100 + i, f"{line}{i % 3}" + "common end of the text, long enough to be of use to someone who looks for repeats in it, at last." * (i % 2)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = suffixes.dedup(docs)
    assert repeats(out) == brute_repeats(rows)


def test_suffixes_with_repeated_rows_null_ids_and_clashing_columns(spark):
    text = "The same long text, which is repeated under several numbers and twice under one of them, over one hundred bytes."
    rows = [(5, text, 1), (5, text, 2), (5, text + " Other end.", 3), (None, text, 4), (9, text, 5)]
    out = suffixes.dedup(spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes bigint")).collect()
    by = Counter((r.doc_id, r.n_removed == r.n_bytes) for r in out)
    assert by == {(None, False): 1, (5, True): 2, (5, False): 1, (9, True): 1}
    assert suffixes.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_suffixes_keep_columns_of_the_same_names(spark):
    line = "A passage that is shared by many documents and is a good deal longer than one hundred bytes, so that it counts. "
    rows = [(1, line + "a", "n1", "k1", 0), (2, "b " + line, "n2", "k2", 0), (3, None, "n3", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes string, kept_text string, n_chars int")
    kept = suffixes.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, line + "a", "n1", "k1", len(line) + 1), (2, "b ", "n2", "k2", 2), (3, None, "n3", None, None)]


def test_suffixes_number_many_texts_of_one_id(spark):
    """Texts without ids are earlier than all others, and each is numbered by itself, in order and by several tasks."""
    line = "A passage that is shared by many documents and is a good deal longer than one hundred bytes, so that it counts. "
    rows = [(None, f"text {i} " + line * (i % 50 == 0)) for i in range(3000)] + [(7, "front " + line)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered, repeated = suffixes._numbered(docs, "text")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert repeated and numbered.select("__doc").distinct().count() == len(rows)
    assert len({r["__doc"] >> 33 for r in numbered.select("__doc").collect()}) > 1
    assert numbered.orderBy(F.desc("__doc")).first().doc_id == 7
    out = suffixes.dedup(docs).collect()
    assert Counter(r.n_removed > 0 for r in out) == {True: 60, False: 2941}
    assert next(r for r in out if r.doc_id == 7).kept_text == "front"


def test_kept_text_is_cut_at_characters(spark):
    rows = [(1, "é" * 80), (2, "xé" + "é" * 70 + "y")]
    out = suffixes.keep(spark.createDataFrame([(i, t, "fr", "s", len(t)) for i, t in rows], DOCS)).collect()
    assert all(r.text.encode().decode() == r.text and r.n_chars == len(r.text) for r in out)


def weights(text):
    w = [x for x in text.split() if x]
    n = 5 if len(w) >= 5 else len(w)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def probability_jaccard(a, b):
    if not a or not b:
        return float(a == b)
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def brute_classes(rows, threshold=0.8):
    w = {i: weights(t or "") for i, t in rows}
    root = {i: i for i in w}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(w)
    by = {}
    for i in ids:
        for g in w[i]:
            by.setdefault(g, []).append(i)
    pairs = {(a, b) for g in by.values() for a in g for b in g if a < b} | {(a, b) for a in ids for b in ids if a < b and not w[a] and not w[b]}
    for a, b in pairs:
        if probability_jaccard(w[a], w[b]) >= threshold - 1e-12:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def found_classes(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_near_duplicates_match_brute_force_on_a_table(spark, small):
    docs = spark.read.parquet(f"{small}/../sf0.01/documents.parquet").select("doc_id", "text")
    assert found_classes(neardup.classes(docs)) == brute_classes([tuple(r) for r in docs.collect()])


def edited(words, i):
    """One word in forty changed, differently for each i."""
    return " ".join(f"{w}{i}" if (k * 7 + i * 13) % 41 == 0 else w for k, w in enumerate(words))


def test_near_duplicates_of_groups_short_and_empty_texts(spark):
    words = [f"w{k * k % 997}x{k}" for k in range(300)]
    rows = [(i, edited(words, i)) for i in range(3, 40)] + [(50, " ".join(words)), (51, None), (52, " \n"), (53, "one two"), (54, "one  two"), (55, "one two three")]
    rows += [(60, " ".join(words[:150] + ["other"] * 150)), (61, "lala " * 5000), (62, "lala " * 5001)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert found_classes(neardup.classes(docs)) == brute_classes(rows)


def test_near_duplicates_keep_one_row(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(7, text, "en", "a", 1), (3, text, "en", "b", 1), (3, text, "en", "b", 1), (None, "alone and on its own", "en", "c", 1), (9, "x y z", None, None, None)]
    kept = neardup.keep(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 9, None]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = neardup.classes(spark.createDataFrame([], DOCS + ", class_id string"))
    assert empty.count() == 0 and empty.columns[-3:] == list(neardup.ADDED)


def test_near_duplicates_beside_columns_of_any_name(spark):
    words = " ".join(f"w{i}" for i in range(60))
    names = ("root", "key", "node", "doc", "bands", "sign", "n_links", "is_first", "x", "m")
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate((words, words + " more", "something else", None))]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    out = {r.doc_id: r for r in neardup.classes(docs).collect()}
    assert [out[i].class_id for i in range(4)] == [0, 0, 2, 3] and [out[i].root for i in range(4)] == [f"root{i}" for i in range(4)] and out[1].key == "key1"
    kept = neardup.keep(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted([r for r in rows if r[0] != 1], key=lambda r: r[0])


def test_links_of_pairs_that_share_hot_buckets_only(spark):
    template = [f"t{k}" for k in range(160)]
    rows = [(i, " ".join(template + [f"o{i}x{k}" for k in range(26)])) for i in range(30)]
    rows += [(i, " ".join(template + [f"b{k}" for k in range(6)] + [f"o{i}x{k}" for k in range(20)])) for i in (100, 101)]
    assert probability_jaccard(weights(rows[-1][1]), weights(rows[-2][1])) >= 0.8 > probability_jaccard(weights(rows[-1][1]), weights(rows[0][1]))
    whole = next(neardup._sign(25, 5)(iter([pa.RecordBatch.from_pydict({"doc": [i for i, _ in rows], "text": [t for _, t in rows]})])))
    signs = dict(zip(whole.column("doc").to_pylist(), whole.column("sign").to_pylist()))
    signed = spark.createDataFrame([(i, [1, 2, 3] if i < 100 else [1, 1000 + i, 2000 + i], signs[i]) for i, _ in rows], "node bigint, bands array<bigint>, sign binary")
    docs = spark.createDataFrame(rows, "doc bigint, text string")
    found = neardup.links(docs, signed, docs["text"], 0.8).collect()
    assert {(r.a, r.b) for r in found} == {(101, 100)}


def components_of_cube(seen, bits):
    """The least number that steps of one passage lead to; two passages are 0.66 and too far."""
    met, todo = {bits}, [bits]
    while todo:
        at = todo.pop()
        steps = [(*at[:k], not at[k], *at[k + 1 :]) for k in range(len(at))]
        new = [b for b in steps if b in seen and b not in met]
        met.update(new)
        todo += new
    return min(seen[b] for b in met)


def test_near_duplicates_combined_from_passages_match_brute_force(spark):
    """Chains of texts that are linked to the next one only, all of them in buckets with many others."""
    import random

    draw, seen = random.Random(7), {}
    for _ in range(16):
        bits = [draw.random() < 0.5 for _ in range(14)]
        for _ in range(20):
            seen.setdefault(tuple(bits), len(seen))
            bits[draw.randrange(14)] ^= True
    rows = [(i, " ".join(f"{'xy'[b]}{k}w{n}" for k, b in enumerate(bits) for n in range(10))) for bits, i in seen.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    near = [components_of_cube(seen, bits) for bits in seen]
    assert found_classes(neardup.classes(docs)) == dict(enumerate(near))


def test_near_duplicates_keep_different_texts_of_one_doc_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (9, b), (None, c), (None, c), (None, d), (7, d), (8, "alone"), (8, None), (8, "alone ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text and r.text.strip()) for r in neardup.keep(docs).collect()), key=str)
    assert kept == sorted([(3, a), (5, b), (None, c), (None, d), (8, "alone"), (8, None)], key=str)
    out = {(r.doc_id, r.text): (r.class_id, r.is_first) for r in neardup.classes(docs).collect()}
    assert out[5, a] == (3, False) and out[5, b] == (5, True) and out[9, b] == (5, False) and out[7, d] == (None, False)


def test_signatures_estimate_probability_jaccard():
    import numpy as np

    a = Counter({i: 1 + i % 4 for i in range(200)})
    b = Counter({i: 1 + (i + i // 50) % 4 for i in range(40, 240)})
    name = lambda i: np.uint64(i * 2654435761 + 12345)
    owner = np.array([0] * len(a) + [1] * len(b))
    hashes = np.array([name(i) for i in (*a, *b)])
    s = neardup.prob_minhash(2, owner, hashes, np.array([*a.values(), *b.values()]), 4000)
    exact = probability_jaccard(a, b)
    assert abs((s[0] == s[1]).mean() - exact) < 0.03
    part = lambda x: (np.sort(np.array([name(i) for i in x])), np.array([x[i] for i in sorted(x, key=name)]))
    assert neardup.probability_jaccard(part(a), part(b)) == pytest.approx(exact)


@pytest.mark.parametrize("prints", [0, 1024])
def test_near_copies_beside_the_threshold_match_brute_force(spark, prints, monkeypatch):
    """A ring of copies of one text, each with a tenth of its words changed; small quotas and blocks make for many rounds."""
    import random

    monkeypatch.setattr(neardup, "QUOTA", 1)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "SPREAD", 4)
    monkeypatch.setattr(neardup, "PRINTS", prints)
    draw, words = random.Random(5), 60
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(50):
        text = list(base)
        for k in draw.sample(range(words), 1):
            text[k] = f"n{draw.randrange(10**6)}"
        rows.append((i, " ".join(text + ["end", "end"] * (i % 3))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found_classes(neardup.classes(docs)) == brute_classes(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert out == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
