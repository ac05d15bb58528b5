"""SentencePiece encoding held against the library, and the filter audit against counting by hand."""

import hashlib
import random
from itertools import permutations

import numpy as np
import pytest

from veilspark.llm import interactions, pieces
from veilspark.llm.queries import op13_pieces, pieces_path


@pytest.fixture(scope="module")
def model():
    return pieces.loaded(pieces_path())


def numbers(model, text):
    return np.frombuffer(pieces.Remembered(model).encode(text), np.int32).tolist()


def test_backtracking_equals_the_library(model):
    rng = random.Random(7)
    alphabet = " ▁abceinrst\n\t\r0123.,;ĠéüßЖж漢字😀​<>x́\0"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert numbers(model, text) == model.library.encode(text, add_eos=True), text
    syllables = ["ing", "er", "the", " ", "re", "on", "\n", "▁", "é", "ion"]
    for _ in range(2000):
        text = "".join(rng.choice(syllables) for _ in range(rng.randrange(30)))
        assert numbers(model, text) == model.library.encode(text, add_eos=True), text


@pytest.mark.parametrize("unit", [" ", "a", "ab", "\n", "é", "😀", "ing", "▁ ", "<s>", "</s>", "<0x0A>", "<unk>"])
def test_runs_without_white_space(model, unit):
    for k in (1, 2, 3, 15, 16, 17, 33, 1000, 20_000):
        assert numbers(model, unit * k) == model.library.encode(unit * k, add_eos=True)


def test_backtracking_gives_way_and_marks_positions(model):
    tried = []

    class Counting(dict):
        def get(self, key):
            tried.append(key)
            return super().get(key)

    class Counted(pieces.Model):
        def __init__(self):
            self.__dict__ |= model.__dict__ | {"pairs": Counting()}

    for text in ("▁" + "unrelatedness" * 50, "▁unrelatedness"):
        tried.clear()
        assert Counted().split(text) == model.merged(text)
        assert len(tried) < 12 * len(text)


def test_older_generation_is_kept(model):
    small = pieces.Remembered(model, limit=4)
    texts = ["one two three four five six seven", "two three", "eight nine ten one"] * 3
    assert [np.frombuffer(small.encode(t), np.int32).tolist() for t in texts] == [model.library.encode(t, add_eos=True) for t in texts]
    assert len(small) <= 4 and len(small.older) <= 4


ROWS = [(1, "hello world"), (2, None), (3, ""), (3, "hello world"), (None, "  two  spaces\n\n▁ mark \0 end "), (5, "longword" * 30_000), (6, "é漢😀" * 500)]


def test_round_trip_with_odd_rows(spark, model):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in ROWS], "doc_id bigint, text string, ids int, decoded string").repartition(3)
    at_once = pieces.encode(docs, pieces_path(), carry=("doc_id", "text"), decoded=True)
    out = pieces.decode(pieces.encode(docs, pieces_path()), pieces_path())
    assert sorted(map(str, at_once.collect())) == sorted(map(str, out.collect()))
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(((r.doc_id or -1, r.text or "", list(r.ids), r.decoded) for r in out.collect()))
    want = sorted((i or -1, t or "", ids := model.library.encode(t or "", add_eos=True), model.library.decode(ids)) for i, t in ROWS)
    assert got == want
    assert pieces.encode(docs.limit(0), pieces_path()).count() == 0
    with_null = pieces.decode(spark.createDataFrame([(None,), ([2],)], "ids array<int>"), pieces_path())
    assert {r.decoded for r in with_null.collect()} == {""}


def test_query_over_whole_documents(spark, small, model):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op13_pieces(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = model.library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.library.decode(ids).encode()).hexdigest()


# --- filter audit


def brute_audit(docs, labels):
    """Every order applied row by row."""
    texts = [t or "" for _, _, t in docs]
    fails = []
    for (key, _, _), text in zip(docs, texts, strict=True):
        words = text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
        words = [w for w in words if w]
        one = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
        one["E"] = key is not None and any(k is not None and k < key and u == text for (k, _, _), u in zip(docs, texts, strict=True))
        fails.append({f for f in one if one[f]})
    good = {k for k, q, _ in labels if k is not None and q == 1}
    toxic = {k for k, _, t in labels if k is not None and t == 1}
    out, shapley = {}, {}
    for part in {s or "" for _, s, _ in docs}:
        mine = [(k, f) for (k, s, _), f in zip(docs, fails, strict=True) if (s or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [(k, x) for k, x in left if f in x], [(k, x) for k, x in left if f not in x]
                failing = sum(f in x for _, x in mine)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x == {f} for _, x in mine), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_filtering_in_every_order(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "GAMMA", "delta", "x#y", "DELTA", "eps", "zeta eta"]
    texts = ["", None, "short", " ".join(["same"] * 60), "LOUD " * 60, "a|b"] + [rng.choice(" \t\n\v").join(rng.choices(words[: rng.randrange(2, 8)] + [f"w{i}" for i in range(rng.randrange(1, 90))], k=rng.randrange(30, 120))) for _ in range(30)]
    docs = [(rng.choice([None, *range(60)]), rng.choice([None, "", "s1", "s2"]), rng.choice(texts)) for _ in range(300)]
    docs += [(7, "s1", "again and again")] * 50 + [(None, "s2", "again and again")] * 20 + [(3, "s1", "again and again"), (9, None, "again and again")]
    labels = [(rng.choice([None, *range(80)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(90)]
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id bigint, source string, text string, mask int").repartition(5)
    lb = spark.createDataFrame([(*x, "n") for x in labels], "doc_id bigint, quality int, toxic int, part string").repartition(2)
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in interactions.COUNTS) for r in interactions.audit(d, lb).collect()}
    assert got == brute_audit(docs, labels)
    assert interactions.audit(d.limit(0), lb).count() == 0
    assert interactions.audit(d, lb.limit(0)).count() == len(got)


def test_removal_steps_are_minima_of_places():
    orders, places, steps = interactions.removal_steps()
    assert len(set(orders)) == 120 and steps.shape == (32, 120)
    for m in range(32):
        for p, order in enumerate(orders):
            want = next((i for i, f in enumerate(order, 1) if m >> "ABCDE".index(f) & 1), 6)
            assert steps[m, p] == want
            assert all(order[places[p, f] - 1] == "ABCDE"[f] for f in range(5))
