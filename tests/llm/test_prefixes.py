"""The trie of shared beginnings held against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from veilspark.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int"


def turn_id(role, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16] + len(words).to_bytes(4, "big")


def brute_trie(rows):
    """Nodes by their prefixes, every number by its definition."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, turn_id(role or "", text or "")))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = (own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h]) + ts[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(ms) - 1) * (int.from_bytes(p[-1][-4:], "big") if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(ms), len(p), min(members[p[:-1]]) if p else -99, len(ms), len(children.get(p, [])), leaves[p], saved[p], digest(p)) for p, ms in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def table(rng, n=400):
    texts = ["hello there", "", None, "a  b\tc", "long " * 50, "one"]
    rows = []
    for c in [*range(n), -7, -20, -21]:
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # no conversation to branch from
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    first = [(0, "user", "hi"), (1, "assistant", "yes"), (2, "user", "go on")]
    rows += [(c, t, r, x) for c in range(1000, 1400) for t, r, x in first]  # a group of copies
    rows += [(2000, t, "user", f"turn {t % 3}") for t in range(700)] + [(2001, t, "user", f"turn {t % 3}") for t in range(650)]
    rows += rng.choices(rows, k=50) + [(None, 1, "user", "no number")] * 5
    return rows


@pytest.mark.parametrize("size", [1 << 22, 6000, 500])
def test_trie_equals_all_prefixes(spark, monkeypatch, size):
    monkeypatch.setattr(prefixes, "SHARD_BYTES", size)
    rows = table(random.Random(size))
    df = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA).repartition(5)
    want = brute_trie(rows)
    assert found(prefixes.trie(df)) == want
    monkeypatch.setattr(prefixes, "SMALL", 0)
    assert found(prefixes.trie(df)) == want


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixes.trie(empty).count() == 0
    rows = [(None, 0, "user", "x")]
    assert prefixes.trie(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)).count() == 0
    rows = [(3, 0, "user", "only")]  # nothing is left of it: its beginning is replaced by that of a conversation that is not there
    assert found(prefixes.trie(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))) == brute_trie(rows)
    rows = [(c, t, None, None) for c in range(50) for t in (None, None, 0)]
    assert found(prefixes.trie(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))) == brute_trie(rows)


def test_layouts_grow_and_paths_are_cut():
    rng = random.Random(1)
    keys = {bytes(20 * i) + bytes([b]) + bytes(19) for i in (0, 1) for b in range(256)} | {b""} | {rng.randbytes(20 * rng.randrange(1, 5)) for _ in range(500)}
    keys |= {k[: 20 * d] for k in keys for d in range(len(k) // 20)}
    tree = prefixes.Tree()
    for i, k in enumerate(sorted(keys)):
        tree.add(k, i)
    kinds, seen, stack = set(), [], [(tree.root, b"")]
    while stack:
        node, at = stack.pop()
        at += node.path
        seen += [at] * len(node.ends)
        if node.below:
            kinds.add((type(node.below).__name__, getattr(node.below, "room", 0)))
            stack += [(n, at + bytes([b])) for b, n in node.below.items()]
            assert [b for b, _ in node.below.items()] == sorted(b for b, _ in node.below.items())
    assert sorted(seen) == sorted(keys)
    assert {"Sorted", "Full"} <= {k for k, _ in kinds}
    indexed = prefixes.Sorted()
    for b in range(40):
        indexed = indexed.put(255 - b, prefixes.Node(bytes([b]), []))
    assert isinstance(indexed, prefixes.Indexed) and indexed.get(250).path == bytes([5]) and indexed.get(1) is None
    deep = prefixes.Tree()
    for k in (2, 1, 3):
        deep.add(b"\1" * 20 * 3000 * k, k)
    rows = prefixes.walk(deep, 0, None, None)
    assert len(rows) == 9001 and {r[8] for r in rows} == {1}
