"""WARC, media, packing, mixing, chat, URL and quality operators on small fixtures."""

import base64
import hashlib
import io
import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest

from veilspark.llm import chat, lm, media, mixing, packing, quality, urls, warc
from veilspark.llm.queries import RULES, tokenizer_path
from veilspark.llm.store import shared_dir

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_warc(rows):
    by = defaultdict(list)
    for key, _, html in rows:
        by[html or ""].append(key)
    out = []
    for html, keys in by.items():
        top = max((k for k in keys if k is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        stored = False
        for k in keys:
            first = k == top and not stored
            stored |= first
            out.append((k, len(html.encode()), digest, "response" if first else "revisit", None if first else top))
    return Counter(out)


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>page {i % 7}</p>" * (1 + i % 3)) for i in range(200)]
    rows += [(300, None, None), (301, "http://x/\r\nInjected: y", ""), (302, "u", "é\0\r\n\r\nWARC/1.1"), (303, "v", "long " * 200_000), (302, "u", "é\0\r\n\r\nWARC/1.1"), (None, "n", "only null")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    uri = shared_dir(spark, "t")
    manifest = warc.write_warc(pages, uri, shard_bytes=100_000, roll_bytes=500).collect()
    assert len({m.shard for m in manifest}) > 1 and sum(m.n_records for m in manifest) == len(rows)
    back = warc.read_warc(spark, uri)
    assert Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()) == brute_warc(rows)
    stored = {bytes(r.payload).decode() for r in back.collect() if r.payload is not None}
    assert stored == {h or "" for _, _, h in rows}
    again = shared_dir(spark, "t")
    assert {(m.file, m.sha256) for m in warc.write_warc(pages.repartition(5), again, shard_bytes=100_000, roll_bytes=500).collect()} == {(m.file, m.sha256) for m in manifest}
    fs, root = pafs.FileSystem.from_uri(uri + "/records")
    assert not [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if "_tmp" in f.path]
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_deals_one_key_over_shards(spark):
    rows = [(None, "n", f"null {i % 150} " * 40) for i in range(300)] + [(2**60 + 1, "k", f"one {i} " * 40) for i in range(300)]
    rows += [(2**60 + i, "u", f"one {i} " * 40) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    uri = shared_dir(spark, "t")
    manifest = warc.write_warc(pages, uri, shard_bytes=20_000).collect()
    shards = Counter()
    for m in manifest:
        shards[m.shard] += m.n_records
    assert sum(shards.values()) == len(rows) and len(shards) > 5 and max(shards.values()) < len(rows) / 4
    back = warc.read_warc(spark, uri, with_payload=False)
    assert Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()) == brute_warc(rows)


def test_warc_splitters_part_keys_and_digests():
    random = np.random.default_rng(2)
    keys, digests = random.integers(-3, 4, 500), np.array(["%02x" % d for d in random.integers(0, 40, 500)], object)
    split = sorted({(int(k), d) for k, d in zip(keys[:30], digests[:30])} | {(9, "aa"), (9, "ab")})
    got = warc.shards_of(keys, digests, split).tolist()
    assert got == [sum(s <= (k, d) for s in split) for k, d in zip(keys.tolist(), digests)]
    assert warc.shards_of(keys, digests, []).tolist() == [0] * 500


def test_netpbm_and_bmp():
    image = np.arange(5 * 7 * 3, dtype=np.uint8).reshape(5, 7, 3)
    assert (media.decode(b"P6 # note\n7 5\n255\n" + image.tobytes()) == image).all()
    assert (media.decode(b"P3\n7 5\n255\n" + b" ".join(str(x).encode() for x in image.ravel())) == image).all()
    assert (media.decode(b"P5 7 5 255\n" + image[:, :, 0].tobytes())[:, :, 0] == image[:, :, 0]).all()
    assert (media.decode(b"P6\n7 5\n65535\n" + (image.astype(">u2") * 257).tobytes()) == image).all()
    assert media.decode(b"P2\n2 1\n15\n0 15\n")[:, :, 0].tolist() == [[0, 255]]
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0\n")[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000]))[:, :, 0].tolist() == [[0, 255, 0], [255, 0, 255]]
    stride = b"\0" * (-21 % 4)
    body = b"".join(row[:, ::-1].tobytes() + stride for row in image[::-1])
    bmp = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, len(body), 0, 0, 0, 0) + body
    assert (media.decode(bmp) == image).all()


def test_images_of_no_or_endless_size_have_no_tile():
    odd = [b"P6 0 0 255\n", b"P5 0 3 255\n", b"P4 0 5\n", b"P1 3 0\n", b"P6 99999999999999999999 1 255\n", b"P4 99999999999999999999999 2\n", b"P2 1 1 99999999999999999999\n1", b"P6 4294967296 4294967296 255\n", b"P6", b"", None]
    odd += [b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, 0, 0, 0, 0, 0) for w, h in ((0, 0), (5, 0), (0, 5), (-3, 2), (2**31 - 1, -(2**31))) for bits in (8, 24, 32)]
    assert {media._describe(d) for d in odd} == {(None, None, None)}


def test_area_resize_is_the_mean_of_covered_pixels():
    image = np.random.default_rng(1).integers(0, 256, (6, 8, 3)).astype(np.uint8)
    assert np.allclose(media.resize(image, 3, 4), image.reshape(3, 2, 4, 2, 3).mean(axis=(1, 3)))
    assert np.allclose(media.resize(image, 12, 16), image.repeat(2, 0).repeat(2, 1))
    assert np.allclose(media.resize(image, 5, 3).mean(axis=(0, 1)), image.mean(axis=(0, 1)))


def brute_features(payload, width=64):
    """Tile and difference hash by summing every sample's share in every cell."""

    def shrunk(image, height, width):
        def shares(n, m):
            out = np.zeros((m, n))
            for i in range(m):
                for j in range(n):
                    out[i, j] = max(0.0, min((i + 1) * n / m, j + 1) - max(i * n / m, j)) * m / n
            return out

        return np.einsum("ia,jb,abc->ijc", shares(image.shape[0], height), shares(image.shape[1], width), image.astype(float))

    image = np.frombuffer(payload, np.uint8).reshape(-1, width, 3)
    grey = np.round(shrunk(image.mean(axis=2, keepdims=True), 8, 9)[:, :, 0], 6)
    bits = "".join("1" if grey[i, j + 1] > grey[i, j] else "0" for i in range(8) for j in range(8))
    return np.clip(np.rint(shrunk(image, 32, 32)), 0, 255).astype(int), f"{int(bits, 2):016x}"


def test_media_columns(spark):
    texts = [None, "", "a", "é" * 96, "x" * 193, "y" * 300_000, "a"]
    rows = [(i, t, "old") for i, t in enumerate(texts)]
    stored = media.encode_text(spark.createDataFrame(rows, "doc_id bigint, text string, media string").repartition(2))
    out = {r.doc_id: r for r in media.features(stored).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 or (192 if not data else 0))
        r, form = out[i], b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(form), hashlib.sha256(form).hexdigest())
        tile, bits = brute_features(payload)
        assert r.feature == bits and np.abs(np.load(io.BytesIO(r.tile)).astype(int) - tile).max() <= 1
    assert out[2].feature == out[6].feature
    odd = media.features(spark.createDataFrame([(b"BMx",), (None,)], "media binary")).collect()
    assert all(r.feature is None for r in odd)
    assert media.features(media.encode_text(spark.createDataFrame([], DOCS))).count() == 0


def check_packing(rows, got, length=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = defaultdict(Counter)
    for doc_id, text in rows:
        x = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(x) % length or length if len(x) > length else len(x)
        edges = [0, *range(first, len(x) + 1, length)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            ids[doc_id][(i, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes()))] += 1
    found = defaultdict(Counter)
    places = defaultdict(list)
    for r in got:
        found[r.doc_id][(r.piece, r.start, r.length, r.ids_crc32)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert found == ids
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= length
    return len(places), sum(r.length for r in got)


def test_packing_of_added_tokens_long_words_and_clashing_columns(spark):
    strange = ["a  <|endoftext|>  b<|im_end|>", "<|endoftext|>", " <|endoftext|>\n\n x", "no" * 40_000, " y" + "z" * 200 + " y", "it's we'll\u00a0 x\x1c y  z", " \u3000 a \t b", "e\u0301 \U0001f600 \u0120x", " ", ""]
    rows = [(i, t, "x") for i, t in enumerate(strange * 2)] + [(None, "null id", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    check_packing([(i, t) for i, t, _ in rows], packing.pack(docs, tokenizer_path()).collect())


def test_packing_pieces_have_the_tokenisers_ids():
    ids, random = packing.Ids(tokenizer_path()), np.random.default_rng(3)
    assert ids.merge
    alphabets = ["ab", "aeinorst", "0123456789.,", "'sdmtlrve aeiou", "A\u0130\u00e9\u00b2\u00aa\u00ad\x1c\x85 \t\n", "".join(map(chr, range(1, 0x250)))]
    texts = ["".join(random.choice(list(a), random.integers(1, 400))) for a in alphabets for _ in range(100)]
    assert ids.of(texts) == ids.of(texts) == ids._encoded(texts)


def test_packing_merges_no_more_than_a_task_holds(spark):
    docs = spark.createDataFrame([(i, " word" * 1200) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    used, _ = check_packing([tuple(r) for r in docs.collect()], packing.pack(docs, tokenizer_path(), group_items=16).collect())
    assert used == 60


def test_packing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    used, total = check_packing([tuple(r) for r in docs.collect()], packing.pack(docs.repartition(6), tokenizer_path()).collect())
    assert used <= math.ceil(total / 2048) + 2


def test_packing_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "it's 'll 's x  y\n\n z\t\x1c a\x85b c²d λword wordλ !'s <|endoftext|>"), (4, "word " * 9000), (5, "a b c"), (5, "a b c"), (6, "日本語 text，ok éx"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check_packing(rows, packing.pack(docs, tokenizer_path()).collect())
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0
    short = packing.pack(docs, tokenizer_path(), group_items=2).collect()  # several roots
    check_packing(rows, short)


def test_best_fit():
    assert sorted(map(len, packing.best_fit([6, 5, 5, 4], 10))) == [2, 2]
    assert packing.best_fit([], 10) == []


def test_mixing_whole_budget(spark):
    rows = [(i, "w " * (1 + i % 9), "hot" if i % 10 else f"s{i % 4}") for i in range(2000)] + [(5000, None, None), (5001, "", "hot")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4), repetition=2.0, block_docs=64).collect()
    n = {i: len((t or "").split()) for i, t, _ in rows}
    per = Counter()
    for r in out:
        per[r.source or ""] += n[r.doc_id]
    whole = Counter()
    for i, _, s in rows:
        whole[s or ""] += n[i]
    assert {r.doc_id for r in out} == set(n)  # nothing is left out
    assert len({(r.doc_id, r.epoch) for r in out}) == len(out)
    ratio = {s: per[s] / whole[s] for s in whole if whole[s]}
    assert min(ratio.values()) == 1 and max(ratio.values()) < 2.02 and ratio["hot"] == 1 and max(ratio.values()) > 1.95
    a = [mixing.bisect_exponent(lambda g: [4 ** (1 - x) for x in g], 2.0)]
    assert abs(a[0] - 0.5) < 1e-6


def test_mixing_matches_brute_force_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    names = ("whole", "all", "end", "blocks", "__x", "key", "n", "left", "rest", "epoch")
    rows = [(i if i % 50 else None, "w " * (1 + i * 7 % 13), "hot" if i % 4 else f"s{i % 3}", *"abcdefghij") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    out = mixing.mix(docs, repetition=None, entropy=0.9, budget=9000, block_docs=32)
    assert out.columns == [*[c for c in docs.columns if c != "epoch"], *mixing.ADDED]
    got = Counter((r.source, r.doc_id) for r in out.collect())
    # The plan by itself: tokens to the power a, normalised, a bisected to the entropy.
    tokens = Counter()
    for _, t, s, *_ in rows:
        tokens[s] += len(t.split())
    total = sum(tokens.values())

    def weights(a):
        z = sum((t / total) ** a for t in tokens.values())
        return {s: (t / total) ** a / z for s, t in tokens.items()}

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if -sum(w * math.log(w) for w in weights(mid).values()) >= 0.9 else (low, mid)
    hashed = lambda *c: F.xxhash64(F.lit(17), *c)
    expected = Counter()
    for s, t in tokens.items():
        goal = round(weights(low)[s] * 9000)
        whole, rest = divmod(goal, t)
        mine = docs.filter(F.col("source") == s)
        blocks = -(-sum(r[2] == s for r in rows) // 32)
        mine = mine.select("doc_id", F.regexp_count("text", F.lit(mixing.WORDS)).alias("size"), F.pmod(hashed("doc_id"), F.lit(blocks)).cast("int").alias("b"))
        mine = mine.withColumn("bk", hashed(F.lit(s), F.lit(whole), "b")).withColumn("dk", hashed(F.lit(whole), "doc_id"))
        last, used = None, 0
        for r in sorted(mine.collect(), key=lambda r: (r.bk, r.b, r.dk, r.doc_id is not None, r.doc_id or 0)):
            # Rows with one doc_id are chosen together.
            taken = used < rest or r.doc_id == last and expected[s, r.doc_id] > whole
            expected[s, r.doc_id] += whole + taken
            used, last = used + r.size, r.doc_id
    assert sum(abs(got[k] - expected[k]) for k in got.keys() | expected.keys() if k[1] is not None) <= len(tokens)  # rounding of a goal


def test_mixing_given_budget_and_entropy(spark):
    rows = [(i, "w " * 10, "abc"[0 if i < 900 else 1 if i < 990 else 2]) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs, repetition=None, entropy=1.0, budget=6000, block_docs=50).collect()
    share = Counter(r.source for r in out)
    q = np.array([share[s] for s in "abc"]) / len(out)
    assert abs(len(out) * 10 - 6000) <= 60 and abs(-(q * np.log(q)).sum() - 1.0) < 0.02
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_chat_escapes_are_undone(spark):
    texts = [chat.END, r"<\|x <|im_sep|> <\\|", "a<", "|b", "", None, "é\n<|im_start|>user\n", "&amp;%0A"]
    rows = [(1, i, ("user", "assistant", "assistant", None)[i % 4], t) for i, t in enumerate(texts)]
    rows += [(2, 0, "us%0Aer\n<|", "x"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (None, 1, "assistant", "n")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = {r.conv_id: r for r in made.select("*", chat.read_back(made.formatted).alias("turns"), chat.loss_text(made.segments).alias("loss")).collect()}
    for c in (1, 2, None):
        turns = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert [(t.role, t.text) for t in got[c].turns] == [t[1:] for t in turns]
        assert got[c].loss == "".join(x for _, r, x in turns if r == "assistant")
        assert "".join(s.piece for s in got[c].segments) == got[c].formatted
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0


def test_url_rules_and_reputation(spark):
    rows = [(1, "https://A.Example.com/en/7x?q"), (2, "http://x.com/en/1"), (3, "http://example.net/de/81"), (4, "http://b.net/de/"), (5, None), (6, "no scheme"), (7, "http://org/es/#a"), (8, "http://xexample.com/en/7")]
    rows += [(100 + i, f"http://bad.example.dev/{i}") for i in range(60)] + [(200 + i, f"http://good{i % 5}.example.dev/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    marks = [(100 + i, 1) for i in range(40)] + [(200 + i, int(i % 40 == 0)) for i in range(150)] + [(None, 1), (9999, 1)]
    out = {r.page_id: r for r in urls.filter_urls(pages, spark.createDataFrame(marks, "page_id bigint, bad int"), RULES).collect()}
    rule = {i: (out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(1, 9)}
    assert rule == {
        1: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 2: ("x.com", "/en/1", "com/en/", "block"), 3: ("example.net", "/de/81", "example.net/de/8", "block"),
        4: ("b.net", "/de/", "net/de/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("org", "/es/", "org/es/", "block"), 8: ("xexample.com", "/en/7", "com/en/", "block"),
    }
    assert {out[100 + i].verdict for i in range(60)} == {"block"} and {out[200 + i].verdict for i in range(200)} == {"allow"}
    bare = urls.filter_urls(pages, spark.createDataFrame([], "page_id bigint, bad int")).collect()
    assert len(bare) == len(rows) and {r.verdict for r in bare} == {"allow"}


def brute_quality(text):
    t = text or ""
    words = [w for w in t.replace("\x1c", "\x01").split(" ") for w in w.split()] if False else [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    texts = [None, "", " \n\t", "a", "a b c a b c a", "x " * 20_000, "l one\nl one\n\n l one\n", "é # * $% <> |", "a\x0bb\x1cc d", "the of and " * 3 + "to in is " * 30]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    assert quality.keep(docs).columns == docs.columns


def test_quality_agrees_with_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    rows = quality.judge(docs).filter("not base_failed").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality]
    assert all(good) and sum(r.kept for r in rows if not r.quality) <= 0.2 * len(rows)


def test_lm_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9001, None), (9002, "THE the"), (None, "x")]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    counts = Counter(w for i, t in rows if not lm.held_out(i) for w in lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        w, r = lm.tokens(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in counts for x in w), n, lm.held_out(i))
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(spark.createDataFrame([], DOCS)).count() == 0


def brute_score(text, vocabulary, model):
    """Every token's probability by a softmax over all symbols, and its share of its class."""
    one = two = lm.START
    out = 0.0
    for w in lm.tokens(text):
        place = vocabulary.ids.get(w)
        symbol = int(vocabulary.symbols[place]) if place is not None else lm.class_of(w)
        context = model.q[one].astype(float) * model.c[0] + model.q[two].astype(float) * model.c[1]
        logits = model.r.astype(float) @ context + model.b
        out += (logits[symbol] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
        if symbol >= lm.WORDS:
            count = int(vocabulary.counts[place]) if place is not None else 0
            out += math.log10((count + 1) / (vocabulary.classes[symbol - lm.WORDS].sum() + 1))
        one, two = symbol, one
    return out


def test_lm_scores_equal_brute_force_and_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").filter("length(text) < 6000").union(spark.createDataFrame([(7001, ""), (7002, None), (7003, "the " * 3000)], "doc_id bigint, text string")).cache()
    vocabulary = lm.vocabulary_of(lm.count_tokens(docs))
    model = lm.train(docs, vocabulary)
    few = {r.doc_id: r for r in lm.score(docs.repartition(1)).collect()}
    many = {r.doc_id: r for r in lm.score(docs.repartition(64)).collect()}
    assert few.keys() == many.keys()
    for i, r in few.items():
        assert r.score == pytest.approx(many[i].score, rel=1e-6, abs=1e-6)
    for r in docs.collect():
        if r.doc_id % 7 == 0 or r.doc_id > 7000:
            assert few[r.doc_id].score == pytest.approx(brute_score(r.text, vocabulary, model), rel=1e-4, abs=1e-3)


def test_lm_is_normalised():
    vocabulary = lm.Vocabulary([(b"w%d" % i, 900 - i) for i in range(700)], 400_000, 700)
    model = lm.Model(vocabulary.unigram())
    every = np.arange(lm.SYMBOLS)
    logs = lm.Scorer(model)(np.full(len(every), 3), np.full(len(every), lm.START), every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)
