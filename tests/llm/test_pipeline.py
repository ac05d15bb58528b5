"""The pipeline stage by stage against brute force, each stage on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from test_dedup import brute_classes
from test_formats import brute_quality, check_packing

from veilspark.llm import quality
from veilspark.llm.store import cut


def brute_keep(text):
    n, chars, symbols, dup_lines, repeated = brute_quality(text)
    words = [w for w in (text or "").split() if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    stop = sum(w in set(quality.STOP_WORDS) for w in words)
    if n < 50 or repeated * 100 > n * 50:
        return False
    return 3 <= chars / n <= 10 and symbols / n <= 0.1 and stop / n >= 0.02 and dup_lines / max(len(lines), 1) <= 0.5


def brute_cut(rows):
    """Texts without the bytes under repeats of 100, where whole characters stay."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        at, kept = 0, []
        for c in text:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                kept.append(c)
            at += size
        out[doc_id] = "".join(kept)
    return out


def test_stages(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "suffix_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    at = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, small), name)
        assert docs.columns == before.columns
        at[name] = docs.collect()
    kept = {i: r.text for i, r in rows.items() if brute_keep(r.text)}
    assert {r.doc_id: r.text for r in at["quality_rules"]} == kept
    first = {i for i, c in brute_classes(list(kept.items())).items() if i == c}
    assert {r.doc_id for r in at["near_dedup"]} == first
    texts = brute_cut([(i, kept[i]) for i in first])
    assert {r.doc_id: r.text for r in at["suffix_dedup"]} == texts
    times = Counter(r.doc_id for r in at["source_mixing"])
    assert set(times) == set(texts) and max(times.values()) <= 3
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    check_packing([(r.doc_id, r.text) for r in at["source_mixing"]], packed)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, small).collect()) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed)
