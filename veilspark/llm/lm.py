"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are words with A-Z in lower case and one end token per text.  Counts of all tokens come from all
training documents.  The model's symbols are the commonest words and, for all other words, classes by ending
and length.  The predicted vector is the sum of the two preceding symbols' vectors, each scaled by a vector of
its position; a symbol's score is the product with its own vector plus a bias.  Documents are dealt into shards of
about two million tokens by their hash, as symbols of two bytes; a task trains on a shard's tokens in numpy against
shared noise samples, and the shards' parameters are averaged by Spark, weighted by tokens.  Scoring normalises over all symbols, by batched matrix products over the contexts not
met before; a word in a class has its add-one share of the class, with one more share for unseen words.

The commonest ``HEAD`` words' counts go to the tasks with the model (bounded by that parameter); counts of all
other words reach their documents by a join on the word, none of which is frequent.

Defined results: a null text is empty and has the end token only; a null doc_id is hashed as the empty string;
repeated rows are each learnt from and each scored; without training documents every count is zero and the
model is uniform over symbols; an empty table gives an empty one; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.store import cut, release

END = b""  # no word is empty
HEAD = 200_000  # words whose counts every task holds, at most
WORDS = 512  # symbols that are words
ENDINGS = 48
CLASSES = 2 * ENDINGS
DIM = 16
NOISE = 32
BATCH = 1024
RATE = 0.05
CHARS = 1 << 18
SHARD = 2_000_000  # tokens that one task trains on, about


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def class_of(word: bytes) -> int:
    return WORDS + (word[-1] if word else 0) % ENDINGS + ENDINGS * (len(word) > 7)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Ids and texts in runs of about ``CHARS``."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        ids.append(i)
        texts.append(t)
        size += len(t or "")
        if size >= CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def count_tokens(docs: DataFrame) -> DataFrame:
    """word (binary), c: over the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not held_out(doc_id):
                    counts.update(tokens(text))
                if len(counts) > 400_000:
                    yield flush()
                    counts = Counter()
        if counts:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The head's words with counts, their symbols, and the share of each class."""

    def __init__(self, head: list[tuple[bytes, int]], n: int, v: int):
        self.ids = {w: i for i, (w, _) in enumerate(head)}
        self.counts = np.array([c for _, c in head], np.int64)
        self.symbols = np.array([i if i < WORDS else class_of(w) for i, (w, _) in enumerate(head)], np.int32)
        self.n, self.v = n, v
        self.classes: np.ndarray = np.zeros((CLASSES, 2), np.int64)  # tokens, words

    def unigram(self) -> np.ndarray:
        """Share of each symbol among the training tokens."""
        top = np.zeros(WORDS)
        top[: min(WORDS, len(self.counts))] = self.counts[:WORDS]
        share = np.r_[top, self.classes[:, 0]] + 1.0
        return share / share.sum()


SYMBOLS = WORDS + CLASSES
START = SYMBOLS  # stands before a text


class Model:
    """Context vectors q, position vectors c, symbol vectors r, biases b."""

    shapes = (("q", (SYMBOLS + 1, DIM)), ("c", (2, DIM)), ("r", (SYMBOLS, DIM)), ("b", (SYMBOLS,)))

    def __init__(self, unigram: np.ndarray):
        random = np.random.default_rng(5)
        self.q = random.normal(0, 0.3, (SYMBOLS + 1, DIM)).astype(np.float32)
        self.r = random.normal(0, 0.02, (SYMBOLS, DIM)).astype(np.float32)  # near the unigram model to begin with
        self.c = np.ones((2, DIM), np.float32)
        self.b = np.log(unigram).astype(np.float32)
        self.noise = unigram
        self.offset = (np.log(NOISE * unigram)).astype(np.float32)
        self.squares = {n: np.full(s, 1e-8, np.float32) for n, s in self.shapes}

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n, _ in self.shapes])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n, s in self.shapes:
            size = int(np.prod(s))
            setattr(self, n, flat[at : at + size].reshape(s).astype(np.float32))
            at += size

    def _step(self, name: str, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        """AdaGrad, upwards."""
        self.squares[name][rows] += gradient * gradient
        getattr(self, name)[rows] += RATE * gradient / np.sqrt(self.squares[name][rows])

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, random: np.random.Generator) -> None:
        """A step over a batch: the symbols before, the ones before those, and what follows."""
        size = len(target)
        drawn = random.choice(SYMBOLS, NOISE, p=self.noise)
        q1, q2 = self.q[one], self.q[two]
        context = q1 * self.c[0] + q2 * self.c[1]
        real = np.einsum("ij,ij->i", context, self.r[target]) + self.b[target] - self.offset[target]
        fake = context @ self.r[drawn].T + self.b[drawn] - self.offset[drawn]
        up = 1 / (1 + np.exp(np.minimum(real, 30)))  # how far from sure that the data are data
        down = -1 / (1 + np.exp(-np.maximum(fake, -30)))
        to_context = up[:, None] * self.r[target] + down @ self.r[drawn]

        def summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
            cells = index[:, None] * DIM + np.arange(DIM)
            return (np.bincount(cells.ravel(), values.ravel(), n * DIM).reshape(n, DIM) / size).astype(np.float32)

        to_r = summed(target, up[:, None] * context, SYMBOLS)
        np.add.at(to_r, drawn, (down.T @ context) / size)
        to_b = np.bincount(target, up, SYMBOLS) / size
        np.add.at(to_b, drawn, down.sum(axis=0) / size)
        to_q = summed(one, to_context * self.c[0], SYMBOLS + 1) + summed(two, to_context * self.c[1], SYMBOLS + 1)
        to_c = np.stack([(to_context * q1).mean(axis=0), (to_context * q2).mean(axis=0)])
        for name, gradient in (("r", to_r), ("b", to_b.astype(np.float32)), ("q", to_q), ("c", to_c)):
            self._step(name, gradient)


class Scorer:
    """Normalised log-probabilities; the normaliser of a context is computed when it is first met."""

    def __init__(self, model: Model):
        self.m = model
        self.normaliser = np.full((SYMBOLS + 1) ** 2, np.nan, np.float32)

    def __call__(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        m = self.m
        where = one.astype(np.int64) * (SYMBOLS + 1) + two
        fresh = np.unique(where[np.isnan(self.normaliser[where])])
        for at in range(0, len(fresh), 2048):
            part = fresh[at : at + 2048]
            context = m.q[part // (SYMBOLS + 1)] * m.c[0] + m.q[part % (SYMBOLS + 1)] * m.c[1]
            logits = context @ m.r.T + m.b
            top = logits.max(axis=1)
            self.normaliser[part] = top + np.log(np.exp(logits - top[:, None]).sum(axis=1))
        context = m.q[one] * m.c[0] + m.q[two] * m.c[1]
        return np.einsum("ij,ij->i", context, m.r[target]) + m.b[target] - self.normaliser[where]


def _symbols(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Head numbers (-1: not in the head), symbols, and where the others stand."""
    ids = np.fromiter(map(vocabulary.ids.get, words, repeat(-1)), np.int64, len(words))
    other = np.flatnonzero(ids < 0)
    symbols = vocabulary.symbols[ids] if len(vocabulary.symbols) else np.zeros(len(ids), np.int32)
    if len(other):
        symbols[other] = [class_of(words[i]) for i in other]
    return ids, symbols, other


def _contexts(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.cumsum(lengths) - lengths
    one, two = np.r_[START, symbols[:-1]], np.r_[START, START, symbols[:-2]][: len(symbols)]
    one[begins] = two[begins] = START
    second = begins[lengths > 1] + 1
    two[second] = START
    return one, two


def _encoded(docs: DataFrame, shared) -> DataFrame:
    """Training documents as ``key`` (a hash of id and text) and ``symbols``, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(2).to_pylist(), 0
            for ids, texts in _texts(batch):
                mine, at = keys[at : at + len(ids)], at + len(ids)
                kept = [(k, tokens(t)) for k, i, t in zip(mine, ids, texts, strict=True) if not held_out(i)]
                if not kept:
                    continue
                _, symbols, _ = _symbols(shared.value, [w for _, f in kept for w in f])
                ends = np.cumsum([len(f) for _, f in kept])
                rows = [x.astype(np.uint16).tobytes() for x in np.split(symbols, ends[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int64()), pa.array(rows, pa.binary())], names=["key", "symbols"])

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(run, "key bigint, symbols binary")


def train(docs: DataFrame, vocabulary: Vocabulary) -> Model:
    """One pass over all training tokens in shards of about ``SHARD``; the average of the shards' parameters.

    Documents go to shards by their hash and stand in its order there, so the model depends on the documents and not on the files or
    partitions they come in."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, random, learnt = Model(shared.value.unigram()), np.random.default_rng(11), 0
        held: list[tuple] = []
        size = 0
        for batch in batches:
            found = [np.frombuffer(x, np.uint16).astype(np.int32) for x in batch.column(1).to_pylist()]
            for at in range(0, len(found), 256):
                part = found[at : at + 256]
                symbols = np.concatenate(part)
                held.append((*_contexts(symbols, np.array([len(f) for f in part])), symbols))
                size += len(symbols)
                if size >= BATCH * 64:
                    one, two, target = (np.concatenate(c) for c in zip(*held, strict=True))
                    done = size - size % BATCH
                    for start in range(0, done, BATCH):
                        model.train(one[start : start + BATCH], two[start : start + BATCH], target[start : start + BATCH], random)
                    held, size, learnt = [(one[done:], two[done:], target[done:])], size - done, learnt + done
        if size:
            one, two, target = (np.concatenate(c) for c in zip(*held, strict=True))
            for at in range(0, size, BATCH):
                model.train(one[at : at + BATCH], two[at : at + BATCH], target[at : at + BATCH], random)
            learnt += size
        if learnt:
            flat = model.flat()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), learnt, np.int64))], names=["i", "x", "n"]
            )

    shards = max(1, -(-vocabulary.n // SHARD))
    dealt = _encoded(docs, shared).repartition(shards, "key").sortWithinPartitions("key", "symbols")
    parts = dealt.mapInArrow(run, "i int, x float, n bigint")
    rows = parts.groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).collect()  # one row per parameter
    model = Model(vocabulary.unigram())
    if rows:
        model.load(np.array([r["x"] for r in sorted(rows)]))
    return model


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """``counts``: word, c. Totals, the head and the classes' sums come to the driver; all are bounded."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # Words by eighths of a power of two of their counts: the lowest step down to which the head still takes all words.
    step, size, cutoff = F.floor(F.log2("c") * 8), 0, None
    for r in sorted(counts.groupBy(step.alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect(), reverse=True):
        size += r["n"]
        cutoff = r["low"] if size <= HEAD else cutoff
    found = counts.filter(F.col("c") >= cutoff).collect() if cutoff else []
    head = sorted(((bytes(r["word"]), r["c"]) for r in found), key=lambda x: (-x[1], x[0]))
    out = Vocabulary(head, total["n"] or 0, total["v"] or 0)
    top = [w for w, _ in head[:WORDS]]
    last = F.when(F.octet_length("word") > 0, F.conv(F.hex(F.expr("substring(word, -1, 1)")), 16, 10).cast("int")).otherwise(0)
    number = last % ENDINGS + F.when(F.octet_length("word") > 7, ENDINGS).otherwise(0)
    rest = counts.filter(~F.col("word").isin(top)) if top else counts
    for r in rest.groupBy(number.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        out.classes[r["k"]] = r["n"], r["v"]
    return out


_SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rest array<struct<word:binary,times:bigint>>"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = shared.value
        scorer = Scorer(model)
        known = np.log10(vocabulary.counts + 1.0)
        share = np.r_[np.zeros(WORDS), np.log10(vocabulary.classes.sum(axis=1) + 1.0)]  # what a class's shares sum to
        rest_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())]))
        for batch in batches:
            row_ids, at = batch.column(2).to_pylist(), 0
            for ids, texts in _texts(batch):
                found = [tokens(t) for t in texts]
                lengths = np.array([len(f) for f in found])
                words = [w for f in found for w in f]
                numbers, symbols, other = _symbols(vocabulary, words)
                one, two = _contexts(symbols, lengths)
                score = scorer(one, two, symbols) / np.log(10) - share[symbols]
                base = np.zeros(len(words))
                inside = numbers >= 0
                base[inside] = known[numbers[inside]]
                score += np.where(symbols >= WORDS, base, 0.0)  # the head's words in classes; the others' counts are joined
                edges = np.r_[0, np.cumsum(lengths)]
                sums = lambda x, e=edges: np.add.reduceat(x, e[:-1]) if len(e) > 1 else x[:0]
                split = np.searchsorted(other, edges)
                rest = [[{"word": w, "times": c} for w, c in Counter(words[i] for i in other[a:b]).items()] for a, b in zip(split, split[1:], strict=False)]
                columns = [row_ids[at : at + len(ids)], ids, [held_out(i) for i in ids], lengths, sums(inside.astype(np.int64)), sums(base), sums(score), rest]
                types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), rest_type)
                names = ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
                at += len(ids)

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = cut(count_tokens(docs), "counts")
    vocabulary = vocabulary_of(counts)
    release(spark)
    model = train(docs, vocabulary)
    shared = spark.sparkContext.broadcast((vocabulary, model))
    scored = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_score(shared), _SCORED)
    scored = cut(scored, "scored")
    release(spark)
    rare = scored.select("row", F.explode("rest").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.times").alias("times"))
    below = F.col("c") < int(vocabulary.counts.min()) if len(vocabulary.counts) else F.lit(True)
    joined = rare.join(counts.filter(below), "word", "left")
    c = F.coalesce("c", F.lit(0))
    rest = joined.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 1.0)).alias("logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("seen"))
    out = scored.drop("rest").join(rest, "row", "left")
    logs, all_ = F.coalesce("logs", F.lit(0.0)), float(np.log10(vocabulary.n + vocabulary.v + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * all_).alias("base_score"), (F.col("score") + logs).alias("score"),
    )
