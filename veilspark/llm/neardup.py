"""Near-duplicates by ProbMinHash: weighted five-word shingles, banding and verification.

A document is its five-word shingles weighted by how often they occur (a text of fewer words is one shingle).
Each shingle is a Poisson process of arrivals whose rate is its weight; every arrival falls on a random
component, and a component keeps the shingle that reached it first.  Two documents agree in a component with
the probability that is their probability Jaccard.  Shingles stop once their next arrival is later than all
components' first ones.

Documents with equal words are one class from the start and go on as one representative.  Signatures are cut
into bands; documents that agree in a band share a bucket.  A bucket is first compared through its best connected
member (the one with most bucket neighbours), not in pairs; what is then in a bucket with other components
is compared by an exact prefix filter (``_rest``).  Pairs are verified by their exact probability Jaccard over
the whole texts.  Links are joined to classes by connected components.

Defined results: a null text is an empty one; texts without words are one class; a null doc_id is smaller than
all others; rows that repeat doc_id and text are one document; other texts of one doc_id are documents of their
own; an empty table gives an empty one; input columns that share a name with an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.components import components
from veilspark.llm.rolling import mix, prefix_sums, range_hash
from veilspark.llm.store import aside, back, cut, parallelism

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
STEP = 1 << 18
SLOTS = 1 << 20
BLOCK = 2048
QUOTA = 16  # likeliest partners of a text in a block that are verified in the first round
PRINTS = 1024  # distinct shingles of a text that travel as two bytes each
SPREAD = 1024  # pairs of one lead in a task
NULL_ID = -(1 << 63)
ADDED = ("class_id", "n_links", "is_first")

_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text a 128-bit key of its words (two columns); and text number, hash, of every shingle in order."""
    joined = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # every text ends with a space
    word = ~_IS_SPACE[joined]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False]))
    begin, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(ends, begin, "right")
    hashes = range_hash(prefix_sums(joined), begin, end)
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    order = np.arange(len(begin)) - first[text]
    key = np.zeros((len(texts), 2), _U)
    for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        parts = mix(hashes ^ mix(order.astype(_U) + _U(salt)))
        sums = np.r_[_U(0), np.cumsum(parts)]
        key[:, i] = mix(sums[first + n] - sums[first] + n.astype(_U))
    short = (n > 0) & (n < SHINGLE)
    starts = np.flatnonzero((order + SHINGLE <= n[text]) | ((order == 0) & short[text]))
    owner = text[starts]
    out = np.zeros(len(starts), _U)
    for j in range(SHINGLE):
        at = starts + j
        there = at < first[owner] + n[owner]
        out = mix(out * _U(3) + np.where(there, hashes[np.minimum(at, max(len(hashes) - 1, 0))], _U(1)) if len(starts) else out)
    return key, owner, out, n


def weighted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text and how often they occur."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])][: len(o)])
    return o[new], h[new], np.diff(np.r_[new, len(o)])


def prob_minhash(n_texts: int, owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
    """The shingle that reaches each component first; ``n_texts`` x ``m``; zero where a text has no shingles."""
    best = np.full(n_texts * m, np.inf)
    who = np.zeros(n_texts * m, _U)
    rate = weight.astype(float)
    time = np.zeros(len(owner))
    live = np.arange(len(owner))
    k = 0
    while len(live):
        k += 1
        random = mix(hashes[live] + _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time[live] -= np.log(((random >> _U(11)).astype(float) + 1) * 2.0**-53) / rate[live]
        slot = owner[live] * m + (mix(random) % _U(m)).astype(np.int64)
        t = time[live]
        order = np.lexsort((t, slot))
        s = slot[order]
        lead = order[np.r_[True, s[1:] != s[:-1]]]
        sooner = lead[t[lead] < best[slot[lead]]]
        best[slot[sooner]], who[slot[sooner]] = t[sooner], hashes[live[sooner]]
        latest = best.reshape(n_texts, m).max(axis=1) if n_texts else best
        live = live[t < latest[owner[live]]]
    return who.reshape(n_texts, m)


def _grouped(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about ``STEP`` bytes, with the number of the first."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t or "").encode())
        size += len(held[-1])
        if size >= STEP:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, texts in _grouped(batch.column(1).to_pylist()):
                key, owner, hashes, n = shingles(texts)
                signature = prob_minhash(len(texts), *weighted(owner, hashes), bands * rows)
                out = np.zeros((len(texts), bands), _U)
                for r in range(rows):
                    out = mix(out * _U(3) + signature[:, r::rows] + np.arange(bands, dtype=_U))
                flat = pa.array(np.where(n[:, None] > 0, out, _U(0)).view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands), flat)
                signs = pa.array([x.tobytes() for x in (signature & _U(255)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(texts)), pa.array([k.tobytes() for k in key], pa.binary()), lists, signs], names=["doc", "key", "bands", "sign"]
                )

    return run


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact, from distinct hashes in order and their weights: the sum over shared shingles i of
    1 / sum over j of max(a_j / a_i, b_j / b_i), by prefix sums over the ratios a_j / b_j in order."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    names = np.union1d(ha, hb)
    x, y = np.zeros(len(names)), np.zeros(len(names))
    x[np.searchsorted(names, ha)], y[np.searchsorted(names, hb)] = wa, wb
    ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    shared = (x > 0) & (y > 0)
    # j up to i's ratio: b_j / b_i is the larger; beyond it a_j / a_i.
    upto = np.searchsorted(ratio, ratio[shared], "right")
    ys, xs = np.r_[0, np.cumsum(y)], np.r_[0, np.cumsum(x)]
    return float(np.sum(1 / (ys[upto] / y[shared] + (xs[-1] - xs[upto]) / x[shared])))


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 200):
                texts = [(t or "").encode() for c in (2, 3) for t in batch.column(c).slice(at, 200).to_pylist()]
                half = len(texts) // 2
                _, owner, hashes, _ = shingles(texts)
                o, h, w = weighted(owner, hashes)
                cut_ = np.searchsorted(o, np.arange(len(texts) + 1))
                part = lambda i, c=cut_, h=h, w=w: (h[c[i] : c[i + 1]], w[c[i] : c[i + 1]])
                same = [probability_jaccard(part(i), part(i + half)) for i in range(half)]
                good = np.array(same) >= threshold - 1e-12
                yield pa.RecordBatch.from_arrays([a.slice(at, half), b.slice(at, half), pa.array(good)], names=["a", "b", "linked"])

    return run


def salted(large: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` with each key of ``large`` dealt over several tasks; ``small`` has a row per key."""
    salts = max(8, parallelism(large.sparkSession) // 8)
    large = large.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.join(small, [key, "__salt"], how).drop("__salt")


def _candidates(members: DataFrame, rank: DataFrame) -> DataFrame:
    """Each bucket's best connected member ``lead`` with all of its members ``node``, each pair once; no lead has more than ``n``."""
    order = F.struct(F.col("degree").alias("d"), (-F.col("node")).alias("m"))
    best = members.join(rank, "node").groupBy("bucket").agg(F.max_by(F.struct(F.col("node").alias("lead"), F.col("degree").alias("n")), order).alias("b"))
    return salted(members, best, "bucket").select("node", "b.lead", "b.n").filter("node <> lead").distinct()


def _judged(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (node, lead, n) verified over their whole texts; a lead with many pairs is dealt over several tasks."""
    shares = F.ceil(F.col("n") / SPREAD).cast("int")
    leads = pairs.select("lead", "n").distinct().join(texts.select(F.col("node").alias("lead"), F.col("text").alias("tb")), "lead")
    leads = leads.select("lead", "tb", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    met = pairs.join(texts.select("node", F.col("text").alias("ta")), "node").withColumn("share", F.pmod(F.xxhash64("node"), shares).cast("int"))
    met = met.join(leads, ["lead", "share"]).select("node", "lead", "ta", "tb")
    return met.mapInArrow(_verify(threshold), "a bigint, b bigint, linked boolean").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "linked")


def _prefixes(threshold: float, counts: np.ndarray):
    """Rows of the rarest shingles of each text, see ``_rest``; ``prev`` is the one before in order, 0 for the first."""
    low, high = threshold, 2 * threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for at, texts in _grouped(batch.column(1).to_pylist()):
                _, owner, hashes, _ = shingles(texts)
                o, h, w = weighted(owner, hashes)
                order = np.lexsort((h, counts[h % _U(len(counts))], o))
                h, w = h[order], w[order]
                sums = np.r_[0, np.cumsum(w)]
                edge = np.searchsorted(o, np.arange(len(texts) + 1))
                left = (sums[edge[1:]][o] - sums[:-1]) / (sums[edge[1:]] - sums[edge[:-1]])[o]
                prev = np.where(np.r_[True, o[1:] != o[:-1]][: len(o)], _U(0), np.r_[_U(0), h[:-1]][: len(o)])
                at_ = np.flatnonzero(left >= low - 1e-9)
                columns = nodes[o[at_] + at], h[at_].view(np.int64), prev[at_].view(np.int64), left[at_] >= high - 1e-9, left[at_]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "e", "prev", "nine", "share"])

    return run


def _count(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _grouped(batch.column(0).to_pylist()):
                _, owner, hashes, _ = shingles(texts)
                slot, n = np.unique(weighted(owner, hashes)[1] % _U(slots), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n)], names=["slot", "n"])

    return run


def least_equal(m: int, threshold: float) -> int:
    """So many of ``m`` components agree at the threshold but for one pair in 300,000 (4.5 standard deviations)."""
    return int(m * threshold - 4.5 * (m * threshold * (1 - threshold)) ** 0.5)


def _sketch(most: int):
    """Per text its distinct shingles' last two bytes and, unless all are one, weights; null beyond ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _grouped(batch.column(1).to_pylist()):
                _, owner, hashes, _ = shingles(texts)
                o, h, w = weighted(owner, hashes)
                edge = np.searchsorted(o, np.arange(len(texts) + 1))
                prints, weights = [], []
                for i, j in zip(edge[:-1], edge[1:]):
                    fits = j - i <= most and w[i:j].max(initial=0) < 256
                    prints.append((h[i:j] & _U(0xFFFF)).astype(np.uint16).tobytes() if fits else None)
                    weights.append(w[i:j].astype(np.uint8).tobytes() if fits and w[i:j].max(initial=0) > 1 else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(prints, pa.binary()), pa.array(weights, pa.binary())], names=["node", "prints", "weights"])

    return run


def _compare_block(rows: dict[str, list], threshold: float, quota: int) -> list[np.ndarray]:
    """Members with other roots that may be linked: node, lead, and whether node has more than ``quota``."""
    node, root, prev, share = (np.array(rows[c]) for c in ("node", "root", "prev", "share"))
    nine, left, right = (np.array(rows[c], bool) for c in ("nine", "left", "right"))
    signs = np.frombuffer(b"".join(rows["sign"]), np.uint8).reshape(len(node), -1)
    least = least_equal(signs.shape[1], threshold)
    known = np.array([p is not None for p in rows["prints"]])
    size = np.array([len(p) // 2 if p else 0 for p in rows["prints"]])
    begin = np.cumsum(size) - size
    prints = np.frombuffer(b"".join(p or b"" for p in rows["prints"]), np.uint16)
    weight = np.frombuffer(b"".join(w or b"\1" * n for w, n in zip(rows["weights"], size)), np.uint8).astype(float)
    mass = weight / np.repeat(np.add.reduceat(weight, begin[size > 0]), size[size > 0]) if len(weight) else weight
    dense = np.zeros(1 << 16)
    r = np.flatnonzero(right)
    out = []
    for k in np.flatnonzero(left & nine):
        # Two that both have the shingle in the short prefix meet once; equal ``prev`` means that they meet there.
        may = (root[r] != root[k]) & ((prev[r] != prev[k]) | (prev[k] == 0)) & (~nine[r] | (node[r] < node[k]))
        j = r[may & (1 / share[r] + 1 / share[k] <= 1 + 1 / threshold + 1e-9)]
        exact = j[known[j] & known[k]]
        rough = j[~(known[j] & known[k])]
        likely = (signs[rough] == signs[k]).sum(axis=1) / signs.shape[1]
        j, likely = rough[likely >= least / signs.shape[1]], likely[likely >= least / signs.shape[1]]
        if len(exact):
            mine = slice(begin[k], begin[k] + size[k])
            np.add.at(dense, prints[mine], mass[mine])
            n = size[exact]
            at = np.repeat(begin[exact] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            got, first = dense[prints[at]], np.cumsum(n) - n
            with np.errstate(divide="ignore"):
                bound = 1 / (1 / np.add.reduceat(got, first) + 1 / np.add.reduceat(mass[at] * (got > 0), first) - 1)
            dense[prints[mine]] = 0
            j, likely = np.r_[j, exact[bound >= threshold - 1e-9]], np.r_[likely, bound[bound >= threshold - 1e-9]]
        if len(j):
            more = len(j) > quota
            j = j[np.argsort(-likely, kind="stable")[:quota]]
            out.append(np.array([np.full(len(j), node[k]), node[j], np.full(len(j), more)]))
    return out


def _compare(threshold: float, quota: int):
    names = ("node", "root", "prev", "nine", "share", "left", "right", "sign", "prints", "weights")

    def found(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        if len(held["node"]) > 1 and (pairs := _compare_block(held, threshold, quota)):
            node, lead, more = np.concatenate(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(lead), pa.array(more.astype(bool))], names=["node", "lead", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {n: [] for n in names}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("e", "i", "j"))))
            for key, *values in zip(keys, *(batch.column(n).to_pylist() for n in names)):
                if key != now:
                    yield from found(held)
                    now, held = key, {n: [] for n in names}
                for n, v in zip(names, values):
                    held[n].append(v)
        yield from found(held)

    return run


def _met(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of each block pair (e, i, j): ``left`` ones are compared with ``right`` ones."""
    met = salted(rows, groups, "e")
    own = F.xxhash64("node", F.lit(1))
    met = met.withColumn("bi", F.pmod(own, "nb9")).withColumn("bj", F.pmod(own, "nb"))
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    across = F.transform(F.sequence(F.lit(0), F.col("nb9") - 1), lambda i: pair(i, F.col("bj")))
    along = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: pair(F.col("bi"), j))
    met = met.withColumn("at", F.explode(F.when(F.col("nine"), F.array_union(across, along)).otherwise(across)))
    sides = (F.col("nine") & (F.col("at.i") == F.col("bi"))).alias("left"), (F.col("at.j") == F.col("bj")).alias("right")
    return met.select("node", "e", "prev", "nine", "share", "at.i", "at.j", *sides)


def _rest(needed: DataFrame, nodes: DataFrame, signed: DataFrame, good: DataFrame, threshold: float) -> DataFrame:
    """``good`` with all links that join other roots among ``nodes`` (node, root), without candidates by chance.

    With s_a and s_b the shares of the texts' weight on shared shingles, the probability Jaccard is at most
    1 / (1 / s_a + 1 / s_b - 1).  So at a threshold t both shares are at least t and the larger one at least
    2 t / (1 + t).  In an order of all shingles, the first one that two linked texts share has at least these
    shares at and behind it: it is in the short prefix (2 t / (1 + t)) of one and in the long one (t) of the other.
    The order takes rare shingles first (by counts of hash slots; any order gives the same links), so that
    frequent passages bring few texts together.  Texts that share the shingle before as well meet there already.

    What meets is compared in blocks inside tasks by these shares, over two bytes of every shingle; a text of
    more than ``PRINTS`` distinct ones is compared by signatures (``least_equal``).  What may be linked is verified.  Where a text has more of that than a quota, the likeliest go first and the rest goes on to another
    round, under the roots that are then joined and a larger quota, until nothing is left.
    """
    texts = cut(needed.join(nodes.select("node"), "node"), "open")
    counted = texts.select("text").mapInArrow(_count(SLOTS), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    rows = cut(texts.mapInArrow(_prefixes(threshold, counts), "node bigint, e bigint, prev bigint, nine boolean, share double"), "prefixes")
    new = (F.min("prev") != F.max("prev")) | (F.count_if(F.col("prev") == 0) > 0)
    groups = rows.groupBy("e").agg(F.count("*").alias("n"), F.count_if(F.col("nine")).alias("n9"), new.alias("new"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    groups = groups.filter("n > 1 and n9 > 0 and new").select("e", blocks("n").alias("nb"), blocks("n9").alias("nb9"))
    met = cut(_met(rows, groups), "met")
    shown = signed.join(texts, "node", "left_semi").select("node", "sign")
    shown = cut(shown.join(texts.select("node", "text").mapInArrow(_sketch(PRINTS), "node bigint, prints binary, weights binary"), "node"), "shown")
    quota, tested = QUOTA, None
    while True:
        now = nodes.join(shown, "node")
        # The number is given because the work grows with the square of a block, not with its bytes.
        now = met.join(now, "node").repartition(parallelism(met.sparkSession), "e", "i", "j").sortWithinPartitions("e", "i", "j")
        near = now.mapInArrow(_compare(threshold, quota), "node bigint, lead bigint, more boolean")
        near = near.groupBy("node", "lead").agg(F.max("more").alias("more"))
        near = cut(near if tested is None else near.join(tested.select("node", "lead", F.lit(True).alias("old")), ["node", "lead"], "left"), "near")
        fresh = near if tested is None else near.filter("old is null")
        of = fresh.groupBy("lead").agg(F.count("*").alias("n"))
        good = good.union(cut(_judged(salted(fresh.select("node", "lead"), of, "lead"), texts, threshold).filter("linked").select("a", "b"), "rest"))
        if not near.filter("more").head(1):
            return good
        tested = fresh.select("node", "lead") if tested is None else tested.union(fresh.select("node", "lead"))
        nodes = nodes.select("node").join(components(good), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        quota *= 8


def links(docs: DataFrame, signed: DataFrame, text: Column, threshold: float) -> DataFrame:
    """Verified links (a, b) between representatives; ``docs`` (doc, text), ``signed`` (node, bands, sign)."""
    spark = docs.sparkSession
    rows = signed.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = cut(salted(rows, shared, "bucket"), "members")
    rank = cut(members.groupBy("node").agg(F.sum("size").alias("degree")), "rank")
    members = members.select("node", "bucket")
    needed = cut(docs.join(rank.select(F.col("node").alias("doc")), "doc", "left_semi").select(F.col("doc").alias("node"), text.alias("text")), "texts")
    pairs = cut(_candidates(members, rank), "pairs")
    good = cut(_judged(pairs, needed, threshold).filter("linked").select("a", "b").distinct(), "judged")
    # Linked documents go on under their component's root; buckets within one component have nothing left to test.
    rooted = members.join(components(good), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("bucket")
    open_ = cut(salted(rooted, apart, "bucket").select("node", "root").distinct(), "unsettled")
    return _rest(needed, open_, signed, good, threshold).distinct() if open_.head(1) else good


def _numbered(docs: DataFrame, text: str) -> tuple[DataFrame, bool]:
    """Add __doc and __node, the number of a doc_id with a text: the doc_id itself unless one has several texts.

    Numbers are in the order of doc_ids.  The flag says whether doc_ids repeat."""
    known = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    marks = known.select("__doc", mark.alias("m")).groupBy("__doc").agg(F.min("m").alias("x"), F.max("m").alias("y"), F.count("*").alias("n"))
    repeated = marks.filter("n > 1").agg(F.count("*").alias("n"), F.count_if(F.col("x") != F.col("y")).alias("several")).first()
    if not repeated["several"]:
        return known.withColumn("__node", F.col("__doc")), bool(repeated["n"])
    known = known.withColumn("__mark", mark)
    numbers = known.select("__doc", "__mark").distinct().orderBy("__doc", "__mark")
    numbers = cut(numbers.withColumn("__node", F.monotonically_increasing_id()), "numbers")
    return cut(known.join(numbers, ["__doc", "__mark"]).drop("__mark"), "numbered"), True


def _classed(docs: DataFrame, threshold: float, bands: int, rows: int, text: str) -> tuple[DataFrame, bool]:
    """``classes`` with __node; do doc_ids repeat?"""
    docs = docs.drop(*[c for c in ADDED if c in docs.columns])
    known, repeated = _numbered(docs, text)
    plain = known.select(F.col("__node").alias("doc"), F.col(text).alias("text"))
    once = plain.dropDuplicates(["doc"]) if repeated else plain
    signed = cut(once.mapInArrow(_sign(bands, rows), "doc bigint, key binary, bands array<bigint>, sign binary"), "signed")
    alike = signed.groupBy("key").agg(F.min_by(F.struct("doc", "bands", "sign"), "doc").alias("one"))
    alike = cut(alike.select("key", F.col("one.doc").alias("node"), "one.bands", "one.sign"), "alike")
    found = cut(links(once, alike.filter("bands[0] <> 0").select("node", "bands", "sign"), F.col("text"), threshold), "found")
    roots = components(found)
    both = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node")))
    facts = alike.select("key", "node").join(roots, "node", "left").join(both.groupBy("node").agg(F.count("*").alias("n_links")), "node", "left")
    facts = facts.select("key", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    member = signed.select("doc", "key", F.col("doc").alias("node"))
    member = salted(member, facts, "key").select(F.col("doc").alias("__node"), F.col("root").alias("__root"), "n_links")
    out = known.join(member, "__node").withColumn("is_first", F.col("__root") == F.col("__node"))
    if repeated:
        ids = known.select(F.col("__node").alias("__root"), F.col("__doc").alias("class_id")).distinct()
        out = out.join(ids.join(member.select("__root").distinct(), "__root", "left_semi"), "__root")
    else:
        out = out.withColumn("class_id", F.col("__root"))
    real = F.when(F.col("class_id") != NULL_ID, F.col("class_id"))
    return out.withColumn("class_id", real).select(*docs.columns, *ADDED, "__node"), repeated


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, text: str = "text") -> DataFrame:
    """``docs`` with ``class_id`` (the class's least doc_id), ``n_links`` (verified links of the document's words to
    other words; pairs already in one class are not tested) and ``is_first`` (is this the document that stays)."""
    return _classed(docs, threshold, bands, rows, text)[0].drop("__node")


def keep(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, text: str = "text") -> DataFrame:
    """One document of each class, the one with the least doc_id, with the columns of the input."""
    out, repeated = _classed(aside(docs, ADDED), threshold, bands, rows, text)
    out = out.filter("is_first")
    return back(out.dropDuplicates(["__node"]) if repeated else out, docs)
