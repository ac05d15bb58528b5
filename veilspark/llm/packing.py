"""Best-fit packing by hierarchical residuals.

Every partition tokenises its documents and packs their pieces best-fit, longest first.  Nearly full bins
are final.  Underfull bins become items of the next round, whose groups take the bins of ``fan_in`` groups
of the round before; so the tree's root sees what is left of all partitions.  A group is only merged while
its items number less than ``group_items``, so no task holds an unbounded group: where nothing fits together,
the tree ends with several roots.

Ids are the tokeniser's own.  Pieces of common Latin characters that no cache holds are merged by ``tiktoken``
from the same vocabulary, where the tokeniser's file is one for which both must agree (``_merger``).

Pieces in a bin carry their numbers only, never texts or ids; texts are not shuffled.

Defined results: a null text is an empty one, so it is the end token alone; repeated rows are packed one by
one; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.store import cut, parallelism

LENGTH = 2048
END_ID = 0
NEARLY_FULL = 8  # bins with at most so much space left are final
CACHE = 500_000  # pieces of text whose ids a worker process remembers; then the cache is begun anew and takes over what is still met
LONG = 64  # characters of a piece that is remembered
JOINED = 500  # pieces encoded as one text
CHARS = 1 << 18  # texts tokenised at once

# White space as the tokeniser's pattern has it; Python's own class also holds the separators 28 to 31.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_WS}]", c))
SPACE = "\u0120"  # fixed value: how the vocabulary spells a space
#: The tokeniser never joins anything across these cuts, so equal pieces have equal ids in every text.
PIECES = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

#: Pieces of these characters only are alike letters, numbers or neither in every version of Unicode.
LATIN = re.compile("[\\x00-\\u024f]+")
#: Fixed value: how byte-level tokenisers part a text before they merge.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BINS = "grp bigint, done boolean, used int, items array<struct<doc_id:bigint,piece:int,start:bigint,length:int,ids_crc32:bigint>>"


def _merger(path: str, tokenizer) -> Callable[[str], list[int]] | None:
    """The vocabulary in ``tiktoken``, which merges the pair whose union has the least id instead of following a list of merges.

    Both agree where merges are listed by the id of what they make and every entry is what its own characters
    merge to: inside the place of an entry that is made last, the steps before are then those of the entry alone,
    so that the pair left over is the listed one.  Where the file is not such a one: None.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    model, before = described["model"], described["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not described["normalizer"]
    if not plain:
        return None
    special = {t["content"] for t in described["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or any([x.id for x in tokenizer.model.tokenize(t)] != [i] for t, i in vocabulary.items()):
        return None
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32]  # a byte is spelt as itself, or else by the next character from 256 on
    bytes_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    if any(c not in bytes_of for t in vocabulary for c in t):
        return None
    ranks = {bytes(bytes_of[c] for c in t): i for t, i in vocabulary.items()}
    if any(bytes([b]) not in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Ids:
    """Token ids as little-endian bytes, through a bounded cache of pieces."""

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are written as the machine's own 32-bit little-endian words")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = (self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size()))
        self.opens = np.array([bool(n) and n.startswith(SPACE) for n in names])
        self.merge = _merger(path, self.tokenizer)
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, texts: list[str]) -> list[bytes]:
        return [array("I", self.merge(t)).tobytes() for t in texts]

    def _fresh(self, pieces: set[str]) -> Iterator[tuple[str, bytes]]:
        latin = list(filter(LATIN.fullmatch, pieces)) if self.merge else []
        yield from self._joined(latin, self._merged)
        yield from self._joined(sorted(pieces.difference(latin)), self._encoded)  # in order, so that neighbours meet equal merges

    def _joined(self, pieces: list[str], encode: Callable[[list[str]], list[bytes]]) -> Iterator[tuple[str, bytes]]:
        """Pieces that begin with a space are encoded joined and parted where a token begins with one."""
        spaced = [p for p in pieces if p[0] == " " and len(p) > 1 and p[1] not in WHITE]
        single = [p for p in pieces if p[0] != " " or len(p) == 1 or p[1] in WHITE]
        runs = [spaced[i : i + JOINED] for i in range(0, len(spaced), JOINED)]
        for run, ids in zip(runs, encode(["".join(r) for r in runs]), strict=True):
            starts = np.flatnonzero(self.opens[np.frombuffer(ids, "<u4")])
            if len(starts) != len(run):  # should a token ever hold such a space inside
                single += run
                continue
            edges = (starts * 4).tolist()
            yield from zip(run, (ids[x:y] for x, y in zip(edges, [*edges[1:], len(ids)], strict=True)), strict=True)
        yield from zip(single, encode(single), strict=True)

    def of(self, texts: list[str]) -> list[bytes]:
        # Texts that hold an added token's string go as they are: it has an id of its own, and cuts text around it.
        whole = {i: t for i, t in enumerate(texts) if any(x in t for x in self.added)}
        pieces = [PIECES.findall(t) if i not in whole else [] for i, t in enumerate(texts)]
        found = [list(map(self.cache.get, p)) for p in pieces]
        gaps = [[i for i, x in enumerate(f) if x is None] for f in found]
        missing = {p[i] for p, gap in zip(pieces, gaps, strict=True) for i in gap}
        new = {p: self.old[p] for p in missing if p in self.old}
        new.update(self._fresh(missing.difference(new)))
        for p, f, gap in zip(pieces, found, gaps, strict=True):
            for i in gap:
                f[i] = new[p[i]]
        out = [b"".join(f) for f in found]
        short = {p: x for p, x in new.items() if len(p) <= LONG}  # entries are bounded, so the cache is too
        if len(self.cache) + len(short) > CACHE:
            self.old, self.cache = self.cache, {}
        self.cache.update(short)
        for i, ids in zip(whole, self._encoded(list(whole.values())), strict=True):
            out[i] = ids
        return out


_IDS: dict[str, Ids] = {}  # one for all tasks of a worker process, so that its cache stays warm


def pieces_of(ids: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32); where a document is cut, the first piece takes what is over."""
    n = len(ids) // 4
    first = n % length or length
    edges = [0, *range(first, n + 1, length)] if n > length else [0, n]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins as lists of indices: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(length + 1)]  # bins by space left
    spaces: list[int] = []  # the spaces that have a bin, in order
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(spaces, sizes[i])
        if at < len(spaces):
            space = spaces[at]
            b = by_space[space].pop()
            if not by_space[space]:
                spaces.pop(at)
        else:
            space, b = length, len(bins)
            bins.append([])
        bins[b].append(i)
        left = space - sizes[i]
        if left:
            if not by_space[left]:
                insort(spaces, left)
            by_space[left].append(b)
    return bins


def _grouped(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str]]]:
    """Documents in runs of about ``CHARS``."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS or i + 1 == len(texts):
            yield ids[at : i + 1], [x or "" for x in texts[at : i + 1]]
            at, size = i + 1, 0


def _tokenised(docs: DataFrame, tokenizer_path: str, length: int) -> DataFrame:
    """One local round: the bins of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, grp = _IDS.get(tokenizer_path) or Ids(tokenizer_path), TaskContext.get().partitionId()
        _IDS[tokenizer_path] = ids
        end = np.array([END_ID], "<u4").tobytes()
        open_: list[tuple[int, int, int, int, int]] = []

        def full(items: list[tuple]) -> pa.RecordBatch:
            return _bin_batch([(grp, True, length, [x]) for x in items])

        def packed(items: list[tuple]) -> pa.RecordBatch:
            bins = [[items[i] for i in b] for b in best_fit([x[3] for x in items], length)]
            used = [sum(x[3] for x in b) for b in bins]
            return _bin_batch([(grp, length - u <= NEARLY_FULL, u, b) for u, b in zip(used, bins, strict=True)])

        for batch in batches:
            whole = []
            for some, texts in _grouped(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for doc_id, found in zip(some, ids.of(texts), strict=True):
                    for piece in pieces_of(found + end, length):
                        (whole if piece[2] == length else open_).append((doc_id, *piece))
            if whole:
                yield full(whole)
            if len(open_) >= 200_000:
                yield packed(open_)
                open_ = []
        if open_:
            yield packed(open_)

    return docs.select("doc_id", "text").mapInArrow(run, _BINS)


_ITEM_TYPE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


def _bin_batch(bins: list[tuple[int, bool, int, list[tuple]]]) -> pa.RecordBatch:
    flat = [x for b in bins for x in b[3]]
    items = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], f.type) for k, f in enumerate(_ITEM_TYPE)], fields=list(_ITEM_TYPE))
    offsets = pa.array(np.cumsum([0, *(len(b[3]) for b in bins)]), pa.int32())
    columns = [pa.array([b[k] for b in bins], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, items)], names=["grp", "done", "used", "items"])


def _merge(length: int):
    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("used", "descending")])
        used, items = part.column("used").to_pylist(), part.column("items").to_pylist()
        out = []
        for b in best_fit(used, length):
            total = sum(used[i] for i in b)
            out.append((key[0], length - total <= NEARLY_FULL, total, [tuple(x.values()) for i in b for x in items[i]]))
        return pa.Table.from_batches([_bin_batch(out)])

    return run


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, fan_in: int = 8, group_items: int = 100_000) -> DataFrame:
    """``docs`` (doc_id, text) to one row per piece with its sequence and offset."""
    spark = docs.sparkSession
    # The local round packs what the reader's splits hold: texts are not shuffled.
    bins = cut(_tokenised(docs, tokenizer_path, length), "bins-0")
    finished, level, groups = [bins.filter("done")], bins.filter("not done"), None
    for step in range(1, 64):
        state = level.agg(F.count("*").alias("n"), F.max("grp").alias("top")).first()
        if not state["n"]:
            break
        groups = state["top"] + 1
        fewer = max(-(-groups // fan_in), -(-state["n"] // group_items))
        if step > 1 and fewer >= groups:
            break
        # Where a split left more bins than a task should hold, they are dealt by their first item.
        first = F.xxhash64(F.col("items")[0]["doc_id"], F.col("items")[0]["piece"])
        merged = level.withColumn("grp", F.pmod(F.col("grp") if fewer <= groups else first, F.lit(fewer))).repartition(min(fewer, parallelism(spark)), "grp")
        merged = cut(merged.groupBy("grp").applyInArrow(_merge(length), _BINS), f"bins-{step}")
        finished.append(merged.filter("done"))
        level = merged.filter("not done")
        if fewer == 1:
            break
    finished.append(level)
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    # A sequence is named after its first piece: (first piece's document, piece) is unique where ids are; the row id is so always.
    out = out.select(F.monotonically_increasing_id().alias("sequence_id"), "items")
    offsets = F.transform("items", lambda x, i: F.struct(x.alias("x"), F.aggregate(F.slice("items", F.lit(1), i), F.lit(0), lambda a, y: a + y["length"]).alias("offset")))
    return out.select("sequence_id", F.explode(offsets).alias("p")).select(
        F.col("p.x.doc_id").alias("doc_id"), F.col("p.x.piece").alias("piece"), F.col("p.x.start").alias("start"),
        F.col("p.x.length").cast("long").alias("length"), F.col("p.x.ids_crc32").alias("ids_crc32"),
        "sequence_id", F.col("p.offset").cast("long").alias("offset"),
    )
