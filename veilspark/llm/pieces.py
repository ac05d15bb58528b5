"""Exact SentencePiece encoding (merge type) by backtracking, and decoding.

A sequence of pieces is what merging gives exactly if each two neighbours, merged again by themselves, stay these
two; and every prefix of a text has one such sequence only.  So the encoder takes, from left to right, the longest
piece that an Aho-Corasick automaton finds at a position and that is compatible with the piece before it; where
none is, the position is marked in a bitfield as failed for good, and the piece before it gives way to a shorter
one.  Every position is tried once, so time and memory are linear in the text, white space or not.

No piece has the space mark behind another character (checked at loading), characters that no longer piece holds
never merge, and neither do a letter and a sign that no piece has behind one.  Texts are cut at all three, and what
stands between is encoded once and remembered by the worker, in two generations of ``REMEMBERED`` parts.  Normalisation and decoding are the library's own.

Defined results: a null or empty text has the end id only; rows that repeat are encoded one by one; an empty table
gives an empty table; columns of the input that share a name with an added one are replaced.  Rows are mapped in
place, so nothing is shuffled and a lost executor costs its own rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
REMEMBERED = 300_000  # parts a generation holds
SHORT = 48  # characters of a part that is remembered
_LETTERS = "A-Za-zÀ-ɏ"
_LETTER = re.compile(f"[{_LETTERS}]")
_PAIRS = 1 << 18  # neighbours whose compatibility is remembered
_BATCH = 1 << 20  # characters of texts, or ids, that are worked on at a time


class Model:
    """The pieces of a model file, with what encoding needs. Models that are not of the merge type with byte fallback,
    or that have pieces defined by users or unused ones, are refused."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        own = self.library
        plain = [i for i in range(own.get_piece_size()) if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i))]
        self.ids = {own.id_to_piece(i): i for i in plain}
        self.scores = {p: own.get_score(i) for p, i in self.ids.items()}
        self.bytes = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = own.eos_id()
        if not all(map(own.is_byte, self.bytes)):
            raise ValueError("the model has no byte fallback")
        if any(map(own.is_unused, plain)) or any(s >= 0 for p, s in self.scores.items() if len(p) > 1):
            raise ValueError("the model has unused pieces or pieces defined by users")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark behind another character")
        self.longest = max(map(len, self.ids))
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
        behind = {b for p in self.ids for a, b in pairwise(p) if _LETTER.match(a)}
        signs = "".join(re.escape(c) for c in string.punctuation if c not in behind)
        word = f"{SPACE}*+[{_LETTERS}]++(?=[{signs}])|" if signs else ""
        self.parts = re.compile((f"[{alone}]|" if alone else "") + word + f"{SPACE}++[^{SPACE}{alone}]*+|[^{SPACE}{alone}]++").findall
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merging as it is defined: the best pair first, the leftmost of equals."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def compatible(self, before: str, piece: str) -> bool:
        """Do the two stay as they are when they are merged again; ``before`` is empty at a text's start. ``pairs`` remembers."""
        fits = self.merged(before + piece) == ([before, piece] if before else [piece])
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        self.pairs[before, piece] = fits
        return fits

    def ends(self, text: str, at: int) -> list[int]:
        """Where pieces that begin at a position end, the longest last. A single character always is a piece."""
        found = [last + 1 for last, size in self.automaton.iter(text, at, min(len(text), at + self.longest)) if last + 1 - size == at]
        return found if found and found[0] == at + 1 else [at + 1, *found]

    def all_ends(self, text: str) -> list[list[int]]:
        """``ends`` of every position of a short text, in one pass of the automaton."""
        found = [[i] for i in range(1, len(text) + 1)]
        for last, size in self.automaton.iter(text):
            if size > 1:
                found[last + 1 - size].append(last + 1)
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a text."""
        n, pairs = len(text), self.pairs
        known = self.all_ends(text) if n <= SHORT else None
        failed = bytearray(n // 8 + 1)
        starts, choices, pieces = [], [], []  # of the pieces taken; their ends that are left to try
        at, before = 0, ""
        left = (known[0] if known else self.ends(text, 0)) if n else []
        while at < n:
            while left:
                end = left.pop()
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                piece = text[at:end]
                fits = pairs.get((before, piece))
                if fits or (fits is None and self.compatible(before, piece)):
                    starts.append(at)
                    choices.append(left)
                    pieces.append(piece)
                    at, before = end, piece
                    if at < n:
                        left = known[at] if known else self.ends(text, at)
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at, left = starts.pop(), choices.pop()
                pieces.pop()
                before = pieces[-1] if pieces else ""
        return pieces

    def numbers(self, text: str) -> bytes:
        """The ids of a text's pieces as 32-bit integers; characters that are no piece go byte by byte."""
        out: list[int] = []
        for p in self.split(text):
            i = self.ids.get(p)
            out += [i] if i is not None else [self.bytes[b] for b in p.encode()]
        return np.array(out, np.int32).tobytes()


class Remembered(dict):
    """Parts with their ids; the older generation goes when the newer one is full."""

    def __init__(self, model: Model, limit: int = REMEMBERED):
        super().__init__()
        self.model, self.limit, self.older = model, limit, {}

    def __missing__(self, part: str) -> bytes:
        out = self.older.get(part)
        if out is None:
            out = self.model.numbers(part)
        if len(part) <= SHORT:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[part] = out
        return out

    def encode(self, text: str) -> bytes:
        ids = b"".join(map(self.__getitem__, self.model.parts(self.model.library.normalize(text)))) if text else b""
        return ids + np.int32(self.model.end).tobytes()


@lru_cache(maxsize=2)
def loaded(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=1)
def memory(path: str) -> Remembered:
    return Remembered(loaded(path))


def _ranges(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts or lists have about ``_BATCH`` bytes or ids in all, so that large batches are worked off in parts."""
    sizes = (pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)).fill_null(0)
    start = total = 0
    for n, size in enumerate(sizes.to_pylist(), 1):
        total += size
        if total >= _BATCH or n == len(sizes):
            yield start, n
            start, total = n, 0


def _lists(rows: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))]))


def _texts(library, lists: list[list[int]]) -> pa.Array:
    return pa.array(library.decode(lists, num_threads=1) if lists else [], pa.string())


def encode(docs: DataFrame, model: str, text: str = "text", carry: Sequence[str] | None = None, decoded: bool = False) -> DataFrame:
    """Add ``ids``: the whole text's ids, the end id last; and ``decoded``, their text, if it is asked for.  ``model`` is the
    path of the model file on every worker; ``carry`` names the columns that go along (else all)."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])]
    names = [c for c in (docs.columns if carry is None else carry) if c not in {f.name for f in added}]
    out = T.StructType([*(docs.schema[c] for c in names), *added])
    given = docs.select(*names, docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = memory(model)
        for batch in batches:
            for start, end in _ranges(batch.column("__text")):
                part = batch.slice(start, end - start)
                rows = [known.encode(t or "") for t in part.column("__text").to_pylist()]
                columns = [*(part.column(c) for c in names), _lists(rows)]
                if decoded:
                    columns.append(_texts(known.model.library, [np.frombuffer(r, np.int32).tolist() for r in rows]))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return given.mapInArrow(run, out)


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of the ids; of null ids, an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = loaded(model).library
        for batch in batches:
            for start, end in _ranges(batch.column(ids)):
                part = batch.slice(start, end - start)
                texts = _texts(library, [x or [] for x in part.column(ids).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    rest = rows.drop("decoded")
    return rest.mapInArrow(run, T.StructType([*rest.schema, T.StructField("decoded", T.StringType())]))


def digests(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """What identifies the result: number of ids, hash of the decimal ids, hash of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
