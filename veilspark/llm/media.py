"""Media columns: Netpbm and BMP images decoded to numpy, area-resized, tiled as NPY and hashed.

``encode_text`` stores any bytes losslessly as the samples of a binary PPM (``P6``, 64 pixels of three bytes
a row).  ``features`` decodes a media column, resizes it by area with integral images and returns an NPY
tile and a 64-bit difference hash.  Both are narrow ``mapInArrow`` steps: no shuffle, one batch in memory.

Defined results: a null text is an empty one and is stored as one row of spaces; equal bytes give equal
media; null or undecodable media give null tile and hash; repeated rows are handled one by one; an empty
table gives an empty table; input columns that share a name with an added one are replaced.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDTH = 64
ROW_BYTES = 3 * WIDTH
TILE = 32


def to_ppm(payload: bytes) -> bytes:
    return b"P6\n%d %d\n255\n" % (WIDTH, len(payload) // ROW_BYTES) + payload


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of ``ROW_BYTES``."""
    return data + b" " * (-len(data) % ROW_BYTES if data else ROW_BYTES)


def _netpbm_fields(data: bytes, want: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, and where the raster begins."""
    out, at = [], 2
    while len(out) < want:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6, samples of one or two bytes scaled to 0 to 255; height x width x channels. P7 is not read."""
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        (w, h), at = _netpbm_fields(data, 2)
        if kind == b"P4":
            bits = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
        else:
            bits = np.frombuffer(bytes(c for c in data[at:] if c in b"01"), np.uint8)[: h * w].reshape(h, w) - 48
        return ((1 - bits) * np.uint8(255))[:, :, None]
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    (w, h, top), at = _netpbm_fields(data, 3)
    if not 0 < top < 1 << 16:
        raise ValueError("no such sample")
    c = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P5", b"P6"):
        image = np.frombuffer(data, np.uint8 if top < 256 else ">u2", h * w * c, at).reshape(h, w, c)
    else:
        image = np.array(data[at:].split()[: h * w * c], np.int64).reshape(h, w, c)
    return image.astype(np.uint8, copy=False) if top == 255 else np.rint(image * (255 / top)).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit palette, 24-bit and 32-bit BMP, either row order."""
    start, size, w, h, _, bits, how = struct.unpack_from("<I4xI", data, 10)[:1] + struct.unpack_from("<IiiHHI", data, 14)
    if how not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("unsupported BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:: -1 if h > 0 else 1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
        return palette[rows[:, :w]]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area mean of every target cell from an integral image; cells may cover fractions of pixels."""
    h, w, c = image.shape
    if not h or not w:
        raise ValueError("an image without pixels")
    integral = np.zeros((h + 1, w + 1, c))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])

    def at(edges: np.ndarray, axis: int, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(int), table.shape[axis] - 2)
        part = (edges - low).reshape([-1 if i == axis else 1 for i in range(3)])
        return np.take(table, low, axis) * (1 - part) + np.take(table, low + 1, axis) * part

    sums = at(np.linspace(0, w, width + 1), 1, at(np.linspace(0, h, height + 1), 0, integral))
    return np.diff(np.diff(sums, axis=0), axis=1) * (height * width / (h * w))


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is a cell of the 8 x 9 grey reduction brighter than its left neighbour."""
    grey = resize(image.mean(axis=2, keepdims=True), 8, 9)[:, :, 0]
    return np.packbits(np.diff(np.round(grey, 6), axis=1) > 0).tobytes().hex()


def _with(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in added]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(added.values()), names=kept + list(added))


def _schema(df: DataFrame, added: dict[str, T.DataType]) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in added]
    return T.StructType(kept + [T.StructField(n, t) for n, t in added.items()])


def encode_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``media`` (binary) and ``n_bytes`` (long, before padding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                data = [(t or "").encode() for t in part.column(text).to_pylist()]
                added = {"media": pa.array([to_ppm(pad(d)) for d in data], pa.binary()), "n_bytes": pa.array(map(len, data), pa.int64())}
                yield _with(part.drop_columns([text]), added)

    rest = docs.select(*dict.fromkeys([c for c in docs.columns if c not in ("media", "n_bytes")] + [text]))
    return rest.mapInArrow(run, _schema(rest.drop(text), {"media": T.BinaryType(), "n_bytes": T.LongType()}))


def _describe(data: bytes | None) -> tuple:
    try:
        image = decode(data)
        tile = npy(np.clip(np.rint(resize(image, TILE, TILE)), 0, 255).astype(np.uint8))
        return tile, difference_hash(image), image.tobytes()
    except (TypeError, ValueError, IndexError, ArithmeticError, struct.error):  # sizes of zero or beyond all bounds included
        return None, None, None


def features(media: DataFrame, column: str = "media", digests: bool = True) -> DataFrame:
    """Add ``tile`` (NPY bytes, 32 x 32 x channels), ``feature`` (difference hash, hex) and, if asked for,
    digests of the stored bytes and of the samples read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                stored = part.column(column).to_pylist()
                tiles, hashes, back = zip(*map(_describe, stored), strict=True)
                added = {"tile": pa.array(tiles, pa.binary()), "feature": pa.array(hashes, pa.string())}
                if digests:
                    hexed = lambda items: pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in items], pa.string())
                    added |= {
                        "payload_bytes": pa.array([None if x is None else len(x) for x in back], pa.int64()),
                        "payload_sha256": hexed(back),
                        "tail_crc32": pa.array([None if x is None else zlib.crc32(x[-16:]) for x in back], pa.int64()),
                        "media_bytes": pa.array([None if x is None else len(x) for x in stored], pa.int64()),
                        "media_sha256": hexed(stored),
                    }
                yield _with(part, added)

    added: dict[str, T.DataType] = {"tile": T.BinaryType(), "feature": T.StringType()}
    if digests:
        added |= {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType()}
        added |= {"media_bytes": T.LongType(), "media_sha256": T.StringType()}
    return media.mapInArrow(run, _schema(media, added))
