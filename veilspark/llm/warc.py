"""A deterministic sharded WARC writer, and its reader.

Records are range-sorted by key and payload digest, so that many payloads under one key, or under none, are dealt
over shards too: splitters come from a sample chosen by a hash of both, so the same table gives the same shards
in any run.  A shard rolls to a new file once the compressed size is reached.  Headers,
record ids and digests are derived from the content alone.  Files are written under temporary names and then
renamed; the manifest of files is a table that is renamed last, and readers open only what it lists.  A task
that runs twice writes the same bytes.

Equal payloads of at least ``revisit_bytes`` are stored once, with the largest key; the others become
``revisit`` records that name it.  The join that finds them is salted, so a payload shared by a third of all
rows is dealt over many tasks.

Defined results: null payloads are empty ones; a null url becomes an empty target; a null key sorts first and
never holds the stored copy while another key shares the payload; of rows that repeat key and payload the
first is stored and the rest revisit it; an empty table gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.store import cut, shared_dir

DATE = "2020-01-01T00:00:00Z"  # given, not taken from the clock, so that files are reproducible
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:record")
SAMPLE = 20_000  # keys and digests sampled for the splitters, about, or
PER_SHARD = 8  # so many for each shard, if that is more
NO_KEY = -(1 << 63)  # stands for a null key, which sorts first
MANIFEST = "file string, shard int, seq int, n_records bigint, n_bytes bigint, sha256 string"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key}/{digest}/{repeat}')}>"


def _clean(value: str) -> str:
    """A header value in one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record(key: int | None, url: str, payload: bytes, leader: int | None, repeat: int, revisit: bool) -> bytes:
    digest = digest32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, digest, repeat)}"]
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    head += [f"X-Key: {key}"] if key is not None else []
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(leader, digest)}"]
        head += [f"X-Refers-To-Key: {leader}"] if leader is not None else []
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


class _Roller:
    """Writes a shard's records, one gzip member each, into files of bounded compressed size."""

    def __init__(self, uri: str, roll_bytes: int):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.roll_bytes, self.stream, self.rows = roll_bytes, None, []
        self.fs.create_dir(self.root, recursive=True)

    def add(self, shard: int, data: bytes) -> None:
        if self.stream is None or shard != self.shard or self.size >= self.roll_bytes:
            self.close(shard)
            self.temporary = f"{self.root}/_tmp-{uuid.uuid4().hex}"
            self.stream, self.size, self.count, self.sha = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self.stream.write(member)
        self.sha.update(member)
        self.size, self.count = self.size + len(member), self.count + 1

    def close(self, shard: int | None = None) -> None:
        if self.stream is not None:
            self.stream.close()
            name = f"part-{self.shard:06d}-{self.seq:04d}.warc.gz"
            final = self.fs.get_file_info(f"{self.root}/{name}")
            if final.type == pafs.FileType.File:  # an earlier attempt of this task ended; its bytes are the same
                self.fs.delete_file(self.temporary)
            else:
                self.fs.move(self.temporary, final.path)
            self.rows.append((name, self.shard, self.seq, self.count, self.size, self.sha.hexdigest()))
            self.seq = self.seq + 1 if shard == self.shard else 0
            self.stream = None
        else:
            self.seq = 0
        self.shard = shard


def _writer(uri: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, repeat, mark, leader = _Roller(uri, roll_bytes), None, 0, None, None
        for batch in batches:
            for shard, key, digest, url, payload, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if payload is None:  # says that the payload has copies, and which one is stored
                    mark, leader = (key, digest), named
                    continue
                repeat = repeat + 1 if last == (key, digest) else 0
                last = (key, digest)
                revisit = mark == last and (key != leader or repeat > 0)
                roller.add(shard, record(key, url, payload.encode(), leader, repeat, revisit))
        roller.close()
        if roller.rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*roller.rows), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in MANIFEST.split(", ")])

    return run


def _splitters(narrow: DataFrame, shard_bytes: int) -> list[tuple[int, str]]:
    """Keys and digests that begin a shard, from a sample in proportion to the shards that depends on both alone."""
    total = narrow.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
    shards = math.ceil((total["b"] or 0) / shard_bytes)
    if shards < 2:
        return []
    every = max(1, total["n"] // max(SAMPLE, PER_SHARD * shards))
    sample = narrow.filter(F.pmod(F.xxhash64("key", "digest"), F.lit(every)) == 0)
    rows = sample.groupBy(F.coalesce("key", F.lit(NO_KEY)).alias("key"), "digest").agg(F.sum("size").alias("b")).orderBy("key", "digest").collect()
    if not rows:
        return []
    ends = np.cumsum([r["b"] + 1 for r in rows])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards)
    return sorted({(rows[i]["key"], rows[i]["digest"]) for i in at})


def shards_of(keys: np.ndarray, digests: np.ndarray, split: list[tuple[int, str]]) -> np.ndarray:
    """How many of the splitters are at or before each key and digest."""
    by_key, by_digest = np.array([k for k, _ in split], np.int64), np.array([d for _, d in split], object)
    shard, end = np.searchsorted(by_key, keys, side="left"), np.searchsorted(by_key, keys, side="right")
    for key in np.unique(keys[shard < end]):  # the keys inside which a shard begins
        here = np.flatnonzero(keys == key)
        among = by_digest[shard[here[0]] : end[here[0]]]
        shard[here] += np.searchsorted(among, digests[here], side="right")
    return shard.astype(np.int32)


def write_warc(
    pages: DataFrame, uri: str, key: str = "page_id", url: str = "url", payload: str = "html",
    shard_bytes: int = 1 << 30, roll_bytes: int = 1 << 28, revisit_bytes: int = 0, salts: int = 8,
) -> DataFrame:
    """Write all rows below ``uri`` and commit; returns the manifest, which lies at ``uri``/manifest."""
    spark = pages.sparkSession
    p = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    narrow = cut(p.select("key", "digest", F.octet_length("payload").alias("size")), "payloads")
    split = _splitters(narrow, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(keys: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series(shards_of(keys.to_numpy(np.int64), digests.to_numpy(object), split))

    copies = narrow.filter(F.col("size") >= revisit_bytes).groupBy("digest").agg(F.max("key").alias("leader"), F.count("*").alias("copies"))
    copies = copies.filter("copies > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marks = narrow.select("key", "digest").distinct().withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(copies, ["digest", "salt"])
    # Payloads are shuffled once; what is known of their copies goes to the same place as rows that sort just before them.
    none = F.lit(None).cast("string")
    rows = p.select("key", "digest", "url", "payload", F.lit(None).cast("bigint").alias("leader"))
    rows = rows.union(marks.select("key", "digest", none, none, "leader")).select(shard_of(F.coalesce("key", F.lit(NO_KEY)), "digest").alias("shard"), "*")
    dealt = rows.repartitionById(len(split) + 1, F.col("shard"))
    dealt = dealt.sortWithinPartitions("shard", "key", "digest", F.col("payload").isNotNull(), "url")
    done = dealt.mapInArrow(_writer(uri + "/records", roll_bytes), MANIFEST)
    done.write.parquet(uri + "/manifest-uncommitted")
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.move(root + "/manifest-uncommitted", root + "/manifest")
    return spark.read.schema(done.schema).parquet(uri + "/manifest")


def records_of(data: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each gzip member; one record is held at a time."""
    unpack, plain = zlib.decompressobj(31), []

    def parsed() -> tuple[dict[str, str], bytes]:
        head, _, rest = b"".join(plain).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        return fields, rest[: int(fields["content-length"])]

    for chunk in data:
        while chunk:
            plain.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                yield parsed()
                unpack, plain = zlib.decompressobj(31), []


def read_warc(spark: SparkSession, uri: str, with_payload: bool = True) -> DataFrame:
    """All records that the manifest lists: key, url, record_type, payload_bytes, payload_digest, refers_to and
    payload (null for revisits).  A file or payload whose digest differs from what was written is an error."""
    manifest = spark.read.parquet(uri + "/manifest")
    files = manifest.select("file", "sha256").repartition(max(1, min(manifest.count(), 10_000)))
    schema = "key bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
    schema += ", payload binary" if with_payload else ""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)][: len(names)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri + "/records")
        for batch in batches:
            for name, sha256 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size, seen = [], 0, hashlib.sha256()

                def chunks(stream: pa.NativeFile, seen=seen) -> Iterator[bytes]:
                    while data := stream.read(1 << 20):
                        seen.update(data)
                        yield data

                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in records_of(chunks(stream)):
                        body = block.partition(b"\r\n\r\n")[2]
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        revisit = head["warc-type"] == "revisit"
                        if not revisit and digest32(body) != digest:
                            raise ValueError(f"{name}: payload digest differs")
                        number = lambda n, head=head: int(head[n]) if n in head else None
                        rows.append((number("x-key"), head.get("warc-target-uri"), head["warc-type"], number("x-payload-length"), digest, number("x-refers-to-key"), None if revisit else body))
                        size += len(body)
                        if len(rows) >= 5000 or size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if seen.hexdigest() != sha256:
                    raise ValueError(f"{name}: not what the manifest lists")
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, schema)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new place in the shared folder and read the archives back, without payloads."""
    uri = shared_dir(pages.sparkSession, "warc")
    write_warc(pages, uri, **options)
    return read_warc(pages.sparkSession, uri, with_payload=False)
