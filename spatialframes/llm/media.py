"""Media columns: payloads in tar shards, addressed by content; rows carry digest, offset and length.

A payload is stored losslessly as a grey picture of 192 samples a row (8 bits a sample, one sample a
byte), named by the payload's SHA-256. Tasks append pictures to shards of their own in the shared
folder. A shard's name is drawn anew by each attempt and its rows are given out only once it is
closed, so a lost task leaves an unread file at most and never a row without its bytes. A shard holds
a payload once; where several shards hold one, the index points to the first of them.

Reading goes by range: :func:`with_headers` reads the 33 bytes that hold a picture's size, and
:func:`with_payloads` the whole picture. Both are ordered by shard and offset, so a task reads forward
in few files.

Shards are written by pyarrow's file systems: the shared folder may be local, HDFS or an object store.

Defined results: a null text is empty; an empty payload is one row of blanks; equal payloads give
equal values; rows that repeat repeat their result; an empty table gives no rows and no shard; other
columns than the id and the text are not kept.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatialframes.llm.common import read, slices
from spatialframes.session import fresh_path, settle

ROW = 192
BLANK = b" "
HEADER = 33  # signature and first chunk of a picture
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the text's bytes, and those padded to rows."""
    data = (text or "").encode()
    return len(data), data + BLANK * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_picture(payload: bytes, level: int = 4) -> bytes:
    """The payload as an 8-bit grey PNG, a row of which is ``ROW`` bytes."""
    height = len(payload) // ROW
    rows = np.zeros((height, ROW + 1), np.uint8)  # each row starts with its filter, 0 for none
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, ROW)
    size = struct.pack(">IIBBBBB", ROW, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", size) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(start: bytes) -> tuple[int, int]:
    """Width and height from the first bytes of a picture."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a picture of this store")
    return struct.unpack(">II", start[16:24])


def from_picture(picture: bytes) -> bytes:
    width, height = read_header(picture)
    at, packed = 8, b""
    while at < len(picture):
        size, kind = struct.unpack(">I4s", picture[at : at + 8])
        data = picture[at + 8 : at + 8 + size]
        if struct.unpack(">I", picture[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk does not pass its check")
        packed += data if kind == b"IDAT" else b""
        at += size + 12
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


class Shards:
    """Appends pictures to tar files; rows wait until the file that they point to is closed."""

    def __init__(self, folder: str, most_bytes: int):
        self.folder, self.most = folder, most_bytes
        self.store, self.base = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.base, recursive=True)
        self.out, self.rows = None, []

    def add(self, payload: bytes) -> tuple[bytes, str, int, int]:
        """Digest, shard, offset and length of the picture; call :meth:`full` after it."""
        digest = hashlib.sha256(payload).digest()
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.at, self.held = self.store.open_output_stream(f"{self.base}/{self.name}"), 0, {}
        if digest not in self.held:
            picture = to_picture(payload)
            entry = tarfile.TarInfo(f"{digest.hex()}.png")
            entry.size = len(picture)
            self.out.write(entry.tobuf(tarfile.USTAR_FORMAT))
            self.out.write(picture + b"\0" * (-len(picture) % 512))
            self.held[digest] = (self.at + 512, len(picture))
            self.at += 512 + len(picture) + -len(picture) % 512
        return digest, self.name, *self.held[digest]

    def full(self) -> bool:
        return self.out is not None and self.at >= self.most

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


INDEX = ("n_bytes", "digest", "shard", "offset", "length")


def store(docs: DataFrame, folder: str, text: str = "text", shard_bytes: int = 64_000_000) -> DataFrame:
    """Writes the shards; one row per document: ``doc_id, n_bytes, digest, shard, offset, length``.

    The rows are written beside the shards, so that they are made once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, waiting = Shards(folder, shard_bytes), []
        for batch in slices(batches, text):
            ids = batch.column("doc_id")
            start, rows = 0, []
            for i, t in enumerate(batch.column(text).to_pylist()):
                n, payload = payload_of(t)
                rows.append((n, *shards.add(payload)))
                if shards.full():
                    shards.close()
                    yield from waiting
                    yield _index(ids.slice(start, i + 1 - start), rows)
                    start, rows, waiting = i + 1, [], []
            if rows:
                waiting.append(_index(ids.slice(start), rows))
        shards.close()
        yield from waiting

    rows = docs.select("doc_id", text)
    schema = rows.drop(text).select(
        "doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("digest"), F.lit("").alias("shard"),
        F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"),
    ).schema
    return settle(rows.mapInArrow(run, schema))


def _index(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", *INDEX])


def contents(index: DataFrame) -> DataFrame:
    """One row per payload: ``digest, shard, offset, length``, in reading order."""
    place = F.min(F.struct("shard", "offset", "length")).alias("p")
    return index.groupBy("digest").agg(place).select("digest", "p.*").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(batch: pa.RecordBatch, folder: str, most: int | None) -> Iterator[bytes]:
    """The stored bytes of each row, or the first ``most`` of them."""
    files, base = fs.FileSystem.from_uri(folder)
    name, file = None, None
    columns = [batch.column(c).to_pylist() for c in ("shard", "offset", "length")]
    for shard, offset, length in zip(*columns, strict=True):
        if shard != name:
            if file:
                file.close()
            name, file = shard, files.open_input_file(f"{base}/{shard}")
        file.seek(offset)
        yield file.read(min(length, most) if most else length)
    if file:
        file.close()


def with_headers(stored: DataFrame, folder: str) -> DataFrame:
    """The rows with ``width`` and ``height``; only headers are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [read_header(b) for b in _ranges(batch, folder, HEADER)]
            added = [pa.array([s[i] for s in sizes], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "width", "height"])

    schema = stored.withColumn("width", F.lit(0).cast("long")).withColumn("height", F.lit(0).cast("long")).schema
    return stored.mapInArrow(run, schema)


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the share of each of eight ranges, as text."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = int(counts @ values) / int(n)
    spread = (int(counts @ values**2) / int(n) - mean**2) ** 0.5
    shares = counts[counts > 0] / n
    entropy = float(-(shares * np.log2(shares)).sum())
    ranges = counts.reshape(8, 32).sum(1) / n
    return " ".join(f"{v:.5f}" for v in (mean, spread, abs(entropy), *ranges))


_READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def with_payloads(stored: DataFrame, folder: str) -> DataFrame:
    """The rows with figures of the payload as read back, and of its stored form."""
    names = [c.split()[0] for c in _READ.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for picture in _ranges(batch, folder, None):
                data = from_picture(picture)
                sha = hashlib.sha256(data).hexdigest()
                rows.append((len(data), sha, zlib.crc32(data[-16:]), len(picture), hashlib.sha256(picture).hexdigest(), feature(data)))
            added = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    return stored.mapInArrow(run, f"{ddl}, {_READ}")


def payloads(stored: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """``digest`` and the stored payload as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                texts = [from_picture(p).decode() for p in _ranges(part, folder, None)]
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(texts, pa.string())], names=["digest", text])

    return stored.mapInArrow(run, f"digest binary, {text} string")


def op6(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "media")
    index = store(read(spark, sf_dir, "documents", "doc_id", "text"), folder)
    known = settle(with_payloads(with_headers(contents(index), folder), folder).drop("shard", "offset", "length"))
    return index.drop("shard", "offset", "length").join(known, "digest").drop("digest")
