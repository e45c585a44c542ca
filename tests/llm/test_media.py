"""Shards and rows: exact round trip, ranges, and equal payloads."""

from __future__ import annotations

import hashlib
import io
import tarfile
import zlib

import pytest
from pyarrow import fs

from spatialframes.llm import media
from spatialframes.session import fresh_path

TEXTS = [None, "", "a", "a" * 192, "a" * 193, "é" * 200, "same", "same", "same  ", "\n" * 5, "x" * 300_000, " "]


def test_pictures():
    for text in TEXTS:
        n, payload = media.payload_of(text)
        assert n == len((text or "").encode()) and payload.rstrip(b" ") == (text or "").encode().rstrip(b" ") and len(payload) % 192 == 0 < len(payload)
        picture = media.to_picture(payload)
        assert media.from_picture(picture) == payload
        assert media.read_header(picture[: media.HEADER]) == (192, len(payload) // 192)
    broken = bytearray(media.to_picture(b" " * 192))
    broken[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_picture(bytes(broken))


@pytest.mark.parametrize("shard_bytes", [600, 64_000_000])
def test_store_and_read(spark, shard_bytes):
    folder = fresh_path(spark, "media")
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, digest string")
    index = media.store(docs, folder, shard_bytes=shard_bytes)
    assert index.count() == len(TEXTS)
    stored = media.contents(index)
    read = media.with_payloads(media.with_headers(stored, folder), folder)
    by = {r["payload_sha256"]: r for r in read.collect()}
    for r in index.collect():
        text = TEXTS[3 if r["doc_id"] is None else r["doc_id"]]
        n, payload = media.payload_of(text)
        own = by[hashlib.sha256(payload).hexdigest()]
        assert r["n_bytes"] == n and bytes(r["digest"]).hex() == own["payload_sha256"]
        assert (own["payload_bytes"], own["tail_crc32"], own["width"], own["height"]) == (len(payload), zlib.crc32(payload[-16:]), 192, len(payload) // 192)
        assert own["media_sha256"] == hashlib.sha256(media.to_picture(payload)).hexdigest() and own["feature"] == media.feature(payload)
    assert {r["text"] for r in media.payloads(stored, folder).collect()} == {media.payload_of(t)[1].decode() for t in TEXTS}
    # any tar reader opens the shards, and the rows' offsets are theirs
    store, base = fs.FileSystem.from_uri(folder)
    places = {(r["shard"], r["offset"]): (bytes(r["digest"]).hex(), r["length"]) for r in index.collect()}
    for shard in {s for s, _ in places}:
        with tarfile.open(fileobj=io.BytesIO(store.open_input_file(f"{base}/{shard}").read())) as tar:
            for entry in tar:
                assert places[(shard, entry.offset_data)] == (entry.name.removesuffix(".png"), entry.size)


def test_empty(spark):
    folder = fresh_path(spark, "media")
    index = media.store(spark.createDataFrame([], "doc_id long, text string"), folder)
    assert media.with_payloads(media.contents(index), folder).count() == 0
