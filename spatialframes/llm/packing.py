"""Mixture-controlled packing: token sequences that hold their sources in target proportions.

A document is its token ids and a closing id. Documents are dealt to *shards* of about
``tokens_per_shard`` tokens by the digest of their id and text. In a shard every source is a queue of
documents, and windows are filled by deficit round-robin: each window adds ``window * share`` tokens
to the credit of every source, a source is served while its credit allows at least ``least_piece``
tokens, and what a window still lacks goes to the sources with the largest credit. What a source got
too much or too little goes on to the next window, and from shard to shard: the credit a shard starts
with is what the shards before it owe each source, known from token counts alone.

Shares are the caller's targets, or those of all tokens; with these every queue runs dry at the end. With targets
windows hold them while all sources last, and then what is left. No token is left over.
The tokens that do not fill a last window of a shard are cut into sequences of powers of two, which
need no padding; all other sequences are full.

The ids are written once to the shared folder. Shuffled are the ids of a shard (two bytes each); a
shard is bounded by its size and the longest document, whatever the skew of sources or of copies.

Defined results: a null text is empty and gives the closing id alone; a null source is a source of
its own; rows that repeat are documents of their own; an empty table gives no rows. Columns of the
input other than the id, the text and the source are not returned.
"""

from __future__ import annotations

import zlib
from array import array
from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.llm.common import read, slices
from spatialframes.session import settle

WINDOW = 2048
CLOSING = 1
_HELD = 200_000  # parts of words whose ids a worker remembers, twice
_SLICE = 4_000_000  # bytes of text whose words are numbered at once, in ten times that memory
_JOINED = 1000  # parts that the model is given at once
_LETTER, _DIGIT, _SIGN, _ODD = range(4)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every byte its kind and its lower case; letters of two bytes are not told here."""
    kinds, lower = np.full(256, _ODD, np.uint8), np.arange(256, dtype=np.uint8)
    for b in range(33, 127):
        c = chr(b)
        if c not in "'<":
            kinds[b] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SIGN
        lower[b] = ord(c.lower())
    return kinds, lower


_KIND, _LOWER = _kinds()


def _byte_letters() -> np.ndarray:
    """The letter that byte-level vocabularies write for a byte: itself if it is printable, else the
    next free one from 256 on. A space stays."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    letters = np.arange(256, dtype="<u4")
    letters[hidden] = 256 + np.arange(len(hidden))
    letters[32] = 32
    return letters


_LETTERS = _byte_letters()


class WordIds:
    """Ids of words, two bytes to an id; words between white space do not depend on each other.

    Words of ASCII and of Latin letters are cut into their parts, runs of letters, single digits and runs of
    signs, which need no normalising; any other word goes through the whole tokenizer.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(file)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need two bytes")
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.known: dict[str, bytes] = {}  # parts seen of late, and before these
        self.older: dict[str, bytes] = {}

    def modelled(self, parts: list[str]) -> Iterator[bytes]:
        """The ids of parts that need no normalising."""
        letters = _LETTERS[np.frombuffer(" ".join(parts).encode(), np.uint8)].tobytes().decode("utf-32-le")
        done = self.model.encode(letters, add_special_tokens=False)
        cuts = np.cumsum(np.bincount(done.word_ids, minlength=len(parts)) * 2).tolist()
        ids = np.array(done.ids, np.uint16).tobytes()
        return (ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False))

    def parts(self, parts: list[str], whole: np.ndarray) -> list[bytes]:
        """The ids of distinct parts; those that are ``whole`` go through the whole tokenizer."""
        if len(self.known) > _HELD:
            self.known, self.older = {}, self.known
        known, new = self.known, []
        for part, odd in zip(parts, whole.tolist(), strict=True):
            if part not in known:
                if (found := self.older.get(part)) is not None:
                    known[part] = found
                elif odd:
                    known[part] = array("H", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
                else:
                    new.append(part)
        for i in range(0, len(new), _JOINED):
            some = new[i : i + _JOINED]
            known.update(zip(some, self.modelled(some), strict=True))
        return [*map(known.__getitem__, parts)]

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the number of ids of each."""
        words = words.cast(pa.string())
        lengths = np.asarray(pa.compute.binary_length(words), np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        if not offsets[-1]:
            return np.empty(0, np.uint16), np.zeros(len(words), np.int32)
        first = np.frombuffer(words.buffers()[1], np.int32)[words.offset]
        data = np.frombuffer(words.buffers()[2], np.uint8)[first : first + offsets[-1]]
        kind, low = _KIND[data], _LOWER[data]
        # the letters from U+00C0 to U+00FF but for the two signs among them
        lead = np.flatnonzero(data == 0xC3)
        second = data[lead + 1]
        lead, second = (x[(second != 0x97) & (second != 0xB7)] for x in (lead, second))
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] = second | np.where(second < 0x9F, 0x20, 0).astype(np.uint8)
        # what is odd or long stays one part as it is
        upto = np.concatenate([[0], np.cumsum(kind == _ODD)])[offsets]
        whole = np.repeat((upto[1:] > upto[:-1]) | (lengths >= 100), lengths)
        low[whole] = data[whole]
        begins = np.empty(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[whole] = False
        begins[offsets[:-1][lengths > 0]] = True
        cuts = np.append(np.flatnonzero(begins), len(data)).astype(np.int32)
        parts = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(low)).dictionary_encode()
        odd = np.zeros(len(parts.dictionary), bool)
        number = np.asarray(parts.indices)
        odd[number[whole[cuts[:-1]]]] = True
        known = self.parts(parts.dictionary.to_numpy(zero_copy_only=False).tolist(), odd)
        ids, size = _gathered(np.frombuffer(b"".join(known), np.uint16), np.fromiter(map(len, known), np.int32, len(known)) // 2, number)
        ends = np.concatenate([[0], np.cumsum(size)])
        ends = ends[np.concatenate([[0], np.cumsum(begins)])[offsets]]
        return ids, np.diff(ends).astype(np.int32)

    def texts(self, texts: list[str | None]) -> list[bytes]:
        return self.column(pa.array(texts, pa.string())).to_pylist()

    def column(self, texts: pa.Array) -> pa.Array:
        """The ids of every text with the closing id, as binary.

        A batch's distinct words are looked up once, and the ids of its words are gathered by their numbers.
        """
        lists = pa.compute.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        known, size = self.words(words.dictionary)
        known, size = np.append(known, np.uint16(CLOSING)), np.append(size, np.int32(1))
        # a closing word after the last word of every text
        ends = np.cumsum(np.asarray(pa.compute.list_value_length(lists), dtype=np.int64))
        number = np.insert(np.asarray(words.indices, dtype=np.int32), ends, len(size) - 1)
        flat, size = _gathered(known, size, number)
        upto = np.cumsum(size, dtype=np.int32)
        cuts = np.concatenate([[0], upto[ends + np.arange(len(ends))]]) * 2
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat)])


def _gathered(ids: np.ndarray, sizes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of numbered items, of which each has its size in ``ids``, and the size of every one."""
    start = np.cumsum(sizes, dtype=np.int32) - sizes
    size = sizes[number]
    upto = np.cumsum(size, dtype=np.int32)
    place = np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)
    place += np.repeat(start[number] - upto + size, size)
    return ids[place], size


_KNOWN: dict[str, WordIds] = {}  # a worker process serves one task after the other


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(docs: DataFrame, text: str, file: str | None = None) -> DataFrame:
    """The rows with ``__ids`` (binary, two bytes to an id) instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file or word_file()
        if name not in _KNOWN:
            _KNOWN[name] = WordIds(name)
        yield from _with_ids(batches, text, _KNOWN[name])

    schema = docs.drop(text).withColumn("__ids", F.lit(b"")).schema
    return docs.mapInArrow(run, schema)


def _with_ids(batches: Iterator[pa.RecordBatch], text: str, ids: WordIds) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text, _SLICE):
        found = ids.column(batch.column(text))
        names = [c for c in batch.schema.names if c != text]
        columns = [batch.column(c) for c in names] + [found]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "__ids"])


def fill(queues: dict[str, deque], shares: dict[str, float], credit: dict[str, float], window: int, least_piece: int):
    """Windows as lists of ``(document, start, length)`` by deficit round-robin.

    ``queues`` holds ``[document, start, left]`` entries and is emptied; full windows come first, the
    last one may be short.
    """
    names = sorted(queues)
    left = {s: sum(d[2] for d in queues[s]) for s in names}
    rest = sum(left.values())
    turn = 0
    while rest:
        room, pieces = min(window, rest), []

        def serve(source: str, most: int) -> int:
            given, queue = 0, queues[source]
            while given < most and queue:
                doc = queue[0]
                n = min(doc[2], most - given)
                pieces.append((doc[0], doc[1], n))
                given += n
                if n == doc[2]:
                    queue.popleft()
                else:
                    doc[1] += n
                    doc[2] -= n
            left[source] -= given
            credit[source] -= given
            return given

        for source in names:
            credit[source] += room * shares[source]
        for i in range(len(names)):
            source = names[(turn + i) % len(names)]
            if room and left[source] and credit[source] >= min(least_piece, left[source]):
                room -= serve(source, min(room, int(credit[source])))
        while room:  # what the round left open, to those that are owed most
            source = max((s for s in names if left[s]), key=credit.__getitem__)
            room -= serve(source, min(room, max(least_piece, int(credit[source]))))
        turn += 1
        rest -= sum(p[2] for p in pieces)
        names = [s for s in names if left[s]] or names
        yield pieces


def sequences(pieces: list[tuple], window: int) -> list[list[tuple]]:
    """A full window is one sequence; a short one is cut into powers of two."""
    total = sum(p[2] for p in pieces)
    sizes = [window] if total == window else [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    out, waiting = [], deque([list(p) for p in pieces])
    for size in sizes:
        own = []
        while size:
            doc, start, n = waiting[0]
            take = min(n, size)
            own.append((doc, start, take))
            size -= take
            if take == n:
                waiting.popleft()
            else:
                waiting[0] = [doc, start + take, n - take]
        out.append(own)
    return out


PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def pack(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    window: int = WINDOW,
    least_piece: int = 64,
    tokens_per_shard: int = 1 << 21,
    file: str | None = None,
    targets: Mapping[str | None, float] | None = None,
) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``.

    ``targets`` are the sources' proportions in a window, any positive numbers; a source that is not named has none
    and is packed when the others have run dry. Without them they are those of all tokens.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    rows = rows.withColumn("__order", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")))
    tokens = settle(tokenize(rows, "text", file).withColumn("__row", F.monotonically_increasing_id()))
    tokens = tokens.withColumn("__n", (F.octet_length("__ids") / 2).cast("long"))
    whole = tokens.agg(F.sum("__n")).first()[0] or 0
    shards = max(1, -(-whole // tokens_per_shard))
    # rows that repeat have the same order, so the row number deals them out too
    tokens = tokens.withColumn("__shard", F.pmod(F.xxhash64("__order", "__row"), F.lit(shards)))

    # what the shards before a shard owe each source: its share of their tokens less what they have of it
    held = settle(tokens.groupBy("__shard", "source").agg(F.sum("__n").alias("n")))
    totals = held.groupBy("__shard").agg(F.sum("n").alias("shard_n"))
    before = Window.orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__shard", F.coalesce(F.sum("shard_n").over(before), F.lit(0)).alias("before_n"))
    if targets is None:
        share = held.groupBy("source").agg((F.sum("n") / F.lit(float(max(whole, 1)))).alias("share"))
    else:
        asked = [(s, float(t) / sum(targets.values())) for s, t in targets.items()]
        asked = docs.sparkSession.createDataFrame(asked, "__a string, share double")
        share = held.select("source").distinct().join(asked, F.col("source").eqNullSafe(F.col("__a")), "left")
        share = share.select("source", F.coalesce("share", F.lit(0.0)).alias("share"))
    own = Window.partitionBy("source").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    owed = held.select("__shard", "source", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("had"))
    owed = owed.join(totals, "__shard").join(share.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
    # with targets a shard's last windows hold what is left of some source, which no later shard can make up for
    credit = F.col("share") * F.col("before_n") - F.col("had") if targets is None else F.lit(0.0)
    owed = owed.select("__shard", F.lit(None).cast("string").alias("doc_id"), "source", F.lit(None).cast("binary").alias("__ids"),
                       F.lit(None).cast("long").alias("__row"), "share", credit.alias("credit"))
    data = tokens.select("__shard", F.col("doc_id").cast("string").alias("doc_id"), "source", "__ids", "__row",
                         F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("credit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            number = batch.column("__shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and number[a] != shard:
                    yield from _packed(int(shard), held, window, least_piece)
                    held = []
                shard = number[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from _packed(int(shard), held, window, least_piece)

    dealt = data.unionByName(owed).repartition(int(shards), "__shard").sortWithinPartitions("__shard", "source", "__row")
    packed = dealt.mapInArrow(run, PIECES.format(id="string"))
    return packed.withColumn("doc_id", F.col("doc_id").cast(id_type))


def _packed(shard: int, batches: list[pa.RecordBatch], window: int, least_piece: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    names = [s if s is None else "=" + s for s in table["source"].to_pylist()]
    ids, doc_ids = table["__ids"].to_pylist(), table["doc_id"].to_pylist()
    shares, credit, queues = {}, {}, {}
    for i, (name, data, share, owed) in enumerate(zip(names, ids, table["share"].to_pylist(), table["credit"].to_pylist(), strict=True)):
        name = name or ""
        if data is None:
            shares[name], credit[name] = share, owed
        else:
            queues.setdefault(name, deque()).append([i, 0, len(data) // 2])
    wide: dict[int, memoryview] = {}  # ids in four bytes, of the documents that are being served

    def crc(i: int, start: int, n: int) -> int:
        data = wide.get(i)
        if data is None:
            data = wide[i] = memoryview(np.frombuffer(ids[i], np.uint16).astype("<u4").tobytes())
        if 2 * (start + n) == len(ids[i]):
            del wide[i]
        return zlib.crc32(data[4 * start : 4 * (start + n)])

    rows, number = [], shard << 32
    for pieces in fill(queues, shares, credit, window, least_piece):
        for sequence in sequences(pieces, window):
            offset = 0
            for i, start, n in sequence:
                rows.append((doc_ids[i], start, n, crc(i, start, n), len(ids[i]) // 2, number, offset, names[i] and names[i][1:]))
                offset += n
            number += 1
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PIECES.split(", ")])


def op8(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "source", "text"))
