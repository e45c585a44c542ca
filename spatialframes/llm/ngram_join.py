"""N-gram Jaccard join by signature trees; its result is complete.

A document's set holds the hashes of its word n-grams. Equal sets are one *node* of the work below;
it is named by 63 bits of the set's digest.

1. **Order.** A fixed-size table of counters, summed over all documents, tells frequent n-grams from
   rare ones. N-grams are ordered by its level, then by hash. The result does not depend on the order.
2. **Blocks.** Two sets that are alike share ``k`` n-grams among the first ``n - ceil(limit * n) + k``
   of either in that order (``SHARED``). Only these are shuffled, one row each. An n-gram of a single node, or of
   nodes whose sizes rule each other out, is dropped. The smallest node of a block is its hub.
3. **Groups.** A node joins the group of the hub it shares most blocks with, so near copies meet once
   and not once for each n-gram that they share. A group is joined by a signature tree (see
   ``signature_tree``); a large one is cut into chunks, every two of which meet in a task of their own.
4. **Rest.** A block whose nodes are linked by now, or all of one group, is done, and so is a node that
   is in fewer than ``k`` of the blocks left; any other leaves its ``k - 1`` largest blocks, as a pair that shares
   ``k`` still meets in the first of them. What remains is joined block by block with trees over the bitmaps alone;
   the few pairs that these cannot rule out are then compared by their sets.
5. **Components** of all links, by alternating stars: linear in the links, a few rounds.

With ``count_links`` the links are counted: nothing is left out for being connected already, and a block is
open unless it is all of one group. A pair of nodes meets in one group at most, and in the rest only if it
met in none, so each task adds up the links of its nodes and gives, besides these sums, only the links
that connect. Within a group most links follow from the distances to the hub and are counted by rank; only
pairs that these and the tree leave open are compared. What the rest links is given as links between
the components of the groups. So no table has a row for every link of a group of near copies. Without
``count_links`` only what connects is looked for.

No stage holds a block, group or component whole: blocks and groups are read in chunks of
``CHUNK_TOKENS`` tokens, hubs are streamed. Broadcast are the counters' levels (one byte each) and a
bitmap of ids of fixed size, which only spares work.

Defined results: texts without words, and null texts, are empty, with 0 n-grams, and linked with
nothing, not with each other; a text with fewer words than an n-gram is one n-gram; documents with
equal sets are linked; rows with equal ids are documents of their own, and a component's id is its
smallest id, null if it has none; an empty table gives no rows. Other columns are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from spatialframes.llm import signature_tree as tree
from spatialframes.llm.common import combined, read, signed, slices, word_hashes
from spatialframes.session import settle

SKETCH_BITS = 20
FILTER_BITS = 22
CHUNK_TOKENS = 1 << 20
SHARED = 4  # blocks that a pair must share, where its sets are large enough
_FEW = 12  # nodes of a block that are compared without a tree
_PART = 1 << 12  # counters to a row while they are summed up


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes; ASCII letters are lower-cased."""
    words = word_hashes((text or "").encode().lower())
    return np.unique(combined(words, n))


def _node(own: np.ndarray) -> int:
    return xxh3_64_intdigest(own.tobytes()) >> 1


def count(docs: DataFrame, text: str, n: int) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, size, node`` of every document, and how frequent the n-grams of each counter are: 0,
    or the binary logarithm of their number."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids = np.zeros(1 << SKETCH_BITS, np.uint32), None
        names = ["doc_id", "size", "node", "part", "counts"]
        for batch in slices(batches, "__text"):
            sets = [ngrams(t, n) for t in batch.column("__text").to_pylist()]
            places = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            counts += np.bincount(places, minlength=len(counts)).astype(np.uint32)
            ids = batch.column("doc_id")
            none = [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, sets), pa.int64()), pa.array(map(_node, sets), pa.int64()), *none], names=names)
        if ids is not None:
            parts = [c.tobytes() for c in counts.reshape(-1, _PART)]
            none = [pa.nulls(len(parts), t) for t in (ids.type, pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(data, np.uint32).astype(np.uint64)
        rows = {p: np.where(s > 0, np.log2(np.maximum(s, 1)), 0).astype(np.uint8).tobytes() for p, s in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(list(rows.values()), pa.binary())], names=["part", "levels"])

    rows = docs.select("doc_id", F.col(text).alias("__text"))
    both = settle(rows.mapInArrow(run, f"doc_id {kind}, size long, node long, part int, counts binary"))
    parts = both.where("part is not null").select("part", "counts")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in parts.repartition("part").mapInArrow(add, "part int, levels binary").collect():  # a byte per counter in all
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["levels"], np.uint8)
    # what a counter holds by chance is no sign of a frequent n-gram
    usual = int(np.median(out)) + 2
    return both.where("part is null").select("doc_id", "size", "node"), np.where(out >= usual, out, 0).astype(np.uint8)


def shared_least(size: int, percent: int) -> int:
    """Blocks that a pair of this size must share."""
    return min(SHARED, -(-percent * size // 100))


def prefix_size(size: int, percent: int) -> int:
    """Two sets of this size that are alike share ``shared_least`` n-grams among so many of either."""
    return size - -(-percent * size // 100) + shared_least(size, percent)


def prefixes(docs: DataFrame, text: str, n: int, percent: int, level: np.ndarray) -> DataFrame:
    """``token, size, node``: the first n-grams of every set. A task gives the rows of a set once."""
    shared = docs.sparkSession.sparkContext.broadcast(level.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = np.frombuffer(shared.value, np.uint8), set()
        for batch in slices(batches, text):
            tokens, sizes, nodes = [np.zeros(0, np.uint64)], [], []
            for t in batch.column(text).to_pylist():
                own = ngrams(t, n)
                node = _node(own)
                if not len(own) or node in seen:
                    continue
                seen.add(node)
                rank = known[(own >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                tokens.append(own[np.argsort(rank, kind="stable")[: prefix_size(len(own), percent)]])
                sizes.append(len(own))
                nodes.append(node)
            reps = list(map(len, tokens[1:]))
            columns = [signed(np.concatenate(tokens)), np.repeat(np.array(sizes, np.int64), reps), np.repeat(np.array(nodes, np.int64), reps)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "size", "node"])

    return docs.select(text).mapInArrow(run, "token long, size long, node long")


def blocks(rows: DataFrame, percent: int) -> DataFrame:
    """``token, node, size, hub``: the rows of blocks in which a node has another of fitting size.

    ``rows`` has ``token, size, node``. They come by token and size; a row is compared with its
    neighbours, so no block is held. Rows of equal sets from several tasks become one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: token, size, node, and whether it fits the row before
        hub = (None, 0, 0)
        for batch in batches:
            token, size, node = (batch.column(c).to_numpy() for c in ("token", "size", "node"))
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            if held is not None and len(token):
                fresh[0] = held[0] != token[0] or held[2] != node[0]
            token, size, node = token[fresh], size[fresh], node[fresh]
            if not len(token):
                continue
            fits = np.zeros(len(token) + 1, bool)
            fits[1:-1] = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
            if held is not None:
                fits[0] = held[0] == token[0] and 100 * held[1] >= percent * size[0]
            rows = [held[:3]] if held is not None and (held[3] or fits[0]) else []
            live = np.flatnonzero(fits[:-1] | fits[1:])
            live = live[live < len(token) - 1]
            rows += zip(token[live].tolist(), size[live].tolist(), node[live].tolist(), strict=True)
            held = (int(token[-1]), int(size[-1]), int(node[-1]), bool(fits[len(token) - 1]))
            out, hub = _with_hubs(rows, hub, percent)
            yield out
        if held is not None and held[3]:
            yield _with_hubs([held[:3]], hub, percent)[0]

    return rows.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(run, "token long, node long, size long, hub long")


def _with_hubs(rows: list[tuple], hub: tuple, percent: int) -> tuple[pa.RecordBatch, tuple]:
    hubs = []
    for token, size, node in rows:
        if token != hub[0] or 100 * hub[1] < percent * size:
            hub = (token, size, node)
        hubs.append(hub[2])
    columns = [[r[0] for r in rows], [r[2] for r in rows], [r[1] for r in rows], hubs]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "node", "size", "hub"]), hub


def sets_of(docs: DataFrame, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """``node, copies, tokens, bits`` of the nodes of ``wanted`` (``node, doc, copies``), read from the texts again.

    Documents are first told by a bitmap of fixed size over the ids wanted, then exactly by a join.
    """
    code = F.pmod(F.xxhash64(F.col("doc").cast("string")), F.lit(1 << FILTER_BITS))
    bits = wanted.select(F.bitmap_bucket_number(code + 1).alias("b"), F.bitmap_bit_position(code + 1).alias("p"))
    bits = bits.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()  # 4 KB a row, 128 rows
    bitmap = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in bits:
        bitmap[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches, "__text"):
            place = batch.column("__code").to_numpy()
            chosen = np.flatnonzero(known[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            own = [ngrams(batch.column("__text")[int(i)].as_py(), n) for i in chosen]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            flat = signed(np.concatenate([*own, np.zeros(0, np.uint64)]))
            bits = pa.array([tree.bitmap(s, min(tree.width(len(s), 4), 512)).tobytes() for s in own], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, own), pa.int64()), pa.ListArray.from_arrays(ends, flat), bits], names=["node", "tokens", "bits"])

    rows = docs.withColumn("doc", F.col("doc_id")).select(code.alias("__code"), F.col(text).alias("__text"))
    found = rows.mapInArrow(run, "node long, tokens array<long>, bits binary").join(wanted.select("node", "copies"), "node")
    # copies of a set come with the same id only where rows repeat
    return found.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("copies", "tokens", "bits")])


def join_groups(groups: DataFrame, sets: DataFrame, percent: int, chunk_tokens: int, want: str = "connected") -> DataFrame:
    """Links ``a, b`` that connect what is alike within each group of ``groups`` (``hub, node, size``).

    ``want`` "every": besides them rows with ``n`` and without ``b``, whose sum is the number of documents
    that node ``a`` is linked with in the group; "hub": the same for links with the hub only, and the links
    are those between the ``comp`` of the nodes, which ``groups`` must have then.
    """
    sums = groups.groupBy("hub").agg(F.sum("size").alias("all"))
    sums = sums.select("hub", F.ceil(F.col("all") / chunk_tokens).cast("int").alias("chunks"))
    rows = groups.join(sums, "hub").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # a chunk meets every chunk; a group of one chunk meets itself only, the hub comes with every pair
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    every = F.flatten(F.transform(others, lambda i: F.transform(F.sequence(i, F.col("chunks") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    own = F.transform(others, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    if want == "hub":
        every = F.transform(others, lambda k: F.struct(k.alias("i"), k.alias("j")))
        own = F.array(F.struct(F.col("own").alias("i"), F.col("own").alias("j")))
    comp = F.col("comp") if want == "hub" else F.lit(None).cast("long").alias("comp")
    rows = rows.select("hub", "node", "own", comp, F.explode(F.when(F.col("hub") == F.col("node"), every).otherwise(own)).alias("t"))
    rows = rows.join(sets, "node").select("hub", "t.i", "t.j", (F.col("node") != F.col("hub")).alias("other"), "node", "tokens", "own", "copies", "comp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, sets_ = None, [], []  # the hub is first

        def linked() -> pa.RecordBatch:
            nodes, chunk, copies, comp = zip(*held, strict=True)
            weights, n = np.array(copies, np.int64), np.zeros(0, np.int64)
            if want == "connected":
                hub = 0 if nodes[0] == key[0] else None
                found = [(nodes[i], nodes[j]) for i, j in tree.join(sets_, percent, hub)]
            elif want == "hub":
                alike = [i for i in range(1, len(nodes)) if tree.alike(sets_[0], sets_[i], percent)]
                found = sorted({(comp[0], comp[i]) for i in alike if comp[i] != comp[0]})
                n = np.zeros(len(nodes), np.int64)
                n[alike] = weights[0]
                n[0] = weights[alike].sum()
            elif key[1] == key[2]:
                found, n = tree.tally(sets_[0], sets_, weights, percent)
                found = [(nodes[i], nodes[j]) for i, j in found]
            else:
                # two nodes of one chunk, and the hub and any other, meet where a chunk meets itself
                found, n = tree.tally(sets_[0], sets_[1:], weights[1:], percent, np.array(chunk[1:]))
                nodes = nodes[1:]
                found = [(nodes[i], nodes[j]) for i, j in found]
            some = np.flatnonzero(n)
            a = [p[0] for p in found] + [nodes[i] for i in some]
            b = [p[1] for p in found] + [None] * len(some)
            columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(found) + n[some].tolist(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("hub", "i", "j")), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in ("node", "own", "copies", "comp")), strict=True)
            tokens = batch.column("tokens")
            for r, (own, value) in enumerate(zip(keys, values, strict=True)):
                if own != key:
                    if len(held) > 1:
                        yield linked()
                    key, held, sets_ = own, [], []
                held.append(value)
                sets_.append(tokens[r].values.to_numpy().view(np.uint64))
        if len(held) > 1:
            yield linked()

    ordered = rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "other", "node")
    return ordered.mapInArrow(run, "a long, b long, n long")


def rest_pairs(rows: DataFrame, maps: DataFrame, percent: int, chunk_rows: int) -> DataFrame:
    """Pairs ``a, b`` of nodes in open blocks that bitmaps cannot rule out.

    ``rows`` has ``token, node, size, comp, grp``, and ``maps`` the nodes' ``bits``, which are dealt once, when it
    is known where a row goes; nodes of one component or group need no pair, nor do a node and the hub of its group.
    """
    sums = rows.groupBy("token").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    cut = rows.join(sums, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    cut = cut.select("token", "node", "size", "comp", "grp", F.explode(own).alias("t"))
    cut = cut.join(maps, "node").select("token", "t.i", "t.j", "node", "size", "comp", "grp", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def fitting() -> pa.RecordBatch:
            sizes = np.array([h[1] for h in held], np.int64)
            out = [] if len(held) > _FEW else _few(held, percent)
            maps = [np.frombuffer(h[4], np.uint64) for h in held] if len(held) > _FEW else []
            # sizes that fit each other differ little: bands of sizes keep the bitmaps of a band alike in width
            for band in _bands(sizes, percent) if maps else ():
                words = min(len(maps[i]) for i in band)
                inner = tree.Links(len(band))
                first = {}
                for p, i in enumerate(band):
                    inner.join(first.setdefault(held[i][2], p), p)
                bits = np.stack([tree.fold(maps[i], words) for i in band])
                label = np.array([held[i][3] for i in band])
                may = [(held[band[p]], held[band[q]]) for p, q in tree.pairs(bits, sizes[band], percent, inner, label)]
                out += [(x[0], y[0]) for x, y in may if x[3] != y[0] and y[3] != x[0]]
            out = sorted({(min(p), max(p)) for p in out})
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("token", "i", "j")), strict=True))
            values = list(zip(*(batch.column(c).to_pylist() for c in ("node", "size", "comp", "grp", "bits")), strict=True))
            for own, value in zip(keys, values, strict=True):
                if own != key:
                    if len(held) > 1:
                        yield fitting()
                    key, held = own, []
                held.append(value)
        if len(held) > 1:
            yield fitting()

    ordered = cut.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "node")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def _few(held: list[tuple], percent: int) -> list[tuple[int, int]]:
    """The pairs of a block that is a single small leaf."""
    maps = [int.from_bytes(h[4], "little") for h in held]
    spare = [h[1] - m.bit_count() for h, m in zip(held, maps, strict=True)]
    out = []
    for p, (a, n, comp, grp, bits) in enumerate(held):
        for q in range(p):
            b, m, comp2, grp2, bits2 = held[q]
            if comp == comp2 or grp == grp2 or grp == b or grp2 == a or 100 * min(n, m) < percent * max(n, m):
                continue
            x, y, wide, wide2 = maps[p], maps[q], 8 * len(bits), 8 * len(bits2)
            while wide > wide2:
                wide //= 2
                x = x >> wide | x & ((1 << wide) - 1)
            while wide2 > wide:
                wide2 //= 2
                y = y >> wide2 | y & ((1 << wide2) - 1)
            # folding only adds shared bits: a lost bit is one more token that may be common
            lost = max(spare[p], n - x.bit_count()) if x != maps[p] else spare[p]
            lost2 = max(spare[q], m - y.bit_count()) if y != maps[q] else spare[q]
            if (x & y).bit_count() + min(lost, lost2) >= -(-percent * (n + m) // (100 + percent)):
                out.append((a, b))
    return out


def _bands(sizes: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Overlapping runs of sizes such that every two that fit each other are in one: from a size up to
    the largest that fits the largest one that fits it."""
    order = np.argsort(sizes, kind="stable")
    ordered = sizes[order]
    start = 0
    while start < len(order):
        reach = ordered[start] * 100 // percent  # largest that fits the smallest of the band
        far = reach * 100 // percent
        end = int(np.searchsorted(ordered, far, side="right"))
        yield order[start:end]
        if end == len(order):
            return
        start = int(np.searchsorted(ordered, reach, side="right"))


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` with the smallest node that links reach, for nodes that have links."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large.where("u <> v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        small = settle(small)
        # done when every node has one edge and no end of an edge has one of its own
        ends = small.select("u").unionByName(small.select(F.col("v").alias("u")).distinct())
        if ends.groupBy("u").count().where("count > 1").isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        edges = small


def link(docs: DataFrame, text: str = "text", n: int = 5, percent: int = 80, chunk_tokens: int = CHUNK_TOKENS, count_links: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; ``percent`` is the least Jaccard similarity.

    With ``count_links`` also ``n_links``, the number of other rows that the row is linked with, rows
    of an equal set included. ``docs`` is read five times.
    """
    docs = docs.select("doc_id", text)
    members, level = count(docs, text, n)
    nodes = members.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.any_value("size").alias("size"), F.count("*").alias("copies"))
    nodes = settle(nodes)
    wanted = nodes.select("node", "doc", "copies")
    rows = settle(blocks(prefixes(docs, text, n, percent, level), percent))

    shared = rows.where("node <> hub").groupBy("node", "hub", "size").agg(F.count("*").alias("c"))
    best = shared.groupBy("node", "size").agg(F.max(F.struct(F.col("c"), -F.col("hub"))).alias("b"))
    best = best.select((-F.col("b.col2")).alias("hub"), "node", "size", F.col("b.c").alias("c"))
    # few shared blocks say little; such pairs are left to the rest
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    best = settle(best.where(F.col("c") * 10 >= prefix).drop("c"))
    hubs = best.select(F.col("hub").alias("node")).distinct().join(nodes.select("node", "size"), "node")
    groups = settle(best.unionByName(hubs.select(F.col("node").alias("hub"), "node", "size")))
    sets = sets_of(docs, text, n, wanted.join(groups.select("node").distinct(), "node", "left_semi")).drop("bits")
    # the sets come grouped by node, as the join with them needs them
    links = settle(join_groups(groups, sets, percent, chunk_tokens, "every" if count_links else "connected"))
    found = components(links.where("b is not null"))

    # a hub belongs to its own group unless it has joined another
    labels = found.join(best.select("node", F.col("hub").alias("grp")), "node", "full")
    own = rows.select("token", "node", "size").join(labels, "node", "left")
    left = own.select("token", "node", "size", F.coalesce("comp", "node").alias("comp"), F.coalesce("grp", "node").alias("grp"))
    if count_links:  # being connected is not being linked
        left = left.withColumn("comp", F.col("node"))
    # a pair that has not met yet shares several open blocks: nodes with fewer are done, and with
    # them blocks that have no other nodes
    needed = F.least(F.lit(SHARED), F.ceil(F.ceil(F.col("size") * percent / 100) * percent / 100))
    left = settle(_open(left)).drop("held")
    left = left.withColumn("c", F.count("*").over(Window.partitionBy("node"))).where(F.col("c") >= needed).drop("c")
    left = settle(_open(_first(settle(_open(left)), needed)).drop("held"))
    if not left.isEmpty():
        # bitmaps of many nodes, and then the sets of the few that these leave
        maps = sets_of(docs, text, n, wanted.join(left.select("node").distinct(), "node", "left_semi")).select("node", "bits")
        more = settle(rest_pairs(left, maps, percent, max(64, chunk_tokens // 256)))
        ends = more.select(F.col("a").alias("node")).unionByName(more.select(F.col("b").alias("node"))).distinct()
        sets = sets_of(docs, text, n, wanted.join(ends, "node", "left_semi")).drop("bits")
        stars = more.select(F.col("a").alias("hub"), F.col("b").alias("node")).unionByName(more.select(F.col("a").alias("hub"), F.col("a").alias("node")).distinct())
        stars = stars.join(nodes.select("node", "size"), "node")
        if count_links:
            stars = stars.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            more = settle(join_groups(settle(stars), sets, percent, chunk_tokens, "hub"))
            later = components(more.where("b is not null")).select(F.col("node").alias("comp"), F.col("comp").alias("last"))
            found = nodes.select("node").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            found = found.join(later, "comp", "left").select("node", F.coalesce("last", "comp").alias("comp"))
            links = links.unionByName(more)
        else:
            more = join_groups(settle(stars.select("hub", "node", "size")), sets, percent, chunk_tokens)
            found = components(settle(links.unionByName(more)))

    named = nodes.select("node", "doc").join(found, "node", "left").select("node", "doc", F.coalesce("comp", "node").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("doc").alias("component_id"))
    named = settle(named.join(smallest, "comp").select("node", "component_id"))
    members = members.withColumn("node", F.when(F.col("size") > 0, F.col("node")))
    out = members.join(named, "node", "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    result = [F.col("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id")]
    if not count_links:
        return out.select(result)
    n = links.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    n = nodes.join(n, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return out.join(settle(n), "node", "left").select(*result, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _open(rows: DataFrame) -> DataFrame:
    """The rows of blocks that have nodes of several components and of several groups, with the number of rows
    ``held`` by the block."""
    sums = rows.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.count("*").alias("held"))
    return rows.join(sums.where("c0 < c1 and g0 < g1").select("token", "held"), "token")


def _first(rows: DataFrame, needed: Column) -> DataFrame:
    """The rows of every node but those of its ``needed - 1`` largest blocks.

    Of ``needed`` blocks that two nodes share, the first in an order that all nodes have in common has
    ``needed - 1`` after it in either node, so it is among the rows of both.
    """
    last = Window.partitionBy("node").orderBy(F.desc("held"), F.desc("token"))
    return rows.withColumn("r", F.row_number().over(last)).where(F.col("r") >= needed).drop("r", "held")


def op1(spark, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents", "doc_id", "text"), n=4, percent=85, count_links=True)
