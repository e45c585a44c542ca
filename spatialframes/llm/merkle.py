"""Merkle manifest of a dataset: a digest of every row, a tree for each group, one root, and a proof for every row.

Leaves of a group stand in order; while there are several, every ``fanout`` consecutive ones become the
digest of their concatenation. The groups' roots, in order, become the dataset's root in the same way.

A leaf's place is a number, and its digits to the base ``fanout`` name its ancestors. A block holds the leaves
that differ in the last ``digits`` digits only. Within a block the digit columns are grouped away one by
one, each time nesting the children's structs in their parent's, all in one stage after one exchange by
block. The digests of the blocks are the leaves of the tier above. From the top tier down, a transform of the
nested structs hands every child what stands left and right of it on each level, and an explode emits the
children with the whole path; a tier's rows meet the paths of their blocks by grouping on the block. A block
is bounded, a tier has ``fanout ** digits`` times fewer rows than the one below, and texts never move.

Places are counted after a range partitioning, so no group, whatever its size, is sorted in one task.

Defined results: null fields are ``-`` in a leaf; a null group is the first group; null order keys come first, ties
are broken by the leaf, so that rows alike are alike in any order; a single leaf is its group's root; an empty
table gives no rows; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatialframes.session import settle

FANOUT = 3
DIGITS = 6  # 729 leaves a block
_PATH = "array<struct<left:string,right:string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as byte count, colon and text, or ``-`` for null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, from left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda low, p: F.sha2(F.concat(p["left"], low, p["right"]), 256))


def placed(rows: DataFrame, tree: str, order: Sequence[Column]) -> DataFrame:
    """The rows with ``__rank``, their place among the rows of their ``tree`` from 0, and ``__n``, how many it has."""
    keys = [F.col(tree), *order]
    rows = settle(rows.withColumn("__tie", F.monotonically_increasing_id()))
    ranged = rows.repartitionByRange(*keys, F.col("__tie")).sortWithinPartitions(*keys, F.col("__tie"))
    ranged = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    ranged = settle(ranged.drop("__tie"))
    # one row a partition and group that meet
    counts = ranged.groupBy(tree, "__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__from"))
    group = Window.partitionBy(tree)
    before = F.sum("__rows").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(
        tree, "__part", (F.coalesce(before, F.lit(0)) - F.col("__from")).alias("__shift"), F.sum("__rows").over(group).alias("__n")
    )
    out = ranged.join(settle(counts), [tree, "__part"])
    return out.withColumn("__rank", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def rollup(leaves: DataFrame, fanout: int = FANOUT, digits: int = DIGITS) -> DataFrame:
    """``tree, n, block, node`` from ``tree, n, rank, node(digest, ...)``: the blocks with their nested nodes.

    ``n`` is the number of nodes of the tree on this tier. A level on which the tree has one node adds nothing.
    """
    place = [F.floor(F.col("rank") / F.lit(fanout**i)) % fanout for i in range(digits)]
    names = [f"d{i}" for i in range(digits)]
    block = F.floor(F.col("rank") / F.lit(fanout**digits))
    rows = leaves.select("tree", "n", block.alias("block"), *[p.cast("int").alias(d) for p, d in zip(place, names)], "node")
    rows = rows.repartition("tree", "block")
    for level in range(digits):
        children = F.array_sort(F.collect_list(F.struct(F.col(names[level]).alias("at"), "node")))
        rows = rows.groupBy("tree", "n", "block", *names[level + 1 :]).agg(children.alias("nodes"))
        nodes = F.transform("nodes", lambda c: c["node"])
        joined = F.concat_ws("", F.transform("nodes", lambda c: c["node"]["digest"]))
        several = F.col("n") > fanout**level
        digest = F.when(several, F.sha2(joined, 256)).otherwise(F.get("nodes", F.lit(0))["node"]["digest"])
        rows = rows.select("tree", "n", "block", *names[level + 1 :], F.struct(digest.alias("digest"), nodes.alias("nodes")).alias("node"))
    return rows


def _emit(node: Column, n: Column, path: Column, level: int, fanout: int) -> Column:
    """Array of the leaves below a nested node, each with its path from the leaf up."""
    if level == 0:
        return F.array(F.struct(node.alias("leaf"), path.alias("path")))
    digests = F.transform(node["nodes"], lambda c: c["digest"])

    def child(c: Column, i: Column) -> Column:
        left = F.concat_ws("", F.slice(digests, F.lit(1), i))
        right = F.concat_ws("", F.slice(digests, i + 2, F.lit(fanout)))
        own = F.array(F.struct(left.alias("left"), right.alias("right")))
        own = F.when(n > fanout ** (level - 1), own).otherwise(F.array().cast(_PATH))
        return _emit(c, n, F.concat(own, path), level - 1, fanout)

    return F.flatten(F.transform(node["nodes"], child))


def descend(blocks: DataFrame, paths: DataFrame, fanout: int = FANOUT, digits: int = DIGITS) -> DataFrame:
    """``tree, n, leaf, path, top`` of the leaves of blocks, given ``tree, block, path, top`` of the blocks.

    Block and path meet by grouping; the leaves come out of their block's struct.
    """
    low = blocks.select("tree", "block", F.struct("n", "node").alias("low"))
    high = paths.select("tree", "block", F.struct("path", "top").alias("high"))
    met = low.unionByName(high, allowMissingColumns=True).groupBy("tree", "block")
    met = met.agg(F.first("low", ignorenulls=True).alias("low"), F.first("high", ignorenulls=True).alias("high"))
    leaves = _emit(F.col("low.node"), F.col("low.n"), F.col("high.path"), digits, fanout)
    out = met.select("tree", F.col("low.n").alias("n"), F.col("high.top").alias("top"), F.explode(leaves).alias("l"))
    return out.select("tree", "n", "l.leaf", "l.path", "top")


def _tiers(leaves: DataFrame, fanout: int, digits: int) -> list[DataFrame]:
    """Written blocks of every tier, up to that where each tree is one block."""
    tiers = []
    while True:
        tiers.append(settle(rollup(leaves, fanout, digits)))
        size = fanout**digits
        if not tiers[-1].where(F.col("n") > size).limit(1).count():
            return tiers
        above = F.ceil(F.col("n") / F.lit(size)).cast("long")
        node = F.struct(F.col("node.digest").alias("digest"), F.col("block").alias("block"))
        leaves = tiers[-1].select("tree", above.alias("n"), F.col("block").alias("rank"), node.alias("node"))


def _paths(tiers: list[DataFrame], tops: DataFrame, fanout: int, digits: int) -> DataFrame:
    """Leaves of the lowest tier with their paths; ``tops(tree, path, top)`` are the paths of the trees."""
    paths = tops.select("tree", F.lit(0).cast("long").alias("block"), "path", "top")
    for tier in tiers[:0:-1]:
        below = descend(tier, paths, fanout, digits)
        paths = settle(below.select("tree", F.col("leaf.block").alias("block"), "path", "top"))
    return descend(tiers[0], paths, fanout, digits)


def manifest(
    docs: DataFrame, digest: Column, tree: Column, order: Sequence[Column], carry: Sequence[Column] = (), fanout: int = FANOUT, digits: int = DIGITS
) -> DataFrame:
    """The carried columns with ``leaf, subroot, root, path`` of every row.

    ``digest`` is the leaf, ``tree`` the group (a string), ``order`` the keys that put a group's rows in order.
    ``path`` holds what stands left and right of the row's ancestors, from the row up.
    """
    # null is the empty name, all others begin with a sign
    named = F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit(""))
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    rows = docs.select(named.alias("tree"), digest.alias("digest"), F.struct(*keys).alias("order"), F.struct(F.lit(0).alias("_"), *carry).alias("carry"))
    rows = placed(rows, "tree", [F.col("order").asc_nulls_first(), F.col("digest")])
    leaf_node = F.struct("digest", "carry").alias("node")
    tiers = _tiers(rows.select("tree", F.col("__n").alias("n"), F.col("__rank").alias("rank"), leaf_node), fanout, digits)

    subroots = tiers[-1].select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("node.digest").alias("digest"))
    subroots = placed(subroots, "all", [F.col("name")])
    node = F.struct("digest", "name").alias("node")
    upper = _tiers(subroots.select(F.col("all").alias("tree"), F.col("__n").alias("n"), F.col("__rank").alias("rank"), node), fanout, digits)
    root = upper[-1].select("tree", F.array().cast(_PATH).alias("path"), F.col("node.digest").alias("top"))
    tops = _paths(upper, root, fanout, digits)
    top = F.struct(F.col("leaf.digest").alias("subroot"), F.col("top").alias("root"))
    tops = settle(tops.select(F.col("leaf.name").alias("tree"), "path", top.alias("top")))

    found = _paths(tiers, tops, fanout, digits)
    carried = [F.col(f"leaf.carry.{c}") for c in rows.schema["carry"].dataType.names if c != "_"]
    return found.select(*carried, F.col("leaf.digest").alias("leaf"), "top.subroot", "top.root", "path")


def op13(spark, sf_dir: str) -> DataFrame:
    from spatialframes.llm.common import read

    docs = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(tampered & F.contains("text", F.lit("\n")), leaf([*own, F.replace("text", F.lit("\n"), F.lit(""))]))
    proofs = manifest(docs, leaf([*own, F.col("text")]), F.col("source"), [F.col("doc_id")], [F.col("doc_id"), changed.alias("changed")])
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(levels: int = 20) -> str:
    """Both trees level by level; 3 ** 20 leaves at most."""

    def tree(name: str, group: str) -> str:
        text = ""
        for i in range(levels):
            text += f""", {name}r{i} AS MATERIALIZED (
  SELECT {group}, n, pos // 3 AS up, list(h ORDER BY pos) AS hs FROM {name}{i} GROUP BY {group}, n, pos // 3
), {name}{i + 1} AS MATERIALIZED (
  SELECT {group}, up AS pos, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}r{i}
)"""
        return text

    def walk(name: str, start: str, group: str, out: str) -> str:
        text, last = "", start
        for i in range(levels):
            text += f""", {out}{i} AS MATERIALIZED (
  SELECT w.* REPLACE (w.pos // 3 AS pos,
    CASE WHEN n > 1 THEN path || array_to_string(hs[: (w.pos % 3)::INT], '') || array_to_string(hs[(w.pos % 3 + 2)::INT :], '') ELSE path END AS path,
    CASE WHEN n > 1 THEN sha256(array_to_string(hs[: (w.pos % 3)::INT], '') || cur || array_to_string(hs[(w.pos % 3 + 2)::INT :], '')) ELSE cur END AS cur)
  FROM {last} w JOIN {name}r{i} r ON r.{group} = w.{group} AND r.up = w.pos // 3
)"""
            last = f"{out}{i}"
        return text

    last = levels - 1
    return (
        _LEAVES_SQL
        + tree("s", "tree")
        + f""", t0 AS MATERIALIZED (
  SELECT 0 AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h FROM s{levels}
)"""
        + tree("t", "tree")
        + walk("s", "w", "tree", "a")
        + f""", b AS MATERIALIZED (
  SELECT a.doc_id, a.leaf, t0.h AS subroot, 0 AS tree, t0.pos AS pos, a.path, a.cur FROM a{last} a JOIN t0 ON t0.name = a.tree
)"""
        + walk("t", "b", "tree", "c")
        + f"""
SELECT doc_id, leaf, subroot, t{levels}.h AS root, sha256(path) AS proof_sha256, cur AS folded_root, cur = t{levels}.h AS verified
FROM c{last}, t{levels}
"""
    )


# a checksum byte by byte, bit by bit; its complement is odd where the checksum is even
_LEAVES_SQL = r"""
WITH d AS (
  SELECT doc_id, text, coalesce('=' || source, '') AS tree, concat(
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS own,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce(list_concat([xor(c, x)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda e, y: CASE WHEN e % 2 = 1 THEN xor(e >> 1, 3988292384::BIGINT) ELSE e >> 1 END)) % 2 = 1 AS hit
  FROM documents
), l AS (
  SELECT doc_id, tree, sha256(own || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS changed, own
  FROM d
), w AS MATERIALIZED (
  SELECT doc_id, tree, leaf, sha256(own || coalesce(strlen(changed) || ':' || changed, '-')) AS cur, '' AS path,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM l
), s0 AS MATERIALIZED (
  SELECT tree, pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS h FROM w
)"""

OP13_SQL = _levels_sql()
