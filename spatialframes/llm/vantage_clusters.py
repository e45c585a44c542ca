"""Centroid clustering in exact integers, with a vantage-point tree over the centroids.

A vector's components become the integers ``floor(scale * x)``. Each round builds a vantage-point tree over
the centroids, at most ``k`` of them, and broadcasts it. A node keeps the nearest and the farthest distance
from its vantage centroid to the centroids inside and outside its radius. A vector opens the node with the
least possible distance first and stops when no open node can reach its best; a node that can just reach it
is opened too, so that of equally near centroids the smallest number wins. Nodes are passed over by distances
in floating point with a margin, answers are integers: a node is never passed over wrongly, and a leaf's
distances are exact. The vectors of a batch walk together, each with its own open nodes.

A task adds up its vectors by cluster, so a round shuffles ``k`` times the components per task however
large a cluster is, and the driver receives the ``k`` sums. Sums of integers do not depend on the order.

Defined results: vectors that are null, of another length, or with a null or non-finite component take no part;
ids may repeat or be null, every row is a vector (a null id comes last among the first centroids; rows with
one id by their components as text); with fewer vectors than ``k`` there are fewer centroids, equal ones may be
among them, the smaller number wins; an empty table gives no rows; components of any size are exact,
but a distance or inertia that a long cannot hold is null; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatialframes.session import settle

BUCKET = 2  # centroids of a leaf
_EXACT = 1 << 25  # a vector of this length has exact squared distances in floating point
_CELLS = 1 << 20  # open nodes of vectors that walk together
_SLACK = 1e-9
_LIMB = 60  # bits
_LONG = (1 << 63) - 1


def integers(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that take part, and their components as whole doubles."""
    column = batch.column(1)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    rows = np.flatnonzero(lengths == dims)
    if not len(rows):
        return rows, np.empty((0, dims))
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(np.nan)).reshape(-1, dims)
    whole = np.isfinite(values).all(axis=1)
    return rows[whole], np.floor(values[whole] * scale)


def _small(largest: float, dims: int) -> bool:
    """Whether squared distances between such components are exact in floating point."""
    return largest * dims**0.5 <= _EXACT


def _exact(points: np.ndarray) -> np.ndarray:
    """Doubles where all arithmetic on them is exact, Python's integers beyond."""
    if points.dtype == object or not points.size or _small(np.abs(points).max(), points.shape[1]):
        return points
    return np.array([[int(x) for x in row] for row in points.tolist()], dtype=object).reshape(points.shape)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to one centre."""
    apart = points - centre
    return (apart * apart).sum(axis=1)


@dataclass
class Node:
    """Centroids of a leaf, or a vantage centroid and what lies inside and outside its radius."""

    members: list[int]
    inside: Node | None = None
    outside: Node | None = None
    near: tuple[float, float] = (0.0, 0.0)  # nearest and farthest distance from the vantage centroid to those inside
    far: tuple[float, float] = (0.0, 0.0)


def build(centroids: list[list[int]], bucket: int = BUCKET) -> Node:
    """The tree; its first centroid in a set is the vantage centroid, the median distance the radius."""

    def grow(members: list[int]) -> Node:
        if len(members) <= bucket:
            return Node(members)
        vantage, rest = members[0], members[1:]
        here = centroids[vantage]
        apart = {m: sum((a - b) ** 2 for a, b in zip(here, centroids[m], strict=True)) for m in rest}
        rest = sorted(rest, key=lambda m: (apart[m], m))
        cut = (len(rest) + 1) // 2
        span = lambda part: (float(apart[part[0]]) ** 0.5, float(apart[part[-1]]) ** 0.5)
        inner, outer = rest[:cut], rest[cut:]
        node = Node([vantage], near=span(inner), inside=grow(sorted(inner)))
        if outer:
            node.far, node.outside = span(outer), grow(sorted(outer))
        return node

    return grow(list(range(len(centroids))))


class Tree:
    """Nodes numbered from the root, for vectors that walk together."""

    def __init__(self, centroids: list[list[int]]):
        self.nodes: list[Node] = []
        self.children: list[list[tuple[int, tuple[float, float]]]] = []
        self.centroids = centroids
        self.small = all(_small(max(map(abs, c)), len(c)) for c in centroids)
        if centroids:
            self._number(build(centroids))

    def _number(self, node: Node) -> int:
        me = len(self.nodes)
        self.nodes.append(node)
        self.children.append([])
        for child, span in ((node.inside, node.near), (node.outside, node.far)):
            if child is not None:
                self.children[me].append((self._number(child), span))
        return me

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each integer point, and the exact squared distance."""
        points = _exact(points)
        if not self.small and points.dtype != object:
            points = np.array([[int(x) for x in row] for row in points.tolist()], dtype=object).reshape(points.shape)
        step = max(1, _CELLS // len(self.nodes))
        walks = [self._walk(points[i : i + step]) for i in range(0, len(points), step)]
        return np.concatenate([w[0] for w in walks]), np.concatenate([w[1] for w in walks])

    def _walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(points)
        centres = [np.array(c, dtype=points.dtype) for c in self.centroids]
        best = np.full(n, np.inf, dtype=points.dtype)
        found = np.full(n, len(centres), dtype="int64")
        reach = np.full(n, np.inf)  # distance of the best in floating point
        bound = np.full((n, len(self.nodes)), np.inf)  # least possible distance of an open node
        bound[:, 0] = 0.0
        active = np.arange(n)
        while len(active):
            first = bound[active].argmin(axis=1)
            least = bound[active, first]
            # inclusive: a node that may hold an equally near centroid is opened
            going = np.isfinite(least) & (least <= reach[active] * (1 + _SLACK))
            active, first = active[going], first[going]
            for number in np.unique(first).tolist():
                walkers = active[first == number]
                bound[walkers, number] = np.inf
                for member in self.nodes[number].members:
                    apart = squared(points[walkers], centres[member])
                    better = (apart < best[walkers]) | ((apart == best[walkers]) & (member < found[walkers]))
                    better = better.astype(bool)
                    who = walkers[better]
                    best[who], found[who] = apart[better], member
                    reach[who] = np.sqrt(apart[better].astype("float64"))
                for child, (low, high) in self.children[number]:
                    # an inner node has one member, so its distances are at hand
                    distance = np.sqrt(apart.astype("float64"))
                    gap = np.maximum(low - distance, distance - high)
                    bound[walkers, child] = np.maximum(gap - (high + distance) * _SLACK, 0.0)
        return found, best


def _limbs(value: int) -> list[int]:
    """Parts of an integer of any size, lowest first: the sum of ``part << 60 * i`` is the value."""
    out = []
    while not -(1 << _LIMB) < value < 1 << _LIMB:
        value, low = divmod(value, 1 << _LIMB)
        out.append(low)
    return [*out, value]


_SUMS = "cluster int, at int, limb int, part long"
_COUNT = -1  # place of a cluster's count beside its components


def _add(sums: dict[tuple[int, int], int], points: np.ndarray, found: np.ndarray) -> None:
    for cluster in np.unique(found).tolist():
        own = found == cluster
        # the doubles of a batch are whole and short, so they add up exactly
        for at, value in enumerate(_exact(points[own]).sum(axis=0).tolist()):
            sums[cluster, at] = sums.get((cluster, at), 0) + int(value)
        sums[cluster, _COUNT] = sums.get((cluster, _COUNT), 0) + int(own.sum())


def _sum_rows(sums: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    rows = [(c, at, i, part) for (c, at), value in sorted(sums.items()) for i, part in enumerate(_limbs(value))]
    if rows:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "at", "limb", "part"])


def totals(parts: DataFrame) -> dict[tuple[int, int], int]:
    """Exact sums by cluster and place: ``k`` times the components and one."""
    whole = parts.groupBy("cluster", "at", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    out: dict[tuple[int, int], int] = {}
    for r in whole.collect():
        key = r["cluster"], r["at"]
        out[key] = out.get(key, 0) + (int(r["part"]) << (_LIMB * r["limb"]))
    return out


def first_centroids(vectors: DataFrame, k: int, dims: int, scale: int, seed: str) -> list[list[int]]:
    """Components of the ``k`` vectors that take part with the smallest digests of ``seed:id``, in that order.

    Each task offers its own ``k`` first.
    """

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[str]]] = []
        for batch in batches:
            rows, points = integers(batch, dims, scale)
            ids = batch.column(0).take(pa.array(rows, pa.int64())).to_pylist()
            digests = ["~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in ids]
            least = heapq.nsmallest(k, digests + [d for d, _ in best])
            near = [(d, [str(int(x)) for x in p.tolist()]) for d, p in zip(digests, points, strict=True) if d <= least[-1]]
            best = heapq.nsmallest(k, best + near)
        columns = [pa.array([d for d, _ in best], pa.string()), pa.array([p for _, p in best], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["digest", "point"])

    offered = vectors.mapInArrow(offer, "digest string, point array<string>")
    return [[int(x) for x in r["point"]] for r in offered.orderBy("digest", "point").limit(k).collect()]


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", key: str = "vec_id", column: str = "embedding"
) -> tuple[DataFrame, list[list[int]]]:
    """``(key, cluster, distance)`` of every vector that takes part, written once, and the final centroids."""
    spark = vectors.sparkSession
    vectors = vectors.select(key, column)
    centroids = first_centroids(vectors, k, dims, scale, seed)

    for _ in range(rounds if centroids else 0):
        tree = spark.sparkContext.broadcast(Tree(centroids))

        def sums(batches: Iterator[pa.RecordBatch], tree=tree) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], int] = {}
            for batch in batches:
                _, points = integers(batch, dims, scale)
                if len(points):
                    _add(held, points, tree.value.nearest(points)[0])
            yield from _sum_rows(held)

        found = totals(vectors.mapInArrow(sums, _SUMS))
        centroids = [
            [found[c, at] // found[c, _COUNT] for at in range(dims)] if (c, _COUNT) in found else old
            for c, old in enumerate(centroids)
        ]
        tree.destroy()

    tree = spark.sparkContext.broadcast(Tree(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, points = integers(batch, dims, scale)
            if len(rows):
                number, best = tree.value.nearest(points)
                exact = [int(d) for d in best.tolist()]
                columns = [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(number, pa.int32()),
                    pa.array([d if d <= _LONG else None for d in exact], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "cluster", "distance"])

    schema = T.StructType([vectors.schema[0], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return settle(vectors.mapInArrow(assign, schema)), centroids


def report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """The vectors with the summed distance of their cluster and of all, and their centroid's digest.

    What is looked up has one row a centroid.
    """
    distance = F.col("distance").cast("decimal(38,0)")
    rows = assigned.groupBy("cluster").agg(F.sum(distance).alias("d"), F.count_if(F.col("distance").isNull()).alias("beyond")).collect()
    sums = {r["cluster"]: None if r["beyond"] else int(r["d"]) for r in rows}
    as_long = lambda d: d if d is not None and d <= _LONG else None
    whole = None if None in sums.values() else as_long(sum(sums.values()))
    table = [
        (c, as_long(sums.get(c)), hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest())
        for c, centre in enumerate(centroids)
    ]
    names = assigned.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(names), "cluster").withColumn("inertia", F.lit(whole).cast("long"))


def op12(spark, sf_dir: str) -> DataFrame:
    from spatialframes.llm.common import read

    found = report(*cluster(read(spark, sf_dir, "embeddings", "vec_id", "embedding")))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds_sql(rounds: int = 10) -> str:
    """The rounds one after the other; scalar products of whole doubles are exact at this size."""
    text = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INT AS cluster, x AS c FROM v
  ORDER BY sha256('3:' || vec_id) LIMIT 8
)"""
    near = """, a{i} AS MATERIALIZED (
  SELECT vec_id, x, p.d AS distance, p.n AS cluster FROM (
    SELECT vec_id, x, (SELECT min({{'d': (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT, 'n': cluster}}) FROM c{i}) AS p
    FROM v)
)"""
    move = """, c{j} AS MATERIALIZED (
  SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT cluster, list(floor(s / n) ORDER BY pos) AS c FROM (
      SELECT cluster, pos, sum(value)::DOUBLE AS s, count(*)::DOUBLE AS n
      FROM (SELECT cluster, unnest(x) AS value, unnest(range(64)) AS pos FROM a{i}) GROUP BY cluster, pos)
    GROUP BY cluster) m ON m.cluster = o.cluster
)"""
    for i in range(rounds):
        text += near.format(i=i) + move.format(i=i, j=i + 1)
    text += near.format(i=rounds)
    return text + f"""
SELECT vec_id, a.cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda y: y::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
"""


OP12_SQL = _rounds_sql()
