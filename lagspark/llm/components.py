"""Connected components of a link table by alternating large-star and small-star rounds.

Every round replaces each node's links by links to its smallest known neighbour; a hot
node's minimum is pre-aggregated and joined back, so no task gathers its neighbours. Links
run from the larger node to the smaller one, so a node's smallest neighbour needs one
aggregation by the larger end only, and no round needs a distinct: small stars keep one
link of those that repeat. Before the rounds every partition replaces its links by a forest
of stars, so a dense group sends its nodes and not its pairs. Rounds end once all links
are stars, one a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links that a partition is meant to hold between rounds, and nodes that a partition's forest holds at once.
PART, FOREST = 500_000, 1_000_000


def components(links: DataFrame, a: str, b: str, node: str, component: str) -> DataFrame:
    """(node, component) for every node that some link touches; component is the smallest node reached.

    Nulls and self-links are ignored, repeated links count once. An empty table gives an empty one.
    """
    found = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = cut(found.mapInArrow(_forest, "u long, v long"))
    n = edges.count()
    while not _stars(edges):
        edges = cut(_small_star(_large_star(edges)).coalesce(max(8, -(-n // PART))))
    roots = edges.select(F.col("v").alias(node), F.col("v").alias(component)).distinct()
    return edges.select(F.col("u").alias(node), F.col("v").alias(component)).unionByName(roots)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (node, smallest node reached) that join what the links of a partition join."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    def flush() -> pa.RecordBatch:
        rows = [(x, r) for x in list(above) if (r := root(x)) != x]
        above.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = root(u), root(v)
            above[max(u, v)] = min(u, v)
        if len(above) >= FOREST:
            yield flush()
    yield flush()


def _stars(edges: DataFrame) -> bool:
    """True if every node has one link at most and no smaller end has one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
    return nodes.where("up > 1 OR (up = 1 AND least = 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
    return edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))
