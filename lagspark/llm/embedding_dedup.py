"""Near-duplicate embeddings by a dual traversal of cover trees.

Vectors are scaled to length one, where cosine >= t means distance <= eps = sqrt(2 - 2t).
The upper levels of the tree are tables: a node of more than CHUNK vectors is opened around
at most FAN centres, picked far apart from each other out of its vectors of smallest hash,
and each vector goes to the nearest one; a node's radius is the largest distance that occurs.
The levels are traversed in pairs by joins on the node: a pair of nodes whose centres are
further apart than both radii plus eps is dropped, the rest are opened on the next level, and
only leaves whose pair has survived are dealt out to each other. A node whose radius is at
most eps / 2 is all but one clique and is cut by a hash of the id instead, as is one that is
too large after LEVELS levels.

Within a leaf, nested levels with halving radii follow, each node a centre and the rows
within its radius. Two leaves are traversed together from their coarsest useful level:
node pairs whose centres are further apart than both covering radii plus eps are dropped,
the rest are opened on the next level, and at the last one cosines are computed in double.
All links at or above the threshold are counted, none below it. A task returns counts and
a spanning forest, never its pairs; components come from the forests.

Vectors that are null, zero or hold nulls or non-finite numbers link with nothing, nor do
vectors of different lengths. Rows that repeat an id count as one vector, the least by length
and bytes. A null id links with nothing and keeps its row. An empty table gives an empty one.
Only the id and the vector are read, so other columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free
from .components import components
from .vectors import matrix, packed

CHUNK = 4096
#: Centres that a node is opened around, vectors that each of them is picked from, and levels of tables.
#: FAN * PICK stays within 1000, up to which Spark cuts a ranking before the shuffle, so that no task gets a whole node.
FAN, PICK, LEVELS = 250, 4, 12
#: Keys that the vectors of a node are dealt over while they look for their centre.
SALTS = 64
#: Radii of the nested levels within a leaf.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Above the rounding of float32 products of unit vectors.
SLACK = 1e-4


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of vectors."""
    eps = math.sqrt(max(0.0, 2 - 2 * threshold))
    rows = packed(vectors, id_col, vec_col).groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("x"))
    leaves, pairs = _tree(rows.select("id", "x.dim", "x.vec"), eps, chunk)
    built = leaves.groupBy("chunk").applyInArrow(_levels, "id long, dim int, vec binary, chunk string, nodes array<int>")
    sides = pairs.select(F.col("one").alias("chunk"), "one", "two").unionByName(pairs.where("one <> two").select(F.col("two").alias("chunk"), "one", "two"))
    dealt = built.join(sides, "chunk")
    found = cut(dealt.groupBy("one", "two").applyInArrow(lambda t: _traverse(t, threshold, eps), "id long, n long, root long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    classes = components(found, "id", "root", "id", "component")
    a, b, n, of = (free(vectors, x) for x in ("a", "b", "n", "component"))
    own = F.col(id_col)
    return (
        vectors.select(own)
        .join(counts.select(F.col("id").alias(a), F.col("n").alias(n)), own == F.col(a), "left")
        .join(classes.select(F.col("id").alias(b), F.col("component").alias(of)), own == F.col(b), "left")
        .select(
            own,
            F.coalesce(n, F.lit(0)).cast("long").alias("n_links"),
            F.coalesce(F.col(of), own).alias("component_id"),
            F.coalesce(own == F.coalesce(F.col(of), own), F.lit(True)).alias("kept"),
        )
    )


def _tree(rows: DataFrame, eps: float, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(id, dim, vec, chunk) of each vector's leaf, and the (one, two) pairs of leaves that may hold links.

    Nodes are named by the way to them from their root, one root for each length of vectors.
    """
    root = F.concat(F.lit("d"), F.col("dim").cast("string"))
    placed = cut(rows.select("id", "dim", "vec", root.alias("node"), F.lit(2.0).alias("away")))
    nodes = cut(placed.groupBy("node").agg(F.count("*").alias("n"), F.max("away").alias("r"), F.lit(None).cast("binary").alias("centre")))
    pairs = nodes.select(F.col("node").alias("one"), F.col("node").alias("two"))
    for _ in range(LEVELS):
        large = nodes.where((F.col("n") > chunk) & (F.col("r") > eps / 2)).select("node", F.least(F.lit(FAN), F.ceil(F.col("n") / chunk)).cast("int").alias("k"))
        if large.isEmpty():
            break
        order = Window.partitionBy("node").orderBy(F.xxhash64("id", F.lit(7)), "id")
        some = placed.withColumn("i", F.row_number().over(order)).where(F.col("i") <= PICK * FAN).join(large, "node").where(F.col("i") <= PICK * F.col("k"))
        centres = cut(some.groupBy("node").applyInArrow(_separated, "node string, dim int, kid int, centre binary"))
        # At most FAN vectors a node.
        table = centres.groupBy("node").agg(F.collect_list(F.struct("kid", "centre")).alias("centres"))
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asks = placed.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(SALTS)).cast("int"))
        joined = asks.join(salted, ["node", "salt"], "left").select("id", "dim", "vec", "node", "away", "centres")
        placed = cut(joined.mapInArrow(_nearest, "id long, dim int, vec binary, node string, away double"))
        made = centres.select(F.concat_ws(".", "node", "kid").alias("node"), F.col("node").alias("up"), F.col("centre").alias("new"))
        sizes = placed.groupBy("node").agg(F.count("*").alias("n"), F.max("away").alias("r"))
        kept = nodes.select("node", F.col("node").alias("same"), F.col("centre").alias("old"))
        nodes = cut(
            sizes.join(made, "node", "left").join(kept, "node", "left").select("node", F.coalesce("up", "same").alias("up"), "n", "r", F.coalesce("new", "old").alias("centre"))
        )
        left = nodes.select(F.col("up").alias("one"), F.col("node").alias("a"), F.col("centre").alias("ca"), F.col("r").alias("ra"))
        right = nodes.select(F.col("up").alias("two"), F.col("node").alias("b"), F.col("centre").alias("cb"), F.col("r").alias("rb"))
        opened = pairs.join(left, "one").join(right, "two").where("one <> two OR a <= b").select("a", "b", "ca", "cb", "ra", "rb")
        pairs = cut(opened.mapInArrow(lambda batches: _close(batches, eps), "one string, two string"))
    # A leaf that is still too large is cut by a hash; its parts meet each other and all partners.
    parts = nodes.select("node", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    cutting = F.concat_ws("#", "node", F.pmod(F.xxhash64("id", F.lit(13)), F.col("parts")).cast("string"))
    leaves = placed.join(parts, "node").select("id", "dim", "vec", cutting.alias("chunk"))
    each = parts.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", F.concat_ws("#", "node", F.col("p").cast("string")).alias("leaf"))
    one, two = each.select(F.col("node").alias("one"), F.col("leaf").alias("a")), each.select(F.col("node").alias("two"), F.col("leaf").alias("b"))
    return leaves, pairs.join(one, "one").join(two, "two").where("one <> two OR a <= b").select(F.col("a").alias("one"), F.col("b").alias("two"))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit rows by one float32 product; off by less than SLACK where they matter."""
    return np.sqrt(np.maximum(2 - 2 * (a.astype(np.float32) @ b.astype(np.float32).T), 0))


def _separated(table: pa.Table) -> pa.Table:
    """k of a node's vectors, each the farthest from those before it; the first is that of the smallest hash."""
    k, dim = table.column("k")[0].as_py(), table.column("dim")[0].as_py()
    table = table.sort_by("i")
    x = _unit(matrix(table.column("vec"), dim))
    picked, gap = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(k, len(x)) and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, np.linalg.norm(x - x[picked[-1]], axis=1))
    some, n = table.take(pa.array(picked)), len(picked)
    return pa.table({"node": some.column("node"), "dim": some.column("dim"), "kid": pa.array(range(n), pa.int32()), "centre": some.column("vec")})


def _nearest(batches):
    """The child that each vector goes to and its distance from the centre; nodes without centres stay."""
    for batch in batches:
        nodes, away = batch.column("node").to_pylist(), batch.column("away").to_numpy().copy()
        lists = batch.column("centres")
        by: dict[str, list[int]] = {}
        for i, node in enumerate(nodes):
            if lists[i].is_valid:
                by.setdefault(node, []).append(i)
        for node, mine in by.items():
            dim, centres = batch.column("dim")[mine[0]].as_py(), lists[mine[0]].as_py()
            x = _unit(matrix(batch.column("vec").take(pa.array(mine)), dim))
            c = _unit(matrix(pa.array([z["centre"] for z in centres], pa.binary()), dim))
            d = np.sqrt(np.maximum(2 - 2 * (x @ c.T), 0))
            best = d.argmin(axis=1)
            away[mine] = np.linalg.norm(x - c[best], axis=1)
            for i, j in zip(mine, best.tolist()):
                nodes[i] = f"{node}.{centres[j]['kid']}"
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(nodes, pa.string()), pa.array(away)], ["id", "dim", "vec", "node", "away"])


def _close(batches, eps):
    """The node pairs that their radii do not rule out; nodes without a centre are ruled out by nothing."""
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        ca, cb = batch.column("ca"), batch.column("cb")
        both = np.nonzero(pc.and_(ca.is_valid(), cb.is_valid()).to_numpy(zero_copy_only=False))[0]
        # A node's name begins with the length of its vectors.
        dims = np.array([int(name.split(".")[0][1:]) for name in batch.column("a").to_pylist()])[both]
        reach = pc.add(batch.column("ra"), batch.column("rb")).to_numpy() + eps + SLACK
        for dim in np.unique(dims):
            mine = both[dims == dim]
            a, b = (_unit(matrix(x.take(pa.array(mine)), int(dim))) for x in (ca, cb))
            keep[mine] = np.linalg.norm(a - b, axis=1) <= reach[mine]
        out = batch.select(["a", "b"]).filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays(out.columns, ["one", "two"])


def _levels(table: pa.Table) -> pa.Table:
    """The node of every vector on each level, the node numbered by its centre's row."""
    ids, keep = np.unique(table.column("id").to_numpy(), return_index=True)
    table = table.take(pa.array(keep))
    x = _unit(matrix(table.column("vec"), table.column("dim")[0].as_py()))
    small, n = x.astype(np.float32), len(x)
    above, levels = np.zeros(n, np.int32), []
    for radius in RADII:
        node = np.full(n, -1, np.int32)
        order = np.argsort(above, kind="stable")
        ends = np.searchsorted(above[order], np.unique(above[order]), side="right")
        start = 0
        for end in ends:  # nested: a node's rows are covered anew within it
            rest, start = order[start:end], end
            while len(rest):
                near = small[rest] @ small[rest[0]] >= 1 - radius * radius / 2
                near[0] = True
                node[rest[near]] = rest[0]
                rest = rest[~near]
        levels.append(node)
        above = node
    nodes = pa.array(np.stack(levels, axis=1).tolist(), pa.list_(pa.int32()))
    return table.append_column("nodes", nodes).select(["id", "dim", "vec", "chunk", "nodes"])


class Side:
    """One chunk's unit vectors and nodes."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("id").to_numpy()
        self.x = _unit(matrix(table.column("vec"), table.column("dim")[0].as_py())) if len(self.ids) else np.empty((0, 1))
        nodes = np.array(table.column("nodes").to_pylist(), np.int32).reshape(len(self.ids), -1)
        self.levels = []  # (centre vectors, covering radii, members) of each level
        for k in range(nodes.shape[1]):
            names, inverse = np.unique(nodes[:, k], return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            ends = np.searchsorted(inverse[order], np.arange(len(names) + 1))
            centre = self.x[order[ends[:-1]]]
            away = np.linalg.norm(self.x - centre[inverse], axis=1)
            radius = np.maximum.reduceat(away[order], ends[:-1]) if len(names) else away
            self.levels.append((centre, radius, inverse, order, ends))


def _traverse(table: pa.Table, threshold: float, eps: float) -> pa.Table:
    """Link counts and a spanning forest of the links between two chunks, or within one."""
    one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
    chunk = table.column("chunk")
    a = Side(table.filter(pc.equal(chunk, one)))
    b = a if one == two else Side(table.filter(pc.equal(chunk, two)))
    blocks = list(_links(a, b, threshold, eps, one == two)) if len(a.ids) and len(b.ids) else []
    counts_a, counts_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    label_a, label_b = a.ids.copy(), b.ids.copy()
    for rows, columns, linked in blocks:
        np.add.at(counts_a, rows, linked.sum(axis=1))
        np.add.at(counts_b, columns, linked.sum(axis=0))
    changed = True
    while changed:  # labels sink to the smallest id that links reach
        changed = False
        for rows, columns, linked in blocks:
            for k in range(0, len(rows), 256):
                r, m = rows[k : k + 256], linked[k : k + 256]
                most = np.iinfo(np.int64).max
                low_b = np.minimum(label_b[columns], np.where(m, label_a[r][:, None], most).min(axis=0, initial=most))
                low_a = np.minimum(label_a[r], np.where(m, low_b, most).min(axis=1, initial=most))
                if (low_b < label_b[columns]).any() or (low_a < label_a[r]).any():
                    changed = True
                    np.minimum.at(label_b, columns, low_b)
                    np.minimum.at(label_a, r, low_a)
        if a is b:
            label_a = label_b = np.minimum(label_a, label_b)
    if a is b:
        sides = [(a.ids, counts_a + counts_b, label_a)]
    else:
        sides = [(a.ids, counts_a, label_a), (b.ids, counts_b, label_b)]
    kept = [(i[n > 0], n[n > 0], r[n > 0]) for i, n, r in sides]
    i, n, r = (np.concatenate(x) for x in zip(*kept))
    return pa.table({"id": pa.array(i, pa.int64()), "n": pa.array(n, pa.int64()), "root": pa.array(r, pa.int64())})


def _links(a: Side, b: Side, threshold: float, eps: float, same: bool):
    """Blocks (rows of a, rows of b, linked or not) of the leaf pairs that survive the bounds; each link once."""
    last = len(RADII) - 1
    # A level with nearly as many nodes as the next one rules out nothing that the next does not.
    levels = [k for k in range(last) if all(len(s.levels[k][1]) * 2 <= len(s.levels[k + 1][1]) for s in (a, b))] + [last]
    pairs = None
    for at, k in enumerate(levels):
        ca, ra, _, order_a, ends_a = a.levels[k]
        cb, rb, _, order_b, ends_b = b.levels[k]
        found = []
        if pairs is None:
            for s in range(0, len(ca), 512):
                near = _distances(ca[s : s + 512], cb) <= (ra[s : s + 512, None] + rb + eps + SLACK).astype(np.float32)
                i, j = np.nonzero(near)
                half = i + s <= j if same else slice(None)
                found.append((i[half] + s, j[half]))
        else:
            up = levels[at - 1]
            kids_a, kids_b = _children(a, up, k), _children(b, up, k)
            # Within one chunk only a node's pair with itself holds each of its child pairs twice.
            for i, j in zip(*pairs):
                x, y = kids_a[i], kids_b[j]
                p, q = np.nonzero(_distances(ca[x], cb[y]) <= (ra[x][:, None] + rb[y] + eps + SLACK).astype(np.float32))
                if same and i == j:
                    half = x[p] <= y[q]
                    p, q = p[half], q[half]
                found.append((x[p], y[q]))
        pairs = tuple(np.concatenate(z) for z in zip(*found)) if found else (np.empty(0, int), np.empty(0, int))
    single_a, single_b = np.diff(ends_a) == 1, np.diff(ends_b) == 1
    lone = single_a[pairs[0]] & single_b[pairs[1]]
    i, j = order_a[ends_a[pairs[0][lone]]], order_b[ends_b[pairs[1][lone]]]
    if same:
        i, j = i[i != j], j[i != j]
    hit = np.concatenate([(a.x[i[s : s + 65536]] * b.x[j[s : s + 65536]]).sum(axis=1) >= threshold for s in range(0, len(i), 65536)] or [np.empty(0, bool)])
    for p, q in zip(i[hit], j[hit]):
        yield np.array([p]), np.array([q]), np.ones((1, 1), bool)
    for p, q in zip(pairs[0][~lone], pairs[1][~lone]):
        rows, columns = order_a[ends_a[p] : ends_a[p + 1]], order_b[ends_b[q] : ends_b[q + 1]]
        linked = a.x[rows] @ b.x[columns].T >= threshold
        if same and p == q:
            linked = np.triu(linked, 1)
        if linked.any():
            yield rows, columns, linked


def _children(side: Side, up: int, down: int) -> list[np.ndarray]:
    """For each node of one level its nodes on a finer one."""
    parents, own = side.levels[up][2], side.levels[down][2]
    both = np.unique(parents.astype(np.int64) << 32 | own)
    parent, child = both >> 32, (both & 0xFFFFFFFF).astype(int)
    ends = np.searchsorted(parent, np.arange(len(side.levels[up][1]) + 1))
    return [child[s:e] for s, e in zip(ends, ends[1:])]
