"""Mixing of sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source's rows are put in a fixed pseudo-random order and cut into blocks. With shares
a_s of a frame of Q slots (the target weights in units of 1/Q), block j of source s is
released at slot floor(j Q / a_s) and due by ceil((j + 1) Q / a_s); earliest deadline first
among the released blocks meets every deadline, so after t slots each source has had its
weight times t blocks to within less than one block. As all shares are whole, the schedule
repeats every Q slots: one frame is scheduled, and the slot of any block follows from its
number, without a pass over the blocks. The bound holds for the shares: against weights that
are not whole shares, the deviation of schedule() grows with the slots. mix() therefore goes
by exact(), which takes the windows from the weights themselves: earliest deadline first over
all blocks. That table has a row a block and is made on the driver; its size is bounded at
every scale, as a block holds at least 1/BLOCKS of all rows. When a source runs out, its slots
stay empty and the others keep their proportions; position counts the rows before a row, in
closed form.

Every row of the input is scheduled once. Row numbers inside a source come from counts over
hash prefixes, so a source with a third of all rows is spread over BUCKETS groups.

Null sources are one source of their own. A given weight that is missing, null or not
positive counts as the smallest share. Rows that repeat an id are scheduled one by one.
An empty table gives an empty one. With more sources than Q / 4, Q grows to the next power of two.
Of the input only the id and the source are read, however long the rest is. All its columns
stay as they are, of any type; a column of the schedule whose name the input has already gets
underscores behind its name.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, unused

FRAME, BLOCK = 1024, 16
#: Hash prefixes (three hexadecimal digits) that a source's rows are counted by.
BUCKETS = 4096
#: Tables of sources and of slots are broadcast up to this many cells of eight bytes.
BROADCAST_CELLS = 4_000_000
#: Blocks that exact() schedules at most, by making blocks larger.
BLOCKS = 1 << 17
#: Bytes of a partition of mix().
PARTITION_BYTES = 32 << 20


def schedule(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    frame: int = FRAME,
    block: int = BLOCK,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """docs with block, slot, release, deadline and position, each long and from 0.

    Without weights, a source's weight is the square root of its row count.
    """
    mine, rows = _packed(docs, source_col, id_col)
    rows = rows.withColumns(
        {
            "__src": F.coalesce(F.concat(F.lit("="), F.col("__source").cast("string")), F.lit("")),
            "__h": F.md5(F.concat(F.lit("0|"), F.coalesce(F.col("__id").cast("string"), F.lit("")))),
        }
    ).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy("__src", "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__src").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__src", "__b", F.coalesce(before, F.lit(0)).alias("__off"))
    totals = counts.groupBy("__src").agg(F.sum("__n").alias("n"))
    n_sources = totals.count()
    while 4 * n_sources > frame:
        frame *= 2
    plan = totals.agg(F.array_sort(F.collect_list(F.struct(F.col("__src").alias("src"), "n"))).alias("s"))
    plan = plan.withColumn("w", F.transform("s", lambda x: _weight(x, weights)))
    # One row each, cut so that the lambdas of the frame don't work the shares out anew.
    plan = cut(plan.withColumn("a", _shares(frame, n_sources)))
    plan = cut(plan.withColumn("p", _frame(frame)))
    shares = plan.select(F.explode(F.arrays_zip("s", "a")).alias("x")).select(
        F.col("x.s.src").alias("__src"), F.col("x.a").alias("__a")
    )
    slots = plan.select(F.posexplode("p").alias("__i", "x"), F.col("s.n").alias("__ns"), "s", F.col("a").alias("__as")).select(
        "__i", F.col("s")[F.col("x.pick")]["src"].alias("__src"), F.col("x.had")[F.col("x.pick")].alias("__r"), F.col("x.had").alias("__had"), "__ns", "__as"
    )
    if frame * n_sources <= BROADCAST_CELLS:
        shares, slots = F.broadcast(shares), F.broadcast(slots)
    number = F.row_number().over(Window.partitionBy("__src", "__b").orderBy("__h", "__id")) - 1
    ranked = rows.withColumn("__k", number).join(offsets, ["__src", "__b"]).withColumn("__k", F.col("__k") + F.col("__off"))
    ranked = ranked.join(shares, "__src").withColumn("block", F.floor(F.col("__k") / block))
    ranked = ranked.withColumns({"__r": F.pmod("block", "__a").cast("int"), "__f": F.floor(F.col("block") / F.col("__a"))})
    placed = ranked.join(slots, ["__src", "__r"])
    passed = F.zip_with("__as", "__had", lambda a, had: (a * F.col("__f") + had) * block)
    earlier = F.aggregate(F.zip_with(passed, F.col("__ns"), lambda x, n: F.least(x, n)), F.lit(0).cast("long"), lambda t, x: t + x)
    q = F.lit(frame)
    return placed.withColumns(
        {
            "slot": F.col("__f") * frame + F.col("__i"),
            "release": F.floor(F.col("block") * q / F.col("__a")),
            "deadline": F.ceil((F.col("block") + 1) * q / F.col("__a")),
            "position": earlier + F.pmod("__k", F.lit(block)),
        }
    ).select(f"{mine}.*", *(F.col(c).cast("long").alias(unused(docs, c)) for c in ("block", "slot", "release", "deadline", "position")))


def exact(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    frame: int = FRAME,
    block: int = BLOCK,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """docs with block, slot and position by the weights themselves, which get no shares of a frame.

    A weight that is missing, null or not positive counts as one slot of a frame.
    """
    mine, rows = _packed(docs, source_col, id_col)
    rows = rows.withColumns(
        {
            "__src": F.coalesce(F.concat(F.lit("="), F.col("__source").cast("string")), F.lit("")),
            "__h": F.md5(F.concat(F.lit("0|"), F.coalesce(F.col("__id").cast("string"), F.lit("")))),
        }
    ).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy("__src", "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__src").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__src", "__b", F.coalesce(before, F.lit(0)).alias("__off"))
    totals = counts.groupBy("__src").agg(F.sum("__n").alias("n")).orderBy("__src").collect()  # one row a source
    names, sizes = [r["__src"] for r in totals], [r["n"] for r in totals]
    given = {f"={k}": float(w) for k, w in (weights or {}).items()}
    shares = [math.sqrt(n) if weights is None else max(given.get(s, 0.0), 0.0) for s, n in zip(names, sizes)]
    block, table = max(block, -(-sum(sizes) // BLOCKS)), []
    if names:
        picks, slots = earliest_deadlines(whole_weights(shares, frame), [-(-n // block) for n in sizes])
        had, at = [0] * len(names), 0
        for i, slot in zip(picks.tolist(), slots.tolist()):
            table.append((names[i], had[i], slot, at))
            at += min(block, sizes[i] - had[i] * block)
            had[i] += 1
    places = docs.sparkSession.createDataFrame(table, "__src string, block long, slot long, __at long")
    if 4 * len(table) <= BROADCAST_CELLS:
        places = F.broadcast(places)
    number = F.row_number().over(Window.partitionBy("__src", "__b").orderBy("__h", "__id")) - 1
    ranked = rows.withColumn("__k", number).join(offsets, ["__src", "__b"]).withColumn("__k", F.col("__k") + F.col("__off"))
    placed = ranked.withColumn("block", F.floor(F.col("__k") / block)).join(places, ["__src", "block"])
    placed = placed.withColumn("position", F.col("__at") + F.pmod("__k", F.lit(block)))
    return placed.select(f"{mine}.*", *(F.col(c).cast("long").alias(unused(docs, c)) for c in ("block", "slot", "position")))


def _packed(docs: DataFrame, source_col: str, id_col: str) -> tuple[str, DataFrame]:
    """The rows of docs as one struct beside their source and id, so that no column of theirs meets one of the schedule."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return "__row", docs.select(whole.alias("__row"), F.col(source_col).alias("__source"), F.col(id_col).alias("__id"))


def whole_weights(weights: list[float], frame: int) -> list[int]:
    """The weights in units of 2**-40 of their sum; those of 0 are raised to one slot of a frame."""
    while 4 * len(weights) > frame:
        frame *= 2
    total, none = sum(weights), sum(w == 0 for w in weights)
    if none == len(weights):
        return [1] * len(weights)
    left = 1 - none / frame
    return [max(1, round((w / total * left if w else 1 / frame) * (1 << 40))) for w in weights]


def earliest_deadlines(weights: list[int], blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The source and the slot of every block, in order of the slots.

    Block j of weight w is released at floor(j W / w) and due by ceil((j + 1) W / w), W the sum.
    A source without blocks left takes no more slots; those at which no block is released stay
    empty and are passed over at once, so there are as many steps as blocks.
    """
    total, ready = sum(weights), []
    waiting = [(0, i) for i, b in enumerate(blocks) if b]
    had, picks, slots, slot = [0] * len(weights), [], [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(had[i] + 1) * total // weights[i]), i))
        i = heapq.heappop(ready)[1]
        picks.append(i)
        slots.append(slot)
        had[i] += 1
        slot += 1
        if had[i] < blocks[i]:
            heapq.heappush(waiting, (had[i] * total // weights[i], i))
    return np.array(picks, np.int64), np.array(slots, np.int64)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, partitions: int | None = None, **how) -> DataFrame:
    """docs in mixed order: the rows of a partition follow each other, and those of the next one follow them.

    Without partitions, their number follows the bytes of the texts, PARTITION_BYTES each.
    """
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in docs.schema if f.dataType.simpleString() in ("string", "binary")]
    size = docs.agg(F.count("*").alias("n"), F.sum(sum(wide, F.lit(8 * len(docs.columns))).cast("long")).alias("bytes")).first()
    partitions = partitions or max(1, -(-(size["bytes"] or 0) // PARTITION_BYTES))
    placed = exact(docs, weights, **how)
    position = placed.columns[-1]
    part = F.floor(F.col(f"`{position}`") * partitions / F.lit(max(size["n"], 1))).cast("int")
    return placed.repartitionById(partitions, part).sortWithinPartitions(f"`{position}`").select(*[F.col(f"`{c}`") for c in docs.columns])


def _weight(x: Column, weights: dict[str, float] | None) -> Column:
    if weights is None:
        return F.sqrt(x["n"].cast("double"))
    given = F.create_map(*[F.lit(v) for k, w in weights.items() for v in (f"={k}", float(w))]) if weights else None
    found = given[x["src"]] if given is not None else F.lit(None).cast("double")
    return F.greatest(F.coalesce(found, F.lit(0.0)), F.lit(0.0))


def _shares(frame: int, n: int) -> Column:
    """Whole shares of the frame: one each, the rest by largest remainders."""
    total = F.aggregate("w", F.lit(0.0), lambda t, x: t + x)
    spare = F.transform("w", lambda x: F.when(total > 0, F.round(x / total * (frame - n), 9)).otherwise(F.lit((frame - n) / max(n, 1))))
    base = F.transform(spare, lambda x: F.floor(x) + 1)
    left = F.lit(frame) - F.aggregate(base, F.lit(0).cast("long"), lambda t, x: t + x)
    order = F.array_sort(F.transform(spare, lambda x, i: F.struct((F.floor(x) - x).alias("f"), i.alias("i"))))
    lucky = F.transform(F.slice(order, F.lit(1), F.greatest(left, F.lit(0)).cast("int")), lambda o: o["i"])
    return F.transform(base, lambda b, i: b + F.when(F.array_contains(lucky, i), 1).otherwise(0))


def _frame(frame: int) -> Column:
    """For each slot of a frame the picked source and the blocks each source has had before it."""
    none = F.transform("a", lambda x: F.lit(0).cast("long"))
    empty = F.array().cast("array<struct<pick:int,had:array<bigint>>>")

    def step(state: Column, t: Column) -> Column:
        had = state["had"]
        due = F.zip_with(had, F.col("a"), lambda c, a: F.when(F.floor(c * frame / a) <= t, F.ceil((c + 1) * frame / a)))
        ready = F.filter(F.transform(due, lambda d, i: F.struct(d.alias("d"), i.alias("i"))), lambda x: x["d"].isNotNull())
        pick = F.array_min(ready)["i"]
        # array_min is bound once: the picked index travels through a one-element array.
        return F.aggregate(
            F.array(pick),
            state,
            lambda s, p: F.struct(
                F.transform(s["had"], lambda c, i: c + F.when(i == p, 1).otherwise(0)).alias("had"),
                F.concat(s["picks"], F.array(F.struct(p.alias("pick"), s["had"].alias("had")))).alias("picks"),
            ),
        )

    start = F.struct(none.alias("had"), empty.alias("picks"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(frame - 1)), start, step, lambda s: s["picks"])


#: The op2 query in DuckDB: square-root weights, frame 1024, blocks of 16 rows.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS src, md5('0|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, doc_id) - 1 AS k FROM d),
t AS (SELECT src, count(*) AS n, row_number() OVER (ORDER BY src) AS i FROM d GROUP BY src),
w AS (SELECT *, sqrt(n::DOUBLE) AS w FROM t),
x AS (SELECT *, round(w / (SELECT list_reduce(list_prepend(0::DOUBLE, list(w ORDER BY i)), lambda a, b: a + b) FROM w)
                     * (1024 - (SELECT count(*) FROM w)), 9) AS spare FROM w),
b AS (SELECT *, floor(spare)::BIGINT + 1 AS base FROM x),
s AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY floor(spare) - spare, i) <= 1024 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS a FROM b),
one AS (SELECT list(a::BIGINT ORDER BY i) AS a, list(n ORDER BY i) AS n FROM s),
edf AS (
  SELECT 0 AS slot, list_transform(a, lambda z: 0::BIGINT) AS had, NULL::BIGINT AS pick, a FROM one
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(a) + 1), lambda q: had[q] + CASE WHEN q = chosen THEN 1 ELSE 0 END), chosen, a
  FROM (
    SELECT *, list_min(list_filter(list_transform(range(1, len(a) + 1), lambda q:
        CASE WHEN had[q] * 1024 // a[q] <= slot THEN ((had[q] + 1) * 1024 + a[q] - 1) // a[q] * 1000000 + q END), lambda z: z IS NOT NULL)) % 1000000 AS chosen
    FROM edf WHERE slot < 1024
  )
),
pattern AS (
  SELECT slot - 1 AS i, pick, list_transform(range(1, len(a) + 1), lambda q: had[q] - CASE WHEN q = pick THEN 1 ELSE 0 END) AS had FROM edf WHERE slot > 0
),
g AS (SELECT r.doc_id, r.source, r.k, s.i AS src_i, s.a, r.k // 16 AS block FROM r JOIN s USING (src)),
j AS (
  SELECT g.*, p.i AS place, p.had, g.block // g.a AS f FROM g JOIN pattern p ON p.pick = g.src_i AND p.had[g.src_i] = g.block % g.a
)
SELECT doc_id, source, block::BIGINT AS block, (f * 1024 + place)::BIGINT AS slot, (block * 1024 // j.a)::BIGINT AS release,
       (((block + 1) * 1024 + j.a - 1) // j.a)::BIGINT AS deadline,
       (list_sum(list_transform(range(1, len(one.a) + 1), lambda q: least(one.n[q], (one.a[q] * f + had[q]) * 16))) + k % 16)::BIGINT AS position
FROM j, one
"""
