"""Removal of repeated word windows by Rabin-Karp hashes counted in Spark.

Words are runs without ASCII white space, unchanged. Every window of ``width`` consecutive
words of a document gets a polynomial hash over 64 bits, rolled by prefix sums. A task cuts
its windows into units of at most 65,536, drops repeats within a unit (they are known to be
repeated already), and sends each hash with its place in the unit to the bucket of that
hash; the bucket counts hashes over all units. Places of repeated hashes go back to their
units, become word intervals of the documents, and adjacent windows merge into maximal
intervals. Windows are judged on the input, not on what is left. A hot window costs its
bucket one entry a unit. Two different windows are confused with a chance of about 7e-12
a window: each bucket holds about BUCKET windows, told apart by 56 bits.

Null texts have no words; texts shorter than a window lose nothing. Rows that repeat an id
and a text are copies of each other: each is judged against the other. Each row of the
input gives one row. An empty table gives an empty one. Texts are used whole, however long.
Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN_WORD, as_text

#: Windows of a unit; a place in it fits 16 bits.
UNIT = 65_536
#: Windows that a bucket is meant to hold.
BUCKET = 500_000
#: Words that a task remembers the hashes of.
MEMO = 200_000
BASE = 0x9E3779B97F4A7C15
M64 = (1 << 64) - 1

UNITS = "bucket int, unit long, places binary, ids array<long>, prints array<long>, starts array<int>, counts array<int>"


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


class Rolling:
    """Polynomial window hashes: sums of h[i + j] * base**-j modulo 2**64."""

    def __init__(self, width: int):
        self.width, self.up, self.down = width, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if n < self.width:
            return np.empty(0, np.uint64)
        if len(self.up) < n:
            size = max(2 * len(self.up), n)
            for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.down[:n])])
        out = (sums[self.width :] - sums[: -self.width]) * self.up[: n - self.width + 1]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(32)


def repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, n_words, n_removed, starts, ends, kept): words [start, end) are removed, kept is the rest joined by spaces."""
    return _apply(docs, intervals(docs, width, id_col, text_col, bucket), id_col, text_col, digest=False)


def digests(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of repeats()."""
    return _apply(docs, intervals(docs, width, id_col, text_col, bucket), id_col, text_col, digest=True)


def intervals(docs: DataFrame, width: int, id_col: str, text_col: str, bucket: int = BUCKET) -> DataFrame:
    """(id, print, starts, ends) of the documents that lose words; print tells apart texts of one id."""
    if width < 1:
        raise ValueError("a window has at least one word")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).cast("binary").alias("text")
    )
    # About one word in six bytes; the count of buckets follows the input.
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    buckets = max(64, -(-size // (6 * bucket)))
    units = rows.mapInArrow(lambda batches: _units(batches, width, buckets), UNITS)
    counted = units.groupBy("bucket").applyInArrow(_count, UNITS)
    spans = counted.groupBy("unit").applyInArrow(lambda t: _spans(t, width), "id long, print long, starts array<int>, ends array<int>")
    return spans.groupBy("id", "print").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )


def _units(batches: Iterator[pa.RecordBatch], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Directory rows (bucket below 0) and bucket rows of each unit."""
    task, number = TaskContext.get().partitionId() << 32, 0
    words, roll = WordHashes(), Rolling(width)
    held: list[np.ndarray] = []
    where: list[tuple] = []  # id, print, first window, windows
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal held, where, size, number
        out = _unit(np.concatenate(held), where, task | number, buckets)
        held, where, size, number = [], [], 0, number + 1
        return out

    for batch in batches:
        for i, p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = PLAIN_WORD.findall(as_text(text.as_py()))
            if len(found) < width:
                continue
            hashes = roll(np.fromiter(map(words.__getitem__, found), np.uint64, len(found)))
            at = 0
            while at < len(hashes):
                part = hashes[at : at + UNIT - size]
                held.append(part)
                where.append((i, p, at, len(part)))
                at, size = at + len(part), size + len(part)
                if size == UNIT:
                    yield flush()
    if size:
        yield flush()


def _unit(hashes: np.ndarray, where: list[tuple], unit: int, buckets: int) -> pa.RecordBatch:
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    again = ~fresh | np.concatenate([~fresh[1:], [False]])
    repeated = np.sort(order[again]).astype("<u2")
    first, key = np.sort(order[fresh]), None
    key = hashes[first]
    to = (key % np.uint64(buckets)).astype(np.int64)
    left = key // np.uint64(buckets) & np.uint64((1 << 56) - 1)
    by = np.argsort(to, kind="stable")
    to, left, first = to[by], left[by], first[by].astype("<u2")
    names, starts = np.unique(to, return_index=True)
    ends = [*starts[1:].tolist(), len(to)]
    raw = left.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
    blobs = [raw[a:b].tobytes() + first[a:b].tobytes() for a, b in zip(starts.tolist(), ends)]
    n = len(names)
    ids, prints, begins, counts = zip(*where)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*names.tolist(), -1 - unit % buckets], pa.int32()),
            pa.array([unit] * (n + 1), pa.int64()),
            pa.array([*blobs, repeated.tobytes()], pa.binary()),
            *(
                pa.array([None] * n + [list(x)], pa.list_(kind))
                for x, kind in ((ids, pa.int64()), (prints, pa.int64()), (begins, pa.int32()), (counts, pa.int32()))
            ),
        ],
        ["bucket", "unit", "places", "ids", "prints", "starts", "counts"],
    )


def _count(table: pa.Table) -> pa.Table:
    """Of each unit's entries in a bucket, the places whose hash another unit has too; directory rows pass."""
    if not table.num_rows or table.column("bucket")[0].as_py() < 0:
        return table
    blobs = table.column("places").to_pylist()
    sizes = np.array([len(b) // 9 for b in blobs])
    wide = np.zeros((sizes.sum(), 8), np.uint8)
    np.concatenate([np.frombuffer(b, np.uint8, 7 * n).reshape(n, 7) for b, n in zip(blobs, sizes)], out=wide[:, :7])
    keys = wide.view("<u8").ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    hit = np.zeros(len(keys), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    ends = np.cumsum(sizes)
    out = [np.frombuffer(b, "<u2", n, 7 * n)[hit[e - n : e]].tobytes() for b, n, e in zip(blobs, sizes, ends)]
    table = table.set_column(2, "places", pa.array(out, pa.binary()))
    return table.filter(pa.array([len(x) > 0 for x in out]))


def _spans(table: pa.Table, width: int) -> pa.Table:
    """The word intervals that a unit's repeated windows cover, by document."""
    bucket = table.column("bucket").to_numpy()
    hit = np.zeros(UNIT, bool)
    for blob in table.column("places").to_pylist():
        hit[np.frombuffer(blob, "<u2")] = True
    row = int(np.nonzero(bucket < 0)[0][0])
    ids, prints, firsts, counts = (table.column(c)[row].as_py() for c in ("ids", "prints", "starts", "counts"))
    out, at = [], 0
    for i, p, first, n in zip(ids, prints, firsts, counts):
        starts = np.nonzero(hit[at : at + n])[0] + first
        at += n
        if len(starts):
            cut = np.concatenate([[True], np.diff(starts) > width])
            last = np.concatenate([starts[np.nonzero(cut)[0][1:] - 1], starts[-1:]])
            out.append((i, p, starts[cut], last + width))
    ids, prints, starts, ends = zip(*out) if out else ((), (), (), ())
    return pa.table(
        {
            "id": pa.array(ids, pa.int64()),
            "print": pa.array(prints, pa.int64()),
            "starts": pa.array(starts, pa.list_(pa.int32())),
            "ends": pa.array(ends, pa.list_(pa.int32())),
        }
    )


def _apply(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """The words that stay of every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__print"), F.col(text_col).cast("binary").alias("__text"))
    joined = rows.join(spans, F.col("__id").cast("long").eqNullSafe(F.col("id")) & (F.col("__print") == F.col("print")), "left").select(
        "__id", "__text", "starts", "ends"
    )
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                rows = batch.slice(part, 512)
                made = [_keep(t.as_py(), a.as_py(), b.as_py(), digest) for t, a, b in zip(*rows.columns[1:])]
                total, removed, starts, ends, kept = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
                    + ([] if digest else [pa.array(starts, ints), pa.array(ends, ints)])
                    + [pa.array(kept, pa.string())],
                    [id_col, "n_words", "n_removed", *([] if digest else ["starts", "ends"]), "kept_sha256" if digest else "kept"],
                )

    last = "kept_sha256 string" if digest else "starts array<int>, ends array<int>, kept string"
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, {last}")


def _keep(text: bytes | None, starts: list[int] | None, ends: list[int] | None, digest: bool) -> tuple:
    words = PLAIN_WORD.findall(as_text(text))
    total, spans, kept, at = len(words), [], [], 0
    for a, b in sorted(zip(starts or (), ends or ())):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    out = " ".join(kept)
    if digest:
        out = hashlib.sha256(out.encode("utf-8")).hexdigest()
    return total, total - len(kept), [a for a, _ in spans], [b for _, b in spans], out
