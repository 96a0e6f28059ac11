"""Near-duplicate documents by Order MinHash and banded alignment.

Words are lower-cased runs of word characters. A document is the sequence of its K-word
shingles, each labelled with how many equal ones came before it. A sketch hashes all
labelled shingles, takes the L smallest and keeps them in text order, so it is sensitive to
the order of what two documents share. Documents with an equal sketch are candidates.

Candidates are verified by alignment: the longest common subsequence of the labelled
shingles (a longest increasing run of matched places, within the band that the threshold
allows). With n and m shingles and c in common, similarity is c / (n + m - c), whose
complement d is a metric.

Documents of equal words are one text. In a bucket of equal sketches all texts are compared
with the smallest id, its leader, and components of these links are formed. A text that is
not in its leader's class goes on to a second step, with the texts of its bucket that the
triangle inequality does not rule out. There texts of different classes meet by a prefix
filter over their rarest shingles, in blocks of about RESIDUE_BLOCK rows, and are aligned.
So no link that would join two classes of texts that share a sketch is lost, no task ever
gathers a bucket, and passages that many texts share do not bring them all together.

Texts without words link with nothing. Texts shorter than K words are one shingle. Null ids
link with nothing. Rows that repeat an id count as one document: the text of the smallest
hash stands for it, here and in keep_first. Texts are used whole, however long. Columns of
the input may have any names; only the id and the text are read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, cut, free
from .components import components

#: Words of a shingle, shingles of a sketch, sketches, and the least similarity.
K, L, SKETCHES, SIMILARITY = 5, 3, 24, 0.8
#: Rows of a block in the second step, and rarest shingles that tell whether a pair was put forward already.
RESIDUE_BLOCK, HEAD = 4096, 16
#: Counters that order shingles by rarity (4 MB in all).
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
MEMO = 200_000
#: Keys that the copies of one text are dealt over.
SALTS = 32
WORD = re.compile(r"\w+")
FAR = 1.0


class Words(dict):
    """32-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def labelled(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles, each with its occurrence number."""
    words = words.astype(np.uint64)
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        out = _mix(out + words[j : j + n] + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(out, kind="stable")
    ordered = out[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if first.all():
        return out
    run = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    label = np.empty(n, np.uint64)
    label[order] = run.astype(np.uint64)
    return np.where(label > 0, _mix(out + label * np.uint64(0xD6E8FEB86659FD93)), out)


def sketches(shingles: np.ndarray, l: int, count: int) -> np.ndarray:
    """One 64-bit key for each sketch: its l smallest shingles in text order."""
    seeds = _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    n = len(shingles)
    least = np.tile(np.arange(min(n, l)), (count, 1))
    if n > l:
        for at, seed in enumerate(seeds):
            x = (shingles ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            least[at] = np.argpartition(x, l - 1)[:l]
        least.sort(axis=1)
    out = np.arange(count, dtype=np.uint64)
    for part in shingles[least].T:
        out = _mix(out ^ part)
    return out


def distance(a: np.ndarray, b: np.ndarray, most: float) -> float:
    """1 - c / (n + m - c) of two labelled shingle sequences, or FAR if it is over most."""
    n, m = len(a), len(b)
    need = (1 - most) * (n + m) / (2 - most)  # c that gives the distance most
    if min(n, m) < need - 1e-9:
        return FAR
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need - 1e-9:
        return FAR
    order = np.argsort(i)
    i, j = i[order], j[order]
    # Band: a path through (i, j) leaves at least |i - j| shingles unmatched on one side.
    band = n + m - 2 * need + 1
    j = j[np.abs(i - j) <= band]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect.bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        c = len(tails)
    else:
        c = len(j)
    return 1 - c / (n + m - c) if c >= need - 1e-9 else FAR


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    k: int = K,
    l: int = L,
    count: int = SKETCHES,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = RESIDUE_BLOCK,
) -> DataFrame:
    """(id, component_id, kept) for every row of docs: the smallest id of its class, and whether it is that."""
    near = 1 - similarity
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("tie")
    ).where(F.col("id").isNotNull())
    sketched = cut(
        rows.mapInArrow(lambda batches: _sketch(batches, k, l, count), "id long, tie long, print string, keys array<long>").groupBy("id").agg(
            F.min(F.struct("tie", "print", "keys")).alias("x")
        ).select("id", "x.print", "x.keys", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    )
    texts = sketched.groupBy("print").agg(F.min("id").alias("rep"), F.collect_set("salt").alias("salts"))
    reps = sketched.join(texts.select(F.col("rep").alias("id")), "id", "left_semi")
    keyed = reps.select("id", F.posexplode("keys").alias("band", "key"))
    leaders = keyed.groupBy("band", "key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(leaders, ["band", "key"]).where("id <> leader"))
    pairs = members.groupBy("leader", "id").agg(F.max("n").alias("n"))
    # Texts that need verifying, one row each; a leader comes in one copy for each block of what its largest bucket holds.
    copies = F.ceil(F.col("n") / block).cast("int")
    pairs = pairs.select("leader", "id", F.pmod(F.xxhash64("id", F.lit(1)), copies).cast("int").alias("salt"), copies.alias("copies"))
    asked = pairs.select("id", F.lit(0).alias("copies")).unionByName(pairs.select(F.col("leader").alias("id"), "copies"))
    asked = asked.groupBy("id").agg(F.max("copies").alias("copies"))
    words = rows.join(asked, "id").select("id", "copies", "tie", "text").mapInArrow(_words, "id long, copies int, tie long, words binary")
    words = cut(words.groupBy("id", "copies").agg(F.min(F.struct("tie", "words")).alias("x")).select("id", "copies", "x.words"))
    led = words.where("copies > 0").select(F.col("id").alias("leader"), F.col("words").alias("led"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    # Distances up to twice the threshold matter to the triangle inequality.
    star = cut(_aligned(pairs.join(words, "id").join(led, ["leader", "salt"]), k, 2 * near))
    links = star.where(F.col("d") <= near).select(F.col("leader").alias("a"), F.col("id").alias("b"))
    classes = components(links, "a", "b", "rep", "component")
    classes = _residue(members, star, classes, words.drop("copies"), near, k, block)
    # The copies of a text are dealt over SALTS keys; its class goes to those that hold one.
    named = texts.join(classes, "rep", "left").select("print", F.coalesce("component", "rep").alias("component"), F.explode("salts").alias("salt"))
    mine, of = free(docs, "id"), free(docs, "class")
    by_id = sketched.where(F.col("print") != "").join(named, ["print", "salt"]).select(F.col("id").alias(mine), F.col("component").alias(of))
    component = F.coalesce(of, F.col(id_col).cast("long"))
    return docs.select(F.col(id_col)).join(by_id, F.col(id_col).cast("long") == F.col(mine), "left").select(
        F.col(id_col), component.alias("component_id"), F.coalesce(F.col(id_col).cast("long") == component, F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each class, that of its smallest id; of the rows that repeat an id the one that stands for it, null ids all stay."""
    mine, row, tie = (free(docs, name) for name in ("id", "row", "tie"))
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    kept = found.where("kept").select(F.col(id_col).alias(mine)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col(mine), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = named.withColumns({row: whole, tie: F.xxhash64(text_col)}).groupBy(id_col).agg(F.min_by(row, tie).alias(row)).select(f"{row}.*")
    return once.unionByName(docs.where(F.col(id_col).isNull()))


def _sketch(batches: Iterator[pa.RecordBatch], k: int, l: int, count: int) -> Iterator[pa.RecordBatch]:
    """Digest of each text's words and its sketches; texts without words have neither."""
    words = Words()
    for batch in batches:
        for part in range(0, batch.num_rows, 512):
            some = batch.slice(part, 512)
            prints, keys = [], []
            for text in some.column("text"):
                found = WORD.findall(as_text(text.as_py()).lower())
                if not found:
                    prints.append("")
                    keys.append([])
                    continue
                prints.append(xxhash.xxh3_128_hexdigest(" ".join(found).encode("utf-8", "surrogatepass")))
                hashed = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
                keys.append(sketches(labelled(hashed, k), l, count).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [some.column("id"), some.column("tie"), pa.array(prints, pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "tie", "print", "keys"],
            )


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of each text, packed as 32-bit integers."""
    words = Words()
    for batch in batches:
        for part in range(0, batch.num_rows, 512):
            some = batch.slice(part, 512)
            out = []
            for text in some.column("text"):
                found = WORD.findall(as_text(text.as_py()).lower())
                out.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(out, pa.binary())], ["id", "copies", "tie", "words"])


def _shingles(blob: bytes, k: int) -> np.ndarray:
    return labelled(np.frombuffer(blob, "<u4"), k)


def _aligned(pairs: DataFrame, k: int, most: float) -> DataFrame:
    """(leader, id, d) of each pair of texts, given with the words of both; d is FAR if it is over most."""
    return pairs.select("leader", "id", "words", "led").mapInArrow(lambda b: _verify(b, k, most), "leader long, id long, d double")


def _verify(batches: Iterator[pa.RecordBatch], k: int, most: float) -> Iterator[pa.RecordBatch]:
    """Distance of each (leader, member) pair."""
    last, led = None, np.empty(0, np.uint64)
    for batch in batches:
        out = []
        for leader, words, blob in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if leader != last:
                last, led = leader, _shingles(blob.as_py(), k)
            out.append(distance(led, _shingles(words.as_py(), k), most))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["leader", "id", "d"])


def _residue(members: DataFrame, star: DataFrame, classes: DataFrame, words: DataFrame, near: float, k: int, block: int) -> DataFrame:
    """classes, with those joined that links between texts of one bucket join although the leaders left them apart.

    A text outside its leader's class may link to those of its bucket that are of another
    class, unless the distances to the leader rule that out. All such texts meet by a prefix
    filter: shingles are ordered by how rare they are among these texts, and two texts that
    are similar enough share one of the first n - ceil(similarity n) + 1 of both. So what
    many of them share (a passage) brings none together. The places of a shared shingle bound
    what can follow it, and pairs that pass are aligned. A pair that meets within its first HEAD
    shingles of that kind is put forward by the first of these alone.
    """
    similarity = 1 - near
    of = classes.select(F.col("rep").alias("id"), F.col("component").alias("class"))
    lead = classes.select(F.col("rep").alias("leader"), F.col("component").alias("led"))
    told = star.join(of, "id", "left").join(lead, "leader", "left")
    told = told.withColumns({"class": F.coalesce("class", "id"), "led": F.coalesce("led", "leader")})
    judged = members.drop("n").join(told, ["leader", "id"]).select("band", "key", "id", "d", "class", (F.col("class") != F.col("led")).alias("out"))
    # FAR stands for any distance over 2 near.
    outside = judged.where("out").groupBy("band", "key").agg(F.min(F.least("d", F.lit(2 * near))).alias("nearest"))
    # A member at d from the leader can link to a text at nearest or more only if d + near >= nearest.
    left = judged.join(outside, ["band", "key"]).where(F.col("out") | (F.col("d") + near + 1e-9 >= F.col("nearest")))
    rest = cut(left.groupBy("id", "class").agg(F.max("out").alias("out")).join(words, "id"))
    if rest.isEmpty():
        return classes
    # At most SLOTS rows reach the driver. They only order the shingles: any order is right.
    found = rest.select("words").mapInArrow(lambda b: _tally(b, k), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, np.uint32)
    table[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 2**32 - 1)
    shared = rest.sparkSession.sparkContext.broadcast(table)
    columns = "id long, out boolean, shingle long, n int, at int"
    keyed = cut(rest.select("id", "out", "words").mapInArrow(lambda b: _rarest(b, k, similarity, shared.value), columns))
    texts = rest.select("id", "words")
    now = keyed.join(of, "id", "left").withColumn("class", F.coalesce("class", "id"))
    sizes = now.groupBy("shingle").agg(
        F.count("*").alias("n_all"), F.sum(F.col("out").cast("int")).alias("n_out"), F.min("class").alias("lo"), F.max("class").alias("hi")
    )
    sizes = sizes.where("n_out > 0 AND lo <> hi").drop("lo", "hi")
    # Each outside text meets every text with its shingle: outside blocks times all blocks.
    met = cut(now.join(sizes, "shingle"))
    # A text's first shingles that bring it together with others; zeros fill up.
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "shingle"))), lambda x: x["shingle"])
    zeros = F.array_repeat(F.lit(0).cast("long"), HEAD)
    heads = met.groupBy("id").agg(F.slice(F.concat(listed, zeros), 1, HEAD).alias("heads"))
    met = met.join(heads, "id")
    n_out, n_all = F.ceil(F.col("n_out") / block).cast("int"), F.ceil(F.col("n_all") / block).cast("int")
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = met.where("out").select(*now.columns, "heads", F.lit(True).alias("asks"), place(n_out).alias("one"), spread(n_all).alias("two"))
    told = met.select(*now.columns, "heads", F.lit(False).alias("asks"), spread(n_out).alias("one"), place(n_all).alias("two"))

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, kind, n = (table.column(c).to_numpy() for c in ("id", "class", "n"))
        after = n - table.column("at").to_numpy()  # the shared shingle and those behind it
        out = table.column("out").to_numpy(zero_copy_only=False)
        who, told, pairs = np.nonzero(asks)[0], np.nonzero(~asks)[0], []
        shingle, heads = table.column("shingle")[0].as_py(), np.array(table.column("heads").to_pylist(), np.int64)
        for s in range(0, len(who), 256):
            some = who[s : s + 256, None]
            need = similarity * (n[some] + n[told]) / (1 + similarity)
            hit = (kind[some] != kind[told]) & (np.minimum(after[some], after[told]) >= need - 1e-9) & ~(out[told] & (ids[told] < ids[some]))
            i, j = np.nonzero(hit)
            i, j = some[i, 0], told[j]
            for t in range(0, len(i), 65536):
                p, q = i[t : t + 65536], j[t : t + 65536]
                meet = (heads[p][:, :, None] == heads[q][:, None, :]).any(axis=2) & (heads[p] != 0)
                first = heads[p, meet.argmax(axis=1)]
                own = ~meet.any(axis=1) | (first == shingle)
                pairs.append((ids[p[own]], ids[q[own]]))
        a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.empty(0, np.int64),) * 2
        return pa.table({"leader": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64())})

    pairs = asks.unionByName(told).groupBy("shingle", "one", "two").applyInArrow(compare, "leader long, id long").distinct()
    pairs = pairs.join(texts, "id").join(texts.select(F.col("id").alias("leader"), F.col("words").alias("led")), "leader")
    # Cut, so that no task holds the workers of the alignment and of the components at once.
    return _joined(classes, cut(_aligned(pairs, k, near).where(F.col("d") <= near)))


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes after more links (leader, id)."""
    edges = classes.select(F.col("rep").alias("a"), F.col("component").alias("b")).unionByName(links.select(F.col("leader").alias("a"), F.col("id").alias("b")))
    return components(edges, "a", "b", "rep", "component")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """How many shingles fall into each slot."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for part in range(0, batch.num_rows, 512):
            found = [_slots(_shingles(blob.as_py(), k)) for blob in batch.column(0).slice(part, 512)]
            at, n = np.unique(np.concatenate(found), return_counts=True)
            total[at] += n
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["slot", "n"])


def _ordered(own: np.ndarray, table: np.ndarray, most: int) -> np.ndarray:
    """Where a text's rarest shingles are, the rarest first."""
    return np.lexsort((own, table[_slots(own)]))[:most]


def _rarest(batches: Iterator[pa.RecordBatch], k: int, similarity: float, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each text with their places."""
    for batch in batches:
        rows, shingles, sizes, places = [], [], [], []
        for row, blob in enumerate(batch.column(2)):
            own = _shingles(blob.as_py(), k)
            first = _ordered(own, table, len(own) - math.ceil(similarity * len(own) - 1e-9) + 1)
            rows.append(np.full(len(first), row))
            shingles.append(own[first].astype(np.int64))
            sizes.append(np.full(len(first), len(own), np.int32))
            places.append(np.arange(len(first), dtype=np.int32))
        if not rows:
            continue
        by_text = batch.select(["id", "out"]).take(pa.array(np.concatenate(rows), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*by_text.columns, *(pa.array(np.concatenate(x)) for x in (shingles, sizes, places))], ["id", "out", "shingle", "n", "at"]
        )
