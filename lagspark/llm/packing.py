"""Packing of documents into sequences of a fixed size by best fit decreasing.

A document's ids (those of the tokenizer, then an end id) are first cut into full windows of
``size`` ids. What is left of the documents is dealt into groups of about GROUP_BYTES of text
by a hash, and each group is packed by itself: the longest piece first, each into the open
window with the least room that still holds it. A segment tree over remaining capacities
finds that window. Groups grow in number with the input, never in size, and one long document
is spread over them window by window.

Best fit leaves some windows open. Their room is filled by cutting up the emptiest of them
(``top_up``), and the last one left in a group is cut into windows whose lengths are powers of
two, which need no padding. So a group has no padding at all, whatever the lengths are.

Null texts are empty and hold the end id only. Rows that repeat an id are packed each for
itself; a null id stays null. Of equal lengths the smaller id goes first. An empty table gives
no rows. Only the id and the text are read, so other columns may have any names. A row's group
depends on its place within its partition, so docs should come from files (or a table cut by
a checkpoint), whose partitions are read again alike when an executor is lost.
"""

from __future__ import annotations

import functools
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text

#: Bytes of text that one group packs, on average.
GROUP_BYTES = 16 << 20
#: Texts are encoded in stretches of about so many characters.
STRETCH = 1 << 18
#: A space between two other characters begins a new run of the split pattern, so text may be cut before it.
BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Runs of white space of this length go to the slower library, whose pattern matcher has no stack.
LONG_SPACE = re.compile(r"\s{4096}")
#: The split pattern of byte-level tokenizers (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them.

    The file's vocabulary is run by tiktoken, which gives the same ids faster (tests compare
    both); texts with very long runs of white space go to tokenizers itself.
    """

    def __init__(self, definition: bytes):
        import tiktoken

        self.definition = definition
        made = json.loads(definition)
        special = {t["content"]: t["id"] for t in made["added_tokens"] if t["special"]}
        ranks = {_as_bytes(k): v for k, v in made["model"]["vocab"].items() if k not in special}
        self.special = set(special)
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.dtype = np.dtype("<u2" if self.fast.max_token_value < 1 << 16 else "<u4")

    @functools.cached_property
    def slow(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.definition.decode())

    def stretches(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > STRETCH:
            border = BORDER.search(text, start + STRETCH)
            if border is None:
                break
            yield text[start : border.start()]
            start = border.start()
        yield text[start:]

    def ids(self, text: str) -> np.ndarray:
        parts = []
        for part in self.stretches(text):
            if len(part) >= 4096 and LONG_SPACE.search(part):
                parts.append(self.slow.encode(part, add_special_tokens=False).ids)
            else:
                parts.append(self.fast.encode_to_numpy(part, allowed_special=self.special, disallowed_special=()))
        return np.concatenate([np.asarray(p, self.dtype) for p in parts])


def _as_bytes(token: str) -> bytes:
    return bytes(_byte_letters()[c] for c in token)


@functools.lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def encoder(definition: bytes) -> Encoder:
    return Encoder(definition)


class Windows:
    """Open windows by what they still hold: a segment tree over capacities 0 to size."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def tightest(self, need: int) -> int:
        """The least capacity of an open window that is need or more; -1 if there is none."""
        at, some = need + self.leaves, self.some
        if some[at]:
            return need
        while at > 1:
            if not at & 1 and some[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if some[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1

    def put(self, window: int, capacity: int) -> None:
        self.open[capacity].append(window)
        at = capacity + self.leaves
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, capacity: int) -> int:
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            at = capacity + self.leaves
            self.some[at] = 0
            while at > 1 and not self.some[at ^ 1]:
                at >>= 1
                self.some[at] = 0
        return window


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """The pieces (by number, in falling length) of each window."""
    windows, packed = Windows(size), []
    for piece, length in enumerate(lengths):
        room = windows.tightest(length)
        if room < 0:
            window, room = len(packed), size
            packed.append([])
        else:
            window = windows.take(room)
        packed[window].append(piece)
        if room > length:
            windows.put(window, room - length)
    return packed


def top_up(packed: list[list[tuple[int, int, int]]], size: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (piece, from, to) without padding: see the module's text."""
    load = lambda w: sum(b - a for _, a, b in w)
    full, part = [], []
    for window in packed:
        (full if load(window) == size else part).append(window)
    part.sort(key=load)
    givers = 0  # part[:givers] are used up
    while len(part) - givers > 1:
        window = part.pop()
        room = size - load(window)
        while room and givers < len(part):
            piece, a, b = part[givers].pop()
            cut = min(room, b - a)
            window.append((piece, a, a + cut))
            room -= cut
            if a + cut < b:
                part[givers].append((piece, a + cut, b))
            if not part[givers]:
                givers += 1
        if room:
            part.append(window)
            break
        full.append(window)
    for window in part[givers:]:
        left = load(window)
        while left:
            most, taken = 1 << (left.bit_length() - 1), []
            left -= most
            while most:
                piece, a, b = window.pop(0)
                cut = min(most, b - a)
                taken.append((piece, a, a + cut))
                most -= cut
                if a + cut < b:
                    window.insert(0, (piece, a + cut, b))
            full.append(taken)
    return full


def pack(
    docs: DataFrame,
    tokenizer: bytes,
    size: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    fill: bool = True,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row a piece: its document, start, length and ids_crc32, doc_tokens, sequence_id, offset and the sequence's padding.

    ids (little-endian unsigned 32-bit, with_ids) are the piece's own. Without ``fill`` windows
    stay as best fit leaves them. tokenizer holds a tokenizer file's bytes. Sequence ids are
    unique; they are the group's number and the window's within it.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("the size is a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(1, math.ceil(total / group_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    narrow = encoder(tokenizer).dtype

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task, place = encoder(shared.value), TaskContext.get().partitionId(), 0

        def made():
            nonlocal out, held
            docs_, places, starts, totals, ids = zip(*out)
            out, held = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array(docs_, batch.schema.field(0).type), pa.array([task] * len(ids), pa.int32()), pa.array(places, pa.int64()), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())],
                ["doc", "task", "place", "start", "total", "ids"],
            )

        for batch in batches:
            out, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(codec.ids(as_text(text.as_py())), np.array([end_id], narrow))
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size].tobytes()
                    out.append((doc, place, start, len(ids), piece))
                    place, held = place + 1, held + len(piece)
                    if held > 4 << 20:
                        yield made()
            if out:
                yield made()

    def fit(table: pa.Table) -> pa.Table:
        group = table.column("grp")[0].as_py()
        ids = [np.frombuffer(x, narrow).astype("<u4") for x in table.column("ids").to_pylist()]
        doc, start = table.column("doc").to_pylist(), table.column("start").to_pylist()
        marks = [zlib.crc32(x) for x in ids]
        order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), doc[i] is None, doc[i] if doc[i] is not None else 0, start[i], marks[i]))
        lengths = [len(ids[i]) for i in order]
        packed = [[(p, 0, lengths[p]) for p in window] for window in best_fit(lengths, size)]
        if fill:
            packed = top_up(packed, size)
        found = []
        for number, window in enumerate(packed):
            load, offset = sum(b - a for _, a, b in window), 0
            padding = 0 if load & (load - 1) == 0 else size - load
            for p, a, b in window:
                i = order[p]
                own = ids[i][a:b]
                found.append((i, start[i] + a, b - a, marks[i] if b - a == len(ids[i]) else zlib.crc32(own), (group << 40) + number, offset, padding, own.tobytes() if with_ids else None))
                offset += b - a
        rows, *rest = zip(*found)
        rows = pa.array(rows)
        longs = [pa.array(x, pa.int64()) for x in rest[:6]]
        out = [table.column("doc").take(rows), longs[0], longs[1], longs[2], table.column("total").take(rows), *longs[3:]]
        return pa.table([*out, pa.array(rest[6], pa.binary())] if with_ids else out, names=names)

    names = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding", *["ids"] * with_ids]
    pieces = source.mapInArrow(cut, f"doc {kind}, task int, place long, start long, total long, ids binary")
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc", "task", "place"), F.lit(n_groups)))
    schema = f"doc {kind}, " + ", ".join(f"{c} long" for c in names[1:8]) + (", ids binary" if with_ids else "")
    return dealt.select("grp", "doc", "start", "total", "ids").groupBy("grp").applyInArrow(fit, schema).withColumnRenamed("doc", id_col)


def load_tokenizer(path: str) -> bytes:
    """The bytes of a tokenizer file on the driver."""
    with open(path, "rb") as file:
        return file.read()


__all__ = ["Encoder", "Windows", "best_fit", "load_tokenizer", "pack", "top_up"]
