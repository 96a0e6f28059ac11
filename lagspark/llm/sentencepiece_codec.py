"""SentencePiece encoding with source offsets, and decoding, for BPE models.

The text is normalised by longest-prefix matches in the model's compiled character map.
Each normalised byte remembers the source bytes it came from, so that every piece can be
projected to its span [begin, end) in the UTF-8 bytes of the original text. Encoding and
spans come from this one pass; where no key of the map starts with a byte of the text, its
look-ups are skipped, and the same alignment is written in arrays.
BPE merges then run inside runs that no piece of the vocabulary crosses; such runs recur
all over a corpus, so each task keeps a bounded memo of them. The runs that a block of texts
adds are merged together, one merge of every run at a time, in arrays.

Nulls count as empty texts. Repeated rows and ids give one row each. An empty text has
the begin and end ids only and decodes to the empty text. Texts are used whole, however long.
An empty table gives an empty one. Only the id and the text are read, so other columns may
have any names.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Runs that a task remembers; the memo starts anew beyond it.
MEMO = 200_000
#: Widths of the arrays that runs are merged in; longer ones are merged one by one.
WIDTHS = (8, 12, 16, 24, 40)
WIDEST = WIDTHS[-1]
NEVER = 1 << 62


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


class CharMap:
    """Longest-prefix lookup in a compiled character map (double-array trie and strings)."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.strings = blob[4 + size :]
        root = _offset(self.units[0]) if self.units else 0
        #: Bytes that some key starts with.
        self.firsts = bytes(b for b in range(1, 256) if self.units and (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key that starts at data[at]."""
        units, found = self.units, None
        if not units:
            return None
        node = _offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.strings[start : self.strings.index(b"\0", start)]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


class Codec:
    """One model's normaliser, merger and decoder."""

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        charmap, self.dummy, self.squeeze, self.escape = b"", True, True, True
        self.fallback, self.unk_surface, kind = False, " ⁇ ", 1
        for number, value in _fields(model):
            if number == 1:
                piece, score, sort = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode("utf-8")
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        sort = v
                self.pieces.append((piece, score, sort))
            elif number == 2:
                for k, v in _fields(value):
                    if k == 3:
                        kind = v
                    elif k == 35:
                        self.fallback = bool(v)
                    elif k == 44:
                        self.unk_surface = v.decode("utf-8")
            elif number == 3:
                for k, v in _fields(value):
                    if k == 2:
                        charmap = v
                    elif k == 3:
                        self.dummy = bool(v)
                    elif k == 4:
                        self.squeeze = bool(v)
                    elif k == 5:
                        self.escape = bool(v)
        sorts = {sort for *_, sort in self.pieces}
        if kind != BPE or sorts & {USER_DEFINED, UNUSED}:
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        self.map = CharMap(charmap)
        self.ids = {p: i for i, (p, _, sort) in enumerate(self.pieces) if sort == NORMAL}
        self.scores = {p: s for p, s, sort in self.pieces if sort == NORMAL}
        self.unk = next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)
        by_name = {p: i for i, (p, _, sort) in enumerate(self.pieces) if sort == CONTROL}
        self.bos, self.eos = by_name["<s>"], by_name["</s>"]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, sort) in enumerate(self.pieces) if sort == BYTE}
        surface = {UNKNOWN: self.unk_surface.encode(), CONTROL: b""}
        self.surface = [
            bytes([int(p[3:5], 16)]) if sort == BYTE else surface.get(sort, p.replace(SPACE, " ").encode())
            for p, _, sort in self.pieces
        ]
        #: Normalised bytes that a piece stands for.
        self.width = np.array([1 if sort == BYTE else 0 if sort == CONTROL else len(p.encode()) for p, _, sort in self.pieces], np.int64)
        #: No piece holds a space mark after another character: merges never cross such a place.
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.splits else "(?s).+")
        self.memo = Memo(self.run_ids)
        self.chars = frozenset(p for p in self.ids if len(p) == 1)
        self._pairs()

    # Normalising.

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the source byte it starts from."""
        if not self.squeeze and not any(b in data for b in self.map.firsts):
            return self._identity(data)
        at, out, origin = 0, bytearray(), []
        if self.squeeze:
            while at < len(data):
                size, new = self.prefix(data, at)
                if new != b" ":
                    break
                at += size
        if at == len(data):
            return b"", np.zeros(1, np.int64)
        mark = SPACE.encode() if self.escape else b" "
        if self.dummy:
            out += mark
            origin += [at] * len(mark)
        after_space = self.squeeze
        while at < len(data):
            size, new = self.prefix(data, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put = new.replace(b" ", mark)
                out += put
                origin += [at] * len(put)
                after_space = self.squeeze and new.endswith(b" ")
            at += size
        end = at
        if self.squeeze:
            while out.endswith(mark):
                end = origin[-len(mark)]
                del out[-len(mark) :], origin[-len(mark) :]
        return bytes(out), np.array([*origin, end], np.int64)

    def _identity(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """normalise() where every look-up leaves its character as it is."""
        if not data:
            return b"", np.zeros(1, np.int64)
        mark = SPACE.encode() if self.escape else b" "
        codes = np.frombuffer(data, np.uint8)
        # A character's bytes start from its first one.
        first = np.maximum.accumulate(np.where(codes & 0xC0 != 0x80, np.arange(len(data)), 0))
        head = [0] * len(mark) if self.dummy else []
        origin = np.concatenate([head, np.repeat(first, np.where(codes == 0x20, len(mark), 1)), [len(data)]]).astype(np.int64)
        return (mark if self.dummy else b"") + data.replace(b" ", mark), origin

    def prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at)
        if found:
            return found
        first = data[at]
        size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return size, data[at : at + size]

    # Encoding.

    def run_ids(self, run: str) -> bytes:
        """Ids of one run, packed as little-endian unsigned 32-bit integers."""
        out: list[int] = []
        for piece in self.merged(run):
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.fallback:
                out += [self.bytes[b] for b in piece.encode("utf-8")]
            else:
                out.append(self.unk)
        return array("I", out).tobytes()

    def _pairs(self) -> None:
        """Sorted codes of the pairs of pieces that merge, with the rank of each and its merged piece."""
        ids, found = self.ids, []
        rank = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    found.append((a * len(self.pieces) + b, rank[self.scores[piece]], i))
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.pair_code, self.pair_rank, self.pair_piece = (np.append(table[:, k], NEVER) for k in range(3))

    def learn_runs(self, runs: Iterable[str]) -> None:
        """Put the ids of runs that are not in the memo yet into it."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        memo = self.memo
        known, groups = self.chars.issuperset, {w: [] for w in WIDTHS}
        width = [next(w for w in WIDTHS if n <= w) for n in range(WIDEST + 1)]
        for run in set(runs):
            if run in memo:
                continue
            n = len(run)
            if n <= WIDEST and known(run):
                groups[width[n]].append(run)
            elif n <= 64:
                self.memo[run] = self.run_ids(run)
        for w, some in groups.items():
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                self.memo.update(zip(part, self._merge_many(part, w)))

    def _merge_many(self, runs: list[str], width: int) -> list[bytes]:
        """Packed ids of runs of at most width characters that are pieces each."""
        n, size = len(runs), len(self.pieces)
        lengths = np.fromiter(map(len, runs), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        piece = np.full((n, width + 1), -1, np.int64)
        piece[:, :width][inside] = np.fromiter(map(self.ids.__getitem__, "".join(runs)), np.int64, int(lengths.sum()))
        after = np.where(np.arange(1, width + 2) < lengths[:, None], np.arange(1, width + 2), width)
        before = np.tile(np.arange(-1, width), (n, 1))
        rank = np.full((n, width + 1), NEVER, np.int64)
        into = np.zeros((n, width + 1), np.int64)

        def look(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            a, b = piece[rows, left], piece[rows, right]
            code = np.where((a >= 0) & (b >= 0), a * size + b, -1)
            at = np.searchsorted(self.pair_code, code)
            hit = self.pair_code[at] == code
            rank[rows, left] = np.where(hit, self.pair_rank[at], NEVER)
            into[rows, left] = self.pair_piece[at]

        rows, columns = np.nonzero(inside[:, 1:])
        look(rows, columns, columns + 1)
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(axis=1)
            go = rank[live, best] < NEVER
            live, best = live[go], best[go]
            gone = after[live, best]
            then = after[live, gone]
            piece[live, best] = into[live, best]
            piece[live, gone] = -1
            rank[live, gone] = NEVER
            after[live, best] = then
            before[live, then] = best
            look(live, best, then)
            first = before[live, best]
            has = first >= 0
            look(live[has], first[has], best[has])
        left = piece >= 0
        packed = piece[left].astype("<u4").tobytes()
        ends = np.cumsum(left.sum(axis=1)).tolist()
        return [packed[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def merged(self, run: str) -> list[str]:
        """Pieces after all merges: best score first, then the leftmost."""
        scores, parts = self.scores, list(run)
        if len(parts) > 48:
            return self._merged_long(parts)
        get, none = scores.get, -np.inf
        pair = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pair:
            best = max(pair)
            if best == none:
                break
            i = pair.index(best)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same by a heap over a linked list, for runs of any length."""
        get, n = self.scores.get, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-s, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (s := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if j < 0 or not parts[i] or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (s := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (-s, a, parts[a] + parts[b]))
        return [p for p in parts if p]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text with begin and end ids."""
        return np.frombuffer(self.packed(self.split(text)), "<u4")

    def split(self, text: str) -> list[str]:
        """The runs of the normalised text; none for the empty text."""
        return self.aligned(text)[0]

    def aligned(self, text: str) -> tuple[list[str], np.ndarray]:
        """The runs of the normalised text, and the source byte of each normalised byte and the end."""
        norm, origin = self.normalise(text.encode("utf-8"))
        return self.runs.findall(norm.decode("utf-8")), origin

    def packed(self, runs: list[str]) -> bytes:
        body = b"".join(map(self.memo.__getitem__, runs))
        return struct.pack("<I", self.bos) + body + struct.pack("<I", self.eos)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans [begin, end) of the ids in the UTF-8 bytes of the text."""
        return self.project(self.normalise(text.encode("utf-8"))[1], ids)

    def project(self, origin: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The spans of ids by the alignment of their text."""
        ends = np.minimum(np.cumsum(self.width[ids]), len(origin) - 1)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return origin[begins], origin[ends]

    # Decoding.

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of ids; begin and end ids vanish, and the leading space mark is dropped."""
        ids = np.asarray(ids, np.int64)
        surface = self.surface
        parts = [surface[i] for i in ids.tolist()]
        if self.dummy or self.squeeze:
            for k, i in enumerate(ids.tolist()):
                sort = self.pieces[i][2]
                if sort == CONTROL:
                    continue
                if sort == NORMAL and self.pieces[i][0].startswith(SPACE):
                    parts[k] = parts[k].lstrip(b" ") if self.squeeze else parts[k][1:]
                break
        return as_text(b"".join(parts))


class Memo(dict):
    """Ids of the runs seen so far, of bounded size."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, run: str) -> bytes:
        out = self.make(run)
        if len(run) <= 64 and len(self) < 2 * MEMO:
            self[run] = out
        return out


def load_model(path: str) -> bytes:
    """The bytes of a model file on the driver."""
    with open(path, "rb") as file:
        return file.read()


#: Columns that encode() can return besides the id, and their types.
COLUMNS = {
    "ids": "array<int>",
    "begins": "array<int>",
    "ends": "array<int>",
    "decoded": "string",
    "n_tokens": "long",
    "covered_bytes": "long",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", columns=("ids", "begins", "ends", "decoded")) -> DataFrame:
    """One row per row of docs: its id and the asked-for columns of its encoded text.

    ids, begins and ends are parallel; the spans are bytes of the original UTF-8 text.
    decoded is decode(ids). The digests are of exactly these ids and that text, made in
    the task so that long arrays need not leave it. covered_bytes sums the spans.
    """
    columns = list(columns)
    schema = docs.select(F.col(id_col)).schema[0]
    # Shipped once to each executor, not with each task.
    model_bytes = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_bytes.value)
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                rows = batch.slice(part, 64)
                texts = [as_text(value.as_py()) for value in rows.column(1)]
                split = [codec.aligned(text) for text in texts]
                codec.learn_runs(itertools.chain.from_iterable(runs for runs, _ in split))
                out: dict[str, list] = {c: [] for c in columns}
                for runs, origin in split:
                    made = _row(codec, runs, origin, columns)
                    for name in columns:
                        out[name].append(made[name])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *(pa.array(out[c], ARROW[COLUMNS[c]]) for c in columns)], [id_col, *columns]
                )

    return source.mapInArrow(run, f"`{id_col}` {schema.dataType.simpleString()}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns))


ARROW = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "long": pa.int64()}


def _row(codec: Codec, runs: list[str], origin: np.ndarray, columns: list[str]) -> dict:
    packed = codec.packed(runs)
    ids = np.frombuffer(packed, "<u4")
    out: dict = {}
    if "begins" in columns or "ends" in columns or "covered_bytes" in columns:
        out["begins"], out["ends"] = codec.project(origin, ids)
        out["covered_bytes"] = int((out["ends"] - out["begins"]).sum())
    if "decoded" in columns or "decoded_sha256" in columns:
        out["decoded"] = codec.decode(ids)
        out["decoded_sha256"] = hashlib.sha256(out["decoded"].encode("utf-8")).hexdigest() if "decoded_sha256" in columns else None
    if "ids_sha256" in columns:
        out["ids_sha256"] = hashlib.sha256(packed).hexdigest()
    return out | {"ids": ids.astype(np.int32), "n_tokens": len(ids)}
