"""Language identification as a mixture: expectation-maximisation over n-gram likelihoods.

A language's model is the distribution of hashed character trigrams of its words, with
marks for a word's ends. A document is a mixture: each of its words has a likelihood under
every language, and EM estimates the proportions. The set of languages grows in the order
of the proportions while the penalised likelihood (BIC) rises: a language is taken
only if it explains the words better by more than its parameter costs. The prediction is
the language with the largest proportion in the chosen set, the score that proportion.
Each document stops by itself, so its result is the same in any batch. Words count by how
often they stand in the document, so memory follows the different words of a few texts, not
the length of the longest ones.

Learning uses at most about PER_LANGUAGE labelled documents of each language (a hash of the
row picks them), never held-out ones. Texts are used whole, however long. A text that is
null or has no letter (Unicode category L) gets ``und`` with score 0, as does every text when
nothing could be learned; keep_identified then keeps what has a letter. Ties go to the
language first by name. Each row gives one row, repeated ones too; an empty table gives an
empty one. Only the id, the text and, in learning, the language are read, so other columns
may have any names.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text

UND = "und"
#: Labelled documents a language is learned from, about.
PER_LANGUAGE = 3000
#: Trigram hashes.
BUCKETS = 1 << 16
#: Added to every count.
SMOOTH = 0.05
#: EM stops for a document once no proportion moves by as much; it moves less with every round.
STILL = 1e-3
#: Words that a task remembers the likelihoods of.
MEMO = 150_000
#: Rows worked on at once, and the bytes of their texts times the languages; a longer text is worked on alone.
PART_ROWS, PART_BYTES = 256, 8 << 20
#: Characters of a text whose words are listed at once, and new words whose likelihoods are worked out at once.
STRETCH, NEW_WORDS = 1 << 20, 1 << 16
WORD, BREAK = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters (Unicode category L); other numerals than digits end a run as digits do."""
    return _runs(text.lower())


def _runs(lowered: str) -> list[str]:
    found = WORD.findall(lowered)
    if "".join(found).isalpha():
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def word_lists(text: str) -> Iterator[list[str]]:
    """words_of(text) in stretches of about STRETCH characters, cut where no word runs on."""
    text, at = text.lower(), 0
    while at < len(text):
        found = BREAK.search(text, min(at + STRETCH, len(text)))
        end = found.start() if found else len(text)
        yield _runs(text[at:end])
        at = end


def tally(text: str) -> Counter[str]:
    """How often each word stands in a text."""
    out: Counter[str] = Counter()
    for words in word_lists(text):
        out.update(words)
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, one after the other, and where each word's begin."""
    chars = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 2)
    mixed = chars[:-2] * np.uint32(0x9E3779B1) ^ chars[1:-1] * np.uint32(0x85EBCA77) ^ chars[2:] * np.uint32(0xC2B2AE3D)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    inside = np.ones(len(mixed), bool)
    for back in (1, 2):  # trigrams that run from one word into the next
        inside[(ends - back)[ends - back < len(mixed)]] = False
    return ((mixed >> np.uint32(16)) & np.uint32(BUCKETS - 1)).astype(np.int64)[inside], np.concatenate([[0], np.cumsum(sizes)[:-1]])


class Model:
    """Log likelihoods of trigrams by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTH
        self.log = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.copy() if languages else np.empty((BUCKETS, 0))


def learn(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model of the languages of the labelled rows that may be learned from."""
    labelled = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000)).alias("h")
    )
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Model([], np.empty((0, BUCKETS)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1_000_000, int(per_language * 1_000_000 / n) + 1))])
    sample = labelled.where(F.col("h") < share[F.col("lang")]).select("lang", F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for words in word_lists(as_text(text.as_py())):
                    if words:
                        found += np.bincount(grams(words)[0], minlength=BUCKETS)
        for lang, found in total.items():
            at = np.nonzero(found)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(found[at], pa.int64())], ["lang", "gram", "n"]
            )

    # At most BUCKETS rows a language reach the driver.
    rows = sample.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.zeros((len(languages), BUCKETS))
    place = {k: i for i, k in enumerate(languages)}
    counts[rows["lang"].map(place).to_numpy(int), rows["gram"].to_numpy(int)] = rows["n"].to_numpy(float)
    return Model(languages, counts)


class Likelihoods:
    """Rows of relative word likelihoods, remembered by word."""

    def __init__(self, model: Model):
        self.log, self.rows, self.table = model.log, {}, np.empty((1024, len(model.languages)), np.float32)
        self.size = 0

    def fresh(self) -> None:
        """Between batches, forget all words once there are too many."""
        if self.size >= MEMO:
            self.rows.clear()
            self.size = 0

    def learn(self, words: Iterable[str]) -> None:
        """Rows for the words that have none yet, NEW_WORDS at once."""
        rows = self.rows
        new = [w for w in set(words) if w not in rows]
        for first in range(0, len(new), NEW_WORDS):
            fresh = new[first : first + NEW_WORDS]
            codes, starts = grams(fresh)
            log = np.add.reduceat(self.log[codes], starts, axis=0)
            made = np.maximum(np.exp(log - log.max(axis=1, keepdims=True)), 1e-30)
            while self.size + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[self.size : self.size + len(fresh)] = made
            rows.update(zip(fresh, range(self.size, self.size + len(fresh))))
            self.size += len(fresh)


def em(like: np.ndarray, sizes: np.ndarray, share: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after convergence from share, and the log likelihoods; documents that have converged leave the rounds.

    like has a row a different word, sizes of them a document; times says how often each word stands there.
    """
    total = np.add.reduceat(times, _starts(sizes), dtype=np.float64)
    out, live, rows, weight, size, now = share.copy(), np.arange(len(share)), like, times[:, None], sizes, share
    while len(live):
        part = rows * np.repeat(now, size, axis=0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-35)
        part *= weight
        new = np.add.reduceat(part, _starts(size), axis=0) / total[:, None]
        on = np.abs(new - now).max(axis=1) >= STILL
        out[live] = new
        if not on.all():
            kept = np.repeat(on, size)
            rows, weight, live, size, total, new = rows[kept], weight[kept], live[on], size[on], total[on], new[on]
        now = new
    fit = np.log(np.maximum((like * np.repeat(out, sizes, axis=0)).sum(axis=1), 1e-35, dtype=np.float64)) * times
    return out, np.add.reduceat(fit, _starts(sizes))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def mixtures(like: np.ndarray, starts: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Proportions of the chosen language set of each document.

    like has a row a word, starts the first word of each document, times how often each word stands there (once).
    """
    sizes = np.diff(np.append(starts, len(like)))
    times = np.ones(len(like), np.float32) if times is None else times
    n_words, n_langs = np.add.reduceat(times, starts, dtype=np.float64), like.shape[1]
    full, _ = em(like, sizes, np.full((len(starts), n_langs), 1 / n_langs, np.float32), times)
    order = np.argsort(-full, axis=1, kind="stable")
    best, best_value = np.zeros_like(full), np.full(len(starts), -np.inf)
    live, rows = np.arange(len(starts)), like
    for size in range(1, n_langs + 1):
        mask = np.zeros((len(live), n_langs), np.float32)
        np.put_along_axis(mask, order[live, :size], 1, axis=1)
        share = full[live] * mask + mask * np.float32(1e-6)
        share, fit = em(rows, sizes, (share / share.sum(axis=1, keepdims=True)).astype(np.float32), times)
        value = fit - (size - 1) * np.log(np.maximum(n_words[live], 2)) / 2
        better = value > best_value[live]
        best[live[better]], best_value[live[better]] = share[better], value[better]
        if not better.any():
            break
        kept = np.repeat(better, sizes)
        rows, times, live, sizes = rows[kept], times[kept], live[better], sizes[better]
    return best


def parts(batch: pa.RecordBatch, place: int, languages: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most PART_ROWS rows, whose texts (column place) have at most PART_BYTES over the languages, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, before = 0, 0
    while first < batch.num_rows:
        full = int(np.searchsorted(ends, before + PART_BYTES // max(1, languages), "right"))
        last = min(first + PART_ROWS, max(first + 1, full), batch.num_rows)
        yield batch.slice(first, last - first)
        first, before = last, int(ends[last - 1])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages, proportions) of every row; the chosen set by falling proportion."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Likelihoods(model)
        for batch in batches:
            for some in parts(batch, 1, len(model.languages)):
                words.fresh()
                yield _batch(some, id_col, model, words)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, languages array<string>, proportions array<double>")


def _batch(rows: pa.RecordBatch, id_col: str, model: Model, words: Likelihoods) -> pa.RecordBatch:
    n = rows.num_rows
    pred, score, sets, shares = [UND] * n, [0.0] * n, [[]] * n, [[]] * n
    split = [tally(as_text(text.as_py())) for text in rows.column(1)] if model.languages else []
    who = [i for i, found in enumerate(split) if found]
    words.learn(itertools.chain.from_iterable(split))
    if who:
        at = [np.fromiter(map(words.rows.__getitem__, split[i]), np.int64, len(split[i])) for i in who]
        starts = np.cumsum([0] + [len(a) for a in at[:-1]])
        times = np.concatenate([np.fromiter(split[i].values(), np.float32, len(split[i])) for i in who])
        found = mixtures(words.table[np.concatenate(at)], starts, times)
        for i, share in zip(who, found.astype(float)):
            order = [int(k) for k in np.argsort(-share, kind="stable") if share[k] > 0]
            pred[i], score[i] = model.languages[order[0]], min(1.0, float(share[order[0]]))
            sets[i], shares[i] = [model.languages[k] for k in order], [float(share[k]) for k in order]
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0),
            pa.array(pred, pa.string()),
            pa.array(score, pa.float64()),
            pa.array(sets, pa.list_(pa.string())),
            pa.array(shares, pa.list_(pa.float64())),
        ],
        [id_col, "lang_pred", "score", "languages", "proportions"],
    )


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of docs, unchanged, whose text gets a language with at least min_score; without a learned language, those with a letter."""
    if not model.languages:
        letters = F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")
        return docs.where(letters)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        words = Likelihoods(model)
        for batch in batches:
            for some in parts(batch, place, len(model.languages)):
                words.fresh()
                texts = some.column(place).cast(pa.binary())
                made = _batch(pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], ["id", "text"]), "id", model, words)
                keep = [p != UND and s >= min_score for p, s in zip(made.column(1).to_pylist(), made.column(2).to_pylist())]
                yield some.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
