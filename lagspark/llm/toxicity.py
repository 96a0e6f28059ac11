"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat (a violent verb), actor, target, negation, reported
speech, other. Five transducers read a clause, each a table of states and arcs (Machine):

* target, from the right: turns an insult or threat with an addressed person within reach
  behind it into an aimed one; its left-to-right half marks those with a person before them;
* negation marks the words within reach of a negation, report those behind a verb of saying;
* threat tells a violent verb behind an actor from one without; with a target behind it the
  order actor, verb, target is complete;
* insult tells a clause's first insult from the next ones.

compose() multiplies the left-to-right machines into one table over the tuples of their
states. An arc of that table emits the marks of all machines; the output of a matched word is
its weight times the weights of the arcs it takes. A clause's score is the sum over its
matches, and only clauses with a match score at all.

Insults are learned: words and word beginnings (stems) whose log-odds of standing in a
toxic text are high and well supported, with the log-odds as weight. Small fixed lists give
the other symbols; their insults and threats keep a fixed weight as a prior, and count more
where the labels say so. The arcs' weights are learned too: how much likelier or less likely
texts with a match over the arc are toxic than those with a match beside it, drawn to the
fixed weight by PRIOR texts. What weakens (negation, report) is never learned above its fixed
weight and what strengthens never below 1, so chance meetings of words cannot turn a negation
round. A logistic curve over the clause scores is then fitted: their
sum, the best one, and their sum by the words of the text and SPAN further ones, on
log scales, so one weak match does not decide a text however short. Arcs and
curve are fitted on labelled rows that the lexicon has not seen. At most about PER_CLASS
labelled rows of each class are learned from, never held-out ones.

Texts are used whole, however long. Null and empty texts have no clause and get the score of
no match. With no labels, or labels of one class only, the fixed lists alone decide. Each row
gives one row; rows that repeat an id are scored one by one; labels that repeat an id count
once, toxic if any of them is. An empty table gives an empty one. Only the id, the text and
the label are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, cut

#: Labelled rows of a class that are learned from, about.
PER_CLASS = 6000
#: Lengths of the word beginnings that may become stems.
STEMS = (4, 5, 6, 7, 8, 9)
#: A lexicon entry stands in at least this many distinct toxic texts (copies of one text share
#: all its words), and has at least these log-odds.
MIN_TEXTS, MIN_ODDS = 4, 2.5
MEMO = 200_000
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, ACTOR, END = range(8)
#: What the target machine makes of an insult and a threat with a person behind it.
AIMED_INSULT, AIMED_THREAT = 8, 9
#: Symbols that a machine may read inside a clause.
ALPHABET = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, ACTOR, AIMED_INSULT, AIMED_THREAT)
INSULTS, THREATS = (INSULT, AIMED_INSULT), (THREAT, AIMED_THREAT)

# Fixed word lists of the grammar, in English, French, German and Spanish.
WORDS = {
    INSULT: "idiot idiots moron morons imbecile scum loser losers trash stupid pathetic worthless disgusting"
    " crétin abruti connard ordure dummkopf trottel abschaum imbécil basura estúpido",
    THREAT: "kill hurt destroy beat burn murder tuer frapper détruire töten schlagen vernichten matar golpear destruir",
    TARGET: "you your yours they them tu toi vous ton votre du dich dein ihr euch tú ti usted ustedes vosotros",
    NEGATION: "not no never ne pas jamais nicht kein keine nie niemals nunca jamás",
    REPORT: "said says say told tells wrote quoted claims reported dit disait écrit raconte sagte sagt schrieb behauptet dijo dice escribió",
    ACTOR: "i we je nous ich wir yo nosotros",
}
SYMBOL = {word: symbol for symbol, words in WORDS.items() for word in words.split()}
#: Least weight of a fixed insult or threat, whatever the labels have learned.
FIXED_WEIGHT = 2.0
#: Weights of the arcs before anything is learned: negated, reported, an aimed insult, an aimed
#: threat, one that an actor utters at a target, an insult behind another in its clause.
ARCS = {"negated": 0.2, "reported": 0.2, "aimed": 1.3, "threatened": 2.0, "ordered": 1.5, "again": 1.0}
#: Texts that an arc's fixed weight counts for beside the labelled ones, and the bounds of what is learned.
PRIOR, LEAST, MOST = 20.0, 0.1, 4.0
#: Words that a text's rate of matches is taken over beside its own.
SPAN = 200
#: Words that negation and an address reach.
REACH = 4


class Machine:
    """A transducer: step[state, symbol] is (next state, mark); the start state is 0."""

    def __init__(self, states: range, step):
        self.step = {(s, x): step(s, x) for s in states for x in ALPHABET}

    def run(self, symbols: list[int]) -> list:
        state, out = 0, []
        for x in symbols:
            state, mark = self.step[state, x]
            out.append(mark)
        return out


def _countdown(starts: int) -> Machine:
    """Marks the symbols at most REACH places behind the one that starts it."""
    return Machine(range(REACH + 1), lambda s, x: (REACH if x == starts else max(0, s - 1), s > 0))


NEGATIONS, BEFORE = _countdown(NEGATION), _countdown(TARGET)
REPORTS = Machine(range(2), lambda s, x: (s or int(x == REPORT), s > 0))
#: An actor stands anywhere before the verb in its clause.
THREATENS = Machine(range(2), lambda s, x: (s or int(x == ACTOR), ("none", "alone", "acted")[(x in THREATS) * (1 + s)]))
REPEATS = Machine(range(2), lambda s, x: (s or int(x in INSULTS), x in INSULTS and s > 0))
#: Left to right; their marks are negated, reported, a person before, threat, again.
FORWARD = (NEGATIONS, REPORTS, BEFORE, THREATENS, REPEATS)


def aim(symbols: list[int]) -> list[int]:
    """The target machine from the right: matches with a person within reach behind them become aimed ones."""
    behind = BEFORE.run(symbols[::-1])[::-1]
    turned = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}
    return [turned.get(x, x) if near else x for x, near in zip(symbols, behind)]


def compose(machines: tuple[Machine, ...]) -> tuple[list[list[int]], list[list[tuple]]]:
    """The product of machines: next state and marks by state and symbol, state 0 first; only states that can be reached."""
    start = (0,) * len(machines)
    states, rows = {start: 0}, []
    todo = [start]
    for state in todo:
        arcs = []
        for x in ALPHABET:
            steps = [m.step[s, x] for m, s in zip(machines, state)]
            to = tuple(s for s, _ in steps)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            arcs.append((states[to], tuple(mark for _, mark in steps)))
        rows.append(arcs)
    return [[to for to, _ in arcs] for arcs in rows], [[marks for _, marks in arcs] for arcs in rows]


NEXT, MARKS = compose(FORWARD)
PLACE = {x: i for i, x in enumerate(ALPHABET)}


def arcs_of(symbol: int, marks: tuple) -> tuple[str, ...]:
    """Names of the weighted arcs that a matched word takes."""
    negated, reported, before, threat, again = marks
    behind = symbol in (AIMED_INSULT, AIMED_THREAT)
    names = [("negated", negated), ("reported", reported), ("again", again)]
    if symbol in THREATS:
        names += [("threatened", before or behind), ("ordered", behind and threat == "acted")]
    else:
        names += [("aimed", before or behind)]
    return tuple(name for name, taken in names if taken)


class Grammar:
    """The composed transducers over a lexicon of word and stem weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], arcs: dict[str, float] | None = None):
        self.words, self.stems, self.arcs = words, stems, ARCS | (arcs or {})
        self.memo: dict[str, tuple[int, float]] = {}
        taken = [[arcs_of(x, marks) if x in INSULTS + THREATS else () for x, marks in zip(ALPHABET, row)] for row in MARKS]
        #: By composed state and symbol: the arcs of a match and the product of their weights.
        self.taken = taken
        self.weight = [[math.prod(self.arcs[name] for name in names) for names in row] for row in taken]

    def symbol(self, word: str) -> tuple[int, float]:
        """A word's symbol and weight."""
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if word in ".!?;:\n":
                found = END, 0.0
            else:
                symbol = SYMBOL.get(word, OTHER)
                weight = max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS if len(word) >= n)])
                if symbol in (INSULT, THREAT):
                    found = symbol, max(weight, FIXED_WEIGHT)
                elif weight and symbol == OTHER:
                    found = INSULT, weight
                else:
                    found = symbol, 0.0
            self.memo[word] = found
        return found

    def matches(self, symbols: list[tuple[int, float]]) -> Iterator[tuple[int, int, float]]:
        """(composed state, place of the symbol, weight) of each match of a clause."""
        state = 0
        for symbol, (_, weight) in zip(aim([s for s, _ in symbols]), symbols):
            at = PLACE[symbol]
            if weight:
                yield state, at, weight
            state = NEXT[state][at]

    def clause(self, symbols: list[tuple[int, float]]) -> float:
        """Output of the composed machines for one clause."""
        return sum(weight * self.weight[state][at] for state, at, weight in self.matches(symbols))

    def clauses(self, text: str) -> tuple[list[list[tuple[int, float]]], int]:
        """The clauses with a match, and how many symbols the text has."""
        symbols = list(map(self.symbol, TOKEN.findall(text.lower())))
        found, done = [], -1
        for i in [i for i, (_, w) in enumerate(symbols) if w]:
            if i <= done:
                continue
            start = end = i
            while start and symbols[start - 1][0] != END:
                start -= 1
            while end < len(symbols) and symbols[end][0] != END:
                end += 1
            found.append(symbols[start:end])
            done = end
        return found, len(symbols)

    def features(self, text: str) -> tuple[float, float, float, int]:
        """log(1 + sum of the clause scores), the best clause, log(1 + that sum a hundred words), matched clauses."""
        found, size = self.clauses(text)
        scores = [self.clause(c) for c in found]
        total = sum(scores)
        return math.log1p(total), max(scores, default=0.0), math.log1p(100 * total / (size + SPAN)), len(found)

    def taken_by(self, text: str) -> tuple[set[str], set[str]]:
        """The arcs that some match of the text takes, and those that some match which could take them does not."""
        took: set[str] = set()
        beside: set[str] = set()
        for clause in self.clauses(text)[0]:
            for state, at, _ in self.matches(clause):
                own = set(self.taken[state][at])
                took |= own
                beside |= {"negated", "reported", *(("threatened", "ordered") if ALPHABET[at] in THREATS else ("aimed", "again"))} - own
        return took, beside


def arc_weights(rows: list[tuple[int, str, int, int]]) -> dict[str, float]:
    """Arc weights from (label, arc, texts that took it, texts with a match beside it) rows."""
    out = {}
    for name, fixed in ARCS.items():
        took = {y: sum(t for label, arc, t, _ in rows if arc == name and label == y) for y in (0, 1)}
        beside = {y: sum(b for label, arc, _, b in rows if arc == name and label == y) for y in (0, 1)}
        share = (beside[1] + 0.5) / (sum(beside.values()) + 1)
        learned = (took[1] + PRIOR * fixed * share) / ((sum(took.values()) + PRIOR) * share)
        least, most = (LEAST, fixed) if fixed < 1 else (1.0, MOST)
        out[name] = min(most, max(least, learned))
    return out


class Scorer:
    """A grammar and the logistic curve over its features."""

    def __init__(self, grammar: Grammar, curve: np.ndarray, scale: np.ndarray):
        self.grammar, self.curve, self.scale = grammar, curve, scale

    def score(self, text: str) -> tuple[float, int]:
        *x, matched = self.grammar.features(text)
        z = self.curve[0] + float((np.array(x) / self.scale) @ self.curve[1:])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), matched


def learn(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
) -> Scorer:
    """A scorer from the labelled texts that may be learned from."""
    marked = labels.where(may_learn & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("y")
    )
    sizes = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}  # one row a class
    fixed = Scorer(Grammar({}, {}), np.array([-3.0, 2.0, 0.5, 0.0]), np.ones(3))
    if len(sizes) < 2:
        return fixed
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1_000_000, int(per_class * 1_000_000 / n) + 1))])
    h = F.pmod(F.xxhash64(F.col("id")), F.lit(1_000_000))
    picked = marked.where(h < share[F.col("y")])
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # At most about per_class rows a class, so their ids may be broadcast; the texts are read once.
    sample = cut(texts.join(F.broadcast(picked), "id")).withColumn("half", F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(3)) < 2)
    # The lexicon: texts of each class that hold a word or stem.
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)))
    stems = [_stems(n) for n in STEMS]
    half = sample.where("half").withColumn("digest", F.xxhash64("text"))
    n_half = {r["y"]: r["count"] for r in half.groupBy("y").count().collect()}
    if len(n_half) < 2:
        return fixed
    # Copies of a text count once in a class: their words are no more support than one text's.
    once = half.dropDuplicates(["y", "digest"])
    n_half = {r["y"]: r["count"] for r in once.groupBy("y").count().collect()}
    held = once.select("y", words.alias("w")).select("y", F.explode(F.concat("w", *stems)).alias("f"))
    counts = held.groupBy("f").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (n_half[1] + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n_half[0] + 1.0))
    entries = counts.where(F.col("bad") >= MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS).select("f", "odds").toPandas()
    words_w = {f: w for f, w in zip(entries["f"], entries["odds"]) if f[0] != "<"}
    stems_w = {f[1:]: w for f, w in zip(entries["f"], entries["odds"]) if f[0] == "<"}
    # Arcs and curve: from the other texts of the sample, a row an arc and then a few numbers a text.
    others = sample.where("NOT half").select("y", F.col("text").cast("binary").alias("text"))
    arcs = arc_weights([tuple(r) for r in _arcs(others, Grammar(words_w, stems_w)).collect()])
    grammar = Grammar(words_w, stems_w, arcs)
    rows = _features(others, grammar).toPandas()
    if rows["y"].nunique() < 2:
        return Scorer(grammar, fixed.curve, fixed.scale)
    x, y = rows[["total", "best", "rate"]].to_numpy(float), rows["y"].to_numpy(float)
    scale = np.maximum(x.std(axis=0), 1e-9)
    curve = logistic(x / scale, y)
    # The sample holds the classes in other shares than the labels do.
    curve[0] += math.log(sizes[1] / sizes[0]) - math.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return Scorer(grammar, curve, scale)


def _stems(n: int) -> Column:
    """The beginnings of n letters of the words in column w, marked."""
    long = F.filter("w", lambda x: F.length(x) >= n)
    return F.array_distinct(F.transform(long, lambda x: F.concat(F.lit("<"), F.substring(x, 1, n))))


def _arcs(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """(y, arc, took, beside): how many texts of a label have a match over the arc, and how many one beside it."""
    shared = rows.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                took, beside = shared.value.taken_by(as_text(text.as_py()))
                made += [(y, name, int(name in took), int(name in beside and name not in took)) for name in sorted(took | beside)]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], ["y", "arc", "took", "beside"])

    rows = rows.mapInArrow(run, "y int, arc string, took long, beside long")
    return rows.groupBy("y", "arc").agg(F.sum("took").alias("took"), F.sum("beside").alias("beside"))


def _features(rows: DataFrame, grammar: Grammar) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([shared.value.features(as_text(t.as_py()))[:3] for t in batch.column(1)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[:, k]) for k in range(3))], ["y", "total", "best", "rate"])

    return rows.mapInArrow(run, "y int, total double, best double, rate double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients, the constant first, by Newton steps with a ridge penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    b, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted, n_clauses) of every row; n_clauses counts the matched clauses."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for batch in batches:
            made = [scorer.score(as_text(t.as_py())) for t in batch.column(1)]
            scores = np.array([s for s, _ in made], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array([n for _, n in made], pa.int64())],
                [id_col, "score", "predicted", "n_clauses"],
            )

    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int, n_clauses long")
