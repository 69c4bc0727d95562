"""Toxicity by weighted finite-state transducers over clauses.

The lexical transducer turns a clause's words into symbols: an insult or a threat, a target, a negation, a report of
speech, or another word. Small transducers then mark what stands near an insult or a threat, each reading what the one
before it gave out; they are composed into two machines, one that reads the clause backwards and marks what follows, and
one that reads it forwards, marks what precedes and tells each match's kind. A match weighs its word's learned weight
times the fitted gain of its kind. A text's score is a logistic function of its summed clause weights, so words matter
only as their clause does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm._store import column, small_batches, written

#: Labelled rows that the lexicon and the weights are fitted on, about (a hash picks them); bounds the fit at any size.
FIT_ROWS = 8_000
#: Most lexicon entries, the heaviest first; bounds what is broadcast.
LEXICON = 4_000
PREFIXES = (4, 5, 6, 7, 8)
#: Toxic texts of the sample that a feature must be in to be learned, and the least log odds of a lexicon entry.
LEAST_TEXTS, MIN_WEIGHT = 3, 1.5
#: Chosen features that a toxic text of the sample is explained by before it stops asking for more.
COVER = 2

#: Whom a clause may be aimed at; the second list also stands before its verb where it is the object.
TARGET = frozenset("you yours yourself u he she they tu vous du ihr sie usted ustedes vosotros".split())
#: What is theirs: near an insult as good as they are, but a threat's verb is not aimed at it.
OWNED = frozenset("your ur votre vos dein deine tus".split())
OBJECT = frozenset("him her them te toi t lui dich dir euch ihn ihm ti os lo".split())
NEGATION = frozenset("not never no neither nor cannot pas jamais ne n ni nicht nie niemals kein keine keinen nunca jamás".split())
REPORT = frozenset("said says say saying told wrote writes called calls quoted quote quotes claimed reported dit disait écrit affirme sagte sagt schrieb behauptet dijo dice escribió afirmó".split())


def _inflected(stems: str, endings: str, *others: str) -> list[str]:
    return [stem + ending.strip("-") for stem in stems.split() for ending in endings.split()] + [w for o in others for w in o.split()]


#: What is threatened: the forms in which a threat is made (infinitives, first person, future), and the verbs' others, which
#: mostly tell what someone does or did.
VOWED = frozenset(
    _inflected("kill murder hurt destroy punch attack slaughter crush smash shoot stab beat strangle", "-")
    + _inflected("tu frapp massacr étrangl poignard égorg extermin", "er e ons erai eras era erons erez eront")
    + _inflected("töt ermord erschieß erschlag erwürg vernicht verprügel zusammenschlag", "en e", "umbringen umbringe schlagen")
    + _inflected("mat golpe asesin apuñal estrangul destroz", "ar o amos aré arás ará aremos arán")
)
TOLD = frozenset(
    _inflected("kill murder hurt destroy punch attack slaughter", "s ed ing", "crushes crushed crushing smashes smashed smashing shoots shot shooting stabs stabbed stabbing beats beaten beating strangles strangled strangling")
    + _inflected("tu frapp massacr étrangl poignard égorg extermin", "es ent ez é ée és")
    + _inflected("töt ermord erschieß erschlag erwürg vernicht verprügel zusammenschlag", "est st t et te ten", "getötet umbringst umbringt erschossen erschossest erschlägt schlägt")
    + _inflected("mat golpe asesin apuñal estrangul destroz", "as a an aron é ó ado")
)
#: Weight of a form before any label is seen, and how many texts that is worth; log odds that make a full weight.
VOW, TALE, FORM_TRUST, FULL_ODDS = 1.0, 0.2, 4.0, 3.0
#: Words within which a target or a negation is near; a report is so within its whole clause. A verb's object comes sooner.
REACH, OBJECT_REACH = 3, 2
#: Words whose class a task remembers, and features that it counts before it sends them on; bound a task's memory.
REMEMBERED, LONGEST, HELD_FEATURES = 100_000, 64, 200_000

_CLAUSE = re.compile(r"[.!?;\n]+")
#: Words; an apostrophe parts them, but for the English negation.
_WORD = re.compile(r"[^\W_]+n['’]t\b|[^\W_]+")

#: Plain symbols; an insult and a threat have a symbol for each set of marks.
OTHER, AIMED, AIMED_OBJECT, DENIES, REPORTS, OWNS = range(6)
MARKS = 256
INSULT, THREATENS = 6, 6 + MARKS
SYMBOLS = 6 + 2 * MARKS
BEFORE_TARGET, BEFORE_OBJECT, BEFORE_NEGATION, BEFORE_REPORT, AFTER_TARGET, AFTER_OBJECT, AFTER_NEGATION, AFTER_REPORT = (1 << i for i in range(8))
#: Kinds of match: for an insult, whether a target is near, a negation precedes, one follows, and speech is reported;
#: for a threat to someone the last three.
KINDS = 24


class Transducer:
    """A deterministic transducer: ``arcs[state][symbol]`` is the next state and the symbol that it gives out."""

    def __init__(self, arcs: list[list[tuple[int, int]]]):
        self.arcs = arcs

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one gives out. Its states are the pairs that can be reached."""
        number, pairs, arcs = {(0, 0): 0}, [(0, 0)], []
        for mine, others in pairs:
            row = []
            for after, middle in self.arcs[mine]:
                then, out = other.arcs[others][middle]
                if (after, then) not in number:
                    number[after, then] = len(pairs)
                    pairs.append((after, then))
                row.append((number[after, then], out))
            arcs.append(row)
        return Transducer(arcs)

    def run(self, symbols: Iterable[int]) -> list[int]:
        state, out = 0, []
        for symbol in symbols:
            state, given = self.arcs[state][symbol]
            out.append(given)
        return out


def marker(mark: int, *triggers: int, reach: int | None = REACH) -> Transducer:
    """Marks insults and threats that come within ``reach`` words after a trigger. States count the words since one."""
    states = 1 + (reach or 1)

    def arc(state: int, symbol: int) -> tuple[int, int]:
        if symbol in triggers:
            return 1, symbol
        after = 0 if state == 0 else state if reach is None else (state + 1) % states
        if state and symbol >= INSULT:
            base = INSULT if symbol < THREATENS else THREATENS
            symbol = base + (symbol - base | mark)
        return after, symbol

    return Transducer([[arc(state, symbol) for symbol in range(SYMBOLS)] for state in range(states)])


def teller() -> Transducer:
    """Gives out the kind of each match, or KINDS: a threat is one if it has an object, before or after it."""

    def kind(symbol: int) -> int:
        if symbol < INSULT:
            return KINDS
        marks = (symbol - INSULT) % MARKS
        near = bool(marks & (BEFORE_TARGET | BEFORE_OBJECT | AFTER_TARGET))
        rest = bool(marks & BEFORE_NEGATION) + 2 * bool(marks & AFTER_NEGATION) + 4 * bool(marks & (BEFORE_REPORT | AFTER_REPORT))
        if symbol < THREATENS:
            return near + 2 * rest
        return 16 + rest if marks & (BEFORE_OBJECT | AFTER_OBJECT) else KINDS

    return Transducer([[(0, kind(symbol)) for symbol in range(SYMBOLS)]])


@cache
def machines() -> tuple[Transducer, Transducer]:
    """The composed machines: the one that reads a clause from its end, and the one that then reads it from its start."""
    back = marker(AFTER_TARGET, AIMED, AIMED_OBJECT, OWNS).then(marker(AFTER_OBJECT, AIMED, AIMED_OBJECT, reach=OBJECT_REACH)).then(marker(AFTER_NEGATION, DENIES)).then(marker(AFTER_REPORT, REPORTS, reach=None))
    on = marker(BEFORE_TARGET, AIMED, OWNS).then(marker(BEFORE_OBJECT, AIMED_OBJECT)).then(marker(BEFORE_NEGATION, DENIES)).then(marker(BEFORE_REPORT, REPORTS, reach=None))
    return back, on.then(teller())


#: What each kind of match is made of: near a target, a negation before, after, reported, and a threat.
DESIGN = np.array([[k & 1, k >> 1 & 1, k >> 2 & 1, k >> 3 & 1, 0] if k < 16 else [0, k & 1, k >> 1 & 1, k >> 2 & 1, 1] for k in range(KINDS)], float)
#: The logarithms of the gains before any text is seen, and how many units of information each prior is worth.
PRIOR, TRUST = np.log([1.25, 0.35, 0.6, 0.6, 5.0]), np.array([25.0, 25.0, 25.0, 25.0, 4.0])


def word_features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Grammar:
    """Lexicon of insult weights (words, and stems that end in ``*``), the log gains of what matches are made of, and the
    logistic line over a text's weight."""

    weights: dict[str, float] = field(default_factory=dict)
    slope: float = 1.0
    bias: float = -3.0
    gains: tuple[float, ...] = tuple(PRIOR.tolist())
    #: Learned weights of threats' forms; others have VOW or TALE.
    threats: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._classes: dict[str, tuple[int, float]] = {}
        self._gain = np.exp(DESIGN @ np.array(self.gains)).tolist()

    def fresh(self) -> Grammar:
        """The same grammar without remembered words, for a task of its own."""
        return Grammar(self.weights, self.slope, self.bias, self.gains, self.threats)

    def word_class(self, word: str) -> tuple[int, float]:
        """The lexical transducer: a word's symbol, and its weight for an insult or a threat."""
        if (found := self._classes.get(word)) is None:
            weight = max((self.weights.get(f, 0.0) for f in word_features(word)), default=0.0)
            lists = ((THREATENS, VOWED), (THREATENS, TOLD), (DENIES, NEGATION), (AIMED, TARGET), (OWNS, OWNED), (AIMED_OBJECT, OBJECT), (REPORTS, REPORT))
            symbol = INSULT if weight > 0 else DENIES if word.endswith(("n't", "n’t")) else next((s for s, words in lists if word in words), OTHER)
            if symbol == THREATENS:
                weight = self.threats.get(word, VOW if word in VOWED else TALE)
            found = symbol, weight if symbol >= INSULT else 0.0
            if len(word) <= LONGEST:
                if len(self._classes) >= REMEMBERED:
                    self._classes.clear()
                self._classes[word] = found
        return found

    def all_kinds(self, words: list[str]) -> list[tuple[int, float]]:
        """Kind and weight of each word of a clause, KINDS for what is no match; nothing for a clause without any."""
        classes = [self.word_class(w) for w in words]
        symbols = [symbol for symbol, _ in classes]
        if max(symbols, default=0) < INSULT:
            return []
        back, on = machines()
        told = on.run(reversed(back.run(reversed(symbols))))
        return [(kind, weight) for kind, (_, weight) in zip(told, classes, strict=True)]

    def kinds(self, words: list[str]) -> list[tuple[int, float]]:
        """Kind and weight of a clause's matches."""
        return [match for match in self.all_kinds(words) if match[0] < KINDS]

    def clauses(self, text: str | None) -> Iterator[tuple[int, int, list[tuple[int, float]]]]:
        """Begin and end (code points of the text) and matches of the clauses that have some."""
        if not text:
            return
        lowered = text.lower()
        if not any(self.word_class(w)[0] >= INSULT for w in set(_WORD.findall(lowered))):
            return
        if len(lowered) != len(text):  # a letter whose lower case is longer
            lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        begin = 0
        for stop in [*(m.span() for m in _CLAUSE.finditer(lowered)), (len(lowered), len(lowered))]:
            if found := self.kinds(_WORD.findall(lowered[begin : stop[0]])):
                yield begin, stop[0], found
            begin = stop[1]

    def threatening(self, text: str | None) -> set[str]:
        """The forms that threaten someone in a text."""
        out: set[str] = set()
        lowered = (text or "").lower()
        if not any(self.word_class(w)[0] == THREATENS for w in set(_WORD.findall(lowered))):
            return out
        for clause in _CLAUSE.split(lowered):
            words = _WORD.findall(clause)
            out.update(w for w, (kind, _) in zip(words, self.all_kinds(words), strict=False) if 16 <= kind < KINDS)
        return out

    def matched(self, text: str | None) -> list[tuple[int, int, float]]:
        """Clauses with weight: begin, end (code points of the text) and weight."""
        return [(begin, end, sum(w * self._gain[kind] for kind, w in found)) for begin, end, found in self.clauses(text)]

    def profile(self, text: str | None) -> list[float]:
        """The weights of a text's matches by kind, in hundredths' steps."""
        out = [0.0] * KINDS
        for _, _, found in self.clauses(text):
            for kind, weight in found:
                out[kind] += weight
        return [round(x, 2) for x in out]

    def weight(self, text: str | None) -> float:
        return math.log1p(sum(w for _, _, w in self.matched(text)))

    def score(self, weight: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * weight + self.bias))))


def fitted_line(profiles: np.ndarray, labels: np.ndarray, counts: np.ndarray, steps: int = 60) -> tuple[float, float, np.ndarray]:
    """Slope, bias and log gains that explain the labels best, by Fisher scoring with priors on the gains."""
    theta = np.concatenate([[1.0, -3.0], PRIOR])
    centre, trust = np.concatenate([[0.0, 0.0], PRIOR]), np.concatenate([[0.01, 0.01], TRUST])

    def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        gains = np.exp(DESIGN @ theta[2:])
        total = profiles @ gains
        weight = np.log1p(total)
        z = np.clip(theta[0] * weight + theta[1], -30, 30)
        p = 1 / (1 + np.exp(-z))
        loss = (counts * (np.logaddexp(0, z) - labels * z)).sum() + (trust * (theta - centre) ** 2).sum() / 2
        slopes = theta[0] * (profiles * gains) @ DESIGN / (1 + total)[:, None]
        return loss, p, np.column_stack([weight, np.ones(len(weight)), slopes]), weight

    loss, p, jacobian, _ = at(theta)
    for _ in range(steps):
        grad = jacobian.T @ (counts * (p - labels)) + trust * (theta - centre)
        hess = jacobian.T @ (jacobian * (counts * p * (1 - p))[:, None]) + np.diag(trust)
        step, size = np.clip(np.linalg.solve(hess, grad), -2, 2), 1.0
        while size > 1e-4 and (found := at(theta - size * step))[0] > loss:
            size /= 2
        if size <= 1e-4:
            break
        theta, (loss, p, jacobian, _) = theta - size * step, found
        if np.abs(size * step).max() < 1e-7:
            break
    return float(theta[0]), float(theta[1]), theta[2:]


def remainder_is(doc_id: Column, divisor: int, value: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor == value, F.lit(False))


def _feature_counts(rows: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """In how many of the texts each word and stem is (of the wanted ones); counted in the tasks, then summed."""
    held = rows.sparkSession.sparkContext.broadcast(wanted)

    def counted(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found = {f for w in set(_WORD.findall((text.as_py() or "").lower())) for f in word_features(w)}
                seen.update(found if held.value is None else found & held.value)
                if len(seen) > HELD_FEATURES:
                    yield counted(seen)
                    seen = Counter()
        yield counted(seen)

    return rows.select("text").mapInArrow(count, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))


def _covering(rows: DataFrame, weights: dict[str, float], least: int, most: int) -> list[str]:
    """Features by greedy cover: each next one is in the most toxic texts that fewer than COVER chosen ones explain.

    Equal texts count once. Near copies share their other words, too; covering keeps the few that explain more.
    """
    held = rows.sparkSession.sparkContext.broadcast(frozenset(weights))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({f for w in set(_WORD.findall((t.as_py() or "").lower())) for f in word_features(w) if f in held.value}) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["features"])

    texts = sorted(tuple(r[0]) for r in rows.select("text").distinct().mapInArrow(features, "features array<string>").collect())
    where: dict[str, set[int]] = {}
    for i, found in enumerate(texts):
        for f in found:
            where.setdefault(f, set()).add(i)
    count = {f: len(at) for f, at in where.items()}
    need, chosen = dict.fromkeys(range(len(texts)), COVER), []
    while where and len(chosen) < most:
        best = max(where, key=lambda f: (len(where[f]) * weights[f], f))
        if len(where[best]) < least:
            break
        chosen.append(best)
        for i in where.pop(best):
            need[i] -= 1
            if not need[i]:
                for f in [f for f, at in where.items() if i in at]:
                    where[f].discard(i)
        stem = best.removesuffix("*")
        for f in list(where):  # what stands for the same words, and a chosen stem's longer forms
            other = f.removesuffix("*")
            if best.endswith("*") and f.startswith(stem) or (stem.startswith(other) or other.startswith(stem)) and count[f] <= 1.3 * count[best]:
                del where[f]
    return chosen


def form_weight(form: str, toxic: float, clean: float) -> float:
    """The weight of a threat's form that threatens someone in these shares of a kind's texts and so many texts.

    Its log odds over FULL_ODDS, between none and all, against the prior of its kind, which is worth FORM_TRUST texts.
    """
    prior = VOW if form in VOWED else TALE
    n = toxic + clean
    return prior if not n else (FORM_TRUST * prior + n * min(1.0, max(0.0, math.log((toxic + 0.5) / (clean + 0.5)) / FULL_ODDS))) / (FORM_TRUST + n)


def _form_weights(rows: DataFrame, grammar: Grammar, sizes: dict[int, int]) -> dict[str, float]:
    """Weights of the forms that threaten someone in labelled texts, by their numbers in as many texts of either label."""
    held = rows.sparkSession.sparkContext.broadcast(grammar)

    def threats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value.fresh()
        for batch in batches:
            found = [(f, label) for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) for f in sorted(g.threatening(text.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], names=["form", "label"])

    counts: dict[str, list[float]] = {}
    for form, label, n in rows.select("text", "label").mapInArrow(threats, "form string, label int").groupBy("form", "label").count().collect():
        counts.setdefault(form, [0.0, 0.0])[label] = float(n)
    even = sizes[1] / sizes[0]  # clean texts are the more: theirs count as if they were not
    return {form: form_weight(form, toxic, clean * even) for form, (clean, toxic) in sorted(counts.items())}


def fit(labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, lexicon: int = LEXICON) -> Grammar:
    """Learn the lexicon and the logistic line from labelled rows; null labels are left out.

    About ``fit_rows`` rows are used, chosen by a hash of text and label, which bounds what the driver holds. The lexicon
    has words and stems of at least LEAST_TEXTS toxic texts whose log odds reach MIN_WEIGHT; each form of a threat's verb weighs
    what the labels of the texts say in which it has an object, against a prior; the gains of targets, negations, reports
    and threats are fitted together with the line. Without labels of both kinds nothing is learned:
    every text then scores as one without insults.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("text", "label"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    rows = written(rows, "toxicity-fit")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Grammar()
    # Toxic texts are the few: what is in LEAST_TEXTS of them or more is then counted in the others.
    bad = {r["feature"]: r["n"] for r in _feature_counts(rows.where("label = 1")).where(F.col("n") >= LEAST_TEXTS).collect()}
    good = {r["feature"]: r["n"] for r in _feature_counts(rows.where("label = 0"), frozenset(bad)).collect()}
    odds = {f: math.log((n + 0.5) / (sizes[1] + 1)) - math.log((good.get(f, 0) + 0.5) / (sizes[0] + 1)) for f, n in bad.items()}
    weights = {f: w for f, w in odds.items() if w >= MIN_WEIGHT}
    chosen = _covering(rows.where("label = 1"), weights, max(LEAST_TEXTS, sizes[1] // 500), lexicon)
    grammar = Grammar({f: weights[f] for f in chosen})
    grammar = Grammar(grammar.weights, threats=_form_weights(rows, grammar, sizes))
    held = labelled.sparkSession.sparkContext.broadcast(grammar)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value.fresh()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([g.profile(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))], names=["label", "profile"])

    points = rows.mapInArrow(weigh, "label int, profile array<double>").groupBy("profile", "label").count().collect()
    points.sort(key=lambda r: (r["label"], r["profile"]))
    grammar.slope, grammar.bias, gains = fitted_line(np.array([r["profile"] for r in points]), *(np.array([r[k] for r in points], float) for k in ("label", "count")))
    return Grammar(grammar.weights, grammar.slope, grammar.bias, tuple(gains.tolist()), grammar.threats)


def scored(docs: DataFrame, grammar: Grammar, *, text_col: str = "text") -> DataFrame:
    """The rows with ``score`` (0 to 1) and ``clauses`` (begin, end, weight of each matched clause) added.

    Null and empty texts have no clause and get the score of a text without insults. Columns of the same names are
    replaced. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(grammar)
    kept = [c for c in docs.columns if c not in ("score", "clauses")]
    docs = docs.select(*(column(c) for c in kept))
    at = kept.index(text_col)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = held.value.fresh()
        for batch in batches:
            found = [g.matched(t.as_py()) for t in batch.column(at)]
            values = [g.score(math.log1p(sum(w for _, _, w in f))) for f in found]
            clauses = pa.array([[{"begin": b, "end": e, "weight": w} for b, e, w in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64()), clauses], names=[*kept, "score", "clauses"])

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

    clause = StructType().add("begin", LongType()).add("end", LongType()).add("weight", DoubleType())
    return docs.mapInArrow(score, StructType([*docs.schema.fields]).add("score", DoubleType()).add("clauses", ArrayType(clause)))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Texts with a label whose ids may be learned from; ids that carry both labels teach nothing.

    About ``fit_rows`` ids are chosen by their hash before the texts are read, so what is broadcast is bounded and no
    text is shuffled.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~remainder_is(F.col("doc_id"), 3, 1))
    n = usable.count()
    if n > fit_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    chosen = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity, learned from the labelled ones whose ids may be; null and empty texts score as clean."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    grammar = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored(docs, grammar).select("doc_id", remainder_is(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("clauses").alias("n_clauses"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
