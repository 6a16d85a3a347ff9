"""Toxicity scores from a weighted lexicon.

Texts are folded (width forms, look-alike letters of other scripts, digits and signs that stand for letters), then one
Aho-Corasick pass finds lexicon terms at the starts of words and exception phrases; a term inside an exception phrase
doesn't count. A term that ends in END is a whole word, any other a stem: of a learnt word that hardly ever goes on the whole
word is kept, of words that share a beginning alone that beginning. The weights that remain are summed, divided by the length
in words, and calibrated to a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, written

#: Look-alikes of Latin letters; small l counts as i, as the digit 1 stands for both.
LOOKS = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "i", "l": "i", "|": "i"}
#: Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
FOLD = str.maketrans(LOOKS | SIGNS)
#: Zero-width characters, which may split a word.
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
WORD = re.compile(r"[^\W\d_]+")
#: What ends a term that is a whole word.
END = "$"
#: Phrases in which a listed word is harmless; others, in any language, are learnt from harmless rows.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "pathetic fallacy", "pond scum", "sore loser")


@dataclass(frozen=True)
class Fit:
    """How a lexicon is learnt.

    rows: labelled documents that are used at most, those of least hash. shortest, longest: letters of a word's beginning
    that can be a term. least_docs, least_share: toxic rows, and share of them, that hold a term at least. covered: share of a
    term's rows from which on a longer one takes its place. least_g2: its log-likelihood ratio at least. harmless: harmless
    rows that hold a phrase of a term and its neighbour, and no toxic one does, for the phrase to be an exception. padding:
    words added to a text's length. The size of the model follows from least_share: a toxic row has so many beginnings, and
    each term takes that share of all rows.
    """

    rows: int = 12_000
    shortest: int = 4
    longest: int = 10
    least_docs: int = 3
    least_share: float = 0.015
    covered: float = 0.95
    least_g2: float = 15.0
    harmless: int = 3
    padding: int = 20


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    offset: float
    padding: int


def plain(text: str) -> str:
    """Lower case, without width forms and hidden characters."""
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return text.lower()


def fold(text: str) -> str:
    return plain(text).translate(FOLD)


def spoken(text: str) -> list[str]:
    """The folded text's words; where digits or signs stand at an end, the word without them too, as they may be no letters."""
    base = plain(text)
    folded = base.translate(FOLD)
    out = []
    for m in WORD.finditer(folded):
        a, b = m.span()
        out.append(m.group())
        if not (base[a].isalpha() and base[b - 1].isalpha()):
            while a < b and not base[a].isalpha():
                a += 1
            while a < b and not base[b - 1].isalpha():
                b -= 1
            if a < b:
                out.append(folded[a:b])
    return out


def prefixes(text: str, fit: Fit) -> set[str]:
    """The beginnings of the folded text's words, and whole words of up to `longest` letters, which END ends."""
    return {(w + END)[:n] for w in set(spoken(text)) for n in range(fit.shortest, min(len(w) + 1, fit.longest + (len(w) == fit.longest)) + 1) if n > fit.shortest or len(w) >= fit.shortest}


class Matcher:
    """One automaton for terms and exception phrases."""

    def __init__(self, model: Model):
        self.padding, self.slope, self.offset = model.padding, model.slope, model.offset
        self.auto = ahocorasick.Automaton()
        entries: dict[str, tuple[float, float, bool]] = {}  # weight as a stem, as a whole word, whether an exception
        for term, weight in model.terms.items():
            word = term.removesuffix(END)
            stem, whole, spared = entries.get(word, (0.0, 0.0, False))
            entries[word] = (stem, weight, spared) if term != word else (weight, whole, spared)
        for phrase in model.exceptions:
            stem, whole, _ = entries.get(phrase, (0.0, 0.0, False))
            entries[phrase] = (stem, whole, True)
        for word, entry in entries.items():
            if word:
                self.auto.add_word(word, (len(word), *entry))
        self.any = len(self.auto) > 0
        if self.any:
            self.auto.make_automaton()

    def found(self, text: str) -> tuple[str, dict[int, tuple[float, int]], list[tuple[int, int]]]:
        """The folded text; (weight, end) of the best term at each word's start; exceptions' spans."""
        base = plain(text)
        folded = base.translate(FOLD)
        if not self.any:
            return folded, {}, []
        best: dict[int, tuple[float, int]] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, stem, whole, exception) in self.auto.iter(folded):
            start = end - n + 1
            if start and base[start - 1].isalpha():
                continue
            ends = end + 1 == len(base) or not base[end + 1].isalpha() or not folded[end + 1].isalpha()
            weight = max(stem, whole if ends else 0.0)
            if weight > best.get(start, (0.0, 0))[0]:
                best[start] = (weight, end)
            if exception and ends:
                spared.append((start, end))
        return folded, best, spared

    def rate(self, text: str | None) -> float:
        """Summed weights, the highest of each word, by words of text."""
        if not text or not self.any:
            return 0.0
        _, best, spared = self.found(text)
        if not best:
            return 0.0
        for a, b in spared:
            for at in [s for s in best if a <= s <= b]:
                del best[at]
        return sum(w for w, _ in best.values()) / (len(text.split()) + self.padding)

    def phrases(self, text: str) -> set[str]:
        """Each term that is found, with the word before it and with the word after it."""
        folded, best, _ = self.found(text)
        out = set()
        for start, (_, end) in best.items():
            stop = end + 1
            while stop < len(folded) and folded[stop].isalpha():
                stop += 1
            after, before = re.match(r" [^\W\d_]+", folded[stop:]), re.search(r"(?<![^\W\d_])[^\W\d_]+ $", folded[max(0, start - 40) : start])
            if after:
                out.add(folded[start:stop] + after.group())
            if before:
                out.add(before.group() + folded[start:stop])
        return out

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.offset + self.slope * math.log1p(100 * self.rate(text))))))


_matchers: dict[int, tuple[Model, Matcher]] = {}


def _counted(of):
    """Rows of each kind that hold each string of of(text)."""

    def run(batches):
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (pos if toxic else neg).update(of(text or ""))
        terms = [*(pos.keys() | neg.keys())]
        for k in range(0, len(terms), 50_000):
            part = terms[k : k + 50_000]
            yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.string()), "a": pa.array([pos[t] for t in part], pa.int64()), "b": pa.array([neg[t] for t in part], pa.int64())})

    return run


def counted(sample: DataFrame, of) -> DataFrame:
    return sample.mapInArrow(_counted(of), "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _phrases(model: Model):
    """The phrases of each text; the automaton is built where it is used."""
    held: list[Matcher] = []

    def of(text: str) -> set[str]:
        if not held:
            held.append(Matcher(model))
        return held[0].phrases(text)

    return of


def learn(sample: DataFrame, fit: Fit = Fit(), text: str = "text", label: str = "toxic", exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A lexicon and its calibration from all rows of `sample`, which learn_from() keeps within fit.rows.

    Rows with a null label are ignored. Without a labelled row of each kind the lexicon is empty and every score 0.
    """
    exceptions = tuple(dict.fromkeys(fold(e) for e in exceptions))
    sample = sample.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), (F.col(label) > 0).alias("toxic"))
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a_all, b_all = size.get(True, 0), size.get(False, 0)
    if not a_all or not b_all:
        return Model({}, exceptions, 0.0, -50.0, fit.padding)
    share = a_all / (a_all + b_all)
    a, b = F.col("a"), F.col("b")
    g2 = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    weight = F.log((a + 0.5) / (a_all + 1.0)) - F.log((b + 0.5) / (b_all + 1.0))
    found = counted(sample, lambda t: prefixes(t, fit)).where((a >= max(fit.least_docs, fit.least_share * a_all)) & (weight > 1.0))
    found = found.select("term", "a", weight.alias("weight"), g2.alias("g2")).where(F.col("g2") >= fit.least_g2).orderBy("term").collect()
    rows = {r.term: r.a for r in found}
    general = {t[:-1] for t, n in rows.items() if n >= fit.covered * rows.get(t[:-1], 2**62)}
    terms = {r.term: r.weight for r in found if r.term not in general}
    if terms:
        harmless = counted(sample, _phrases(Model(terms, (), 0.0, 0.0, fit.padding))).where((a == 0) & (b >= fit.harmless)).orderBy("term").collect()
        exceptions = tuple(dict.fromkeys([*exceptions, *(r.term for r in harmless)]))
    model = Model(terms, exceptions, 0.0, 0.0, fit.padding)
    rates = sample.select(toxicity(F.col("text"), model, raw=True).alias("x"), F.col("toxic").cast("int").alias("y")).collect()
    slope, offset = calibrated(np.array([math.log1p(100 * r.x) for r in rates]), np.array([r.y for r in rates], float))
    return Model(model.terms, exceptions, slope, offset, fit.padding)


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a small ridge on the slope."""
    w = np.array([1.0, math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))])
    X = np.c_[x, np.ones(len(x))]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        grad = X.T @ (p - y) + ridge * w * [1, 0]
        hess = (X * (p * (1 - p) + 1e-9)[:, None]).T @ X + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def toxicity(text: Column, model: Model, raw: bool = False) -> Column:
    """Scores 0 to 1 (double) of whole texts; raw: the weights by length. Null and empty texts score like harmless ones."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if id(model) not in _matchers:
            _matchers.clear()
            _matchers[id(model)] = (model, Matcher(model))
        m = _matchers[id(model)][1]
        f = m.rate if raw else m.score
        return pa.array([f(t.as_py()) for t in texts], pa.float64())

    return score(text.cast("string"))


def held_out(key: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def learn_from(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit: Fit = Fit(), **more) -> Model:
    """The lexicon of the labelled documents that aren't held out, fit.rows of them at most.

    The sample is drawn from the labels alone (those of least hash), so that only its texts are read into a table of
    their own. Labels that are null or of no document are ignored; a document with labels of both kinds is toxic, and of
    documents that share an id the least text counts.
    """
    known = labels.where(~held_out(F.col(key)) & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("toxic"))
    drawn = known.orderBy(F.xxhash64(F.col("_k").cast("string")), "_k").limit(fit.rows)
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(F.broadcast(drawn), "_k").groupBy("_k").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = written(texts.select("text", "toxic"), "labelled")
    model = learn(sample, fit, **more)
    discard(sample)
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs with `score` and `predicted` (1 from the threshold on), which replace columns of these names."""
    return docs.withColumn("score", toxicity(F.col(text), model)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
