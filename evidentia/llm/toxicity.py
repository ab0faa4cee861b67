"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

A text is folded first: compatibility forms (full-width, mathematical letters)
to plain ones, lower case, look-alike letters of other scripts to Latin ones,
letters that stand alone in a row to one word, digits and signs inside words to
the letters they stand for, everything else that is no letter to one blank.
The lexicon has whole words and beginnings of words, each with a weight learned
from labels.  An exception phrase is a pair of neighbouring words, one of them a
hit, that clean rows have as often as toxic ones; a hit inside one doesn't
count.  The sum of weights, as it is and divided by the root of the number of
words, goes through a logistic curve that is fitted on rows that the lexicon at
hand was not learned from.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, whole

#: Labelled rows that the lexicon and the curve are learned from, at most about so many of each label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
#: Shortest and longest beginning of a word that can be an entry.
STEM = (4, 8)
#: Rows that must have an entry or an exception phrase, the least log odds of an entry, and the least
#: root of its likelihood ratio; the same evidence counts alike in samples of any size.
SUPPORT, LEAST_ODDS, LEAST_Z = 3, 3.0, 4.0
#: The curve where there is nothing to fit one to: every text is clean.
NO_CURVE = (-6.0, 0.0, 0.0)

# Cyrillic, Greek and full-width characters and the Latin ones or digits that they look like.
LOOKALIKES = str.maketrans(
    "авсԁеһіјкмпорԛѕтухѵԝ" + "αβεικμνορτυχ" + "０１３４５７",
    "abcdehijkmnopqstyxvw" + "abeikmvoptux" + "013457",
    "\u00ad\u200b\u200c\u200d\u2060\ufeff",
)
# What digits and signs stand for inside a word.
SUBSTITUTES = str.maketrans("013457@$", "oieastas")

# A word with a digit or sign, from its beginning, so that no part of a word is read twice.
_MIXED = re.compile(r"(?<![\w@$])(?:[^\W\d_]+[0-9@$]|[0-9@$]+[^\W\d_])[\w@$]*")
_SPACED = re.compile(r"(?<![^\W_])[^\W_]([ .*_-])[^\W_](?:\1[^\W_])+(?![^\W_]|[.*_-][^\W_])")
_LETTERS = re.compile(r"[^\W\d_]+")


def _unmask(m: re.Match) -> str:
    """A word with digits or signs in it, which at its end are punctuation."""
    return m[0].rstrip("@$").translate(SUBSTITUTES)


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    low = text.lower()
    if not low.isascii():
        low = low.translate(LOOKALIKES)
    low = _SPACED.sub(lambda m: m[0][::2], low)
    return _LETTERS.findall(_MIXED.sub(_unmask, low))


def _terms(words: Sequence[str]) -> set[str]:
    """A document's candidates: ``word `` for whole words, ``stem`` without a blank for beginnings."""
    out = set()
    for w in set(words):
        out.add(f"{w} ")
        out.update(w[:k] for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1))
    return out


class Lexicon:
    """Entries with weights in an automaton."""

    def __init__(self, weights: dict[str, float], exceptions: Sequence[str] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term, w in weights.items():
            self.automaton.add_word(f" {term}", (w, len(term) + 1, 0))
        for phrase in exceptions:
            # Where its second word begins, counted from where the phrase does.
            self.automaton.add_word(f" {phrase} ", (None, len(phrase) + 2, phrase.index(" ") + 1))
        self.empty = len(self.automaton) == 0
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, words: Sequence[str]) -> dict[int, float]:
        """Of folded words, the heaviest entry that begins at each offset of their text, exceptions left out."""
        at: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (w, n, second) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - n + 1
            if w is None:
                spared.append((start, start + second))
            elif w > at.get(start, 0.0):
                at[start] = w
        for start, second in spared:
            at.pop(start, None)
            at.pop(second, None)
        return at

    def features(self, text: str) -> tuple[float, float]:
        """The log of the sum of weights and the sum over the root of the number of words.

        Of entries that begin at the same word the heaviest counts.
        """
        words = fold(text)
        if not words or self.empty:
            return 0.0, 0.0
        total = math.fsum(self.hits(words).values())
        return math.log1p(total), total / math.sqrt(len(words))

    def phrases(self, text: str) -> set[str]:
        """The pairs of neighbouring words of a text of which one is a hit."""
        words = fold(text)
        out: set[str] = set()
        if not words or self.empty:
            return out
        at, offset = self.hits(words), 0
        for k, w in enumerate(words):
            if offset in at:
                out.update(" ".join(words[j : j + 2]) for j in (k - 1, k) if 0 <= j < len(words) - 1)
            offset += len(w) + 1
        return out


def _root_ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """Root of the likelihood ratio of a of n_a and b of n_b rows having something, against both having it alike."""
    part = lambda x, n, p: x * math.log(x / (n * p)) if x else 0.0
    p = (a + b) / (n_a + n_b)
    if p in (0.0, 1.0):
        return 0.0
    both = part(a, n_a, p) + part(n_a - a, n_a, 1 - p) + part(b, n_b, p) + part(n_b - b, n_b, 1 - p)
    return math.sqrt(max(0.0, 2 * both))


def choose_entries(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights (log odds) of the terms that tell toxic rows, from document counts by label."""
    found = {}
    for term, a in toxic.items():
        b = clean.get(term, 0)
        if a < SUPPORT:
            continue
        w = math.log((a + 0.5) / (n_toxic - a + 0.5)) - math.log((b + 0.5) / (n_clean - b + 0.5))
        # An entry must be rare in clean rows, for its own sake and not only for toxic ones being many.
        if w > LEAST_ODDS and _root_ratio(a, b, n_toxic, n_clean) >= LEAST_Z:
            found[term] = w
    # A beginning goes when one longer entry accounts for nearly all of it.
    longest: dict[str, int] = {}
    for term in found:
        for k in range(STEM[0], len(term.strip()) + 1):
            if (stem := term[:k]) != term and stem in found:
                longest[stem] = max(longest.get(stem, 0), toxic[term])
    return {t: w for t, w in sorted(found.items()) if longest.get(t, 0) < 0.9 * toxic[t]}


def choose_exceptions(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> list[str]:
    """The phrases with a hit that SUPPORT clean rows have and that are as common there as in toxic rows."""
    return sorted(p for p, b in clean.items() if b >= SUPPORT and b * n_toxic >= toxic.get(p, 0) * n_clean)


def _fit_curve(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic regression with a slight ridge, by Newton's method; NO_CURVE where not both classes are there."""
    if not 0 < y.sum() < len(y):
        return list(NO_CURVE)
    x = np.c_[np.ones(len(x)), x]
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[0.05] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def learn_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Lexicon and curve from labelled rows that have ``learn`` (a condition on the id).

    Learned from a sample bounded by SAMPLE_TOXIC and SAMPLE_CLEAN, chosen by a
    hash of the id, with equal texts of one label once; rows of a null id or
    label, or labelled both ways, are left out.  Without labels of both kinds,
    or without documents that have them, every text scores the same, next to 0.
    """
    spark = docs.sparkSession
    marked = labels.where(learn & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("most")).where("y = most and y in (0, 1)")
    sizes = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {"weights": {}, "exceptions": [], "curve": list(NO_CURVE)}
    unit = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("y") == 1, SAMPLE_TOXIC / sizes[1]).otherwise(SAMPLE_CLEAN / sizes[0])
    ids = marked.where(unit < share).select("id", "y")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))
    # The ids are bounded by the sample's size.  Copies of a text are no further evidence, and are in one half.
    fold_of = F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(2)).cast("int")
    sample = stored(texts.join(F.broadcast(ids), "id").select("y", "text").distinct().select(fold_of.alias("fold"), "y", "text"), "toxicity-sample")
    counts = {r: n for *r_, n in (tuple(x) for x in sample.df.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()) for r in [tuple(r_)]}

    def count(only: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[tuple[int, str], int] = {}
            for batch in batches:
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    terms = _terms(fold(text))
                    for t in terms if only is None else terms & only:
                        totals[k, t] = totals.get((k, t), 0) + 1
            yield pa.record_batch([pa.array([k for k, _ in totals], pa.int32()), pa.array([t for _, t in totals], pa.string()), pa.array(totals.values(), pa.int64())], names=["fold", "term", "n"])

        return run

    def counted(y: int, only: frozenset | None, least: int) -> list:
        rows = sample.df.where(F.col("y") == y).select("fold", "text").mapInArrow(count(only), "fold int, term string, n long")
        by = rows.groupBy("term").agg(*(F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (0, 1)))
        return [(r.term, (r.n0, r.n1)) for r in by.where(F.col("n0") + F.col("n1") >= least).collect()]

    size = lambda y, k=None: sum(counts.get((j, y), 0) for j in (0, 1) if k in (None, j))
    toxic = dict(counted(1, None, SUPPORT))
    clean = dict(counted(0, frozenset(toxic), 1))
    lexicons = [choose_entries({t: n[k] for t, n in toxic.items()}, {t: n[k] for t, n in clean.items()}, size(1, k), size(0, k)) for k in (0, 1)]
    weights = choose_entries({t: sum(n) for t, n in toxic.items()}, {t: sum(n) for t, n in clean.items()}, size(1), size(0))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, totals = Lexicon(weights), {}
        for batch in batches:
            for k, y, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                for p in lexicon.phrases(text):
                    totals[k, y, p] = totals.get((k, y, p), 0) + 1
        yield pa.record_batch([pa.array([k for k, _, _ in totals], pa.int32()), pa.array([y for _, y, _ in totals], pa.int32()), pa.array([p for *_, p in totals], pa.string()), pa.array(totals.values(), pa.int64())], names=["fold", "y", "phrase", "n"])

    by_phrase: dict[tuple[int, int], dict[str, int]] = {(k, y): {} for k in (0, 1) for y in (0, 1)}
    said = sample.df.select("fold", "y", "text").mapInArrow(phrases, "fold int, y int, phrase string, n long").groupBy("fold", "y", "phrase").agg(F.sum("n").alias("n"))
    # Only phrases that enough clean rows have can be exceptions.
    enough = said.groupBy("phrase").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean")).where(F.col("clean") >= SUPPORT).select("phrase")
    for r in said.join(enough, "phrase", "left_semi").collect():
        by_phrase[r.fold, r.y][r.phrase] = r.n
    total = lambda y: {p: by_phrase[0, y].get(p, 0) + by_phrase[1, y].get(p, 0) for p in by_phrase[0, y].keys() | by_phrase[1, y].keys()}
    exceptions = choose_exceptions(total(1), total(0), size(1), size(0))
    spared = [choose_exceptions(by_phrase[k, 1], by_phrase[k, 0], size(1, k), size(0, k)) for k in (0, 1)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = [Lexicon(lexicons[1], spared[1]), Lexicon(lexicons[0], spared[0])]  # each row by the lexicon of the other half
        for batch in batches:
            f = [other[k].features(t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(2), pa.array([a for a, _ in f], pa.float64()), pa.array([b for _, b in f], pa.float64())], names=["y", "a", "b"])

    points = sorted(tuple(r) for r in sample.df.select("fold", "text", "y").mapInArrow(measure, "y int, a double, b double").collect())
    sample.drop()
    y = np.array([p[0] for p in points], float)
    x = np.array([p[1:] for p in points], float)
    return {"weights": weights, "exceptions": exceptions, "curve": _fit_curve(x.reshape(-1, 2), y)}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: id, score, predicted.

    A null or empty text scores as a text without hits.  Null ids and repeated
    rows are rows of their own; other columns are ignored; an empty table gives
    an empty result.  No shuffle; what goes to the executors are entries and
    phrases of the sample, whose size is bounded.
    """
    frozen = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = json.loads(frozen)
        lexicon, (c, a, b) = Lexicon(own["weights"], own["exceptions"]), own["curve"]
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                x, y = lexicon.features(text)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, c + a * x + b * y)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "id long, score double").select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
