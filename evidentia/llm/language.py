"""Language by rank-order n-gram profiles.

A profile is the list of a language's most frequent n-grams of letters, in
order of rank.  A document's own most frequent n-grams are compared with each
profile by out-of-place distance: the sum over its n-grams of how far their
ranks are apart, with a fixed penalty for those that the profile lacks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import whole

#: N-grams in a profile, and longest n-gram.
RANKS, LONGEST = 300, 3
#: Profiles are learned from about so many documents of each language at most.
SAMPLE_PER_LANGUAGE = 2_000

_LETTERS = re.compile(r"[^\W\d_]+")


def _grams(text: str) -> np.ndarray:
    """Every n-gram of the words of a text, each word between two blanks; three code points of 21 bits make a number."""
    words = _LETTERS.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64)
    at = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    found = [at[at != 32]]
    for n in range(2, LONGEST + 1):
        code = at[: len(at) - n + 1].copy()
        for k in range(1, n):
            code |= at[k : len(at) - n + 1 + k] << np.uint64(21 * k)
        # No n-gram spans two words.
        inner = np.ones(len(code), bool)
        for k in range(1, n - 1):
            inner &= at[k : len(at) - n + 1 + k] != 32
        if n == 2:
            inner = (at[:-1] != 32) | (at[1:] != 32)
        found.append(code[inner])
    return np.concatenate(found)


def _ranked(codes: np.ndarray) -> np.ndarray:
    """The most frequent codes by falling count, then rising code."""
    unique, counts = np.unique(codes, return_counts=True)
    return unique[np.argsort(-counts, kind="stable")[:RANKS]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, dict[int, int]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            of = totals.setdefault(lang, {})
            for code, n in zip(*(x.tolist() for x in np.unique(_grams(text), return_counts=True)), strict=True):
                of[code] = of.get(code, 0) + n
    for lang, of in totals.items():
        yield pa.record_batch([pa.array([lang] * len(of), pa.string()), pa.array(of.keys(), pa.int64()), pa.array(of.values(), pa.int64())], names=["lang", "code", "n"])


def language_profiles(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_PER_LANGUAGE) -> dict[str, list[int]]:
    """Of each language that rows with ``learn`` have, its n-grams by rank.

    Learned from a sample of about ``sample`` rows a language, chosen by a hash of the id.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample / n))])
    unit = F.pmod(F.xxhash64(F.lit("profile"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.where(unit < share[F.col("lang")]).select("lang", whole(F.col("text")).alias("text"))
    counted = chosen.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= RANKS)
    profiles: dict[str, list[int]] = {lang: [] for lang in sorted(sizes)}
    for r in top.orderBy("lang", "rank").collect():
        profiles[r.lang].append(r.code)
    return {lang: codes for lang, codes in profiles.items() if codes}


class Profiles:
    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.codes = np.unique(np.array([c for x in profiles.values() for c in x], np.uint64))
        self.rank = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.codes, np.array(profiles[lang], np.uint64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language, ties by name, and by which part of the next one's distance it is nearer."""
        own = _ranked(_grams(text))
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        rank = self.rank[:, at]
        distance = np.where(rank < 0, RANKS, np.abs(rank - np.arange(len(own)))).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        best = int(distance[order[0]])
        other = int(distance[order[1]]) if len(order) > 1 else RANKS * len(own)
        return self.langs[order[0]], (other - best) / other if other else 0.0


def identify_language(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score.

    ``und`` with score 0 for a text that is null or has no letter, and for
    every text where nothing was learned.  Null ids and repeated rows are rows
    of their own; other columns are ignored.  No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles)
        for batch in batches:
            said = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def with_language(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", lang_col: str = "lang", least_score: float = 0.0) -> DataFrame:
    """The input rows whose language can be told, with all their columns and ``lang_col`` set to what was told.

    A null text and one without a letter go.  ``least_score`` also drops texts
    whose two nearest languages are about as near.
    """
    @F.pandas_udf("string")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Profiles(profiles)  # once a task
        for texts in batches:
            said = [model.predict(t) for t in texts]
            yield pd.Series([lang if lang != "und" and score >= least_score else None for lang, score in said], dtype=object)

    # Not to be asked twice, once for the condition and once for the column.
    return docs.withColumn(lang_col, told.asNondeterministic()(whole(F.col(text_col)))).where(F.col(lang_col).isNotNull())
