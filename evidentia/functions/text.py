"""Text expressions: normal forms, tokens, sentences, skeletons, set overlap."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidentia.features.cues import STOPWORDS


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode composition, for which Spark has no function."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """NFC; texts that are plain ASCII, which it leaves alone, go to Python as null."""
    return F.coalesce(nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s]+", " "))


def normal_text(text: Column, unicode: bool = True) -> Column:
    """NFC, lower case, runs of white space as one blank."""
    return collapse(F.lower(composed(text) if unicode else text))


def tokens(text: Column, least: int = 2, stopwords: Sequence[str] = STOPWORDS, pattern: str = r"[a-z0-9+#.]+") -> Column:
    """Lower-case tokens of a technical text, in order."""
    stop = F.array(*map(F.lit, stopwords)) if stopwords else F.array().cast("array<string>")
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)), lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t))


def token_set(text: Column, **options) -> Column:
    return F.array_distinct(tokens(text, **options))


def words(text: Column) -> Column:
    """Letters only, lower case: RE2 and Java agree on them."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def without_hedges(text: Column, markers: Sequence[str]) -> Column:
    """The text without the sentences that have a hedge marker."""
    marks = F.array(*map(F.lit, markers))
    return F.array_join(F.filter(sentences(text), lambda s: ~F.exists(marks, lambda m: F.contains(F.lower(s), m))), " ")


def overlap_ratio(left: Column, right: Column) -> Column:
    """SET-1: the part of the left set that the right has; an empty left set gives 0."""
    return F.when(F.size(left) > 0, F.size(F.array_intersect(left, right)) / F.size(left)).otherwise(F.lit(0.0))


def union_sets(sets: Column) -> Column:
    """SET-3: of an array of sets."""
    return F.array_distinct(F.flatten(sets))


def skeleton(text: Column, id_pattern: str = r"[A-Z]{2,}_[0-9]+") -> Column:
    """The text with ids and numbers masked, so that filled-in templates are equal."""
    return F.regexp_replace(F.regexp_replace(text, id_pattern, "<id>"), r"[0-9]+(?:\.[0-9]+)?", "<n>")


def before_comma(text: Column) -> Column:
    return F.trim(F.substring_index(text, ",", 1))


def label(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("_"), F.lit(" "))


def compose(sections: Sequence[tuple[str, Column]], labelled: bool = True, separator: str = "\n") -> Column:
    """A document of its non-empty sections, each with its label in front."""
    parts = [F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, F.concat(F.lit(f"{name}: ") if labelled else F.lit(""), F.trim(c))) for name, c in sections]
    return F.concat_ws(separator, *parts)
