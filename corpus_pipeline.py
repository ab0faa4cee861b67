"""From raw documents to token ids: language, exact and near duplicates, mixing, encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over the columns of
``documents``; only the last returns the encoding instead.  A stage works on all
that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm.common import crc_mod, stored, table
from evidentia.llm.exact_dedup import keep_first_copies
from evidentia.llm.language import language_profiles, with_language
from evidentia.llm.mixing import take_mix
from evidentia.llm.near_dedup import keep_one_of_each
from evidentia.llm.pieces import encode_digests
from evidentia.llm.queries import piece_model


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language can be told go: null and empty texts and those without a letter.

    ``lang`` becomes what was told; null ids and repeated rows are rows of their own.  With nothing to learn from, as in
    an empty table, no row stays.
    """
    return with_language(docs, language_profiles(docs, crc_mod("doc_id", 4) != 2))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest, then the smallest id stays.

    Null, empty and blank texts are one group, of which one row stays.  A null id loses against any other; of
    rows that repeat id and text one stays.  Texts of any length are compared whole; an empty table stays empty.
    """
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that hangs together by a Jaccard similarity of 0.8 over five-word shingles, the smallest id stays.

    Texts without words are linked with nothing and all stay.  Rows with a null id stay only where no other row of their
    group has one; rows that repeat an id stay or go together.  Whole texts of any length; an empty table stays empty.
    """
    return keep_one_of_each(docs, width=5, similarity=(4, 5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times.

    A null source is a source of its own, the last.  Texts without words (null, empty, blank) weigh nothing and go.
    Rows that share an id, or have none, are taken as often as the most often taken of them.  An empty table stays empty.
    """
    return take_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row its number of ids, and digests of the ids and of what they decode to.

    A null text counts as empty, which is the end id alone.  Null ids and repeated rows are rows of their own; a text
    of any length is encoded whole; an empty table gives an empty result.
    """
    return encode_digests(docs, piece_model())


STAGES = [("language", identify), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("encoding", encode)]

#: SQL can't express the n-gram profiles, the similarity join or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one leaves is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}").df
    return STAGES[-1][1](spark, docs, sf_dir)
