"""Quality rules as a short-circuit cascade, in built-in functions only.

Each rule is a condition under which a text is rejected.  On a bounded sample
the rules are timed and their rejections counted; the cascade then asks the
rule with the most rejections per second first, and a text that one rule
rejects is asked no further (CASE evaluates its branches lazily).  The order
changes the cost only: a text is kept when no rule rejects it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored, whole, without_white

#: Words in a window of the repetition count.
WINDOW = 8
#: The rules' costs and selectivities are measured on about so many rows.
SAMPLE_ROWS = 2_000
#: What every text must have, whatever the rules.
LEAST_WORDS, MOST_REPEATED = 20, 0.30


@dataclass(frozen=True)
class Rule:
    """``rejects`` is over the columns ``text`` and those of ``measures``."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    text, words = F.col("text"), F.col("n_words")
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return [
        Rule("symbols", F.col("n_symbols") > 0.3 * words),
        Rule("word_length", ~F.col("word_chars").between(2 * words, 15 * words)),
        Rule("repeated_lines", F.col("n_dup_lines") > 0.3 * F.size(F.split(text, "\n"))),
        Rule("shouting", F.regexp_count(text, F.lit(r"\p{Lu}")) > 0.5 * letters),
        Rule("exclamations", F.regexp_count(text, F.lit("!")) > 0.3 * words),
        Rule("letters", letters < 0.5 * F.col("word_chars")),
        Rule("variety", F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))) < 0.1 * words),
    ]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null text counts as empty, which has 0 of everything.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    split = base.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    counted = split.select(
        "id", "text", "words", "lines",
        F.size("words").cast("long").alias("n_words"),
        # Windows by a hash first: only where two hashes are equal, the windows themselves are compared.
        F.when(F.size("words") > WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("hashes"),
    )
    keyed = counted.select(
        "id", "text", "n_words", "lines",
        F.when(
            F.size(F.array_distinct("hashes")) < F.size("hashes"),
            F.sort_array(F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice("words", i, WINDOW), " ").alias("key"), i.alias("at")))),
        ).alias("windows"),
    )
    twice = F.filter("windows", lambda x, k: F.coalesce(F.get("windows", k - 1)["key"] == x["key"], F.lit(False)) | F.coalesce(F.get("windows", k + 1)["key"] == x["key"], F.lit(False)))
    found = keyed.select("id", "text", "n_words", "lines", F.sort_array(F.transform(twice, lambda x: x["at"])).alias("at"))
    # Each window covers its words up to where the next repeated one begins.
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return found.select(
        "id", "text", "n_words",
        F.char_length(without_white(F.col("text"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def order_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second of evaluation, measured on a sample; ties in the given order."""
    n = docs.count()
    unit = F.pmod(F.xxhash64(F.lit("quality"), F.col(id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    held = stored(measures(docs.where(unit < sample_rows / max(n, 1)), id_col, text_col), "quality-sample")
    sample = held.df.coalesce(1)

    def run(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - began, hits

    run(F.lit(True))  # opens the file
    idle, _ = run(F.col("n_words") < 0)
    rate = {}
    for rule in rules:
        run(rule.rejects)  # compiles
        took, hits = run(rule.rejects)
        rate[rule.name] = hits / max(took - idle, 1e-3)
    held.drop()
    return sorted(rules, key=lambda r: -rate[r.name])


def cascade(rules: list[Rule]) -> Column:
    """Whether any rule rejects; later rules are asked only where earlier ones do not."""
    said = F.lit(False)
    for rule in reversed(rules):
        said = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(True)).otherwise(said)
    return said


def quality(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the five counts, base_failed, kept.

    Empty and null texts fail.  Null ids and repeated rows are rows of their
    own; other columns are ignored, whatever their names.  No shuffle.
    """
    ordered = order_rules(docs, default_rules() if rules is None else rules, id_col, text_col)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > round(100 * MOST_REPEATED) * F.col("n_words"))
    said = F.when(F.col("base_failed"), F.lit(False)).otherwise(~cascade(ordered))
    return measures(docs, id_col, text_col).withColumn("base_failed", failed).select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", said.alias("kept"))
