"""Total order, top-k, display ties, bands, and the validator of a ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.functions.text import skeleton


def top_k(df: DataFrame, k: int, score: str, id_col: str, floored: str | None = None, exact: bool = False) -> DataFrame:
    """T-1, W-1: the first k by (floored, score falling, id), with ``rank``.

    Each task keeps k rows and sends those alone (TakeOrderedAndProject); ranks
    are given to k rows, not to the input.  ``exact`` is an error with fewer rows.
    """
    order = ([F.col(floored).asc()] if floored else []) + [F.col(score).desc(), F.col(id_col).asc()]
    top = df.orderBy(*order).limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    if exact:
        n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
        ranked = ranked.withColumn("__n", n).where(F.when(F.col("__n") >= k, F.lit(True)).otherwise(F.raise_error(F.lit(f"fewer than {k} rows to rank")).cast("boolean"))).drop("__n")
    return ranked


def display_ranks(ranked: DataFrame, score: str, id_col: str, digits: int = 6) -> DataFrame:
    """SNK-2: ranks anew by the score as shown, equal ones by id; for a ranking, not for a whole input."""
    shown = ranked.withColumn("shown", F.round(score, digits))
    return shown.withColumn("rank", F.row_number().over(Window.orderBy(F.col("shown").desc(), F.col(id_col))))


def rank_band(rank: Column, n: Column | int, top: float = 0.10, mid: float = 0.50) -> Column:
    """W-7."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(rank <= n * top, "top").when(rank <= n * mid, "mid").otherwise("tail")


def validate_ranking(
    ranking: DataFrame,
    rows: int,
    id_col: str = "id",
    rank: str = "rank",
    score: str = "score",
    text: str | None = None,
    id_pattern: str | None = None,
    template_share: float = 0.70,
    known_ids: DataFrame | None = None,
) -> DataFrame:
    """G-V1 to G-V10: (code, n) for every fault found, sorted by code; empty for a sound ranking.

    The ranking is the short final table, so one window over it is bounded by
    ``rows`` and what is wrong with it.
    """
    spark = ranking.sparkSession
    r = ranking.select(F.col(id_col).alias("id"), F.col(rank).cast("long").alias("rank"), F.col(score).cast("double").alias("score"), *([F.col(text).alias("text")] if text else []))
    w = Window.orderBy("rank", "id")
    seq = r.withColumns({"prev_score": F.lag("score").over(w), "prev_id": F.lag("id").over(w)})
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    found = [
        r.agg(F.count("*").alias("n")).where(F.col("n") != rows).select(F.lit("WRONG_ROW_COUNT").alias("code"), F.abs(F.col("n") - rows).cast("long").alias("n")),
        r.where(~F.col("rank").between(1, rows)).groupBy().agg(F.count("*").alias("n")).select(F.lit("RANK_OUT_OF_RANGE"), "n"),
        r.groupBy("rank").count().where("count > 1").groupBy().agg(F.count("*").alias("n")).select(F.lit("DUPLICATE_RANK"), "n"),
        spark.range(1, rows + 1).withColumnRenamed("id", "rank").join(r.select("rank"), "rank", "left_anti").groupBy().agg(F.count("*").alias("n")).select(F.lit("MISSING_RANK"), "n"),
        r.groupBy("id").count().where("count > 1").groupBy().agg(F.count("*").alias("n")).select(F.lit("DUPLICATE_ID"), "n"),
        r.where(~finite).groupBy().agg(F.count("*").alias("n")).select(F.lit("SCORE_NOT_FINITE"), "n"),
        seq.where("score > prev_score").groupBy().agg(F.count("*").alias("n")).select(F.lit("SCORE_INCREASING"), "n"),
        seq.where("score = prev_score and id < prev_id").groupBy().agg(F.count("*").alias("n")).select(F.lit("TIE_BREAK_VIOLATION"), "n"),
    ]
    if id_pattern:
        found.append(r.where(~F.coalesce(F.col("id").cast("string").rlike(id_pattern), F.lit(False))).groupBy().agg(F.count("*").alias("n")).select(F.lit("BAD_ID_FORMAT"), "n"))
    if known_ids is not None:
        found.append(r.join(known_ids.select(F.col(known_ids.columns[0]).alias("id")), "id", "left_anti").groupBy().agg(F.count("*").alias("n")).select(F.lit("UNKNOWN_ID"), "n"))
    if text:
        t = r.where(F.length(F.trim("text")) > 0)
        found += [
            r.where(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0).groupBy().agg(F.count("*").alias("n")).select(F.lit("EMPTY_REASONING"), "n"),
            t.groupBy("text").count().where("count > 1").groupBy().agg(F.count("*").alias("n")).select(F.lit("IDENTICAL_REASONING"), "n"),
            t.groupBy(skeleton(F.col("text")).alias("s")).count().groupBy().agg(F.max("count").alias("m"), F.sum("count").alias("all")).where(F.col("m") >= template_share * F.col("all")).where("all > 1").select(F.lit("TEMPLATED_REASONING"), F.col("m").alias("n")),
        ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.where("n > 0").orderBy("code")


def band_faults(ranking: DataFrame, n: int, band: str, strengths: str, rank: str = "rank") -> DataFrame:
    """G-V6: rows whose stated band is not that of their rank, or which stand high without a strength."""
    expected = rank_band(F.col(rank), n)
    code = F.when(F.col(band) != expected, "BAND_MISMATCH").when((expected != "tail") & (F.col(strengths) < 1), "NO_STRENGTH")
    return ranking.withColumn("code", code).where("code is not null")


def hallucinations(ranking: DataFrame, path: str = "evidence", derived: Sequence[str] = ()) -> DataFrame:
    """G-V5: rows whose evidence does not resolve in their own record: code HALLUCINATION.

    A path is ``list[i].field`` of an array of the record, or one of the
    ``derived`` names; the field must be there and not blank.
    """
    p = F.coalesce(F.col(path), F.lit(""))
    root, index, name = (F.regexp_extract(p, r"^([a-z_]+)\[([0-9]+)\]\.([a-z_]+)$", k) for k in (1, 2, 3))
    told = p.isin(*derived) if derived else F.lit(False)
    for field in ranking.schema.fields:
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            item = F.get(F.col(field.name), F.expr("try_cast(__index as int)"))
            for inner in field.dataType.elementType.fields:
                if not isinstance(inner.dataType, (T.ArrayType, T.StructType, T.MapType)):
                    value = item[inner.name].cast("string")
                    told = told | ((F.col("__root") == field.name) & (F.col("__name") == inner.name) & (F.length(F.trim(F.coalesce(value, F.lit("")))) > 0))
    out = ranking.withColumns({"__root": root, "__index": index, "__name": name}).where(~F.coalesce(told, F.lit(False)))
    return out.withColumn("code", F.lit("HALLUCINATION")).drop("__root", "__index", "__name")


def ranked_with(ranking: DataFrame, id_col: str, *tables: DataFrame) -> DataFrame:
    """J-14: the ranked rows with what other tables (raw, scored, reasons) say of the same ids; the short side is checked and sent to all.

    A ranked id that a table lacks is an error of the build and drops out of the inner join; ``hallucinations`` and ``validate_ranking`` find it.
    """
    out = ranking
    for t in tables:
        short = out.select(id_col)
        # The ranking is bounded by its rows, so each large table is only filtered by it.
        out = out.join(t.join(F.broadcast(short), id_col, "left_semi"), id_col)
    return out
