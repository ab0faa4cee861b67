"""Connected components of a table of links, by alternating large and small stars.

Each round hangs every node's neighbours on its smallest one; after a few
rounds (their number grows with the logarithm of the longest chain) every node
hangs on the smallest of its component.  Each round's links are written to the
shared folder, so the plan stays short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _hang(links: DataFrame, larger_only: bool) -> DataFrame:
    """Of (u, v) both ways, or with v < u only: each v and u itself on the smallest of u's neighbours and u."""
    if larger_only:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _clean(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % F.lit(1 << 32)), F.lit(0))).first()
    return r[0], r[1]


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node that has a link to another; component is its smallest node.

    Null ends and links of a node with itself are left out; repeated links count once.
    """
    now = stored(_clean(links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")), "links")
    mark = _mark(now.df)
    while mark[0]:
        # The result of a large star has all links to smaller nodes, which is what a small star starts from.
        after = stored(_clean(_hang(_clean(_hang(now.df, True)), False)), "links")
        now.drop()
        now, before, mark = after, mark, _mark(after.df)
        if mark == before:
            break
    hung = now.df.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return hung.union(now.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
