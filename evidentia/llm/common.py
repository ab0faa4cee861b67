"""What the operators share: reading, intermediate tables, white space, word tokens."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words everywhere here.
WHITE = " \t\n\x0b\x0c\r"
#: A word: a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def without_white(text: Column) -> Column:
    """The text after deleting every white-space character.

    ``replace`` works on bytes; ``translate`` and regular expressions cost several times more.
    """
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, of this application alone.

    It lies in spark.checkpoint.dir, which driver and executors share.  Only
    where that is unset (tests, a single machine) is it a temporary folder.
    It is removed when the driver's Python ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="evidentia-")
            spark.conf.set("spark.checkpoint.dir", base)
        _folders[app] = f"{base.rstrip('/')}/evidentia-{app}"
        atexit.register(_remove_at_end, spark, _folders[app])
    return _folders[app]


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):
        _delete(spark, folder)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Stored:
    """An intermediate table on shared storage: ``df`` reads it, ``drop`` removes it."""

    def __init__(self, spark: SparkSession, path: str, **partition_filter):
        self.spark, self.path = spark, path
        self.df = spark.read.parquet(path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def stored(df: DataFrame, label: str, partition_by: str | None = None) -> Stored:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: what follows reads files that outlive any executor.
    The shuffle files of the write are of no further use and are dropped with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEAN_SHUFFLES)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)
    return Stored(spark, path)
