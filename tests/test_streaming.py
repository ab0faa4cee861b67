from conftest import SMALL
from evidentia.session import load
from evidentia.streaming import events as E
from pyspark.sql import functions as F


def test_stream_and_table_agree(spark, tmp_path):
    batch = load(spark, SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = E.read_events(spark, SMALL)
    got = E.run_once(E.tumbling(stream, "1 day", "1 hour", "event_type"), spark, "days", str(tmp_path / "c"))
    want = E.tumbling(batch, "1 day", "1 hour", "event_type")
    assert sorted(got.collect()) == sorted(want.collect())


def test_each_once(spark, tmp_path):
    stream = E.read_events(spark, SMALL)
    got = E.run_once(E.once_each(stream.union(stream)), spark, "once", str(tmp_path / "c"), "append")
    assert got.count() == load(spark, SMALL, "events").count()
