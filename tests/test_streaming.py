"""Streams give what the batch operators give, across restarts."""

import time

import pytest
from pyspark.sql import functions as F

from streamloom import views
from streamloom.operators import integrity, storage
from streamloom.streaming import processors as p

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def arrivals(spark, tmp_path_factory):
    """Arrivals in two files, in order."""
    spark.conf.set(*p.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    folder = tmp_path_factory.mktemp("arrivals")
    a = views.arrival(views.record(spark, SF)).withColumn("ts", F.timestamp_micros(F.expr("ingestion_ts_ns div 1000"))).withColumn("payload", F.col("props").cast("binary"))
    for i in range(2):
        a.where(F.expr("arrival div 1000") == F.lit(i) if i == 0 else F.expr("arrival div 1000") >= i).coalesce(1).write.mode("append").parquet(str(folder))
    yield str(folder)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def streamed(spark, arrivals):
    return spark.readStream.schema(spark.read.parquet(arrivals).schema).option("maxFilesPerTrigger", 1).parquet(arrivals)


def run(df, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True)
    q = q.format("parquet").start(f"{tmp_path}/out") if mode == "append" else q.format("memory").queryName("snapshots").start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.read.parquet(f"{tmp_path}/out") if mode == "append" else df.sparkSession.table("snapshots")


def test_writer(spark, arrivals, tmp_path):
    out = run(p.written_stream(streamed(spark, arrivals)), tmp_path)
    checked = integrity.arrivals_checked(spark.read.parquet(arrivals))
    want = {tuple(r) for r in checked.where("not duplicate").select("arrival", "source_sequence").collect()}
    assert {tuple(r) for r in out.where("kind = 'record'").select("arrival", "source_sequence").collect()} == want
    gaps = {tuple(r) for r in integrity.gaps(checked).select("arrival", "gap_first", "gap_last").collect()}
    assert {tuple(r) for r in out.where("kind = 'gap'").select("arrival", "gap_first", "gap_last").collect()} == gaps


def test_receiver(spark, arrivals, tmp_path):
    out = run(p.deduplicated_stream(streamed(spark, arrivals)), tmp_path)
    got = {tuple(r)[:-1]: r.highest for r in out.groupBy(*p.SOURCE).agg(F.max("highest").alias("highest")).collect()}
    want = {tuple(r)[:-1]: r.highest for r in integrity.highest_contiguous(spark.read.parquet(arrivals)).collect()}
    assert got == want


def test_retransmission(spark, arrivals, tmp_path):
    s = streamed(spark, arrivals).select(*p.SOURCE, "arrival", F.when(F.col("arrival") % 6 == 0, "accepted").otherwise("frame").alias("kind"), F.when(F.col("arrival") % 6 == 0, F.col("source_sequence") - 1).otherwise(F.col("source_sequence")).alias("sequence"), F.when(F.col("arrival") % 12 == 0, F.col("source_sequence") - 2).alias("highest"))
    # its timers keep the query alive, so it is stopped once it has seen every row
    q = p.outstanding_stream(s).writeStream.option("checkpointLocation", f"{tmp_path}/ck").format("parquet").start(f"{tmp_path}/out")
    total, end = spark.read.parquet(arrivals).count(), time.time() + 90
    while sum(x["numInputRows"] for x in q.recentProgress) < total and time.time() < end and q.isActive:
        time.sleep(0.3)
    q.stop()
    out = spark.read.parquet(f"{tmp_path}/out").groupBy("event").count().collect()
    n = {r.event: r["count"] for r in out}
    assert 0 < n["acknowledged"] < n["outstanding"]


def test_snapshot(spark, arrivals, tmp_path):
    out = run(p.snapshot_stream(streamed(spark, arrivals)), tmp_path, "complete")
    want = storage.latest(spark.read.parquet(arrivals), ["topic_id", "partition_id"], "ingestion_sequence")
    assert sorted(tuple(r)[:3] for r in out.select("topic_id", "partition_id", "ingestion_sequence").collect()) == sorted(tuple(r) for r in want.select("topic_id", "partition_id", "ingestion_sequence").collect())


def test_windows_and_leases(spark, arrivals, tmp_path):
    s = streamed(spark, arrivals)
    assert run(p.windowed_counts(s, "1 hour", "1 day"), tmp_path / "w").count() >= 0
    leases = run(p.lease_stream(s.withColumnRenamed("publisher_id", "owner_id"), "2 hours"), tmp_path / "l")
    assert leases.agg(F.sum("heartbeats")).first()[0] <= 1020
