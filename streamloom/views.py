"""Event-log relations derived from the driver's tables, as DataFrames and as DuckDB common table expressions.

record: one row for each event, a message in a partitioned log. arrival: records in the order in which they
reach a writer, some of them twice. segment: files of a partitioned log, of orders. node, publisher,
subscriber, topic, driver: registry tables, of suppliers, customers and parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.plans.running import running

TOPICS = ("click", "error", "purchase", "signup", "view")
SEGMENT_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topic(spark: SparkSession) -> DataFrame:
    return spark.range(1, len(TOPICS) + 1).select(F.col("id").alias("topic_id"), F.element_at(F.array(*map(F.lit, TOPICS)), F.col("id").cast("int")).alias("topic_name"))


TOPIC_SQL = "topic AS (SELECT * FROM (VALUES " + ", ".join(f"({i + 1}::BIGINT, '{t}')" for i, t in enumerate(TOPICS)) + ") AS t(topic_id, topic_name))"


def record(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.lit(None).cast("bigint")
    for i, t in enumerate(TOPICS):
        kind = F.when(F.col("event_type") == t, F.lit(i + 1).cast("bigint")).otherwise(kind)
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    base = e.select(
        "event_id", kind.alias("topic_id"), (F.col("user_id") % 4).alias("partition_id"), (F.col("user_id") % 8 + 1).alias("node_id"),
        F.col("user_id").alias("publisher_id"), F.lit(1).cast("bigint").alias("publisher_epoch"), ns.alias("ingestion_ts_ns"),
        (ns - F.col("event_id") % 7 * 1000).alias("observed_ts_ns"), F.length("props").cast("bigint").alias("payload_size"),
        F.when(F.col("event_id") % 97 == 0, 2).otherwise(0).cast("bigint").alias("flags"), "props", "value",
    )
    one = F.lit(1).cast("bigint")
    numbered = running(base, ["topic_id", "partition_id"], "event_id", {"ingestion_sequence": ("sum", one, True)})
    skipped = (F.col("event_id") % 10 == 0).cast("bigint")
    sourced = running(numbered, ["topic_id", "publisher_id"], "event_id", {"_n": ("sum", one, True), "_skipped": ("sum", skipped, False)})
    return sourced.withColumn("source_sequence", F.col("_n") + F.col("_skipped")).drop("_n", "_skipped")


RECORD_SQL = (
    "base AS (SELECT event_id, CASE event_type " + " ".join(f"WHEN '{t}' THEN {i + 1}::BIGINT" for i, t in enumerate(TOPICS)) + """ END AS topic_id,
  user_id % 4 AS partition_id, user_id % 8 + 1 AS node_id, user_id AS publisher_id, 1::BIGINT AS publisher_epoch,
  epoch_us(ts) * 1000 AS ingestion_ts_ns, epoch_us(ts) * 1000 - event_id % 7 * 1000 AS observed_ts_ns,
  length(props)::BIGINT AS payload_size, (CASE WHEN event_id % 97 = 0 THEN 2 ELSE 0 END)::BIGINT AS flags, props, value FROM events),
record AS (SELECT *, row_number() OVER (PARTITION BY topic_id, partition_id ORDER BY event_id) AS ingestion_sequence,
  row_number() OVER (PARTITION BY topic_id, publisher_id ORDER BY event_id)
  + coalesce(sum(CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY topic_id, publisher_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS source_sequence FROM base)"""
)


def arrival(records: DataFrame) -> DataFrame:
    """Every record at arrival 2 * event_id, every fiftieth again a little later."""
    again = records.where(F.col("event_id") % 50 == 0).withColumn("arrival", F.col("event_id") * 2 + 7)
    return records.withColumn("arrival", F.col("event_id") * 2).unionByName(again)


ARRIVAL_SQL = "arrival AS (SELECT *, event_id * 2 AS arrival FROM record UNION ALL SELECT *, event_id * 2 + 7 FROM record WHERE event_id % 50 = 0)"


def segment_file(records: DataFrame) -> DataFrame:
    """The record log's own segments: SEGMENT_ROWS consecutive ingestion sequences of a partition each."""
    number = F.floor((F.col("ingestion_sequence") - 1) / SEGMENT_ROWS)
    return records.groupBy("topic_id", "partition_id", number.alias("segment_id")).agg(
        F.min("ingestion_sequence").alias("first_sequence"), F.max("ingestion_sequence").alias("last_sequence"), F.min("ingestion_ts_ns").alias("created_at_ns"),
        F.max("ingestion_ts_ns").alias("latest_ts_ns"), F.sum("payload_size").alias("size_bytes"),
    )


SEGMENT_FILE_SQL = f"""segment_file AS (SELECT topic_id, partition_id, (ingestion_sequence - 1) // {SEGMENT_ROWS} AS segment_id,
  min(ingestion_sequence) AS first_sequence, max(ingestion_sequence) AS last_sequence, min(ingestion_ts_ns) AS created_at_ns,
  max(ingestion_ts_ns) AS latest_ts_ns, sum(payload_size)::BIGINT AS size_bytes FROM record GROUP BY ALL)"""

#: Of a segment: 1 creating, 2 open, 3 sealed, 4 indexed, 5 retained, 6 deleted.
SEGMENT_STATES = ("creating", "open", "sealed", "indexed", "retained", "deleted")


def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_orderkey") + 1).alias("segment_id"), (F.col("o_custkey") % 16 + 1).alias("topic_id"), (F.col("o_custkey") % 3).alias("partition_id"),
        (F.col("o_orderkey") % 6 + 1).alias("state"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("latest_ts"),
        (F.col("o_orderkey") % 13 == 0).alias("archive_complete"),
    )


SEGMENT_SQL = """segment AS (SELECT o_orderkey + 1 AS segment_id, o_custkey % 16 + 1 AS topic_id, o_custkey % 3 AS partition_id, o_orderkey % 6 + 1 AS state,
  round(o_totalprice * 100)::BIGINT AS size_bytes, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS latest_ts, o_orderkey % 13 = 0 AS archive_complete FROM orders)"""


def node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """health 0 healthy, 1 degraded, 2 unavailable; liveness 0 unknown, 1 alive, 2 dead; lease_deadline in seconds."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (k + 1).alias("node_id"), (k % 5 % 3).alias("health"), (k % 7 % 3).alias("liveness"), (1000 + k * 37 % 500).alias("lease_deadline"),
        (k % 4 + 1).alias("lease_epoch"), F.concat(F.lit("domain"), F.col("s_nationkey")).alias("trust_domain"), (k % 6).alias("endpoint_count"), (k % 9).alias("config_version"),
    )


NODE_SQL = """node AS (SELECT s_suppkey + 1 AS node_id, s_suppkey % 5 % 3 AS health, s_suppkey % 7 % 3 AS liveness, 1000 + s_suppkey * 37 % 500 AS lease_deadline,
  s_suppkey % 4 + 1 AS lease_epoch, 'domain' || s_nationkey AS trust_domain, s_suppkey % 6 AS endpoint_count, s_suppkey % 9 AS config_version FROM supplier)"""


def participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations of a topic: kind 0 publisher, 1 subscriber, 2 bridge, 3 recorder, 4 replay pin."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("participant_id"), (k % 64 + 1).alias("topic_id"), (k % 5).alias("kind"), (k * 7 % 100 + 1).alias("node_id"), (k % 3 + 1).alias("generation"))


PARTICIPANT_SQL = """participant AS (SELECT c_custkey AS participant_id, c_custkey % 64 + 1 AS topic_id, c_custkey % 5 AS kind, c_custkey * 7 % 100 + 1 AS node_id, c_custkey % 3 + 1 AS generation FROM customer)"""


def driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport drivers: kind 0 tcp, 1 udp, 2 shared memory; reliable or not; health as of nodes; max_frame 0 is unbounded."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("driver_id"), (k % 3).alias("kind"), (k % 2 == 0).alias("reliable"), (k % 11 % 4).alias("health"), (F.col("p_size") % 5).cast("bigint").alias("priority"), (k % 4 * 1000).alias("max_frame"), (k % 13 != 0).alias("is_running"))


DRIVER_SQL = """driver AS (SELECT p_partkey AS driver_id, p_partkey % 3 AS kind, p_partkey % 2 = 0 AS reliable, p_partkey % 11 % 4 AS health, (p_size % 5)::BIGINT AS priority,
  p_partkey % 4 * 1000 AS max_frame, p_partkey % 13 <> 0 AS is_running FROM part)"""

RECORDS = f"WITH {TOPIC_SQL},\n{RECORD_SQL}"
ARRIVALS = f"{RECORDS},\n{ARRIVAL_SQL}"
FILES = f"{RECORDS},\n{SEGMENT_FILE_SQL}"
