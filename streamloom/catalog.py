"""Every named query of the engine over the driver's tables, with its DuckDB counterpart."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom import views as v
from streamloom.functions import scalars as f
from streamloom.operators import capacity, delivery, integrity, registry, replay, storage, telemetry
from streamloom.operators.replay import Range, ReplayFilter

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    from streamloom import simulations  # noqa: F401  its queries register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from streamloom import simulations  # noqa: F401

    return dict(_SQL)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; where it names none, a temporary one of a local session."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="streamloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def L(x) -> F.Column:  # noqa: N802
    return F.lit(x).cast("bigint")


# replay -------------------------------------------------------------------------------------

FILTER = ReplayFilter(ingestion_sequence=Range(10, 400_000), source_sequence=Range(2, None), topic_ids=frozenset({1, 3}), topic_names=frozenset({"view"}), node_ids=frozenset({1, 2, 3, 5, 8}))
FILTER_SQL = "flags & 1 = 0 AND topic_id IN (1, 3, 5) AND node_id IN (1, 2, 3, 5, 8) AND ingestion_sequence BETWEEN 10 AND 400000 AND source_sequence >= 2"
KEY_SQL = "row(ingestion_ts_ns, topic_id, partition_id, ingestion_sequence, node_id, publisher_id, publisher_epoch, source_sequence, observed_ts_ns)"
MERGE_SQL = f"max({KEY_SQL}) OVER (PARTITION BY topic_id, partition_id ORDER BY ingestion_sequence)"


def _filtered(spark, d) -> DataFrame:
    return v.record(spark, d).where(replay.resolved(FILTER, v.topic(spark)).condition())


@query(f"""{v.RECORDS}
SELECT topic_id, topic_name, partition_id, ingestion_sequence, node_id, publisher_id, publisher_epoch, source_sequence, ingestion_ts_ns, observed_ts_ns, flags,
  'session-1' AS session, 'replay' AS namespace, ingestion_ts_ns AS publish_ts_ns, row_number() OVER (ORDER BY k, ingestion_sequence) - 1 AS position
FROM (SELECT *, {MERGE_SQL} AS k FROM record WHERE {FILTER_SQL}) JOIN topic USING (topic_id)""")
def replay_filtered_merge(spark, d):
    return replay.metadata(replay.positioned(_filtered(spark, d)), v.topic(spark), "session-1", extra=["position"])


@query(f"""{v.RECORDS}
SELECT topic_id, partition_id, ingestion_sequence, 1000000 + CAST(floor(greatest(ingestion_ts_ns - first(ingestion_ts_ns) OVER (ORDER BY {KEY_SQL}), 0) / 2.0) AS BIGINT) AS target_ns
FROM record WHERE {FILTER_SQL}""")
def replay_schedule(spark, d):
    return replay.schedule(_filtered(spark, d), 1_000_000, 2.0).select("topic_id", "partition_id", "ingestion_sequence", "target_ns")


@query(f"""{v.RECORDS}
SELECT topic_id, partition_id, ingestion_sequence FROM (SELECT *, {MERGE_SQL} AS k FROM record WHERE {FILTER_SQL}) ORDER BY k, ingestion_sequence LIMIT 1 OFFSET 5""")
def replay_step(spark, d):
    return replay.merged(_filtered(spark, d)).offset(5).limit(1).select("topic_id", "partition_id", "ingestion_sequence")


class _Shy(replay.Publisher):
    """Takes everything but one kind of message, at which it fails."""

    def publish(self, request: dict) -> None:
        if request["source_sequence"] % 97 == 96:
            raise replay.ReplayError("refused")


@query(f"""{v.RECORDS},
due AS (SELECT *, row_number() OVER w AS n, min(CASE WHEN source_sequence % 97 = 96 THEN ingestion_sequence END) OVER (PARTITION BY topic_id, partition_id) AS stop FROM record JOIN topic USING (topic_id) WHERE flags & 1 = 0 WINDOW w AS (PARTITION BY topic_id, partition_id ORDER BY ingestion_sequence))
SELECT topic_id, partition_id, count(CASE WHEN ingestion_sequence < coalesce(stop, ingestion_sequence + 1) THEN 1 END) AS published, max(CASE WHEN ingestion_sequence < coalesce(stop, ingestion_sequence + 1) THEN ingestion_sequence END) AS last_published, any_value(stop) AS failed_at, CASE WHEN any_value(stop) IS NOT NULL THEN 'ReplayError: refused' END AS error FROM due GROUP BY topic_id, partition_id""")
def replay_publish(spark, d):
    return replay.publish(replay.metadata(v.record(spark, d), v.topic(spark), "session-1"), _Shy)


@query("SELECT topic FROM (VALUES ('9'), ('nope')) t(topic)")
def replay_unknown_topics(spark, d):
    return replay.unknown_topics(v.topic(spark), [1, 9], ["view", "nope"])


@query(f"""{v.RECORDS}
SELECT topic_id, partition_id, ingestion_sequence, max(ingestion_ts_ns) OVER (PARTITION BY topic_id, partition_id ORDER BY ingestion_sequence) AS merge_ts FROM record""")
def merge_running_key(spark, d):
    return replay.with_merge_key(v.record(spark, d)).select("topic_id", "partition_id", "ingestion_sequence", F.col("merge_key.ingestion_ts_ns").alias("merge_ts"))


@query(f"""{v.RECORDS}
SELECT topic_id, count(*) AS records, count(CASE WHEN flags & 2 <> 0 THEN 1 END) AS tombstones, count(CASE WHEN flags & 1 <> 0 THEN 1 END) AS gaps FROM record GROUP BY topic_id""")
def flag_counts(spark, d):
    r = v.record(spark, d)
    return r.groupBy("topic_id").agg(F.count("*").alias("records"), F.count_if(F.col("flags").bitwiseAND(2) != 0).alias("tombstones"), F.count_if(integrity.is_gap(F.col("flags"))).alias("gaps"))


@query(f"""{v.RECORDS}
SELECT topic_id, topic_name, publisher_id, count(*) AS records FROM record JOIN topic USING (topic_id) GROUP BY ALL""")
def record_topic_names(spark, d):
    return v.record(spark, d).join(F.broadcast(v.topic(spark)), "topic_id").groupBy("topic_id", "topic_name", "publisher_id").agg(F.count("*").alias("records"))


def _schema_rows(spark, d):
    return v.record(spark, d).select("*", F.col("topic_id").alias("schema_ref"), (F.col("ingestion_sequence") % 5 % 3 + 1).alias("schema_version"), L(1).alias("layout_version"))


@query(f"""{v.RECORDS}
SELECT topic_id, count(*) AS mismatches FROM record WHERE ingestion_sequence % 5 % 3 + 1 = 3 GROUP BY topic_id""")
def schema_resolution_mismatches(spark, d):
    schemas = v.topic(spark).select("topic_id", F.col("topic_id").alias("schema_ref"), F.explode(F.array(L(1), L(2))).alias("schema_version"), L(1).alias("layout_version"))
    return replay.schema_mismatches(_schema_rows(spark, d), F.broadcast(schemas)).groupBy("topic_id").agg(F.count("*").alias("mismatches"))


@query("SELECT s_suppkey + 1 AS node_id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT s_suppkey + 1, s_name FROM supplier WHERE s_suppkey % 3 = 0")
def source_union(spark, d):
    s = v.table(spark, d, "supplier").select((F.col("s_suppkey") + 1).alias("node_id"), F.col("s_name").alias("name"))
    return s.where((F.col("node_id") - 1) % 2 == 0).unionByName(s.where((F.col("node_id") - 1) % 3 == 0)).distinct()


# integrity ----------------------------------------------------------------------------------

SRC = "topic_id, node_id, publisher_id, publisher_epoch"
CHECKED = f"""{v.ARRIVALS},
checked AS (SELECT *, max(source_sequence) OVER (PARTITION BY {SRC} ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_sequence FROM arrival),
gap AS (SELECT *, last_sequence + 1 AS gap_first, source_sequence - 1 AS gap_last FROM checked WHERE source_sequence > last_sequence + 1),
discard AS (SELECT {SRC}, source_sequence - 1 AS source_sequence, CASE WHEN event_id % 3 = 0 THEN 'cancelled' ELSE 'queue_full' END AS reason FROM record WHERE event_id % 4 < 3 AND source_sequence > 1)"""


def _checked(spark, d) -> DataFrame:
    return integrity.arrivals_checked(v.arrival(v.record(spark, d)))


@query(f"{CHECKED}\nSELECT {SRC}, arrival, source_sequence, last_sequence, coalesce(source_sequence <= last_sequence, false) AS duplicate FROM checked")
def arrival_classification(spark, d):
    return _checked(spark, d).select(*integrity.SOURCE, "arrival", "source_sequence", "last_sequence", "duplicate")


@query(f"{CHECKED}\nSELECT {SRC}, arrival, source_sequence FROM checked WHERE source_sequence <= last_sequence")
def duplicate_rows(spark, d):
    return _checked(spark, d).where("duplicate").select(*integrity.SOURCE, "arrival", "source_sequence")


@query(f"{CHECKED}\nSELECT {SRC}, partition_id, arrival, gap_first, gap_last, ingestion_ts_ns, observed_ts_ns FROM gap")
def gap_spans(spark, d):
    return integrity.gaps(_checked(spark, d))


@query(f"""{CHECKED}
SELECT g.topic_id, g.node_id, g.publisher_id, g.publisher_epoch, gap_first, gap_last,
  CASE WHEN count(DISTINCT d.source_sequence) = gap_last - gap_first + 1 AND count(DISTINCT d.reason) = 1 THEN min(d.reason) ELSE 'source_sequence_jump' END AS reason
FROM gap g LEFT JOIN discard d ON d.topic_id = g.topic_id AND d.node_id = g.node_id AND d.publisher_id = g.publisher_id AND d.publisher_epoch = g.publisher_epoch AND d.source_sequence BETWEEN gap_first AND gap_last
GROUP BY g.topic_id, g.node_id, g.publisher_id, g.publisher_epoch, gap_first, gap_last""")
def gap_reasons(spark, d):
    r = v.record(spark, d)
    discards = r.where("event_id % 4 < 3 and source_sequence > 1").select(*integrity.SOURCE, (F.col("source_sequence") - 1).alias("source_sequence"), F.when(F.col("event_id") % 3 == 0, "cancelled").otherwise("queue_full").alias("reason"))
    return integrity.gap_reasons(integrity.gaps(_checked(spark, d)), discards)


@query(f"""{CHECKED},
kept AS (SELECT *, source_sequence > last_sequence + 1 AS has_gap FROM checked WHERE NOT coalesce(source_sequence <= last_sequence, false)),
numbered AS (SELECT *, sum(CASE WHEN has_gap THEN 2 ELSE 1 END) OVER (PARTITION BY topic_id, partition_id ORDER BY arrival)::BIGINT AS n FROM kept)
SELECT topic_id, partition_id, node_id, publisher_id, publisher_epoch, arrival, ingestion_ts_ns, observed_ts_ns, flags, source_sequence, payload_size, n AS assigned_sequence FROM numbered
UNION ALL SELECT topic_id, partition_id, node_id, publisher_id, publisher_epoch, arrival, ingestion_ts_ns, observed_ts_ns, 1, last_sequence + 1, 24, n - 1 FROM numbered WHERE has_gap""")
def assigned_ingestion_sequence(spark, d):
    return integrity.written(_checked(spark, d))


@query(f"""{CHECKED}
SELECT {SRC}, coalesce(max(CASE WHEN source_sequence = rn THEN rn END), 0)::BIGINT AS highest
FROM (SELECT *, row_number() OVER (PARTITION BY {SRC} ORDER BY source_sequence) AS rn FROM (SELECT DISTINCT {SRC}, source_sequence FROM arrival)) GROUP BY ALL""")
def highest_contiguous(spark, d):
    return integrity.highest_contiguous(v.arrival(v.record(spark, d)))


@query(f"""{CHECKED}
SELECT topic_id, count(*) AS arrived, count(CASE WHEN NOT coalesce(source_sequence <= last_sequence, false) THEN 1 END) AS accepted, count(CASE WHEN source_sequence <= last_sequence THEN 1 END) AS duplicates,
  count(CASE WHEN source_sequence > last_sequence + 1 THEN 1 END) AS gaps, coalesce(sum(CASE WHEN source_sequence > last_sequence + 1 THEN source_sequence - 1 - last_sequence END), 0)::BIGINT AS missing
FROM checked GROUP BY topic_id""")
def writer_stats(spark, d):
    return integrity.stats(_checked(spark, d))


@query(f"""{v.RECORDS}
SELECT topic_id, partition_id, ingestion_sequence, previous FROM (SELECT *, lag(ingestion_sequence) OVER (PARTITION BY topic_id, partition_id ORDER BY ingestion_sequence) AS previous FROM record WHERE event_id % 11 <> 0)
WHERE previous IS NOT NULL AND ingestion_sequence <> previous + 1""")
def contiguity_breaks(spark, d):
    r = v.record(spark, d).where("event_id % 11 <> 0")
    return integrity.contiguity_breaks(r, ["topic_id", "partition_id"]).select("topic_id", "partition_id", "ingestion_sequence", "previous")


FILES_SHIFTED = f"{v.FILES},\nshifted AS (SELECT * REPLACE (CASE WHEN segment_id % 3 = 1 THEN first_sequence - 2 ELSE first_sequence END AS first_sequence) FROM segment_file)"


def _shifted(spark, d):
    return v.segment_file(v.record(spark, d)).withColumn("first_sequence", F.when(F.col("segment_id") % 3 == 1, F.col("first_sequence") - 2).otherwise(F.col("first_sequence")))


@query(f"""{FILES_SHIFTED}
SELECT topic_id, partition_id, segment_id, first_sequence, previous_last FROM (SELECT *, lag(last_sequence) OVER (PARTITION BY topic_id, partition_id ORDER BY first_sequence, created_at_ns, segment_id) AS previous_last FROM shifted)
WHERE first_sequence <= previous_last""")
def segment_order_breaks(spark, d):
    return integrity.order_breaks(_shifted(spark, d)).select("topic_id", "partition_id", "segment_id", "first_sequence", "previous_last")


@query(f"""{v.FILES}
SELECT topic_id, partition_id, segment_id, row_number() OVER (PARTITION BY topic_id, partition_id ORDER BY first_sequence, created_at_ns, segment_id) AS place FROM segment_file""")
def segment_replay_order(spark, d):
    w = F.row_number().over(replay.Window.partitionBy("topic_id", "partition_id").orderBy("first_sequence", "created_at_ns", "segment_id"))
    return v.segment_file(v.record(spark, d)).select("topic_id", "partition_id", "segment_id", w.cast("bigint").alias("place"))


@query(f"""{v.FILES}
SELECT r.topic_id, r.partition_id, r.ingestion_sequence, s.segment_id FROM record r JOIN segment_file s ON s.topic_id = r.topic_id AND s.partition_id = r.partition_id AND r.ingestion_sequence BETWEEN s.first_sequence AND s.last_sequence""")
def record_segments(spark, d):
    r = v.record(spark, d)
    return integrity.owning_segments(r, v.segment_file(r)).select("topic_id", "partition_id", "ingestion_sequence", "segment_id")


@query(f"""{v.RECORDS},
ack AS (SELECT topic_id, publisher_id, source_sequence AS observed, CASE WHEN event_id % 4 = 0 THEN source_sequence - 3 END AS highest, CASE WHEN event_id % 3 = 0 THEN 'nack' ELSE 'accepted' END AS disposition FROM record WHERE event_id % 6 < 2)
SELECT topic_id, publisher_id, source_sequence AS sequence FROM record r WHERE NOT EXISTS (SELECT 1 FROM ack a WHERE a.topic_id = r.topic_id AND a.publisher_id = r.publisher_id
  AND (r.source_sequence <= a.highest OR (a.disposition = 'accepted' AND r.source_sequence = a.observed)))""")
def unacknowledged_frames(spark, d):
    r = v.record(spark, d)
    acks = r.where("event_id % 6 < 2").select("topic_id", "publisher_id", F.col("source_sequence").alias("observed"), F.when(F.col("event_id") % 4 == 0, F.col("source_sequence") - 3).alias("highest"), F.when(F.col("event_id") % 3 == 0, "nack").otherwise("accepted").alias("disposition"))
    frames = r.select("topic_id", "publisher_id", F.col("source_sequence").alias("sequence"))
    return integrity.unacknowledged(frames, acks, ["topic_id", "publisher_id"])


# storage ------------------------------------------------------------------------------------

NOW = 10_500
SEGMENTS = f"WITH {v.SEGMENT_SQL}"
PLAN_SQL = f"""{SEGMENTS},
p1 AS (SELECT *, CASE WHEN state IN (3, 4, 5) THEN (CASE WHEN latest_ts <= {NOW} AND {NOW} - latest_ts >= 1200 THEN 1 ELSE 0 END) + (CASE WHEN archive_complete THEN 8 ELSE 0 END) ELSE 0 END AS first FROM segment WHERE state <> 6),
t AS (SELECT sum(size_bytes) FILTER (first = 0) AS b, count(*) FILTER (first = 0) AS n, sum(size_bytes) AS all_b, count(*) AS all_n FROM p1),
p2 AS (SELECT segment_id, size_bytes, t.b - coalesce(sum(size_bytes) OVER w, 0) AS b, t.n - count(*) OVER w AS n, all_b, all_n FROM p1, t WHERE state IN (3, 4, 5) AND first = 0
  WINDOW w AS (ORDER BY latest_ts, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT segment_id, size_bytes, first AS reasons FROM p1 WHERE first > 0 UNION ALL
  SELECT segment_id, size_bytes, (CASE WHEN b > all_b * 0.6 THEN 2 ELSE 0 END) + (CASE WHEN n > all_n * 0.7 THEN 4 ELSE 0 END) FROM p2 WHERE b > all_b * 0.6 OR n > all_n * 0.7)"""


def _plan(spark, d) -> tuple[DataFrame, DataFrame]:
    s = v.segment(spark, d)
    t = s.where("state <> 6").agg(F.sum("size_bytes").alias("b"), F.count("*").alias("n")).first()
    return s, storage.retention_plan(s, NOW, max_age=1200, max_bytes=int((t.b or 0) * 0.6), max_count=int(t.n * 0.7), delete_archived=True)


@query(f"{PLAN_SQL}\nSELECT segment_id, size_bytes, reasons FROM plan")
def retention_plan(spark, d):
    return _plan(spark, d)[1].select("segment_id", "size_bytes", "reasons")


@query(f"""{PLAN_SQL}
SELECT all_b::BIGINT AS total_bytes, all_n AS total_count, d.b::BIGINT AS deleted_bytes, d.n AS deleted_count, (all_b - d.b)::BIGINT AS remaining_bytes, all_n - d.n AS remaining_count FROM t, (SELECT sum(size_bytes) AS b, count(*) AS n FROM plan) d""")
def retention_summary(spark, d):
    return storage.retention_summary(*_plan(spark, d))


@query(f"""{PLAN_SQL}
SELECT segment_id, CASE WHEN segment_id IN (SELECT o_custkey * 3 + 1 FROM orders WHERE o_orderkey % 50 > 20 AND o_orderkey % 7 = 0) THEN 'pending' ELSE 'unlink' END AS step FROM plan""")
def deletion_steps(spark, d):
    o = v.table(spark, d, "orders").where("o_orderkey % 7 = 0")
    pins = o.select((F.col("o_custkey") * 3 + 1).alias("segment_id"), (F.col("o_orderkey") % 50).alias("expires_at"))
    return storage.deletion_steps(_plan(spark, d)[1], pins, 20)


@query(f"{SEGMENTS}\nSELECT segment_id, latest_ts FROM segment WHERE state IN (3, 4, 5) ORDER BY latest_ts, segment_id LIMIT 100")
def oldest_segments(spark, d):
    return v.segment(spark, d).where("state in (3, 4, 5)").orderBy("latest_ts", "segment_id").limit(100).select("segment_id", "latest_ts")


@query(f"""{v.RECORDS}
SELECT topic_id, partition_id, ingestion_sequence, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, partition_id ORDER BY ingestion_sequence DESC) AS rn FROM record) WHERE rn = 1""")
def snapshot_latest(spark, d):
    return storage.latest(v.record(spark, d), ["topic_id", "partition_id"], "ingestion_sequence").select("topic_id", "partition_id", "ingestion_sequence", "event_id", "props")


@query(f"""{SEGMENTS}
SELECT count(DISTINCT topic_id) AS topics, count(DISTINCT (topic_id, partition_id)) AS partitions, count(*) AS segments, sum(size_bytes)::BIGINT AS bytes FROM segment""")
def session_totals(spark, d):
    return storage.session_totals(v.segment(spark, d))


@query("""SELECT key, moment, previous, state FROM (SELECT o_custkey AS key, o_orderkey AS moment, o_orderkey % 5 % 4 + 2 AS state, lag(o_orderkey % 5 % 4 + 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders)
WHERE previous <> state AND (previous, state) NOT IN ((1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6))""")
def segment_lifecycle_breaks(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("moment"), (F.col("o_orderkey") % 5 % 4 + 2).alias("state"))
    return storage.bad_moves(o, storage.SEGMENT_MOVES, ["key"], "moment").select("key", "moment", "previous", "state")


DISK = f"""{v.FILES},
disk AS (SELECT 't' || topic_id || '/p' || partition_id || '/' || segment_id AS path, * FROM segment_file),
tracked AS (SELECT * FROM disk WHERE (topic_id + segment_id) % 7 <> 3)"""


def _disk(spark, d) -> tuple[DataFrame, DataFrame]:
    disk = v.segment_file(v.record(spark, d)).withColumn("path", F.concat(F.lit("t"), F.col("topic_id"), F.lit("/p"), F.col("partition_id"), F.lit("/"), F.col("segment_id")))
    return disk, disk.where("(topic_id + segment_id) % 7 <> 3")


@query(f"{DISK}\nSELECT path, size_bytes FROM disk WHERE path NOT IN (SELECT path FROM tracked)")
def orphan_segments(spark, d):
    return storage.orphans(*_disk(spark, d)).select("path", "size_bytes")


@query(f"""{DISK.replace("WITH", "WITH RECURSIVE", 1)},
file AS (SELECT *, segment_id < 2 AS known, segment_id % 4 <> 1 AS sealed, (topic_id + segment_id) % 9 <> 4 AS readable FROM disk WHERE (topic_id * 3 + segment_id) % 11 <> 7),
turn AS (SELECT *, row_number() OVER (PARTITION BY topic_id, partition_id ORDER BY NOT known, segment_id) AS n FROM file),
walk AS (SELECT topic_id, partition_id, 0::BIGINT AS n, 0::BIGINT AS id, 0::BIGINT AS done, NULL::VARCHAR AS path, NULL::VARCHAR AS action FROM turn WHERE n = 1
  UNION ALL SELECT topic_id, partition_id, n, CASE WHEN fits THEN greatest(id, segment_id) ELSE id END, CASE WHEN fits THEN greatest(done, last_sequence) ELSE done END, path,
    CASE WHEN NOT fits THEN 'quarantine' WHEN known THEN CASE WHEN sealed THEN 'keep' ELSE 'repair_tail' END WHEN sealed THEN 'adopt' ELSE 'repair_adopt' END
  FROM (SELECT t.*, w.id, w.done, t.known OR (t.readable AND t.segment_id > w.id AND t.first_sequence = w.done + 1) AS fits FROM walk w JOIN turn t ON t.topic_id = w.topic_id AND t.partition_id = w.partition_id AND t.n = w.n + 1))
SELECT path, topic_id, partition_id, action FROM walk WHERE path IS NOT NULL""")
def session_recovery(spark, d):
    disk, _ = _disk(spark, d)
    k = F.col("segment_id")
    files = disk.where((F.col("topic_id") * 3 + k) % 11 != 7).withColumn("sealed", k % 4 != 1).withColumn("readable", (F.col("topic_id") + k) % 9 != 4)
    return storage.recovery_decisions(files, files.where("segment_id < 2"))


MANIFEST = f"""{v.FILES},
manifest AS (SELECT topic_id, partition_id, segment_id AS position, CASE WHEN segment_id % 9 = 5 THEN segment_id - 1 ELSE segment_id + 1 END AS segment_id, CASE WHEN segment_id % 3 = 1 THEN first_sequence - 2 ELSE first_sequence END AS first_sequence, last_sequence,
  segment_id // 2 AS path, segment_id % 5 + 1 AS state, 100 AS created_at, (segment_id * 67) % 210 AS sealed_at, segment_id * 13 AS size_bytes, CASE WHEN segment_id % 4 = 0 THEN last_sequence + segment_id % 3 - 1 END AS checkpoint FROM segment_file),
m AS (SELECT *, lag(segment_id) OVER w AS pid, lag(last_sequence) OVER w AS plast, lead(position) OVER w AS nxt, count(*) OVER (PARTITION BY topic_id, partition_id, path) AS paths FROM manifest WINDOW w AS (PARTITION BY topic_id, partition_id ORDER BY position))"""


def _manifest(spark, d):
    k = F.col("segment_id")
    return v.segment_file(v.record(spark, d)).select(
        "topic_id", "partition_id", k.alias("position"), F.when(k % 9 == 5, k - 1).otherwise(k + 1).alias("segment_id"), F.when(k % 3 == 1, F.col("first_sequence") - 2).otherwise(F.col("first_sequence")).alias("first_sequence"),
        "last_sequence", F.floor(k / 2).alias("path"), (k % 5 + 1).alias("state"), L(100).alias("created_at"), (k * 67 % 210).alias("sealed_at"), (k * 13).alias("size_bytes"), F.when(k % 4 == 0, F.col("last_sequence") + k % 3 - 1).alias("checkpoint"),
    )


@query(f"""{MANIFEST}
SELECT topic_id, partition_id, segment_id, 'segment_id_order' AS rule FROM m WHERE segment_id <= pid
UNION ALL SELECT topic_id, partition_id, segment_id, 'sequence_overlap' FROM m WHERE first_sequence <= plast
UNION ALL SELECT topic_id, partition_id, segment_id, 'duplicate_path' FROM m WHERE paths > 1
UNION ALL SELECT topic_id, partition_id, segment_id, 'active_not_last' FROM m WHERE state < 3 AND nxt IS NOT NULL
UNION ALL SELECT topic_id, partition_id, segment_id, 'sealed_at' FROM m WHERE CASE WHEN state >= 3 THEN sealed_at < created_at ELSE sealed_at <> 0 END
UNION ALL SELECT topic_id, partition_id, segment_id, 'sealed_size' FROM m WHERE state >= 3 AND size_bytes < 52
UNION ALL SELECT topic_id, partition_id, segment_id, 'checkpoint_outside' FROM m WHERE checkpoint < first_sequence OR checkpoint > last_sequence""")
def partition_manifest_violations(spark, d):
    return storage.manifest_violations(_manifest(spark, d))


@query("""WITH t AS (SELECT p_partkey AS topic_id, p_name AS name, p_partkey % 7 AS schema_ref, p_brand AS digest, lag(p_partkey % 7) OVER (ORDER BY p_partkey) AS previous, count(*) OVER (PARTITION BY p_name) AS names, count(*) OVER (PARTITION BY p_brand, p_partkey % 7) AS digests FROM part)
SELECT topic_id, 'zero_id' AS rule FROM t WHERE topic_id = 0 UNION ALL SELECT topic_id, 'duplicate_name' FROM t WHERE names > 1
UNION ALL SELECT topic_id, 'schema_ref_order' FROM t WHERE schema_ref <= previous UNION ALL SELECT topic_id, 'duplicate_digest' FROM t WHERE digests > 1""")
def recording_manifest_violations(spark, d):
    p = v.table(spark, d, "part").select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 7).alias("schema_ref"), F.col("p_brand").alias("digest"))
    return storage.recording_violations(p)


@query("""SELECT topic_id, generation, config_version, durable_sequence, behind FROM (SELECT c_custkey AS topic_id, c_custkey % 9 AS generation, c_custkey % 5 AS config_version, c_custkey % 100 AS durable_sequence,
  array_to_string(list_filter([CASE WHEN c_custkey % 9 < 4 THEN 'generation' END, CASE WHEN c_custkey % 5 < 2 THEN 'config_version' END, CASE WHEN c_custkey % 100 < 10 THEN 'durable_sequence' END], lambda x: x IS NOT NULL), ',') AS behind FROM customer) WHERE behind <> ''""")
def manifest_rollbacks(spark, d):
    k = F.col("c_custkey")
    m = v.table(spark, d, "customer").select(k.alias("topic_id"), (k % 9).alias("generation"), (k % 5).alias("config_version"), (k % 100).alias("durable_sequence"))
    least = m.select("topic_id", L(4).alias("generation"), L(2).alias("config_version"), L(10).alias("durable_sequence"))
    return storage.rollbacks(m, least)


@query("""SELECT p.partition_id, p.recording_id, s.recording_id AS session_id FROM (SELECT o_orderkey AS partition_id, o_custkey % 5 AS recording_id, o_custkey % 50 AS session FROM orders) p JOIN (SELECT c_custkey AS session, c_custkey % 4 AS recording_id FROM customer) s USING (session) WHERE p.recording_id <> s.recording_id""")
def session_identity_mismatches(spark, d):
    p = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("partition_id"), (F.col("o_custkey") % 5).alias("recording_id"), (F.col("o_custkey") % 50).alias("session"))
    s = v.table(spark, d, "customer").select(F.col("c_custkey").alias("session"), (F.col("c_custkey") % 4).alias("recording_id"))
    return storage.identity_mismatches(p, s)


@query("""SELECT l_orderkey, l_linenumber, n::BIGINT AS size, CASE WHEN n <= 64 THEN 64 WHEN n <= 256 THEN 256 WHEN n <= 2048 THEN 2048 WHEN n <= 65536 THEN 65536 END AS slot,
  (CASE WHEN n = 0 THEN 0 WHEN n <= 4096 THEN 4096 WHEN n <= 65536 THEN 65536 WHEN n <= 1048576 THEN 1048576 ELSE ((n + 4095) // 4096) * 4096 END)::BIGINT AS charged, (140 + ((n + 7) // 8) * 8)::BIGINT AS encoded
FROM (SELECT *, (l_orderkey * 37 + l_partkey * l_linenumber * 11) % 3000000 AS n FROM lineitem)""")
def size_classes(spark, d):
    n = (F.col("l_orderkey") * 37 + F.col("l_partkey") * F.col("l_linenumber") * 11) % 3_000_000
    li = v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", n.alias("size"))
    return li.select("*", f.slot_class(F.col("size")).alias("slot"), f.charged_bytes(F.col("size")).alias("charged"), f.encoded_record_size(F.col("size")).alias("encoded"))


@query(f"{v.RECORDS}\nSELECT topic_id, partition_id, ingestion_sequence, (ingestion_sequence - 1) // 128 AS segment_number FROM record")
def segment_rotation(spark, d):
    return storage.rotated(v.record(spark, d), ["topic_id", "partition_id"], "event_id", 128).select("topic_id", "partition_id", "ingestion_sequence", "segment_number")


@query(f"""{v.RECORDS}
SELECT topic_id, partition_id, ingestion_sequence FROM (SELECT *, sum(payload_size) OVER (PARTITION BY topic_id, partition_id ORDER BY event_id) AS b FROM record) WHERE b <= 4096""")
def drain_budget(spark, d):
    return storage.drained(v.record(spark, d), ["topic_id", "partition_id"], "event_id", "payload_size", 4096).select("topic_id", "partition_id", "ingestion_sequence")


@query("""WITH x AS (SELECT l_orderkey AS path, l_linenumber * 100 + l_suppkey % 100 AS "offset", NOT (l_partkey % 5 = 0) AS valid FROM lineitem),
y AS (SELECT path, count(CASE WHEN valid THEN 1 END) AS records, min("offset") FILTER (NOT valid) AS damage, max("offset") FILTER (valid) AS last_valid FROM x GROUP BY path)
SELECT path, records, damage, CASE WHEN damage IS NULL THEN 'clean' WHEN last_valid > damage THEN 'corruption' ELSE 'incomplete_tail' END AS disposition FROM y""")
def recovery_disposition(spark, d):
    x = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100).alias("offset"), (F.col("l_partkey") % 5 != 0).alias("valid"))
    return storage.disposition(x)


@query(f"""{v.RECORDS}
SELECT count(*) AS unknown FROM record WHERE NOT (event_id % 13 = 0 AND event_id % 3 = 0) AND event_id % 13 = 0 OR topic_id = 5 AND event_id % 13 <> 0""")
def unknown_schema_refs(spark, d):
    r = v.record(spark, d).select(F.when(F.col("event_id") % 13 == 0, 0).otherwise(F.col("topic_id")).alias("schema_ref"), (F.col("event_id") % 3 == 0).alias("gap"), "event_id")
    known = v.topic(spark).where("topic_id < 5").select(F.col("topic_id").alias("schema_ref"))
    checked = r.where(~(F.col("gap") & (F.col("schema_ref") == 0)))
    return checked.join(F.broadcast(known), "schema_ref", "left_anti").agg(F.count("*").alias("unknown"))


@query("SELECT r AS rate, p AS pause_ms, r * p // 1000 AS bytes FROM (VALUES (1000000::BIGINT), (50000000::BIGINT), (200000000::BIGINT)) a(r), (VALUES (10::BIGINT), (100::BIGINT), (1500::BIGINT)) b(p)")
def pause_buffer_sizes(spark, d):
    rate, pause = F.array(*map(L, (1_000_000, 50_000_000, 200_000_000))), F.array(*map(L, (10, 100, 1500)))
    grid = spark.range(1).select(F.explode(rate).alias("rate"), pause.alias("p")).select("rate", F.explode("p").alias("pause_ms"))
    return grid.withColumn("bytes", F.floor(F.col("rate") * F.col("pause_ms") / 1000))


@query(f"{SEGMENTS}\nSELECT state, CASE state WHEN 1 THEN 'creating' WHEN 2 THEN 'open' WHEN 3 THEN 'sealed' WHEN 4 THEN 'indexed' WHEN 5 THEN 'retained' WHEN 6 THEN 'deleted' END AS name, count(*) AS n FROM segment GROUP BY ALL")
def state_names(spark, d):
    return v.segment(spark, d).groupBy("state").agg(F.count("*").alias("n")).select("state", storage.state_name(F.col("state")).alias("name"), "n")


# telemetry ----------------------------------------------------------------------------------


@query(f"""{v.RECORDS}
SELECT topic_name AS name, '{{"name":"' || topic_name || '","gauge":{{"dataPoints":[{{"timeUnixNano":"77","asInt":"' || max(payload_size) || '"}}]}}}}' AS json FROM record JOIN topic USING (topic_id) GROUP BY topic_name""")
def otlp_gauges(spark, d):
    g = v.record(spark, d).groupBy("topic_id").agg(F.max("payload_size").alias("n")).join(F.broadcast(v.topic(spark)), "topic_id")
    return telemetry.otlp_gauge(g, "topic_name", "n", 77)


@query(f"{v.RECORDS}\nSELECT topic_id, sum(payload_size)::BIGINT AS value FROM record GROUP BY topic_id")
def counter_totals(spark, d):
    return v.record(spark, d).groupBy("topic_id").agg(F.sum("payload_size").alias("value"))


@query(f"""{v.RECORDS}
SELECT topic_id, sum(g)::BIGINT AS value FROM (SELECT topic_id, event_id % 32 AS shard, arg_max(payload_size * 10 + partition_id, event_id) AS g FROM record GROUP BY ALL) GROUP BY topic_id""")
def gauge_totals(spark, d):
    r = v.record(spark, d).select("topic_id", (F.col("event_id") % 32).alias("shard"), "event_id", (F.col("payload_size") * 10 + F.col("partition_id")).alias("g"))
    return telemetry.gauge_totals(r, ["topic_id"], "shard", "event_id", "g")


LATENCY = "(event_id * 7919 + publisher_id * 104729) % 5000011"
BUCKET = f"CASE WHEN {LATENCY} = 0 THEN 0 ELSE length(bin({LATENCY})) END"
HISTOGRAM = f"""{v.RECORDS},
hit AS (SELECT topic_id, ({BUCKET})::INTEGER AS bucket, count(*) AS count, sum({LATENCY})::BIGINT AS total FROM record GROUP BY ALL),
hist AS (SELECT t.topic_id, b::INTEGER AS bucket, coalesce(count, 0) AS count, coalesce(total, 0) AS total FROM topic t CROSS JOIN range(65) r(b) LEFT JOIN hit ON hit.topic_id = t.topic_id AND hit.bucket = b)"""


def _latencies(spark, d):
    return v.record(spark, d).select("topic_id", ((F.col("event_id") * 7919 + F.col("publisher_id") * 104729) % 5000011).alias("latency"))


@query(f"{HISTOGRAM}\nSELECT topic_id, bucket, count, total FROM hist")
def log2_histogram(spark, d):
    return telemetry.histogram(_latencies(spark, d), ["topic_id"], "latency")


@query(f"{HISTOGRAM}\nSELECT topic_id, bucket, count, total, sum(count) OVER (PARTITION BY topic_id ORDER BY bucket)::BIGINT AS cumulative FROM hist")
def cumulative_buckets(spark, d):
    return telemetry.cumulative(telemetry.histogram(_latencies(spark, d), ["topic_id"], "latency"), ["topic_id"])


@query(f"""{HISTOGRAM},
c AS (SELECT topic_name AS name, bucket, count, total, sum(count) OVER (PARTITION BY topic_id ORDER BY bucket)::BIGINT AS cumulative FROM hist JOIN topic USING (topic_id))
SELECT name, bucket AS place, name || '_bucket{{le="' || CASE WHEN bucket = 64 THEN '+Inf' ELSE ((1::HUGEINT << bucket) - 1)::VARCHAR END || '"}} ' || cumulative AS line FROM c WHERE count > 0 OR bucket = 64
UNION ALL SELECT name, 65, name || '_sum ' || sum(total)::BIGINT FROM c GROUP BY name UNION ALL SELECT name, 66, name || '_count ' || sum(count)::BIGINT FROM c GROUP BY name""")
def prometheus_lines(spark, d):
    h = telemetry.histogram(_latencies(spark, d), ["topic_id"], "latency").join(F.broadcast(v.topic(spark)), "topic_id").withColumnRenamed("topic_name", "name")
    return telemetry.prometheus_lines(h, "name")


@query(f"""{HISTOGRAM}
SELECT topic_name AS name, '{{"name":"' || topic_name || '","histogram":{{"aggregationTemporality":2,"dataPoints":[{{"timeUnixNano":"77","startTimeUnixNano":"5","count":"' || sum(count)::BIGINT || '","sum":' || sum(total)::BIGINT || ',"bucketCounts":[' || string_agg('"' || count || '"', ',' ORDER BY bucket) || '],"explicitBounds":[' || (SELECT string_agg(((1::HUGEINT << b) - 1)::VARCHAR, ',' ORDER BY b) FROM range(64) r(b)) || ']}}]}}}}' AS json
FROM hist JOIN topic USING (topic_id) GROUP BY topic_name""")
def otlp_histograms(spark, d):
    h = telemetry.histogram(_latencies(spark, d), ["topic_id"], "latency").join(F.broadcast(v.topic(spark)), "topic_id")
    return telemetry.otlp_histogram(h, "topic_name", 77, 5)


@query(f"""{v.RECORDS}
SELECT topic_name AS name, '{{"name":"' || topic_name || '","sum":{{"aggregationTemporality":2,"isMonotonic":true,"dataPoints":[{{"asInt":"' || count(*) || '"}}]}}}}' AS json FROM record JOIN topic USING (topic_id) GROUP BY topic_name""")
def otlp_metrics(spark, d):
    c = v.record(spark, d).groupBy("topic_id").agg(F.count("*").alias("n")).join(F.broadcast(v.topic(spark)), "topic_id").select(F.col("topic_name").alias("name"), "n")
    return telemetry.otlp_json(c, "name", "n")


@query(f"""{v.RECORDS}
SELECT 'counter' AS kind, topic_name AS name, count(*) AS value FROM record JOIN topic USING (topic_id) GROUP BY ALL
UNION ALL SELECT 'gauge', topic_name, max(event_id) FROM record JOIN topic USING (topic_id) GROUP BY ALL UNION ALL SELECT 'histogram', topic_name, sum({LATENCY})::BIGINT FROM record JOIN topic USING (topic_id) GROUP BY ALL""")
def metric_snapshot(spark, d):
    r = v.record(spark, d).select("topic_id", "event_id", ((F.col("event_id") * 7919 + F.col("publisher_id") * 104729) % 5000011).alias("latency"))
    one = r.groupBy("topic_id").agg(F.count("*").alias("counter"), F.max("event_id").alias("gauge"), F.sum("latency").alias("histogram")).join(F.broadcast(v.topic(spark)), "topic_id")
    return one.unpivot(["topic_name"], ["counter", "gauge", "histogram"], "kind", "value").withColumnRenamed("topic_name", "name")


@query(f"""{v.RECORDS},
x AS (SELECT topic_id, {LATENCY} AS latency, row_number() OVER (PARTITION BY topic_id ORDER BY {LATENCY}) AS rn, count(*) OVER (PARTITION BY topic_id) AS n FROM record)
SELECT topic_id, p::INTEGER AS percent, latency AS value FROM x, (VALUES (50), (95), (99), (100)) q(p) WHERE rn = greatest(1, (p * n + 99) // 100)""")
def nearest_rank_percentiles(spark, d):
    return telemetry.nearest_rank(_latencies(spark, d), ["topic_id"], "latency")


CLOCK = f"""{v.RECORDS},
s AS (SELECT publisher_id % 16 AS shard, event_id, ingestion_ts_ns // 1000 AS wall, ingestion_ts_ns // 1000 + CASE WHEN event_id % 23 = 0 THEN 4000 ELSE 0 END AS mono, ingestion_ts_ns // 1000 - (event_id % 50) * 100 + CASE WHEN event_id % 31 = 0 THEN 9000 ELSE 0 END AS origin,
  event_id % 10 AS uncertainty, ingestion_ts_ns // 1000 - (event_id % 7) * 1000 AS last_sync, event_id % 17 <> 0 AS synchronized, 1 AS quality_domain, CASE WHEN event_id % 41 = 0 THEN 2 ELSE 1 END AS origin_domain FROM record),
p AS (SELECT *, lag(wall) OVER w AS pw, lag(mono) OVER w AS pm FROM s WINDOW w AS (PARTITION BY shard ORDER BY event_id)),
g AS (SELECT *, CASE WHEN pw IS NOT NULL AND (wall < pw OR mono < pm OR abs((wall - pw) - (mono - pm)) > 2000) THEN 'clock_jump'
  WHEN NOT synchronized OR quality_domain <> origin_domain OR uncertainty > 7 OR wall < last_sync OR wall - last_sync > 5000 THEN 'uncertain' WHEN wall < origin THEN 'negative' ELSE 'accepted' END AS decision FROM p)"""


def _gated(spark, d):
    e, t = F.col("event_id"), F.expr("ingestion_ts_ns div 1000")
    s = v.record(spark, d).select(
        (F.col("publisher_id") % 16).alias("shard"), "event_id", t.alias("wall"), (t + F.when(e % 23 == 0, 4000).otherwise(0)).alias("mono"), (t - e % 50 * 100 + F.when(e % 31 == 0, 9000).otherwise(0)).alias("origin"),
        (e % 10).alias("uncertainty"), (t - e % 7 * 1000).alias("last_sync"), (e % 17 != 0).alias("synchronized"), F.lit(1).alias("quality_domain"), F.when(e % 41 == 0, 2).otherwise(1).alias("origin_domain"),
    )
    return telemetry.clock_gated(s, "shard", "event_id", 7, 2000, 5000)


@query(f"{CLOCK}\nSELECT shard, event_id, decision, CASE WHEN decision = 'accepted' THEN wall - origin END AS latency FROM g")
def clock_gate(spark, d):
    return _gated(spark, d).select("shard", "event_id", "decision", "latency")


@query(f"{CLOCK}\nSELECT decision, count(*) AS samples, coalesce(sum(CASE WHEN decision = 'accepted' THEN wall - origin END), 0)::BIGINT AS total FROM g GROUP BY decision")
def clock_gate_counts(spark, d):
    return _gated(spark, d).groupBy("decision").agg(F.count("*").alias("samples"), F.coalesce(F.sum("latency"), F.lit(0)).alias("total"))


# The sampling hash in DuckDB: 64-bit wrap-around arithmetic in wider integers.
_M = "18446744073709551616::UHUGEINT"


SAMPLE_STEPS = f"""{v.RECORDS},
h0 AS (SELECT *, topic_id::UHUGEINT AS h FROM record),
""" + ",\n".join(
    f"""a{i} AS (SELECT * EXCLUDE (h), (h + {f.MIX_INCREMENT}::UHUGEINT) % {_M} AS h FROM h{i}),
b{i} AS (SELECT * EXCLUDE (h), (xor(h, h >> 30) % {_M} * {f.MIX_FIRST}::UHUGEINT) % {_M} AS h FROM a{i}),
c{i} AS (SELECT * EXCLUDE (h), (xor(h, h >> 27) % {_M} * {f.MIX_SECOND}::UHUGEINT) % {_M} AS h FROM b{i}),
h{i + 1} AS (SELECT * EXCLUDE (h), xor(xor(h, h >> 31), {nxt}) AS h FROM c{i})"""
    for i, nxt in enumerate(("publisher_id::UHUGEINT", "source_sequence::UHUGEINT", "0::UHUGEINT"))
)


@query(f"{SAMPLE_STEPS}\nSELECT topic_id, publisher_id, source_sequence, (h % 1000000)::BIGINT AS point FROM h3")
def sample_points(spark, d):
    return v.record(spark, d).select("topic_id", "publisher_id", "source_sequence", f.sample_point(F.col("topic_id"), F.col("publisher_id"), F.col("source_sequence")).alias("point"))


@query(f"{SAMPLE_STEPS}\nSELECT topic_id, count(*) AS traced FROM h3 WHERE h % 1000000 < 250000 GROUP BY topic_id")
def sampled_events(spark, d):
    return telemetry.traced(v.record(spark, d), "sampled", 250_000).groupBy("topic_id").agg(F.count("*").alias("traced"))


@query("SELECT event_id FROM events WHERE (value * 100)::BIGINT % 977 >= 500 OR event_id % 29 = 0")
def slow_events(spark, d):
    e = v.table(spark, d, "events")
    return e.where(telemetry.slow_enough("sampled", 500, F.round(F.col("value") * 100).cast("bigint") % 977, F.col("event_id") % 29 == 0)).select("event_id")


RUNS = """WITH e AS (SELECT event_id, event_id // 7 % 5 + event_id // 40 AS second FROM events),
r AS (SELECT *, CASE WHEN second <> lag(second) OVER (ORDER BY event_id) OR event_id = (SELECT min(event_id) FROM e) THEN event_id END AS b FROM e),
k AS (SELECT *, max(b) OVER (ORDER BY event_id) AS run FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY event_id) AS nth FROM k)"""


@query(f"{RUNS}\nSELECT event_id, second FROM n WHERE nth <= 3")
def rate_limited_events(spark, d):
    e = v.table(spark, d, "events").select("event_id", (F.expr("event_id div 7") % 5 + F.expr("event_id div 40")).alias("second"))
    return telemetry.rate_limited(e, "second", "event_id", 3)


@query(f"""{SAMPLE_STEPS},
t AS (SELECT event_id, event_id // 100 AS second FROM h3 WHERE h % 1000000 < 500000 AND (payload_size >= 9 OR event_id % 29 = 0))
SELECT event_id, second FROM (SELECT *, row_number() OVER (PARTITION BY second ORDER BY event_id) AS nth FROM t) WHERE nth <= 5""")
def trace_admission(spark, d):
    r = telemetry.traced(v.record(spark, d), "sampled", 500_000).where(telemetry.slow_enough("sampled", 9, F.col("payload_size"), F.col("event_id") % 29 == 0))
    return telemetry.rate_limited(r.select("event_id", F.expr("event_id div 100").alias("second")), "second", "event_id", 5)


@query(r"""SELECT p_partkey, regexp_full_match(name, '[A-Za-z_:][A-Za-z0-9_:]*') AND octet_length(name::BLOB) < 64 AS valid, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*') AS full_name
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN replace(p_name, ' ', ':') WHEN 3 THEN p_partkey || p_name ELSE replace(p_name, ' ', '.') || repeat('x', (p_partkey % 70)::INTEGER) END AS name FROM part)""")
def metric_names(spark, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 5 == 0, n).when(k % 5 == 1, F.replace(n, F.lit(" "), F.lit("_"))).when(k % 5 == 2, F.replace(n, F.lit(" "), F.lit(":"))).when(k % 5 == 3, F.concat(k, n)).otherwise(F.concat(F.replace(n, F.lit(" "), F.lit(".")), F.repeat(F.lit("x"), (k % 70).cast("int"))))
    return v.table(spark, d, "part").select("p_partkey", name.alias("name")).select("p_partkey", f.metric_name_valid(F.col("name")).alias("valid"), f.full_name_valid(F.col("name")).alias("full_name"))


@query("SELECT doc_id, true AS valid FROM documents WHERE text IS NOT NULL")
def utf8_validity(spark, d):
    return v.table(spark, d, "documents").where("text is not null").select("doc_id", F.is_valid_utf8("text").alias("valid"))


# registry -----------------------------------------------------------------------------------

TOPIC_META = """topic_meta AS (SELECT p_partkey AS topic_id, CASE WHEN p_partkey % 19 = 0 THEN 'bad name' ELSE replace(p_name, ' ', '/') END AS name, p_partkey % 5 AS channel_kind, CASE WHEN p_partkey % 7 = 0 THEN 12 ELSE 16 END::BIGINT AS capacity,
  p_partkey % 3 AS max_publishers, p_partkey % 4 * 30 AS max_subscribers, p_partkey % 6 AS partition_count, p_partkey % 5 AS queue_full_policy, p_partkey % 2 AS reliability, p_partkey % 3 = 0 AS allow_drop,
  p_partkey % 8 AS schema_version, 1::BIGINT AS layout_version, p_partkey % 2 AS route_policy, p_partkey % 3 AS static_route_count, p_partkey % 10 AS config_version,
  p_partkey % 6 AS state, p_partkey % 4 AS schema_id, CASE p_partkey % 3 WHEN 0 THEN [p_partkey % 5, 9] WHEN 1 THEN range(1, 1 + p_partkey % 40) ELSE [7, 8, p_partkey % 9] END::BIGINT[] AS accepted_schemas, CASE WHEN p_partkey % 3 = 0 THEN [] ELSE [p_partkey % 5, p_partkey % 7][:(p_partkey % 3)::INTEGER] END::BIGINT[] AS static_routes,
  p_partkey % 11 AS region_version, 1::BIGINT AS channel_version, p_partkey % 12 AS acl_version, p_partkey % 4 AS route_set_version, p_partkey % 8 = 0 AS candidate FROM part)"""


def _topic_meta(spark, d):
    k = F.col("p_partkey")
    return v.table(spark, d, "part").select(
        k.alias("topic_id"), F.when(k % 19 == 0, "bad name").otherwise(F.replace("p_name", F.lit(" "), F.lit("/"))).alias("name"), (k % 5).alias("channel_kind"), F.when(k % 7 == 0, 12).otherwise(16).cast("bigint").alias("capacity"),
        (k % 3).alias("max_publishers"), (k % 4 * 30).alias("max_subscribers"), (k % 6).alias("partition_count"), (k % 5).alias("queue_full_policy"), (k % 2).alias("reliability"), (k % 3 == 0).alias("allow_drop"),
        (k % 8).alias("schema_version"), L(1).alias("layout_version"), (k % 2).alias("route_policy"), (k % 3).alias("static_route_count"), (k % 10).alias("config_version"),
        (k % 6).alias("state"), (k % 4).alias("schema_id"), F.when(k % 3 == 0, F.array(k % 5, L(9))).when(k % 3 == 1, F.when(k % 40 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(L(1), k % 40))).otherwise(F.array(L(7), L(8), k % 9)).alias("accepted_schemas"),
        F.slice(F.array(k % 5, k % 7), F.lit(1), (k % 3).cast("int")).alias("static_routes"), (k % 11).alias("region_version"), L(1).alias("channel_version"), (k % 12).alias("acl_version"), (k % 4).alias("route_set_version"), (k % 8 == 0).alias("candidate"),
    )


def _rules_sql(cte: str, source: str, key: str, rules: dict[str, str]) -> str:
    return cte + "\n" + "\nUNION ALL ".join(f"SELECT {key}, '{n}' AS rule FROM {source} WHERE {c}" for n, c in rules.items())


@query(_rules_sql(f"WITH {TOPIC_META}", "topic_meta", "topic_id", {
    "name": "NOT regexp_full_match(name, '[A-Za-z0-9_./-]+')", "channel_kind": "channel_kind NOT BETWEEN 0 AND 3", "capacity": "capacity = 12", "publishers": "max_publishers NOT BETWEEN 1 AND 65536", "subscribers": "max_subscribers NOT BETWEEN 1 AND 65536",
    "partitions": "partition_count NOT BETWEEN 1 AND 4096", "spsc_single": "channel_kind = 0 AND (max_publishers <> 1 OR max_subscribers <> 1)", "mpsc_single": "channel_kind = 1 AND max_subscribers <> 1", "broadcast_bitmap": "channel_kind = 2 AND max_subscribers > 64",
    "work_queue_sample": "channel_kind = 3 AND queue_full_policy = 4", "drop_forbidden": "NOT allow_drop AND queue_full_policy IN (2, 3, 4)", "ordered_drop": "reliability = 1 AND allow_drop", "schema_identity": "schema_version = 0",
    "discovery_routes": "route_policy = 0 AND static_route_count > 0", "static_routes": "route_policy = 1 AND static_route_count = 0", "config_version": "config_version = 0",
    "state": "state > 4", "accepted_bound": "len(accepted_schemas) > 16", "accepted_identity": "list_contains(accepted_schemas, 0) OR list_contains(accepted_schemas, schema_id)", "accepted_unique": "len(list_distinct(accepted_schemas)) < len(accepted_schemas)",
    "route_target": "list_contains(static_routes, 0)", "route_unique": "len(list_distinct(static_routes)) < len(static_routes)", "resource_version": "region_version = 0 OR acl_version = 0",
    "candidate_assigned": "candidate AND (topic_id <> 0 OR config_version <> 0 OR route_set_version <> 0 OR state <> 0)", "published_identity": "NOT candidate AND (topic_id = 0 OR route_set_version = 0)",
}))
def topic_metadata_violations(spark, d):
    return registry.topic_violations(_topic_meta(spark, d))


@query(_rules_sql(f"WITH {v.NODE_SQL}", "node", "node_id", {"no_endpoint": "endpoint_count = 0", "too_many_endpoints": "endpoint_count > 4", "lease": "lease_deadline > 1400", "config_version": "config_version = 0"}))
def node_registration_violations(spark, d):
    return registry.node_violations(v.node(spark, d))


@query("""SELECT mode, topology, CASE topology WHEN 'strong' THEN mode IN ('buffered', 'durable') WHEN 'isolated' THEN true ELSE mode <> 'durable' END AS allowed
FROM (VALUES ('best_effort'), ('buffered'), ('durable'), ('snapshot')) m(mode), (VALUES ('strong'), ('isolated'), ('best_effort')) t(topology)""")
def mode_topology_matrix(spark, d):
    m = spark.range(1).select(F.explode(F.array(*map(F.lit, registry.MODES))).alias("mode")).select("mode", F.explode(F.array(*map(F.lit, registry.TOPOLOGIES))).alias("topology"))
    return m.withColumn("allowed", registry.mode_allowed(F.col("mode"), F.col("topology")))


def _policy_options(spark):
    def each(values, name, kind="string"):
        return F.explode(F.array(*[F.lit(x).cast(kind) for x in values])).alias(name)

    o = spark.range(1).select(each(registry.MODES, "mode"))
    for values, name, kind in ((registry.TOPOLOGIES, "topology", "string"), ((None, "block", "drop_newest", "drop_oldest", "fail"), "full_policy", "string"), ((None, "accepted", "buffered", "durable"), "ack_level", "string"), ((None, "none", "interval"), "sync_policy", "string"), ((True, False), "state_topic", "boolean"), ((True, False), "complete", "boolean")):
        o = o.select("*", each(values, name, kind))
    return o


@query("""WITH o AS (SELECT * FROM (VALUES ('best_effort'), ('buffered'), ('durable'), ('snapshot')) m(mode), (VALUES ('strong'), ('isolated'), ('best_effort')) t(topology), (VALUES (NULL), ('block'), ('drop_newest'), ('drop_oldest'), ('fail')) a(full_policy),
  (VALUES (NULL), ('accepted'), ('buffered'), ('durable')) b(ack_level), (VALUES (NULL), ('none'), ('interval')) c(sync_policy), (VALUES (true), (false)) s(state_topic), (VALUES (true), (false)) z(complete)),
e AS (SELECT *, CASE mode WHEN 'best_effort' THEN 'accepted' WHEN 'buffered' THEN 'buffered' WHEN 'durable' THEN 'durable' END AS own_ack,
  coalesce(full_policy, CASE mode WHEN 'best_effort' THEN 'drop_newest' WHEN 'snapshot' THEN 'drop_oldest' ELSE 'block' END) AS ff,
  coalesce(sync_policy, CASE mode WHEN 'best_effort' THEN 'none' WHEN 'snapshot' THEN NULL ELSE 'interval' END) AS ss, complete OR mode = 'durable' OR topology = 'strong' AS cc FROM o),
x AS (SELECT *, CASE WHEN NOT (CASE topology WHEN 'strong' THEN mode IN ('buffered', 'durable') WHEN 'isolated' THEN true ELSE mode <> 'durable' END) THEN 'mode_topology'
  WHEN mode = 'snapshot' AND NOT state_topic THEN 'not_a_state_topic' WHEN mode = 'snapshot' AND ack_level IS NOT NULL THEN 'snapshot_ack' WHEN mode = 'snapshot' AND sync_policy IS NOT NULL THEN 'snapshot_sync'
  WHEN mode = 'snapshot' AND complete THEN 'snapshot_complete' WHEN mode <> 'snapshot' AND ack_level <> own_ack THEN 'ack_mismatch' WHEN complete AND mode = 'best_effort' THEN 'best_effort_complete'
  WHEN complete AND topology = 'best_effort' THEN 'topology_complete' WHEN mode = 'snapshot' AND ff <> 'drop_oldest' THEN 'snapshot_full_policy' WHEN cc AND ff NOT IN ('block', 'fail') THEN 'complete_drops'
  WHEN mode = 'durable' AND ss = 'none' THEN 'durable_sync' END AS error FROM e)
SELECT mode, topology, full_policy, ack_level, sync_policy, state_topic, complete, error, CASE WHEN error IS NULL THEN ff END AS effective_full, CASE WHEN error IS NULL THEN own_ack END AS effective_ack,
  CASE WHEN error IS NULL THEN ss END AS effective_sync, CASE WHEN error IS NULL THEN cc END AS effective_complete FROM x""")
def recording_policy_resolution(spark, d):
    return registry.resolved_policy(_policy_options(spark))


ROUTES = f"""WITH {v.PARTICIPANT_SQL}, t AS (SELECT DISTINCT topic_id, topic_id % 2 AS route_policy FROM participant),
static AS (SELECT topic_id, (topic_id * 3 + s * 11) % 100 + 1 AS node_id FROM t, (VALUES (0), (1), (2)) v(s)),
route AS (SELECT topic_id, node_id, 'static' AS policy FROM t JOIN static USING (topic_id) WHERE route_policy = 1 UNION ALL
  SELECT DISTINCT topic_id, node_id, 'discovery' FROM t JOIN participant USING (topic_id) WHERE route_policy = 0 AND kind = 1)"""


def _routes(spark, d):
    p = v.participant(spark, d)
    t = p.select("topic_id").distinct().withColumn("route_policy", F.col("topic_id") % 2)
    static = t.select("topic_id", F.explode(F.array(L(0), L(1), L(2))).alias("s")).select("topic_id", ((F.col("topic_id") * 3 + F.col("s") * 11) % 100 + 1).alias("node_id"))
    return registry.routes(t, static, p.where("kind = 1"))


@query(f"{ROUTES}\nSELECT topic_id, node_id, policy FROM route")
def topic_routes(spark, d):
    return _routes(spark, d)


@query(f"{ROUTES}, {v.NODE_SQL}\nSELECT topic_id, r.node_id, CASE WHEN n.node_id IS NULL THEN 'unregistered' WHEN lease_deadline > 1200 AND liveness = 1 AND health <> 2 THEN 'usable' ELSE 'unavailable' END AS status FROM route r LEFT JOIN node n ON n.node_id = r.node_id")
def route_targets(spark, d):
    n = v.node(spark, d)
    n = n.select("node_id", registry.usable(n, 1200).alias("_ok"))
    return _routes(spark, d).join(n, "node_id", "left").select("topic_id", "node_id", F.when(F.col("_ok").isNull(), "unregistered").when(F.col("_ok"), "usable").otherwise("unavailable").alias("status"))


TARGETS = f"WITH {v.DRIVER_SQL}, target AS (SELECT s_suppkey AS target_id, s_suppkey % 3 AS endpoint_kind, s_suppkey % 2 AS reliability, s_suppkey % 40 * 100 AS payload FROM supplier)"


def _targets(spark, d):
    k = F.col("s_suppkey")
    return v.table(spark, d, "supplier").select(k.alias("target_id"), (k % 3).alias("endpoint_kind"), (k % 2).alias("want"), (k % 40 * 100).alias("payload"))


@query(f"{TARGETS}\nSELECT target_id, count(*) AS drivers, min(driver_id) AS first_driver FROM target JOIN driver ON kind = endpoint_kind WHERE is_running GROUP BY target_id")
def endpoint_driver_candidates(spark, d):
    # a target's drivers are those of its kind: counted by kind, not paired
    kinds = v.driver(spark, d).where("is_running").groupBy("kind").agg(F.count("*").alias("drivers"), F.min("driver_id").alias("first_driver"))
    return registry.candidates(_targets(spark, d), kinds.withColumn("is_running", F.lit(True))).select("target_id", "drivers", "first_driver")


@query(f"""{TARGETS},
r AS (SELECT target_id, driver_id, health, priority, row_number() OVER (PARTITION BY target_id ORDER BY health, priority DESC, driver_id) AS rn FROM target JOIN driver ON kind = endpoint_kind
  WHERE is_running AND health IN (0, 1) AND (reliability = 0 OR reliable) AND (max_frame = 0 OR payload <= max_frame))
SELECT target_id, driver_id, health, priority FROM r WHERE rn = 1""")
def best_drivers(spark, d):
    return registry.best_driver(_targets(spark, d), v.driver(spark, d), "target_id", F.col("want"), F.col("payload"))


@query(f"""WITH {v.NODE_SQL}
SELECT node_id, CASE WHEN lease_deadline > 1200 THEN 'active' WHEN liveness = 2 THEN 'removed' WHEN liveness = 1 THEN 'retained_alive' ELSE 'retained_unknown' END AS outcome, CASE WHEN lease_deadline <= 1200 THEN 2 ELSE health END AS health_after FROM node""")
def node_lease_sweep(spark, d):
    return registry.node_sweep(v.node(spark, d), 1200)


@query(f"WITH {v.PARTICIPANT_SQL}\nSELECT topic_id, string_agg(node_id::VARCHAR, ',' ORDER BY node_id) AS nodes, count(*) AS n FROM (SELECT DISTINCT topic_id, node_id FROM participant WHERE kind = 1) GROUP BY topic_id")
def subscriber_nodes(spark, d):
    return registry.subscriber_nodes(v.participant(spark, d).where("kind = 1"))


@query(f"""WITH {v.PARTICIPANT_SQL}, t AS (SELECT n::BIGINT AS topic_id FROM range(1, 80) r(n)),
c AS (SELECT topic_id, count(CASE WHEN kind = 0 THEN 1 END) AS publishers, count(CASE WHEN kind = 1 THEN 1 END) AS subscribers, count(CASE WHEN kind = 2 THEN 1 END) AS bridges, count(CASE WHEN kind = 3 THEN 1 END) AS recorders, count(CASE WHEN kind = 4 THEN 1 END) AS replay_pins FROM participant GROUP BY topic_id)
SELECT topic_id, coalesce(publishers, 0) AS publishers, coalesce(subscribers, 0) AS subscribers, coalesce(bridges, 0) AS bridges, coalesce(recorders, 0) AS recorders, coalesce(replay_pins, 0) AS replay_pins,
  coalesce(publishers + subscribers + bridges + recorders, 0) > 0 AS blocks_retire, coalesce(replay_pins, 0) > 0 AS blocks_delete FROM t LEFT JOIN c USING (topic_id)""")
def topic_usage(spark, d):
    return registry.usage(spark.range(1, 80).withColumnRenamed("id", "topic_id"), v.participant(spark, d))


@query("""SELECT key, moment, previous, state FROM (SELECT o_custkey AS key, o_orderkey AS moment, o_orderkey % 7 % 5 AS state, lag(o_orderkey % 7 % 5) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders)
WHERE previous <> state AND (previous, state) NOT IN ((0, 1), (1, 2), (2, 3), (3, 4))""")
def topic_lifecycle_breaks(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("moment"), (F.col("o_orderkey") % 7 % 5).alias("state"))
    return storage.bad_moves(o, registry.TOPIC_MOVES, ["key"], "moment").select("key", "moment", "previous", "state")


@query("""SELECT type, moment, version, previous FROM (SELECT o_custkey AS type, o_orderkey AS moment, o_orderkey % 97 AS version, lag(o_orderkey % 97) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE version <= previous""")
def registry_version_breaks(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("type"), F.col("o_orderkey").alias("moment"), (F.col("o_orderkey") % 97).alias("version"))
    return registry.version_breaks(o, "type", "moment", "version")


@query("SELECT o_custkey AS type, max(o_orderkey % 97) AS version, arg_max(o_orderkey, (o_orderkey % 97) * 1000000000 + o_orderkey) AS moment FROM orders GROUP BY o_custkey")
def latest_schema_versions(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("type"), F.col("o_orderkey").alias("moment"), (F.col("o_orderkey") % 97).alias("version"))
    return o.groupBy("type").agg(F.max(F.struct("version", "moment")).alias("m")).select("type", "m.version", "m.moment")


@query(f"{v.RECORDS}\nSELECT topic_id, count(*) AS accepted FROM record WHERE (topic_id, ingestion_sequence % 4) IN ((1, 0), (1, 2), (3, 1), (5, 3)) GROUP BY topic_id")
def accepted_schema_records(spark, d):
    r = v.record(spark, d).withColumn("schema_ref", F.col("ingestion_sequence") % 4)
    accepted = spark.range(1).select(F.explode(F.array(*[F.struct(L(a).alias("topic_id"), L(b).alias("schema_ref")) for a, b in ((1, 0), (1, 2), (3, 1), (5, 3))])).alias("x")).select("x.*")
    return r.join(F.broadcast(accepted), ["topic_id", "schema_ref"], "left_semi").groupBy("topic_id").agg(F.count("*").alias("accepted"))


@query("""SELECT o_orderkey AS id FROM orders WHERE o_custkey % 3 = 2 AND (o_orderkey % 500 = 0 OR o_orderkey % 500 > 400 OR 400 - o_orderkey % 500 >= 100)""")
def reservation_aborts(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 500).alias("reserved_at"), (F.col("o_custkey") % 3).alias("liveness"))
    return registry.reservation_aborts(o, 400, 100).select("id")


LEASES = """lease AS (SELECT c_custkey AS subscriber_id, c_custkey % 3 + 1 AS generation, c_custkey % 11 <> 0 AS active, c_custkey * 7 % 2000 AS heartbeat, c_custkey % 4 % 3 + 1 AS heartbeat_generation, c_custkey % 3 AS liveness FROM customer)"""
SWEPT = f"WITH {LEASES},\nswept AS (SELECT subscriber_id, generation, CASE WHEN heartbeat > 1500 OR 1500 - heartbeat < 600 THEN 'kept' WHEN liveness = 2 THEN 'evicted' ELSE 'held' END AS outcome FROM lease WHERE active)"


def _leases(spark, d):
    k = F.col("c_custkey")
    return v.table(spark, d, "customer").select(k.alias("subscriber_id"), (k % 3 + 1).alias("generation"), (k % 11 != 0).alias("active"), (k * 7 % 2000).alias("heartbeat"), (k % 4 % 3 + 1).alias("heartbeat_generation"), (k % 3).alias("liveness"))


@query(f"{SWEPT}\nSELECT * FROM swept")
def subscriber_lease_sweep(spark, d):
    return registry.subscriber_sweep(_leases(spark, d), 1500, 600)


@query(f"WITH {LEASES}\nSELECT subscriber_id, CASE WHEN heartbeat_generation = generation AND 1500 - heartbeat >= 600 THEN 'evicted' ELSE 'kept' END AS outcome FROM lease WHERE active")
def channel_heartbeat_sweep(spark, d):
    return registry.channel_sweep(_leases(spark, d), 1500, 600)


@query(f"{SWEPT}\nSELECT o_orderkey AS pin, o_custkey AS subscriber_id, o_orderkey % 3 + 1 AS generation FROM orders WHERE (o_custkey, o_orderkey % 3 + 1) NOT IN (SELECT (subscriber_id, generation) FROM swept WHERE outcome = 'evicted')")
def pins_of_the_living(spark, d):
    pins = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("pin"), F.col("o_custkey").alias("subscriber_id"), (F.col("o_orderkey") % 3 + 1).alias("generation"))
    return registry.pins_after(pins, registry.subscriber_sweep(_leases(spark, d), 1500, 600))


MEMBERS = f"""{v.RECORDS},
member AS (SELECT c_custkey % 5 + 1 AS topic_id, c_custkey AS subscriber_id, c_custkey * 13 % 700 + 1 AS joined_at, c_custkey * 13 % 700 + 1 + c_custkey % 900 AS left_at FROM customer),
message AS (SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY event_id) AS sequence, flags FROM record)"""


def _messages(spark, d):
    r = v.record(spark, d)
    return v.running(r, ["topic_id"], "event_id", {"sequence": ("sum", L(1), True)}).select("topic_id", "sequence", "flags")


def _members(spark, d):
    k = F.col("c_custkey")
    return v.table(spark, d, "customer").select((k % 5 + 1).alias("topic_id"), k.alias("subscriber_id"), (k * 13 % 700 + 1).alias("joined_at"), (k * 13 % 700 + 1 + k % 900).alias("left_at"))


@query(f"{MEMBERS}\nSELECT b.topic_id, subscriber_id, count(m.sequence) AS delivered FROM member b LEFT JOIN message m ON m.topic_id = b.topic_id AND m.sequence >= joined_at AND m.sequence < left_at AND m.flags & 2 = 0 GROUP BY ALL")
def fanout_deliveries(spark, d):
    return registry.delivered(_messages(spark, d), _members(spark, d))


@query(f"WITH {v.PARTICIPANT_SQL}, s AS (SELECT topic_id, participant_id * 31 % 50 AS cursor FROM participant WHERE kind = 1 AND generation <> 3)\nSELECT topic_id, min(cursor) AS least, count(CASE WHEN cursor = m THEN 1 END) AS tied FROM (SELECT *, min(cursor) OVER (PARTITION BY topic_id) AS m FROM s) GROUP BY topic_id")
def least_cursors(spark, d):
    p = v.participant(spark, d).where("kind = 1").select("topic_id", (F.col("participant_id") * 31 % 50).alias("cursor"), (F.col("generation") != 3).alias("active"))
    return registry.least_cursor(p)


@query("SELECT o_custkey AS subscriber_id, o_orderkey % 2 AS generation, count(*) AS events, count(*) AS messages, max(o_orderkey) AS last_first, max(o_orderkey) + 1 AS last_end FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL")
def broadcast_drop_gaps(spark, d):
    o = v.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("subscriber_id"), (F.col("o_orderkey") % 2).alias("generation"), F.col("o_orderkey").alias("sequence"))
    return registry.drop_gaps(o)


@query("""SELECT key, sum(CASE WHEN state >= 2 THEN coalesce(nxt, 1000000000) - moment ELSE 0 END)::BIGINT AS degraded, count(CASE WHEN state >= 2 THEN 1 END) AS episodes FROM (SELECT o_custkey AS key, o_orderkey AS moment, o_orderkey % 4 AS state, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) GROUP BY key""")
def degraded_durations(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("moment"), (F.col("o_orderkey") % 4).alias("state"))
    return registry.impaired_time(o, "key", "moment", F.col("state") >= 2, 1_000_000_000)


@query(f"{MEMBERS}\nSELECT topic_id, sequence % 3 AS consumer, count(*) AS messages FROM message GROUP BY ALL")
def work_queue_assignment(spark, d):
    return registry.assigned(_messages(spark, d), 3).groupBy("topic_id", "consumer").agg(F.count("*").alias("messages"))


@query("""SELECT CASE WHEN NOT occupied THEN CASE WHEN state = 0 THEN 'free' ELSE 'inconsistent' END WHEN magic <> 7 THEN 'corrupt' WHEN state = 3 THEN CASE WHEN crc_ok AND size <= capacity THEN 'ok' ELSE 'corrupt' END WHEN state BETWEEN 0 AND 4 THEN 'orphan' ELSE 'corrupt' END AS finding, count(*) AS slots
FROM (SELECT l_partkey % 3 > 0 AS occupied, l_suppkey % 6 AS state, CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 7 END AS magic, l_linenumber <> 2 AS crc_ok, l_partkey % 70 AS size, 64 AS capacity FROM lineitem) GROUP BY ALL""")
def slab_consistency(spark, d):
    li = v.table(spark, d, "lineitem").select((F.col("l_partkey") % 3 > 0).alias("occupied"), (F.col("l_suppkey") % 6).alias("state"), F.when(F.col("l_orderkey") % 11 == 0, 1).otherwise(7).alias("magic"), (F.col("l_linenumber") != 2).alias("crc_ok"), (F.col("l_partkey") % 70).alias("size"), F.lit(64).alias("capacity"))
    return registry.slab_counts(li, 7)


EDGES = "edges AS (SELECT p_partkey AS type, p_partkey // 2 AS dependency FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2 AND p_partkey % 5 = 0)"


@query(f"WITH RECURSIVE {EDGES}, c AS (SELECT type, dependency FROM edges UNION SELECT c.type, e.dependency FROM c JOIN edges e ON e.type = c.dependency) SELECT DISTINCT type, dependency FROM c")
def dependency_closure(spark, d):
    p = v.table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    edges = p.where("k > 0").selectExpr("k as type", "k div 2 as dependency").union(p.where("k > 2 and k % 5 = 0").selectExpr("k", "k div 3"))
    return registry.closure(edges, scratch(spark, "closure"))


FIELDS = """old AS (SELECT s_suppkey AS key, f::BIGINT AS field_id, CASE WHEN (s_suppkey + f) % 9 = 0 THEN 'int64' ELSE 'string' END AS type, CASE WHEN f % 3 = 0 THEN 'required' ELSE 'optional' END AS cardinality, NULL::VARCHAR AS "default", CASE WHEN f % 2 = 0 THEN 64 END::BIGINT AS max_bytes, (s_suppkey + f) % 4 > 0 AS reserved_after FROM supplier, range(1, 7) r(f) WHERE (s_suppkey * f) % 5 <> 1),
new AS (SELECT s_suppkey AS key, f::BIGINT AS field_id, CASE WHEN (s_suppkey + f) % 9 = 0 AND s_suppkey % 10 = 0 THEN 'int32' WHEN (s_suppkey + f) % 9 = 0 THEN 'int64' ELSE 'string' END AS type, CASE WHEN f % 3 = 0 THEN 'required' ELSE 'optional' END AS cardinality, NULL::VARCHAR AS "default", CASE WHEN f % 2 = 0 THEN 64 + s_suppkey % 3 * 8 - 8 END::BIGINT AS max_bytes, (s_suppkey + f) % 7 = 0 AS reserved_before FROM supplier, range(1, 7) r(f) WHERE (s_suppkey * f) % 5 <> 2),
dir AS (SELECT coalesce(o.key, n.key) AS key, coalesce(o.field_id, n.field_id) AS field_id, CASE WHEN o.key IS NULL THEN CASE WHEN n.cardinality = 'optional' AND NOT reserved_before THEN 'neutral' ELSE 'incompatible' END WHEN n.key IS NULL THEN CASE WHEN o.cardinality = 'optional' AND reserved_after THEN 'neutral' ELSE 'incompatible' END
  WHEN o.type <> n.type THEN 'incompatible' WHEN o.max_bytes IS NOT DISTINCT FROM n.max_bytes THEN 'neutral' WHEN o.max_bytes IS NULL THEN 'write' WHEN n.max_bytes IS NULL THEN 'read' WHEN n.max_bytes < o.max_bytes THEN 'write' ELSE 'read' END AS direction
  FROM old o FULL JOIN new n ON o.key = n.key AND o.field_id = n.field_id)"""


def _directions(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.explode(F.sequence(L(1), L(6))).alias("field_id"))
    k, n = F.col("key"), F.col("field_id")
    nine = (k + n) % 9 == 0
    card, none = F.when(n % 3 == 0, "required").otherwise("optional").alias("cardinality"), F.lit(None).cast("string").alias("default")
    old = s.where(k * n % 5 != 1).select("key", "field_id", F.when(nine, "int64").otherwise("string").alias("type"), card, none, F.when(n % 2 == 0, L(64)).alias("max_bytes"), ((k + n) % 4 > 0).alias("reserved_after"))
    new = s.where(k * n % 5 != 2).select("key", "field_id", F.when(nine & (k % 10 == 0), "int32").when(nine, "int64").otherwise("string").alias("type"), card, none, F.when(n % 2 == 0, 64 + k % 3 * 8 - 8).alias("max_bytes"), ((k + n) % 7 == 0).alias("reserved_before"))
    return registry.field_directions(old, new)


@query(f"WITH {FIELDS}\nSELECT key, field_id, direction FROM dir")
def schema_field_directions(spark, d):
    return _directions(spark, d)


@query(f"""WITH {FIELDS}
SELECT key, CASE WHEN bool_or(direction = 'incompatible') OR (bool_or(direction = 'read') AND bool_or(direction = 'write')) THEN 'incompatible' WHEN bool_or(direction = 'read') THEN 'read' WHEN bool_or(direction = 'write') THEN 'write' ELSE 'wire' END AS compatibility FROM dir GROUP BY key""")
def schema_compatibility(spark, d):
    return registry.compatibility(_directions(spark, d))


# delivery -----------------------------------------------------------------------------------

STAGE_SQL = "CASE WHEN {required} = 'local_published' THEN true WHEN {kind} = 'node' THEN {required} = 'remote_accepted' AND {reached} = 'remote_accepted' ELSE coalesce(list_position(['recorder_buffered', 'storage_written', 'storage_durable'], {reached}) >= list_position(['recorder_buffered', 'storage_written', 'storage_durable'], {required}), false) END"
STAGE_VALUES = "(VALUES ('local_published'), ('remote_accepted'), ('recorder_buffered'), ('storage_written'), ('storage_durable'))"


@query(f"SELECT kind, reached, required, {STAGE_SQL.format(kind='kind', reached='reached', required='required')} AS satisfied FROM (VALUES ('node'), ('recorder')) k(kind), {STAGE_VALUES} a(reached), {STAGE_VALUES} b(required)")
def stage_matrix(spark, d):
    m = spark.range(1).select(F.explode(F.array(F.lit("node"), F.lit("recorder"))).alias("kind"))
    for name in ("reached", "required"):
        m = m.select("*", F.explode(F.array(*map(F.lit, delivery.STAGES))).alias(name))
    return m.withColumn("satisfied", delivery.stage_satisfied(F.col("kind"), F.col("reached"), F.col("required")))


RECEIPTS = """receipt AS (SELECT o_orderkey AS receipt_id, CASE o_orderkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'any' ELSE 'quorum' END AS policy, 2::BIGINT AS quorum, ['local_published', 'remote_accepted', 'recorder_buffered', 'storage_written', 'storage_durable'][(o_custkey % 5 + 1)::INTEGER] AS stage FROM orders),
target AS (SELECT l_orderkey AS receipt_id, CASE WHEN l_linenumber % 3 = 0 THEN 'node' ELSE 'recorder' END AS target_kind, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE ['local_published', 'remote_accepted', 'recorder_buffered', 'storage_written', 'storage_durable'][(l_suppkey % 5 + 1)::INTEGER] END AS reached, l_partkey % 7 <> 0 AS ok FROM lineitem)"""


def _stage(k):
    return F.element_at(F.array(*map(F.lit, delivery.STAGES)), (k % 5 + 1).cast("int"))


@query(f"""WITH {RECEIPTS},
c AS (SELECT r.receipt_id, policy, quorum, count(target_kind) AS targets, count(CASE WHEN reached IS NOT NULL AND ok AND {STAGE_SQL.format(kind='target_kind', reached='reached', required='stage')} THEN 1 END) AS successes, count(CASE WHEN target_kind IS NOT NULL AND reached IS NULL THEN 1 END) AS pending FROM receipt r LEFT JOIN target t ON t.receipt_id = r.receipt_id GROUP BY ALL),
q AS (SELECT *, (CASE policy WHEN 'all' THEN targets WHEN 'any' THEN least(targets, 1) ELSE quorum END)::BIGINT AS required FROM c)
SELECT receipt_id, required, successes, pending, CASE WHEN successes >= required THEN 'complete' WHEN successes + pending < required THEN 'failed' ELSE 'outstanding' END AS state FROM q""")
def delivery_completion(spark, d):
    o, li = v.table(spark, d, "orders"), v.table(spark, d, "lineitem")
    policy = F.when(F.col("o_orderkey") % 3 == 0, "all").when(F.col("o_orderkey") % 3 == 1, "any").otherwise("quorum")
    receipts = o.select(F.col("o_orderkey").alias("receipt_id"), policy.alias("policy"), L(2).alias("quorum"), _stage(F.col("o_custkey")).alias("stage"))
    targets = li.select(F.col("l_orderkey").alias("receipt_id"), F.when(F.col("l_linenumber") % 3 == 0, "node").otherwise("recorder").alias("target_kind"), F.when(F.col("l_partkey") % 4 != 0, _stage(F.col("l_suppkey"))).alias("reached"), (F.col("l_partkey") % 7 != 0).alias("ok"))
    return delivery.completion(receipts, targets)


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 <> 0 THEN 'published' ELSE 'failed' END AS status, CASE WHEN o_custkey % 5 = 0 THEN 'skipped' WHEN o_custkey % 3 <> 0 THEN 'dispatched' ELSE 'degraded' END AS bridge_status FROM orders""")
def publish_results(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5 != 0).alias("local_ok"), (F.col("o_custkey") % 3 != 0).alias("bridge_ok"))
    return delivery.publish_results(o).select("id", "status", "bridge_status")


@query("SELECT o_orderkey AS id FROM orders WHERE 1000 - o_orderkey % 900 >= 300")
def expired_frames(spark, d):
    return delivery.expired(v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 900).alias("enqueued_at")), 1000, 300).select("id")


@query("""WITH x AS (SELECT l_orderkey AS message_id, l_linenumber - 1 AS i, l_partkey || ':' AS bytes FROM lineitem),
o AS (SELECT message_id, i, count(DISTINCT bytes) AS v, min(bytes) AS bytes FROM x GROUP BY ALL),
g AS (SELECT message_id, max(v) AS v, count(*) AS have, max(i) AS i1, string_agg(bytes, '' ORDER BY i) AS payload FROM o GROUP BY message_id)
SELECT message_id, CASE WHEN v > 1 OR i1 >= message_id % 5 + 1 OR message_id % 13 = 5 AND have > 1 THEN 'rejected' WHEN have < message_id % 5 + 1 THEN 'incomplete' WHEN message_id % 11 = 3 THEN 'corrupt' ELSE 'complete' END AS status,
  CASE WHEN v = 1 AND i1 < message_id % 5 + 1 AND NOT (message_id % 13 = 5 AND have > 1) AND have >= message_id % 5 + 1 AND message_id % 11 <> 3 THEN payload END AS payload FROM g""")
def fragment_reassembly(spark, d):
    li = v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("message_id"), (F.col("l_linenumber") - 1).alias("index"), F.concat(F.col("l_partkey"), F.lit(":")).cast("binary").alias("bytes"))
    sums = li.groupBy("message_id", "index").agg(F.min("bytes").alias("bytes"))
    sums = sums.groupBy("message_id").agg(F.crc32(delivery.joined(F.array_sort(F.collect_list(F.struct("index", "bytes"))))).alias("crc"))
    # every eleventh message arrives with another checksum, and of every thirteenth the fragments disagree on it
    wrong = F.when(F.col("message_id") % 11 == 3, 1).otherwise(0) + F.when((F.col("message_id") % 13 == 5) & (F.col("index") > 0), F.col("index")).otherwise(0)
    frames = li.join(sums, "message_id").select(F.lit(1).alias("connection"), F.lit(1).alias("peer"), "message_id", "index", "bytes", (F.col("message_id") % 5 + 1).alias("count"), F.col("crc").bitwiseXOR(wrong).alias("crc"))
    return delivery.reassembled(frames).select("message_id", "status", F.col("payload").cast("string").alias("payload"))


# capacity -----------------------------------------------------------------------------------

STATE = "state AS (SELECT s_suppkey AS node_id, i::INTEGER AS ordinal, n AS dimension, 1000::BIGINT + i * 100 AS \"limit\", 100::BIGINT AS reserve, (s_suppkey * 17 + i * 31) % 900 AS committed, (s_suppkey * 5 + i) % 200 AS pending FROM supplier, (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(capacity.DIMENSIONS)) + ") d(i, n))"


def _state(spark, d):
    dims = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("dimension")) for i, n in enumerate(capacity.DIMENSIONS)])
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.explode(dims).alias("x")).select("node_id", "x.*")
    k, i = F.col("node_id"), F.col("ordinal")
    return s.select("*", (L(1000) + i * 100).alias("limit"), L(100).alias("reserve"), ((k * 17 + i * 31) % 900).alias("committed"), ((k * 5 + i) % 200).alias("pending"))


@query(f'WITH {STATE}\nSELECT node_id, dimension, greatest(0, "limit" - reserve - committed - pending) AS data_plane, greatest(0, "limit" - committed - pending) AS control_plane FROM state')
def capacity_headroom(spark, d):
    return capacity.headroom(_state(spark, d)).select("node_id", "dimension", "data_plane", "control_plane")


REQUESTS = f"""WITH {STATE},
request AS (SELECT o_orderkey AS request_id, o_custkey % (SELECT count(*) FROM supplier) AS node_id, CASE WHEN o_orderkey % 3 = 0 THEN 'control' ELSE 'data' END AS plane, i::INTEGER AS ordinal, n AS dimension, CASE WHEN (o_orderkey + i) % 3 = 0 THEN 0 ELSE (o_orderkey * 7 + i * 13) % 400 END AS requested
  FROM orders, (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(capacity.DIMENSIONS))}) d(i, n))"""


def _requests(spark, d):
    nodes = v.table(spark, d, "supplier").agg(F.count("*").alias("_n"))
    dims = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("dimension")) for i, n in enumerate(capacity.DIMENSIONS)])
    o = v.table(spark, d, "orders").join(F.broadcast(nodes)).select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % F.col("_n")).alias("node_id"), F.when(F.col("o_orderkey") % 3 == 0, "control").otherwise("data").alias("plane"), F.explode(dims).alias("x")).select("request_id", "node_id", "plane", "x.*")
    return o.withColumn("requested", F.when((F.col("request_id") + F.col("ordinal")) % 3 == 0, 0).otherwise((F.col("request_id") * 7 + F.col("ordinal") * 13) % 400))


@query(f"""{REQUESTS},
j AS (SELECT request_id, r.ordinal, r.dimension, requested, greatest(0, "limit" - CASE WHEN plane = 'data' THEN reserve ELSE 0 END - committed - pending) AS available FROM request r JOIN state s ON s.node_id = r.node_id AND s.dimension = r.dimension),
x AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ordinal) AS rn FROM j WHERE requested > 0 AND requested > available)
SELECT q.request_id, x.request_id IS NULL AS admitted, x.dimension, x.requested, x.available FROM (SELECT DISTINCT request_id FROM j) q LEFT JOIN x ON x.request_id = q.request_id AND rn = 1""")
def capacity_admissions(spark, d):
    return capacity.admissions(_requests(spark, d), _state(spark, d))


@query(f"{REQUESTS}\nSELECT node_id, dimension, sum(requested)::BIGINT AS requested FROM request GROUP BY ALL")
def capacity_sums(spark, d):
    return capacity.summed(_requests(spark, d), ["node_id"]).select("node_id", "dimension", "requested")


@query(f"""WITH {STATE}\nSELECT node_id, '{{' || string_agg('"' || dimension || '":' || "limit", ',' ORDER BY ordinal) || '}}' AS json FROM state GROUP BY node_id""")
def capacity_json(spark, d):
    return capacity.rendered(_state(spark, d))


@query("""WITH s AS (SELECT l_partkey AS topic_id, sum(l_suppkey % 50 + 1)::BIGINT AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL)
SELECT p_partkey AS topic_id, CASE WHEN p_partkey % 6 > 0 THEN CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE p_partkey % 6 * p_size * 4096 END END::BIGINT AS recorder_buffer_bytes, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 6 * 2 + 1 END AS file_descriptors,
  CASE WHEN p_partkey % 6 > 0 THEN coalesce(n, 0) END AS schema_buffer_bytes, CASE WHEN p_partkey % 6 = 0 THEN 'no partition' END AS error FROM part LEFT JOIN s ON topic_id = p_partkey""")
def capacity_estimate(spark, d):
    k = F.col("p_partkey")
    topics = v.table(spark, d, "part").select(k.alias("topic_id"), (k % 6).alias("partition_count"), F.element_at(F.array(*map(F.lit, registry.MODES)), (k % 4 + 1).cast("int")).alias("mode"), (F.col("p_size").cast("long") * 4096).alias("buffer_limit"))
    artifacts = v.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("topic_id"), (F.col("l_suppkey") % 50 + 1).alias("size"))
    return capacity.recorder_estimate(topics, artifacts)


# scalars ------------------------------------------------------------------------------------


@query("""SELECT id, u AS zig, n AS back, greatest(1, (length(bin(u)) + 6) // 7)::INTEGER AS varint FROM (SELECT l_orderkey * 10 + l_linenumber AS id, (l_partkey * 100003 - l_suppkey * 9973) * CASE WHEN l_orderkey % 2 = 0 THEN 1 ELSE -1 END AS n FROM lineitem) x, LATERAL (SELECT CASE WHEN n >= 0 THEN 2 * n ELSE -2 * n - 1 END AS u)
""")
def zigzag_varint(spark, d):
    n = (F.col("l_partkey") * 100003 - F.col("l_suppkey") * 9973) * F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(-1)
    li = v.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), n.alias("n")).withColumn("zig", f.zigzag(F.col("n")))
    return li.select("id", "zig", f.unzigzag(F.col("zig")).alias("back"), f.varint_length(F.col("zig")).alias("varint"))


@query("""SELECT p_partkey, sha256(p_name) AS digest, (('0x' || substr(sha256(p_name), 1, 2))::HUGEINT * 1::HUGEINT + ('0x' || substr(sha256(p_name), 3, 2))::HUGEINT * 256::HUGEINT + ('0x' || substr(sha256(p_name), 5, 2))::HUGEINT * 65536::HUGEINT + ('0x' || substr(sha256(p_name), 7, 2))::HUGEINT * 16777216::HUGEINT + ('0x' || substr(sha256(p_name), 9, 2))::HUGEINT * 4294967296::HUGEINT + ('0x' || substr(sha256(p_name), 11, 2))::HUGEINT * 1099511627776::HUGEINT + ('0x' || substr(sha256(p_name), 13, 2))::HUGEINT * 281474976710656::HUGEINT + ('0x' || substr(sha256(p_name), 15, 2))::HUGEINT * 72057594037927936::HUGEINT)::DECIMAL(20, 0) AS short_id FROM part""")
def schema_digests(spark, d):
    return v.table(spark, d, "part").select("p_partkey", f.digest_hex(F.col("p_name").cast("binary")).alias("digest")).withColumn("short_id", f.short_id(F.col("digest")))


@query("""SELECT c_custkey, ((c_custkey % 300) << 16) | (c_custkey % 7) AS packed, c_custkey % 300 AS major, c_custkey % 7 AS minor, least(500 * 2::BIGINT ** (c_custkey % 12), 30000)::BIGINT AS delay FROM customer""")
def versions_and_backoff(spark, d):
    k = F.col("c_custkey")
    c = v.table(spark, d, "customer").select(k, f.parse_version(F.concat_ws(".", k % 300, k % 7)).alias("packed"))
    return c.select("c_custkey", "packed", f.version_major(F.col("packed")).alias("major"), f.version_minor(F.col("packed")).alias("minor"), f.backoff_delay(500, 30000, k % 12 + 1).alias("delay"))


@query("""SELECT c_custkey, least(18446744073709551615::HUGEINT, 18446744073709550000::HUGEINT + c_custkey * 3)::DECIMAL(20, 0) AS added, least(18446744073709551615::HUGEINT, (c_custkey * 100000000000000)::HUGEINT * 1000)::DECIMAL(20, 0) AS multiplied FROM customer""")
def saturating_arithmetic(spark, d):
    k = F.col("c_custkey")
    return v.table(spark, d, "customer").select(k, f.saturating_add(F.lit("18446744073709550000").cast("decimal(20,0)"), k * 3).alias("added"), f.saturating_multiply(f.saturating_multiply(k, F.lit(100000000000000)), F.lit(1000)).alias("multiplied"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, json_extract(props, '$.k') IS NOT NULL AS has_k, [json_extract(props, '$.k')::BIGINT, event_id % 5][(event_id % 2 + 1)::INTEGER] AS element FROM events")
def dynamic_fields(spark, d):
    e = v.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("m"))
    return e.select("event_id", F.col("m").getField("k").alias("k"), F.col("m.k").isNotNull().alias("has_k"), F.element_at(F.array(F.col("m.k"), F.col("event_id") % 5), (F.col("event_id") % 2 + 1).cast("int")).alias("element"))


@query("SELECT event_id, e::BIGINT AS element FROM (SELECT event_id, unnest([event_id % 3, event_id % 5, event_id % 7]) AS e FROM events)")
def vector_elements(spark, d):
    e = F.col("event_id")
    return v.table(spark, d, "events").select("event_id", F.explode(F.array(e % 3, e % 5, e % 7)).alias("element"))


# as-of, resume, eviction --------------------------------------------------------------------


@query("""WITH a AS (SELECT o_custkey AS connection, o_orderkey AS moment, o_orderkey % 9 AS version FROM orders WHERE o_orderkey % 4 = 0), q AS (SELECT o_custkey AS connection, o_orderkey AS moment FROM orders WHERE o_orderkey % 4 <> 0)
SELECT q.connection, q.moment, a.version FROM q ASOF LEFT JOIN a ON q.connection = a.connection AND q.moment >= a.moment""")
def announced_schema_asof(spark, d):
    o = v.table(spark, d, "orders").select(F.col("o_custkey").alias("connection"), F.col("o_orderkey").alias("moment"))
    announced = F.when(F.col("moment") % 4 == 0, F.struct("moment", (F.col("moment") % 9).alias("version")))
    seen = v.running(o, ["connection"], "moment", {"_a": ("max", announced, True)})
    return seen.where("moment % 4 <> 0").select("connection", "moment", F.col("_a.version").alias("version"))


@query(f"{v.RECORDS}\nSELECT node_id, publisher_id, publisher_epoch, max(source_sequence) AS last, row_number() OVER (PARTITION BY node_id ORDER BY publisher_id, publisher_epoch) AS place FROM record GROUP BY node_id, publisher_id, publisher_epoch")
def resume_entries(spark, d):
    last = v.record(spark, d).groupBy("node_id", "publisher_id", "publisher_epoch").agg(F.max("source_sequence").alias("last"))
    w = F.row_number().over(replay.Window.partitionBy("node_id").orderBy("publisher_id", "publisher_epoch"))
    return last.withColumn("place", w.cast("bigint"))


@query(f"{v.RECORDS}\nSELECT node_id, arg_min(publisher_id, last * 1000000 + publisher_id) AS victim FROM (SELECT node_id, publisher_id, max(event_id) AS last FROM record GROUP BY ALL) GROUP BY node_id")
def least_recent_sources(spark, d):
    last = v.record(spark, d).groupBy("node_id", "publisher_id").agg(F.max("event_id").alias("last"))
    return last.groupBy("node_id").agg(F.min_by("publisher_id", F.struct("last", "publisher_id")).alias("victim"))


@query(f"{v.ARRIVALS}\nSELECT publisher_id % 8 AS session, count(*) AS frames, sum(payload_size)::BIGINT AS bytes, count(CASE WHEN flags & 2 <> 0 THEN 1 END) AS tombstones, min(arrival) AS first, max(arrival) AS last FROM arrival GROUP BY ALL")
def session_traffic(spark, d):
    a = v.arrival(v.record(spark, d))
    return a.groupBy((F.col("publisher_id") % 8).alias("session")).agg(F.count("*").alias("frames"), F.sum("payload_size").alias("bytes"), F.count_if(F.col("flags").bitwiseAND(2) != 0).alias("tombstones"), F.min("arrival").alias("first"), F.max("arrival").alias("last"))
