"""Stateful simulations as queries: one state machine for each key, fed in order, in bounded memory."""

from __future__ import annotations

import zlib
from collections import deque

from pyspark.sql import functions as F

from streamloom import views as v
from streamloom.catalog import CHECKED, query
from streamloom.operators import capacity
from streamloom.plans import simulate
from streamloom.plans.machines import machines


@query()
def bounded_queue_policies(spark, d):
    """What becomes of every message under each full policy; every third event takes one out."""
    e = v.record(spark, d).select("topic_id", "event_id", F.when(F.col("event_id") % 3 == 0, "dequeue").otherwise("enqueue").alias("kind"))
    e = e.select("*", F.explode(F.array(*map(F.lit, simulate.POLICIES))).alias("policy"))

    def start():
        box: list = []
        machine = None

        def feed(r):
            nonlocal machine
            if machine is None:
                def events():
                    while True:
                        yield box.pop()

                machine = simulate.bounded_queue(events(), 16, r["policy"], 4)
            box.append((r["kind"], r["event_id"]))
            item, outcome, retired = next(machine)
            return [(r["topic_id"], r["policy"], item, outcome, -1 if retired is None else retired)]

        return feed

    return machines(e, ["topic_id", "policy"], "event_id", start, "topic_id long, policy string, event_id long, outcome string, retired long")


@query()
def buffer_pool_admission(spark, d):
    """Reservations in a byte-budgeted pool for each node, dropping the oldest, and its pressure after each."""
    r = v.record(spark, d).select("node_id", "event_id", "topic_id", (F.col("event_id") * 7919 % 200_000).alias("size"))

    def start():
        pool = simulate.BufferPool(global_limit=2 << 20, topic_limit=1 << 20, slots=64)

        def feed(x):
            outcome, evicted = pool.reserve(x["event_id"], x["topic_id"], x["size"], "drop_oldest")
            if x["event_id"] % 5 == 0:
                pool.dequeue()
            return [(x["node_id"], x["event_id"], outcome, len(evicted), pool.used, pool.pressure())]

        return feed

    return machines(r, ["node_id"], "event_id", start, "node_id long, event_id long, outcome string, evicted int, used long, pressure string")


@query()
def receiver_dedup(spark, d):
    """A receiver's decision on every arrival, for each node's session."""
    a = v.arrival(v.record(spark, d)).select("node_id", "topic_id", "publisher_id", "source_sequence", "arrival", "ingestion_ts_ns")

    def start():
        window = simulate.DedupWindow(distance=64, max_sources=40, max_age=3_600_000_000_000)

        def feed(x):
            decision, highest = window.offer(1, (x["topic_id"], x["publisher_id"]), x["source_sequence"], x["ingestion_ts_ns"])
            return [(x["node_id"], x["arrival"], decision, -1 if highest is None else highest)]

        return feed

    return machines(a, ["node_id"], "arrival", start, "node_id long, arrival long, decision string, highest long")


@query()
def recording_admission(spark, d):
    """Admission under the three topologies while the recorder comes and goes."""
    r = v.record(spark, d).select("topic_id", "event_id", F.when(F.col("event_id") % 37 == 0, "degraded").when(F.col("event_id") % 41 == 0, "ready").otherwise("").alias("state"), (F.col("event_id") % 11 == 0).alias("is_full"))
    r = r.select("*", F.explode(F.array(*map(F.lit, ("strong", "isolated", "best_effort")))).alias("topology"))

    def start():
        box: list = []
        machine, cursor = None, 0

        def feed(x):
            nonlocal machine, cursor
            if machine is None:
                def events():
                    while True:
                        yield box.pop()

                machine = simulate.admission(events(), x["topology"])
            cursor += 2 if x["event_id"] % 13 == 0 and x["topology"] != "strong" else 0
            box.append((cursor, x["state"], x["is_full"]))
            out = next(machine)
            cursor = max(cursor, out["cursor"])
            first, last = out["gap"] or (-1, -1)
            return [(x["topic_id"], x["topology"], x["event_id"], out["outcome"], out["reason"], out["cursor"], first, last)]

        return feed

    return machines(r, ["topic_id", "topology"], "event_id", start, "topic_id long, topology string, event_id long, outcome string, reason string, cursor long, gap_first long, gap_last long")


@query()
def capacity_reservations(spark, d):
    """A sequence of reservations, commits and releases on every node."""
    o = v.table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("node_id"), F.col("o_orderkey").alias("request_id"))
    o = o.select("*", F.explode(F.array(F.struct((F.col("request_id") * 10).alias("at"), F.lit("reserve").alias("kind")), F.struct((F.col("request_id") * 10 + 1501).alias("at"), F.lit("settle").alias("kind")), F.struct((F.col("request_id") * 10 + 90_002).alias("at"), F.lit("release").alias("kind")))).alias("s")).select("node_id", "request_id", "s.*")

    def start():
        box: list = []

        def events():
            while True:
                yield box.pop()

        order = capacity.DIMENSIONS
        machine = simulate.reservations(events(), dict.fromkeys(order, 1000), dict.fromkeys(order, 100), order)

        def feed(x):
            n, kind = x["request_id"], x["kind"]
            kind = ("reserve_control" if n % 4 == 0 else "reserve_data") if kind == "reserve" else ("rollback" if n % 5 == 0 else "commit") if kind == "settle" else kind
            box.append((kind, n, {order[n % len(order)]: n % 400, order[n % 3]: n % 90}))
            request, outcome, dimension = next(machine)
            return [(x["node_id"], x["at"], request, kind, outcome, dimension or "")]

        return feed

    return machines(o, ["node_id"], "at", start, "node_id long, at long, request_id long, kind string, outcome string, dimension string")


@query()
def rotation_by_size_and_time(spark, d):
    """The segment of every record when bytes, records and time all close one."""
    r = v.record(spark, d).select("topic_id", "partition_id", "event_id", "payload_size", "ingestion_ts_ns")

    def start():
        box: list = []

        def records():
            while True:
                yield box.pop()

        machine = simulate.rotation(records(), 2000, 100, 3_600_000_000_000)

        def feed(x):
            box.append((x["payload_size"], x["ingestion_ts_ns"]))
            segment, place = next(machine)
            return [(x["topic_id"], x["partition_id"], x["event_id"], segment, place)]

        return feed

    return machines(r, ["topic_id", "partition_id"], "event_id", start, "topic_id long, partition_id long, event_id long, segment long, place long")


@query()
def schema_negotiation(spark, d):
    """What becomes of the frames of every connection while schemas are announced late."""
    r = v.record(spark, d).select("node_id", "event_id", "payload_size", (F.col("event_id") % 23).alias("ref"), (F.col("event_id") % 17 == 0).alias("announces"))

    def start():
        n = simulate.Negotiator(max_frames=200, max_bytes=1 << 20, per_second=4)

        def feed(x):
            out = n.announce(x["ref"]) if x["announces"] else n.frame(x["event_id"], x["ref"], x["payload_size"], x["event_id"] // 50)
            return [(x["node_id"], item, outcome) for item, outcome in out]

        return feed

    return machines(r, ["node_id"], "event_id", start, "node_id long, event_id long, outcome string")


@query()
def bridge_pump(spark, d):
    """What a bridge does with every arrival: publishes and acknowledges, acknowledges again, or refuses."""
    found = receiver_dedup(spark, d)
    action = F.when(F.col("decision") == "accept", "publish_ack").when(F.col("decision") == "duplicate", "ack").otherwise("nack")
    return found.select("node_id", "arrival", action.alias("action"), "highest")


@query(f"""{CHECKED},
kept AS (SELECT *, source_sequence > last_sequence + 1 AS has_gap FROM (SELECT *, max(source_sequence) OVER (PARTITION BY topic_id, partition_id, node_id, publisher_id, publisher_epoch ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_sequence FROM arrival) WHERE NOT coalesce(source_sequence <= last_sequence, false)),
numbered AS (SELECT *, sum(CASE WHEN has_gap THEN 2 ELSE 1 END) OVER (PARTITION BY topic_id, partition_id ORDER BY arrival)::BIGINT AS n FROM kept)
SELECT topic_id, partition_id, publisher_id, n AS assigned_sequence, source_sequence AS first_sequence, source_sequence AS last_sequence, false AS gap FROM numbered
UNION ALL SELECT topic_id, partition_id, publisher_id, n - 1, last_sequence + 1, source_sequence - 1, true FROM numbered WHERE has_gap""")
def writer_pump(spark, d):
    """Rows that a writer appends, in one pass over the arrivals of each partition, as a stream would see them."""
    a = v.arrival(v.record(spark, d)).select("topic_id", "partition_id", "node_id", "publisher_id", "publisher_epoch", "source_sequence", "arrival")

    def start():
        last: dict = {}
        place = 0

        def feed(x):
            nonlocal place
            source = (x["node_id"], x["publisher_id"], x["publisher_epoch"])
            seen = last.get(source)
            if seen is not None and x["source_sequence"] <= seen:
                return []
            out = []
            if seen is not None and x["source_sequence"] > seen + 1:
                place += 1
                out.append((x["topic_id"], x["partition_id"], x["publisher_id"], place, seen + 1, x["source_sequence"] - 1, True))
            place += 1
            last[source] = x["source_sequence"]
            return [*out, (x["topic_id"], x["partition_id"], x["publisher_id"], place, x["source_sequence"], x["source_sequence"], False)]

        return feed

    return machines(a, ["topic_id", "partition_id"], "arrival", start, "topic_id long, partition_id long, publisher_id long, assigned_sequence long, first_sequence long, last_sequence long, gap boolean")




@query()
def receiver_stats(spark, d):
    """Decisions of every receiver, counted."""
    return receiver_dedup(spark, d).groupBy("node_id", "decision").agg(F.count("*").alias("n"), F.max("highest").alias("highest"))


@query()
def recording_admission_metrics(spark, d):
    """Outcomes by topology, with the gaps and records that they owe."""
    a = recording_admission(spark, d)
    return a.groupBy("topology", "outcome", "reason").agg(F.count("*").alias("n"), F.count_if(F.col("gap_first") >= 0).alias("gaps"), F.sum(F.when(F.col("gap_first") >= 0, F.col("gap_last") - F.col("gap_first")).otherwise(0)).alias("owed"))


@query()
def export_pipeline(spark, d):
    """A bounded exporter for each topic that drops what doesn't fit; every fourth event drains one."""
    e = v.record(spark, d).select("topic_id", "event_id", F.when(F.col("event_id") % 4 == 0, "dequeue").otherwise("enqueue").alias("kind"))

    def start():
        box: list = []

        def events():
            while True:
                yield box.pop()

        machine = simulate.bounded_queue(events(), 8, "drop_newest")

        def feed(r):
            box.append((r["kind"], r["event_id"]))
            item, outcome, _ = next(machine)
            return [(r["topic_id"], item, outcome)]

        return feed

    return machines(e, ["topic_id"], "event_id", start, "topic_id long, event_id long, outcome string")


@query()
def receipt_admission(spark, d):
    """Receipts that each node's table takes under its limits, while those of 400 events ago, whosever they are, complete."""
    r = v.record(spark, d).select("node_id", "publisher_id", "event_id")

    def start():
        table = simulate.ReceiptTable(max_outstanding=64, max_per_publisher=5)
        due: deque[int] = deque()

        def feed(x):
            while due and due[0] + 400 <= x["event_id"]:
                table.complete(due.popleft())
            outcome = table.reserve(x["event_id"], x["publisher_id"])
            if outcome == "admitted":
                due.append(x["event_id"])
            return [(x["node_id"], x["publisher_id"], x["event_id"], outcome)]

        return feed

    return machines(r, ["node_id"], "event_id", start, "node_id long, publisher_id long, event_id long, outcome string")


@query()
def broadcast_channel(spark, d):
    """A bounded broadcast channel for each topic, with readers of different pace: what every event publishes, drops, and shows them."""
    r = v.record(spark, d).select("topic_id", "event_id", (F.col("event_id") % 7 == 3).alias("slow"))

    def start():
        channel = simulate.BroadcastChannel(16)
        for reader in range(3):
            channel.join(reader)

        def feed(x):
            n = x["event_id"]
            outcome, lost = channel.publish()
            out = [(x["topic_id"], n, -1, outcome, -1 if lost is None else lost, channel.next)]
            if n % 400 == 399:
                channel.leave(2)
                channel.join(2)
            for reader in range(3):
                channel.release(reader) if n % (reader + 2) else None
                if n % (reader + 1) == 0 or x["slow"]:
                    out.append((x["topic_id"], n, reader, *channel.poll(reader)))
            return out

        return feed

    return machines(r, ["topic_id"], "event_id", start, "topic_id long, event_id long, reader int, outcome string, first long, next long")


@query()
def fragment_arrivals(spark, d):
    """What becomes of every fragment as it arrives, late, twice or wrong, under quotas and a timeout."""
    li = v.table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("connection"), F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("line"), "l_partkey")
    li = li.withColumn("at", F.col("message_id") * 10 + F.col("line") + F.when(F.col("l_partkey") % 9 == 0, 40).otherwise(0) + F.col("line") / 10)

    def start():
        box = simulate.Reassembler(connection_messages=3, messages=5, connection_bytes=40, bytes=64, timeout=60)

        def feed(x):
            n = x["message_id"] % 3 + 1
            parts = [f"{x['message_id']}/{i}".encode() for i in range(n)]
            whole = b"".join(parts)
            i = (x["line"] - 1) % n
            outcome, got = box.offer(x["connection"], x["message_id"], i, n, len(whole), zlib.crc32(whole) ^ (x["l_partkey"] % 31 == 0), parts[i], int(x["at"]))
            return [(x["connection"], x["message_id"], x["line"], outcome, None if got is None else got.decode(), len(box.open), box.timeouts)]

        return feed

    return machines(li, ["connection"], "at", start, "connection long, message_id long, line int, outcome string, payload string, open int, timeouts int")
