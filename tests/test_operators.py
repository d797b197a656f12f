"""Operators on small planted cases, and closed forms against plain loops."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from streamloom.functions import scalars
from streamloom.operators import capacity, delivery, integrity, registry, replay, storage, telemetry
from streamloom.operators.replay import Range, ReplayError, ReplayFilter
from streamloom.plans.running import running

RECORD = "topic_id long, partition_id long, ingestion_sequence long, ingestion_ts_ns long, node_id long, publisher_id long, publisher_epoch long, source_sequence long, observed_ts_ns long, flags long"


def records(spark, rows):
    """rows: (topic, partition, sequence, time)."""
    return spark.createDataFrame([(t, p, s, ts, 1, 1, 1, s, ts, 0) for t, p, s, ts in rows], RECORD)


def test_merge_equals_a_heap_of_heads(spark):
    r = random.Random(1)
    for _ in range(4):
        streams = {(t, p): [(t, p, s, r.randint(0, 60)) for s in range(1, r.randint(2, 30))] for t in (1, 2) for p in (0, 1)}
        heap, order = [], []
        head = lambda x, k: (x[3], x[0], x[1], x[2], k)
        for k, rows in streams.items():
            heapq.heappush(heap, (*head(rows[0], k), 0))
        while heap:
            *_, k, i = heapq.heappop(heap)
            order.append(streams[k][i][:3])
            if i + 1 < len(streams[k]):
                heapq.heappush(heap, (*head(streams[k][i + 1], k), i + 1))
        frame = records(spark, [x for rows in streams.values() for x in rows])
        assert [tuple(x) for x in replay.merged(frame).select("topic_id", "partition_id", "ingestion_sequence").collect()] == order
        placed = replay.positioned(frame, slice_ns=7).orderBy("position").select("topic_id", "partition_id", "ingestion_sequence", "position").collect()
        assert [tuple(x)[:3] for x in placed] == order and [x.position for x in placed] == list(range(len(order)))


def test_replay_case(spark):
    topics = spark.createDataFrame([(1, "alpha"), (2, "beta")], "topic_id long, topic_name string")
    rows = [(1, 0, 1, 100, 7, 1, 1, 49, 1000, 0), (1, 0, 2, 200, 8, 1, 1, 50, 1100, 0), (1, 0, 3, 300, 8, 1, 1, 51, 1200, 0), (1, 0, 4, 210, 8, 1, 1, 50, 1100, 1)]
    frame = spark.createDataFrame(rows, RECORD)
    flt = ReplayFilter(Range(150, 250), Range(1050, 1150), Range(50, 50), Range(2, 4), topic_names=frozenset({"alpha"}), node_ids=frozenset({8}))
    got = replay.metadata(frame.where(replay.resolved(flt, topics).condition()), topics, "s").collect()
    assert [(x.ingestion_ts_ns, x.namespace, x.publish_ts_ns) for x in got] == [(200, "replay", 200)]
    with pytest.raises(ReplayError):
        Range(2, 1)
    with pytest.raises(ReplayError):
        replay.resolved(ReplayFilter(topic_ids=frozenset({9})), topics)
    with pytest.raises(ReplayError):
        replay.guard_log(frame.withColumn("topic_id", F.lit(3).cast("long")), topics)
    with pytest.raises(ReplayError):
        replay.authorise("live", True, False)
    assert replay.authorise("replay", False, False) == "replay"


@pytest.mark.parametrize(("speed", "due"), [(1.0, [0, 1000, 3000]), (2.0, [0, 500, 1500]), (0.5, [0, 2000, 6000])])
def test_schedule(spark, speed, due):
    frame = records(spark, [(1, 0, 1, 1000), (1, 0, 2, 2000), (1, 0, 3, 4000)])
    assert sorted(x.target_ns for x in replay.schedule(frame, 0, speed).collect()) == due


def test_gap_and_duplicate_case(spark):
    rows = [(1, 0, 101, 1, 1), (1, 0, 202, 10, 2), (1, 0, 101, 1, 3), (1, 0, 101, 3, 4)]
    frame = spark.createDataFrame([(t, p, 1, pub, 1, seq, a, 0, 0, 0, 8) for t, p, pub, seq, a in rows], "topic_id long, partition_id long, node_id long, publisher_id long, publisher_epoch long, source_sequence long, arrival long, ingestion_ts_ns long, observed_ts_ns long, flags long, payload_size long")
    checked = integrity.arrivals_checked(frame)
    out = integrity.written(checked).orderBy("assigned_sequence").collect()
    assert [(x.assigned_sequence, x.publisher_id, x.source_sequence, x.flags) for x in out] == [(1, 101, 1, 0), (2, 202, 10, 0), (3, 101, 2, 1), (4, 101, 3, 0)]
    discards = spark.createDataFrame([(1, 1, 101, 1, 2, "cancelled")], "topic_id long, node_id long, publisher_id long, publisher_epoch long, source_sequence long, reason string")
    assert [x.reason for x in integrity.gap_reasons(integrity.gaps(checked), discards).collect()] == ["cancelled"]
    assert [x.duplicates for x in integrity.stats(checked).collect()] == [1]


def test_running_in_small_chunks(spark):
    r = random.Random(2)
    rows = [(k, i, r.randint(0, 9)) for i in range(300) for k in [r.choice("aab")]]
    frame = spark.createDataFrame(rows, "k string, i long, v long")
    values = {"s": ("sum", F.col("v"), True), "before": ("sum", F.col("v"), False), "m": ("max", F.col("v"), False)}
    got = {x.i: (x.s, x.before, x.m) for x in running(frame, ["k"], "i", values, chunk=7).collect()}
    seen = {"a": [], "b": []}
    for k, i, v in rows:
        before = seen[k]
        assert got[i] == (sum(before) + v, sum(before), max(before, default=None))
        before.append(v)


def plain_retention(segments, now, age, limit, count, archived):
    total, n = sum(s[2] for s in segments if s[1] != 6), sum(s[1] != 6 for s in segments)
    out = {}
    able = sorted((s for s in segments if s[1] in (3, 4, 5)), key=lambda s: (s[3], s[0]))
    for s in able:
        reasons = (1 if age is not None and s[3] <= now and now - s[3] >= age else 0) + (8 if archived and s[4] else 0)
        if reasons:
            out[s[0]] = reasons
            total, n = total - s[2], n - 1
    for s in able:
        b, c = limit is not None and total > limit, count is not None and n > count
        if not b and not c:
            break
        if s[0] not in out:
            out[s[0]] = 2 * b + 4 * c
            total, n = total - s[2], n - 1
    return out


def test_retention_equals_the_loop(spark):
    schema = "segment_id long, state long, size_bytes long, latest_ts long, archive_complete boolean"
    case = [(1, 3, 10, 10, False), (2, 4, 20, 80, False), (3, 5, 30, 90, True), (4, 2, 40, 1, True)]
    plan = storage.retention_plan(spark.createDataFrame(case, schema), 100, 50, 40, 1, True)
    assert {x.segment_id: x.reasons for x in plan.collect()} == {1: 1, 2: 6, 3: 8}
    r = random.Random(3)
    for _ in range(6):
        rows = [(i, r.randint(1, 6), r.randint(0, 50), r.randint(0, 20), r.random() < 0.2) for i in range(1, r.randint(2, 40))]
        args = (15, r.choice([None, 5, 12]), r.choice([None, 100, 400]), r.choice([None, 3, 12]), r.random() < 0.5)
        got = {x.segment_id: x.reasons for x in storage.retention_plan(spark.createDataFrame(rows, schema), *args).collect()}
        assert got == plain_retention(rows, *args)


def test_histogram_case(spark):
    frame = spark.createDataFrame([(1, x) for x in (0, 1, 2, 3, 4, 7, 8, -1)], "k int, v long")  # -1 has the bits of the largest unsigned value
    got = {x.bucket: x["count"] for x in telemetry.histogram(frame, ["k"], "v").collect()}
    assert len(got) == 65 and {b: n for b, n in got.items() if n} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 1, 64: 1}


def test_clock_case(spark):
    rows = [(1, 1, 1000, 1000, 900, 5), (1, 2, 1100, 1100, 1200, 5), (1, 3, 1200, 1200, 1100, 21), (1, 4, 1300, 1500, 1250, 5)]
    frame = spark.createDataFrame([(*r, r[2], True, 1, 1) for r in rows], "shard int, i int, wall long, mono long, origin long, uncertainty long, last_sync long, synchronized boolean, quality_domain int, origin_domain int")
    got = telemetry.clock_gated(frame, "shard", "i", 20, 100, 1000).orderBy("i").collect()
    assert [(x.decision, x.latency) for x in got] == [("accepted", 100), ("negative", None), ("uncertain", None), ("clock_jump", None)]


def test_rate_limit_equals_the_loop(spark):
    r = random.Random(4)
    rows = [(i, r.randint(0, 2) if r.random() < 0.3 else 5) for i in range(200)]
    kept, second, n = [], None, 0
    for i, s in rows:
        n = n + 1 if s == second else 1
        second = s
        kept += [i] * (n <= 2)
    frame = spark.createDataFrame(rows, "i long, s long")
    assert sorted(x.i for x in telemetry.rate_limited(frame, "s", "i", 2).collect()) == kept
    assert telemetry.rate_limited(frame, "s", "i", 0).count() == 200


def test_capacity_case(spark):
    state = spark.createDataFrame([(1, i, d, limit, 0, 0, 0) for i, (d, limit) in enumerate((("shm_bytes", 1024), ("bridge_connections", 2), ("bridge_egress_bytes", 100), ("schema_buffer_bytes", 32)))], "node_id long, ordinal int, dimension string, limit long, reserve long, committed long, pending long")
    asked = spark.createDataFrame([(1, 1, "data", i, d, n) for i, (d, n) in enumerate((("shm_bytes", 512), ("bridge_connections", 1), ("bridge_egress_bytes", 101), ("schema_buffer_bytes", 16)))], "request_id long, node_id long, plane string, ordinal int, dimension string, requested long")
    assert [tuple(x) for x in capacity.admissions(asked, state).collect()] == [(1, False, "bridge_egress_bytes", 101, 100)]


def test_receipt_cases(spark):
    receipts = spark.createDataFrame([(1, "any", 0, delivery.WRITTEN), (2, "quorum", 2, delivery.WRITTEN), (3, "all", 0, delivery.WRITTEN), (4, "all", 0, delivery.WRITTEN), (5, "all", 0, delivery.WRITTEN)], "receipt_id long, policy string, quorum long, stage string")
    rec = delivery.RECORDER
    targets = [(1, rec, delivery.WRITTEN, False), (1, rec, delivery.DURABLE, True), (1, rec, None, None), (2, rec, delivery.WRITTEN, True), (2, rec, delivery.DURABLE, True), (2, rec, None, None), (3, rec, delivery.BUFFERED, True), (4, rec, None, None)]
    got = {x.receipt_id: x.state for x in delivery.completion(receipts, spark.createDataFrame(targets, "receipt_id long, target_kind string, reached string, ok boolean")).collect()}
    assert got == {1: "complete", 2: "complete", 3: "failed", 4: "outstanding", 5: "complete"}


def test_fragments(spark):
    import zlib

    crc = zlib.crc32(b"abcd")
    rows = [(1, 0, b"ab", 2, crc), (1, 1, b"cd", 2, crc), (1, 1, b"cd", 2, crc), (2, 0, b"ab", 2, crc), (3, 0, b"ab", 2, crc), (3, 0, b"xx", 2, crc), (3, 1, b"cd", 2, crc), (4, 0, b"ab", 2, crc), (4, 1, b"cx", 2, crc), (5, 2, b"ab", 2, crc)]
    frame = spark.createDataFrame([(1, 1, m, i, bytes(b), n, c) for m, i, b, n, c in rows], "connection int, peer int, message_id long, index int, bytes binary, count int, crc long")
    got = {x.message_id: (x.status, x.payload and bytes(x.payload)) for x in delivery.reassembled(frame).collect()}
    assert got == {1: ("complete", b"abcd"), 2: ("incomplete", None), 3: ("rejected", None), 4: ("corrupt", None), 5: ("rejected", None)}


def test_scalars(spark):
    one = spark.createDataFrame([(0,), (-1,), (1,), (2**62,), (-(2**63),), (127,), (-64,)], "v long").select("v", scalars.zigzag(F.col("v")).alias("z"))
    for x in one.select("v", "z", scalars.unzigzag(F.col("z")).alias("back"), scalars.varint_length(F.col("z")).alias("n")).collect():
        u = (x.v << 1 ^ x.v >> 63) & (1 << 64) - 1
        assert x.z & (1 << 64) - 1 == u and x.back == x.v and x.n == max(1, -(-u.bit_length() // 7))
    assert scalars.crc32c(b"123456789") == 0xE3069283
    row = spark.range(1).select(scalars.parse_version(F.lit("2.1")).alias("a"), scalars.parse_version(F.lit("2.01")).alias("b"), scalars.parse_version(F.lit("70000.1")).alias("c"), scalars.slot_class(F.lit(65)).alias("d"), scalars.charged_bytes(F.lit((1 << 20) + 1)).alias("e"), scalars.encoded_record_size(F.lit(0)).alias("f"), scalars.crc32c_column(F.lit(b"123456789")).alias("g")).first()
    assert tuple(row) == (131073, None, None, 256, (1 << 20) + 4096, 140, 0xE3069283)


def test_dependency_closure_ends_on_cycles(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "type long, dependency long")
    got = {tuple(x) for x in registry.closure(edges, str(tmp_path)).collect()}
    assert got == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3)}


def test_recovery_follows_the_chain(spark):
    schema = "path string, topic_id long, partition_id long, segment_id long, first_sequence long, last_sequence long, sealed boolean, readable boolean"
    tracked = spark.createDataFrame([("a", 1, 0, 1, 1, 10, True, True), ("b", 1, 0, 2, 11, 20, False, True)], schema)
    rest = [("c", 1, 0, 3, 21, 30, True, True), ("d", 1, 0, 4, 40, 50, True, True), ("e", 1, 0, 5, 31, 35, False, True), ("f", 1, 0, 6, 36, 38, True, False), ("g", 1, 0, 7, 36, 40, True, True), ("h", 1, 0, 8, 36, 40, True, True)]
    rest += [("i", 2, 0, 9, 1, 5, True, True), ("j", 2, 0, 10, 1, 5, True, True), ("k", 2, 0, 8, 6, 9, True, True), ("l", 3, 0, 1, 2, 5, True, True)]
    got = {x.path: x.action for x in storage.recovery_decisions(tracked.union(spark.createDataFrame(rest, schema)), tracked).collect()}
    assert got == {"a": "keep", "b": "repair_tail", "c": "adopt", "d": "quarantine", "e": "repair_adopt", "f": "quarantine", "g": "adopt", "h": "quarantine", "i": "adopt", "j": "quarantine", "k": "quarantine", "l": "quarantine"}


def test_recording_rules_with_holes_in_the_ids(spark):
    rows = [(0, "a", 1, "x"), (7, "b", 2, "y"), (3_000_000, "b", 2, "y"), (9_000_000, "c", 9, "z")]
    got = {tuple(r) for r in storage.recording_violations(spark.createDataFrame(rows, "topic_id long, name string, schema_ref long, digest string")).collect()}
    assert got == {(0, "zero_id"), (7, "duplicate_name"), (3_000_000, "duplicate_name"), (7, "duplicate_digest"), (3_000_000, "duplicate_digest"), (3_000_000, "schema_ref_order")}


def test_running_keeps_rows_with_null_keys(spark):
    from pyspark.sql import functions as F

    from streamloom.plans.running import running

    df = spark.createDataFrame([(None, 1, 5), (None, 3_000_000, 6), (1, 2, 7), (1, 4, 8)], "k long, o long, v long")
    got = {(r.k, r.o): (r.s, r.m) for r in running(df, ["k"], "o", {"s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False)}).collect()}
    assert got == {(None, 1): (5, None), (None, 3_000_000): (11, 5), (1, 2): (7, None), (1, 4): (15, 7)}


def test_replay_publishes_in_order_until_refused(spark, tmp_path):
    class Collecting(replay.Publisher):
        """Refuses what says so, and writes down the rest."""

        def __init__(self, folder):
            import uuid

            self.file = open(f"{folder}/{uuid.uuid4().hex}", "a", buffering=1)

        def publish(self, request):
            if request["payload"] == "bad":
                raise OSError("full")
            print(request["topic_id"], request["ingestion_sequence"], request["payload"], file=self.file)

    rows = [(t, 0, i, 1 if i == 4 else 0, "bad" if (t, i) == (2, 7) else f"p{i}") for t in (1, 2) for i in range(12, 0, -1)]
    folder = str(tmp_path)
    done = replay.publish(spark.createDataFrame(rows, "topic_id long, partition_id long, ingestion_sequence long, flags long, payload string").repartition(3), lambda: Collecting(folder)).collect()
    assert sorted(map(tuple, done)) == [(1, 0, 11, 12, None, None), (2, 0, 5, 6, 7, "OSError: full")]
    said = [line.split() for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    assert [int(i) for t, i, _ in said if t == "1"] == [i for i in range(1, 13) if i != 4]
    assert [(int(i), p) for t, i, p in said if t == "2"] == [(i, f"p{i}") for i in (1, 2, 3, 5, 6)]


def test_fragments(spark):
    import zlib

    whole = b"abcdef"
    rows = [(1, i, whole[2 * i : 2 * i + 2], 3, zlib.crc32(whole)) for i in (2, 0, 1, 1)]  # a repeat
    rows += [(2, 0, b"ab", 2, 5), (3, 0, b"ab", 1, 5), (4, 0, b"a", 2, 1), (4, 1, b"b", 2, 2), (5, 0, b"a", 1, 1), (5, 0, b"b", 1, 1), (6, 3, b"a", 2, 1), (7, 0, b"", 1, 0)]
    frames = spark.createDataFrame([(1, 1, *r) for r in rows], "connection long, peer long, message_id long, index long, bytes binary, count long, crc long")
    got = {r.message_id: (r.status, r.payload) for r in delivery.reassembled(frames).collect()}
    assert got == {1: ("complete", bytearray(whole)), 2: ("incomplete", None), 3: ("corrupt", None), 4: ("rejected", None), 5: ("rejected", None), 6: ("rejected", None), 7: ("complete", bytearray())}


def test_saturating_arithmetic_beyond_64_bits(spark, tmp_path):
    from streamloom import catalog

    keys = [0, 1, 184, 185, 92_234, 900_000, 5_000_000_000]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.c_custkey: (int(r.added), int(r.multiplied)) for r in catalog.queries()["saturating_arithmetic"](spark, str(tmp_path)).collect()}
    most = (1 << 64) - 1
    assert got == {k: (min(most, 18446744073709550000 + 3 * k), min(most, k * 10**17)) for k in keys}
    wide = spark.range(1).select(scalars.saturating_multiply(F.lit("9" * 38).cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)")).alias("x")).first()
    assert int(wide.x) == most
