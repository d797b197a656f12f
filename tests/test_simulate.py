"""State machines on planted cases."""

from streamloom.plans import simulate


def outcomes(policy, n=6, capacity=2, **more):
    return [o for _, o, _ in simulate.bounded_queue([("enqueue", i) for i in range(n)], capacity, policy, **more)]


def test_queue_policies():
    assert outcomes("block") == ["accepted"] * 2 + ["would_block"] * 4
    assert outcomes("fail")[2:] == ["failed"] * 4
    assert outcomes("drop_newest")[2:] == ["dropped"] * 4
    assert list(simulate.bounded_queue([("enqueue", i) for i in range(4)], 2, "drop_oldest"))[2:] == [(2, "accepted", 0), (3, "accepted", 1)]
    assert outcomes("sample", sample_rate=2)[2:] == ["would_block"] * 4
    assert outcomes("sample", capacity=3, sample_rate=2)[3:] == ["sampled_out"] * 3
    assert list(simulate.bounded_queue([("dequeue", 1)], 2, "block")) == [(1, "empty", None)]


def test_dedup_window_case():
    w = simulate.DedupWindow(distance=8)
    assert [w.offer(1, "s", n, 0) for n in (1, 3, 3, 2, 1)] == [("accept", 1), ("accept", 1), ("duplicate", 1), ("accept", 3), ("duplicate", 3)]
    assert w.offer(1, "s", 12, 0) == ("nack", 3) and w.offer(2, "s", 4, 0) == ("stale_session", None) and w.offer(1, "s", 0, 0) == ("invalid", None)
    assert w.offer(1, "t", 9, 0) == ("nack", 0)
    small = simulate.DedupWindow(max_sources=2, max_age=10)
    for i, s in enumerate("abc"):
        small.offer(1, s, 1, i)
    assert set(small.sources) == {"b", "c"}
    assert small.offer(1, "b", 1, 20) == ("accept", 1)


def test_buffer_pool():
    pool = simulate.BufferPool(global_limit=5 * 4096, topic_limit=3 * 4096, slots=10)
    assert [pool.reserve(i, i % 2, 100, "drop_oldest") for i in range(5)] == [("accepted", [])] * 5
    assert pool.pressure() == "high" and pool.reserve(5, 1, 100, "drop_newest") == ("dropped_newest", [])
    assert pool.reserve(6, 0, 100, "drop_oldest") == ("accepted", [0])
    assert pool.reserve(7, 0, 60_000, "drop_oldest") == ("dropped_newest", [])
    assert pool.reserve(8, 0, 100, "block")[0] == "would_block" and pool.reserve(8, 0, 60_000, "block")[0] == "too_large"
    assert pool.reserve(9, 0, 100, "fail")[0] == pool.reserve(10, 1, 1, "drop_newest")[0] == "recording_failed"
    assert simulate.charge(0, (4096,), 9000) == 0 and simulate.charge(8193, (4096,), 9000) == 9000 and simulate.charge(9001, (4096,), 9000) is None


def test_admission():
    run = lambda events, topology, **m: [(x["outcome"], x["reason"], x["gap"], x["cursor"]) for x in simulate.admission(events, topology, **m)]
    events = [(0, "", False), (3, "", False), (4, "", True), (5, "degraded", False), (6, "ready", False)]
    assert run(events, "isolated") == [("record", "ready", None, 1), ("record", "cursor_lag", (1, 3), 4), ("drop_recording", "buffer_full", (4, 5), 5), ("drop_recording", "recorder_degraded", (5, 6), 6), ("record", "ready", None, 7)]
    assert run([(0, "", False), (1, "", True), (3, "", False), (1, "ready", False)], "strong") == [("record", "ready", None, 1), ("block_primary", "buffer_full", None, 1), ("block_primary", "cursor_lag", None, 1), ("record", "ready", None, 2)]
    assert [x[0] for x in run([(0, "", True), (0, "", False)], "strong", full_policy="fail")] == ["fail_primary"] * 2
    assert run([(5, "unbound", True)], "best_effort") == [("bypass", "unbound", None, 6)]
    assert run([(0, "", False), (0, "", False)], "best_effort")[1][:2] == ("invalid", "stale_cursor")


def test_reservations():
    limit, reserve, order = {"a": 10, "b": 5}, {"a": 2, "b": 0}, ("a", "b")
    events = [("reserve_data", 1, {"a": 8}), ("reserve_data", 2, {"a": 1, "b": 1}), ("reserve_control", 3, {"a": 2}), ("commit", 1, {}), ("release", 1, {}), ("rollback", 3, {}), ("reserve_data", 4, {"a": 8, "b": 6}), ("commit", 9, {}), ("reserve_data", 5, {"a": 0})]
    assert [x[1:] for x in simulate.reservations(events, limit, reserve, order)] == [("reserved", None), ("rejected", "a"), ("reserved", None), ("committed", None), ("released", None), ("rolled_back", None), ("rejected", "b"), ("unknown", None), ("invalid", None)]


def test_rotation_and_negotiation():
    assert list(simulate.rotation([(50, 0), (60, 1), (10, 2), (10, 3), (10, 99)], 100, 3, 50)) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0)]
    assert list(simulate.rotation([(500, 0), (500, 0)], 100, 3, 50)) == [(0, 0), (1, 0)]
    n = simulate.Negotiator(max_frames=3, per_second=1)
    assert n.frame(1, 7, 10, 0) == [(1, "buffered")] and n.frame(2, 8, 10, 0) == [(2, "rate_limited")] and n.frame(3, 8, 10, 1) == [(3, "buffered")]
    assert n.announce(7) == [(1, "released")] and n.frame(4, 7, 10, 1) == [(4, "passed")]
    assert n.frame(5, 8, 1, 1) == n.frame(5, 8, 1, 1) == [(5, "buffered")]
    assert n.frame(6, 8, 1, 1) == [(3, "discarded"), (5, "discarded"), (5, "discarded"), (6, "connection_failed")] and n.failed


def test_receipts_of_every_publisher_leave_room():
    t = simulate.ReceiptTable(max_outstanding=3, max_per_publisher=2)
    assert [t.reserve(i, p) for i, p in ((1, 7), (2, 7), (3, 7), (4, 8), (5, 9))] == ["admitted", "admitted", "rejected_publisher", "admitted", "rejected_table"]
    assert t.complete(1) and not t.complete(1) and not t.complete(99)
    assert t.reserve(6, 9) == "admitted" and t.reserve(7, 7) == "rejected_table"
    assert t.complete(4) and t.reserve(8, 7) == "admitted" and t.held == {7: 2, 9: 1}
    assert simulate.ReceiptTable(5, 0).reserve(1, 1) == "rejected_publisher"


def test_broadcast_drops_the_oldest_for_all_who_wait_for_it():
    c = simulate.BroadcastChannel(2)
    c.join(1), c.join(2)
    assert [c.publish() for _ in range(2)] == [("published", None)] * 2
    assert c.publish() == ("published", 0) and c.cursors == {1: 1, 2: 1} and c.dropped == {1: 1, 2: 1}
    assert c.poll(1) == ("gap", 0, 1) and c.poll(1) == ("message", 1, 2)  # the gap is told once
    assert c.publish() == ("would_block", None) and c.cursors == {1: 1, 2: 1}  # all or nothing: 1 holds the oldest
    assert c.release(1) and not c.release(1)
    assert c.publish() == ("published", 1) and c.cursors == {1: 2, 2: 2} and c.dropped == {1: 1, 2: 2}
    assert c.poll(2) == ("gap", 0, 2)  # two drops in a row are one gap
    c.leave(1)
    c.join(3)
    assert c.poll(3) == ("empty", 4, 4) and c.publish() == ("published", 2) and c.poll(3) == ("message", 4, 5) and c.poll(3) == ("held", 4, 5)
    assert c.poll(2) == ("gap", 2, 3) and c.poll(2) == ("message", 3, 4)
    still = simulate.BroadcastChannel(1, drop=False)
    still.join(1)
    assert [still.publish()[0] for _ in range(2)] == ["published", "would_block"]
    assert [simulate.BroadcastChannel(1).publish()] * 3 == [("published", None)] * 3


def test_reassembly_under_quotas_and_time():
    import zlib

    r = simulate.Reassembler(connection_messages=2, messages=3, connection_bytes=10, bytes=12, timeout=10)
    crc = zlib.crc32(b"abcd")
    assert r.offer(1, 1, 1, 2, 4, crc, b"cd", 0) == ("stored", None) and r.offer(1, 1, 1, 2, 4, crc, b"cd", 1) == ("duplicate", None)
    assert r.offer(1, 2, 0, 2, 7, 0, b"x", 1) == ("quota", None)  # 4 and 7 are over a connection's 10 bytes
    assert r.offer(1, 2, 0, 2, 4, crc, b"ab", 1) == ("stored", None) and r.offer(1, 3, 0, 2, 1, crc, b"ab", 1) == ("quota", None)
    assert r.offer(2, 3, 0, 2, 5, crc, b"ab", 1) == ("quota", None)  # 8 and 5 are over all connections' 12
    assert r.offer(1, 1, 0, 2, 4, crc, b"ab", 2) == ("complete", b"abcd") and r.offer(1, 1, 0, 2, 4, crc, b"zz", 3) == ("duplicate", None)
    assert r.offer(1, 2, 1, 2, 4, crc + 1, b"cd", 3) == ("rejected", None) and not r.open
    assert r.offer(1, 4, 0, 1, 2, 5, b"ab", 3) == ("rejected", None) and r.offer(1, 4, 3, 2, 2, 5, b"ab", 3) == ("rejected", None)
    assert r.offer(1, 5, 0, 2, 4, crc, b"ab", 3) == ("stored", None) and r.offer(1, 5, 0, 2, 4, crc, b"xx", 4) == ("rejected", None)
    assert r.offer(1, 6, 0, 2, 4, crc, b"ab", 5) == ("stored", None)
    assert r.offer(1, 6, 1, 2, 4, crc, b"cd", 15) == ("stored", None) and r.timeouts == 1  # what began a timeout ago is forgotten
    assert r.offer(1, 1, 0, 2, 4, crc, b"ab", 15) == ("stored", None)  # and so is what was complete
