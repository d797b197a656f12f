"""Every state machine's query against the same machine fed plainly, key by key, from the collected rows."""

import pytest

from streamloom import catalog, simulations
from streamloom.operators import storage
from streamloom.plans.machines import machines

SF = "/root/testdata/sf0.001"
NAMES = "bounded_queue_policies buffer_pool_admission receiver_dedup recording_admission capacity_reservations rotation_by_size_and_time schema_negotiation bridge_pump writer_pump receiver_stats recording_admission_metrics export_pipeline receipt_admission session_recovery broadcast_channel fragment_arrivals".split()


def plain(df, keys, order, start):
    rows = sorted((r.asDict(recursive=False) for r in df.collect()), key=lambda r: (*[r[k] for k in keys], r[order]))
    out, current, feed = [], None, None
    for r in rows:
        if (key := tuple(r[k] for k in keys)) != current:
            current, feed = key, start()
        out += feed(r)
    return out


@pytest.mark.parametrize("name", NAMES)
def test_machine_is_fed_in_order(spark, name, monkeypatch):
    seen = []

    def both(df, keys, order, start, schema):
        out = machines(df, keys, order, start, schema)
        seen.append((out, plain(df, keys, order, start)))
        return out

    for module in (simulations, storage):
        monkeypatch.setattr(module, "machines", both)
    result = catalog.queries()[name](spark, SF)
    (out, want), *_ = seen
    assert want and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    assert result.count() > 0


def test_derived_from_the_receiver(spark):
    found = catalog.queries()["receiver_dedup"](spark, SF).collect()
    action = {"accept": "publish_ack", "duplicate": "ack"}
    pumped = catalog.queries()["bridge_pump"](spark, SF).collect()
    assert sorted(map(tuple, pumped)) == sorted((r.node_id, r.arrival, action.get(r.decision, "nack"), r.highest) for r in found)
    counted = {}
    for r in found:
        n, most = counted.get((r.node_id, r.decision), (0, -1))
        counted[r.node_id, r.decision] = (n + 1, max(most, r.highest))
    assert {(r.node_id, r.decision): (r.n, r.highest) for r in catalog.queries()["receiver_stats"](spark, SF).collect()} == counted


def test_derived_from_admission(spark):
    counted = {}
    for r in catalog.queries()["recording_admission"](spark, SF).collect():
        n, gaps, owed = counted.get((r.topology, r.outcome, r.reason), (0, 0, 0))
        counted[r.topology, r.outcome, r.reason] = (n + 1, gaps + (r.gap_first >= 0), owed + (r.gap_last - r.gap_first if r.gap_first >= 0 else 0))
    got = {(r.topology, r.outcome, r.reason): (r.n, r.gaps, r.owed) for r in catalog.queries()["recording_admission_metrics"](spark, SF).collect()}
    assert got == counted
