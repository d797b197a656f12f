"""Segment files, frames and configuration."""

import random

import pytest

from streamloom.sources import frames, segment


def made(n=5, first=1, topic=1):
    head = segment.SegmentHeader(1, topic, 0, 9, first, 100)
    records = [segment.Record(0, 1, 1, 1, topic, 0, first + i, 1000 + i, 1, 2, 3, i + 1, 900 + i, bytes(range(i * 3))) for i in range(n)]
    return head, records, segment.encode_header(head) + b"".join(map(segment.encode_record, records))


def test_round_trip_and_sizes():
    head, records, data = made()
    assert segment.decode_header(data) == head and len(segment.encode_record(records[0])) == segment.encoded_size(0) == 140
    assert [x for _, x in segment.scan(data)] == records
    assert segment.disposition(data) == ("clean", 5, len(data))


def test_every_truncation_point():
    _, records, data = made(3)
    ends = [segment.HEADER_SIZE]
    for r in records:
        ends.append(ends[-1] + segment.encoded_size(len(r.payload)))
    for n in range(segment.HEADER_SIZE, len(data)):
        kind, whole, good = segment.disposition(data[:n])
        assert whole == sum(e <= n for e in ends[1:]) and good == max(e for e in ends if e <= n)
        assert kind == ("clean" if n in ends else "incomplete_tail")


def test_any_flipped_bit_is_found():
    _, records, data = made(3)
    r = random.Random(1)
    for _ in range(150):
        at = r.randrange(len(data))
        bad = bytearray(data)
        bad[at] ^= 1 << r.randrange(8)
        assert segment.disposition(bytes(bad))[0] != "clean"
    interior = bytearray(data)
    interior[segment.HEADER_SIZE + 60] ^= 1
    assert segment.disposition(bytes(interior))[:2] == ("corruption", 2)


def test_data_source(spark, tmp_path):
    spark.dataSource.register(segment.SegmentSource)
    rows = [(0, 1, 1, 1, t, 0, s, s * 10, 1, 1, 1, s, s, bytearray(b"x" * s)) for t in (1, 2) for s in range(1, 21)]
    schema = segment.SCHEMA.replace("path string, offset long, ", "")
    spark.createDataFrame(rows, schema).coalesce(1).write.format("segment").mode("append").save(str(tmp_path))
    back = spark.read.format("segment").load(str(tmp_path))
    assert back.count() == 40 and back.where("topic_id = 2").agg({"ingestion_sequence": "max"}).first()[0] == 20
    assert segment.read_segments(spark, str(tmp_path)).count() == 40
    path = next(tmp_path.glob("t1-*.segment"))
    path.write_bytes(path.read_bytes()[:-5])
    got = {r.disposition for r in segment.recovery(spark, str(tmp_path)).collect()}
    assert got == {"clean", "incomplete_tail"}
    assert spark.read.format("segment").option("mode", "DROPMALFORMED").load(str(tmp_path)).count() == 39


def test_segments_rotate_in_the_writer(spark, tmp_path):
    spark.dataSource.register(segment.SegmentSource)
    schema = segment.SCHEMA.replace("path string, offset long, ", "")
    rows = [(0, 1, 1, 1, t, 0, s, s * 10, 1, 1, 1, s, s, bytearray(b"x" * 10)) for t in (1, 2) for s in range(1, 101)]
    frame = spark.createDataFrame(rows, schema).coalesce(1)

    def lengths(folder, **options):
        frame.write.format("segment").options(**options).mode("append").save(str(tmp_path / folder))
        back = spark.read.format("segment").load(str(tmp_path / folder))
        assert back.count() == 200 and {r.disposition for r in segment.recovery(spark, str(tmp_path / folder)).collect()} == {"clean"}
        return sorted(r["count"] for r in back.groupBy("path").count().collect())

    assert lengths("a", batch=7) == [100, 100]  # batches go on in the open segment
    assert lengths("b", max_records=30) == [10, 10, 30, 30, 30, 30, 30, 30]
    assert lengths("c", max_ns=500) == [50] * 4
    size = segment.encoded_size(10)
    assert lengths("d", max_bytes=segment.HEADER_SIZE + 60 * size) == [40, 40, 60, 60]
    holes = frame.where("ingestion_sequence % 50 <> 0")
    holes.write.format("segment").mode("append").save(str(tmp_path / "e"))
    assert sorted(r["count"] for r in spark.read.format("segment").load(str(tmp_path / "e")).groupBy("path").count().collect()) == [49] * 4


def test_clean_scan_agrees_with_the_careful_one():
    import random

    from streamloom.sources.segment import Record, SegmentHeader, encode_header, encode_record, scan, scan_clean

    r = random.Random(8)
    records = [Record(i % 3 % 2, 1, 2, 3, 7, 1, i, i * 10, 1, 2, 3, i, i + 5, r.randbytes(r.choice([0, 1, 8, 9, 300, 700]))) for i in range(4, 60)]
    data = encode_header(SegmentHeader(1, 7, 1, 1, 4, 40)) + b"".join(map(encode_record, records))
    places, found = scan_clean(data)
    careful = list(scan(data))
    assert [at for at, _ in careful] == places.tolist() and [x for _, x in careful] == records
    for name in ("flags", "schema_ref", "topic_id", "ingestion_sequence", "node_id", "observed_ts_ns"):
        assert found[name].tolist() == [getattr(x, name) for x in records]
    assert len(scan_clean(encode_header(SegmentHeader(1, 7, 1, 1, 4, 40)))[0]) == 0
    for at in sorted(r.sample(range(len(data)), 300)):  # whatever the careful scan objects to, this one does not pass
        bad = bytearray(data)
        bad[at] ^= 1 << r.randrange(8)
        assert scan_clean(bytes(bad)) is None
    assert scan_clean(data[:-3]) is None and scan_clean(data + b"x" * 200) is None
    swapped = encode_header(SegmentHeader(1, 7, 1, 1, 4, 40)) + b"".join(map(encode_record, [records[1], records[0]]))
    assert scan_clean(swapped) is None


def test_crc32c_by_slices():
    import random

    import numpy as np

    from streamloom.functions.scalars import _CRC, crc32c, crc32c_rows

    def plain(data):
        crc = 0xFFFFFFFF
        for x in data:
            crc = _CRC[(crc ^ x) & 255] ^ (crc >> 8)
        return crc ^ 0xFFFFFFFF

    assert crc32c(b"123456789") == 0xE3069283
    r = random.Random(3)
    for n in (0, 1, 255, 256, 257, 511, 512, 5000, 1 << 20):
        data = r.randbytes(n)
        assert crc32c(data) == plain(data)
        assert crc32c(data[n // 3 :], crc32c(data[: n // 3])) == plain(data)
    for n in (0, 1, 3, 4, 5, 200, 256, 258, 259, 300, 1030):
        rows = np.frombuffer(r.randbytes(7 * n), np.uint8).reshape(7, n)
        assert crc32c_rows(rows).tolist() == [plain(x.tobytes()) for x in rows]


def test_frames():
    f = frames.Frame(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, b"payload", frames.HAS_CRC, (1, 2, 3, 4, 5, 6))
    plain = frames.Frame(1, 2, 3, 4, 5, 6, 7, 8, 9, 10)
    assert len(frames.encode(plain)) == 80 and frames.decode(frames.encode(plain)) == plain and frames.decode(frames.encode(f)) == f
    data = frames.prefixed(f) + frames.prefixed(plain)
    for step in (1, 7, len(data)):
        s = frames.FrameStream()
        got = [x for i in range(0, len(data), step) for x in s.push(data[i : i + step])]
        s.finish()
        assert got == [f, plain]
    raw = bytearray(frames.encode(f))
    for at in range(len(raw)):
        bad = raw.copy()
        bad[at] ^= 1
        with pytest.raises(frames.FrameError):
            frames.decode(bytes(bad))
    s = frames.FrameStream()
    list(s.push(data[:10]))
    with pytest.raises(frames.FrameError):
        s.finish()
    with pytest.raises(frames.FrameError):
        list(frames.FrameStream(most=10).push(data))


def test_small_codecs():
    assert frames.decode_gap(frames.encode_gap(2, 5, 1)) == (2, 5, 1)
    for bad in (b"", bytes(24)):
        with pytest.raises(frames.FrameError):
            frames.decode_gap(bad)
    assert frames.decode_endpoint(frames.encode_endpoint("tcp", "v1", "10.0.0.1", 80)) == ("tcp", "v1", "10.0.0.1", 80)
    with pytest.raises(frames.FrameError):
        frames.decode_endpoint("tcp://x")
    assert frames.load_config('[node]\nid = 3\n[telemetry]\nmode = "sampled"')["node"]["id"] == 3
    for bad in ("[x]\na = 1", "[node]\nid = true", '[node]\nid = "3"', "[node]\nnope = 1"):
        with pytest.raises(ValueError):
            frames.load_config(bad)
