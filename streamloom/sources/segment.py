"""The segment file: framed records with checksums, its scan and recovery, and a Spark data source."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from streamloom.functions.scalars import crc32c, crc32c_rows

#: The format's own marks, version and sizes.
SEGMENT_MAGIC, RECORD_MAGIC, COMMIT_MARK, VERSION = 0x4C474553, 0x4C474552, 0x54494D4D4F434745, 1
HEADER_SIZE, RECORD_HEADER, TRAILER, ALIGN = 52, 100, 28, 8
MAX_PAYLOAD = 64 << 20
GAP, TOMBSTONE = 1, 2

_SEGMENT = "<IHHQIIQQQ"  # then the checksum
_RECORD = "<IHHIIIIIQQQQQQQII"  # magic version flags schema_ref schema_version layout topic partition seq ts node publisher epoch source_seq observed payload_size payload_crc
SCHEMA = (
    "path string, offset long, flags int, schema_ref long, schema_version long, layout_version long, topic_id long, partition_id long, ingestion_sequence long, ingestion_ts_ns long, "
    "node_id long, publisher_id long, publisher_epoch long, source_sequence long, observed_ts_ns long, payload binary"
)


class SegmentError(ValueError):
    """reason is one of a fixed set of words."""

    def __init__(self, reason: str, offset: int = 0):
        super().__init__(f"{reason} at {offset}")
        self.reason, self.offset = reason, offset


@dataclass(frozen=True)
class SegmentHeader:
    recording_id: int
    topic_id: int
    partition_id: int
    writer_id: int
    first_sequence: int
    created_at_ns: int


@dataclass(frozen=True)
class Record:
    flags: int
    schema_ref: int
    schema_version: int
    layout_version: int
    topic_id: int
    partition_id: int
    ingestion_sequence: int
    ingestion_ts_ns: int
    node_id: int
    publisher_id: int
    publisher_epoch: int
    source_sequence: int
    observed_ts_ns: int
    payload: bytes = b""


def encode_header(h: SegmentHeader) -> bytes:
    raw = struct.pack(_SEGMENT, SEGMENT_MAGIC, VERSION, 0, h.recording_id, h.topic_id, h.partition_id, h.writer_id, h.first_sequence, h.created_at_ns)
    return raw + struct.pack("<I", crc32c(raw))


def decode_header(data: bytes) -> SegmentHeader:
    if len(data) < HEADER_SIZE:
        raise SegmentError("truncated_header")
    magic, version, flags, *rest = struct.unpack_from(_SEGMENT, data)
    for bad, reason in ((magic != SEGMENT_MAGIC, "header_magic"), (version != VERSION, "header_version"), (flags != 0, "header_flags"), (struct.unpack_from("<I", data, struct.calcsize(_SEGMENT))[0] != crc32c(data[: struct.calcsize(_SEGMENT)]), "header_checksum")):
        if bad:
            raise SegmentError(reason)
    return SegmentHeader(*rest)


def encoded_size(payload: int) -> int:
    return 8 + 4 + RECORD_HEADER + -(-payload // ALIGN) * ALIGN + TRAILER


def encode_record(r: Record) -> bytes:
    if r.flags & ~(GAP | TOMBSTONE) or len(r.payload) > MAX_PAYLOAD:
        raise SegmentError("unencodable")
    size = encoded_size(len(r.payload))
    head = struct.pack(_RECORD, RECORD_MAGIC, VERSION, r.flags, r.schema_ref, r.schema_version, r.layout_version, r.topic_id, r.partition_id, r.ingestion_sequence, r.ingestion_ts_ns, r.node_id, r.publisher_id, r.publisher_epoch, r.source_sequence, r.observed_ts_ns, len(r.payload), crc32c(r.payload))
    head += struct.pack("<I", crc32c(head)) + b"\0" * (RECORD_HEADER - len(head) - 4)
    body = struct.pack("<QI", size - 8, RECORD_HEADER) + head + r.payload + b"\0" * (-len(r.payload) % ALIGN)
    return body + struct.pack("<QQIQ", size - 8, r.ingestion_sequence, crc32c(body), COMMIT_MARK)


def decode_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """(record, its end); every length, mark and checksum is tested."""

    def need(ok: bool, reason: str) -> None:
        if not ok:
            raise SegmentError(reason, at)

    need(at + 12 + RECORD_HEADER + TRAILER <= len(data), "truncated_record")
    length, header = struct.unpack_from("<QI", data, at)
    need(header == RECORD_HEADER, "header_length")
    head = data[at + 12 : at + 12 + RECORD_HEADER]
    magic, version, flags, *rest = struct.unpack_from(_RECORD, head)
    need(magic == RECORD_MAGIC, "record_magic")
    need(version == VERSION, "record_version")
    need(flags & ~(GAP | TOMBSTONE) == 0, "record_flags")
    *values, size, payload_crc = rest
    need(struct.unpack_from("<I", head, struct.calcsize(_RECORD))[0] == crc32c(head[: struct.calcsize(_RECORD)]), "header_checksum")
    need(size <= MAX_PAYLOAD and encoded_size(size) == length + 8, "record_length")
    end = at + length + 8
    need(end <= len(data), "truncated_record")
    body, trailer = data[at : end - TRAILER], data[end - TRAILER : end]
    again, sequence, crc, mark = struct.unpack("<QQIQ", trailer)
    need(again == length, "trailer_length")
    need(sequence == values[5], "trailer_sequence")
    need(mark == COMMIT_MARK, "commit_mark")
    begin = at + 12 + RECORD_HEADER
    payload = data[begin : begin + size]
    need(not any(data[begin + size : end - TRAILER]), "padding")
    need(crc32c(payload) == payload_crc, "payload_checksum")
    need(crc32c(body) == crc, "record_checksum")
    return Record(flags, *values, payload), end


def scan(data: bytes, checkpoint: int | None = None) -> Iterator[tuple[int, Record | SegmentError]]:
    """(offset, record or what is wrong) of a whole file. After damage, the next place where a whole record decodes is sought."""
    at = checkpoint or HEADER_SIZE
    try:
        head = decode_header(data)
    except SegmentError as e:
        yield 0, e
        return
    expected = head.first_sequence if checkpoint is None else None
    while at < len(data):
        try:
            record, end = decode_record(data, at)
            if (record.topic_id, record.partition_id) != (head.topic_id, head.partition_id):
                raise SegmentError("identity", at)
            if expected is not None and record.ingestion_sequence != expected:
                raise SegmentError("sequence", at)
            expected = record.ingestion_sequence + 1
            yield at, record
            at = end
        except SegmentError as e:
            yield at, e
            mark = struct.pack("<I", RECORD_MAGIC)
            expected, found = None, data.find(mark, at + 13)
            while found >= 0:
                try:
                    decode_record(data, found - 12)
                    break
                except SegmentError:
                    found = data.find(mark, found + 1)
            if found < 0:
                return
            at = found - 12


#: The fields of a record's header, as _RECORD packs them.
_FIELDS = np.dtype([(n, f"<u{k}") for n, k in (
    ("magic", 4), ("version", 2), ("flags", 2), ("schema_ref", 4), ("schema_version", 4), ("layout_version", 4), ("topic_id", 4), ("partition_id", 4),
    ("ingestion_sequence", 8), ("ingestion_ts_ns", 8), ("node_id", 8), ("publisher_id", 8), ("publisher_epoch", 8), ("source_sequence", 8), ("observed_ts_ns", 8),
    ("size", 4), ("payload_crc", 4),
)])
#: Bytes of records that are tested together.
_TOGETHER = 16 << 20


def scan_clean(data: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """(offsets, header fields) of a file in which every record passes every test that decode_record and scan make; None for any other, which scan is for.

    Records of one length are tested side by side.
    """
    try:
        head = decode_header(data)
    except SegmentError:
        return None
    at, n, offsets = HEADER_SIZE, len(data), []
    least = encoded_size(0)
    while at < n:
        size = int.from_bytes(data[at : at + 8], "little") + 8
        if size < least or at + size > n:
            return None
        offsets.append(at)
        at += size
    places = np.array(offsets, np.int64)
    sizes = np.diff(np.append(places, n))
    raw, found = np.frombuffer(data, np.uint8), np.zeros(len(places), _FIELDS)
    packed = _FIELDS.itemsize
    for size in np.unique(sizes).tolist():
        every = np.flatnonzero(sizes == size)
        step = max(1, _TOGETHER // size)
        for own in (every[i : i + step] for i in range(0, len(every), step)):
            rows = sliding_window_view(raw, size)[places[own]]
            f = np.ascontiguousarray(rows[:, 12 : 12 + packed]).view(_FIELDS).ravel()
            number = lambda a, k, rows=rows: np.ascontiguousarray(rows[:, a : a + k]).view(f"<u{k}").ravel()
            whole = (number(8, 4) == RECORD_HEADER) & (f["magic"] == RECORD_MAGIC) & (f["version"] == VERSION) & (f["flags"] & ~np.uint16(GAP | TOMBSTONE) == 0)
            whole &= number(12 + packed, 4) == crc32c_rows(rows[:, 12 : 12 + packed])
            whole &= (f["size"] <= MAX_PAYLOAD) & (encoded_size(0) + -(-f["size"].astype(np.int64) // ALIGN) * ALIGN == size)
            tail = size - TRAILER
            whole &= (number(tail, 8) == size - 8) & (number(tail + 8, 8) == f["ingestion_sequence"]) & (number(tail + 20, 8) == COMMIT_MARK)
            if not whole.all() or not (number(tail + 16, 4) == crc32c_rows(rows[:, :tail])).all():
                return None
            begin = 12 + RECORD_HEADER
            for length in np.unique(f["size"]).tolist():
                same = f["size"] == length
                if rows[same, begin + length : tail].any() or not (crc32c_rows(rows[same, begin : begin + length]) == f["payload_crc"][same]).all():
                    return None
            found[own] = f
    sequence = found["ingestion_sequence"]
    if len(found) and not ((found["topic_id"] == head.topic_id) & (found["partition_id"] == head.partition_id) & (sequence == np.uint64(head.first_sequence) + np.arange(len(found), dtype=np.uint64))).all():
        return None
    return places, found


def disposition(data: bytes) -> tuple[str, int, int]:
    """(clean, incomplete_tail or corruption; whole records; where the good prefix ends)."""
    damage, records, good, after = None, 0, HEADER_SIZE, False
    for at, x in scan(data):
        if isinstance(x, SegmentError):
            damage = at if damage is None else damage
        else:
            records += 1
            after = after or damage is not None
            good = good if damage is not None else at + encoded_size(len(x.payload))
    if damage is None:
        return "clean", records, good
    return ("corruption" if after or damage == 0 else "incomplete_tail"), records, good if damage else 0


class _Reader(DataSourceReader):
    """Rows of segment files. One partition for each file; mode FAILFAST raises at damage, DROPMALFORMED passes over it."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        import glob
        import os

        path = self.options["path"]
        found = sorted(glob.glob(os.path.join(path, "**", "*.segment"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [InputPartition(p) for p in found]

    def read(self, partition):
        if partition.value is None:
            return
        with open(partition.value, "rb") as f:
            data = f.read()
        for at, x in scan(data):
            if isinstance(x, SegmentError):
                if self.options.get("mode", "FAILFAST").upper() == "FAILFAST":
                    raise x
                continue
            yield (partition.value, at, *(getattr(x, c.name) for c in fields(x)))


@dataclass
class _Written(WriterCommitMessage):
    paths: list


class _Open:
    """A segment that is being written: batches are appended until it is full."""

    def __init__(self, folder: str, recording: int, first: Record):
        import os
        import uuid

        self.path = os.path.join(folder, f"t{first.topic_id}-p{first.partition_id}-{first.ingestion_sequence:020d}-{uuid.uuid4().hex[:8]}.segment")
        self.file = open(self.path + ".part", "wb")
        self.file.write(encode_header(SegmentHeader(recording, first.topic_id, first.partition_id, 1, first.ingestion_sequence, first.ingestion_ts_ns)))
        self.size, self.records, self.began, self.last = HEADER_SIZE, 0, first.ingestion_ts_ns, first.ingestion_sequence - 1

    def takes(self, r: Record, limits: tuple[int, int, int]) -> bool:
        """Whether the next record follows the last one and none of the limits (bytes, records, nanoseconds) is passed; an empty segment takes any."""
        most_bytes, most_records, most_ns = limits
        fits = self.size + encoded_size(len(r.payload)) <= most_bytes and self.records < most_records and r.ingestion_ts_ns - self.began < most_ns
        return r.ingestion_sequence == self.last + 1 and (fits or not self.records)

    def append(self, r: Record) -> None:
        data = encode_record(r)
        self.file.write(data)
        self.size, self.records, self.last = self.size + len(data), self.records + 1, r.ingestion_sequence

    def close(self) -> str:
        import os

        self.file.flush()
        os.fsync(self.file.fileno())
        self.file.close()
        return self.path


class _Writer(DataSourceWriter):
    """The segments of a task's rows by topic and partition, each written beside its name and moved on commit.

    Rows wait in batches of at most `batch` records, sorted by sequence before they are appended. A segment ends where
    its limits (max_bytes, max_records, max_ns) or a break in the sequence say so. Sort rows within partitions for long segments.
    """

    def __init__(self, options: dict, schema: StructType):
        self.options, self.names = dict(options), [f.name for f in schema]

    def write(self, iterator):
        import os

        option = lambda name, default: int(self.options.get(name, default))
        folder, limits = self.options["path"], (option("max_bytes", 128 << 20), option("max_records", 1 << 62), option("max_ns", 1 << 62))
        os.makedirs(folder, exist_ok=True)
        waiting: dict[tuple, list[Record]] = {}
        segments: dict[tuple, _Open] = {}
        paths, held, most = [], 0, option("batch", 4096)

        def drain() -> None:
            for key, records in waiting.items():
                for r in sorted(records, key=lambda r: r.ingestion_sequence):
                    if key in segments and not segments[key].takes(r, limits):
                        paths.append(segments.pop(key).close())
                    if key not in segments:
                        segments[key] = _Open(folder, option("recording_id", 1), r)
                    segments[key].append(r)
            waiting.clear()

        for row in iterator:
            r = dict(zip(self.names, row, strict=True))
            record = Record(**{f.name: r[f.name] for f in fields(Record) if f.name in r})
            waiting.setdefault((record.topic_id, record.partition_id), []).append(record)
            held += 1
            if held >= most:
                drain()
                held = 0
        drain()
        return _Written([*paths, *(x.close() for x in segments.values())])

    def commit(self, messages):
        import os

        for m in messages:
            for p in m.paths if m else ():
                os.replace(p + ".part", p)

    def abort(self, messages):
        import contextlib
        import os

        for m in messages:
            for p in m.paths if m else ():
                with contextlib.suppress(OSError):
                    os.remove(p + ".part")


class SegmentSource(DataSource):
    """spark.read.format("segment").load(folder), df.write.format("segment").mode("append").save(folder), on a file system that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "segment"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema)


def read_segments(spark: SparkSession, path: str, findings: bool = False) -> DataFrame:
    """Records of segment files in any store that Spark reads; with findings, a row for every damage too (reason not null)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.segment").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = to_arrow_schema(T._parse_datatype_string(SCHEMA + ", reason string"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                clean = scan_clean(data)
                if clean is None:
                    rows = []
                    for at, x in scan(data):
                        if isinstance(x, SegmentError):
                            if not findings:
                                raise x
                            rows.append({"path": p, "offset": at, "reason": x.reason})
                        else:
                            rows.append({"path": p, "offset": at, "reason": None, **{f.name: getattr(x, f.name) for f in fields(x)}})
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    continue
                places, found = clean
                for i in range(0, len(places), 10_000):
                    at, f = places[i : i + 10_000], found[i : i + 10_000]
                    begins = (at + 12 + RECORD_HEADER).tolist()
                    known = {"path": [p] * len(at), "offset": at, "reason": [None] * len(at), "payload": [data[b : b + k] for b, k in zip(begins, f["size"].tolist(), strict=True)]}
                    yield pa.RecordBatch.from_arrays([pa.array(known[c.name] if c.name in known else f[c.name].astype(np.int64), c.type) for c in kinds], schema=kinds)

    out = files.mapInArrow(decode, SCHEMA + ", reason string")
    return out if findings else out.drop("reason")


def recovery(spark: SparkSession, path: str) -> DataFrame:
    """path, records, damage (first bad offset) and disposition of every file."""
    from streamloom.operators.storage import disposition as by_file

    found = read_segments(spark, path, findings=True)
    return by_file(found.select("path", "offset", F.col("reason").isNull().alias("valid")))
