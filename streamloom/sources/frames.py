"""Frames on the wire: header, optional trace, payload; length-prefixed streams; gap payloads and endpoints; configuration files."""

from __future__ import annotations

import struct
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass

from streamloom.functions.scalars import crc32c

MAGIC, VERSION, HEADER = 0x4C465257, 1, 80
HAS_TRACE, CONTROL, HAS_CRC = 1, 2, 4
_HEAD = ">IHHIIIIIIQQQQQII"  # magic version flags header_length topic type schema_ref schema_version layout node publisher epoch sequence time payload_length header_crc
_TRACE = ">QQIIQQ"
MAX_PAYLOAD = 16 << 20


class FrameError(ValueError):
    """The stream can't be read on from here."""


@dataclass(frozen=True)
class Frame:
    topic_id: int
    message_type: int
    schema_ref: int
    schema_version: int
    layout_version: int
    node_id: int
    publisher_id: int
    publisher_epoch: int
    sequence: int
    timestamp_ns: int
    payload: bytes = b""
    flags: int = 0
    trace: tuple | None = None


def encode(f: Frame) -> bytes:
    flags = f.flags | (HAS_TRACE if f.trace else 0)
    extra = (struct.pack(">I", crc32c(f.payload)) if flags & HAS_CRC else b"") + (struct.pack(_TRACE, *f.trace) if f.trace else b"")
    fields = (MAGIC, VERSION, flags, HEADER + len(extra), f.topic_id, f.message_type, f.schema_ref, f.schema_version, f.layout_version, f.node_id, f.publisher_id, f.publisher_epoch, f.sequence, f.timestamp_ns, len(f.payload))
    crc = crc32c(struct.pack(_HEAD, *fields, 0) + extra)
    return struct.pack(_HEAD, *fields, crc) + extra + f.payload


def decode(data: bytes) -> Frame:
    if len(data) < HEADER:
        raise FrameError("truncated header")
    magic, version, flags, header, *rest, size, crc = struct.unpack_from(_HEAD, data)
    extra = 4 * bool(flags & HAS_CRC) + struct.calcsize(_TRACE) * bool(flags & HAS_TRACE)
    if magic != MAGIC or version != VERSION or flags & ~7 or header != HEADER + extra or size > MAX_PAYLOAD or len(data) != header + size:
        raise FrameError("header fields")
    if crc32c(data[: HEADER - 4] + b"\0\0\0\0" + data[HEADER:header]) != crc:
        raise FrameError("header checksum")
    payload = data[header:]
    if flags & HAS_CRC and struct.unpack_from(">I", data, HEADER)[0] != crc32c(payload):
        raise FrameError("payload checksum")
    trace = struct.unpack_from(_TRACE, data, HEADER + 4 * bool(flags & HAS_CRC)) if flags & HAS_TRACE else None
    return Frame(*rest, payload=payload, flags=flags & ~HAS_TRACE, trace=trace)


class FrameStream:
    """Cuts a byte stream, pushed in any pieces, into frames by their length prefixes."""

    def __init__(self, most: int = MAX_PAYLOAD + 256):
        self.rest, self.most = b"", most

    def push(self, data: bytes) -> Iterator[Frame]:
        self.rest += data
        while len(self.rest) >= 4:
            size = struct.unpack_from(">I", self.rest)[0]
            if size > self.most:
                raise FrameError("frame too long")
            if len(self.rest) < 4 + size:
                return
            body, self.rest = self.rest[4 : 4 + size], self.rest[4 + size :]
            yield decode(body)

    def finish(self) -> None:
        if self.rest:
            raise FrameError("stream ends inside a frame")


def prefixed(f: Frame) -> bytes:
    body = encode(f)
    return struct.pack(">I", len(body)) + body


def encode_gap(first: int, last: int, reason: int) -> bytes:
    """What a gap record carries: the missing range and why, in 24 bytes."""
    if not 0 < first <= last:
        raise FrameError("gap range")
    return struct.pack("<QQHHI", first, last, reason, 1, 0)


def decode_gap(data: bytes) -> tuple[int, int, int]:
    if len(data) != 24:
        raise FrameError("gap payload size")
    first, last, reason, version, zero = struct.unpack("<QQHHI", data)
    if version != 1 or zero or not 0 < first <= last:
        raise FrameError("gap payload")
    return first, last, reason


def encode_endpoint(kind: str, protocol: str, address: str, port: int) -> str:
    return f"{kind}+{protocol}://{address}:{port}"


def decode_endpoint(text: str) -> tuple[str, str, str, int]:
    head, sep, rest = text.partition("://")
    kind, plus, protocol = head.partition("+")
    address, colon, port = rest.rpartition(":")
    if not (sep and plus and colon and kind and protocol and address and port.isdigit() and int(port) < 65536):
        raise FrameError(f"no endpoint: {text}")
    return kind, protocol, address, int(port)


#: What a configuration may say, with types; anything else is an error.
CONFIG = {"node": {"id": int, "trust_domain": str, "lease_seconds": int}, "recorder": {"directory": str, "mode": str, "topology": str, "partitions": int, "batch_records": int}, "telemetry": {"mode": str, "sample_rate_ppm": int, "max_events_per_second": int}}


def load_config(text: str) -> dict:
    """A TOML configuration, checked against CONFIG."""
    out = tomllib.loads(text)
    for section, values in out.items():
        if section not in CONFIG or not isinstance(values, dict):
            raise ValueError(f"unknown section {section}")
        for k, x in values.items():
            kind = CONFIG[section].get(k)
            if kind is None or not isinstance(x, kind) or isinstance(x, bool):
                raise ValueError(f"{section}.{k} is unknown or of the wrong type")
    return out
