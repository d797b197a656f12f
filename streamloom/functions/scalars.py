"""Scalar functions of the wire format, the schema system and telemetry, as column expressions where Spark has the arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = 1 << 64


def zigzag(v: Column) -> Column:
    """Signed to unsigned bits (as a bigint): small absolute values become small."""
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(F.when(u.bitwiseAND(1) == 1, F.lit(-1)).otherwise(F.lit(0)).cast("bigint"))


def bit_length(v: Column) -> Column:
    """Bits up to the highest one, of a bigint's 64 bits; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def varint_length(v: Column) -> Column:
    """Bytes of the minimal LEB128 form of a bigint's 64 bits."""
    return F.greatest(F.lit(1), F.ceil(bit_length(v) / 7).cast("int"))


def log2_bucket(v: Column) -> Column:
    """0 for 0, else the bit length: bucket b ends at 2^b - 1."""
    return bit_length(v).cast("int")


def pack_version(major: Column, minor: Column) -> Column:
    return F.shiftleft(major.cast("bigint"), 16).bitwiseOR(minor.cast("bigint"))


def version_major(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 16)


def version_minor(packed: Column) -> Column:
    return packed.bitwiseAND(0xFFFF)


def parse_version(text: Column) -> Column:
    """"major.minor", decimal without leading zeros and at most 65535 each, packed; null if it isn't that."""
    ok = text.rlike(r"^(0|[1-9][0-9]{0,4})\.(0|[1-9][0-9]{0,4})$")
    major, minor = (F.when(ok, F.split_part(text, F.lit("."), F.lit(i))).cast("bigint") for i in (1, 2))
    return F.when(ok & (major <= 65535) & (minor <= 65535), pack_version(major, minor))


def saturating_add(a: Column, b: Column, most: int = U64 - 1) -> Column:
    """In decimal(20,0), at most `most`."""
    return F.least(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"), F.lit(str(most)).cast("decimal(38,0)")).cast("decimal(20,0)")


def saturating_multiply(a: Column, b: Column, most: int = U64 - 1) -> Column:
    """In decimal(20,0), at most `most`, however large the product of the two."""
    wide = F.try_multiply(a.cast("decimal(38,0)"), b.cast("decimal(38,0)"))
    return F.least(F.coalesce(wide.cast("decimal(38,0)"), F.lit(str(most)).cast("decimal(38,0)")), F.lit(str(most)).cast("decimal(38,0)")).cast("decimal(20,0)")


def align_up(v: Column, step: int) -> Column:
    return (F.floor((v + (step - 1)) / step) * step).cast("bigint")


def encoded_record_size(payload: Column) -> Column:
    """Bytes of a framed record: two length fields and the header, the payload padded to 8, the trailer."""
    return (F.lit(8 + 4 + 100) + align_up(payload, 8) + F.lit(28)).cast("bigint")


def backoff_delay(initial: int, most: int, attempt: Column) -> Column:
    """initial doubled for each attempt after the first, at most `most`."""
    return F.least(F.lit(initial) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(62))), F.lit(float(most))).cast("bigint")


def digest_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def short_id(digest: Column) -> Column:
    """The first 8 bytes of a hex digest, little endian, as decimal(20,0)."""
    pairs = [F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)]
    high, low = F.conv(F.concat(*pairs[:4]), 16, 10), F.conv(F.concat(*pairs[4:]), 16, 10)
    return (high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + low.cast("decimal(20,0)")).cast("decimal(20,0)")


# The increment, multipliers and shifts of the 64-bit mixer that sampling has to agree on.
MIX_INCREMENT, MIX_FIRST, MIX_SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MIX_SHIFTS = (30, 27, 31)


def mix64(x: np.ndarray) -> np.ndarray:
    a, b, c = map(np.uint64, MIX_SHIFTS)
    x = x + np.uint64(MIX_INCREMENT)
    x = (x ^ (x >> a)) * np.uint64(MIX_FIRST)
    x = (x ^ (x >> b)) * np.uint64(MIX_SECOND)
    return x ^ (x >> c)


def stable_hash(topic: np.ndarray, source: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """The sampling hash of (topic, source, sequence), the same on every node."""
    t, s, q = (x.astype(np.int64).view(np.uint64) for x in (topic, source, sequence))
    return mix64(mix64(mix64(t) ^ s) ^ q)


def sample_point(topic: Column, source: Column, sequence: Column) -> Column:
    """stable_hash modulo a million: an event is sampled at a rate of ppm if this is less. Null if an input is."""

    @F.pandas_udf("bigint")
    def point(t: pd.Series, s: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series((stable_hash(t.to_numpy(), s.to_numpy(), q.to_numpy()) % np.uint64(1_000_000)).astype(np.int64))

    return point(F.coalesce(topic, F.lit(0)), F.coalesce(source, F.lit(0)), F.coalesce(sequence, F.lit(0)))


def sampled(topic: Column, source: Column, sequence: Column, ppm: int) -> Column:
    """At 0 nothing, at a million and more everything, and no hash is taken for either."""
    if ppm <= 0:
        return F.lit(False)
    return F.lit(True) if ppm >= 1_000_000 else sample_point(topic, source, sequence) < ppm


def crc32c_table() -> np.ndarray:
    """Of the reflected Castagnoli polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


_CRC = [int(x) for x in crc32c_table()]
#: Bytes that are looked up together.
_SLICE = 256


def _slices() -> tuple[np.ndarray, list[list[int]]]:
    """What each byte in each place of a slice adds to the checksum, and what each byte of the checksum before the slice does."""
    table = crc32c_table()
    on = lambda x: (x >> np.uint32(8)) ^ table[x & np.uint32(255)]
    places = [table]
    for _ in range(_SLICE - 1):
        places.append(on(places[-1]))
    carried = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for _ in range(_SLICE):
        carried = [on(x) for x in carried]
    return np.stack(places[::-1]), [x.tolist() for x in carried]


_PLACES, _CARRIED = _slices()


def crc32c(data: bytes, crc: int = 0) -> int:
    """The checksum is linear, so whole slices are looked up at once and then chained; the rest goes byte by byte."""
    crc ^= 0xFFFFFFFF
    whole = len(data) // _SLICE * _SLICE
    if whole:
        parts = np.frombuffer(data, np.uint8, whole).reshape(-1, _SLICE)
        a, b, c, d = _CARRIED
        for at in range(0, len(parts), 4096):
            for x in np.bitwise_xor.reduce(_PLACES[np.arange(_SLICE), parts[at : at + 4096]], axis=1).tolist():
                crc = x ^ a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]
    for x in data[whole:]:
        crc = _CRC[(crc ^ x) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def crc32c_rows(rows: np.ndarray) -> np.ndarray:
    """The checksums of byte strings of one length, a row each: what came before a slice is folded into its first four bytes."""
    state = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for at in range(0, rows.shape[1], _SLICE):
        part = rows[:, at : at + _SLICE].copy()
        n = part.shape[1]
        if n >= 4:
            part[:, :4] ^= state.astype("<u4").view(np.uint8).reshape(-1, 4)
            state = np.bitwise_xor.reduce(_PLACES[np.arange(_SLICE - n, _SLICE), part], axis=1)
        else:
            for k in range(n):
                state = (state >> np.uint32(8)) ^ _PLACES[-1][(state ^ part[:, k]) & np.uint32(255)]
    return state ^ np.uint32(0xFFFFFFFF)


def crc32c_column(data: Column) -> Column:
    """CRC-32C of binary values (Spark's own crc32 is another polynomial)."""

    @F.pandas_udf("bigint")
    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else crc32c(bytes(x))).astype("Int64")

    return of(data)


def metric_name_valid(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_:][A-Za-z0-9_:]*$") & (F.octet_length(name) < 64)


def identifier_valid(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")


def full_name_valid(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$")


#: The slot sizes of the default classes, and of the recorder's fixed buffer classes, in bytes.
SLOT_CLASSES = (64, 256, 2048, 65536)
BUFFER_CLASSES = (4 << 10, 64 << 10, 1 << 20)


def slot_class(size: Column, classes=SLOT_CLASSES) -> Column:
    """The smallest class that holds size; null if none does."""
    return F.coalesce(*[F.when(size <= c, F.lit(c)) for c in sorted(classes)], F.lit(None).cast("int"))


def charged_bytes(size: Column, most: int = 16 << 20, classes=BUFFER_CLASSES) -> Column:
    """What a payload is charged: nothing, its class, or whole steps of the smallest class; null above most."""
    step = min(classes)
    fixed = [F.when(size <= c, F.lit(c)) for c in sorted(classes)]
    return F.when(size == 0, 0).otherwise(F.coalesce(*fixed, F.when(size <= most, F.least(align_up(size, step), F.lit(most))))).cast("bigint")
