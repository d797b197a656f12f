"""Schema descriptors: types, fields, aggregates, and what they are in Spark."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: The scalar types of the interface language.
INTEGERS = {"int32": (-(1 << 31), (1 << 31) - 1), "int64": (-(1 << 63), (1 << 63) - 1), "uint32": (0, (1 << 32) - 1), "uint64": (0, (1 << 64) - 1), "fixed32": (0, (1 << 32) - 1), "fixed64": (0, (1 << 64) - 1)}
SCALARS = (*INTEGERS, "float", "double", "bool", "string", "bytes")
MAX_FIELD_ID = 536_870_911

SPARK = {
    "int32": T.IntegerType(), "int64": T.LongType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "fixed32": T.LongType(), "fixed64": T.DecimalType(20, 0),
    "float": T.FloatType(), "double": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType(),
}


class SchemaError(ValueError):
    """What is wrong and where (line and column, or a name)."""

    def __init__(self, kind: str, message: str, where: object = ""):
        super().__init__(f"{kind}: {message}" + (f" at {where}" if where else ""))
        self.kind = kind


@dataclass(frozen=True)
class Type:
    """A scalar, a vector of element, or a user's type by full name."""

    name: str
    element: Type | None = None

    @property
    def is_vector(self) -> bool:
        return self.element is not None

    @property
    def is_scalar(self) -> bool:
        return not self.is_vector and self.name in SCALARS

    def users(self) -> set[str]:
        return self.element.users() if self.element else set() if self.is_scalar else {self.name}

    def text(self) -> str:
        if self.element:
            return f"vector<{self.element.text()}>"
        return self.name if self.is_scalar else f"type({len(self.name.encode())}):{self.name}"


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: Type
    cardinality: str = "unspecified"  # or optional, required
    max_bytes: int | None = None
    max_capacity: int | None = None
    snapshot_key: bool = False
    default: tuple[str, bytes] | None = None  # (kind, canonical value)
    where: object = field(default="", compare=False)

    @property
    def optional(self) -> bool:
        return self.cardinality == "optional"

    def constraint_text(self) -> str:
        parts = [f"cardinality={self.cardinality}"]
        parts += [f"{n}={x}" for n, x in (("max_bytes", self.max_bytes), ("max_capacity", self.max_capacity)) if x is not None]
        return ",".join(sorted(parts + ["snapshot_key"] * self.snapshot_key))

    def default_text(self) -> bytes:
        if self.default is None:
            return b"-"
        kind, value = self.default
        if kind in ("string", "bytes"):
            return f"{kind}({len(value)}):".encode() + (value if kind == "string" else value.hex().encode())
        return f"{kind}:".encode() + value


@dataclass(frozen=True)
class Aggregate:
    kind: str  # message or struct
    name: str  # full
    fields: tuple[Field, ...]
    reserved: tuple[tuple[int, int], ...] = ()

    def field(self, key: int | str) -> Field | None:
        return next((f for f in self.fields if key in (f.id, f.name)), None)

    def is_reserved(self, number: int) -> bool:
        return any(a <= number <= b for a, b in self.reserved)

    def uses(self) -> set[str]:
        return set().union(*(f.type.users() for f in self.fields))


@dataclass(frozen=True)
class Schema:
    """An aggregate with its identity: the digest of its canonical text over everything it depends on."""

    aggregate: Aggregate
    version: int
    layout: int
    dependencies: tuple[tuple[str, str], ...]  # (full name, digest), sorted
    digest: str
    text: bytes = b""

    @property
    def name(self) -> str:
        return self.aggregate.name

    @property
    def short_id(self) -> int:
        return int.from_bytes(bytes.fromhex(self.digest)[:8], "little")


def canonical_text(aggregate: Aggregate, dependencies) -> bytes:
    """Names of fields are left out, so a renamed field keeps the identity."""
    out = [b"schema-canonical-v1\0", f"type:{aggregate.kind}:{len(aggregate.name.encode())}:{aggregate.name}\n".encode()]
    for f in sorted(aggregate.fields, key=lambda f: f.id):
        out.append(f"{f.id}:{f.type.text()}:{f.constraint_text()}:".encode() + f.default_text() + b"\n")
    ranges: list[list[int]] = []
    for a, b in sorted(aggregate.reserved):
        if ranges and ranges[-1][1] + 1 == a:
            ranges[-1][1] = b
        else:
            ranges.append([a, b])
    if ranges:
        out.append(b"reserved:" + ",".join(f"{a}-{b}" for a, b in ranges).encode() + b"\n")
    out += [f"dependency:{len(n.encode())}:{n}:{d}\n".encode() for n, d in sorted(dependencies)]
    return b"".join(out)


def identified(aggregate: Aggregate, version: int, layout: int, dependencies) -> Schema:
    text = canonical_text(aggregate, dependencies)
    return Schema(aggregate, version, layout, tuple(sorted(dependencies)), hashlib.sha256(text).hexdigest(), text)


def spark_type(kind: Type, schemas: dict[str, Schema]) -> T.DataType:
    if kind.element:
        return T.ArrayType(spark_type(kind.element, schemas), False)
    return SPARK[kind.name] if kind.is_scalar else struct_type(schemas[kind.name], schemas)


def struct_type(schema: Schema, schemas: dict[str, Schema]) -> T.StructType:
    """The StructType of a schema; field ids and limits are column metadata."""
    out = []
    for f in schema.aggregate.fields:
        about = {"field_id": f.id, "cardinality": f.cardinality, "snapshot_key": f.snapshot_key}
        about |= {n: x for n, x in (("max_bytes", f.max_bytes), ("max_capacity", f.max_capacity)) if x is not None}
        out.append(T.StructField(f.name, spark_type(f.type, schemas), f.optional, about))
    return T.StructType(out)


def dataclass_source(schema: Schema) -> str:
    """Python source of a dataclass with the schema's fields."""
    hints = {"string": "str", "bytes": "bytes", "bool": "bool", "float": "float", "double": "float"}

    def hint(t: Type) -> str:
        return f"list[{hint(t.element)}]" if t.element else hints.get(t.name, "int") if t.is_scalar else f'"{t.name.rpartition(".")[2]}"'

    fields = sorted(schema.aggregate.fields, key=lambda f: f.optional)
    lines = [f"    {f.name}: {hint(f.type)} | None = None" if f.optional else f"    {f.name}: {hint(f.type)}" for f in fields]
    return "\n".join(["@dataclass", f"class {schema.name.rpartition('.')[2]}:", *(lines or ["    pass"])]) + "\n"


def footprint(kind: Type, f: Field, schemas: dict[str, Schema]) -> int:
    """Bytes that a field's largest value takes."""
    sizes = {"int32": 4, "uint32": 4, "fixed32": 4, "float": 4, "bool": 1}
    if kind.element:
        return (f.max_capacity or 0) * footprint(kind.element, f, schemas)
    if kind.name in ("string", "bytes"):
        return f.max_bytes or 0
    if kind.is_scalar:
        return sizes.get(kind.name, 8)
    return type_footprint(schemas[kind.name].aggregate, schemas)


def type_footprint(aggregate: Aggregate, schemas: dict[str, Schema]) -> int:
    return sum(footprint(f.type, f, schemas) for f in aggregate.fields)


def layout(aggregate: Aggregate, schemas: dict[str, Schema]) -> tuple[list[tuple[str, int, int]], int]:
    """(name, offset, size) of each field, aligned to its size of at most 8, and the whole size."""
    out, at = [], 0
    for f in aggregate.fields:
        size = max(1, footprint(f.type, f, schemas))
        step = min(8, 1 << max(0, size.bit_length() - 1)) if f.type.is_scalar else 8
        at = -(-at // step) * step
        out.append((f.name, at, size))
        at += size
    return out, -(-at // 8) * 8


def default_value(kind: str, token_kind: str, value) -> tuple[str, bytes]:
    """The canonical form of a default: normal integers, the bits of floats, raw text."""
    if kind in INTEGERS and token_kind == "int" and INTEGERS[kind][0] <= value <= INTEGERS[kind][1]:
        return "integer", str(value).encode()
    if kind in ("float", "double") and token_kind in ("int", "float"):
        try:
            return ("float32" if kind == "float" else "float64"), struct.pack(">f" if kind == "float" else ">d", value).hex().encode()
        except OverflowError:
            pass
    if kind == "bool" and token_kind == "bool":
        return "boolean", b"true" if value else b"false"
    if kind == "string" and token_kind == "string":
        try:
            value.decode()
            return "string", value
        except UnicodeDecodeError:
            pass
    if kind == "bytes" and token_kind == "string":
        return "bytes", value
    raise SchemaError("default", f"not a value of {kind}")


