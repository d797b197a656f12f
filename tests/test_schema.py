"""Interface language, identity, compatibility, registry and wire format."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from streamloom.schema import language, registry, wire
from streamloom.schema.model import SchemaError, dataclass_source, layout, struct_type, type_footprint

HEAD = 'syntax = "v1";\npackage demo;\noption schema_version = "1.0";\n'
POINT = HEAD + "struct Point { float x = 1; float y = 2; }"
FRAME = HEAD + 'import "point";\n/* block */ message Frame { // line\n required uint32 id = 1; optional string name = 2 [max_bytes = 64, default = "a\\x00b"]; vector<demo.Point> points = 3 [max_capacity = 3]; bytes raw = 4 [max_bytes = 8]; reserved 6 to 7, 9; }'


def build(body, version="1.0", **more):
    return language.compile_files("f", {"f": f'package p; option schema_version = "{version}"; message M {{ {body} }}'}, **more)["p.M"]


def test_compiles_with_imports():
    found = language.compile_files("f", {"f": FRAME, "point": POINT})
    frame = found["demo.Frame"]
    assert set(found) == {"demo.Frame", "demo.Point"} and frame.version == 1 << 16
    assert dict(frame.dependencies) == {"demo.Point": found["demo.Point"].digest}
    assert frame.short_id == int.from_bytes(bytes.fromhex(frame.digest)[:8], "little")
    moved = language.compile_files("g", {"g": FRAME.replace('"point"', '"else/where"'), "else/where": POINT})
    assert moved["demo.Frame"].digest == frame.digest
    renamed = language.compile_files("f", {"f": FRAME.replace(" id = 1", " other = 1"), "point": POINT})
    assert renamed["demo.Frame"].digest == frame.digest
    kind = struct_type(frame, found)
    assert kind["id"].dataType == T.LongType() and kind["name"].nullable and not kind["id"].nullable
    assert kind["points"].dataType.elementType.fieldNames() == ["x", "y"] and kind["name"].metadata["max_bytes"] == 64
    assert "class Frame" in (source := dataclass_source(frame)) and "name: str | None = None" in source
    compile(source.replace("@dataclass", ""), "x", "exec")
    assert type_footprint(frame.aggregate, found) == 4 + 64 + 3 * 8 + 8
    assert layout(found["demo.Point"].aggregate, found) == ([("x", 0, 4), ("y", 4, 4)], 8)


@pytest.mark.parametrize(("source", "kind"), [
    ("message M { int32 a = 1 }", "parse"), ("message M { int32 a = 0; }", "field"), ("message M { int32 a = 1; int32 b = 1; }", "field"), ("message M { int32 a = 1; int64 a = 2; }", "field"),
    ("message M { string a = 1; }", "limit"), ("message M { int32 a = 1 [max_bytes = 3]; }", "limit"), ("message M { vector<int32> a = 1; }", "limit"), ("message M { int32 a = 5; reserved 4 to 6; }", "field"),
    ("message M { reserved 4 to 6, 5; }", "reserved"), ("message M { int32 a = 1 [default = 3000000000]; }", "default"), ("message M { int32 a = 1 [default = \"x\"]; }", "default"), ("message M { int32 a = 1 [nope]; }", "annotation"),
    ("message M { int32 a = 1 []; }", "parse"), ("message M { int32 a = 1 [snapshot_key,]; }", "parse"), ("message M { Other a = 1; }", "type"), ("message M { M a = 1; }", "type"), ("struct S { string a = 1 [max_bytes = 3]; }", "struct"),
    ("package a; package b;", "parse"), ('message M { string a = 1 [max_bytes = 9, default = "\\q"]; }', "lex"), ('message M { string a = 1 [max_bytes = 9, default = "\\ud800"]; }', "lex"), ("message M { string a = 1 [max_bytes = 1, default = \"ab\"]; }", "default"),
    ('message M { string a = 1 [max_bytes = 9, default = "\\xff"]; }', "default"), ("message M { int32 a = 0x1; }", "lex"), ("#", "lex"), ('option schema_version = "01.0"; message M { int32 a = 1; }', "version"), ("message M { vector<bytes> a = 1 [max_bytes = 1000000, max_capacity = 1000000]; }", "limit"),
    ('import "lost"; message M { int32 a = 1; }', "import"), ("message A { B b = 1; } message B { A a = 1; }", "type"), ("struct S { M m = 1; } message M { int32 a = 1; }", "struct"), (b"\xff", "lex"),
])
def test_errors(source, kind):
    with pytest.raises(SchemaError) as e:
        language.compile_files("f", {"f": source})
    assert e.value.kind == kind


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n{}[]()<>=;,.+-\"\\/*x19aé_messagvctorint", max_size=80))
def test_any_text_parses_or_fails_cleanly(text):
    try:
        language.parse(text)
    except SchemaError:
        pass


def test_compatibility_cases():
    check = lambda a, b: registry.compatibility(build(a), build(b, "1.1"))
    text = "string a = 1 [max_bytes = {}]; string b = 2 [max_bytes = {}];"
    assert check(text.format(64, 64), text.format(32, 64)) == "write"
    assert check(text.format(32, 64), text.format(64, 64)) == "read"
    assert check(text.format(32, 64), text.format(64, 32)) == "incompatible"
    assert check("int32 a = 1;", "int32 a = 1; optional int32 b = 2;") == "wire"
    assert check("int32 a = 1;", "int32 a = 1; int32 b = 2;") == "incompatible"
    assert check("int32 a = 1; optional int32 b = 2;", "int32 a = 1; reserved 2;") == "wire"
    assert check("int32 a = 1; optional int32 b = 2;", "int32 a = 1;") == "incompatible"
    assert check("int32 a = 1; reserved 2;", "int32 a = 1; optional int32 b = 2;") == "incompatible"
    assert check("int32 a = 1;", "int32 renamed = 1;") == "identical"
    assert check("int32 a = 1;", "int64 a = 1;") == "incompatible"
    nested = 'package p; option schema_version = "1.0"; struct N {{ {} x = 1; }} message M {{ N n = 1; }}'
    old, new = (language.compile_files("f", {"f": nested.format(k)}) for k in ("int32", "int64"))
    assert registry.compatibility(old["p.M"], new["p.M"], [*old.values(), *new.values()]) == "incompatible"


def test_registry(spark):
    r = registry.SchemaRegistry()
    first = r.register(build("int32 a = 1;"))
    assert r.register(build("int32 other = 1;")) is first
    with pytest.raises(SchemaError):
        r.register(build("int32 a = 1; optional int32 b = 2;"))
    with pytest.raises(SchemaError):
        r.register(build("int64 a = 1;", "1.1"))
    second = r.register(build("int32 a = 1; optional int32 b = 2;", "1.1"))
    assert r.find("p.M") is second and r.find("p.M", 1 << 16) is first and r.find("p.X") is None
    assert r.find_short(first.short_id) is first and r.find_short(1) is None
    assert [s.name for s in r.register_source("g", {"g": 'package q; message Z { required int32 a = 1; }'})] == ["q.Z"]
    schemas, fields, uses = r.tables(spark)
    assert (schemas.count(), fields.count(), uses.count()) == (3, 4, 0)


WIRE = 'package fuzz; option schema_version = "1.0"; message Payload { int32 delta = 1; uint64 sequence = 2; fixed32 code = 3; float sample = 4; optional string label = 5 [max_bytes = 32]; vector<uint32> values = 6 [max_capacity = 4]; }'
GOLDEN = bytes.fromhex("080110ac021d12345678253412c07f2a02c3a9320503017f8001")


def codec(source=WIRE, name="fuzz.Payload"):
    found = language.compile_files("f", {"f": source})
    return wire.Codec(found[name], found)


def test_wire_golden():
    c = codec()
    message = {"delta": -1, "sequence": 300, "code": 0x78563412, "sample": struct.pack("<I", 0x7FC01234), "label": "é", "values": [1, 127, 128]}
    assert c.encode(message) == GOLDEN
    out = c.decode(GOLDEN)
    assert out.pop("sample") != 0 and out == {k: v for k, v in message.items() if k != "sample"}
    with_unknown = GOLDEN + wire.varint(9 << 3 | 2) + b"\x01z"
    got = c.decode(with_unknown)
    assert got["_unknown"] == [(9, with_unknown[len(GOLDEN) :])]
    got["sample"] = message["sample"]
    assert c.encode(got) == with_unknown


@pytest.mark.parametrize("data", [GOLDEN[:-1], GOLDEN + b"\x08\x01", b"\x10\xac\x02\x08\x01", GOLDEN.replace(b"\x08\x01", b"\x08\x81\x00", 1), b"\x0b", b"\x00\x00", GOLDEN.replace(b"\xc3\xa9", b"\xff\xff"), b"\x08" + b"\xff" * 10])
def test_wire_corruption(data):
    with pytest.raises(wire.WireError):
        codec().decode(data)


def test_every_truncation_fails():
    for n in range(len(GOLDEN)):
        with pytest.raises(wire.WireError):
            codec().decode(GOLDEN[:n])


@settings(max_examples=100, deadline=None)
@given(st.integers(-(1 << 31), (1 << 31) - 1), st.integers(0, (1 << 64) - 1), st.integers(0, (1 << 32) - 1), st.floats(width=32, allow_nan=False), st.none() | st.text(max_size=8), st.lists(st.integers(0, (1 << 32) - 1), max_size=4))
def test_wire_round_trip(delta, sequence, code, sample, label, values):
    m = {"delta": delta, "sequence": sequence, "code": code, "sample": sample, "label": label, "values": values}
    assert codec().decode(codec().encode(m)) == m


def test_wire_columns(spark):
    found = language.compile_files("f", {"f": WIRE})
    schema = found["fuzz.Payload"]
    frame = spark.createDataFrame([(1, bytearray(GOLDEN)), (2, None), (3, bytearray(b"\x0b"))], "i int, raw binary")
    got = {r.i: r.m for r in frame.select("i", wire.decoded(frame.raw, schema, found, "null").alias("m")).collect()}
    assert got[1].delta == -1 and got[1].label == "é" and got[1]["values"] == [1, 127, 128] and got[2] is None
    nan_free = spark.createDataFrame([(bytearray(GOLDEN.replace(bytes.fromhex("253412c07f"), bytes.fromhex("250000803f"))),)], "raw binary")
    again = nan_free.select("raw", wire.encoder(schema, found)(wire.decoded(nan_free.raw, schema, found)).alias("again")).first()
    assert bytes(again.raw) == bytes(again.again)
