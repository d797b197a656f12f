"""The interface language: text to tokens, tokens to declarations, declarations to schemas."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from .model import MAX_FIELD_ID, SCALARS, Aggregate, Field, Schema, SchemaError, Type, default_value, identified, type_footprint

MAX_SOURCE, MAX_DEPTH, MAX_FOOTPRINT = 1 << 20, 32, 64 << 20

_TOKEN = re.compile(
    r"(?P<space>[ \t\r\n]+|//[^\n]*|/\*.*?\*/)|(?P<float>[0-9]+(?:\.[0-9]+(?:[eE][+-]?[0-9]+)?|[eE][+-]?[0-9]+))(?![\w.])|(?P<int>0|[1-9][0-9]*)(?![\w.])"
    r'|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<string>"(?:[^"\\\x00-\x1f\x7f]|\\.)*")|(?P<mark>[{}\[\]()<>=;,.+-])',
    re.S,
)
_ESCAPES = {'"': b'"', "\\": b"\\", "/": b"/", "b": b"\b", "f": b"\f", "n": b"\n", "r": b"\r", "t": b"\t"}


@dataclass(frozen=True)
class Token:
    kind: str
    value: object
    where: str


def _unescaped(body: str, where: str) -> bytes:
    out, i = bytearray(), 0
    while i < len(body):
        if body[i] != "\\":
            out += body[i].encode()
            i += 1
            continue
        c = body[i + 1]
        digits = {"x": 2, "u": 4}.get(c)
        if c in _ESCAPES:
            out += _ESCAPES[c]
            i += 2
        elif digits and re.fullmatch(rf"[0-9a-fA-F]{{{digits}}}", body[i + 2 : i + 2 + digits]):
            code = int(body[i + 2 : i + 2 + digits], 16)
            if c == "u" and 0xD800 <= code < 0xE000:
                raise SchemaError("lex", "surrogate in string", where)
            out += bytes([code]) if c == "x" else chr(code).encode()
            i += 2 + digits
        else:
            raise SchemaError("lex", "unknown escape", where)
    return bytes(out)


def tokenise(source: str | bytes) -> list[Token]:
    if isinstance(source, bytes):
        try:
            source = source.decode()
        except UnicodeDecodeError as e:
            raise SchemaError("lex", "not UTF-8") from e
    if len(source) > MAX_SOURCE:
        raise SchemaError("lex", "source too long")
    out, at, line, line_start = [], 0, 1, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        where = f"{line}:{at - line_start + 1}"
        if not m:
            raise SchemaError("lex", f"unexpected {source[at]!r}", where)
        kind, text = m.lastgroup, m[0]
        if kind != "space":
            value = int(text) if kind == "int" else float(text) if kind == "float" else _unescaped(text[1:-1], where) if kind == "string" else text
            out.append(Token(kind, value, where))
        line += text.count("\n")
        if "\n" in text:
            line_start = at + text.rindex("\n") + 1
        at = m.end()
    return [*out, Token("end", "", f"{line}:{at - line_start + 1}")]


@dataclass
class File:
    package: str = ""
    syntax: str | None = None
    imports: list[str] = field(default_factory=list)
    options: dict[str, object] = field(default_factory=dict)
    aggregates: list[Aggregate] = field(default_factory=list)


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def here(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str):
        raise SchemaError("parse", f"expected {wanted}, found {self.here.value!r}", self.here.where)

    def take(self, kind: str, value=None):
        t = self.here
        if t.kind != kind or value is not None and t.value != value:
            self.fail(repr(value) if value is not None else kind)
        self.at += 1
        return t.value

    def has(self, value: str, kind: str = "mark") -> bool:
        if self.here.kind == kind and self.here.value == value:
            self.at += 1
            return True
        return False

    def several(self, one: Callable, close: str) -> list:
        """At least one, comma-separated, up to close."""
        out = [one()]
        while self.has(","):
            out.append(one())
        self.take("mark", close)
        return out

    def dotted(self) -> str:
        parts = [self.take("name")]
        while self.has("."):
            parts.append(self.take("name"))
        return ".".join(parts)

    def literal(self) -> tuple[str, object]:
        sign = -1 if self.has("-") else 1 if self.has("+") else 0
        t = self.here
        if t.kind in ("int", "float"):
            self.at += 1
            return t.kind, t.value * (sign or 1)
        if sign:
            self.fail("a number")
        if t.kind == "string":
            self.at += 1
            return "string", t.value
        if t.kind == "name":
            self.at += 1
            return ("bool", t.value == "true") if t.value in ("true", "false") else ("name", t.value)
        self.fail("a literal")

    def type(self, depth: int = 0) -> Type:
        if depth > MAX_DEPTH:
            raise SchemaError("parse", "types nest too deep", self.here.where)
        if self.here.value == "vector" and self.tokens[self.at + 1].value == "<":
            self.at += 2
            element = self.type(depth + 1)
            self.take("mark", ">")
            return Type("vector", element)
        return Type(self.dotted())

    def annotation(self) -> tuple[str, tuple[str, object] | None]:
        return self.dotted(), self.literal() if self.has("=") else None

    def field(self) -> tuple[Field, list]:
        where, cardinality = self.here.where, "unspecified"
        if self.here.kind == "name" and self.here.value in ("optional", "required") and self.tokens[self.at + 1].kind == "name":
            cardinality = self.take("name")
        kind, name = self.type(), self.take("name")
        self.take("mark", "=")
        number = self.take("int")
        notes = self.several(self.annotation, "]") if self.has("[") else []
        self.take("mark", ";")
        return Field(number, name, kind, cardinality, where=where), notes

    def reserved_range(self) -> tuple[int, int]:
        first = self.take("int")
        return first, self.take("int") if self.has("to", "name") else first

    def aggregate(self, package: str) -> Aggregate:
        kind, name = self.take("name"), self.take("name")
        self.take("mark", "{")
        fields, reserved = [], []
        while not self.has("}"):
            if self.here.value == "reserved" and self.tokens[self.at + 1].kind == "int":
                self.at += 1
                reserved += self.several(self.reserved_range, ";")
            else:
                fields.append(_annotated(*self.field()))
        return Aggregate(kind, f"{package}.{name}" if package else name, tuple(fields), tuple(reserved))

    def file(self) -> File:
        out = File()
        pending: list[int] = []
        seen = set()
        while self.here.kind != "end":
            word = self.here.value
            if word in ("syntax", "package") and word in seen:
                raise SchemaError("parse", f"second {word}", self.here.where)
            if word == "syntax":
                self.at += 1
                self.take("mark", "=")
                out.syntax = self.take("string").decode()
                self.take("mark", ";")
            elif word == "package":
                self.at += 1
                out.package = self.dotted()
                self.take("mark", ";")
            elif word == "import":
                self.at += 1
                out.imports.append(self.take("string").decode())
                self.take("mark", ";")
            elif word == "option":
                self.at += 1
                name = self.dotted()
                self.take("mark", "=")
                out.options[name] = self.literal()[1]
                self.take("mark", ";")
            elif word in ("message", "struct"):
                pending.append(self.at)
                out.aggregates.append(self.aggregate(""))
            else:
                self.fail("a declaration")
            seen.add(word)
        if out.package:
            out.aggregates = [replace(a, name=f"{out.package}.{a.name}") for a in out.aggregates]
        return out


def _annotated(f: Field, notes: list) -> Field:
    """The field with its annotations applied."""
    seen, given = set(), {}
    for name, value in notes:
        if name in seen or name not in ("max_bytes", "max_capacity", "default", "snapshot_key"):
            raise SchemaError("annotation", f"{'second' if name in seen else 'unknown'} {name}", f.where)
        seen.add(name)
        if name in ("max_bytes", "max_capacity"):
            if value is None or value[0] != "int" or value[1] <= 0:
                raise SchemaError("annotation", f"{name} needs a positive integer", f.where)
            given[name] = value[1]
        elif name == "snapshot_key":
            if value is not None and value[0] != "bool":
                raise SchemaError("annotation", "snapshot_key is a flag", f.where)
            given[name] = value is None or bool(value[1])
        else:
            if value is None or not f.type.is_scalar:
                raise SchemaError("default", "only scalars have a default value", f.where)
            given["default"] = default_value(f.type.name, *value)
    return replace(f, **given)


def parse(source: str | bytes) -> File:
    return _Parser(tokenise(source)).file()


def pack_version(text: object) -> int:
    """"major.minor" as major * 65536 + minor."""
    if isinstance(text, bytes):
        text = text.decode(errors="replace")
    m = re.fullmatch(r"(0|[1-9][0-9]{0,4})\.(0|[1-9][0-9]{0,4})", str(text))
    if not m or max(int(m[1]), int(m[2])) > 65535:
        raise SchemaError("version", f"not major.minor: {text!r}")
    return int(m[1]) << 16 | int(m[2])


def _checked(a: Aggregate) -> None:
    ids, names = set(), set()
    ranges = sorted(a.reserved)
    for (x, y), (z, _) in zip(ranges, [*ranges[1:], (MAX_FIELD_ID + 1, 0)], strict=False):
        if not 1 <= x <= y <= MAX_FIELD_ID or z <= y:
            raise SchemaError("reserved", f"range {x}-{y} is empty, out of bounds or overlaps", a.name)
    for f in a.fields:
        if not 1 <= f.id <= MAX_FIELD_ID or f.id in ids or f.name in names or a.is_reserved(f.id):
            raise SchemaError("field", f"id or name of {f.name} is out of range, taken or reserved", f.where or a.name)
        ids.add(f.id)
        names.add(f.name)
        leaf, vector = f.type, False
        while leaf.element:
            leaf, vector = leaf.element, True
        if (leaf.name in ("string", "bytes")) != (f.max_bytes is not None):
            raise SchemaError("limit", f"max_bytes belongs to strings and bytes, and they need it: {f.name}", f.where)
        if vector != (f.max_capacity is not None):
            raise SchemaError("limit", f"max_capacity belongs to vectors, and they need it: {f.name}", f.where)
        if f.default is not None and f.default[0] in ("string", "bytes") and len(f.default[1]) > f.max_bytes:
            raise SchemaError("default", f"default of {f.name} is longer than max_bytes", f.where)
        if a.kind == "struct" and (vector or leaf.name in ("string", "bytes") or f.cardinality == "optional"):
            raise SchemaError("struct", f"a struct's fields have fixed size: {f.name}", f.where)


def _resolved(t: Type, package: str, known: set[str]) -> Type:
    """Names within the package first, then absolute ones."""
    if t.element:
        return replace(t, element=_resolved(t.element, package, known))
    if t.name in SCALARS:
        return t
    for name in ([f"{package}.{t.name}"] if package else []) + [t.name]:
        if name in known:
            return Type(name)
    raise SchemaError("type", f"unknown type {t.name}")


def compile_files(root: str, sources: dict[str, str | bytes], registered: dict[str, Schema] | None = None, layout: int = 1) -> dict[str, Schema]:
    """Schemas by full name of everything that root and its imports declare. Paths don't matter to identity."""
    files: dict[str, File] = {}
    todo = [root]
    while todo:
        path = todo.pop()
        if path not in files:
            if path not in sources:
                raise SchemaError("import", f"no file {path}")
            files[path] = parse(sources[path])
            todo += files[path].imports
    declared: dict[str, tuple[Aggregate, File]] = {}
    for f in files.values():
        for a in f.aggregates:
            if a.name in declared and declared[a.name][0] != a:
                raise SchemaError("type", f"{a.name} is declared twice, differently")
            if a.name in (registered or {}) and a.name in declared:
                raise SchemaError("type", f"{a.name} is declared twice")
            declared[a.name] = (a, f)
    registered = registered or {}
    known = set(declared) | set(registered)
    resolved = {n: replace(a, fields=tuple(replace(x, type=_resolved(x.type, f.package, known)) for x in a.fields)) for n, (a, f) in declared.items()}
    done: dict[str, Schema] = {}

    def build(name: str, above: tuple[str, ...]) -> Schema:
        if name in above:
            raise SchemaError("type", f"{name} contains itself")
        if name in done:
            return done[name]
        if name not in resolved:
            done.update({name: registered[name]})
            return registered[name]
        a = resolved[name]
        _checked(a)
        closure: dict[str, str] = {}
        for other in sorted(a.uses()):
            s = build(other, (*above, name))
            if a.kind == "struct" and s.aggregate.kind != "struct":
                raise SchemaError("struct", f"{name} holds the message {other}")
            closure |= {other: s.digest, **dict(s.dependencies)}
        version = pack_version(declared[name][1].options.get("schema_version", b"1.0"))
        schema = identified(a, version, layout, closure.items())
        if type_footprint(a, {**registered, **done}) > MAX_FOOTPRINT:
            raise SchemaError("limit", f"{name} can take more than {MAX_FOOTPRINT} bytes")
        done[name] = schema
        return schema

    for name in resolved:
        build(name, ())
    return {n: done[n] for n in resolved}
