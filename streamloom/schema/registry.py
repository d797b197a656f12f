"""Compatibility of schema versions, and a registry that keeps them in order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .language import compile_files
from .model import Field, Schema, SchemaError

#: Directions by how they combine: neutral gives way, and two that differ are incompatible.
NEUTRAL, READ, WRITE, INCOMPATIBLE = "wire", "read", "write", "incompatible"


def combined(directions: Iterable[str]) -> str:
    found = {d for d in directions if d != NEUTRAL}
    if not found:
        return NEUTRAL
    return found.pop() if len(found) == 1 else INCOMPATIBLE


def _limit(old: int | None, new: int | None) -> str:
    """Tightening is safe to write, widening to read."""
    if old == new:
        return NEUTRAL
    top = float("inf")
    return WRITE if (top if new is None else new) < (top if old is None else old) else READ


def compatibility(old: Schema, new: Schema, closure: Iterable[Schema] = ()) -> str:
    """identical, wire, read, write or incompatible."""
    known = {s.digest: s for s in (*closure, old, new)}
    memo: dict[tuple[str, str], str] = {}

    def nested(name: str, a: Schema, b: Schema) -> str:
        x, y = known.get(dict(a.dependencies).get(name)), known.get(dict(b.dependencies).get(name))
        same = dict(a.dependencies).get(name) == dict(b.dependencies).get(name)
        if same and name in dict(a.dependencies):
            return NEUTRAL
        if x is None or y is None or x.name != name or y.name != name:
            return INCOMPATIBLE
        return NEUTRAL if (c := pair(x, y)) == "identical" else c

    def matched(f: Field, g: Field, a: Schema, b: Schema) -> str:
        if (f.type, f.cardinality, f.default, f.snapshot_key) != (g.type, g.cardinality, g.default, g.snapshot_key):
            return INCOMPATIBLE
        return combined([_limit(f.max_bytes, g.max_bytes), _limit(f.max_capacity, g.max_capacity), *(nested(n, a, b) for n in sorted(f.type.users()))])

    def pair(a: Schema, b: Schema) -> str:
        if a.digest == b.digest:
            return "identical"
        key = (a.digest, b.digest)
        if key not in memo:
            memo[key] = INCOMPATIBLE  # also what a pair met again inside itself is
            if (a.name, a.aggregate.kind) == (b.name, b.aggregate.kind):
                found = []
                for i in {f.id for f in (*a.aggregate.fields, *b.aggregate.fields)}:
                    f, g = a.aggregate.field(i), b.aggregate.field(i)
                    if f and g:
                        found.append(matched(f, g, a, b))
                    elif g:
                        found.append(NEUTRAL if g.optional and not a.aggregate.is_reserved(i) else INCOMPATIBLE)
                    else:
                        found.append(NEUTRAL if f.optional and b.aggregate.is_reserved(i) else INCOMPATIBLE)
                memo[key] = combined(found)
        return memo[key]

    return pair(old, new)


@dataclass
class SchemaRegistry:
    """Schemas by digest, the versions of each name in order, and ids that are an index only."""

    by_digest: dict[str, Schema] = field(default_factory=dict)
    history: dict[str, list[Schema]] = field(default_factory=dict)

    def register(self, schema: Schema) -> Schema:
        """Adds a version: the same again is fine; another must have a higher version and be compatible."""
        if schema.digest in self.by_digest:
            return self.by_digest[schema.digest]
        missing = [n for n, d in schema.dependencies if d not in self.by_digest]
        if missing:
            raise SchemaError("dependency", f"{schema.name} needs {missing}")
        versions = self.history.get(schema.name, [])
        if versions:
            last = versions[-1]
            if schema.version <= last.version:
                raise SchemaError("version", f"{schema.name} must rise above {last.version}")
            if compatibility(last, schema, self.by_digest.values()) == INCOMPATIBLE:
                raise SchemaError("compatibility", f"{schema.name} breaks version {last.version}")
        self.by_digest[schema.digest] = schema
        self.history.setdefault(schema.name, []).append(schema)
        return schema

    def register_source(self, root: str, sources: dict[str, str | bytes]) -> list[Schema]:
        """Compiles and registers. Names that the sources lack are taken from here, where exactly one schema has them."""
        try:
            found = compile_files(root, sources)
        except SchemaError as e:
            if e.kind != "type":
                raise
            many = [n for n, v in self.history.items() if len(v) > 1 and any(n.rpartition(".")[2] in str(s) for s in sources.values())]
            if many:
                raise SchemaError("ambiguous", f"several versions of {many} are registered") from e
            found = compile_files(root, sources, {n: v[-1] for n, v in self.history.items()})
        ordered = sorted(found.values(), key=lambda s: len(s.dependencies))
        return [self.register(s) for s in ordered]

    def find(self, name: str, version: int | None = None) -> Schema | None:
        versions = self.history.get(name, [])
        return next((s for s in reversed(versions) if version is None or s.version == version), None)

    def find_short(self, short_id: int, digest: str | None = None) -> Schema | None:
        """By the short id; where several share it the digest decides."""
        hits = [s for s in self.by_digest.values() if s.short_id == short_id and digest in (None, s.digest)]
        if len(hits) > 1:
            raise SchemaError("ambiguous", f"{len(hits)} schemas have id {short_id}")
        return hits[0] if hits else None

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """schema, schema_field and schema_dependency as DataFrames."""
        every = list(self.by_digest.values())
        schemas = [(s.digest, str(s.short_id), s.name, s.version, s.layout, s.aggregate.kind) for s in every]
        fields = [(s.digest, f.id, f.name, f.type.text(), f.cardinality, f.max_bytes, f.max_capacity, f.snapshot_key) for s in every for f in s.aggregate.fields]
        uses = [(s.digest, n, d) for s in every for n, d in s.dependencies]
        return (
            spark.createDataFrame(schemas, "digest string, short_id string, name string, version long, layout long, kind string").selectExpr("digest", "cast(short_id as decimal(20,0)) short_id", "name", "version", "layout", "kind"),
            spark.createDataFrame(fields, "digest string, field_id long, name string, type string, cardinality string, max_bytes long, max_capacity long, snapshot_key boolean"),
            spark.createDataFrame(uses, "digest string, dependency string, dependency_digest string"),
        )
