"""Schemas as JSON, to be kept beside the data that they describe."""

from __future__ import annotations

import json

from .model import Aggregate, Field, Schema, SchemaError, Type, identified


def _type(t: Type) -> object:
    return {"vector": _type(t.element)} if t.element else t.name


def _untype(x: object) -> Type:
    return Type("vector", _untype(x["vector"])) if isinstance(x, dict) else Type(x)


def dumps(schema: Schema) -> str:
    a = schema.aggregate
    fields = [
        {"id": f.id, "name": f.name, "type": _type(f.type), "cardinality": f.cardinality, "max_bytes": f.max_bytes, "max_capacity": f.max_capacity, "snapshot_key": f.snapshot_key, "default": f.default and [f.default[0], f.default[1].hex()]}
        for f in a.fields
    ]
    return json.dumps({"kind": a.kind, "name": a.name, "version": schema.version, "layout": schema.layout, "fields": fields, "reserved": a.reserved, "dependencies": schema.dependencies, "digest": schema.digest}, sort_keys=True)


def loads(text: str) -> Schema:
    """The schema, if its digest is that of what it says."""
    try:
        x = json.loads(text)
        fields = tuple(Field(f["id"], f["name"], _untype(f["type"]), f["cardinality"], f["max_bytes"], f["max_capacity"], f["snapshot_key"], f["default"] and (f["default"][0], bytes.fromhex(f["default"][1]))) for f in x["fields"])
        a = Aggregate(x["kind"], x["name"], fields, tuple(map(tuple, x["reserved"])))
        schema = identified(a, x["version"], x["layout"], [tuple(d) for d in x["dependencies"]])
    except (KeyError, TypeError, ValueError) as e:
        raise SchemaError("artifact", f"malformed: {e}") from e
    if schema.digest != x["digest"]:
        raise SchemaError("artifact", f"digest of {schema.name} doesn't match")
    return schema
