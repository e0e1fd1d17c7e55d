"""Typed mappings of an index, and how they show in Spark schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import AmbiguousColumn, IllegalArgument, StrictMapping

#: Mapped types and their Spark types.
SPARK_TYPES: dict[str, T.DataType] = {
    "text": T.StringType(),
    "keyword": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.TimestampType(),
    "knn_vector": T.ArrayType(T.FloatType()),
}
DYNAMIC = ("true", "false", "strict")
SYNTHETIC = ("_id", "_score")
_NAME = re.compile(r"^[a-z0-9][a-z0-9._-]*$")
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?)?$")


def check_index_name(name: str) -> str:
    """Lower case, no leading dot, dash or underscore, no special characters, at most 255 bytes."""
    if not name or len(name.encode()) > 255 or not _NAME.match(name):
        raise IllegalArgument(f"invalid index name [{name}]")
    return name


@dataclass
class Mapping:
    """Field names and types in order; ``dimension`` of vectors; what to do with unknown fields."""

    fields: dict[str, str] = field(default_factory=dict)
    dynamic: str = "false"
    dimensions: dict[str, int] = field(default_factory=dict)

    @classmethod
    def of(cls, body: dict | None, dynamic: str = "false") -> Mapping:
        """From a create body's ``mappings``: ``{"properties": {f: {"type": t}}, "dynamic": ...}`` or ``{f: t}``."""
        body = dict(body or {})
        dynamic = str(body.pop("dynamic", dynamic)).lower()
        if dynamic not in DYNAMIC:
            raise IllegalArgument(f"unknown dynamic mode [{dynamic}]")
        out = cls(dynamic=dynamic)
        for name, spec in body.get("properties", body).items():
            spec = {"type": spec} if isinstance(spec, str) else spec
            kind = spec.get("type")
            if kind not in SPARK_TYPES:
                raise IllegalArgument(f"field [{name}] has unknown type [{kind}]")
            out.fields[name] = kind
            if "dimension" in spec:
                out.dimensions[name] = int(spec["dimension"])
        return out

    @classmethod
    def of_schema(cls, schema: T.StructType, text: tuple[str, ...] = (), dynamic: str = "false") -> Mapping:
        """From a DataFrame's schema; the strings named in ``text`` are analysed, other strings are keywords."""
        out = cls(dynamic=dynamic)
        for f in schema.fields:
            kind = f.dataType
            if f.name in SYNTHETIC:
                continue
            if isinstance(kind, T.StringType):
                out.fields[f.name] = "text" if f.name in text else "keyword"
            elif isinstance(kind, T.IntegralType):
                out.fields[f.name] = "integer"
            elif isinstance(kind, T.FractionalType):
                out.fields[f.name] = "float"
            elif isinstance(kind, T.BooleanType):
                out.fields[f.name] = "boolean"
            elif isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
                out.fields[f.name] = "date"
            elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
                out.fields[f.name] = "knn_vector"
        return out

    def kind(self, name: str) -> str | None:
        return self.fields.get(name)

    def is_text(self, name: str) -> bool:
        return self.fields.get(name) == "text" or name == "body" and name not in self.fields

    def schema(self) -> T.StructType:
        out = T.StructType([T.StructField("_id", T.StringType(), False)])
        for name, kind in self.fields.items():
            extra = {"mapped": kind} | ({"dimension": self.dimensions[name]} if name in self.dimensions else {})
            out.add(T.StructField(name, SPARK_TYPES[kind], True, extra))
        return out

    def resolve(self, name: str) -> str | None:
        """The field's own spelling: an exact match, else the only one that differs in case; else None."""
        if name in self.fields or name in SYNTHETIC:
            return name
        near = [f for f in [*self.fields, *SYNTHETIC] if f.lower() == name.lower()]
        if len(near) > 1:
            raise AmbiguousColumn(f"column [{name}] may be any of {sorted(near)}")
        return near[0] if near else None

    def learn(self, doc: dict) -> Mapping:
        """The mapping after a document: unseen scalar fields are added if dynamic, refused if strict."""
        unknown = [k for k in doc if k not in self.fields and k not in SYNTHETIC]
        if self.dynamic == "strict" and unknown:
            raise StrictMapping(f"fields {unknown} are not mapped and the mapping is strict")
        if self.dynamic != "true":
            return self
        added = {k: t for k in unknown if (t := infer(doc[k])) is not None}
        return Mapping({**self.fields, **added}, self.dynamic, self.dimensions) if added else self

    def body(self) -> dict:
        """The create body that makes this mapping."""
        props = {n: {"type": k} | ({"dimension": self.dimensions[n]} if n in self.dimensions else {}) for n, k in self.fields.items()}
        return {"dynamic": self.dynamic, "properties": props}


def infer(value: object) -> str | None:
    """The type of an unseen field's first value; nulls, arrays of other than numbers and objects have none."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "date" if _DATE.match(value) else "text"
    if isinstance(value, list) and value and all(isinstance(x, int | float) and not isinstance(x, bool) for x in value):
        return "knn_vector"
    return None
