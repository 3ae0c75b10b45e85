"""Document schemas: field types, validation as columns, differences between schemas."""

from __future__ import annotations

import datetime
import enum
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ValidationError(ValueError):
    """A document doesn't fit its schema."""


class FieldType(enum.Enum):
    STRING = "string"
    INT = "int"
    FLOAT = "float"
    BOOL = "bool"
    STRINGS = "[]string"
    INTS = "[]int"
    FLOATS = "[]float"
    DATETIME = "datetime"
    REFERENCE = "reference"

    @staticmethod
    def parse(name: str) -> FieldType:
        try:
            return FieldType(name)
        except ValueError:
            raise ValidationError(f"unknown field type {name!r}") from None

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]


#: Integers are doubles too: stored as JSON numbers, they needn't be whole.
_SPARK = {
    FieldType.STRING: T.StringType(),
    FieldType.INT: T.DoubleType(),
    FieldType.FLOAT: T.DoubleType(),
    FieldType.BOOL: T.BooleanType(),
    FieldType.STRINGS: T.ArrayType(T.StringType()),
    FieldType.INTS: T.ArrayType(T.DoubleType()),
    FieldType.FLOATS: T.ArrayType(T.DoubleType()),
    FieldType.DATETIME: T.StringType(),
    FieldType.REFERENCE: T.StringType(),
}
RFC3339 = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


@dataclass(frozen=True)
class FieldDefinition:
    type: FieldType
    required: bool = False
    indexed: bool = False
    full_text: bool = False
    reference: str = ""


@dataclass(frozen=True)
class Schema:
    fields: dict[str, FieldDefinition] = field(default_factory=dict)
    embedding_model: str = ""
    embedding_dims: int = 0

    def indexed(self) -> set[str]:
        return {n for n, f in self.fields.items() if f.indexed}

    def full_text(self) -> set[str]:
        return {n for n, f in self.fields.items() if f.full_text}

    def validate(self, attributes: dict[str, Any] | None) -> None:
        """Raise ``ValidationError`` for the first field that doesn't fit: the world is closed, null is no value."""
        attributes = attributes or {}
        for name in sorted(attributes):
            if name not in self.fields:
                raise ValidationError(f"unknown field {name!r}")
        for name, definition in sorted(self.fields.items()):
            if name not in attributes:
                if definition.required:
                    raise ValidationError(f"field {name!r} is required")
            elif not _fits(definition.type, attributes[name]):
                raise ValidationError(f"field {name!r} is no {definition.type.value}")

    def evolve(self, **changes: Any) -> Schema:
        return replace(self, **changes)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _fits(kind: FieldType, x: Any) -> bool:
    if kind in (FieldType.STRING, FieldType.REFERENCE):
        return isinstance(x, str)
    if kind in (FieldType.INT, FieldType.FLOAT):
        return _number(x)
    if kind is FieldType.BOOL:
        return isinstance(x, bool)
    if kind is FieldType.DATETIME:
        return isinstance(x, datetime.datetime) or isinstance(x, str) and bool(re.match(RFC3339, x))
    if not isinstance(x, (list, tuple)):
        return False
    return all(isinstance(v, str) for v in x) if kind is FieldType.STRINGS else all(_number(v) for v in x)


def kind_of(value: Column) -> Column:
    """string, number, bool, array, object or null: the kind of a VARIANT, before any cast can blur it."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (name == "VOID"), "null")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "bool")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .when(name.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), "number")
        .otherwise("other")
    )


def violations(schema: Schema, attributes: Column) -> Column:
    """Sorted messages of what a JSON object of attributes breaks, as ARRAY<STRING>: validation of a whole table at once."""
    v = F.parse_json(F.coalesce(attributes, F.lit("{}")))
    names = F.coalesce(F.json_object_keys(F.coalesce(attributes, F.lit("{}"))), F.array())
    known = F.array(*[F.lit(n) for n in schema.fields]) if schema.fields else F.array().cast("array<string>")
    unknown = F.transform(F.array_except(names, known), lambda n: F.concat(F.lit("unknown "), n))
    checks = []
    for name, definition in schema.fields.items():
        value = F.try_variant_get(v, f"$['{name}']", "variant")
        absent = ~F.array_contains(names, name)
        if definition.required:
            checks.append(F.when(absent, F.lit(f"missing {name}")))
        checks.append(F.when(~absent & ~_fits_column(definition.type, value), F.lit(f"type {name}")))
    return F.array_sort(F.concat(unknown, F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")))


def _fits_column(kind: FieldType, value: Column) -> Column:
    k = kind_of(value)
    if kind in (FieldType.STRING, FieldType.REFERENCE):
        return k == "string"
    if kind in (FieldType.INT, FieldType.FLOAT):
        return k == "number"
    if kind is FieldType.BOOL:
        return k == "bool"
    if kind is FieldType.DATETIME:
        return (k == "string") & F.coalesce(F.try_variant_get(value, "$", "string").rlike(RFC3339), F.lit(False))
    inner = "string" if kind is FieldType.STRINGS else "number"
    elements = F.try_variant_get(value, "$", "array<variant>")
    return (k == "array") & F.coalesce(F.forall(elements, lambda x: kind_of(x) == inner), F.lit(False))


@dataclass(frozen=True)
class SchemaChange:
    embedding: bool
    indexed: bool
    full_text: bool

    def __bool__(self) -> bool:
        return self.embedding or self.indexed or self.full_text


def diff(old: Schema | None, new: Schema | None) -> SchemaChange:
    """Which derived indexes a change of schema touches."""
    a, b = old or Schema(), new or Schema()
    return SchemaChange((a.embedding_model, a.embedding_dims) != (b.embedding_model, b.embedding_dims), a.indexed() != b.indexed() or (old is None) != (new is None), a.full_text() != b.full_text())
