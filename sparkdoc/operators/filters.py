"""The attribute filter language: eight operators, joined by AND, compiled to Catalyst predicates.

Kinds are string, number and bool; values of different kinds are never equal. An array matches if any
element does, except that ``neq`` needs a present value and no element that equals. ``contains`` is
element membership, as ``eq``. Ranges are for numbers alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdoc.functions.schema import kind_of

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "contains")
RANGES = ("gt", "gte", "lt", "lte")


class FilterError(ValueError):
    """A filter that can't be meant."""


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: Any


def _number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def kind(x: Any) -> str | None:
    return "string" if isinstance(x, str) else "bool" if isinstance(x, bool) else "number" if _number(x) else None


def validate(filters: Iterable[Filter]) -> None:
    for f in filters:
        if not f.field:
            raise FilterError("a filter needs a field")
        if f.op not in OPERATORS:
            raise FilterError(f"unknown operator {f.op!r}")
        if f.op in RANGES and not _number(f.value):
            raise FilterError(f"{f.op} needs a number")
        if f.op == "in" and not isinstance(f.value, (list, tuple)):
            raise FilterError("in needs a list")


def _literal(x: Any) -> Column:
    return F.lit(float(x)) if _number(x) else F.lit(x)


def _compare(c: Column, op: str, v: Column) -> Column:
    return {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]


def _type_kind(t: T.DataType) -> str | None:
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    return "number" if isinstance(t, T.NumericType) else None


def _no() -> Column:
    return F.lit(False)


class Typed:
    """A column of known type. Predicates on scalars are ``IS NOT NULL`` and a bare comparison, which are never null and which the Parquet scan takes."""

    def __init__(self, column: Column, dtype: T.DataType) -> None:
        self.array = isinstance(dtype, T.ArrayType)
        self.kind = _type_kind(dtype.elementType if self.array else dtype)
        self.number = self.kind == "number"
        self.c = column

    def _cast(self, x: Column) -> Column:
        return x.cast("double") if self.number else x

    def present(self) -> Column:
        if self.kind is None:
            return _no()
        return F.coalesce(F.size(F.filter(self.c, lambda x: x.isNotNull())) > 0, _no()) if self.array else self.c.isNotNull()

    def eq(self, v: Any) -> Column:
        if kind(v) is None or kind(v) != self.kind:
            return _no()
        if self.array:
            return F.coalesce(F.exists(self.c, lambda x: self._cast(x).eqNullSafe(_literal(v))), _no())
        return self.c.isNotNull() & (self.c == F.lit(v))

    def neq(self, v: Any) -> Column:
        if self.array or kind(v) is None or kind(v) != self.kind:
            return self.present() & ~self.eq(v)
        return self.c.isNotNull() & (self.c != F.lit(v))

    def any_of(self, values: Sequence[Any]) -> Column:
        if self.array:
            return reduce(lambda a, b: a | b, [self.eq(v) for v in values], _no())
        alike = [v for v in values if kind(v) is not None and kind(v) == self.kind]
        return self.c.isNotNull() & self.c.isin(alike) if alike else _no()

    def range(self, op: str, v: Any) -> Column:
        if not self.number:
            return _no()
        if self.array:
            return F.coalesce(F.exists(self.c, lambda x: F.coalesce(_compare(self._cast(x), op, _literal(v)), _no())), _no())
        return self.c.isNotNull() & _compare(self.c, op, F.lit(v))


class Loose:
    """A field of a JSON object: kinds are looked at before any cast."""

    def __init__(self, attributes: Column, field: str) -> None:
        value = F.try_variant_get(attributes, "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")
        elements = F.when(kind_of(value) == "array", F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))
        one = lambda x, k, t: F.when(kind_of(x) == k, F.try_variant_get(x, "$", t))
        normal = F.transform(elements, lambda x: F.struct(one(x, "string", "string").alias("string"), one(x, "number", "double").alias("number"), one(x, "bool", "boolean").alias("bool")))
        self.c = F.filter(normal, lambda x: x["string"].isNotNull() | x["number"].isNotNull() | x["bool"].isNotNull())

    def present(self) -> Column:
        return F.coalesce(F.size(self.c) > 0, _no())

    def eq(self, v: Any) -> Column:
        if kind(v) is None:
            return _no()
        return F.coalesce(F.exists(self.c, lambda x: x[kind(v)].eqNullSafe(_literal(v))), _no())

    def neq(self, v: Any) -> Column:
        return self.present() & ~self.eq(v)

    def any_of(self, values: Sequence[Any]) -> Column:
        return reduce(lambda a, b: a | b, [self.eq(v) for v in values], _no())

    def range(self, op: str, v: Any) -> Column:
        return F.coalesce(F.exists(self.c, lambda x: F.coalesce(_compare(x["number"], op, _literal(v)), _no())), _no())


def _predicate(field: Typed | Loose | None, f: Filter) -> Column:
    if field is None or isinstance(f.value, float) and math.isnan(f.value) and f.op != "neq":
        return _no()
    if f.op in ("eq", "contains"):
        return field.eq(f.value)
    if f.op == "neq":
        return field.neq(f.value)
    if f.op == "in":
        return field.any_of([v for v in f.value if not (isinstance(v, float) and math.isnan(v))])
    return field.range(f.op, f.value)


def predicate(filters: Sequence[Filter], columns: dict[str, tuple[Column, T.DataType]] | None = None, attributes: Column | None = None, indexed: Iterable[str] | None = None) -> Column:
    """All filters as one predicate over typed columns or over a VARIANT of attributes.

    Fields outside ``indexed`` (if given) or unknown match nothing; no filters match everything.
    """
    validate(filters)
    allowed = None if indexed is None else set(indexed)

    def resolve(name: str) -> Typed | Loose | None:
        if allowed is not None and name not in allowed:
            return None
        if columns is not None:
            return Typed(*columns[name]) if name in columns else None
        return Loose(attributes, name)

    return reduce(lambda a, b: a & b, [_predicate(resolve(f.field), f) for f in filters], F.lit(True))


def columns_of(df: DataFrame, *names: str) -> dict[str, tuple[Column, T.DataType]]:
    return {n: (df[n], df.schema[n].dataType) for n in (names or df.columns)}


def page(df: DataFrame, limit: int, offset: int, *order: Any) -> DataFrame:
    """Rows in order; an offset below 0 is 0, a limit of 0 or less takes all the rest."""
    ordered = df.orderBy(*order)
    if offset > 0:
        ordered = ordered.offset(offset)
    return ordered.limit(limit) if limit > 0 else ordered


def search(docs: DataFrame, filters: Sequence[Filter], limit: int = 0, offset: int = 0, id_col: str = "id", columns: Iterable[str] | None = None, indexed: Iterable[str] | None = None) -> DataFrame:
    """Documents that pass all filters, in id order, a page of them."""
    known = columns_of(docs, *(columns or [c for c in docs.columns if c != id_col]))
    return page(docs.where(predicate(filters, columns=known, indexed=indexed)), limit, offset, id_col)
