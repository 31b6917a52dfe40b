"""Metadata filters: a small text form, and nested payloads, both compiled to one boolean column.

A field that is missing or null equals no literal, so != holds for it; ordering compares as numbers, and what is no
number compares as false. Literals equal values of a kind with them: numbers and booleans among themselves, strings
among themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Operators of the text form in the order in which they are looked for, and their names in payloads.
OPERATORS = {">=": "$gte", "<=": "$lte", "!=": "$ne", "=": "$eq", ">": "$gt", "<": "$lt"}
DESCRIPTIONS = {"$eq": "equals", "$ne": "not_equals", "$lt": "less_than", "$lte": "less_than_or_equal", "$gt": "greater_than", "$gte": "greater_than_or_equal"}
ORDERING = {"$lt": "<", "$lte": "<=", "$gt": ">", "$gte": ">="}

Literal = str | int | float | bool


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Literal

    def __post_init__(self) -> None:
        if not self.field.strip():
            raise ValueError("a filter needs a field")
        if self.operator not in DESCRIPTIONS:
            raise ValueError(f"no such filter operator: {self.operator}")
        if isinstance(self.value, str) and not self.value.strip():
            raise ValueError("a filter needs a value")

    def description(self) -> dict[str, Literal]:
        return {"field": self.field, "operator": DESCRIPTIONS[self.operator], "value": self.value}


def literal(text: str) -> Literal:
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parse(text: str) -> Filter:
    """FIELD op VALUE; the first of OPERATORS that occurs anywhere in the text parts it."""
    sign = next((s for s in OPERATORS if s in text), None)
    if sign is None:
        raise ValueError(f"{text!r} is no filter: FIELD, one of {' '.join(OPERATORS)}, VALUE")
    field, _, value = text.partition(sign)
    if not value.strip():
        raise ValueError("a filter needs a value")
    got = literal(value.strip())
    if OPERATORS[sign] in ORDERING and isinstance(got, str):
        raise ValueError(f"{sign} needs a number, not {got!r}")
    return Filter(field.strip(), OPERATORS[sign], got)


def payload(filters: list[Filter]) -> dict | None:
    """The filters as one payload: all must hold."""
    clauses = [{f.field: {f.operator: f.value}} for f in filters]
    return None if not clauses else clauses[0] if len(clauses) == 1 else {"$and": clauses}


def merged(*payloads: dict | None) -> dict | None:
    given = [p for p in payloads if p]
    return None if not given else given[0] if len(given) == 1 else {"$and": given}


def _equals(field: Column, kind: T.DataType | None, value: Literal) -> Column:
    """Null-safe equality between values of a kind."""
    text = isinstance(kind, (T.StringType, T.CharType, T.VarcharType))
    if kind is None or text != isinstance(value, str):
        return F.lit(False)
    if isinstance(kind, T.BooleanType) or isinstance(value, bool):
        return F.coalesce(field.cast("double") == F.lit(float(value)), F.lit(False))
    return field.eqNullSafe(F.lit(value))


def _clause(field: Column, kind: T.DataType | None, operator: str, value) -> Column:
    if operator == "$eq":
        return _equals(field, kind, value)
    if operator == "$ne":
        return ~_equals(field, kind, value)
    if operator == "$in":
        return reduce(lambda a, b: a | b, (_equals(field, kind, v) for v in value), F.lit(False))
    if operator in ORDERING:
        bound = literal(value) if isinstance(value, str) else value
        if kind is None or isinstance(bound, str):
            return F.lit(False)
        number = field.try_cast("double")
        test = {"<": number < bound, "<=": number <= bound, ">": number > bound, ">=": number >= bound}[ORDERING[operator]]
        return F.coalesce(test, F.lit(False))
    raise ValueError(f"no such operator in a payload: {operator}")


def to_column(where: dict | None, schema: T.StructType) -> Column:
    """The payload over columns of schema; a payload with $and has nothing beside it."""
    if not where:
        return F.lit(True)
    if "$and" in where:
        return reduce(lambda a, b: a & b, (to_column(w, schema) for w in where["$and"]), F.lit(True))
    kinds = {f.name: f.dataType for f in schema.fields}
    tests = []
    for name, condition in where.items():
        field = F.col(f"`{name}`") if name in kinds else F.lit(None)
        for operator, value in (condition if isinstance(condition, dict) else {"$eq": condition}).items():
            tests.append(_clause(field, kinds.get(name), operator, value))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def apply(df: DataFrame, filters: list[Filter] | None = None, where: dict | None = None) -> DataFrame:
    return df.where(to_column(merged(payload(filters or []), where), df.schema))
