"""Predicates as small values, compiled to one Spark Column or to SQL text.

Three-valued logic throughout: a comparison with a null field is not true, so it drops the row; with
null_matches, != and NOT IN keep it.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass
from functools import reduce
from typing import Any, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@dataclass(frozen=True)
class Eq:
    field: str
    value: Any


@dataclass(frozen=True)
class Neq:
    field: str
    value: Any
    null_matches: bool = False


@dataclass(frozen=True)
class In:
    field: str
    values: tuple


@dataclass(frozen=True)
class NotIn:
    field: str
    values: tuple
    null_matches: bool = False


@dataclass(frozen=True)
class Range:
    field: str
    low: Any = None
    high: Any = None
    low_open: bool = False
    high_open: bool = False


@dataclass(frozen=True)
class IsNull:
    field: str


@dataclass(frozen=True)
class NotNull:
    field: str


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Sql:
    """An SQL expression in the place of a value: for SQL text alone."""

    text: str


Predicate = Union[Eq, Neq, In, NotIn, Range, IsNull, NotNull, And, Or]
KINDS = {c.__name__.lower(): c for c in (Eq, Neq, In, NotIn, Range, IsNull, NotNull, And, Or)}


class InvalidPredicate(ValueError):
    """A field outside the allow-list, a value of no literal type, or a malformed node."""


def fields(p: Predicate) -> set[str]:
    return set().union(*map(fields, p.parts)) if isinstance(p, (And, Or)) else {p.field}


def check(p: Predicate, allowed: list[str]) -> None:
    """Raises unless every field is a plain name in allowed, and every node and literal is well formed."""
    if isinstance(p, (And, Or)):
        if len(p.parts) < 2:
            raise InvalidPredicate("and / or need two operands")
        for x in p.parts:
            check(x, allowed)
        return
    if not NAME.fullmatch(p.field) or p.field not in allowed:
        raise InvalidPredicate(f"unknown field {p.field!r}")
    if isinstance(p, (In, NotIn)):
        if not p.values or any(v is None for v in p.values):
            raise InvalidPredicate("a value list holds at least one value and no null")
    if isinstance(p, Range) and p.low is None and p.high is None:
        raise InvalidPredicate("a range needs an end")
    for v in [getattr(p, n) for n in ("value", "low", "high") if hasattr(p, n)] + list(getattr(p, "values", ())):
        if not isinstance(v, (type(None), bool, int, float, str, dt.datetime, dt.date)):
            raise InvalidPredicate(f"no literal for {v!r}")


def literal(value: Any, kind: str) -> Column:
    """A literal of the field's type: text becomes a time where the field is one."""
    if isinstance(value, str) and kind.startswith("timestamp"):
        return F.lit(value.replace("T", " ").rstrip("Z")).cast(kind)
    return F.lit(value)


def compile(p: Predicate, df: DataFrame) -> Column:
    """The predicate as one Column over df, pushed down by Catalyst where the source can take it."""
    kinds = dict(df.dtypes)
    check(p, list(kinds))

    def build(x: Predicate) -> Column:
        if isinstance(x, And):
            return reduce(lambda a, b: a & b, map(build, x.parts))
        if isinstance(x, Or):
            return reduce(lambda a, b: a | b, map(build, x.parts))
        c = F.col(x.field)
        lit = lambda v: literal(v, kinds[x.field])
        if isinstance(x, Eq):
            return c.isNull() if x.value is None else c == lit(x.value)
        if isinstance(x, Neq):
            if x.value is None:
                return c.isNotNull()
            return ~F.coalesce(c == lit(x.value), F.lit(False)) if x.null_matches else c != lit(x.value)
        if isinstance(x, In):
            return c.isin(*[lit(v) for v in x.values])
        if isinstance(x, NotIn):
            inside = c.isin(*[lit(v) for v in x.values])
            return ~F.coalesce(inside, F.lit(False)) if x.null_matches else ~inside
        if isinstance(x, Range):
            ends = []
            if x.low is not None:
                ends.append(c > lit(x.low) if x.low_open else c >= lit(x.low))
            if x.high is not None:
                ends.append(c < lit(x.high) if x.high_open else c <= lit(x.high))
            return reduce(lambda a, b: a & b, ends)
        return c.isNull() if isinstance(x, IsNull) else c.isNotNull()

    return build(p)


def sql_literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, Sql):
        return value.text
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'"
    if re.fullmatch(r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d:\d\dZ?)?", value):
        return f"TIMESTAMP '{value.replace('T', ' ').rstrip('Z')}'"
    return "'" + value.replace("'", "''") + "'"


def to_sql(p: Predicate | None) -> str:
    """The predicate as SQL text, parenthesised throughout. Names must have passed check."""
    if p is None:
        return "TRUE"
    if isinstance(p, (And, Or)):
        return "(" + (" AND " if isinstance(p, And) else " OR ").join(map(to_sql, p.parts)) + ")"
    f = p.field
    if isinstance(p, Eq):
        return f"({f} IS NULL)" if p.value is None else f"({f} = {sql_literal(p.value)})"
    if isinstance(p, Neq):
        if p.value is None:
            return f"({f} IS NOT NULL)"
        test = f"{f} <> {sql_literal(p.value)}"
        return f"({test} OR {f} IS NULL)" if p.null_matches else f"({test})"
    if isinstance(p, (In, NotIn)):
        values = ", ".join(map(sql_literal, p.values))
        if isinstance(p, In):
            return f"({f} IN ({values}))"
        return f"({f} NOT IN ({values}) OR {f} IS NULL)" if p.null_matches else f"({f} NOT IN ({values}))"
    if isinstance(p, Range):
        ends = []
        if p.low is not None:
            ends.append(f"{f} {'>' if p.low_open else '>='} {sql_literal(p.low)}")
        if p.high is not None:
            ends.append(f"{f} {'<' if p.high_open else '<='} {sql_literal(p.high)}")
        return "(" + " AND ".join(ends) + ")"
    return f"({f} IS NULL)" if isinstance(p, IsNull) else f"({f} IS NOT NULL)"


def to_dict(p: Predicate | None) -> dict | None:
    if p is None:
        return None
    out = {"kind": type(p).__name__.lower()}
    for k, v in vars(p).items():
        out[k] = [to_dict(x) for x in v] if k == "parts" else list(v) if isinstance(v, tuple) else v
    return out


def from_dict(d: dict | str | None) -> Predicate | None:
    d = json.loads(d) if isinstance(d, str) else d
    if d is None:
        return None
    d = dict(d)
    try:
        kind = KINDS[d.pop("kind")]
        if "parts" in d:
            d["parts"] = tuple(map(from_dict, d["parts"]))
        if "values" in d:
            d["values"] = tuple(d["values"])
        return kind(**d)
    except (KeyError, TypeError) as e:
        raise InvalidPredicate(f"malformed predicate: {e}") from e
