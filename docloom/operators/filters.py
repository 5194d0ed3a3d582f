"""The structured filter language: a dict of field to condition, compiled to one Column."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _NotNull:
    def __repr__(self) -> str:
        return "NOT_NULL"


#: The field has a value.
NOT_NULL = _NotNull()


@dataclass(frozen=True)
class Range:
    """Bounds on a scalar: one lower (gt or ge) and one upper (lt or le) at most, one of them at least."""

    gt: Any = None
    ge: Any = None
    lt: Any = None
    le: Any = None

    def __post_init__(self) -> None:
        given = {k: v for k, v in vars(self).items() if v is not None}
        if not given or {"gt", "ge"} <= given.keys() or {"lt", "le"} <= given.keys():
            raise ValueError("a Range needs a bound, and at most one lower and one upper")
        if any(isinstance(v, list | tuple | set | dict) for v in given.values()):
            raise ValueError("bounds of a Range are scalars")

    def on(self, c: Column) -> Column:
        terms = [f(c, v) for f, v in ((Column.__gt__, self.gt), (Column.__ge__, self.ge), (Column.__lt__, self.lt), (Column.__le__, self.le)) if v is not None]
        out = terms[0]
        for t in terms[1:]:
            out = out & t
        return out


@dataclass(frozen=True)
class Contains:
    """A literal part of a text; case counts only if asked for."""

    text: str
    case_sensitive: bool = False

    def __post_init__(self) -> None:
        if not self.text:
            raise ValueError("Contains needs a text")

    def on(self, c: Column) -> Column:
        return F.contains(c, F.lit(self.text)) if self.case_sensitive else F.contains(F.lower(c), F.lit(self.text.lower()))


NAME = re.compile(r"[A-Za-z_]\w*", re.ASCII)


def field(df: DataFrame, name: str) -> Column:
    if not NAME.fullmatch(name.lstrip("@")):
        raise ValueError(f"not a field name: {name!r}")
    if name not in df.columns:
        raise ValueError(f"no field {name!r}; there are {df.columns}")
    return F.col(f"`{name}`")


def equal(df: DataFrame, name: str, value: Any) -> Column:
    """A float also meets a single-precision field that was rounded from it."""
    c = field(df, name)
    if value is None:
        raise ValueError(f"{name}: comparing with None finds nothing; leave the field out, or use NOT_NULL")
    if isinstance(value, float) and isinstance(df.schema[name].dataType, T.FloatType):
        return c == F.lit(value).cast("float")
    return c == F.lit(value)


def predicate(df: DataFrame, where: Mapping[str, Any] | None = None, key_range: tuple[str, Any, Any] | None = None) -> Column:
    """All conditions joined by AND. An empty membership is false: the plan reads nothing then."""
    out = F.lit(True)
    for name, value in (where or {}).items():
        if value is NOT_NULL:
            term = field(df, name).isNotNull()
        elif isinstance(value, Range | Contains):
            term = value.on(field(df, name))
        elif isinstance(value, list | tuple | set | frozenset):
            values = list(value)
            if not values:
                return F.lit(False)
            term = equal(df, name, values[0])
            if len(values) > 1:
                kind = df.schema[name].dataType
                term = field(df, name).isin(*(F.lit(v).cast("float") for v in values)) if isinstance(kind, T.FloatType) else field(df, name).isin(*values)
        else:
            term = equal(df, name, value)
        out = out & term
    if key_range:
        name, low, high = key_range
        out = out & (field(df, name) >= F.lit(low)) & (field(df, name) < F.lit(high))
    return out


def order_columns(df: DataFrame, spec: str) -> list[Column]:
    """'field [ASC|DESC], ...' as sort columns."""
    out = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(@?[A-Za-z_]\w*)(?:\s+(ASC|DESC))?\s*", part, re.ASCII | re.IGNORECASE)
        if not m:
            raise ValueError(f"not a sort order: {spec!r}")
        c = field(df, m[1])
        out.append(c.desc() if (m[2] or "").upper() == "DESC" else c.asc())
    return out
