"""Conditions on columns, composed into one predicate that Spark can push towards the scan.

A condition is a function-free description; ``compile`` turns it into a Column that is never null: what can't be
decided is false, as in a store of documents, not unknown, as in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Condition:
    def compile(self) -> Column:
        return F.coalesce(self._column(), F.lit(False))

    def _column(self) -> Column:
        raise NotImplementedError


@dataclass
class MatchValue(Condition):
    """Equal to a boolean, whole number or text."""

    key: str
    value: Any

    def _column(self):
        return F.col(self.key) == self.value


@dataclass
class MatchAny(Condition):
    """One of some values; of an array, any element."""

    key: str
    values: Sequence
    array: bool = False

    def _column(self):
        return F.arrays_overlap(F.col(self.key), F.array(*map(F.lit, self.values))) if self.array else F.col(self.key).isin(*self.values)


@dataclass
class MatchExcept(Condition):
    """At least one value that is none of some values; so an array passes if any element does."""

    key: str
    values: Sequence
    array: bool = False

    def _column(self):
        return F.exists(self.key, lambda x: ~x.isin(*self.values)) if self.array else ~F.col(self.key).isin(*self.values)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), 1)


@dataclass
class MatchText(Condition):
    """Every token of the query occurs, in any order."""

    key: str
    text: str

    def _column(self):
        have = _tokens(F.col(self.key))
        return F.forall(_tokens(F.lit(self.text)), lambda t: F.array_contains(have, t))


@dataclass
class MatchPhrase(Condition):
    """The tokens of the query occur side by side."""

    key: str
    text: str

    def _column(self):
        joined = lambda t: F.concat(F.lit(" "), F.array_join(_tokens(t), " "), F.lit(" "))
        return F.contains(joined(F.col(self.key)), joined(F.lit(self.text)))


@dataclass
class Range(Condition):
    """Bounds on a number or a time."""

    key: str
    gt: Any = None
    gte: Any = None
    lt: Any = None
    lte: Any = None

    def _column(self):
        x = F.col(self.key)
        parts = [p for v, p in ((self.gt, lambda v: x > v), (self.gte, lambda v: x >= v), (self.lt, lambda v: x < v), (self.lte, lambda v: x <= v)) if v is not None for p in [p(F.lit(v))]]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


DatetimeRange = Range


@dataclass
class GeoBoundingBox(Condition):
    lon: str
    lat: str
    top_left: tuple[float, float]
    bottom_right: tuple[float, float]

    def _column(self):
        (west, north), (east, south) = self.top_left, self.bottom_right
        inside = F.col(self.lon).between(west, east) if west <= east else (F.col(self.lon) >= west) | (F.col(self.lon) <= east)
        return inside & F.col(self.lat).between(south, north)


EARTH_M = 6_371_000.0


@dataclass
class GeoRadius(Condition):
    lon: str
    lat: str
    center: tuple[float, float]
    metres: float

    def _column(self):
        lon, lat = (F.radians(F.lit(x)) for x in self.center)
        a = F.pow(F.sin((F.radians(self.lat) - lat) / 2), 2) + F.cos(F.radians(self.lat)) * F.cos(lat) * F.pow(F.sin((F.radians(self.lon) - lon) / 2), 2)
        return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0)))) <= self.metres


@dataclass
class GeoPolygon(Condition):
    """Inside a ring, by the parity of the edges that a ray crosses, and in none of its holes."""

    lon: str
    lat: str
    exterior: Sequence[tuple[float, float]]
    interiors: Sequence[Sequence[tuple[float, float]]] = ()

    def _column(self):
        return reduce(lambda a, b: a & ~b, map(self._within, self.interiors), self._within(self.exterior))

    def _within(self, ring):
        x, y, crossed = F.col(self.lon), F.col(self.lat), F.lit(0)
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if y1 != y2:
                hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
                crossed = crossed + hit.cast("int")
        return crossed % 2 == 1


@dataclass
class ValuesCount(Condition):
    key: str
    gt: int | None = None
    gte: int | None = None
    lt: int | None = None
    lte: int | None = None

    def _column(self):
        n = F.size(self.key)
        parts = [p(v) for v, p in ((self.gt, lambda v: n > v), (self.gte, lambda v: n >= v), (self.lt, lambda v: n < v), (self.lte, lambda v: n <= v)) if v is not None]
        return F.col(self.key).isNotNull() & reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass
class IsEmpty(Condition):
    key: str

    def _column(self):
        return F.col(self.key).isNull() | (F.size(self.key) == 0)


@dataclass
class IsNull(Condition):
    key: str

    def _column(self):
        return F.col(self.key).isNull()


@dataclass
class HasId(Condition):
    ids: Sequence
    key: str = "chunk_id"

    def _column(self):
        return F.col(self.key).isin(*self.ids)


HasVector = lambda key: Not(IsNull(key))


@dataclass
class Nested(Condition):
    """Some element of an array of structs meets a condition on its fields; ``on`` gets the element."""

    key: str
    on: Any

    def _column(self):
        return F.exists(self.key, self.on)


@dataclass
class Not(Condition):
    inner: Condition

    def _column(self):
        return ~self.inner.compile()


@dataclass
class MinShould(Condition):
    conditions: Sequence[Condition]
    least: int

    def _column(self):
        return reduce(lambda a, b: a + b, [x.compile().cast("int") for x in self.conditions], F.lit(0)) >= self.least


@dataclass
class Filter(Condition):
    """All of ``must``, one of ``should`` (if there are any), none of ``must_not``."""

    must: Sequence[Condition] = ()
    should: Sequence[Condition] = ()
    must_not: Sequence[Condition] = ()

    def _column(self):
        out = reduce(lambda a, b: a & b, [x.compile() for x in self.must], F.lit(True))
        if self.should:
            out = out & reduce(lambda a, b: a | b, [x.compile() for x in self.should])
        return reduce(lambda a, b: a & ~b, [x.compile() for x in self.must_not], out)


@dataclass(frozen=True)
class Field:
    """A filterable field: its type, the operator that its argument stands for, and whether one must be given."""

    name: str
    type: str
    condition: str | None = "=="
    required: bool = False


_ALLOWED = {"keyword": {"==", "!=", "any", "except"}, "integer": {"==", "!=", ">", ">=", "<", "<=", "any", "except"}, "float": {">", ">=", "<", "<="}, "boolean": {"==", "!="}}
_BOUND = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}


def make_filter(fields: Sequence[Field], values: dict[str, Any], prefix: str = "") -> Filter:
    """The filter for given field values; unknown, missing and unsupported ones are errors, nulls mean not asked."""
    known = {f.name: f for f in fields}
    if unknown := set(values) - set(known):
        raise ValueError(f"not filterable: {', '.join(sorted(unknown))}")
    must, must_not = [], []
    for f in fields:
        value = values.get(f.name)
        if value is None:
            if f.required:
                raise ValueError(f"{f.name} is required")
            continue
        if f.condition is None:
            continue
        if f.condition not in _ALLOWED.get(f.type, ()):
            raise ValueError(f"{f.condition} isn't supported for {f.type} fields")
        key = prefix + f.name
        if f.condition == "==":
            must.append(MatchValue(key, value))
        elif f.condition == "!=":
            must_not.append(MatchValue(key, value))
        elif f.condition == "any":
            must.append(MatchAny(key, value))
        elif f.condition == "except":
            must.append(MatchExcept(key, value))
        else:
            must.append(Range(key, **{_BOUND[f.condition]: value}))
    return Filter(must, (), must_not)


def wrap_filters(search, fields: Sequence[Field]):
    """``search`` with one keyword argument for each field instead of a filter."""

    def wrapped(*args, **kwargs):
        asked = {f.name: kwargs.pop(f.name, None) for f in fields}
        return partial(search, condition=make_filter(fields, asked))(*args, **kwargs)

    return wrapped


def is_test_file(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    name, parent = F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.startswith(name, F.lit("test_")) | stem.rlike("(_test|_tests|_spec)$") | parent.isin("test", "tests", "spec", "specs", "__tests__")


def apply_filters(hits: DataFrame, include_tests: bool, languages: Sequence[str] | None = None, path: str = "path", language: str = "lang") -> DataFrame:
    """Languages first (rows without one go), then test files."""
    if languages:
        hits = hits.filter(MatchAny(language, list(languages)).compile())
    return hits if include_tests else hits.filter(~is_test_file(F.col(path)))
