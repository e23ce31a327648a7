"""Conflict strategies, as expressions over two cells and as aggregates over many.

``pair(a, b, ta, tb)`` decides between two cells that are both there; ``agg(v, ts)``
folds the cells of any number of replicas in one aggregation.  All but ``Custom``
and ``Concat(dedup=False)`` are commutative, associative and idempotent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import FLOATS, known, ordered, python_text


def _split(value: Column, sep: str) -> Column:
    """Trimmed parts of a text, without empty ones."""
    parts = F.transform(F.split(value.cast("string"), "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


@dataclass(frozen=True)
class Strategy:
    """How two versions of a cell become one."""

    name: ClassVar[str] = ""

    def rank(self, v: Column, ts: Column, kind: T.DataType) -> Column:
        """What the winner has most of; ties go to the greater value, so the order of replicas never tells."""
        raise NotImplementedError

    def pair(self, a: Column, b: Column, ta: Column, tb: Column, kind: T.DataType) -> Column:
        ra, rb = self.rank(a, ta, kind), self.rank(b, tb, kind)
        return F.when(rb > ra, b).otherwise(a)

    def agg(self, v: Column, ts: Column, kind: T.DataType) -> Column:
        return F.max_by(v, F.when(v.isNotNull(), self.rank(v, ts, kind)))

    def params(self) -> dict:
        return {}


@dataclass(frozen=True)
class LWW(Strategy):
    """The later time stamp; at the same time the greater value (as text of Python's with ``text_ties``)."""

    name: ClassVar[str] = "lww"
    text_ties: bool = False

    def rank(self, v, ts, kind):
        return F.struct(ts, *([known(v, kind).isNotNull()] if isinstance(kind, FLOATS) else []), python_text(v, kind) if self.text_ties else ordered(v, kind))

    def params(self):
        return {"text_ties": True} if self.text_ties else {}


@dataclass(frozen=True)
class MaxWins(Strategy):
    """The greater value; NaN loses."""

    name: ClassVar[str] = "max"

    def rank(self, v, ts, kind):
        return F.struct(known(v, kind).isNotNull(), ordered(known(v, kind), kind))

    def agg(self, v, ts, kind):
        # Plain maxima need no ordering key, and partial aggregation keeps one number.
        return F.coalesce(F.max(known(v, kind)), F.max(v)) if isinstance(kind, FLOATS) else F.max(v) if isinstance(kind, T.AtomicType) else super().agg(v, ts, kind)


@dataclass(frozen=True)
class MinWins(Strategy):
    """The smaller value; NaN loses."""

    name: ClassVar[str] = "min"

    def pair(self, a, b, ta, tb, kind):
        ka, kb = ordered(known(a, kind), kind), ordered(known(b, kind), kind)
        return F.when(ka.isNull() | (kb < ka), b).otherwise(a)

    def agg(self, v, ts, kind):
        if isinstance(kind, T.AtomicType):
            return F.coalesce(F.min(known(v, kind)), F.min(v)) if isinstance(kind, FLOATS) else F.min(v)
        return F.min_by(v, F.when(v.isNotNull(), ordered(v, kind)))


@dataclass(frozen=True)
class UnionSet(Strategy):
    """The sorted union of the trimmed parts of both texts; a value that meets no other stays as it is."""

    name: ClassVar[str] = "union"
    separator: str = ","

    def pair(self, a, b, ta, tb, kind):
        parts = F.array_sort(F.array_union(_split(a, self.separator), _split(b, self.separator)))
        return F.when(a == b, a).otherwise(F.array_join(parts, self.separator))

    def agg(self, v, ts, kind):
        seen = F.collect_set(v.cast("string"))
        parts = F.array_sort(F.array_distinct(F.flatten(F.transform(seen, lambda x: _split(x, self.separator)))))
        return F.when(F.size(seen) == 1, seen[0]).when(F.size(seen) > 1, F.array_join(parts, self.separator))

    def params(self):
        return {"separator": self.separator}


@dataclass(frozen=True)
class Concat(Strategy):
    """Sorted parts of both texts, each once (with ``dedup``) or as often as they come."""

    name: ClassVar[str] = "concat"
    separator: str = " | "
    dedup: bool = True

    def _parts(self, v: Column) -> Column:
        if self.dedup:
            return _split(v, self.separator)
        return F.split(v.cast("string"), "\\Q" + self.separator + "\\E")

    def pair(self, a, b, ta, tb, kind):
        both = F.concat(self._parts(a), self._parts(b))
        joined = F.array_join(F.array_sort(F.array_distinct(both) if self.dedup else both), self.separator)
        return F.when(a == b, a).otherwise(joined)

    def agg(self, v, ts, kind):
        seen = F.collect_set(v.cast("string")) if self.dedup else F.collect_list(v.cast("string"))
        parts = F.flatten(F.transform(seen, self._parts))
        parts = F.array_sort(F.array_distinct(parts) if self.dedup else parts)
        return F.when(F.size(seen) == 1, seen[0]).when(F.size(seen) > 1, F.array_join(parts, self.separator))

    def params(self):
        return {"separator": self.separator, "dedup": self.dedup}


@dataclass(frozen=True)
class Priority(Strategy):
    """The value furthest in ``levels``; others are before all; ties go to the greater text."""

    name: ClassVar[str] = "priority"
    levels: tuple[str, ...] = ()

    def rank(self, v, ts, kind):
        text = v.cast("string")
        place = F.array_position(F.array(*(F.lit(x) for x in self.levels)).cast("array<string>"), text)
        return F.struct(place, text)

    def params(self):
        return {"levels": list(self.levels)}


@dataclass(frozen=True)
class LongestWins(Strategy):
    """The longer text, in characters; then the later; then the greater."""

    name: ClassVar[str] = "longest"

    def rank(self, v, ts, kind):
        return F.struct(F.char_length(v.cast("string")), ts, ordered(v, kind))


@dataclass(frozen=True)
class Mean(Strategy):
    """The mean of numbers, of many cells the mean of all; not associative pair by pair.  Of anything else the later."""

    name: ClassVar[str] = "avg"

    def pair(self, a, b, ta, tb, kind):
        if not isinstance(kind, T.NumericType):
            return LWW().pair(a, b, ta, tb, kind)
        return ((a.cast("double") + b.cast("double")) / 2).cast(kind)

    def agg(self, v, ts, kind):
        return F.avg(v).cast(kind) if isinstance(kind, T.NumericType) else LWW().agg(v, ts, kind)


@dataclass(frozen=True)
class Custom(Strategy):
    """A function of two Columns, or of (a, b, ta, tb); many cells are folded by time, then value."""

    name: ClassVar[str] = "custom"
    fn: Callable[..., Column] | None = None
    times: bool = False

    def _call(self, a, b, ta, tb):
        return self.fn(a, b, ta, tb) if self.times else self.fn(a, b)

    def pair(self, a, b, ta, tb, kind):
        return self._call(a, b, ta, tb)

    def agg(self, v, ts, kind):
        cells = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(ts.alias("t"), v.alias("v")))))
        rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
        folded = F.reduce(rest, cells[0], lambda s, x: F.struct(F.greatest(s["t"], x["t"]).alias("t"), self._call(s["v"], x["v"], s["t"], x["t"]).cast(kind).alias("v")))
        return F.when(F.size(cells) > 0, folded["v"])


STRATEGIES: dict[str, type[Strategy]] = {c.name: c for c in (LWW, MaxWins, MinWins, UnionSet, Concat, Priority, LongestWins, Mean)}
#: Other names that the merge language and stored schemas may use.
ALIASES = {"latest": "lww", "last": "lww", "last_writer_wins": "lww", "maxwins": "max", "minwins": "min", "unionset": "union", "set": "union", "longestwins": "longest", "mean": "avg", "average": "avg"}
_CUSTOM: dict[str, Custom] = {}


def register_strategy(name: str, fn: Callable[..., Column], times: bool = False) -> None:
    """Make ``custom:name`` a strategy."""
    _CUSTOM[name] = Custom(fn, times)


def strategy(given: str | Strategy | Mapping) -> Strategy:
    """A strategy by name, as ``name:argument`` or as a stored mapping."""
    if isinstance(given, Strategy):
        return given
    if isinstance(given, Mapping):
        params = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k != "strategy"}
        return STRATEGIES[given["strategy"]](**params)
    name, _, argument = given.partition(":")
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key == "custom":
        if argument not in _CUSTOM:
            raise ValueError(f"no strategy custom:{argument} is registered")
        return _CUSTOM[argument]
    if key not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; known are {', '.join(sorted(STRATEGIES))} and custom:<name>")
    if key == "priority":
        return Priority(tuple(x.strip() for x in argument.split(",") if x.strip()))
    if key in ("union", "concat") and argument:
        return STRATEGIES[key](argument)
    return STRATEGIES[key]()


@dataclass
class MergeSchema:
    """Strategies by column, and that of all other columns."""

    default: Strategy = field(default_factory=LWW)
    columns: dict[str, Strategy] = field(default_factory=dict)

    @classmethod
    def of(cls, given: MergeSchema | Mapping[str, str | Strategy] | None, default: str | Strategy = "lww") -> MergeSchema:
        if isinstance(given, MergeSchema):
            return given
        return cls(strategy(default), {c: strategy(s) for c, s in (given or {}).items()})

    def __getitem__(self, column: str) -> Strategy:
        return self.columns.get(column, self.default)

    def to_json(self) -> str:
        """Names and parameters; functions of ``Custom`` can't be stored."""
        def one(s: Strategy) -> dict:
            if isinstance(s, Custom):
                raise ValueError("a custom strategy's function can't be stored; register it and name it again")
            return {"strategy": s.name, **s.params()}

        return json.dumps({"default": one(self.default), "columns": {c: one(s) for c, s in self.columns.items()}}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> MergeSchema:
        stored = json.loads(text)
        return cls(strategy(stored["default"]), {c: strategy(s) for c, s in stored["columns"].items()})
