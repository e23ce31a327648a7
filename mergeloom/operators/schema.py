"""Schema drift between versions: widening, policies, compatibility."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLICIES = ("union", "intersection", "left_priority", "right_priority")
_WIDEN: dict[frozenset[str], T.DataType] = {}


def register_widening(a: T.DataType, b: T.DataType, to: T.DataType) -> None:
    """Let columns of types ``a`` and ``b`` become ``to``."""
    _WIDEN[frozenset((a.simpleString(), b.simpleString()))] = to


# Fixed rules: whole with whole and fractional with fractional numbers go to the wider type; 32-bit
# whole with 32-bit fractional stays 32 bits; 64-bit whole with fractional becomes double.
for _a, _b, _to in (
    (T.IntegerType(), T.LongType(), T.LongType()),
    (T.FloatType(), T.DoubleType(), T.DoubleType()),
    (T.IntegerType(), T.FloatType(), T.FloatType()),
    (T.LongType(), T.DoubleType(), T.DoubleType()),
    (T.IntegerType(), T.DoubleType(), T.DoubleType()),
):
    register_widening(_a, _b, _to)
    register_widening(T.ArrayType(_a), T.ArrayType(_b), T.ArrayType(_to))


def widen(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that holds both by the rules; None if there is none."""
    return a if a.simpleString() == b.simpleString() else _WIDEN.get(frozenset((a.simpleString(), b.simpleString())))


def widen_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """As ``widen``, and text where the rules know nothing: a merge must end with some type."""
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    found = widen(a, b)
    if found is None and isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    return found or T.StringType()


@dataclass
class Evolution:
    """The common schema and how it came about; changes: (column, change, old type, new type)."""

    schema: T.StructType
    changes: list[tuple[str, str, str | None, str | None]]
    defaults: Mapping[str, Any] = field(default_factory=dict)
    renamed: dict[str, str] = field(default_factory=dict)

    @property
    def compatible(self) -> bool:
        return not any(c[1] == "incompatible" for c in self.changes)

    def rename(self, old: str, new: str) -> Evolution:
        """With one more column renamed."""
        return Evolution(self.schema, [*self.changes, (new, "renamed", old, None)], self.defaults, {**self.renamed, old: new})

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` in the common schema; what it lacks is the default, or null."""
        df = df.withColumnsRenamed({o: n for o, n in self.renamed.items() if o in df.columns})
        cells = []
        for f in self.schema:
            value = F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
            cells.append((F.coalesce(value, F.lit(self.defaults[f.name]).cast(f.dataType)) if f.name in self.defaults else value).alias(f.name))
        return df.select(*cells)

    def changes_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(sorted(self.changes), "column string, change string, old_type string, new_type string")


def evolve(old: T.StructType, new: T.StructType, policy: str = "union", defaults: Mapping[str, Any] | None = None, allow_narrowing: bool = False) -> Evolution:
    """The common schema of two.

    union keeps all columns, intersection the common ones; left_priority and
    right_priority keep all and take the type of their side.  Where types can't
    be widened the old one stays and the column is incompatible, or the new one
    is taken with ``allow_narrowing``.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    a, b = ({f.name: f.dataType for f in s} for s in (old, new))
    fields, changes = [], []
    for name in [*a, *(n for n in b if n not in a)]:
        ta, tb = a.get(name), b.get(name)
        text = lambda t: t.simpleString() if t is not None else None
        if ta is None or tb is None:
            if policy != "intersection":
                fields.append(T.StructField(name, ta if ta is not None else tb))
            changes.append((name, "added" if ta is None else "removed", text(ta), text(tb)))
            continue
        if ta == tb:
            kind, change = ta, None
        elif policy in ("left_priority", "right_priority"):
            kind, change = (ta if policy == "left_priority" else tb), "type_changed"
        elif (wide := widen(ta, tb)) is not None:
            kind, change = wide, "widened"
        else:
            kind, change = (tb, "narrowed") if allow_narrowing else (ta, "incompatible")
        fields.append(T.StructField(name, kind))
        if change:
            changes.append((name, change, text(ta), text(tb)))
    return Evolution(T.StructType(fields), changes, defaults or {})


def compatible(old: T.StructType, new: T.StructType) -> bool:
    """Every old column is in the new schema, of the same or a wider type."""
    b = {f.name: f.dataType for f in new}
    return all(f.name in b and widen(f.dataType, b[f.name]) is not None for f in old)


def union_evolved(a: DataFrame, b: DataFrame, policy: str = "union", defaults: Mapping[str, Any] | None = None, allow_narrowing: bool = False) -> DataFrame:
    """Rows of both in their common schema."""
    both = evolve(a.schema, b.schema, policy, defaults, allow_narrowing)
    return both.apply(a).unionByName(both.apply(b))
