"""The merge language: text to a DataFrame plan.

    [EXPLAIN] MERGE source [, source ...] ON key [, key ...]
        [STRATEGY column = name[:argument] [, ...]]
        [WHERE condition] [HAVING condition] [MAP old -> new [, ...]] [LIMIT n]

Clauses after ON come in any order.  WHERE filters every source before the merge
(a value may be gone afterwards), HAVING the merged rows.  Conditions have =, !=,
<>, <, <=, >, >=, [NOT] LIKE, [NOT] IN, IS [NOT] NULL, AND, OR, NOT and parentheses.
Numbers compare as numbers when both sides are, else as text; the empty text counts
as null.  Words may be quoted with ' or ", which also keeps keywords as names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strategies import MergeSchema, register_strategy, strategy
from ..operators.merge import merge_many, provenance

_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<op><=|>=|<>|!=|->|[=<>(),:;])|(?P<word>[^\s,()'"=<>!:;]+))""")
_CLAUSES = ("STRATEGY", "WHERE", "HAVING", "MAP", "LIMIT")


class LanguageError(ValueError):
    """The text isn't a statement, or names what isn't there."""


@dataclass(frozen=True)
class Token:
    kind: str  # text, op, word
    value: str
    at: int

    def word(self, *names: str) -> bool:
        return self.kind == "word" and self.value.upper() in names

    def op(self, *names: str) -> bool:
        return self.kind == "op" and self.value in names


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    text = text.rstrip().rstrip(";")
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise LanguageError(f"can't read {text[at:at + 20]!r} at {at}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "text":
            value = value[1:-1].replace(value[0] * 2, value[0])
        out.append(Token(kind, value, m.start(kind)))
        at = m.end()
    return out


@dataclass
class Statement:
    """A parsed MERGE; conditions are functions from a row's columns to a Column."""

    sources: list[str]
    keys: list[str]
    strategies: dict[str, str] = field(default_factory=dict)
    where: Callable[[], Column] | None = None
    having: Callable[[], Column] | None = None
    renames: dict[str, str] = field(default_factory=dict)
    limit: int | None = None
    explain: bool = False
    where_columns: list[str] = field(default_factory=list)


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.i, self.columns = tokens(text), 0, []

    def peek(self) -> Token | None:
        return self.tokens[self.i] if self.i < len(self.tokens) else None

    def fail(self, wanted: str):
        t = self.peek()
        raise LanguageError(f"expected {wanted}, found {t.value!r} at {t.at}" if t else f"expected {wanted}, found the end")

    def take(self, what: str, test: Callable[[Token], bool]) -> str:
        t = self.peek()
        if t is None or not test(t):
            self.fail(what)
        self.i += 1
        return t.value

    def keyword(self, name: str) -> None:
        self.take(name, lambda t: t.word(name))

    def accept(self, test: Callable[[Token], bool]) -> bool:
        if (t := self.peek()) is not None and test(t):
            self.i += 1
            return True
        return False

    def name(self, what: str = "a name") -> str:
        return self.take(what, lambda t: t.kind in ("word", "text"))

    def several(self, one: Callable[[], object]) -> list:
        out = [one()]
        while self.accept(lambda t: t.op(",")):
            out.append(one())
        return out

    def statement(self) -> Statement:
        explain = self.accept(lambda t: t.word("EXPLAIN"))
        self.keyword("MERGE")
        sources = self.several(lambda: self.name("a source"))
        self.keyword("ON")
        st = Statement(sources, self.several(lambda: self.name("a key")), explain=explain)
        seen: set[str] = set()
        while self.peek() is not None:
            clause = self.take(" or ".join(_CLAUSES), lambda t: t.word(*_CLAUSES)).upper()
            if clause in seen:
                raise LanguageError(f"{clause} comes twice")
            seen.add(clause)
            if clause == "STRATEGY":
                st.strategies = dict(self.several(self.rule))
            elif clause == "MAP":
                st.renames = dict(self.several(self.rename))
            elif clause == "LIMIT":
                number = self.take("a number", lambda t: t.kind == "word" and t.value.isdigit())
                st.limit = int(number)
            elif clause == "WHERE":
                st.where = self.either()
                st.where_columns = list(self.columns)
            else:
                st.having = self.either()
        return st

    def rule(self) -> tuple[str, str]:
        column = self.name("a column")
        self.take("=", lambda t: t.op("="))
        name = self.name("a strategy")
        if self.accept(lambda t: t.op(":")):
            name += ":" + self.name("an argument")
        elif self.accept(lambda t: t.op("(")):
            name += ":" + ",".join(self.several(lambda: self.name("an argument")))
            self.take(")", lambda t: t.op(")"))
        return column, name

    def rename(self) -> tuple[str, str]:
        old = self.name("a column")
        if not self.accept(lambda t: t.op("->")):
            self.keyword("TO") if self.peek() and self.peek().word("TO") else self.keyword("AS")
        return old, self.name("a name")

    # Conditions.

    def either(self):
        parts = [self.both()]
        while self.accept(lambda t: t.word("OR")):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else lambda: _all(parts, lambda x, y: x | y)

    def both(self):
        parts = [self.inverse()]
        while self.accept(lambda t: t.word("AND")):
            parts.append(self.inverse())
        return parts[0] if len(parts) == 1 else lambda: _all(parts, lambda x, y: x & y)

    def inverse(self):
        if self.accept(lambda t: t.word("NOT")):
            inner = self.inverse()
            return lambda: ~inner()
        if self.accept(lambda t: t.op("(")):
            inner = self.either()
            self.take(")", lambda t: t.op(")"))
            return inner
        return self.comparison()

    def comparison(self):
        column = self.name("a column")
        self.columns.append(column)
        if self.accept(lambda t: t.word("IS")):
            negative = self.accept(lambda t: t.word("NOT"))
            self.keyword("NULL")
            return lambda: ~_empty(column) if negative else _empty(column)
        negative = self.accept(lambda t: t.word("NOT"))
        if self.accept(lambda t: t.word("LIKE")):
            pattern = self.name("a pattern")
            return lambda: _sure(F.col(column).cast("string").like(pattern), negative)
        if self.accept(lambda t: t.word("IN")):
            self.take("(", lambda t: t.op("("))
            values = self.several(lambda: self.name("a value"))
            self.take(")", lambda t: t.op(")"))
            return lambda: _sure(F.col(column).cast("string").isin(values), negative)
        if negative:
            self.fail("LIKE or IN")
        op = self.take("a comparison", lambda t: t.op("=", "!=", "<>", "<", "<=", ">", ">="))
        value = self.name("a value")
        return lambda: compared(column, op, value)


def _all(parts, op) -> Column:
    out = parts[0]()
    for p in parts[1:]:
        out = op(out, p())
    return out


def _empty(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


def _sure(condition: Column, negative: bool) -> Column:
    return F.coalesce(~condition if negative else condition, F.lit(False))


def compared(column: str, op: str, value: str) -> Column:
    """Numeric if both sides are numbers, else textual; a null is unequal to everything and in no order."""
    import operator

    ops = {"=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
    text = F.col(column).cast("string")
    out = ops[op](text, F.lit(value))
    try:
        number = F.lit(float(value))
    except ValueError:
        pass
    else:
        own = text.try_cast("double")
        out = F.when(own.isNotNull(), ops[op](own, number)).otherwise(out)
    return F.coalesce(out, F.lit(op in ("!=", "<>")))


def parse(text: str) -> Statement:
    return _Parser(text).statement()


class MergeLanguage:
    """Named sources and the statements over them; results are lazy DataFrames."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.sources = spark, {}

    def register(self, name: str, df: DataFrame) -> None:
        self.sources[name] = df
        df.createOrReplaceTempView(name)

    def unregister(self, name: str) -> None:
        self.sources.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def list_sources(self) -> list[str]:
        return sorted(self.sources)

    def source_info(self, name: str) -> dict:
        df = self._source(name)
        return {"name": name, "columns": df.columns, "rows": df.count()}

    @staticmethod
    def register_strategy(name: str, fn: Callable[..., Column]) -> None:
        """Make STRATEGY column = custom:name call ``fn(a, b)`` on Columns."""
        register_strategy(name, fn)

    def _source(self, name: str) -> DataFrame:
        if name not in self.sources:
            raise LanguageError(f"no source {name!r}; known are {', '.join(self.list_sources()) or 'none'}")
        return self.sources[name]

    def execute(self, text: str) -> DataFrame:
        """The merged rows; for EXPLAIN one row with the plan."""
        st = parse(text)
        if st.explain:
            return self.spark.createDataFrame([(self.explain(text),)], "plan string")
        return self._build(st)

    def _build(self, st: Statement) -> DataFrame:
        try:
            rules = MergeSchema.of({c: strategy(s) for c, s in st.strategies.items()})
        except ValueError as e:
            raise LanguageError(str(e)) from e
        frames = [self._source(s) for s in st.sources]
        every = {c for f in frames for c in f.columns}
        for c in [*st.keys, *st.strategies, *st.renames, *st.where_columns]:
            if c not in every:
                raise LanguageError(f"no column {c!r} in {', '.join(st.sources)}")
        if st.where is not None:
            lacking = [f.withColumns({c: F.lit(None).cast("string") for c in st.where_columns if c not in f.columns}) for f in frames]
            frames = [w.where(st.where()).select(f.columns) for w, f in zip(lacking, frames, strict=True)]
        out = merge_many(frames, st.keys, rules)
        if st.having is not None:
            out = out.where(st.having())
        if st.limit is not None:  # the smallest keys, so that the same rows come every time
            out = out.orderBy(*st.keys).limit(st.limit)
        return out.withColumnsRenamed(st.renames)

    def conflicts(self, text: str) -> DataFrame:
        """Rows (field, conflicts) for a statement: in how many keys a column has several values after WHERE."""
        st = parse(text)
        self._build(st)
        frames = [self._source(s) for s in st.sources]
        if st.where is not None:
            lacking = [f.withColumns({c: F.lit(None).cast("string") for c in st.where_columns if c not in f.columns}) for f in frames]
            frames = [w.where(st.where()).select(f.columns) for w, f in zip(lacking, frames, strict=True)]
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f, allowMissingColumns=True)
        fields = [c for c in rows.columns if c not in st.keys]
        per = rows.groupBy(*st.keys).agg(*((F.min(c) < F.max(c)).alias(c) for c in fields))
        counted = per.agg(*(F.count_if(F.col(c)).alias(c) for c in fields))
        return counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("conflicts")) for c in fields))).alias("x")).select("x.*")

    def provenance(self, text: str) -> DataFrame:
        """The provenance log of a statement over two sources, by its strategies."""
        st = parse(text)
        if len(st.sources) != 2:
            raise LanguageError("provenance is of two sources")
        return provenance(*(self._source(s) for s in st.sources), st.keys, {c: strategy(s) for c, s in st.strategies.items()})

    def explain(self, text: str) -> str:
        """Sources, keys, strategies and Spark's plan."""
        st = parse(text)
        df = self._build(st)
        lines = [f"MERGE {', '.join(st.sources)} ON {', '.join(st.keys)}", *(f"  strategy {c}: {s}" for c, s in st.strategies.items()), "  strategy of others: lww"]
        if st.where is not None:
            lines.append(f"  filter before the merge on {', '.join(dict.fromkeys(st.where_columns))}")
        if st.limit is not None:
            lines.append(f"  limit {st.limit} by key")
        return "\n".join([*lines, df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))])
