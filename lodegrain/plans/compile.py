"""Compilation of decoders to staged projections.

A decoder compiles to a value expression and issue terms. Whatever later steps use more than once is
bound to a temporary column of a stage, and stages become successive projections: this keeps the plan
linear in the number of steps, where nested expressions would double with each.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import _to_seq
from pyspark.sql.functions.builtin import _unresolved_named_lambda_variable

ISSUE_DDL = "struct<path:array<string>,code:string,message:string,meta:string,custom_message:boolean>"
ISSUES_DDL = f"array<{ISSUE_DDL}>"

Path = tuple  # of str and Column


@dataclass(frozen=True)
class Source:
    """What a decoder reads: a typed column, a variant, a row of columns, or nothing.

    boundary: `object`, `json` or `record`, which decides what an absent or misplaced field means.
    """

    kind: str
    column: Column | None = None
    dtype: T.DataType | None = None
    boundary: str = "object"
    level: int = 0
    fields: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def is_null(self) -> Column:
        if self.kind == "absent":
            return F.lit(True)
        if self.kind == "row":
            return F.lit(False)
        if self.kind == "variant":
            return self.column.isNull() | F.is_variant_null(self.column)
        return self.column.isNull()


@dataclass(frozen=True)
class Out:
    """A value, null where there are issues; terms: ("one", issue or null) or ("many", array of issues)."""

    value: Column
    terms: list
    level: int = 0


class Context:
    """Collects the stages of a compilation; inside a lambda of an array, variables bound around the result."""

    _names = itertools.count()

    def __init__(self, frame: DataFrame | None, nested: bool = False, depth: int = 0):
        self.frame, self.nested, self.depth = frame, nested, depth
        self.stages: list[dict[str, Column]] = []
        self.lets: list[tuple[Column, Column]] = []
        self.held: dict[tuple, tuple] = {}

    def bind(self, column: Column, level: int) -> tuple[Column, int]:
        if self.nested:
            variable = _unresolved_named_lambda_variable("b")
            self.lets.append((variable, column))
            return variable, level
        while len(self.stages) <= level:
            self.stages.append({})
        name = f"__decode_{next(self._names)}"
        self.stages[level][name] = column
        return F.col(name), level + 1

    def shared(self, decoder, src: Source) -> tuple[Column, int]:
        """The typed value of a source, bound once for all fields that read it by one decoder."""
        key = (id(decoder), id(src.column), src.level)
        if key not in self.held:
            self.held[key] = (decoder, src.column, self.bind(decoder.value(src.column, src.dtype), src.level))
        return self.held[key][-1]

    def inner(self) -> "Context":
        return Context(self.frame, True, self.depth)

    def close(self, body: Column) -> Column:
        """The body with every bound variable in its scope, each evaluated once."""
        sql = SparkContext._active_spark_context._jvm.PythonSQLUtils
        for variable, column in reversed(self.lets):
            f = sql.lambdaFunction(body._jc, _to_seq(SparkContext._active_spark_context, [variable._jc]))
            held = Column(sql.fn("transform", _to_seq(SparkContext._active_spark_context, [F.array(column)._jc, f])))
            body = held[0]
        return body

    def apply(self, frame: DataFrame) -> DataFrame:
        for stage in self.stages:
            if stage:
                frame = frame.select("*", *(c.alias(n) for n, c in stage.items()))
        return frame


def path_column(path: Path) -> Column:
    return F.array(*(p if isinstance(p, Column) else F.lit(str(p)) for p in path)) if path else F.array().cast("array<string>")


def issue(path: Path, code: str, message, meta=None, custom: bool = False) -> Column:
    """An issue; message: text or Column, meta: None, a dictionary of plain values and Columns, or JSON text."""
    if meta is None:
        meta = F.lit("{}")
    elif isinstance(meta, dict):
        if any(isinstance(v, Column) for v in meta.values()):
            meta = F.to_json(F.struct(*((v if isinstance(v, Column) else _literal(v)).alias(k) for k, v in meta.items())))
        else:
            meta = F.lit(json.dumps(meta, ensure_ascii=False, separators=(",", ":"), default=str))
    elif isinstance(meta, str):
        meta = F.lit(meta)
    return F.struct(
        path_column(path).alias("path"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        meta.alias("meta"),
        F.lit(custom).alias("custom_message"),
    )


def _literal(v) -> Column:
    return F.array(*(F.lit(x) for x in v)) if isinstance(v, (list, tuple)) else F.lit(v)


def none() -> Column:
    return F.lit(None).cast(ISSUE_DDL)


def empty() -> Column:
    return F.array().cast(ISSUES_DDL)


def failed(terms: list) -> Column:
    """Whether any term has an issue."""
    out = F.lit(False)
    for kind, c in terms:
        out = out | (c.isNotNull() if kind == "one" else F.size(c) > 0)
    return out


def gathered(terms: list) -> Column:
    """All issues in order; rows without any allocate nothing."""
    if not terms:
        return empty()
    runs = []
    for kind, group in itertools.groupby(terms, key=lambda t: t[0]):
        cols = [c for _, c in group]
        runs += [F.filter(F.array(*cols), lambda x: x.isNotNull())] if kind == "one" else cols
    joined = runs[0] if len(runs) == 1 else F.concat(*runs)
    return F.when(failed(terms), joined).otherwise(empty())


def root_of(frame: DataFrame, boundary: str) -> Source:
    fields = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in frame.schema.fields}
    return Source("row", None, frame.schema, boundary, 0, fields)


def child(source: Source, name: str) -> tuple[Source, Column | bool]:
    """The field of a source, and whether it is there: known when planned for columns, a Column otherwise."""
    keep = {"boundary": source.boundary, "level": source.level}
    if source.kind == "row":
        if name not in source.fields:
            return Source("absent", **keep), False
        c, t = source.fields[name]
        return _typed(c, t, keep), True
    if source.kind == "variant":
        if "'" in name and '"' in name:
            raise ValueError(f"a JSON field name may hold one kind of quote: {name}")
        quote = '"' if "'" in name else "'"
        c = F.try_variant_get(source.column, f"$[{quote}{name}{quote}]", "variant")
        return Source("variant", c, None, **keep), c.isNotNull()
    if source.kind == "typed" and isinstance(source.dtype, T.StructType):
        if name not in source.dtype.names:
            return Source("absent", **keep), False
        return _typed(source.column.getField(name), source.dtype[name].dataType, keep), True
    if source.kind == "typed" and isinstance(source.dtype, T.MapType):
        c = F.try_element_at(source.column, F.lit(name))
        return _typed(c, source.dtype.valueType, keep), F.coalesce(F.map_contains_key(source.column, name), F.lit(False))
    return Source("absent", **keep), False


def _typed(c: Column, t: T.DataType, keep: dict) -> Source:
    return Source("variant", c, None, **keep) if isinstance(t, T.VariantType) else Source("typed", c, t, **keep)


def source_of(c: Column, t: T.DataType, boundary: str, level: int) -> Source:
    return _typed(c, t, {"boundary": boundary, "level": level})
