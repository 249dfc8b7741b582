"""Decoding of whole frames, and operators on the results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compile import ISSUES_DDL, Context, Source, empty, failed, gathered, issue, root_of, source_of
from . import guard, issues as I
from .core import Decoder, Verdict


@dataclass(frozen=True)
class Decoded:
    """A frame with the columns value and issues beside those of the input.

    A row is sound where issues is empty; value may be null in sound rows and is null in others.
    """

    frame: DataFrame

    def is_ok(self) -> DataFrame:
        return self.frame.filter(F.size("issues") == 0)

    def is_err(self) -> DataFrame:
        return self.frame.filter(F.size("issues") > 0)

    def valid(self) -> DataFrame:
        """Values of the sound rows, a struct's fields as columns."""
        rows = self.is_ok()
        return rows.select("value.*") if isinstance(rows.schema["value"].dataType, T.StructType) else rows.select("value")

    def rejected(self) -> DataFrame:
        """Input columns and issues of the other rows."""
        return self.is_err().drop("value")

    def issues(self, *keys: str) -> DataFrame:
        return I.exploded(self.frame, list(keys))

    def map(self, f: Callable[[Column], Column]) -> "Decoded":
        return Decoded(self.frame.withColumn("value", F.when(F.size("issues") == 0, f(F.col("value")))))

    def flat_map(self, f: Callable[[Column], Verdict]) -> "Decoded":
        """Rules over the value whose paths are taken as they are."""
        verdict = f(F.col("value"))
        made = [F.when((F.size("issues") == 0) & F.coalesce(r.failing, F.lit(False)), issue(r.at, r.code, r.message, r.meta, r.custom)) for r in verdict.rules]
        more = F.filter(F.array(*made), lambda x: x.isNotNull()) if made else empty()
        frame = self.frame.withColumn("__more", more)
        sound = (F.size("issues") == 0) & (F.size("__more") == 0)
        return Decoded(frame.withColumn("value", F.when(sound, verdict.value)).withColumn("issues", F.concat("issues", "__more")).drop("__more"))

    def fold(self, on_ok: Callable[[Column], Column], on_err: Callable[[Column], Column], name: str = "folded") -> DataFrame:
        return self.frame.withColumn(name, F.when(F.size("issues") == 0, on_ok(F.col("value"))).otherwise(on_err(F.col("issues"))))

    def or_else_throw(self, message: Callable[[Column], Column] | None = None) -> DataFrame:
        """Values; running it raises if any row has issues, by default with the messages joined by `; `."""
        joined = lambda i: F.array_join(F.transform(i, lambda x: F.concat(I.pointer(x["path"]), F.lit(": "), x["message"])), "; ")
        error = (message or joined)(F.col("issues"))
        return self.frame.withColumn("value", F.when(F.size("issues") == 0, F.col("value")).otherwise(F.raise_error(error)))

    get_or_throw = or_else_throw

    def resolve(self, resolver=None, locale: str | None = None) -> "Decoded":
        return Decoded(self.frame.withColumn("issues", I.resolve(F.col("issues"), resolver, locale)))


def _run(frame: DataFrame, decoder: Decoder, source: Callable[[DataFrame], Source], path: tuple) -> Decoded:
    for name in ("value", "issues"):
        if name in frame.columns:
            raise ValueError(f"a column is already called {name}")
    with guard.decoding():
        ctx = Context(frame)
        out = decoder.compile(ctx, source(frame), path)
        staged = ctx.apply(frame)
        value = F.when(~failed(out.terms), out.value) if out.terms else out.value
        done = staged.select(*(F.col(f"`{c}`") for c in frame.columns), value.alias("value"), gathered(out.terms).cast(ISSUES_DDL).alias("issues"))
    return Decoded(done)


def decode(frame: DataFrame, decoder: Decoder, boundary: str = "object", path: tuple = ()) -> Decoded:
    """Decode every row as an object of its columns; boundary `record` tells absent columns from nulls."""
    return _run(frame, decoder, lambda f: root_of(f, boundary), path)


def decode_column(frame: DataFrame, column: str, decoder: Decoder, path: tuple = ()) -> Decoded:
    """Decode one column: a variant as JSON, anything else by its type."""
    t = frame.schema[column].dataType
    return _run(frame, decoder, lambda f: source_of(F.col(f"`{column}`"), t, "json" if isinstance(t, T.VariantType) else "object", 0), path)


def indexed(frame: DataFrame, order: list[str], name: str = "index", per_range: int = 20) -> DataFrame:
    """Number rows from 0 in the order of unique keys, without one task for all of them.

    A bounded sample of the keys gives boundaries of ranges, which the plan holds as literals, so every
    read of a row puts it in the same range. Rows are numbered in their range, after all rows of the
    ranges before it; ranges are a few for each shuffle partition, whatever the rows.
    """
    ranges = min(512, 2 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = frame.select(*order)
    n = keys.count()
    drawn = sorted(keys.sample(fraction=min(1.0, 2 * ranges * per_range / n), seed=1).limit(4 * ranges * per_range).collect(), key=lambda r: tuple((x is not None, x) for x in r)) if n else []
    cuts = [drawn[len(drawn) * k // ranges] for k in range(1, ranges)] if len(drawn) >= ranges else []
    types = [frame.schema[c].dataType for c in order]
    cut = lambda r: F.struct(*(F.lit(x).cast(t).alias(f"_{k}") for k, (x, t) in enumerate(zip(r, types))))
    own = F.struct(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(order)))
    place = F.size(F.filter(F.array(*(cut(r) for r in cuts)), lambda x: x <= own)) if cuts else F.lit(0)
    ranged = frame.withColumn("__range", place)
    sizes = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    starts, total = [], 0
    for k in range(len(cuts) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    start = F.element_at(F.array(*(F.lit(x).cast("long") for x in starts)), F.col("__range") + 1)
    return ranged.withColumn(name, start + number).drop("__range")


def traverse(frame: DataFrame, decoder: Decoder, order: list[str], base: tuple = (), boundary: str = "object", prefix: bool = True) -> Decoded:
    """Decode rows as the elements of a list in the order of unique keys; issues carry base and the index.

    ``all_or_nothing`` tells whether the whole list is sound. Without prefix, issues carry no index.
    """
    numbered = indexed(frame, order)
    done = decode(numbered, decoder, boundary).frame
    if prefix:
        head = [F.lit(p) for p in base] + [F.col("index").cast("string")]
        done = done.withColumn("issues", F.transform("issues", lambda i: i.withField("path", F.concat(F.array(*head), i["path"]))))
    return Decoded(done)


def all_or_nothing(decoded: Decoded) -> DataFrame:
    """The values if no row has issues, else no rows; the check is one aggregate row."""
    bad = decoded.frame.agg(F.count_if(F.size("issues") > 0).alias("__bad"))
    return decoded.frame.crossJoin(F.broadcast(bad)).filter("__bad = 0").drop("__bad", "issues")


def combined(on: list[str], f: Callable[..., Column], *results: Decoded) -> Decoded:
    """Results of two or more sources with equal keys: f of the values, issues of all in order.

    A key that a source lacks is an issue at the root.
    """
    joined, names = None, []
    for k, r in enumerate(results):
        names.append((f"value_{k}", f"issues_{k}"))
        own = r.frame.select(*on, F.col("value").alias(names[-1][0]), F.col("issues").alias(names[-1][1]))
        joined = own if joined is None else joined.join(own, on, "full")
    lacking = F.array(issue((), "required", "is required"))
    held = [F.coalesce(F.col(i), lacking) for _, i in names]
    frame = joined.withColumn("issues", F.concat(*held))
    value = F.when(F.size("issues") == 0, f(*(F.col(v) for v, _ in names)))
    return Decoded(frame.select(*on, value.alias("value"), "issues"))


map2 = map3 = map4 = combined


def regroup(frame: DataFrame, header: list[str], line: list[str], order: list[str] | None = None, name: str = "lines") -> DataFrame:
    """One row a header with its lines as an array, in the order given: joined rows to parents and children.

    Lines of a header that an outer join left without a child are no lines.
    """
    child = F.struct(*((order or []) + line))
    there = F.lit(False)
    for c in line:
        there = there | F.col(c).isNotNull()
    lines = F.sort_array(F.collect_list(F.when(there, child)))
    return frame.groupBy(*header).agg(F.transform(lines, lambda x: F.struct(*(x[c].alias(c) for c in line))).alias(name))
