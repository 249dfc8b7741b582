"""Decoders of arrays and maps; size rules run once every element is sound."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plans.compile import Context, Out, Path, Source, empty, gathered, issue, none, source_of
from .core import Chain, Decoder


class _List(Decoder):
    def __init__(self, element: Decoder):
        self.element = element

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        required = issue(path, "required", "is required")
        wrong = lambda actual: issue(path, "type_mismatch", "expected array", {"expected": "array", "actual": actual})
        if src.kind == "variant":
            kind = F.schema_of_variant(src.column)
            problem = F.when(src.is_null, required).when(~kind.startswith("ARRAY"), wrong(kind))
            items, dtype = F.try_variant_get(src.column, "$", "array<variant>"), T.VariantType()
        elif src.kind == "typed" and isinstance(src.dtype, T.ArrayType):
            problem, items, dtype = F.when(src.is_null, required), src.column, src.dtype.elementType
        else:
            made = required if src.kind == "absent" else wrong(src.dtype.simpleString() if src.kind == "typed" else "object")
            return Out(F.lit(None), [("one", F.when(src.is_null, required).otherwise(made))], src.level)
        problem, level = ctx.bind(problem.otherwise(none()), src.level)

        def one(x: Column, i: Column) -> Column:
            inner = ctx.inner()
            out = self.element.compile(inner, source_of(x, dtype, src.boundary, 0), (*path, i.cast("string")))
            return inner.close(F.struct(out.value.alias("value"), gathered(out.terms).alias("issues")))

        done, level = ctx.bind(F.transform(items, one), max(level, src.level))
        found, level = ctx.bind(F.when(problem.isNotNull(), F.array(problem)).otherwise(F.coalesce(F.flatten(F.transform(done, lambda r: r["issues"])), empty())), level)
        return Out(F.when(F.size(found) == 0, F.transform(done, lambda r: r["value"])), [("many", found)], level)


class _Map(Decoder):
    def __init__(self, value: Decoder):
        self.value = value

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        required = issue(path, "required", "is required")
        wrong = lambda actual: issue(path, "type_mismatch", "expected object", {"expected": "object", "actual": actual})
        if src.kind == "variant":
            kind = F.schema_of_variant(src.column)
            problem = F.when(src.is_null, required).when(~kind.startswith("OBJECT"), wrong(kind))
            entries, dtype = F.map_entries(F.try_variant_get(src.column, "$", "map<string,variant>")), T.VariantType()
        elif src.kind == "typed" and isinstance(src.dtype, T.MapType):
            problem, entries, dtype = F.when(src.is_null, required), F.map_entries(src.column), src.dtype.valueType
        elif src.kind == "typed" and isinstance(src.dtype, T.StructType):
            # an object whose fields have one type
            dtype = src.dtype.fields[0].dataType
            problem = F.when(src.is_null, required)
            entries = F.when(~src.is_null, F.array(*(F.struct(F.lit(n).alias("key"), src.column.getField(n).alias("value")) for n in src.dtype.names)))
        else:
            made = required if src.kind == "absent" else wrong(src.dtype.simpleString() if src.kind == "typed" else "object")
            return Out(F.lit(None), [("one", F.when(src.is_null, required).otherwise(made))], src.level)
        problem, level = ctx.bind(problem.otherwise(none()), src.level)

        def one(e: Column) -> Column:
            inner = ctx.inner()
            key = e["key"].cast("string")
            out = self.value.compile(inner, source_of(e["value"], dtype, src.boundary, 0), (*path, key))
            return inner.close(F.struct(key.alias("key"), out.value.alias("value"), gathered(out.terms).alias("issues")))

        done, level = ctx.bind(F.transform(entries, one), max(level, src.level))
        found, level = ctx.bind(F.when(problem.isNotNull(), F.array(problem)).otherwise(F.coalesce(F.flatten(F.transform(done, lambda r: r["issues"])), empty())), level)
        pairs = F.map_from_entries(F.transform(done, lambda r: F.struct(r["key"], r["value"])))
        return Out(F.when(F.size(found) == 0, pairs), [("many", found)], level)


class _Sized(Chain):
    noun = "elements"

    def nonempty(self):
        return self._test(lambda v: F.size(v) < 1, "too_small", "must not be empty", {"min": 1, "actual": 0})

    def min_size(self, n: int):
        return self._test(lambda v: F.size(v) < n, "too_small", f"must have at least {n} {self.noun}", lambda v: {"min": n, "actual": F.size(v)})

    def max_size(self, n: int):
        return self._test(lambda v: F.size(v) > n, "too_big", f"must have at most {n} {self.noun}", lambda v: {"max": n, "actual": F.size(v)})

    def fixed_size(self, n: int):
        return self._test(lambda v: F.size(v) != n, "invalid_size", f"must have exactly {n} {self.noun}", lambda v: {"expected": n, "actual": F.size(v)})


class ListDecoder(_Sized):
    def contains(self, element):
        if element is None:
            raise ValueError("element must not be null")
        return self._test(lambda v: ~F.coalesce(F.array_contains(v, element), F.lit(False)), "missing_element", f"must contain {X.quoted(element)}", {"expected": element})

    def contains_all(self, *elements):
        if not elements:
            raise ValueError("contains_all needs an element")
        wanted = list(dict.fromkeys(elements))
        missing = lambda v: F.array_except(F.array(*(F.lit(e) for e in wanted)), v)
        message = lambda v: F.concat(F.lit(f"must contain all of {X.quoted(wanted)} (missing: ["), F.array_join(missing(v), ", "), F.lit("])"))
        return self._test(lambda v: F.size(missing(v)) > 0, "missing_elements", message, lambda v: {"expected": wanted, "missing": missing(v)})

    def unique(self):
        """No value twice, null included; the issue lists repeated values by their second place."""

        def repeated(v: Column) -> Column:
            earlier = lambda x, i: F.exists(F.slice(v, F.lit(1), i), lambda y: y.eqNullSafe(x))
            return F.array_distinct(F.filter(v, lambda x, i: F.when(i > 0, earlier(x, i)).otherwise(F.lit(False))))

        # the quadratic list of repeats is built for failing rows alone
        message = lambda v: F.concat(F.lit("must not contain duplicates: ["), F.array_join(repeated(v).cast("array<string>"), ", ", "null"), F.lit("]"))
        return self._test(lambda v: F.size(F.array_distinct(v)) < F.size(v), "duplicate_element", message, lambda v: {"duplicates": repeated(v)})

    def to_set(self):
        return self._convert(F.array_distinct, None, None, None, None, Chain)

    def to_map(self, key, value):
        """A map by a key of each element; a repeated key is a `duplicate_ids` issue and never an error."""
        keys = lambda v: F.transform(v, key)
        tested = self._test(lambda v: F.size(F.array_distinct(keys(v))) < F.size(v), "duplicate_ids", "contains duplicate ids")
        return tested._convert(lambda v: F.when(F.size(F.array_distinct(keys(v))) == F.size(v), F.map_from_arrays(keys(v), F.transform(v, value))), None, None, None, None, Chain)


class MapDecoder(_Sized):
    noun = "entries"

    def extra_fields(self, *known: str):
        """The entries whose keys are not among known."""
        return self._convert(lambda v: F.map_filter(v, lambda k, _: ~k.isin(*known)), None, None, None, None, MapDecoder)


def list_(element: Decoder) -> ListDecoder:
    """An array whose elements are decoded under their index, gathering all issues."""
    return ListDecoder(_List(element))


def map_(value: Decoder) -> MapDecoder:
    """An object with any keys, whose values are decoded under their key."""
    return MapDecoder(_Map(value))
