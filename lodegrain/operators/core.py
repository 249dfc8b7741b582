"""Decoder nodes: the algebra from source values to typed values or issues.

A decoder is an immutable description; ``compile`` turns it into column expressions. Scalar decoders
are chains that stop at their first issue; fields, lists and maps gather all issues in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plans.compile import Context, Out, Path, Source, child, empty, failed, gathered, issue, none, source_of

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
NUMBERS = (*INTEGERS, *FLOATS, T.DecimalType)
STRINGS = (T.StringType, T.VarcharType, T.CharType)


class Decoder:
    """Base of all decoders."""

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        raise NotImplementedError

    def map(self, f: Callable[[Column], Column]) -> "Decoder":
        """Transform the value, on success only."""
        return Mapped(self, f)

    def flat_map(self, f: Callable[[Column], "Verdict"]) -> "Decoder":
        """Rules over the value, on success only; their paths are relative to this decoder's."""
        return FlatMapped(self, f)

    def flat_map_with_path(self, f: Callable[[Column, Path], "Verdict"]) -> "Decoder":
        """Like flat_map, but f gets the path and gives absolute paths."""
        return FlatMapped(self, f, absolute=True)

    def pipe(self, following: "Decoder") -> "Decoder":
        """Decode the decoded value again."""
        return Piped(self, following)

    def list(self) -> "Decoder":
        """Decode an array of such inputs, gathering issues under their index."""
        from .collections import list_

        return list_(self)


@dataclass(frozen=True)
class Rule:
    """An issue raised where failing is true; at: path segments below the decoder."""

    failing: Column
    code: str
    message: Any
    meta: Any = None
    at: tuple = ()
    custom: bool = False


@dataclass(frozen=True)
class Verdict:
    """What a function given to flat_map returns: a value, or the issues of all rules that fail."""

    value: Column
    rules: tuple = ()


def ok(value: Column) -> Verdict:
    return Verdict(value)


def fail(code: str, message, meta=None, at: tuple = (), custom: bool = False) -> Verdict:
    return Verdict(F.lit(None), (Rule(F.lit(True), code, message, meta, at, custom),))


def check(value: Column, *rules: Rule) -> Verdict:
    return Verdict(value, rules)


# ---------------------------------------------------------------- chains


@dataclass(frozen=True)
class Step:
    """test: failing(value) raises the issue; map: value becomes f(value), where null raises it, if it has a code."""

    kind: str
    f: Callable[[Column], Column]
    code: str | None = None
    message: Any = None
    meta: Any = None
    custom: bool = False
    dtype: T.DataType | None = None


class Chain(Decoder):
    """A base decoder and steps that stop at the first issue."""

    def __init__(self, base: Decoder, steps: tuple = ()):
        self.base, self.steps = base, steps

    @property
    def dtype(self) -> T.DataType | None:
        """The type of the value, where a conversion or the base tells it."""
        for s in reversed(self.steps):
            if s.kind == "map":
                return s.dtype
        return getattr(self.base, "dtype", None)

    def _then(self, step: Step, into: type | None = None):
        return (into or type(self))(self.base, (*self.steps, step))

    def _test(self, failing, code, message, meta=None, given: str | None = None):
        return self._then(Step("test", failing, code, message if given is None else given, meta, given is not None))

    def _convert(self, f, code, message, meta, given, into, dtype=None):
        return self._then(Step("map", f, code, message if given is None else given, meta, given is not None, dtype), into)

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        out = self.base.compile(ctx, src, path)
        value, level = out.value, out.level
        first, rest = (out.terms[0], out.terms[1:]) if out.terms else (None, [])
        if rest or first and first[0] == "many":
            # behind lists and maps the steps run once all elements are sound
            listed, level = ctx.bind(gathered(out.terms), level)
            start = F.size(listed) > 0
            terms, whens = [("many", listed)], None
            guard = lambda c: ~start & c
        else:
            terms, whens, guard = [], first[1] if first else None, lambda c: c
        cases: list[tuple[Column, Column]] = []
        if whens is not None:
            cases.append((whens.isNotNull(), whens))
        for s in self.steps:
            if s.kind == "map":
                before = value
                value, level = ctx.bind(s.f(value), level)
                if s.code:
                    cases.append((guard(before.isNotNull() & value.isNull()), _issue(path, s, before)))
            else:
                cases.append((guard(F.coalesce(s.f(value), F.lit(False))), _issue(path, s, value)))
        if not cases:
            return Out(value, terms, level)
        found = None
        for c, i in cases:
            found = F.when(c, i) if found is None else found.when(c, i)
        found, level = ctx.bind(found.otherwise(none()), level)
        terms.append(("one", found))
        return Out(F.when(~failed(terms), value), terms, level)


def _issue(path: Path, s: Step, v: Column) -> Column:
    message = s.message(v) if callable(s.message) else s.message
    meta = s.meta(v) if callable(s.meta) else s.meta
    return issue(path, s.code, message, meta, s.custom)


# ---------------------------------------------------------------- scalar bases


class Scalar(Decoder):
    """A value of one type, from a typed column or a JSON value."""

    def __init__(self, name: str, accepts: tuple, value: Callable[[Column, T.DataType], Column], variant: Callable[[Column, Column], tuple] | None = None):
        """variant: (value, its type's name) to (whether it has the type, the typed value)."""
        self.name, self.accepts, self.value, self.variant = name, accepts, value, variant
        plain = {"string": T.StringType(), "integer": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType()}
        self.dtype = plain.get(name)

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        required = issue(path, "required", "is required")
        mismatch = lambda actual: issue(path, "type_mismatch", f"expected {self.name}", {"expected": self.name, "actual": actual})
        nothing = F.lit(None)
        if src.kind == "absent":
            return Out(nothing, [("one", required)], src.level)
        if src.kind == "row":
            return Out(nothing, [("one", mismatch("object"))], src.level)
        if src.kind == "variant":
            if self.variant is None:
                return Out(nothing, [("one", F.when(src.is_null, required).otherwise(mismatch("json")))], src.level)
            kind = F.schema_of_variant(src.column)
            fits, value = self.variant(src.column, kind)
            found, level = ctx.bind(F.when(src.is_null, required).when(~fits | value.isNull(), mismatch(kind)).otherwise(none()), src.level)
            return Out(F.when(found.isNull(), value), [("one", found)], level)
        if not isinstance(src.dtype, self.accepts):
            return Out(nothing, [("one", F.when(src.column.isNull(), required).otherwise(mismatch(src.dtype.simpleString())))], src.level)
        value, level = ctx.shared(self, src)
        found = F.when(src.column.isNull(), required).when(value.isNull(), mismatch(src.dtype.simpleString())).otherwise(none())
        return Out(value, [("one", found)], level)


def _variant(kinds: tuple[str, ...], into: str):
    return lambda v, kind: (F.coalesce(kind.rlike(rf"^({'|'.join(kinds)})(\(.*)?$"), F.lit(False)), F.try_variant_get(v, "$", into))


def narrowed(v: Column, t: T.DataType, bits: int) -> Column:
    """To 32 or 64 bits as the JVM narrows: floats are cut and saturate, whole numbers wrap."""
    into = "int" if bits == 32 else "bigint"
    low, high = -(1 << bits - 1), (1 << bits - 1) - 1
    if isinstance(t, FLOATS):
        return F.when(F.isnan(v), 0).when(v >= float(high), high).when(v <= float(low), low).otherwise(v.try_cast(into)).cast(into)
    if isinstance(t, T.DecimalType):
        whole = v.cast("decimal(38,0)") if t.scale == 0 else F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("decimal(38,0)")
        size = F.lit(str(1 << bits)).cast("decimal(38,0)")
        wrapped = F.pmod(whole, size)
        return F.when(wrapped > high, wrapped - size).otherwise(wrapped).try_cast(into)
    if bits == 32 and isinstance(t, T.LongType):
        return F.shiftright(F.shiftleft(v, 32), 32).cast("int")
    return v.cast(into)


def exact(v: Column, t: T.DataType, into: str) -> Column:
    """The value as a whole number, null where it is not one of that size."""
    cast = v.try_cast(into)
    return cast if isinstance(t, INTEGERS) else F.when(cast.cast("double") == v.cast("double"), cast) if isinstance(t, FLOATS) else F.when(cast.cast(t) == v, cast)


# ---------------------------------------------------------------- composition


class Mapped(Decoder):
    def __init__(self, inner: Decoder, f: Callable[[Column], Column]):
        self.inner, self.f = inner, f

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        out = self.inner.compile(ctx, src, path)
        value, level = ctx.bind(out.value, out.level)
        value, level = ctx.bind(F.when(~failed(out.terms), self.f(value)), level)
        return Out(value, out.terms, level)


class FlatMapped(Decoder):
    def __init__(self, inner: Decoder, f: Callable, absolute: bool = False):
        self.inner, self.f, self.absolute = inner, f, absolute

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        out = self.inner.compile(ctx, src, path)
        value, level = ctx.bind(out.value, out.level)
        before, level = ctx.bind(failed(out.terms), level)
        verdict = self.f(value, path) if self.absolute else self.f(value)
        terms, level = _ruled(ctx, verdict, () if self.absolute else path, before, level)
        all_terms = [*out.terms, *terms]
        result, level = ctx.bind(F.when(~failed(all_terms), verdict.value), level)
        return Out(result, all_terms, level)


def _ruled(ctx: Context, verdict: Verdict, path: Path, before: Column, level: int) -> tuple[list, int]:
    terms, top = [], level
    for r in verdict.rules:
        made = issue((*path, *r.at), r.code, r.message, r.meta, r.custom)
        c, deep = ctx.bind(F.when(~before & F.coalesce(r.failing, F.lit(False)), made).otherwise(none()), level)
        terms.append(("one", c))
        top = max(top, deep)
    return terms, top


class Piped(Decoder):
    def __init__(self, first: Decoder, second: Decoder):
        self.first, self.second = first, second

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        out = self.first.compile(ctx, src, path)
        value, level = ctx.bind(out.value, out.level)
        before, level = ctx.bind(failed(out.terms), level)
        dtype = getattr(self.first, "dtype", None)
        if dtype is None:
            if ctx.nested:
                raise ValueError("inside arrays and maps, pipe follows a scalar decoder")
            dtype = ctx.apply(ctx.frame).select(value.alias("v")).schema["v"].dataType
        then = self.second.compile(ctx, source_of(value, dtype, src.boundary, level), path)
        later, level = ctx.bind(gathered(then.terms), then.level)
        held, level = ctx.bind(F.when(before, empty()).otherwise(later), level)
        return Out(F.when(~before, then.value), [*out.terms, ("many", held)], level)


class Field(Decoder):
    """A named part of the input. An absent one is null to its decoder; in records it is an issue."""

    def __init__(self, name: str, inner: Decoder):
        self.name, self.inner = name, inner

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        own = (*path, self.name)
        part, there = child(src, self.name)
        if src.boundary == "record" and there is False:
            return Out(F.lit(None), [("one", issue(own, "missing_field", "field is missing"))], src.level)
        if src.kind == "variant":
            # a parent that is no object is one issue at each field's path
            object_like = F.coalesce(F.schema_of_variant(src.column).startswith("OBJECT"), F.lit(False)) | src.is_null
            out = self.inner.compile(ctx, part, own)
            actual = F.coalesce(F.schema_of_variant(src.column), F.lit("VOID"))
            wrong = issue(own, "type_mismatch", "expected object", {"expected": "object", "actual": actual})
            inner = gathered(out.terms) if len(out.terms) != 1 or out.terms[0][0] == "many" else None
            if inner is None:
                term, level = ctx.bind(F.when(~object_like, wrong).otherwise(out.terms[0][1]), out.level)
                return Out(F.when(object_like, out.value), [("one", term)], level)
            term, level = ctx.bind(F.when(~object_like, F.array(wrong)).otherwise(inner), out.level)
            return Out(F.when(object_like, out.value), [("many", term)], level)
        if src.kind == "typed" and not isinstance(src.dtype, (T.StructType, T.MapType)):
            wrong = issue(own, "type_mismatch", "expected object", {"expected": "object", "actual": src.dtype.simpleString()})
            return Out(F.lit(None), [("one", wrong)], src.level)
        return self.inner.compile(ctx, part, own)


class OptionalField(Decoder):
    """Null where the field is absent, or where a JSON parent is no object; a null that is there goes to the decoder."""

    def __init__(self, name: str, inner: Decoder):
        self.name, self.inner = name, inner

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        part, there = child(src, self.name)
        out = self.inner.compile(ctx, part, (*path, self.name))
        if there is True:
            return out
        if there is False:
            return Out(F.when(F.lit(False), out.value), [], src.level)
        return _gated(ctx, out, there)


def _gated(ctx: Context, out: Out, there: Column) -> Out:
    terms = [(k, F.when(there, c).otherwise(none() if k == "one" else empty())) for k, c in out.terms]
    return Out(F.when(there, out.value), terms, out.level)


class OptionalNullableField(Decoder):
    """struct(state, value): absent, present_null or present."""

    def __init__(self, name: str, inner: Decoder):
        self.name, self.inner = name, inner

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        part, there = child(src, self.name)
        out = self.inner.compile(ctx, part, (*path, self.name))
        there = F.lit(there) if isinstance(there, bool) else there
        gated = _gated(ctx, out, there & ~part.is_null)
        state = F.when(~there, F.lit("absent")).when(part.is_null, F.lit("present_null")).otherwise(F.lit("present"))
        value = F.struct(state.alias("state"), gated.value.alias("value"))
        return Out(F.when(~failed(gated.terms), value), gated.terms, gated.level)


class Nullable(Decoder):
    def __init__(self, inner: Decoder):
        self.inner = inner

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        if src.kind == "absent":
            # a missing JSON value is not a null one
            out = self.inner.compile(ctx, src, path)
            return Out(out.value, [] if src.boundary != "json" else out.terms, out.level)
        out = self.inner.compile(ctx, src, path)
        null = F.is_variant_null(src.column) & src.column.isNotNull() if src.kind == "variant" else src.is_null
        return _gated(ctx, out, ~F.coalesce(null, F.lit(False)))


class Nested(Decoder):
    """An object inside the input; in records the same flat record."""

    def __init__(self, inner: Decoder):
        self.inner = inner

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        if src.boundary == "record" or src.kind == "row":
            return self.inner.compile(ctx, src, path)
        required = issue(path, "required", "is required")
        if src.kind == "absent":
            out = self.inner.compile(ctx, src, path)
            return Out(F.when(F.lit(False), out.value), [("one", required)], src.level)
        if src.kind == "typed" and not isinstance(src.dtype, (T.StructType, T.MapType)):
            wrong = issue(path, "type_mismatch", "expected object", {"expected": "object", "actual": src.dtype.simpleString()})
            return Out(F.lit(None), [("one", F.when(src.is_null, required).otherwise(wrong))], src.level)
        out = self.inner.compile(ctx, src, path)
        problem = F.when(src.is_null, required)
        if src.kind == "variant":
            kind = F.schema_of_variant(src.column)
            problem = problem.when(~kind.startswith("OBJECT"), issue(path, "type_mismatch", "expected object", {"expected": "object", "actual": kind}))
        problem, level = ctx.bind(problem.otherwise(none()), src.level)
        gated = _gated(ctx, out, problem.isNull())
        return Out(gated.value, [("one", problem), *gated.terms], max(level, gated.level))


# ---------------------------------------------------------------- combine


class Combiner(Decoder):
    """Several decoders over one input; all run, and their issues follow in order.

    Without a function the value is a struct named by the fields, or _1, _2 and so on.
    """

    def __init__(self, parts: tuple, names: tuple | None = None, f: Callable | None = None, flat: Callable | None = None, known: tuple | None = None):
        self.parts, self.names, self.f, self.flat, self.known = parts, names, f, flat, known

    def named(self, *names: str) -> "Combiner":
        return Combiner(self.parts, names, self.f, self.flat, self.known)

    def tuple(self) -> "Combiner":
        return self.named(*(f"_{k}" for k in range(1, len(self.parts) + 1)))

    def map(self, f: Callable[..., Column]) -> "Combiner":
        """f gets the values of all parts."""
        return Combiner(self.parts, self.names, f, None, self.known)

    def flat_map(self, f: Callable[..., Verdict]) -> "Combiner":
        """f gets the values of all parts, once all are sound; its paths are relative."""
        return Combiner(self.parts, self.names, None, f, self.known)

    def known_fields(self) -> tuple[str, ...]:
        return tuple(p.name for p in self.parts if isinstance(p, Field))

    def strict(self, f: Callable[..., Column] | None = None) -> Decoder:
        """Report keys of the input that no field decoder among the parts names.

        Only plain fields count: an optional, defaulted or mapped field's key is reported. JSON values
        are not looked into here; give strict() their keys.
        """
        return Strict(self.map(f) if f else self, self.known_fields(), json=False)

    def strict_flat_map(self, f: Callable[..., Verdict]) -> Decoder:
        return Strict(self.flat_map(f), self.known_fields(), json=False)

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        outs = [p.compile(ctx, src, path) for p in self.parts]
        terms = [t for o in outs for t in o.terms]
        level = max([src.level, *(o.level for o in outs)])
        if self.f is None and self.flat is None:
            names = self.names or tuple(_name_of(p) or f"_{k}" for k, p in enumerate(self.parts, 1))
            value = F.struct(*(o.value.alias(n) for n, o in zip(names, outs)))
            return Out(F.when(~failed(terms), value), terms, level)
        values = []
        for o in outs:
            v, deep = ctx.bind(o.value, level)
            values.append(v)
        top = level if ctx.nested else level + 1
        if self.f is not None:
            return Out(F.when(~failed(terms), self.f(*values)), terms, top)
        before, top = ctx.bind(failed(terms), top)
        verdict = self.flat(*values)
        more, top = _ruled(ctx, verdict, path, before, top)
        every = [*terms, *more]
        value, top = ctx.bind(F.when(~failed(every), verdict.value), top)
        return Out(value, every, top)


def _name_of(part: Decoder) -> str | None:
    """The name of the field that a part reads, also behind defaults and the like."""
    while not hasattr(part, "name") and hasattr(part, "inner"):
        part = part.inner
    return getattr(part, "name", None) if isinstance(part, (Field, OptionalField, OptionalNullableField)) else None


def combine(*parts) -> Combiner:
    """Combine any number of decoders, given one by one or as a list."""
    if len(parts) == 1 and isinstance(parts[0], (list, tuple)):
        parts = tuple(parts[0])
    if not parts:
        raise ValueError("combine needs a decoder")
    return Combiner(tuple(parts))


class Strict(Decoder):
    def __init__(self, inner: Decoder, known: tuple[str, ...], json: bool = True):
        self.inner, self.known, self.json = inner, tuple(known), json

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        out = self.inner.compile(ctx, src, path)
        unknown = lambda name: issue((*path, name), "unknown_field", "unknown field", F.to_json(F.struct(name.alias("field"))) if isinstance(name, Column) else {"field": name})
        extra: list = []
        if src.boundary != "record" and src.kind in ("row", "typed") and (src.kind == "row" or isinstance(src.dtype, T.StructType)):
            names = src.fields if src.kind == "row" else src.dtype.names
            extra = [("one", unknown(n)) for n in names if n not in self.known]
        else:
            keys = None
            if src.kind == "typed" and isinstance(src.dtype, T.MapType):
                keys = F.map_keys(src.column)
            elif src.kind == "variant" and self.json:
                keys = F.map_keys(F.try_variant_get(src.column, "$", "map<string,variant>"))
            if keys is not None:
                left = F.array_except(keys, F.array(*(F.lit(k) for k in self.known)) if self.known else F.array().cast("array<string>"))
                extra = [("many", F.coalesce(F.transform(F.array_sort(left), lambda k: unknown(k)), empty()))]
        level = out.level
        bound = []
        for k, c in extra:
            c, deep = ctx.bind(c, src.level)
            level = max(level, deep)
            bound.append((k, c))
        terms = [*out.terms, *bound]
        return Out(F.when(~failed(terms), out.value), terms, level)


class WithDefault(Decoder):
    """The default where every issue says `required`, whatever its path."""

    def __init__(self, inner: Decoder, default):
        self.inner, self.default = inner, default

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        out = self.inner.compile(ctx, src, path)
        found, level = ctx.bind(gathered(out.terms), out.level)
        missing, level = ctx.bind((F.size(found) > 0) & F.forall(found, lambda i: i["code"] == "required"), level)
        return Out(F.when(missing, _constant(self.default)).otherwise(out.value), [("many", F.when(missing, empty()).otherwise(found))], level)


class Recover(Decoder):
    """A value for any failure; a function gets the issues."""

    def __init__(self, inner: Decoder, fallback):
        self.inner, self.fallback = inner, fallback

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        out = self.inner.compile(ctx, src, path)
        found, level = ctx.bind(gathered(out.terms), out.level)
        other = self.fallback(found) if callable(self.fallback) else _constant(self.fallback)
        return Out(F.when(F.size(found) > 0, other).otherwise(out.value), [], level)


def _constant(v) -> Column:
    v = v() if callable(v) else v
    return v if isinstance(v, Column) else F.lit(v)


class OneOf(Decoder):
    """The first candidate that succeeds; else one issue that holds the candidates' issues."""

    def __init__(self, candidates: tuple):
        self.candidates = candidates

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        from .issues import listed

        outs = [c.compile(ctx, src, path) for c in self.candidates]
        value = found = None
        level = src.level
        bound = []
        for o in outs:
            i, deep = ctx.bind(gathered(o.terms), o.level)
            level = max(level, deep, o.level)
            bound.append(i)
        for o, i in zip(outs, bound):
            value = F.when(F.size(i) == 0, o.value) if value is None else value.when(F.size(i) == 0, o.value)
            found = F.size(i) > 0 if found is None else found & (F.size(i) > 0)
        parts = [F.concat(F.lit(f'{{"candidate":{k},"issues":'), listed(i), F.lit("}")) for k, i in enumerate(bound)]
        meta = F.concat(F.lit('{"candidates":['), F.concat_ws(",", *parts), F.lit("]}"))
        term, level = ctx.bind(F.when(found, issue(path, "one_of_failed", "no variant matched", meta)).otherwise(none()), level)
        return Out(value, [("one", term)], level)


class Discriminate(Decoder):
    """The decoder that a tag field names. Values of all variants need one type; others go through map."""

    def __init__(self, name: str, tag: Decoder, variants: dict):
        self.name, self.tag, self.variants = name, tag, variants

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        own = Field(self.name, self.tag).compile(ctx, src, path)
        tag, level = ctx.bind(own.value, own.level)
        allowed = sorted(self.variants)
        missing = failed(own.terms)
        unknown = ~missing & ~F.coalesce(tag.isin(*allowed), F.lit(False))
        made = issue((*path, self.name), "not_allowed", f"must be one of {X.quoted(allowed)}", {"allowed": allowed})
        term, top = ctx.bind(F.when(unknown, made).otherwise(none()), level)
        terms, value = [*own.terms, ("one", term)], None
        for k, d in self.variants.items():
            out = _gated(ctx, d.compile(ctx, replace(src, level=max(src.level, 0)), path), F.coalesce(tag == k, F.lit(False)))
            terms += out.terms
            v, deep = ctx.bind(out.value, max(out.level, level))
            top = max(top, deep)
            value = F.when(tag == k, v) if value is None else value.when(tag == k, v)
        # issue terms of the variants refer to the tag, so they belong to the stage after it
        bound = []
        for kind, c in terms:
            b, deep = ctx.bind(c, top)
            bound.append((kind, b))
        return Out(value, bound, top if ctx.nested else top + 1)


class Lazy(Decoder):
    """Recursion, unrolled as far as depth; a value below that is an issue, so that nothing passes unchecked."""

    def __init__(self, supplier: Callable[[], Decoder], depth: int = 4):
        self.supplier, self.depth = supplier, depth

    def compile(self, ctx: Context, src: Source, path: Path) -> Out:
        if ctx.depth >= self.depth:
            required = issue(path, "required", "is required")
            if src.kind == "absent":
                return Out(F.lit(None).cast("string"), [("one", required)], src.level)
            deep = issue(path, "nested_too_deeply", f"is nested more than {self.depth} levels deep", {"max": self.depth})
            return Out(F.lit(None).cast("string"), [("one", F.when(src.is_null, required).otherwise(deep))], src.level)
        ctx.depth += 1
        try:
            return self.supplier().compile(ctx, src, path)
        finally:
            ctx.depth -= 1


class Literal(Chain):
    pass


def field_(name: str, inner: Decoder) -> Field:
    return Field(name, inner)


def with_default(inner: Decoder, default) -> Decoder:
    return WithDefault(inner, default)


def recover(inner: Decoder, fallback) -> Decoder:
    return Recover(inner, fallback)


def one_of(*candidates: Decoder) -> Decoder:
    return OneOf(candidates)


def nullable(inner: Decoder) -> Decoder:
    return Nullable(inner)


def nested(inner: Decoder) -> Decoder:
    return Nested(inner)


def optional_field(name: str, inner: Decoder) -> Decoder:
    return OptionalField(name, inner)


def optional_nullable_field(name: str, inner: Decoder) -> Decoder:
    return OptionalNullableField(name, inner)


def strict(inner: Decoder, known) -> Decoder:
    return Strict(inner, tuple(known))


def discriminate(name: str, variants: dict, tag: Decoder | None = None) -> Decoder:
    from .scalars import string

    return Discriminate(name, tag or string(), variants)


def lazy(supplier: Callable[[], Decoder], depth: int = 4) -> Decoder:
    return Lazy(supplier, depth)


def literal(expected: str, inner: Decoder | None = None) -> Decoder:
    from .scalars import string

    inner = inner or string()
    return Literal(inner, (Step("test", lambda v: v != expected, "invalid_format", "invalid value", {"expected": expected}),))


def enum_of(names, inner: Decoder | None = None) -> Decoder:
    """The constant's own spelling, whatever the case of the input."""
    from .scalars import string

    names = list(names)
    allowed = [n.lower() for n in names]
    table = lambda: F.create_map(*(F.lit(x) for n in names for x in (n.lower(), n)))
    return Literal(inner or string(), (Step("map", lambda v: F.try_element_at(table(), F.lower(v)), "invalid_format", "invalid value", {"allowed": allowed}, dtype=T.StringType()),))


