"""Scalar decoders and their rules."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .core import INTEGERS, NUMBERS, STRINGS, Chain, Decoder, Scalar, _variant, exact, narrowed

PLACES = 18
DECIMAL = f"decimal(38,{PLACES})"


def _formatted(n) -> str:
    return X.quoted(n)


class StringDecoder(Chain):
    """Rules and conversions of strings; each has an optional message of the caller's own."""

    def non_blank(self, message: str | None = None):
        return self._test(X.is_blank, "blank", "must not be blank", None, message)

    def allow_blank(self):
        """Drop nothing: blank strings are allowed from the start. Only directly after string()."""
        if self.steps:
            raise ValueError("allow_blank() stands directly after string()")
        return self

    def min_length(self, n: int, message: str | None = None):
        return self._test(lambda v: X.utf16_length(v) < n, "too_short", f"must be at least {n} characters", lambda v: {"min": n, "actual": X.utf16_length(v)}, message)

    def max_length(self, n: int, message: str | None = None):
        return self._test(lambda v: X.utf16_length(v) > n, "too_long", f"must be at most {n} characters", lambda v: {"max": n, "actual": X.utf16_length(v)}, message)

    def fixed_length(self, n: int, message: str | None = None):
        return self._test(lambda v: X.utf16_length(v) != n, "invalid_length", f"must be exactly {n} characters", lambda v: {"expected": n, "actual": X.utf16_length(v)}, message)

    def one_of(self, *allowed: str):
        names = sorted(allowed)
        return self._test(lambda v: ~v.isin(*names), "not_allowed", f"must be one of {X.quoted(names)}", lambda v: {"allowed": names, "actual": v})

    def pattern(self, regex: str, code: str = "invalid_format", message: str | None = None):
        """The whole value must match the regular expression."""
        return self._test(lambda v: ~X.full_match(v, regex), code, "invalid format", {"pattern": regex}, message)

    def starts_with(self, prefix: str, message: str | None = None):
        return self._test(lambda v: ~F.startswith(v, F.lit(prefix)), "invalid_format", f'must start with "{prefix}"', {"prefix": prefix}, message)

    def ends_with(self, suffix: str, message: str | None = None):
        return self._test(lambda v: ~F.endswith(v, F.lit(suffix)), "invalid_format", f'must end with "{suffix}"', {"suffix": suffix}, message)

    def includes(self, part: str, message: str | None = None):
        return self._test(lambda v: ~F.contains(v, F.lit(part)), "invalid_format", f'must include "{part}"', {"substring": part}, message)

    def _format(self, valid: Callable[[Column], Column], name: str, message: str | None):
        return self._test(lambda v: ~F.coalesce(valid(v), F.lit(False)), "invalid_format", f"not a valid {name}", None, message)

    def email(self, message: str | None = None):
        return self._format(X.is_email, "email", message)

    def url(self, message: str | None = None):
        """http or https in lower case, with a host."""
        return self._format(X.is_url, "URL", message)

    def ipv4(self, message: str | None = None):
        return self._format(X.is_ipv4, "IPv4 address", message)

    def ipv6(self, message: str | None = None):
        return self._format(X.is_ipv6, "IPv6 address", message)

    def ip(self, message: str | None = None):
        return self._format(lambda v: X.is_ipv4(v) | X.is_ipv6(v), "IP address", message)

    def cuid(self, message: str | None = None):
        return self._format(lambda v: X.full_match(v, X.CUID), "CUID", message)

    def ulid(self, message: str | None = None):
        return self._format(lambda v: X.full_match(v, X.ULID), "ULID", message)

    def trim(self):
        return self._convert(X.strip, None, None, None, None, StringDecoder, T.StringType())

    def to_lower_case(self):
        return self._convert(F.lower, None, None, None, None, StringDecoder, T.StringType())

    def to_upper_case(self):
        return self._convert(F.upper, None, None, None, None, StringDecoder, T.StringType())

    def uuid(self, message: str | None = None):
        return self._convert(X.parse_uuid, "invalid_format", "not a valid UUID", None, message, Chain)

    def uri(self, message: str | None = None):
        return self._convert(X.parse_uri, "invalid_format", "not a valid URI", None, message, Chain)

    def iso8601(self, message: str | None = None):
        return self._convert(X.parse_instant, "invalid_format", "not a valid ISO 8601 instant", None, message, TemporalDecoder)

    def date(self, message: str | None = None):
        return self._convert(X.parse_date, "invalid_format", "not a valid date (yyyy-MM-dd)", None, message, TemporalDecoder)

    def time(self, message: str | None = None):
        return self._convert(X.parse_time, "invalid_format", "not a valid time (HH:mm:ss)", None, message, TemporalDecoder)

    def date_time(self, message: str | None = None):
        return self._convert(X.parse_date_time, "invalid_format", "not a valid ISO-8601 local date-time (e.g., 2024-01-15T10:30 or 2024-01-15T10:30:45)", None, message, TemporalDecoder)

    def offset_date_time(self, message: str | None = None):
        return self._convert(X.parse_offset_date_time, "invalid_format", "not a valid ISO-8601 offset date-time (e.g., 2024-01-15T10:30:00+09:00)", None, message, OffsetDecoder)

    def _coerce(self, f, name: str, message: str | None, into: type):
        dtype = {"integer": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}.get(name)
        return self._convert(f, "type_mismatch", f"expected {name}", {"expected": name}, message, into, dtype)

    def to_int(self, message: str | None = None):
        return self._coerce(lambda v: F.when(X.full_match(v, r"[+-]?\d+"), v.try_cast("int")), "integer", message, IntDecoder)

    def to_long(self, message: str | None = None):
        return self._coerce(lambda v: F.when(X.full_match(v, r"[+-]?\d+"), v.try_cast("bigint")), "long", message, IntDecoder)

    def to_decimal(self, message: str | None = None):
        """A number with its scale as written; the value is a decimal of 18 places, and a number that has more of them, or more than 20 digits before the point, is a mismatch."""
        return self._coerce(lambda v: F.when(X.full_match(v, r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"), _scaled(v)), "decimal", message, DecimalDecoder)

    def to_bool(self, message: str | None = None):
        return self._coerce(lambda v: F.when(F.lower(v).isin("true", "1", "yes", "on"), True).when(F.lower(v).isin("false", "0", "no", "off"), False), "boolean", message, BoolDecoder)


def _scaled(text: Column) -> Column:
    """struct(number, scale): Spark's scale belongs to the column, this one to the value. Null where the number would be rounded."""
    number, scale = text.try_cast(DECIMAL), X.decimal_scale(text)
    digits = F.translate(F.regexp_replace(text, r"[eE].*\z", ""), ".+-", "")
    needed = scale - F.length(F.regexp_extract(digits, r"(0*)\z", 1))
    exact = (scale <= PLACES) | (F.length(F.translate(digits, "0", "")) == 0) | (needed <= PLACES)
    return F.when(number.isNotNull() & exact, F.struct(number.alias("number"), X.decimal_scale(text).alias("scale")))


def _scaled_number(v: Column, t: T.DataType) -> Column:
    """_scaled of a typed number. Whole numbers and doubles printed without an exponent take no regular expressions."""
    text = v.cast("string")
    if isinstance(t, INTEGERS):
        return F.when(v.isNotNull(), F.struct(v.cast(DECIMAL).alias("number"), F.lit(0).alias("scale")))
    if not isinstance(t, T.DoubleType):
        return _scaled(text)
    places = F.length(text) - F.instr(text, ".")
    plain = ((F.abs(v) >= 1e-3) & (F.abs(v) < 1e7) | (v == 0)) & (places <= PLACES)
    return F.when(plain, F.struct(v.try_cast(DECIMAL).alias("number"), places.alias("scale"))).otherwise(_scaled(text))


class NumberDecoder(Chain):
    """Rules of numbers."""

    one, minus_one, zero = 1, -1, 0

    def _range(self, failing, message: str, limits: dict, given: str | None = None):
        return self._test(failing, "out_of_range", message, lambda v: {**limits, "actual": self._plain(v)}, given)

    def _plain(self, v: Column) -> Column:
        return v

    def min(self, n, message: str | None = None):
        return self._range(lambda v: self._plain(v) < F.lit(n), f"must be at least {_formatted(n)}", {"min": n}, message)

    def max(self, n, message: str | None = None):
        return self._range(lambda v: self._plain(v) > F.lit(n), f"must be at most {_formatted(n)}", {"max": n}, message)

    def range(self, low, high, message: str | None = None):
        return self._range(lambda v: ~self._plain(v).between(F.lit(low), F.lit(high)), f"must be between {_formatted(low)} and {_formatted(high)}", {"min": low, "max": high}, message)

    def positive(self):
        return self._range(lambda v: self._plain(v) <= 0, "must be positive", {"min": self.one})

    def negative(self):
        return self._range(lambda v: self._plain(v) >= 0, "must be negative", {"max": self.minus_one})

    def non_negative(self):
        return self._range(lambda v: self._plain(v) < 0, "must be non-negative", {"min": self.zero})

    def non_positive(self):
        return self._range(lambda v: self._plain(v) > 0, "must be non-positive", {"max": self.zero})


class IntDecoder(NumberDecoder):
    """Rules of whole numbers."""

    def multiple_of(self, n):
        if not n:
            raise ValueError("the divisor must not be 0")
        return self._test(lambda v: F.try_mod(self._plain(v), F.lit(n)) != 0, "not_multiple_of", f"must be a multiple of {n}", lambda v: {"divisor": n, "actual": self._plain(v)})

    def one_of(self, *allowed):
        values = sorted(allowed)
        return self._test(lambda v: ~self._plain(v).isin(*values), "not_allowed", f"must be one of {X.quoted(values)}", lambda v: {"allowed": values, "actual": self._plain(v)})


class FloatDecoder(NumberDecoder):
    """Rules of floating-point numbers; NaN is the greatest, and -0.0 is below 0.0."""

    one = minus_one = zero = 0.0

    def one_of(self, *allowed):
        values = sorted(allowed)
        return self._test(lambda v: ~v.isin(*values), "not_allowed", f"must be one of {X.quoted(values)}", lambda v: {"allowed": values, "actual": v})

    def non_negative(self):
        return self._range(lambda v: (v < 0) | _minus_zero(v), "must be non-negative", {"min": 0.0})

    def min(self, n, message: str | None = None):
        return self._range(lambda v: _below(v, n), f"must be at least {_formatted(n)}", {"min": n}, message)

    def max(self, n, message: str | None = None):
        return self._range(lambda v: _above(v, n), f"must be at most {_formatted(n)}", {"max": n}, message)

    def range(self, low, high, message: str | None = None):
        return self._range(lambda v: _below(v, low) | _above(v, high), f"must be between {_formatted(low)} and {_formatted(high)}", {"min": low, "max": high}, message)

    def negative(self):
        return self._range(lambda v: (v > 0) | (v == 0) & ~_minus_zero(v), "must be negative", {"max": 0.0})


class EqualZerosDecoder(FloatDecoder):
    """The same rules in the order of SQL, in which -0.0 and 0.0 are equal."""

    non_negative, min, max, range, negative = (getattr(NumberDecoder, n) for n in ("non_negative", "min", "max", "range", "negative"))


def _below(v: Column, n: float) -> Column:
    """v < n in the order in which -0.0 is below 0.0."""
    return (v < F.lit(n)) | _minus_zero(v) if n == 0 and not str(float(n)).startswith("-") else v < F.lit(n)


def _above(v: Column, n: float) -> Column:
    return (v > F.lit(n)) | (v == 0) & ~_minus_zero(v) if n == 0 and str(float(n)).startswith("-") else v > F.lit(n)


def _minus_zero(v: Column) -> Column:
    return (v == 0) & v.cast("string").startswith("-")


class DecimalDecoder(IntDecoder):
    """Rules of decimals: a struct of number and scale until the chain ends."""

    one = minus_one = zero = 0
    one_of = None

    def _plain(self, v: Column) -> Column:
        return v.getField("number")

    def scale(self, n: int, message: str | None = None):
        return self._test(lambda v: v.getField("scale") > n, "invalid_scale", f"too many decimal places (max {n})", lambda v: {"maxScale": n, "actualScale": v.getField("scale")}, message)

    def compile(self, ctx, src, path):
        from ..plans.compile import Out

        out = super().compile(ctx, src, path)
        return Out(out.value.getField("number"), out.terms, out.level)


class BoolDecoder(Chain):
    def _is(self, wanted: bool, message: str | None):
        return self._test(lambda v: v != wanted, "invalid_value", f"must be {str(wanted).lower()}", lambda v: {"expected": wanted, "actual": v}, message)

    def is_true(self, message: str | None = None):
        return self._is(True, message)

    def is_false(self, message: str | None = None):
        return self._is(False, message)


def _shown(b) -> str:
    if isinstance(b, datetime) and b.tzinfo:
        return b.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return b.isoformat() if isinstance(b, date) else str(b)


def _bound(b) -> Column:
    if isinstance(b, datetime):
        return F.lit(b if b.tzinfo else b.isoformat(sep=" ")).cast("timestamp" if b.tzinfo else "timestamp_ntz")
    return F.lit(b)


class TemporalDecoder(Chain):
    """Rules of dates and times: before and after exclude the bound, between includes both."""

    def _key(self, v: Column) -> Column:
        return v

    def before(self, bound, message: str | None = None):
        text = _shown(bound)
        return self._test(lambda v: self._key(v) >= _bound(bound), "out_of_range", f"must be before {text}", lambda v: {"before": text, "actual": self._key(v).cast("string")}, message)

    def after(self, bound, message: str | None = None):
        text = _shown(bound)
        return self._test(lambda v: self._key(v) <= _bound(bound), "out_of_range", f"must be after {text}", lambda v: {"after": text, "actual": self._key(v).cast("string")}, message)

    def between(self, low, high, message: str | None = None):
        if low > high:
            raise ValueError("the bounds are inverted")
        a, b = _shown(low), _shown(high)
        return self._test(lambda v: ~self._key(v).between(_bound(low), _bound(high)), "out_of_range", f"must be between {a} and {b}", lambda v: {"from": a, "to": b, "actual": self._key(v).cast("string")}, message)


class OffsetDecoder(TemporalDecoder):
    """Instants with an offset, compared by instant."""

    def _key(self, v: Column) -> Column:
        return v.getField("ts")


def string() -> StringDecoder:
    return StringDecoder(Scalar("string", STRINGS, lambda v, t: v.cast("string"), _variant(("STRING",), "string")))


def allow_blank_string() -> StringDecoder:
    return string()


def from_(inner: Decoder) -> StringDecoder:
    """String rules over any decoder of strings."""
    return StringDecoder(inner)


def int_(narrow: str = "strict") -> IntDecoder:
    """A 32-bit number. Columns of other numbers are narrowed: `strict` takes only numbers that stay the same, `java` cuts and wraps."""
    into = (lambda v, t: narrowed(v, t, 32)) if narrow == "java" else (lambda v, t: exact(v, t, "int"))
    wide = _variant(("BIGINT", "INT", "SMALLINT", "TINYINT"), "bigint")
    variant = (lambda v, k: (wide(v, k)[0], narrowed(wide(v, k)[1], T.LongType(), 32))) if narrow == "java" else _variant(("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
    return IntDecoder(Scalar("integer", NUMBERS, into, variant))


def long_(narrow: str = "strict") -> IntDecoder:
    into = (lambda v, t: narrowed(v, t, 64)) if narrow == "java" else (lambda v, t: exact(v, t, "bigint"))
    return IntDecoder(Scalar("long", NUMBERS, into, _variant(("BIGINT", "INT", "SMALLINT", "TINYINT"), "bigint")))


def double_(signed_zeros: bool = True) -> FloatDecoder:
    """A double. Without signed zeros, rules take -0.0 and 0.0 as equal, as SQL does; the value stays as it is."""
    return (FloatDecoder if signed_zeros else EqualZerosDecoder)(Scalar("double", NUMBERS, lambda v, t: v.cast("double")))


def float_() -> FloatDecoder:
    return FloatDecoder(Scalar("float", NUMBERS, lambda v, t: v.cast("float")))


def bool_() -> BoolDecoder:
    return BoolDecoder(Scalar("boolean", (T.BooleanType,), lambda v, t: v, _variant(("BOOLEAN",), "boolean")))


def decimal_() -> DecimalDecoder:
    """A decimal of 18 places; the scale rule goes by the number as printed, so 1500.0 has scale 1."""

    def variant(v: Column, kind: Column):
        fits, _ = _variant(("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"), "string")(v, kind)
        return fits, _scaled(F.try_variant_get(v, "$", "string"))

    return DecimalDecoder(Scalar("number", NUMBERS, _scaled_number, variant))


def date_() -> TemporalDecoder:
    return TemporalDecoder(Scalar("date", (T.DateType,), lambda v, t: v))


def time_() -> TemporalDecoder:
    """Nanoseconds of the day, from a bigint column or, where it is on, a TIME column."""
    kinds = (T.LongType, *([T.TimeType] if hasattr(T, "TimeType") else []))
    return TemporalDecoder(Scalar("time", kinds, lambda v, t: v))


def date_time() -> TemporalDecoder:
    return TemporalDecoder(Scalar("datetime", (T.TimestampNTZType,), lambda v, t: v))


def iso8601() -> TemporalDecoder:
    """An instant; strings are refused, string().iso8601() parses them."""
    return TemporalDecoder(Scalar("instant", (T.TimestampType,), lambda v, t: v))


def offset_date_time() -> OffsetDecoder:
    return OffsetDecoder(Scalar("offset date-time", (T.StructType,), lambda v, t: v))


def bytes_() -> Chain:
    return Chain(Scalar("byte[]", (T.BinaryType,), lambda v, t: v))

