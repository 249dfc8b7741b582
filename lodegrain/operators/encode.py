"""Encoders: from typed columns back to plain objects. They cannot fail."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Encoder:
    f: Callable[[Column], Column]

    def __call__(self, c: Column) -> Column:
        return self.f(c)

    def contramap(self, g: Callable[[Column], Column]) -> "Encoder":
        return Encoder(lambda c: self.f(g(c)))

    def and_then(self, g: Callable[[Column], Column]) -> "Encoder":
        return Encoder(lambda c: g(self.f(c)))

    def nullable(self) -> "Encoder":
        return Encoder(lambda c: F.when(c.isNotNull(), self.f(c)))

    def with_default(self, default) -> "Encoder":
        """Encodes the default in place of null."""
        value = lambda: default() if callable(default) else default
        return Encoder(lambda c: self.f(F.coalesce(c, F.lit(value()) if not isinstance(value(), Column) else value())))


@dataclass(frozen=True)
class Property:
    """A key, a getter of the value's column (by default the field of that name), and an encoder."""

    key: str
    getter: Callable[[Column], Column]
    encoder: Encoder

    def encode(self, c: Column) -> Column:
        return self.encoder(self.getter(c)).alias(self.key)


def property_(key: str, encoder: Encoder, getter: Callable[[Column], Column] | None = None) -> Property:
    return Property(key, getter or (lambda c: c.getField(key)), encoder)


def object_(*properties: Property) -> Encoder:
    """A struct with the keys in the order given; null for a null value."""
    return Encoder(lambda c: F.when(c.isNotNull(), F.struct(*(p.encode(c) for p in properties))))


def nested(encoder: Encoder) -> Encoder:
    return encoder


def list_(element: Encoder) -> Encoder:
    return Encoder(lambda c: F.transform(c, element.f))


def to_json(encoder: Encoder) -> Encoder:
    return encoder.and_then(F.to_json)


identity = Encoder(lambda c: c)
string = int_ = long_ = double_ = float_ = bool_ = decimal_ = enum_of = identity


def _clock(seconds: Column, micros: Column) -> Column:
    """:ss and a fraction of 3 or 6 digits, each left out where it is zero."""
    ms = F.lpad((micros / 1000).cast("int").cast("string"), 3, "0")
    us = F.lpad(micros.cast("string"), 6, "0")
    tail = F.when(micros == 0, F.lit("")).when(micros % 1000 == 0, F.concat(F.lit("."), ms)).otherwise(F.concat(F.lit("."), us))
    return F.concat(F.lit(":"), F.lpad(seconds.cast("string"), 2, "0"), tail)


def _parts(c: Column) -> tuple[Column, Column]:
    micros = F.date_format(c, "SSSSSS").cast("int")
    return F.second(c), micros


def _instant(c: Column) -> Column:
    seconds, micros = _parts(c)
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm"), _clock(seconds, micros), F.lit("Z"))


def _local(c: Column) -> Column:
    seconds, micros = _parts(c)
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm"), F.when((seconds == 0) & (micros == 0), F.lit("")).otherwise(_clock(seconds, micros)))


def _offset(c: Column) -> Column:
    ts, off = c.getField("ts"), c.getField("offset_seconds")
    local = F.timestamp_micros(F.unix_micros(ts) + off.cast("bigint") * 1_000_000)
    size = F.abs(off)
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    zone = F.when(off == 0, F.lit("Z")).otherwise(F.concat(F.when(off < 0, F.lit("-")).otherwise(F.lit("+")), two(F.floor(size / 3600)), F.lit(":"), two(F.floor(size / 60) % 60), F.when(size % 60 != 0, F.concat(F.lit(":"), two(size % 60))).otherwise(F.lit(""))))
    return F.concat(_local(local), zone)


def _of_day(c: Column) -> Column:
    seconds, nanos = F.floor(c / 1_000_000_000), c % 1_000_000_000
    clock = F.concat(F.lpad(F.floor(seconds / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(seconds / 60) % 60).cast("string"), 2, "0"))
    return F.concat(clock, F.when((seconds % 60 == 0) & (nanos == 0), F.lit("")).otherwise(_clock(seconds % 60, F.floor(nanos / 1000))))


#: Temporal text leaves out what is zero, as ISO 8601 allows. Instants are printed in the session's zone, which must be UTC.
iso8601 = Encoder(_instant)
date = Encoder(lambda c: F.date_format(c, "yyyy-MM-dd"))
time = Encoder(_of_day)
date_time = Encoder(_local)
offset_date_time = Encoder(_offset)
