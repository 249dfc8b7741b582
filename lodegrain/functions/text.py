"""Column expressions whose results differ from the Spark functions of similar names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and limits that users of the format rules rely on.
MAX_EMAIL, MAX_URL, MAX_IP = 254, 2048, 45
EMAIL = r"[a-zA-Z0-9._%+\-]{1,64}@[a-zA-Z0-9.\-]{1,255}\.[a-zA-Z]{2,}"
IPV4 = r"((25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)\.){3}(25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)"
CUID = r"c[a-z0-9]{24}"
ULID = r"[0-9A-HJKMNP-TV-Z]{26}"


def utf16_length(v: Column) -> Column:
    """Length in UTF-16 units; characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(v, "UTF-16BE")) / 2).cast("int")


def full_match(v: Column, pattern: str) -> Column:
    """Whether the whole value, line ends included, matches the pattern."""
    return v.rlike(rf"\A(?:{pattern})\z")


def is_blank(v: Column) -> Column:
    return v.rlike(r"\A\p{javaWhitespace}*\z")


def strip(v: Column) -> Column:
    """Without the leading and trailing characters up to U+0020."""
    return F.regexp_replace(v, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def _ipv6() -> str:
    group, v4 = "[0-9a-fA-F]{1,4}", IPV4
    tails = [f"(?:{group}:){{7}}{group}", f"(?:{group}:){{6}}{v4}"]
    for left in range(0, 8):
        head = f"{group}(?::{group}){{{left - 1}}}" if left else ""
        right = 7 - left
        tails.append(f"{head}::(?:{group}(?::{group}){{0,{right - 1}}})?" if right else f"{head}::")
        if right >= 2:
            tails.append(f"{head}::(?:{group}:){{0,{right - 2}}}{v4}")
    return "(?:" + "|".join(tails) + ")(?:%[0-9a-zA-Z_.\\-]+)?"


IPV6 = _ipv6()


def is_ipv4(v: Column) -> Column:
    return full_match(v, IPV4)


def is_ipv6(v: Column) -> Column:
    """An IPv6 address, in brackets or not, by its grammar alone: names are never looked up."""
    return (F.length(v) <= MAX_IP) & v.contains(":") & (full_match(v, IPV6) | full_match(v, rf"\[{IPV6}\]"))


def is_email(v: Column) -> Column:
    return (utf16_length(v) <= MAX_EMAIL) & full_match(v, EMAIL)


def is_url(v: Column) -> Column:
    host = F.try_parse_url(v, F.lit("HOST"))
    return (utf16_length(v) <= MAX_URL) & full_match(v, r"https?://[\s\S]*") & F.coalesce(F.length(host) > 0, F.lit(False))


def parse_uri(v: Column) -> Column:
    return F.try_reflect(F.lit("java.net.URI"), F.lit("create"), v)


def parse_uuid(v: Column) -> Column:
    """The canonical form; groups may be written short, as in 1-1-1-1-1."""
    groups = [F.split(v, "-").getItem(k) for k in range(5)]
    widths = (8, 4, 4, 4, 12)
    padded = F.concat_ws("-", *(F.right(F.lpad(F.lower(g), 16, "0"), F.lit(w)) for g, w in zip(groups, widths)))
    return F.when(full_match(v, r"[0-9a-fA-F]{1,16}(-[0-9a-fA-F]{1,16}){4}") & (F.length(v) <= 36), padded)


DATE = r"[+-]?\d{4,9}-\d{2}-\d{2}"
CLOCK = r"\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"


def parse_date(v: Column) -> Column:
    return F.when(full_match(v, r"\d{4}-\d{2}-\d{2}"), F.try_to_date(v, "yyyy-MM-dd"))


def parse_date_time(v: Column) -> Column:
    """A date and time without zone; digits beyond microseconds are dropped."""
    return F.when(full_match(v, rf"\d{{4}}-\d{{2}}-\d{{2}}[Tt]{CLOCK}") & _clock_ok(v), F.upper(v).try_cast("timestamp_ntz"))


def _clock_ok(v: Column) -> Column:
    return full_match(v, r"(.*[Tt])?([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?([Zz]|[+-].*)?")


def parse_instant(v: Column) -> Column:
    return F.when(full_match(v, rf"\d{{4}}-\d{{2}}-\d{{2}}[Tt]{CLOCK}([Zz]|[+-]\d{{2}}:?(\d{{2}}(:?\d{{2}})?)?)") & _clock_ok(v), F.upper(v).try_cast("timestamp"))


def parse_offset_date_time(v: Column) -> Column:
    """struct(ts, offset_seconds); the offset is mandatory."""
    offset = F.regexp_extract(v, r"([Zz]|[+-]\d{2}:\d{2}(?::\d{2})?)\z", 1)
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    part = lambda k: F.coalesce(F.get(F.split(F.substring(offset, 2, 8), ":"), F.lit(k)).try_cast("int"), F.lit(0))
    seconds = F.when(F.upper(offset) == "Z", 0).otherwise(sign * (part(0) * 3600 + part(1) * 60 + part(2)))
    ts = F.upper(v).try_cast("timestamp")
    return F.when(full_match(v, rf"\d{{4}}-\d{{2}}-\d{{2}}[Tt]{CLOCK}([Zz]|[+-]\d{{2}}:\d{{2}}(:\d{{2}})?)") & _clock_ok(v) & ts.isNotNull(), F.struct(ts.alias("ts"), seconds.alias("offset_seconds")))


def parse_time(v: Column) -> Column:
    """Nanoseconds of the day, as Spark's TIME type is off unless configured."""
    part = lambda k: F.coalesce(F.get(F.split(v, "[:.]"), F.lit(k)).try_cast("bigint"), F.lit(0))
    nanos = F.coalesce(F.rpad(F.get(F.split(v, r"\."), F.lit(1)), 9, "0").try_cast("bigint"), F.lit(0))
    return F.when(full_match(v, CLOCK) & _clock_ok(v), (part(0) * 3600 + part(1) * 60 + part(2)) * 1_000_000_000 + F.when(v.contains("."), nanos).otherwise(0))


def decimal_scale(text: Column) -> Column:
    """Digits after the point of a number as written, less its exponent."""
    fraction = F.length(F.regexp_extract(text, r"\.(\d*)", 1))
    exponent = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?\d+)\z", 1).try_cast("int"), F.lit(0))
    return fraction - exponent


def quoted(value) -> str:
    """A Python value as messages print it."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(quoted(v) for v in value) + "]"
    return "null" if value is None else str(value)
