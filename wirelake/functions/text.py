"""Scalar functions on the fields of messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def command_word(text: Column) -> Column:
    """The first word of a command, a-z in capitals."""
    return F.translate(F.substring_index(F.trim(text), " ", 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def plain_name(text: Column) -> Column:
    """Letters, digits and ``_:/-`` alone."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_:/-]", "")


def service_of(path: Column) -> Column:
    """``/a.B/C`` as ``a.B.C``."""
    return F.replace(F.regexp_replace(path, r"^/+|/+$", ""), F.lit("/"), F.lit("."))


def one_line(statement: Column, most: int = 1024) -> Column:
    """Line feeds as blanks, and no more than a bounded part of a statement."""
    return F.substring(F.translate(statement, "\n", " "), 1, most)


def from_hex(text: Column) -> Column:
    """The number that hex digits stand for; null if there is anything else."""
    return F.when(text.rlike(r"^[0-9A-Fa-f]{1,15}$"), F.conv(text, 16, 10).cast("bigint"))


def header_names(headers: Column) -> Column:
    return F.transform_keys(headers, lambda k, _: F.lower(k))


def go_duration(ns: Column) -> Column:
    """Nanoseconds as text like ``1h2m3.5s``, ``12.5ms``, ``681.536µs`` or ``0s``."""

    def decimal(unit: int) -> Column:
        # Whole and fraction apart, so that no digit is lost in a double.
        a = F.abs(ns)
        width = len(str(unit)) - 1
        fraction = F.regexp_replace(F.lpad((a % unit).cast("string"), width, "0"), "0+$", "")
        return F.concat(F.floor(a / unit).cast("string") if unit < 10**9 else ((a - a % unit) / unit).cast("bigint").cast("string"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))

    a = F.abs(ns)
    minutes_all = ((a - a % 60_000_000_000) / 60_000_000_000).cast("bigint")
    rest = a % 60_000_000_000
    fraction = F.regexp_replace(F.lpad((rest % 1_000_000_000).cast("string"), 9, "0"), "0+$", "")
    secs = F.concat(((rest - rest % 1_000_000_000) / 1_000_000_000).cast("bigint").cast("string"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("s"))
    hours = ((minutes_all - minutes_all % 60) / 60).cast("bigint")
    long = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""), F.when(minutes_all > 0, F.concat((minutes_all % 60).cast("string"), F.lit("m"))).otherwise(""), secs)
    text = F.when(a == 0, "0s").when(a < 1_000, F.concat(a.cast("string"), F.lit("ns"))).when(a < 1_000_000, F.concat(decimal(1_000), F.lit("µs"))).when(a < 1_000_000_000, F.concat(decimal(1_000_000), F.lit("ms"))).otherwise(long)
    return F.when(ns.isNotNull(), F.concat(F.when(ns < 0, "-").otherwise(""), text))


def captured_body(body: Column, content_type: Column, most: int = 102_400) -> Column:
    """The first bytes of bodies of text types; null for others."""
    return F.when(F.lower(content_type).rlike("json|plain|html"), F.substring(body, 1, most))


def body_is_json(body: Column) -> Column:
    return F.try_parse_json(body).isNotNull()
