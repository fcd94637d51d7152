"""Milliseconds, timecodes and interval arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared milliseconds; 0 for intervals that touch or are apart."""
    return F.greatest(F.lit(0).cast("long"), F.least(e1, e2) - F.greatest(s1, s2))


def gap_ms(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Milliseconds between two intervals; 0 if they touch or overlap."""
    return F.greatest(F.lit(0).cast("long"), s1 - e2, s2 - e1)


def overlap_ratio(s: Column, e: Column, ws: Column, we: Column) -> Column:
    """Share of a span that lies in a window; the span counts as 1 ms at least."""
    return overlap_ms(s, e, ws, we) / F.greatest(F.lit(1).cast("long"), e - s)


def whole_clock(s: Column) -> Column:
    """Whole seconds as HH:MM:SS with as many digits of hours as they have; by integers, as a double loses seconds from 2^53 ms on."""
    unit = lambda n: F.call_function("div", s, F.lit(n))
    part = lambda c: F.when(F.length(c.cast("string")) < 2, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    return F.concat(part(unit(3600)), F.lit(":"), part(unit(60) % 60), F.lit(":"), part(s % 60))


def timecode(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS.mmm."""
    x = F.greatest(F.lit(0).cast("long"), ms.cast("long"))
    return F.concat(whole_clock(F.call_function("div", x, F.lit(1000))), F.lit("."), F.lpad((x % 1000).cast("string"), 3, "0"))


def clock(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS."""
    return F.substring_index(timecode(ms), ".", 1)


def seconds_timecode(s: Column) -> Column:
    """Seconds as a timecode, truncated to whole milliseconds."""
    return timecode((s * 1000).cast("long"))


def half_even_ms(s: Column) -> Column:
    """Seconds to milliseconds, halves to even."""
    return F.rint(s * 1000).cast("long")


def parse_timecode(text: Column) -> Column:
    """H:M:S.f (the fraction scaled to milliseconds) or M:S.f (taken as it stands); anything else is 0."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    last = F.split(F.element_at(parts, -1), r"\.")
    whole, fraction = F.get(last, F.lit(0)), F.get(last, F.lit(1))
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
    scaled = number(F.rpad(F.substring(fraction, 1, 3), 3, "0"))
    literal = number(fraction)
    three = number(F.get(parts, F.lit(0))) * 3_600_000 + number(F.get(parts, F.lit(1))) * 60_000 + number(whole) * 1000 + F.when(fraction.isNull(), 0).otherwise(scaled)
    two = number(F.get(parts, F.lit(0))) * 60_000 + number(whole) * 1000 + F.when(fraction.isNull(), 0).otherwise(literal)
    return F.when(n == 3, three).when(n == 2, two).otherwise(F.lit(0).cast("long"))


def flexible_seconds(text: Column, span_s: Column) -> Column:
    """'S', 'M:S' or 'H:M:S' as seconds; null if it cannot be read, is negative or lies half a second beyond the span."""
    parts = F.split(F.trim(text), ":")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("double"))
    bad = (F.size(parts) > 3) | F.exists(numbers, lambda x: x.isNull() | F.isnan(x))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when(~bad & (total >= 0) & (total <= span_s + 0.5), total)
