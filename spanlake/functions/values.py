"""Plain values: numbers that may be none, options, prompts, kinds of failure and waits before another try."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Failures that another try may mend; longest wait in seconds.
TRANSIENT = ["rate_limited", "server", "timeout", "connection", "empty"]
LONGEST_S = 60.0


def number_or_text(value: Column) -> Column:
    """A number where a text is one, in its shortest form; else the text as it is."""
    number = value.try_cast("double")
    return F.coalesce(number.cast("string"), value)


def option(value: Column, kind: str, default) -> Column:
    """A configured value as a number; the default where it is empty or no such number."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")).try_cast(kind), F.lit(default).cast(kind))


def first_option(*values: Column) -> Column:
    """The first that is not blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A prompt with its {names} filled in."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def failure_kind(status: Column) -> Column:
    """What an HTTP status says went wrong."""
    return (
        F.when(status == 408, "timeout").when(status == 429, "rate_limited").when(status >= 500, "server")
        .when(status.isin(401, 403), "auth").when(status == 400, "bad_request").otherwise("http")
    )


def is_transient(kind: Column) -> Column:
    return kind.isin(TRANSIENT)


def wait_s(attempt: Column, share: Column) -> Column:
    """Seconds before the attempt after ``attempt`` (1..) failures: twice as long each time, at most a minute, times half to all by ``share`` 0..1."""
    return F.least(F.lit(LONGEST_S), F.pow(F.lit(2.0), attempt - 1)) * (0.5 + share / 2)
