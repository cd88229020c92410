"""Scalar rules about sizes, rates, names and options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def even(n: Column) -> Column:
    """The next even number for positive n; other values stay."""
    return F.when(n > 0, n + F.pmod(n, F.lit(2))).otherwise(n)


def rescale(n: Column, quarters: int, round_even: bool = True) -> Column:
    """n times quarters / 4, truncated, then made even."""
    out = F.floor(n * quarters / 4)
    return even(out) if round_even else out


def ratio_bucket(r: Column) -> Column:
    """1, 0.75, 0.5 or 0.25: the largest step that r reaches, a quarter at least."""
    return F.when(r >= 1, 1.0).when(r >= 0.75, 0.75).when(r >= 0.5, 0.5).otherwise(0.25)


def frame_rate(text: Column) -> Column:
    """'num/den' as a number; 25 where it is not one or den is 0."""
    parts = F.split(text, "/")
    num, den = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    return F.coalesce(F.when(den != 0, num / F.nullif(den, F.lit(0.0))), F.lit(25.0))


def seconds_of(text: Column) -> Column:
    """'HH:MM:SS' (seconds may have a fraction) as seconds."""
    p = F.split(text, ":")
    return F.get(p, F.lit(0)).try_cast("double") * 3600 + F.get(p, F.lit(1)).try_cast("double") * 60 + F.get(p, F.lit(2)).try_cast("double")


def option_kind(text: Column) -> Column:
    """bool for true or false, int for whole numbers, float for other numbers, else string."""
    number = text.try_cast("double")
    return F.when(F.lower(text).isin("true", "false"), "bool").when(number.isNotNull() & (number == F.floor(number)), "int").when(number.isNotNull(), "float").otherwise("string")


def chunk_name(number: Column, first: Column, last: Column) -> Column:
    pad = lambda c, n: F.when(F.length(c.cast("string")) >= n, c.cast("string")).otherwise(F.lpad(c.cast("string"), n, "0"))
    return F.concat(F.lit("chunk-"), pad(number, 3), F.lit("-"), pad(first, 8), F.lit("-"), pad(last, 8))


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"(datediff(to_date({ts}), DATE'1970-01-01') * 86400L + hour({ts}) * 3600 + minute({ts}) * 60) * 1000000L + cast(date_part('SECOND', {ts}) * 1000000 AS BIGINT)")


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """The basename without its last extension; a name that only begins with a dot keeps it."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def quoted(text: Column) -> Column:
    """The text in double quotes, once."""
    return F.when(F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"')) & (F.length(text) > 1), text).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def has_non_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def frame_seconds(frame: Column, rate: Column) -> Column:
    """When a frame begins, in seconds with three decimals (ties to even), as text."""
    return F.format_string("%.3f", F.bround((frame / rate).cast("double"), 3))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def scale_factor(target: Column, source: Column) -> Column:
    """The least whole factor of both sides that makes an area of `source` reach `target`."""
    return F.ceil(F.sqrt(target / source))


def ceil_to(n: Column, multiple: int) -> Column:
    return F.ceil(n / multiple) * multiple


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
