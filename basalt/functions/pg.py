"""PostgreSQL scalar semantics as Column builders (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x: Column, digits: int = 0) -> Column:
    """By scaling doubles, halves away from zero."""
    scale = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def float_to_int(x: Column) -> Column:
    """Casts round, they do not truncate."""
    return F.round(x, 0).cast("bigint")


def text_to_bool(x: Column) -> Column:
    word = F.lower(F.trim(x))
    return F.when(word.isin("t", "true", "yes", "y", "on", "1"), True).when(word.isin("f", "false", "no", "n", "off", "0"), False).when(x.isNotNull(), F.raise_error(F.concat(F.lit("invalid input syntax for type boolean: "), x)).cast("boolean"))


def concat(*xs: Column) -> Column:
    """Nulls count as empty text."""
    return F.concat_ws("", *(x.cast("string") for x in xs))


def substring(x: Column, start: Column, length: Column | None = None) -> Column:
    """1-based; what lies before the text is cut off, not counted from the end."""
    if length is None:
        return F.substring(x, F.greatest(start, F.lit(1)), F.length(x))
    end = F.greatest(start + length, F.lit(1))
    first = F.greatest(start, F.lit(1))
    return F.substring(x, first, F.greatest(end - first, F.lit(0)))


def left(x: Column, n: Column) -> Column:
    """Negative n: all but the last -n characters."""
    return F.substring(x, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(x) + n, F.lit(0))))


def right(x: Column, n: Column) -> Column:
    """Negative n: all but the first -n characters."""
    size = F.when(n >= 0, F.least(n, F.length(x))).otherwise(F.greatest(F.length(x) + n, F.lit(0)))
    return F.substring(x, F.length(x) - size + 1, size)


def order(x: Column, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """Nulls are larger than all values unless stated."""
    first = descending if nulls_first is None else nulls_first
    if descending:
        return x.desc_nulls_first() if first else x.desc_nulls_last()
    return x.asc_nulls_first() if first else x.asc_nulls_last()
