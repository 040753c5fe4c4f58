"""Expressions on byte values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading bytes two values share; null counts as empty. Values are below 2**25 bytes.

    A descent over powers of two: each step adds its power if the next that
    many bytes are equal, so 25 comparisons do for any length.
    """
    shorter = F.least(F.octet_length(a), F.octet_length(b))
    steps = F.transform(F.sequence(F.lit(24), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))

    def step(n: Column, more: Column) -> Column:
        return F.when((n + more <= shorter) & (F.substring(a, n + 1, more) == F.substring(b, n + 1, more)), n + more).otherwise(n)

    return F.coalesce(F.aggregate(steps, F.lit(0), step), F.lit(0)).cast("bigint")


def after(value: Column, n: Column) -> Column:
    """The bytes of ``value`` behind its first ``n``; null for null."""
    return F.substring(value, n.cast("int") + 1, F.octet_length(value))


def tsv_cell(value: Column) -> Column:
    r"""A cell of tab-separated text: \N for null, escapes for \ tab CR LF, base64 for bytes that aren't UTF-8."""
    text = value.cast("string")
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return F.when(value.isNull(), F.lit("\\N")).when(~F.is_valid_utf8(value.cast("string")), F.concat(F.lit("base64:"), F.base64(value.cast("binary")))).otherwise(text)


def seconds_left(deadline: Column, now: Column) -> Column:
    """Whole seconds to ``deadline``, at least 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(deadline) - F.unix_micros(now)) / 1_000_000)).cast("bigint")
