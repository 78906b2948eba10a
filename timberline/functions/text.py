"""Small text and number helpers shared by the expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timberline.functions import patterns as P


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(P.WHITESPACE))


def words(text: Column) -> Column:
    """Non-empty pieces between runs of white space."""
    return F.filter(F.split(text, P.uni(r"\s+")), lambda w: w != "")


def half_up(value: Column, places: int) -> Column:
    """Round half up the same way in every engine: floor(x * 10^p + 0.5) / 10^p."""
    scale = float(10**places)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def contains_any(text: Column, needles) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def last_word(tokens: Column, keep) -> Column:
    """Last token for which ``keep`` holds, else null."""
    return F.try_element_at(F.filter(tokens, keep), F.lit(-1))


def first_word(tokens: Column, keep) -> Column:
    return F.try_element_at(F.filter(tokens, keep), F.lit(1))


def none_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def lookup(key: Column, table: dict, other) -> Column:
    """``CASE key WHEN ...`` over a small fixed table."""
    out = None
    for name, value in table.items():
        branch = (key == name, F.lit(value))
        out = F.when(*branch) if out is None else out.when(*branch)
    return out.otherwise(F.lit(other))


def shortened(value: Column, chars: int | None) -> Column:
    """The whole text, or its first ``chars`` characters."""
    return value if chars is None else F.substring(value, 1, chars)


def two_decimals(value: Column) -> Column:
    """Fixed two-decimal text of a score."""
    cents = F.floor(value * 100 + 0.5)
    return F.concat(
        F.floor(cents / 100).cast("string"),
        F.lit("."),
        F.lpad((cents % 100).cast("string"), 2, "0"),
    )


def pin(name: str) -> Column:
    """Column ``name`` as it is, computed here and not again inside later filters.

    A filter above a projection is normally moved below it by repeating the
    column's expression. For columns built in many steps that repeats every step
    over and over. A test on the partition number (always true, and not known to
    the optimizer beforehand) keeps the filter above; unused columns are still
    pruned.
    """
    return F.when(F.spark_partition_id() >= 0, F.col(name)).alias(name)
