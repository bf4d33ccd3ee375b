"""Column functions over numbers and arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridelta.functions.text import strip


def quantity(c: Column) -> Column:
    """Struct of a decimal and its unit from '1,204.5 seats'; null without a leading number."""
    number = F.regexp_extract(c, r"^\s*([+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[+-]?[0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.lower(strip(F.regexp_extract(c, r"^\s*[+-]?[0-9][0-9,.]*\s*(.*)$", 1)))
    return F.when(number != "", F.struct(F.replace(number, F.lit(","), F.lit("")).cast("decimal(28,6)").alias("value"), unit.alias("unit")))


def unit_score(c: Column) -> Column:
    """A score in [0, 1], else null."""
    return F.when(~F.isnan(c) & c.between(0.0, 1.0), c)


def magnitude_step(c: Column) -> Column:
    """How far a number is moved when it is perturbed: a step that fits its size, at least 1."""
    a = F.abs(c)
    return F.when(a < 10, 1).when(a < 100, 5).when(a < 1000, 25).otherwise(F.greatest(F.floor(a / 10), F.lit(1))).cast("long")


def hard_path_score(gap: Column, span: Column, prior: Column, hops: Column, dated: Column, views: Column) -> Column:
    """Difficulty of a path; gap and span in months, dated and prior as shares."""
    return 40 / (1 + gap) + 20 / (1 + span / 12) + 20 / (1 + 1000 * prior) + 10 * hops / 5 + 5 * dated + 5 / (1 + views / 1e6)


def non_blank_distinct(c: Column) -> Column:
    """The array has no null or blank string and none twice."""
    return F.coalesce(F.forall(c, lambda x: x.isNotNull() & (strip(x) != "")) & (F.size(c) == F.size(F.array_distinct(c))), F.lit(False))


def same_set(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def gaps(c: Column) -> Column:
    """Differences of neighbours of an array sorted upwards."""
    s = F.array_sort(c)
    return F.when(F.size(s) > 1, F.zip_with(F.slice(s, 2, F.size(s) - 1), F.slice(s, 1, F.size(s) - 1), lambda x, y: x - y)).otherwise(F.slice(s, 1, 0))
