"""Column functions over frequency vectors and their rank vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bases import col


def rank_vector(vals: Column | str) -> Column:
    """For each dimension its position in ascending order of the values, ties by dimension; null for null."""
    ordered = F.array_sort(F.transform(col(vals), lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    placed = F.transform(ordered, lambda s, p: F.struct(s["i"].alias("i"), p.alias("p")))
    return F.transform(F.array_sort(placed), lambda s: s["p"].cast("int"))


def rank_distance(a: Column | str, b: Column | str) -> Column:
    """Sum of absolute rank differences."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def is_vector(c: Column | str, dims: int) -> Column:
    """An array of ``dims`` entries without null (and for doubles without NaN)."""
    return F.coalesce((F.size(col(c)) == dims) & F.forall(col(c), lambda x: x.isNotNull()), F.lit(False))


def is_numeric_vector(c: Column | str, dims: int) -> Column:
    return is_vector(c, dims) & F.coalesce(F.forall(col(c), lambda x: ~F.isnan(x)), F.lit(False))
