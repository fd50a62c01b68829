"""How many reads a depth of coverage takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def read_number(total: Column, depth: float, length: int) -> Column:
    """Reads for a depth of coverage, rounded up to an even number."""
    n = F.floor(F.lit(depth) * total / length)
    return n + n % 2
