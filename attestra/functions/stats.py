"""Statistics of measured runs, as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a share, within [0, 1]; null without cases."""
    z = 1.959963984540054
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def amdahl(share: Column) -> Column:
    """Upper bound of the speed-up when one stage costs nothing."""
    return 1 / F.greatest(1 - share, F.lit(1e-9))
