"""Numbers for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, places: int) -> Column:
    """A double to ``places`` digits as SQL engines round in binary: scaled, halves away from zero, scaled back.

    Spark's own ``round`` goes by a double's shortest decimals, so 0.63955 becomes 0.6396 there although it lies below the half.
    It also loses the sign of what becomes zero, which -1e-9 keeps elsewhere (-0.0).
    """
    scale = float(10**places)
    scaled = (F.col(c) if isinstance(c, str) else c) * scale
    return F.when(scaled < 0, -F.round(-scaled)).otherwise(F.round(scaled)) / scale
