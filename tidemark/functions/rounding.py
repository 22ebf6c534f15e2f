"""Rounding of doubles to decimal places, exact halves to even, by their exact binary value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0  # 2^27 + 1 parts a double into two halves whose products are exact


def half_even(x: Column, places: int = 2) -> Column:
    """``x`` rounded to ``places``. What a double's product with a power of ten leaves out decides where the product
    looks like an exact half: 2.675 is below it and gives 2.67, 0.125 is one and gives 0.12. ``x`` is read several
    times, so it should be a stored column; null stays null."""
    ten = F.lit(10.0**places)
    high = x * SPLIT - (x * SPLIT - x)
    product = x * ten
    rest = (high * ten - product) + (x - high) * ten
    whole = F.floor(product).cast("double")
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (whole % 2 != 0))))
    return (whole + F.when(up, 1.0).otherwise(0.0)) / ten
