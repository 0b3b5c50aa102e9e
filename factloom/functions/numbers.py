"""Column functions on numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 3) -> Column:
    """``x`` to ``digits`` decimal places, halves to even.

    What the binary double holds decides, not its shortest text: 2.675 lies below the half, 0.0005
    above.  The double is split in two so that its product with a power of ten is exact.
    """
    x, scale = x.cast("double"), float(10**digits)
    wide = x * float(2**27 + 1)
    high = wide - (wide - x)
    below = F.floor(x * scale)
    beyond = (high * (2 * scale) - (below * 2 + 1).cast("double")) + (x - high) * (2 * scale)
    n = F.when(beyond < 0, below).when(beyond > 0, below + 1).otherwise(below + F.pmod(below, F.lit(2)))
    return n / F.lit(scale)
