"""Decimal-exact rounding of DOUBLE amounts.

``round`` on a DOUBLE rounds the shortest decimal text half-up in Spark but
the binary value in other engines, so half-cent ties come out differently.
Passing through DECIMAL(38, 8) first makes the tie decision on a decimal
value in every engine: amounts are taken at eight decimals, which also absorbs
the noise of floating-point sums. An amount too large for that decimal (1e30 and
more) has no decimals as a DOUBLE and is returned as it is, as are NaN and infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

_DEC = DecimalType(38, 8)


def money_round(col: Column | str, scale: int = 2) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.round(c.try_cast(_DEC), scale).cast("double"), c.cast("double"))
