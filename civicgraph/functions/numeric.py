"""Rounding and distance expressions shared by every operator.

Everything here builds a Column, so it stays inside whole-stage codegen.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per degree at the city's latitude, and walking speed.
LAT_M = 111320.0
LON_M = 85390.0
WALK_M_PER_MIN = 80.0
EARTH_RADIUS_MILES = 3959.0


def col(c):
    return F.col(c) if isinstance(c, str) else c


def round_even(x, digits=0) -> Column:
    """Round half to even on the scaled value (the numpy rule).

    Spark's own ``round`` is half-up, which differs on ties.
    """
    scale = float(10**digits)
    return F.rint(col(x).cast("double") * F.lit(scale)) / F.lit(scale)


def planar_m2(lat1, lon1, lat2, lon2) -> Column:
    """Squared planar distance in metres; compare it with r*r to avoid sqrt."""
    dy = (col(lat1) - col(lat2)) * F.lit(LAT_M)
    dx = (col(lon1) - col(lon2)) * F.lit(LON_M)
    return dy * dy + dx * dx


def degree_d2(lat1, lon1, lat2, lon2) -> Column:
    """Squared distance in raw degrees (no longitude scaling)."""
    dy = col(lat1) - col(lat2)
    dx = col(lon1) - col(lon2)
    return dy * dy + dx * dx


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle miles."""
    la1, lo1, la2, lo2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    s1 = F.sin((la2 - la1) / F.lit(2.0))
    s2 = F.sin((lo2 - lo1) / F.lit(2.0))
    a = s1 * s1 + F.cos(la1) * F.cos(la2) * s2 * s2
    return F.lit(EARTH_RADIUS_MILES) * F.lit(2.0) * F.asin(F.sqrt(a))


def to_number(c) -> Column:
    """Numeric coercion: unparsable text becomes null instead of an error."""
    return col(c).cast("string").try_cast("double")


def zero_pad(c, width=2) -> Column:
    """null -> "", then left-pad with zeros without ever truncating."""
    s = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def clip01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))


def null_if_nan(c) -> Column:
    """NaN to null, applied once where results leave Spark."""
    return F.when(F.isnan(col(c)), F.lit(None)).otherwise(col(c))
