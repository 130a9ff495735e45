"""Consecutive row numbers without funnelling all rows through one task."""

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


#: Rows that a block should hold.
BLOCK_ROWS = 100_000


def sequential_index(df: DataFrame, order, key=None, width=None, out="idx", group=()) -> DataFrame:
    """Add ``out`` = 0-based position of each row in ``order``.

    ``group`` holds leading order columns of few values and ``key`` the numeric
    column that follows them; rows are numbered inside (group, key div width)
    blocks in parallel, then shifted by the size of all earlier blocks. Without a
    ``width`` it follows from the keys' range and number, so that a block holds
    about BLOCK_ROWS rows however sparse the keys are. Only the block counts meet
    in a single task. Keys must be unique within a group.
    """
    group = list(group)
    blocks = group + ["_block"]
    if width is None:
        low, high = F.min(key).cast("double"), F.max(key).cast("double")
        span = F.ceil((high - low + 1) * F.lit(float(BLOCK_ROWS)) / F.count(F.lit(1)))
        width = F.coalesce(F.greatest(span, F.lit(1)), F.lit(1)).alias("w")
        width = df.agg(width).scalar()
    else:
        width = F.lit(width)
    df = df.withColumn("_block", F.floor(F.col(key) / width))
    sizes = df.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy(*blocks).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(b).alias(f"_o_{b}") for b in blocks],
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = F.row_number().over(W.partitionBy(*blocks).orderBy(*order)) - 1
    numbered = df.withColumn("_rn", within)
    cond = [F.col(b).eqNullSafe(F.col(f"_o_{b}")) for b in blocks]
    joined = numbered.join(offsets, cond, "inner")
    keep = [c for c in numbered.columns if c not in ("_block", "_rn")]
    return joined.select(*keep, (F.col("_off") + F.col("_rn")).cast("long").alias(out))
