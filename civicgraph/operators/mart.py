"""Building the resource mart: dedup, ids, transit proximity and scores."""

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.indexing import sequential_index
from ..functions.numeric import WALK_M_PER_MIN, clip01, round_even, to_number
from ..functions.session import materialise
from .spatial import knn, radius_count

# The seven columns every resource has, and the city's box.
CORE_COLUMNS = ["resource_id", "resource_type", "name", "address", "borough",
                "latitude", "longitude"]
LAT_RANGE = (40.4, 40.95)
LON_RANGE = (-74.3, -73.6)


def in_city(df: DataFrame, lat=LAT_RANGE, lon=LON_RANGE) -> DataFrame:
    """Inclusive bounding box; null coordinates drop out. lon=None skips it."""
    df = df.where(F.col("latitude").between(*lat))
    return df.where(F.col("longitude").between(*lon)) if lon else df.where(F.col("longitude").isNotNull())


def spatial_dedup(df: DataFrame, order) -> DataFrame:
    """Keep the first row per (type, lat, lon rounded to 4 places).

    A rank-1 window filter is pushed below the shuffle as a per-task limit, so
    even one position holding most rows reaches its reducer as a few rows.
    """
    keyed = (df.withColumn("_lat4", round_even("latitude", 4))
             .withColumn("_lon4", round_even("longitude", 4)))
    first = W.partitionBy("resource_type", "_lat4", "_lon4").orderBy(*order)
    return (keyed.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1)
            .drop("_rn", "_lat4", "_lon4"))


def reissue_ids(df: DataFrame, order, key, group=()) -> DataFrame:
    """resource_id = first 8 letters of the type + _ + global row index."""
    numbered = sequential_index(df, order, key, out="_idx", group=group)
    rid = F.concat_ws("_", F.substring("resource_type", 1, 8), F.col("_idx").cast("string"))
    return numbered.withColumn("resource_id", rid).drop("_idx")


def normalize(df: DataFrame, order, key, group=()) -> DataFrame:
    """Coerce, box, dedup, re-id, fill and trim."""
    df = df.withColumn("latitude", to_number("latitude")).withColumn("longitude", to_number("longitude"))
    df = reissue_ids(spatial_dedup(in_city(df), order), order, key, group)
    return (df.withColumn("name", F.trim(F.coalesce("name", F.lit("Unknown"))))
            .withColumn("address", F.trim(F.coalesce("address", F.lit("")))))


def nearest_station(df: DataFrame, stations: DataFrame, id_col="resource_id") -> DataFrame:
    """Add nearest_transit_{id,name,dist_m,walk_min} by planar distance.

    ``stations`` needs station_id, name, latitude, longitude.
    """
    st = stations.withColumnRenamed("name", "nearest_transit_name")
    near = knn(df, st, 1, id_col, "station_id", carry=("nearest_transit_name",))
    dist = round_even("dist")
    near = near.select(F.col(id_col), F.col("station_id").alias("nearest_transit_id"),
                       "nearest_transit_name", dist.alias("nearest_transit_dist_m"),
                       round_even(dist / F.lit(WALK_M_PER_MIN), 1).alias("nearest_transit_walk_min"))
    return df.join(near, id_col, "left")


def p99_score(df: DataFrame, n_col: str, out: str) -> DataFrame:
    """1 - n/p99 clipped to [0, 1], 3 decimals; a zero p99 counts as 1.

    The exact percentile runs on the histogram of counts (few distinct
    values), and comes back as a scalar subquery rather than a join.
    """
    hist = df.groupBy(F.col(n_col).alias("_v")).agg(F.count(F.lit(1)).alias("_f"))
    p99 = hist.agg(F.percentile("_v", 0.99, F.col("_f")).alias("_p")).select(
        F.when(F.col("_p") == 0, F.lit(1.0)).otherwise(F.col("_p")).alias("_p")).scalar()
    return df.withColumn(out, round_even(clip01(F.lit(1.0) - F.col(n_col) / p99), 3))


def near_count_score(df: DataFrame, points: DataFrame, n_col: str, out: str,
                     id_col="resource_id", radius=500.0) -> DataFrame:
    """Count points near each row, then score the count against its p99.

    The counts are written once, since the percentile and the score both read
    them.
    """
    places = df.select(id_col, "latitude", "longitude")
    counts = materialise(radius_count(places, points, radius, id_col, out=n_col)
                         .select(id_col, n_col), n_col)
    return df.join(p99_score(counts, n_col, out), id_col, "left")


def build_mart(resources, stations, incidents, complaints, order, key, group=()) -> DataFrame:
    """Each expensive step is written once to the shared folder and reused."""
    mart = materialise(normalize(resources, order, key, group), "resources")
    scored = near_count_score(mart, incidents, "n_nypd_500m", "safety_score")
    scored = near_count_score(scored, complaints, "n_311_500m", "quality_score")
    near = nearest_station(mart.select("resource_id", "latitude", "longitude"), stations)
    mart = scored.join(near.drop("latitude", "longitude"), "resource_id", "left")
    for c in ("capacity", "total_units"):
        if c in mart.columns:
            mart = mart.withColumn(c, to_number(c))
    return mart


def value_counts(df: DataFrame, col: str, out="n") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), col)
