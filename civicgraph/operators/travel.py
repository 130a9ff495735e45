"""Travel estimates between points, set at a time over trip tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import haversine_miles, round_even
from ..functions.text import any_word, in_set, lookup
from .spatial import knn

# ---- Fixed values -------------------------------------------------------

FARE = 2.90
WALK_MIN_PER_MILE = 20.0
TRAIN_MPH = 20.0
MIN_RIDE_MIN = 3.0
SKIP_STEP_NAMES = ["", "ramp", "off ramp", "on ramp", "link"]
SKIP_STEP_WORDS = ["expressway", "interstate", "highway", "turnpike", "parkway ramp"]
STEP_VERBS = {
    "depart": "Head", "turn": "Turn onto", "new name": "Continue on",
    "arrive": "Arrive at", "merge": "Continue on", "end of road": "At end of road, go to",
    "fork": "Keep on", "roundabout": "Take roundabout to",
}
DEFAULT_VERB = "Continue on"
FEET_PER_M, M_PER_MILE = 3.281, 1609.34
SHORTEST_STEP_M, MOST_STEPS = 50, 8


def trip_miles():
    return haversine_miles("from_lat", "from_lon", "to_lat", "to_lon")


def _end(trips, which):
    return trips.select("trip_id", F.col(f"{which}_lat").alias("latitude"), F.col(f"{which}_lon").alias("longitude"))


def _stations(stations):
    return stations.select("station_id", F.col("name").alias("st_name"), F.col("subway_lines").alias("st_lines"),
                           F.col("latitude").alias("st_lat"), F.col("longitude").alias("st_lon"),
                           "latitude", "longitude")


CARRY = ("st_name", "st_lines", "st_lat", "st_lon")


def near_stations(trips: DataFrame, stations: DataFrame, k, which="from") -> DataFrame:
    """k nearest stations to one end of each trip, by great-circle miles."""
    return knn(_end(trips, which), _stations(stations), k, "trip_id", "station_id",
               carry=CARRY, metric="miles")


def transit_estimate(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Walk, ride, walk: minutes and fare between the nearest stations."""
    o = near_stations(trips, stations, 1, "from").select(
        "trip_id", F.col("dist").alias("_wo"), F.col("st_name").alias("origin_station"),
        F.col("st_lines").alias("origin_lines"), F.col("st_lat").alias("_ola"), F.col("st_lon").alias("_olo"))
    d = near_stations(trips, stations, 1, "to").select(
        "trip_id", F.col("dist").alias("_wd"), F.col("st_name").alias("dest_station"),
        F.col("st_lines").alias("dest_lines"), F.col("st_lat").alias("_dla"), F.col("st_lon").alias("_dlo"))
    walk_to = F.col("_wo") * F.lit(WALK_MIN_PER_MILE)
    walk_from = F.col("_wd") * F.lit(WALK_MIN_PER_MILE)
    ride = F.greatest(haversine_miles("_ola", "_olo", "_dla", "_dlo") / F.lit(TRAIN_MPH) * F.lit(60.0),
                      F.lit(MIN_RIDE_MIN))
    return trips.join(o, "trip_id").join(d, "trip_id").select(
        "trip_id", round_even(trip_miles(), 2).alias("distance_miles"), "origin_station", "dest_station",
        "origin_lines", "dest_lines", round_even(walk_to, 1).alias("walk_to_min"), round_even(ride, 1).alias("ride_min"),
        round_even(walk_from, 1).alias("walk_from_min"),
        round_even(walk_to + ride + walk_from).cast("int").alias("duration_min"), F.lit(FARE).alias("cost"))


def alt_stations(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Of the three nearest origin stations, up to two not named as the first."""
    three = near_stations(trips, stations, 3)
    chosen = three.where("rank = 1").select("trip_id", F.col("st_name").alias("_chosen"))
    rest = three.join(chosen, "trip_id").where("rank > 1 AND length(st_name) > 0 AND st_name <> _chosen")
    return rest.select("trip_id", "rank", F.col("st_name").alias("name"), F.col("st_lines").alias("lines"),
                       round_even(F.col("dist") * F.lit(WALK_MIN_PER_MILE), 1).alias("walk_min"))


def fallback_estimate(trips: DataFrame) -> DataFrame:
    """Distance-only estimate for when no stations are known."""
    d = trip_miles()
    return trips.select("trip_id", round_even(d, 2).alias("distance_miles"),
                        round_even(d * F.lit(3.0) + F.lit(10.0)).cast("int").alias("duration_min"),
                        round_even(d * F.lit(2.0)).cast("int").alias("ride_min"), F.lit(FARE).alias("cost"))


def nearest_benefits(trips: DataFrame, mart: DataFrame) -> DataFrame:
    """Nearest benefits centre to each trip's start."""
    centres = mart.where(F.col("resource_type") == "benefits_center").withColumn("hra_name", F.col("name"))
    near = knn(_end(trips, "from"), centres, 1, "trip_id", "resource_id", carry=("hra_name", "address"), metric="miles")
    return near.select("trip_id", "resource_id", F.col("hra_name").alias("name"), "address",
                       round_even("dist", 2).alias("distance_miles"))


def travel_advice(trips: DataFrame, transit: DataFrame, benefits: DataFrame) -> DataFrame:
    """Options and one piece of advice per trip, by distance and budget."""
    t = transit.select("trip_id", F.col("duration_min").alias("transit_min"))
    b = benefits.select("trip_id", F.col("name").alias("_hra"))
    d = trip_miles()
    df = trips.withColumn("_d", d).join(t, "trip_id", "left").join(b, "trip_id", "left")
    short = F.col("budget").isNotNull() & (F.col("budget") < FARE)
    long_walk = F.col("_d") > 1.5
    advice = (F.when(short & long_walk & F.col("_hra").isNotNull(), "walk_long_get_fare")
              .when(short & long_walk, "walk_long").when(short, "walk_only")
              .when(F.col("_d") < 0.5, "short_walk").when(F.col("_d") < 2, "walk_or_transit")
              .otherwise("transit"))
    ride = F.when(F.col("_d") > 0.5, F.col("transit_min"))
    return df.select(
        "trip_id", round_even("_d", 2).alias("distance_miles"),
        round_even(F.col("_d") * F.lit(WALK_MIN_PER_MILE)).cast("int").alias("walk_min"),
        F.lit(0.0).alias("walk_cost"), ride.alias("transit_min"),
        F.when(F.col("_d") > 0.5, F.lit(FARE)).alias("transit_cost"), advice.alias("advice"),
        F.when(short & long_walk, F.col("_hra")).alias("free_fare_at"))


def merge_steps(routes: DataFrame, steps="steps", most=None) -> DataFrame:
    """Fold an array of walk steps into the few that matter.

    ``steps``: array<struct<name, type, distance_m, duration_s>> in walking
    order, one route per row. Tiny steps go, unnamed and highway steps add to
    the step before. With ``most``, only that many of the longest stay.
    """
    name = "lower(trim(s.name))"
    skip = f"({in_set(name, SKIP_STEP_NAMES)} OR {any_word(name, SKIP_STEP_WORDS)})"
    feet = f"CAST(rint(s.distance_m * {FEET_PER_M}D) AS BIGINT)"
    verb = lookup("s.type", STEP_VERBS, f"'{DEFAULT_VERB}'")
    fresh = f"""array(named_struct('instruction', concat({verb}, ' ', trim(s.name)), 'distance_ft', {feet},
        'duration_min', rint(s.distance_m / {M_PER_MILE}D * 20D)))"""
    last = "element_at(acc, -1)"
    grown = f"""concat(slice(acc, 1, size(acc) - 1), array(named_struct('instruction', {last}.instruction,
        'distance_ft', {last}.distance_ft + {feet},
        'duration_min', rint(({last}.duration_min + rint(s.duration_s / 60D * 10D) / 10D) * 1000000D) / 1000000D)))"""
    fold = f"""aggregate(filter({steps}, s -> s.distance_m >= {SHORTEST_STEP_M} OR s.type = 'arrive'),
        CAST(array() AS array<struct<instruction: string, distance_ft: bigint, duration_min: double>>),
        (acc, s) -> CASE WHEN {skip} THEN CASE WHEN size(acc) > 0 THEN {grown} ELSE acc END
                         ELSE concat(acc, {fresh}) END)"""
    if not most:
        return routes.withColumn("merged", F.expr(fold))
    routes = routes.withColumn("_m", F.expr(fold))
    tagged = "transform(_m, (x, i) -> named_struct('f', -x.distance_ft, 'i', i, 'x', x))"
    best = f"slice(array_sort({tagged}), 1, {most})"
    by_time = f"transform({best}, (r, j) -> named_struct('t', r.x.duration_min, 'j', j, 'x', r.x))"
    cut = f"transform(array_sort({by_time}), r -> r.x)"
    return routes.withColumn("merged", F.expr(f"CASE WHEN size(_m) > {most} THEN {cut} ELSE _m END")).drop("_m")
