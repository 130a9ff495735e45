"""Travel estimates and advice over a trip table."""

from pyspark.sql import functions as F

from ..functions.numeric import round_even
from ..operators import travel as T
from .registry import Views, ctes, miles, query, r_even

D = "CAST({} AS DOUBLE)".format


def near_sql(name, end, table, tid, where="true", k=1):
    d = miles(f"t.{end}_lat", f"t.{end}_lon", "s.latitude", "s.longitude")
    return (name, f"""SELECT * FROM (SELECT t.trip_id, s.*, {d} AS d, row_number() OVER (PARTITION BY t.trip_id ORDER BY {d}, s.{tid}) AS rank
        FROM trips t, {table} s WHERE {where}) WHERE rank <= {k}""")


TRIP = miles("from_lat", "from_lon", "to_lat", "to_lon")
RIDE = f"greatest({miles('o.latitude', 'o.longitude', 'd.latitude', 'd.longitude')} / {D(20)} * {D(60)}, {D(3)})"
TRANSIT = [near_sql("o", "from", "stations", "station_id"), near_sql("d", "to", "stations", "station_id"),
    ("transit", f"""SELECT trip_id, {r_even(TRIP, 2)} AS distance_miles, o.name AS origin_station, d.name AS dest_station,
        o.subway_lines AS origin_lines, d.subway_lines AS dest_lines, {r_even(f'o.d * {D(20)}', 1)} AS walk_to_min,
        {r_even(RIDE, 1)} AS ride_min, {r_even(f'd.d * {D(20)}', 1)} AS walk_from_min,
        CAST({r_even(f'o.d * {D(20)} + {RIDE} + d.d * {D(20)}')} AS INT) AS duration_min, {D(2.9)} AS cost
        FROM trips JOIN o USING (trip_id) JOIN d USING (trip_id)""")]


@query("transit_estimate", ctes("trips", "stations", *TRANSIT, body="SELECT * FROM transit"))
def transit_estimate(spark, sf_dir):
    v = Views(spark, sf_dir)
    return T.transit_estimate(v.trips, v.stations)


@query("alt_stations", ctes("trips", "stations", near_sql("three", "from", "stations", "station_id", k=3), body=f"""
    SELECT a.trip_id, CAST(a.rank AS INT) AS rank, a.name, a.subway_lines AS lines, {r_even(f'a.d * {D(20)}', 1)} AS walk_min
    FROM three a JOIN three c ON a.trip_id = c.trip_id AND c.rank = 1 WHERE a.rank > 1 AND a.name <> c.name"""))
def alt_stations(spark, sf_dir):
    v = Views(spark, sf_dir)
    return T.alt_stations(v.trips, v.stations)


@query("fallback_estimate", ctes("trips", body=f"""
    SELECT trip_id, {r_even(TRIP, 2)} AS distance_miles, CAST({r_even(f'{TRIP} * {D(3)} + {D(10)}')} AS INT) AS duration_min,
           CAST({r_even(f'{TRIP} * {D(2)}')} AS INT) AS ride_min, {D(2.9)} AS cost FROM trips"""))
def fallback_estimate(spark, sf_dir):
    return T.fallback_estimate(Views(spark, sf_dir).trips)


HRA = near_sql("hra", "from", "mart", "resource_id", "s.resource_type = 'benefits_center'")


@query("nearest_benefits", ctes("trips", "mart", HRA, body=f"""
    SELECT trip_id, resource_id, name, address, {r_even('d', 2)} AS distance_miles FROM hra"""))
def nearest_benefits(spark, sf_dir):
    v = Views(spark, sf_dir)
    return T.nearest_benefits(v.trips, v.mart)


@query("travel_advice", ctes("trips", "stations", "mart", *TRANSIT, HRA, body=f"""
    , t AS (SELECT t.*, {TRIP} AS d, x.duration_min AS tm, h.name AS hra, coalesce(t.budget < {D(2.9)}, false) AS short
            FROM trips t LEFT JOIN transit x USING (trip_id) LEFT JOIN hra h USING (trip_id))
    SELECT trip_id, {r_even('d', 2)} AS distance_miles, CAST({r_even(f'd * {D(20)}')} AS INT) AS walk_min, {D(0)} AS walk_cost,
           CASE WHEN d > 0.5 THEN tm END AS transit_min, CASE WHEN d > 0.5 THEN {D(2.9)} END AS transit_cost,
           CASE WHEN short AND d > 1.5 AND hra IS NOT NULL THEN 'walk_long_get_fare' WHEN short AND d > 1.5 THEN 'walk_long'
                WHEN short THEN 'walk_only' WHEN d < 0.5 THEN 'short_walk' WHEN d < 2 THEN 'walk_or_transit' ELSE 'transit' END AS advice,
           CASE WHEN short AND d > 1.5 THEN hra END AS free_fare_at FROM t"""))
def travel_advice(spark, sf_dir):
    v = Views(spark, sf_dir)
    return T.travel_advice(v.trips, T.transit_estimate(v.trips, v.stations), T.nearest_benefits(v.trips, v.mart))


SKIP = ("(lower(trim(name)) IN ('', 'ramp', 'off ramp', 'on ramp', 'link') OR contains(lower(name), 'expressway') "
        "OR contains(lower(name), 'interstate') OR contains(lower(name), 'highway') OR contains(lower(name), 'turnpike') "
        "OR contains(lower(name), 'parkway ramp'))")
VERB = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.STEP_VERBS.items()) + " ELSE 'Continue on' END"


MERGED = f"""
    , s AS (SELECT *, {SKIP} AS skip FROM walk_steps WHERE distance_m >= 50 OR type = 'arrive'),
    g AS (SELECT *, count(*) FILTER (NOT skip) OVER (PARTITION BY route_id ORDER BY step_no, name, type, distance_m, duration_s ROWS UNBOUNDED PRECEDING) AS grp FROM s),
    m AS (SELECT route_id, grp, max(concat({VERB}, ' ', trim(name))) FILTER (NOT skip) AS instruction,
                 CAST(sum({r_even('distance_m * CAST(3.281 AS DOUBLE)')}) AS BIGINT) AS distance_ft,
                 {r_even(f"sum(CASE WHEN skip THEN {r_even('duration_s / CAST(60 AS DOUBLE)', 1)} ELSE {r_even('distance_m / CAST(1609.34 AS DOUBLE) * CAST(20 AS DOUBLE)')} END)", 6)} AS duration_min
          FROM g WHERE grp > 0 GROUP BY 1, 2),
    r AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n,
                 row_number() OVER (PARTITION BY route_id ORDER BY distance_ft DESC, grp) AS far FROM m)"""


def merged_steps(spark, sf_dir, most=None):
    steps = Views(spark, sf_dir).walk_steps
    one = F.struct("step_no", "name", "type", "distance_m", "duration_s")
    routes = steps.groupBy("route_id").agg(F.array_sort(F.collect_list(one)).alias("steps"))
    out = T.merge_steps(routes, most=most).select("route_id", F.posexplode("merged").alias("position", "m"))
    return out.select("route_id", "position", "m.instruction", "m.distance_ft",
                      round_even("m.duration_min", 6).alias("duration_min"))


@query("merge_steps", ctes("walk_steps", body=MERGED + """
    SELECT route_id, CAST(grp - 1 AS INT) AS position, instruction, distance_ft, duration_min FROM r"""))
def merge_steps(spark, sf_dir):
    return merged_steps(spark, sf_dir)


@query("merge_steps_longest", ctes("walk_steps", body=MERGED + """
    SELECT route_id, CAST(CASE WHEN n > 8 THEN row_number() OVER (PARTITION BY route_id ORDER BY duration_min, far)
                          ELSE grp END - 1 AS INT) AS position, instruction, distance_ft, duration_min
    FROM r WHERE n <= 8 OR far <= 8"""))
def merge_steps_longest(spark, sf_dir):
    return merged_steps(spark, sf_dir, T.MOST_STEPS)
