"""Mart building: dedup, ids, nearest station, radius counts, scores."""

from pyspark.sql import functions as F

from ..operators import mart as M
from ..operators.spatial import radius_count
from .registry import Views, ctes, planar2, query, r_even

# Duplicate set: every site once more under another key at the same position.
DUPED = ("duped", """
    SELECT site_id, 0 AS stage_rank, resource_type, name, address, borough, latitude, longitude FROM sites
    UNION ALL
    SELECT site_id + 2, 1, resource_type, CASE WHEN site_id % 3 = 0 THEN NULL ELSE concat(' ', name, ' ') END,
           CASE WHEN site_id % 5 = 0 THEN NULL ELSE address END, borough, latitude, longitude FROM sites""")
FIRST = ("firsts", f"""
    SELECT * FROM duped WHERE latitude BETWEEN CAST(40.4 AS DOUBLE) AND CAST(40.95 AS DOUBLE)
      AND longitude BETWEEN CAST(-74.3 AS DOUBLE) AND CAST(-73.6 AS DOUBLE)
    QUALIFY row_number() OVER (PARTITION BY resource_type, {r_even('latitude', 4)}, {r_even('longitude', 4)}
                               ORDER BY stage_rank, site_id) = 1""")
REISSUED = ("reissued", """
    SELECT * REPLACE (coalesce(trim(name), 'Unknown') AS name, coalesce(trim(address), '') AS address),
           concat(substring(resource_type, 1, 8), '_', CAST(row_number() OVER (ORDER BY stage_rank, site_id) - 1 AS VARCHAR)) AS resource_id
    FROM firsts""")


def duped(v):
    s = v.sites.select("site_id", F.lit(0).alias("stage_rank"), "resource_type", "name", "address",
                       "borough", "latitude", "longitude")
    again = (s.withColumn("stage_rank", F.lit(1))
             .withColumn("name", F.when(F.col("site_id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "name", F.lit(" "))))
             .withColumn("address", F.when(F.col("site_id") % 5 != 0, F.col("address")))
             .withColumn("site_id", F.col("site_id") + 2))
    return s.unionByName(again)


ORDER = ["stage_rank", "site_id"]


@query("spatial_dedup", ctes("sites", DUPED, FIRST, body="""
    SELECT site_id, stage_rank, resource_type, latitude, longitude FROM firsts"""))
def spatial_dedup(spark, sf_dir):
    df = M.spatial_dedup(M.in_city(duped(Views(spark, sf_dir))), ORDER)
    return df.select("site_id", "stage_rank", "resource_type", "latitude", "longitude")


@query("reissue_ids", ctes("sites", DUPED, FIRST, REISSUED, body="""
    SELECT resource_id, name, address, site_id FROM reissued"""))
def reissue_ids(spark, sf_dir):
    df = M.normalize(duped(Views(spark, sf_dir)), ORDER, "site_id", ["stage_rank"])
    return df.select("resource_id", "name", "address", "site_id")


def nearest_sql(left, left_id, out="near"):
    d = planar2("st.latitude", "st.longitude", f"{left}.latitude", f"{left}.longitude")
    return (out, f"""
        SELECT {left}.{left_id}, arg_min(st.station_id, (({d}), st.station_id)) AS nearest_transit_id,
               arg_min(st.name, (({d}), st.station_id)) AS nearest_transit_name, sqrt(min({d})) AS dist_m
        FROM {left} CROSS JOIN stations st GROUP BY 1""")


@query("nearest_station", ctes("sites", "stations", nearest_sql("sites", "site_id"), body=f"""
    SELECT site_id, nearest_transit_id, nearest_transit_name,
           {r_even('dist_m')} AS nearest_transit_dist_m,
           {r_even(r_even('dist_m') + ' / CAST(80 AS DOUBLE)', 1)} AS nearest_transit_walk_min
    FROM near"""))
def nearest_station(spark, sf_dir):
    v = Views(spark, sf_dir)
    return M.nearest_station(v.sites, v.stations, "site_id").select(
        "site_id", "nearest_transit_id", "nearest_transit_name", "nearest_transit_dist_m",
        "nearest_transit_walk_min")


def within_sql(left, left_id, points, out, r=500):
    d = planar2("p.latitude", "p.longitude", f"{left}.latitude", f"{left}.longitude")
    return (out, f"""
        SELECT {left}.{left_id}, count(p.latitude) AS n FROM {left} LEFT JOIN {points} p
        ON {d} <= CAST({r * r} AS DOUBLE) GROUP BY 1""")


def score_sql(counts, key, n_col, score):
    return (f"{counts}_s", f"""
        SELECT {key}, n AS {n_col}, {r_even(f'greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) - n / p))', 3)} AS {score}
        FROM {counts}, (SELECT CASE WHEN quantile_cont(n, 0.99) = 0 THEN CAST(1 AS DOUBLE)
                               ELSE CAST(quantile_cont(n, 0.99) AS DOUBLE) END AS p FROM {counts}) q""")


@query("radius_count", ctes("sites", "incidents", within_sql("sites", "site_id", "incidents", "c"), body="""
    SELECT site_id, n FROM c"""))
def radius_count_query(spark, sf_dir):
    v = Views(spark, sf_dir)
    return radius_count(v.sites, v.incidents, 500.0, "site_id").select("site_id", "n")


@query("safety_score", ctes("sites", "incidents", within_sql("sites", "site_id", "incidents", "c"),
                            score_sql("c", "site_id", "n_nypd_500m", "safety_score"), body="""
    SELECT site_id, n_nypd_500m, safety_score FROM c_s"""))
def safety_score(spark, sf_dir):
    v = Views(spark, sf_dir)
    return M.near_count_score(v.sites, v.incidents, "n_nypd_500m", "safety_score", "site_id").select(
        "site_id", "n_nypd_500m", "safety_score")


@query("quality_score", ctes("sites", "complaints", within_sql("sites", "site_id", "complaints", "c"),
                             score_sql("c", "site_id", "n_311_500m", "quality_score"), body="""
    SELECT site_id, n_311_500m, quality_score FROM c_s"""))
def quality_score(spark, sf_dir):
    v = Views(spark, sf_dir)
    return M.near_count_score(v.sites, v.complaints, "n_311_500m", "quality_score", "site_id").select(
        "site_id", "n_311_500m", "quality_score")


@query("type_breakdown", ctes("mart", body="""
    SELECT resource_type, count(*) AS n, CAST(median(nearest_transit_walk_min) AS DOUBLE) AS median_walk_min
    FROM mart GROUP BY 1"""))
def type_breakdown(spark, sf_dir):
    return (Views(spark, sf_dir).mart.groupBy("resource_type")
            .agg(F.count(F.lit(1)).alias("n"), F.median("nearest_transit_walk_min").alias("median_walk_min"))
            .orderBy(F.desc("n"), "resource_type"))


FULL = ["sites", "stations", "incidents", "complaints", DUPED, FIRST, REISSUED,
        nearest_sql("reissued", "resource_id"),
        within_sql("reissued", "resource_id", "incidents", "c1"), score_sql("c1", "resource_id", "n_nypd_500m", "safety_score"),
        within_sql("reissued", "resource_id", "complaints", "c2"), score_sql("c2", "resource_id", "n_311_500m", "quality_score"),
        ("built", f"""
        SELECT resource_id, resource_type, name, address, borough, latitude, longitude, nearest_transit_id,
               nearest_transit_name, {r_even('dist_m')} AS nearest_transit_dist_m,
               {r_even(r_even('dist_m') + ' / CAST(80 AS DOUBLE)', 1)} AS nearest_transit_walk_min,
               n_nypd_500m, safety_score, n_311_500m, quality_score
        FROM reissued JOIN near USING (resource_id) JOIN c1_s USING (resource_id) JOIN c2_s USING (resource_id)""")]


def built_mart(v):
    mart = M.build_mart(duped(v), v.stations, v.incidents, v.complaints, ORDER, "site_id", ["stage_rank"])
    return mart.drop("site_id", "stage_rank")


@query("build_mart", ctes(*FULL, body="SELECT * FROM built"))
def build_mart(spark, sf_dir):
    return built_mart(Views(spark, sf_dir))


@query("mart_ranked", ctes(*FULL, body="""
    SELECT * FROM built WHERE resource_type = 'shelter' AND borough = 'BK'
    ORDER BY safety_score DESC, quality_score DESC, resource_id LIMIT 5"""))
def mart_ranked(spark, sf_dir):
    df = built_mart(Views(spark, sf_dir))
    return (df.where((F.col("resource_type") == "shelter") & (F.col("borough") == "BK"))
            .orderBy(F.desc("safety_score"), F.desc("quality_score"), "resource_id").limit(5))
