"""Ranked lookup, allocation and what-if queries over the mart."""

from pyspark.sql import functions as F

from ..functions.numeric import round_even
from ..operators import lookup as L
from .registry import Views, ctes, miles, planar2, query, r_even

D = "CAST({} AS DOUBLE)".format


def sql_list(vs):
    return "(" + ", ".join(f"'{v}'" for v in vs) + ")"


# (type, expanded types) as a SQL table
EXPAND = ("expand", " UNION ALL ".join(
    f"SELECT '{k}' AS cat, '{t}' AS t" for k, ts in L.TYPE_EXPANSION.items() for t in ts))
CENTROID = ("centroid", " UNION ALL ".join(
    f"SELECT '{b}' AS borough, {D(la)} AS c_lat, {D(lo)} AS c_lon, {i} AS i"
    for i, (b, (la, lo)) in enumerate(L.BOROUGH_CENTROIDS.items())))
POP = ("pop", " UNION ALL ".join(f"SELECT '{b}' AS borough, {n} AS p" for b, n in L.POPULATION.items()))

# What each customer asks for: one to three categories.
WANT_LISTS = ["'Medical'", "'housing', 'shelter'", "'food', 'food_bank', 'benefits'", "'legal', 'hospital'",
              "' Education '", "'unheard_of', 'documents'"]


def wants(spark, sf_dir):
    lists = [f"array({x})" for x in WANT_LISTS]
    case = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(lists))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        "c_custkey AS request_id", f"CASE c_custkey % 6 {case} END AS types")


WANTS_SQL = ("wants", "SELECT c_custkey AS request_id, CASE c_custkey % 6 "
             + " ".join(f"WHEN {i} THEN [{x}]" for i, x in enumerate(WANT_LISTS)) + " END AS types FROM customer")
WANTED = ("wanted", """
    SELECT DISTINCT request_id, coalesce(e.t, u.raw) AS t
    FROM (SELECT request_id, unnest(types) AS raw FROM wants) u LEFT JOIN expand e ON e.cat = lower(trim(u.raw))""")


@query("expand_types", ctes(WANTS_SQL, EXPAND, WANTED, body="SELECT request_id, t AS resource_type FROM wanted"))
def expand_types(spark, sf_dir):
    return wants(spark, sf_dir).select("request_id", F.explode(L.expand_types("types")).alias("resource_type"))


def place_sql(lat, lon):
    whens = " ".join(f"WHEN {c.format(lat=lat, lon=lon)} THEN '{b}'" for c, b in L.BOROUGH_BOXES)
    near = f"""(SELECT borough FROM centroid ORDER BY ({lat} - c_lat) * ({lat} - c_lat) + ({lon} - c_lon) * ({lon} - c_lon), i LIMIT 1)"""
    return f"CASE {whens} ELSE {near} END"


@query("borough_from_point", ctes("complaints", CENTROID, body=f"""
    SELECT complaint_id, latitude, longitude, {place_sql('latitude', 'longitude')} AS borough FROM complaints"""))
def borough_from_point(spark, sf_dir):
    return Views(spark, sf_dir).complaints.select(
        "complaint_id", "latitude", "longitude", L.borough_from_point().alias("borough"))


HERE = (40.6501, -73.9496)
HERE_SQL = (D(HERE[0]), D(HERE[1]))


@query("haversine_sort", ctes("mart", body=f"""
    SELECT resource_id, {r_even(miles(*HERE_SQL, 'latitude', 'longitude'), 6)} AS distance_miles,
           CAST({r_even(miles(*HERE_SQL, 'latitude', 'longitude') + ' * ' + D(20))} AS INT) AS walk_min_est FROM mart"""))
def haversine_sort(spark, sf_dir):
    return L.sort_by_distance(Views(spark, sf_dir).mart, *HERE).select(
        "resource_id", round_even("distance_miles", 6).alias("distance_miles"), "walk_min_est")


REPORTED = ("reported", """
    SELECT DISTINCT concat('Customer#', lpad(CAST(event_id % 700 AS VARCHAR), 9, '0')) AS name
    FROM case_events WHERE action = 'checkin_no'""")


def reported(v):
    return (v.case_events.where("action = 'checkin_no'")
            .selectExpr("concat('Customer#', lpad(CAST(event_id % 700 AS STRING), 9, '0')) AS name"))


@query("exclude_reported", ctes("mart", "case_events", REPORTED, body="""
    SELECT resource_id, name FROM mart WHERE name NOT IN (SELECT name FROM reported)"""))
def exclude_reported(spark, sf_dir):
    v = Views(spark, sf_dir)
    return L.exclude_reported(v.mart, reported(v)).select("resource_id", "name")


@query("soft_filter", ctes("mart", body="""
    SELECT resource_id, resource_type, borough FROM mart m
    WHERE (ada_accessible AND capacity > 190) OR NOT EXISTS (
        SELECT 1 FROM mart n WHERE n.resource_type = m.resource_type AND n.borough = m.borough
        AND n.ada_accessible AND n.capacity > 190)"""))
def soft_filter(spark, sf_dir):
    df = Views(spark, sf_dir).mart
    match = F.col("ada_accessible") & (F.col("capacity") > 190)
    return L.soft_filter(df, ["resource_type", "borough"], match).select("resource_id", "resource_type", "borough")


@query("ranked_lookup", ctes("mart", "case_events", REPORTED, body="""
    , pool AS (SELECT * FROM mart WHERE resource_type IN ('hospital', 'clinic', 'mental_health') AND borough = 'BK'
               AND name NOT IN (SELECT name FROM reported))
    SELECT resource_id, name, borough, safety_score, quality_score FROM pool
    WHERE ada_accessible OR NOT (SELECT bool_or(ada_accessible) FROM pool)
    ORDER BY safety_score DESC, quality_score DESC, resource_id LIMIT 5"""))
def ranked_lookup(spark, sf_dir):
    v = Views(spark, sf_dir)
    return L.ranked_lookup(v.mart, ["medical"], borough="Brooklyn", ada=True, reported=reported(v)).select(
        "resource_id", "name", "borough", "safety_score", "quality_score")


@query("ranked_lookup_near", ctes("mart", body=f"""
    , pool AS (SELECT *, {miles(*HERE_SQL, 'latitude', 'longitude')} AS d FROM mart WHERE resource_type = 'food_bank'),
    local AS (SELECT * FROM pool WHERE borough = 'BK' OR NOT (SELECT bool_or(borough = 'BK') FROM pool))
    SELECT resource_id, borough, {r_even('d', 6)} AS distance_miles FROM local ORDER BY d, resource_id LIMIT 5"""))
def ranked_lookup_near(spark, sf_dir):
    return L.ranked_lookup(Views(spark, sf_dir).mart, ["food"], lat=HERE[0], lon=HERE[1]).select(
        "resource_id", "borough", round_even("distance_miles", 6).alias("distance_miles"))


# Searches: every request asks for its categories, some from a landmark.
SPOTS = [(40.6501, -73.9496), (40.8116, -73.9465), (40.7028, -73.7890)]
SEARCH_SELECT = f"""request_id AS search_id, types,
    CASE request_id % 7 WHEN 0 THEN 'Brooklyn' WHEN 1 THEN 'midtown' WHEN 2 THEN 'the bronx' WHEN 3 THEN ''
         WHEN 4 THEN 'QN' ELSE CAST(NULL AS STRING) END AS borough,
    request_id % 4 = 0 AS ada, CAST(3 + request_id % 3 AS INT) AS top,
    CASE request_id % 5 WHEN 1 THEN {D(SPOTS[0][0])} WHEN 2 THEN {D(SPOTS[1][0])} WHEN 3 THEN {D(SPOTS[2][0])} END AS lat,
    CASE request_id % 5 WHEN 1 THEN {D(SPOTS[0][1])} WHEN 2 THEN {D(SPOTS[1][1])} WHEN 3 THEN {D(SPOTS[2][1])} END AS lon"""
LOOKUP_CASE = "CASE lower(trim(borough)) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in L.LOOKUP_BOROUGHS.items()) + " ELSE substring(upper(trim(borough)), 1, 2) END"
# Distinct questions first: the check would otherwise rank the mart per request.
BATCHED = [EXPAND, CENTROID, WANTS_SQL, ("searches", f"SELECT {SEARCH_SELECT.replace('AS STRING', 'AS VARCHAR')} FROM wants"),
    ("asks", "SELECT DISTINCT types, borough, ada, top, lat, lon FROM searches"),
    ("asked", f"""SELECT *, row_number() OVER () AS a, CASE WHEN lat IS NOT NULL THEN {place_sql('lat', 'lon')}
                  WHEN borough = '' OR borough IS NULL THEN NULL ELSE {LOOKUP_CASE} END AS place FROM asks"""),
    ("asktype", """SELECT DISTINCT a, coalesce(e.t, u.raw) AS t FROM (SELECT a, unnest(types) AS raw FROM asked) u
                   LEFT JOIN expand e ON e.cat = lower(trim(u.raw))"""),
    ("pool1", f"""SELECT k.a, k.ada, k.top, k.lat, k.place, m.*, CASE WHEN k.lat IS NOT NULL THEN
                  {miles('k.lat', 'k.lon', 'm.latitude', 'm.longitude')} END AS d
                  FROM asked k JOIN asktype t USING (a) JOIN mart m ON m.resource_type = t.t
                  WHERE k.lat IS NOT NULL OR k.place IS NULL OR m.borough = k.place"""),
    ("pool2", """SELECT *, bool_or(borough = place) OVER (PARTITION BY a) AS anyb FROM pool1"""),
    ("pool3", """SELECT *, bool_or(ada_accessible) OVER (PARTITION BY a) AS anya FROM pool2
                 WHERE lat IS NULL OR NOT coalesce(anyb, false) OR borough = place"""),
    ("best", """SELECT *, row_number() OVER (PARTITION BY a ORDER BY d NULLS LAST, safety_score DESC, quality_score DESC, resource_id) AS rank
                FROM pool3 WHERE NOT ada OR NOT anya OR ada_accessible""")]


@query("batched_lookup", ctes("mart", *BATCHED, body=f"""
    SELECT s.search_id, b.rank, b.resource_id, {r_even('b.d', 6)} AS distance_miles, b.name
    FROM searches s JOIN asked k ON s.types = k.types AND s.borough IS NOT DISTINCT FROM k.borough AND s.ada = k.ada
         AND s.top = k.top AND s.lat IS NOT DISTINCT FROM k.lat
    JOIN best b ON b.a = k.a AND b.rank <= k.top"""))
def batched_lookup(spark, sf_dir):
    searches = spark.sql(f"SELECT {SEARCH_SELECT} FROM {{w}}", w=wants(spark, sf_dir))
    out = L.batched_lookup(searches, Views(spark, sf_dir).mart)
    return out.select("search_id", F.col("rank").cast("long").alias("rank"), "resource_id",
                      round_even("distance_miles", 6).alias("distance_miles"), "name")


@query("nearest_of_type", ctes("mart", "complaints", body=f"""
    , o AS (SELECT complaint_id, latitude, longitude, CASE complaint_id % 3 WHEN 0 THEN 'shelter'
            WHEN 1 THEN 'hospital' ELSE 'food_bank' END AS resource_type FROM complaints),
    p AS (SELECT o.complaint_id, m.resource_id, m.resource_type,
                 {planar2('m.latitude', 'm.longitude', 'o.latitude', 'o.longitude')} AS d2
          FROM o JOIN mart m USING (resource_type))
    SELECT complaint_id, resource_type, resource_id, row_number() OVER (PARTITION BY complaint_id ORDER BY d2, resource_id) AS rank,
           {r_even('sqrt(d2) / CAST(80 AS DOUBLE)', 1)} AS walk_min FROM p
    QUALIFY row_number() OVER (PARTITION BY complaint_id ORDER BY d2, resource_id) <= 3"""))
def nearest_of_type(spark, sf_dir):
    v = Views(spark, sf_dir)
    kind = F.expr("CASE complaint_id % 3 WHEN 0 THEN 'shelter' WHEN 1 THEN 'hospital' ELSE 'food_bank' END")
    origins = v.complaints.select("complaint_id", "latitude", "longitude", kind.alias("resource_type"))
    out = L.nearest_of_type(origins, v.mart, 3, "complaint_id")
    return out.select("complaint_id", "resource_type", "resource_id", F.col("rank").cast("long").alias("rank"), "walk_min")


# ---- Allocation ---------------------------------------------------------


def ranked_near(name, table, where, n, tie):
    d2 = planar2("m.latitude", "m.longitude", "c.c_lat", "c.c_lon")
    return (name, f"""SELECT m.*, {d2} AS d2, row_number() OVER (PARTITION BY borough ORDER BY {d2}, {tie}) AS rank
        FROM {table} m JOIN centroid c USING (borough) WHERE {where}
        QUALIFY row_number() OVER (PARTITION BY borough ORDER BY {d2}, {tie}) <= {n}""")


NEAR8 = ranked_near("near8", "mart", "resource_type = 'shelter'", 8, "resource_id")
SHARE = ("CAST(floor({p} / count(*) OVER (PARTITION BY {g})) + CASE WHEN rank <= {p} % count(*) OVER (PARTITION BY {g}) "
         "THEN 1 ELSE 0 END AS INT)")


def near8(v):
    return L.near_centroid(v.mart.where("resource_type = 'shelter'"), 8)


@query("cost_matrix", ctes("mart", CENTROID, NEAR8, body=f"""
    , nodes AS (SELECT borough, rank, latitude, longitude FROM near8 UNION ALL
                SELECT borough, 0, c_lat, c_lon FROM centroid WHERE borough IN (SELECT borough FROM near8))
    SELECT a.borough, CAST(a.rank AS INT) AS i, CAST(b.rank AS INT) AS j,
           {r_even('sqrt(' + planar2('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude') + ') / CAST(80 AS DOUBLE)', 1)} AS minutes
    FROM nodes a JOIN nodes b USING (borough)"""))
def cost_matrix(spark, sf_dir):
    return L.cost_matrix(near8(Views(spark, sf_dir)))


@query("even_allocation", ctes("mart", CENTROID, NEAR8, body=f"""
    SELECT borough, CAST(rank AS INT) AS rank, resource_id, {SHARE.format(p=200, g='borough')} AS assigned_people FROM near8"""))
def even_allocation(spark, sf_dir):
    return L.even_allocation(near8(Views(spark, sf_dir)), 200).select("borough", "rank", "resource_id", "assigned_people")


LOTS_FLAG = ("flagged", """SELECT *, CASE WHEN length(landuse_raw) < 2 THEN lpad(landuse_raw, 2, '0') ELSE landuse_raw END AS landuse,
    landuse IN ('08', '09', '12') AS is_overflow_candidate FROM lots""")


def lots(v):
    from ..functions.numeric import zero_pad
    from ..operators.clean import candidate_flag
    return v.lots.withColumn("landuse", zero_pad("landuse_raw")).withColumn("is_overflow_candidate", candidate_flag())


@query("emergency_plan", ctes("mart", "lots", CENTROID, LOTS_FLAG, NEAR8,
        ranked_near("over5", "flagged", "is_overflow_candidate", 5, "bbl"),
        ranked_near("food3", "mart", "resource_type = 'food_bank'", 3, "resource_id"), body=f"""
    SELECT borough, 'shelter' AS role, CAST(rank AS INT) AS rank, resource_id AS id, name AS detail,
           {r_even('sqrt(d2)', 1)} AS dist_m, {SHARE.format(p=200, g='borough')} AS assigned_people FROM near8
    UNION ALL SELECT borough, 'overflow', rank, CAST(bbl AS VARCHAR), ownername, {r_even('sqrt(d2)', 1)}, NULL FROM over5
    UNION ALL SELECT borough, 'food', rank, resource_id, name, {r_even('sqrt(d2)', 1)}, NULL FROM food3"""))
def emergency_plan(spark, sf_dir):
    v = Views(spark, sf_dir)
    return L.emergency_plan(v.mart, lots(v))


def cover(n):
    return r_even(f"{n} / pop_estimate * {D(100000)}", 1)


@query("capacity_what_if", ctes("mart", POP, body=f"""
    , s AS (SELECT * FROM mart WHERE resource_type = 'shelter'),
    e AS (SELECT floor(500 / greatest(count(*) FILTER (borough = 'BK'), 1)) AS each FROM s),
    g AS (SELECT borough, count(*) AS sites_before, count(*) AS sites_after, coalesce(sum(capacity), 0) AS beds_before,
          coalesce(sum(CASE WHEN borough = 'BK' THEN coalesce(capacity, 0) + each ELSE capacity END), 0) AS beds_after
          FROM s, e WHERE borough IS NOT NULL GROUP BY 1),
    h AS (SELECT g.*, coalesce(p, 500000) AS pop_estimate FROM g LEFT JOIN pop USING (borough))
    SELECT *, {cover('sites_before')} AS coverage_per_100k_before, {cover('sites_after')} AS coverage_per_100k_after,
           {cover('beds_before')} AS beds_per_100k_before, {cover('beds_after')} AS beds_per_100k_after,
           {r_even(cover('sites_after') + ' - ' + cover('sites_before'), 2)} AS improvement FROM h"""))
def capacity_what_if(spark, sf_dir):
    return L.capacity_what_if(Views(spark, sf_dir).mart, "BK", 500)


@query("intake_allocation", ctes("mart", body=f"""
    , m AS (SELECT *, CAST((CASE WHEN contains(lower(coalesce(languages_spoken, '')), 'spanish') THEN 1 ELSE 0 END
            + CASE WHEN contains(lower(coalesce(languages_spoken, '')), 'chinese') THEN 1 ELSE 0 END) AS INT) AS lang_match
            FROM mart WHERE resource_type IN ('shelter', 'food_bank', 'school')),
    t AS (SELECT *, row_number() OVER (PARTITION BY resource_type ORDER BY lang_match DESC, safety_score DESC, resource_id) AS rank
          FROM m QUALIFY rank <= 5)
    SELECT resource_type, CAST(rank AS INT) AS rank, resource_id, lang_match,
           CASE WHEN resource_type = 'shelter' THEN {SHARE.format(p=80, g='resource_type')} END AS assigned_people,
           count(languages_spoken) OVER (PARTITION BY resource_type) AS language_sites FROM t"""))
def intake_allocation(spark, sf_dir):
    df = L.intake_allocation(Views(spark, sf_dir).mart, 80, ["Spanish", "Chinese"], ["shelter", "food_bank", "school"])
    return df.select("resource_type", "rank", "resource_id", "lang_match", "assigned_people", "language_sites")


@query("resource_gap", ctes("mart", POP, body=f"""
    , g AS (SELECT borough, count(*) AS resource_count, coalesce(any_value(p), 500000) AS pop_estimate
            FROM mart LEFT JOIN pop USING (borough)
            WHERE resource_type IN ('shelter', 'food_bank', 'hospital') AND borough IS NOT NULL GROUP BY 1),
    r AS (SELECT *, {cover('resource_count')} AS resources_per_100k FROM g)
    SELECT *, (SELECT borough FROM r ORDER BY resources_per_100k, borough LIMIT 1) AS most_underserved FROM r"""))
def resource_gap(spark, sf_dir):
    return L.resource_gap(Views(spark, sf_dir).mart)


@query("mart_status", ctes("mart", body="""
    SELECT resource_type, count(*) AS n FROM mart GROUP BY 1 UNION ALL SELECT 'ALL', count(*) FROM mart"""))
def mart_status(spark, sf_dir):
    return L.mart_status(Views(spark, sf_dir).mart)


COLOUR = "CASE resource_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.MAP_COLOURS.items()) + " ELSE '200,200,200,200' END"
MAP_SQL = f"""SELECT resource_id, resource_type, name, address, borough, latitude, longitude, safety_score, {COLOUR} AS color
    FROM mart WHERE latitude IS NOT NULL AND longitude IS NOT NULL"""


@query("map_rows", ctes("mart", body=MAP_SQL))
def map_rows(spark, sf_dir):
    return L.map_rows(Views(spark, sf_dir).mart)


@query("map_first_view", ctes("mart", body=MAP_SQL + " ORDER BY resource_id LIMIT 2000"))
def map_first_view(spark, sf_dir):
    return L.map_rows(Views(spark, sf_dir).mart, limit=2000)


@query("map_centre", ctes("mart", ("rows_", MAP_SQL), body=f"""
    SELECT {r_even('avg(latitude)', 6)} AS lat, {r_even('avg(longitude)', 6)} AS lon FROM rows_"""))
def map_centre(spark, sf_dir):
    return L.map_centre(L.map_rows(Views(spark, sf_dir).mart))


TEXTS = """SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN concat('00', CAST(user_id AS {s})) WHEN 1 THEN concat('CUSTOMER#', '00000', CAST(user_id AS {s}))
    WHEN 2 THEN concat('r', '#') ELSE concat(CAST(user_id % 10 AS {s}), '9') END AS query FROM {t}"""


@query("name_lookup", ctes("mart", ("texts", TEXTS.format(s="VARCHAR", t="events")), body="""
    SELECT query, min(resource_id) AS resource_id, arg_min(name, resource_id) AS name,
           arg_min(resource_type, resource_id) AS resource_type, arg_min(address, resource_id) AS address
    FROM texts JOIN mart ON contains(lower(name), lower(query)) GROUP BY 1"""))
def name_lookup(spark, sf_dir):
    texts = spark.sql(TEXTS.format(s="STRING", t="{ev}"), ev=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return L.name_lookup(texts, Views(spark, sf_dir).mart)
