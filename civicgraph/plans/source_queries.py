"""Landing, scans and sinks, each checked by reading back what was written."""

from pyspark.sql import functions as F

from ..functions.session import work_path
from ..sources import tables as S
from .lookup_queries import lots
from .registry import Views, ctes, query


FEEDS = """
    SELECT 'incidents' AS dataset, o_orderkey AS id, concat(o_orderpriority, '|', CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS content
    FROM orders WHERE o_orderdate > TIMESTAMP '1995-01-01' 
    UNION ALL SELECT 'complaints' AS dataset, event_id AS id, concat(event_type, '|', CAST(CAST(ts AS DATE) AS VARCHAR)) AS content FROM events WHERE event_type <> 'purchase'
    UNION ALL SELECT 'lots' AS dataset, p_partkey AS id, concat(p_name, '|', p_brand) AS content FROM part"""


def landed(spark, sf_dir, limits=(None, None, None)):
    """All three sources landed and read back, with an id and the content of every row."""
    registry = {
        "incidents": S.Dataset(f"{sf_dir}/orders.parquet", limit=limits[0], where="o_orderdate > timestamp_ntz'1995-01-01'",
                               select=("o_orderkey", "o_orderdate", "o_orderpriority"), order=("o_orderkey",)),
        "complaints": S.Dataset(f"{sf_dir}/events.parquet", limit=limits[1], where="event_type <> 'purchase'",
                                select=("event_id", "ts", "event_type"), order=("event_id",)),
        "lots": S.Dataset(f"{sf_dir}/part.parquet", limit=limits[2], order=("p_partkey",)),
    }
    content = {"incidents": ("o_orderkey AS id", "concat(o_orderpriority, '|', CAST(CAST(o_orderdate AS DATE) AS STRING)) AS content"),
               "complaints": ("event_id AS id", "concat(event_type, '|', CAST(CAST(ts AS DATE) AS STRING)) AS content"),
               "lots": ("p_partkey AS id", "concat(p_name, '|', p_brand) AS content")}
    folder = work_path(spark, "landing")
    S.land_all(spark, registry, folder)
    tables = S.land_all(spark, registry, folder)   # already there: nothing is fetched again
    parts = [df.selectExpr(f"'{n}' AS dataset", *content[n]) for n, df in tables.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("land_datasets", FEEDS)
def land_datasets(spark, sf_dir):
    return landed(spark, sf_dir)


@query("land_datasets_limited", "WITH " + ", ".join(f"f{k} AS (SELECT * FROM ({part}) ORDER BY id LIMIT {n})" for k, (part, n) in enumerate(zip(
    FEEDS.split("UNION ALL"), (500, 300, 90)))) + """
    SELECT dataset, id, content FROM f0 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2""")
def land_datasets_limited(spark, sf_dir):
    return landed(spark, sf_dir, (500, 300, 90))


@query("scan_parquet", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 100000")
def scan_parquet(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return df.where("o_totalprice > 100000").select("o_orderkey", "o_orderpriority")


@query("scan_csv", ctes("raw_stations", body="""
    SELECT Stop_Name AS name, GTFS_Latitude AS latitude, ADA AS ada FROM raw_stations"""))
def scan_csv(spark, sf_dir):
    path = work_path(spark, "stations-csv")
    raw = Views(spark, sf_dir).raw_stations
    raw.toDF(*[f" {c.replace('_', ' ')} " for c in raw.columns]).write.csv(path, header=True)
    df = S.scan_csv(spark, path)
    return df.select(F.col("Stop Name").alias("name"), F.col("GTFS Latitude").alias("latitude"), F.col("ADA").alias("ada"))


@query("sink_parquet", """
    SELECT count(*) AS n_written, count(*) AS n_read, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events""")
def sink_parquet(spark, sf_dir):
    path = work_path(spark, "sink")
    n = S.save(Views(spark, sf_dir).complaints, path)
    return spark.read.parquet(path).agg(F.lit(n).alias("n_written"), F.count(F.lit(1)).alias("n_read"),
                                        F.sum("complaint_id").alias("id_sum"))


@query("scan_case_docs", """
    SELECT concat('case_', CAST(user_id AS VARCHAR)) AS case_id, concat('Client ', CAST(user_id AS VARCHAR)) AS name,
           count(*) AS n_visits, max(event_type) AS last_query, NULL::VARCHAR AS admin_notes, 'two kids' AS notes,
           max(concat('site of ', event_type)) AS last_shown, CAST(40.5 AS DOUBLE) AS last_lat, concat('t', CAST(user_id AS VARCHAR)) AS thread_id,
           'https://example.org/t' AS thread_url, user_id % 2 = 0 AS acknowledged
    FROM events WHERE user_id % 10 <> 3 GROUP BY user_id""")
def scan_case_docs(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    visit = F.struct(F.col("event_type").alias("query"), F.lit("shown").alias("answer_summary"),
                     F.array(F.struct(F.concat(F.lit("site of "), "event_type").alias("name"), F.lit("shelter").alias("type"))).alias("resources_shown"),
                     F.struct(F.lit(40.5).alias("lat"), F.lit(-73.9).alias("lon")).alias("location"))
    intent = F.struct(F.lit("site").alias("resource_name"), F.concat(F.lit("t"), "user_id").alias("thread_id"),
                      F.lit("https://example.org/t").alias("thread_url"), (F.col("user_id") % 2 == 0).alias("acknowledged"))
    doc = F.to_json(F.struct(F.concat(F.lit("case_"), "user_id").alias("case_id"),
                             F.concat(F.lit("Client "), "user_id").alias("name"),
                             F.sort_array(F.collect_list(visit)).alias("visits"), F.lit("two kids").alias("notes"),
                             F.array(F.first(intent)).alias("destination_intents"),
                             F.lit("ignored").alias("field_of_a_later_version")))
    docs = ev.groupBy("user_id").agg(doc.alias("value"))
    # every tenth document was cut off while it was written
    broken = F.when(F.col("user_id") % 10 == 3, F.expr("substring(value, 1, length(value) - 5)")).otherwise(F.col("value"))
    path = work_path(spark, "case-docs")
    docs.select(broken.alias("value")).write.text(path)
    return S.scan_case_docs(spark, path).select(
        "case_id", "name", F.size("visits").cast("long").alias("n_visits"),
        F.element_at("visits", -1)["query"].alias("last_query"), "admin_notes", "notes",
        F.expr("visits[size(visits) - 1].resources_shown[0].name").alias("last_shown"),
        F.expr("visits[size(visits) - 1].location.lat").alias("last_lat"),
        *[F.col("destination_intents")[0][c].alias(c) for c in ("thread_id", "thread_url", "acknowledged")])


@query("union_stages", ctes("sites", "stations", "households", body="""
    SELECT CAST(site_id AS VARCHAR) AS resource_id, resource_type, name, address, borough, latitude, longitude, capacity, NULL AS subway_lines
    FROM sites WHERE resource_type = 'shelter'
    UNION ALL SELECT CAST(station_id AS VARCHAR), 'transit_station', name, NULL, borough, latitude, longitude, NULL, subway_lines FROM stations"""))
def union_stages(spark, sf_dir):
    v, folder = Views(spark, sf_dir), work_path(spark, "stage")
    S.save(v.sites.where("resource_type = 'shelter'").select(
        F.col("site_id").cast("string").alias("resource_id"), "resource_type", "name", "address", "borough",
        "latitude", "longitude", "capacity"), f"{folder}/shelters")
    S.save(v.stations.select(F.col("station_id").cast("string").alias("resource_id"),
                             F.lit("transit_station").alias("resource_type"), "name", "borough", "latitude",
                             "longitude", "subway_lines"), f"{folder}/transit_stations")
    stages = S.load_stage(spark, folder, ["shelters", "food_banks", "transit_stations"])
    return S.union_stages(stages.values())


@query("lot_layer", ctes("lots", body="""
    SELECT borough, count(*) AS n_lots, count(*) FILTER (landuse_raw IN ('8', '9', '12')) AS n_candidates
    FROM lots GROUP BY 1"""))
def lot_layer(spark, sf_dir):
    path = work_path(spark, "lots")
    S.save_lot_layer(lots(Views(spark, sf_dir)), path)
    return (spark.read.parquet(path).groupBy("borough")
            .agg(F.count(F.lit(1)).alias("n_lots"), F.count_if("is_overflow_candidate").alias("n_candidates")))


@query("graph_tables", """
    SELECT 'LINE' AS edge_type, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS dst_sum FROM lineitem WHERE l_linenumber = 2
    UNION ALL SELECT 'OTHER', count(*), CAST(sum(l_partkey) AS BIGINT) FROM lineitem WHERE l_linenumber <> 2
    UNION ALL SELECT 'ORDER', count(*), CAST(sum(o_custkey) AS BIGINT) FROM orders""")
def graph_tables(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line = read("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1.0).alias("weight"),
                                   F.when(F.col("l_linenumber") == 2, "LINE").otherwise("OTHER").alias("edge_type"))
    order = read("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.lit(1.0).alias("weight"),
                                  F.lit("ORDER").alias("edge_type"))
    nodes = read("customer").select(F.col("c_custkey").alias("node_id"), F.lit("customer").alias("node_type"))
    folder = work_path(spark, "graph")
    S.save_graph(nodes, line.unionByName(order), folder)
    _, edges = S.load_graph(spark, folder)
    return edges.groupBy("edge_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dst").alias("dst_sum"))
