"""Triple store building, complaint facts, and questions over the store."""

from pyspark.sql import functions as F

from ..functions.session import materialise
from ..operators import evidence as G
from ..operators import triples as T
from ..operators.store import TripleStore
from .lookup_queries import LOTS_FLAG, lots
from .registry import Views, ctes, deg2, query, r_even

D = "CAST({} AS DOUBLE)".format


def q(s):
    return "'" + s.replace("'", "''") + "'"


def tri(subject, predicate, obj, conf, source, frm, where="true"):
    conf = D(conf) if isinstance(conf, float) else conf
    return (f"SELECT * FROM (SELECT {subject} AS subject, {predicate} AS predicate, CAST({obj} AS VARCHAR) AS object_val, "
            f"{conf} AS confidence, '{source}' AS source FROM {frm} WHERE {where}) WHERE object_val IS NOT NULL")


def union(*parts):
    return "\nUNION ALL ".join(parts)


LOC = "printf('%.6f,%.6f', latitude, longitude)"
RESOURCE = union(
    tri("resource_id", "'HAS_TYPE'", "resource_type", 0.95, "dohmh", "mart"),
    tri("resource_id", "'HAS_NAME'", "name", 1.0, "dohmh", "mart"),
    tri("resource_id", "'HAS_ADDRESS'", "address", 1.0, "dohmh", "mart"),
    tri("resource_id", "'IN_BOROUGH'", "borough", 1.0, "dohmh", "mart"),
    tri("resource_id", "'HAS_LOCATION'", LOC, 1.0, "dohmh", "mart", "latitude IS NOT NULL"),
    tri("resource_id", "'HAS_CAPACITY'", "CAST(capacity AS BIGINT)", 1.0, "dhs", "mart", "capacity > 0"),
    tri("resource_id", "'NEAREST_TRANSIT'", "nearest_transit_name", 0.8, "mta_gtfs", "mart"),
    tri("resource_id", "'TRANSIT_WALK_MIN'", r_even("nearest_transit_walk_min", 1), 0.8, "mta_gtfs", "mart"))


@query("resource_triples", ctes("mart", body=RESOURCE))
def resource_triples(spark, sf_dir):
    return T.resource_triples(Views(spark, sf_dir).mart)


def category(c, table):
    whens = " ".join(f"WHEN {c} IN ({', '.join(q(v) for v in vs)}) THEN '{k}'" for k, vs in table.items())
    return f"CASE {whens} ELSE 'other' END"


@query("crime_category", ctes("incidents", body=f"""
    SELECT incident_id, {category('ofns_desc', T.CRIME_CATEGORIES)} AS category FROM incidents"""))
def crime_category(spark, sf_dir):
    return Views(spark, sf_dir).incidents.select("incident_id", T.crime_category().alias("category"))


@query("complaint_category", ctes("complaints", body=f"""
    SELECT complaint_id, {category('complaint_type', T.COMPLAINT_CATEGORIES)} AS category FROM complaints"""))
def complaint_category(spark, sf_dir):
    return Views(spark, sf_dir).complaints.select("complaint_id", T.complaint_category().alias("category"))


R2 = f"({D(500)} / {D(111320)}) * ({D(500)} / {D(111320)})"


def near(points, cat, prefix, source):
    return tri("resource_id", f"concat('{prefix}', upper(cat), '_500M')", "n", 0.8, source, f"""
        (SELECT m.resource_id, p.cat, count(*) AS n FROM mart m JOIN (SELECT *, {cat} AS cat FROM {points}) p
         ON {deg2('p.latitude', 'p.longitude', 'm.latitude', 'm.longitude')} <= {R2} GROUP BY 1, 2)""")


CRIME = near("incidents", category("ofns_desc", T.CRIME_CATEGORIES), "CRIME_", "nypd")
COMPLAINT = near("complaints", category("complaint_type", T.COMPLAINT_CATEGORIES), "COMPLAINTS_", "311")
SCORES = union(tri("resource_id", "'SAFETY_SCORE'", r_even("safety_score", 3), 0.75, "nypd_derived", "mart"),
               tri("resource_id", "'QUALITY_SCORE'", r_even("quality_score", 3), 0.75, "311_derived", "mart"))


@query("crime_triples", ctes("mart", "incidents", body=CRIME))
def crime_triples(spark, sf_dir):
    v = Views(spark, sf_dir)
    return T.crime_triples(v.mart, v.incidents)


@query("complaint_triples", ctes("mart", "complaints", body=COMPLAINT))
def complaint_triples(spark, sf_dir):
    v = Views(spark, sf_dir)
    return T.complaint_triples(v.mart, v.complaints)


@query("score_triples", ctes("mart", body=SCORES))
def score_triples(spark, sf_dir):
    return T.score_triples(Views(spark, sf_dir).mart)


LABEL = "CASE landuse " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANDUSE_LABELS.items()) + " ELSE landuse END"
LOT_ROLLUP = union(
    tri("concat('boro_', borough)", "'TOTAL_LOTS'", "n", 0.9, "pluto", "(SELECT borough, count(*) AS n FROM flagged GROUP BY 1)"),
    tri("concat('boro_', borough)", f"concat('LOTS_', upper({LABEL}))", "n", 0.9, "pluto",
        "(SELECT borough, landuse, count(*) AS n FROM flagged GROUP BY 1, 2)"))
LOT = union(*[tri("CAST(bbl AS VARCHAR)", f"'{p}'", o, c, "pluto", "flagged", f"is_overflow_candidate AND {w}") for p, o, c, w in [
    ("IS_OVERFLOW_CANDIDATE", "'True'", 0.9, "true"), ("HAS_ADDRESS", "address", 1.0, "true"),
    ("IN_BOROUGH", "borough", 1.0, "true"), ("LANDUSE", LABEL, 0.9, "true"), ("OWNER", "ownername", 1.0, "true"),
    ("NUM_FLOORS", "CAST(numfloors AS BIGINT)", 1.0, "true"), ("YEAR_BUILT", "yearbuilt", 1.0, "yearbuilt > 0"),
    ("HAS_LOCATION", LOC, 1.0, "true")]])


@query("lot_rollup_triples", ctes("lots", LOTS_FLAG, body=LOT_ROLLUP))
def lot_rollup_triples(spark, sf_dir):
    return T.lot_rollup_triples(lots(Views(spark, sf_dir)))


@query("lot_triples", ctes("lots", LOTS_FLAG, body=LOT))
def lot_triples(spark, sf_dir):
    return T.lot_triples(lots(Views(spark, sf_dir)))


SID = "concat('station_', CAST(station_id AS VARCHAR))"
STATION = union(*[tri(SID, f"'{p}'", o, 1.0, "mta_gtfs", "stations") for p, o in [
    ("HAS_TYPE", "'transit_station'"), ("HAS_NAME", "name"), ("IN_BOROUGH", "borough"),
    ("HAS_LOCATION", LOC), ("SERVES_LINES", "subway_lines")]])


@query("station_triples", ctes("stations", body=STATION))
def station_triples(spark, sf_dir):
    return T.station_triples(Views(spark, sf_dir).stations)


COLOCATED = tri("a.resource_id", "'CO_LOCATED_WITH'", "b.resource_id", 0.8, "spatial_derived",
                f"""mart a JOIN mart b ON a.resource_id < b.resource_id AND a.resource_type <> b.resource_type
                AND {deg2('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= {R2}""")


@query("colocation", ctes("mart", body=COLOCATED))
def colocation(spark, sf_dir):
    return T.colocation_triples(Views(spark, sf_dir).mart)


POPS = ("pops", " UNION ALL ".join(f"SELECT '{b}' AS borough, {n} AS p" for b, n in T.POPULATION.items()))
RATE = r_even(f"n / p * {D(100000)}", 1)
DENSITY = union(
    tri("concat('boro_', borough)", "'HAS_POPULATION'", "p", 0.6, "acs_census", "pops"),
    *[tri("concat('boro_', borough)", name, obj, 0.75, "mart_derived", f"({src}) g JOIN pops USING (borough)")
      for name, obj, src in [
          ("'TOTAL_RESOURCES'", "n", "SELECT borough, count(*) AS n FROM mart GROUP BY 1"),
          ("'RESOURCES_PER_100K'", RATE, "SELECT borough, count(*) AS n FROM mart GROUP BY 1"),
          ("concat('COUNT_', upper(resource_type))", "n", "SELECT borough, resource_type, count(*) AS n FROM mart GROUP BY 1, 2"),
          ("concat(upper(resource_type), '_PER_100K')", RATE, "SELECT borough, resource_type, count(*) AS n FROM mart GROUP BY 1, 2")]])


@query("density_triples", ctes("mart", POPS, body=DENSITY))
def density_triples(spark, sf_dir):
    return T.density_triples(Views(spark, sf_dir).mart)


EVERY = ["mart", "incidents", "complaints", "lots", "stations", LOTS_FLAG, POPS,
         ("t", union(RESOURCE, CRIME, COMPLAINT, SCORES, LOT_ROLLUP, LOT, STATION, COLOCATED, DENSITY))]


def store(v):
    return T.build_triples(v.mart, v.incidents, v.complaints, lots(v), v.stations)


@query("build_triples", ctes(*EVERY, body="SELECT * FROM t"))
def build_triples(spark, sf_dir):
    return store(Views(spark, sf_dir))


@query("triple_stats", ctes(*EVERY, body=f"""
    SELECT 'n_triples' AS stat, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM t
    UNION ALL SELECT 'n_subjects', '', count(DISTINCT subject) FROM t
    UNION ALL SELECT 'n_predicates', '', count(DISTINCT predicate) FROM t
    UNION ALL SELECT 'mean_confidence', '', {r_even('avg(confidence)', 3)} FROM t
    UNION ALL SELECT 'source', source, count(*) FROM t GROUP BY source
    UNION ALL (SELECT 'predicate', predicate, count(*) AS n FROM t GROUP BY predicate ORDER BY n DESC, predicate LIMIT 20)"""))
def triple_stats(spark, sf_dir):
    return T.triple_stats(materialise(store(Views(spark, sf_dir)), "triples"))


# ---- Complaint facts ----------------------------------------------------

IMPACT = ("impact", " UNION ALL ".join(
    f"SELECT {q(t)} AS t, {q(d) if d else 'NULL'} AS d, '{i}' AS i, '{s}' AS s, '{a}' AS a" for (t, d), (i, s, a) in T.IMPACTS.items()))
TYPED = ("typed", " UNION ALL ".join(
    f"SELECT {q(t)} AS t, '{i}' AS i, '{s}' AS s, '{a}' AS a" for t, (i, s, a) in T.TYPE_IMPACTS.items()))
RULED = ("ruled", """
    SELECT c.*, coalesce(e.i, n.i, y.i, lower(replace(complaint_type, '/', '_'))) AS issue,
           coalesce(e.s, n.s, y.s, 'low') AS severity, coalesce(e.a, n.a, y.a, 'all') AS affects
    FROM complaints c LEFT JOIN impact e ON e.t = complaint_type AND e.d = descriptor
    LEFT JOIN impact n ON n.t = complaint_type AND n.d IS NULL LEFT JOIN typed y ON y.t = complaint_type""")
SUBJ = "concat('addr_', replace(coalesce(incident_address, 'unknown'), ' ', '_'), '_', coalesce(borough, ''))"


def sev(f):
    return "CASE severity " + " ".join(f"WHEN '{s}' THEN {D(round(v * f, 3))}" for s, v in T.SEVERITY_CONFIDENCE.items()) + " END"


FACTS = union(
    tri(SUBJ, "'HAS_ISSUE'", "issue", sev(0.85), "311_txt2kg", "ruled"),
    tri(SUBJ, "'ISSUE_SEVERITY'", "severity", sev(0.90), "311_txt2kg", "ruled"),
    tri(SUBJ, "'AFFECTS_POPULATION'", "affects", sev(0.80), "311_txt2kg", "ruled"),
    tri(SUBJ, "'ISSUE_DATE'", "CAST(created_at AS DATE)", 0.95, "311_txt2kg", "ruled"))
FACT_PARTS = ["complaints", IMPACT, TYPED, RULED, ("f", FACTS)]


@query("issue_rules", ctes("complaints", IMPACT, TYPED, RULED, body="""
    SELECT complaint_id, issue, severity, affects FROM ruled"""))
def issue_rules(spark, sf_dir):
    return T.issue_rules(Views(spark, sf_dir).complaints).select("complaint_id", "issue", "severity", "affects")


@query("complaint_fact_triples", ctes(*FACT_PARTS, body="SELECT * FROM f"))
def complaint_fact_triples(spark, sf_dir):
    return T.complaint_fact_triples(Views(spark, sf_dir).complaints)


@query("complaint_fact_triples_cut", ctes(*FACT_PARTS[:-1], ("f", FACTS.replace(
    "replace(coalesce(incident_address, 'unknown'), ' ', '_')", "substring(replace(coalesce(incident_address, 'unknown'), ' ', '_'), 1, 8)")), body="SELECT * FROM f"))
def complaint_fact_triples_cut(spark, sf_dir):
    return T.complaint_fact_triples(Views(spark, sf_dir).complaints, address_length=8)


ISSUES = ("issues_", """
    SELECT subject, count(*) FILTER (predicate = 'HAS_ISSUE') AS issue_count,
           string_agg(DISTINCT object_val, ', ' ORDER BY object_val) FILTER (predicate = 'HAS_ISSUE') AS issues,
           CASE max(CASE object_val WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END)
                FILTER (predicate = 'ISSUE_SEVERITY') WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium'
                WHEN 1 THEN 'low' END AS worst_severity FROM f GROUP BY 1""")


@query("address_issues", ctes(*FACT_PARTS, ISSUES, body="SELECT * FROM issues_"))
def address_issues(spark, sf_dir):
    return T.address_issues(T.complaint_fact_triples(Views(spark, sf_dir).complaints))


@query("worst_addresses", ctes(*FACT_PARTS, ISSUES, body="""
    SELECT * FROM issues_ ORDER BY issue_count DESC, subject LIMIT 10"""))
def worst_addresses(spark, sf_dir):
    return T.worst_addresses(T.address_issues(T.complaint_fact_triples(Views(spark, sf_dir).complaints)))


# Model replies as they arrive: fenced, chatty, broken, or with missing keys.
REPLY = """event_id AS reply_id, CASE event_id % 5
    WHEN 0 THEN concat('```json\n[{"s":"addr_', CAST(user_id AS STRING), '","p":"HAS_ISSUE","o":"', event_type, '"},{"s":"addr_', CAST(user_id AS STRING), '","p":"SEVERITY","o":"high"}]\n```')
    WHEN 1 THEN concat('Here you go: [{"s":"addr_', CAST(user_id AS STRING), '","p":"AFFECTS"}]')
    WHEN 2 THEN concat('[{"s":"addr_', CAST(user_id AS STRING), '","p":"HAS_ISSUE","o":"cut of')
    WHEN 3 THEN 'no triples found'
    ELSE concat('  [{"s":"a', CAST(event_id AS STRING), '","p":"RISK_FACTOR","o":"fire_risk","note":"x"}]  ') END AS text"""
REPLIES = ("replies", f"SELECT {REPLY.replace('AS STRING', 'AS VARCHAR')} FROM events")
PARSED = ("parsed", r"""SELECT *, regexp_extract(regexp_replace(regexp_replace(text, '```(json)?\s*', '', 'g'), '```\s*$', ''), '\[.*\]\s*$', 0, 's') AS body FROM replies""")
ELEMENTS = ("elements", """SELECT reply_id, unnest(from_json(body, '["JSON"]')) AS j FROM parsed WHERE body <> ''""")


def replies(spark, sf_dir):
    return spark.sql("SELECT " + REPLY.replace("{", "{{").replace("}", "}}") + " FROM {ev}",
                     ev=spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("model_triples_parse", ctes(REPLIES, PARSED, ELEMENTS, body="""
    SELECT coalesce(j->>'s', '') AS subject, coalesce(j->>'p', '') AS predicate, coalesce(j->>'o', '') AS object_val,
           CAST(0.7 AS DOUBLE) AS confidence, '311_llm_txt2kg' AS source FROM elements"""))
def model_triples_parse(spark, sf_dir):
    return T.model_triples(replies(spark, sf_dir))


@query("model_triples_rejects", ctes(REPLIES, PARSED, body="""
    SELECT count(*) FILTER (body = '') AS rejected, count(*) AS replies FROM parsed"""))
def model_triples_rejects(spark, sf_dir):
    return T.parse_model_triples(replies(spark, sf_dir)).agg(
        F.count_if(F.col("parsed").isNull()).alias("rejected"), F.count(F.lit(1)).alias("replies"))


# ---- Questions ----------------------------------------------------------


def whole_store(v):
    """The store, built once for what reads it several times."""
    return materialise(store(v), "store")


def parted_store(v):
    """(triples, links): the store without pairs of places, and the pairs as a link. They are by far the most triples."""
    named = T.build_triples(v.mart, v.incidents, v.complaints, lots(v), v.stations, colocated=False)
    places = v.mart.select("resource_id", "resource_type", "latitude", "longitude")
    return named, [(places, "resource_id", T.colocation_triples)]


def written_store(v):
    """The store in three orders. Pairs of places are made from numbers."""
    named, links = parted_store(v)
    return TripleStore.write(named, links=links)


@query("query_triples_store", ctes(*EVERY, body="""
    SELECT * FROM t WHERE predicate = 'IN_BOROUGH' AND object_val = 'BK' AND confidence >= 0.9"""))
def query_triples_store(spark, sf_dir):
    return G.query_triples(whole_store(Views(spark, sf_dir)), predicate="IN_BOROUGH", object_val="BK", min_confidence=0.9)


@query("query_triples", ctes(*EVERY, body="""
    SELECT * FROM t WHERE predicate = 'IN_BOROUGH' AND object_val = 'BK' AND confidence >= 0.9"""))
def query_triples(spark, sf_dir):
    """From the copy ordered by predicate and object."""
    return written_store(Views(spark, sf_dir)).match(predicate="IN_BOROUGH", object_val="BK", min_confidence=0.9)


@query("match_subject", ctes(*EVERY, body="SELECT * FROM t WHERE subject = 'boro_BK' AND object_val IS NOT NULL"))
def match_subject(spark, sf_dir):
    return written_store(Views(spark, sf_dir)).match(subject="boro_BK")


@query("match_object", ctes(*EVERY, body="SELECT * FROM t WHERE object_val = 'shelter' AND subject IS NOT NULL"))
def match_object(spark, sf_dir):
    return written_store(Views(spark, sf_dir)).match(object_val="shelter")


@query("subjects_with", ctes(*EVERY, body="""
    SELECT subject FROM t WHERE predicate = 'HAS_TYPE' AND object_val = 'shelter' INTERSECT
    SELECT subject FROM t WHERE predicate = 'IN_BOROUGH' AND object_val = 'BK'"""))
def subjects_with(spark, sf_dir):
    return written_store(Views(spark, sf_dir)).subjects_with(("HAS_TYPE", "shelter"), ("IN_BOROUGH", "BK"))


HOPS = ["CO_LOCATED_WITH", "HAS_TYPE", "NEAREST_TRANSIT", "HAS_CAPACITY"]


def traverse_sql(*named):
    parts, frm = [], "SELECT resource_id AS start, resource_id AS subject, CAST(1 AS DOUBLE) AS cum FROM mart"
    for i, p in enumerate(HOPS):
        parts.append((f"best{i}", f"SELECT * FROM t WHERE predicate = '{p}' QUALIFY row_number() OVER (PARTITION BY subject ORDER BY confidence DESC, object_val) = 1"))
        parts.append((f"step{i}", f"""SELECT h.start, {i + 1} AS hop, h.subject, '{p}' AS predicate, b.object_val, b.confidence, b.source,
            h.cum * coalesce(b.confidence, 0) AS cum FROM ({frm}) h LEFT JOIN best{i} b USING (subject)"""))
        frm = f"""SELECT start, CASE WHEN object_val IN (SELECT subject FROM t) THEN object_val ELSE subject END AS subject, cum
                  FROM step{i} WHERE object_val IS NOT NULL"""
    body = "\nUNION ALL ".join(f"""SELECT start, hop, subject, predicate, coalesce(object_val, 'NOT_FOUND') AS object,
        coalesce({r_even('confidence', 3)}, 0) AS confidence, {r_even('cum', 3)} AS cumulative, coalesce(source, '—') AS source
        FROM step{i}""" for i in range(len(HOPS)))
    return ctes(*named, *parts, body=body)


@query("traverse_path", traverse_sql(*EVERY))
@query("traverse_path_store", traverse_sql(*EVERY))
def traverse_path_store(spark, sf_dir):
    v = Views(spark, sf_dir)
    return G.traverse_path(v.mart, whole_store(v), HOPS, "resource_id")


RUN = r_even("product(confidence) OVER (PARTITION BY {k} ORDER BY hop ROWS UNBOUNDED PRECEDING)", 3)


@query("explain_underserved", ctes("mart", POPS, ("t", DENSITY), body=f"""
    , b AS (SELECT *, substring(subject, 6) AS borough FROM t),
    f AS (SELECT borough, coalesce(max(CAST(object_val AS BIGINT)) FILTER (predicate = 'HAS_POPULATION'), 0) AS pop,
          coalesce(max(CAST(object_val AS BIGINT)) FILTER (predicate = 'TOTAL_RESOURCES'), 0) AS total,
          coalesce(max(CAST(object_val AS DOUBLE)) FILTER (predicate = 'RESOURCES_PER_100K'), 0) AS rate FROM b GROUP BY 1),
    r AS (SELECT string_agg(concat(borough, '=', CAST(rate AS VARCHAR)), ', ' ORDER BY rate, borough) AS r FROM f WHERE total > 0),
    w AS (SELECT borough, row_number() OVER (PARTITION BY borough ORDER BY CAST(object_val AS DOUBLE), lower(replace(predicate, '_PER_100K', ''))) AS rn,
          lower(replace(predicate, '_PER_100K', '')) AS kind, CAST(object_val AS DOUBLE) AS v FROM b WHERE predicate LIKE '%\\_PER\\_100K' ESCAPE '\\'),
    h AS (SELECT borough, 1 AS hop, concat(borough, ' has population ', format('{{:,}}', pop)) AS fact, {D(0.6)} AS confidence, 'acs_census' AS source FROM f
      UNION ALL SELECT borough, 2, concat(borough, ' has ', format('{{:,}}', total), ' total resources'), 0.75, 'mart_derived' FROM f
      UNION ALL SELECT borough, 3, concat('That''s ', CAST(rate AS VARCHAR), ' resources per 100K residents'), 0.75, 'mart_derived' FROM f
      UNION ALL SELECT borough, 4, concat('Borough ranking (low→high): ', r), 0.75, 'mart_derived' FROM f, r
      UNION ALL SELECT borough, CAST(rn + 4 AS INT), concat('Lowest coverage: ', kind, ' at ', CAST(v AS VARCHAR), ' per 100K'), 0.75, 'mart_derived' FROM w WHERE rn <= 3)
    SELECT *, {RUN.format(k='borough')} AS cumulative FROM h"""))
def explain_underserved(spark, sf_dir):
    return G.explain_underserved(T.density_triples(Views(spark, sf_dir).mart))


RECOMMENDED = f"""
    , o AS (SELECT unnest({G.PRIORITY_PREDICATES}) AS predicate, unnest(range(1, 9)) AS n),
    h AS (SELECT subject, CAST(n AS INT) AS hop, concat(predicate, ': ', object_val) AS fact, confidence, source FROM t JOIN o USING (predicate)),
    c AS (SELECT subject, count(*) AS total_triples FROM t GROUP BY 1)
    SELECT *, {RUN.format(k='subject')} AS cumulative FROM h JOIN c USING (subject)"""


@query("explain_recommendation", ctes(*EVERY, body=RECOMMENDED))
@query("explain_recommendation_store", ctes(*EVERY, body=RECOMMENDED))
def explain_recommendation_store(spark, sf_dir):
    return G.explain_recommendation(whole_store(Views(spark, sf_dir)))


@query("explain_emergency", ctes("mart", "lots", LOTS_FLAG, POPS, ("t", union(DENSITY, LOT_ROLLUP)), body=f"""
    , b AS (SELECT *, substring(subject, 6) AS borough FROM t), bs AS (SELECT DISTINCT borough FROM b),
    h0 AS (SELECT borough, 1 AS o, concat('Shelters in ', borough, ': ', object_val) AS fact, {D(0.95)} AS confidence, 'mart_derived' AS source FROM b WHERE predicate = 'COUNT_SHELTER'
      UNION ALL SELECT borough, 2, concat('Assembly-zoned overflow sites in ', borough, ': ', object_val), 0.9, 'pluto' FROM b WHERE predicate = 'LOTS_ASSEMBLY_COMMUNITY'
      UNION ALL SELECT borough, 3, concat('Food banks in ', borough, ': ', object_val), 0.95, 'mart_derived' FROM b WHERE predicate = 'COUNT_FOOD_BANK'
      UNION ALL SELECT borough, 4, 'Shelter data source: DOHMH facilities registry (official)', 0.95, 'dohmh' FROM bs
      UNION ALL SELECT borough, 5, 'Overflow sites from PLUTO zoning (landuse=08, assembly)', 0.9, 'pluto' FROM bs
      UNION ALL SELECT borough, 6, 'Distance sort: Euclidean from borough centroid', 0.85, 'spatial_derived' FROM bs),
    h AS (SELECT borough, CAST(row_number() OVER (PARTITION BY borough ORDER BY o) AS INT) AS hop, fact, confidence, source FROM h0)
    SELECT *, {RUN.format(k='borough')} AS cumulative FROM h"""))
def explain_emergency(spark, sf_dir):
    v = Views(spark, sf_dir)
    return G.explain_emergency(T.density_triples(v.mart).unionByName(T.lot_rollup_triples(lots(v))))


PLAN_COLUMNS = [
    "request_id",
    "CASE WHEN request_id % 3 = 0 THEN 'lookup' WHEN request_id % 3 = 1 THEN 'needs_assessment' ELSE 'simulate' END AS intent",
    "CASE request_id % 4 WHEN 0 THEN 'cold_emergency' WHEN 1 THEN 'resource_gap' WHEN 2 THEN 'capacity_change' ELSE 'migrant_allocation' END AS scenario",
    "CAST(request_id % 3 + 1 AS INT) AS n_needs"]

CHAINS = ("chains", union(
    *[f"SELECT '{'lookup' if k == 'lookup' else 'simulate'}' AS intent, '{k}' AS scenario, {i + 1} AS hop, {D(c)} AS confidence, {q(s)} AS source"
      for k, hops in G.INTENT_HOPS.items() for i, (c, s) in enumerate(hops)]))


@query("reasoning_chain", ctes("requests", CHAINS, ("plans", f"SELECT {', '.join(PLAN_COLUMNS)} FROM requests"), body=f"""
    , h AS (SELECT request_id, p.intent, c.hop, c.confidence, c.source FROM plans p JOIN chains c
              ON c.intent = p.intent AND (p.intent = 'lookup' OR c.scenario = p.scenario)
      UNION ALL SELECT request_id, intent, 1, 1.0, 'user_query' FROM plans WHERE intent = 'needs_assessment'
      UNION ALL SELECT request_id, intent, CAST(unnest(range(2, n_needs + 3)) AS INT), 0.85, 'nemotron_planning' FROM plans WHERE intent = 'needs_assessment'
      UNION ALL SELECT request_id, intent, n_needs + 3, 0.95, 'mart + graph' FROM plans WHERE intent = 'needs_assessment'),
    r AS (SELECT *, {RUN.format(k='request_id')} AS cumulative FROM h),
    l AS (SELECT request_id, min(cumulative) AS last FROM r GROUP BY 1)
    SELECT r.*, CASE WHEN last >= 0.7 THEN 'high' WHEN last >= 0.4 THEN 'moderate' ELSE 'limited' END AS band FROM r JOIN l USING (request_id)"""))
def reasoning_chain(spark, sf_dir):
    return G.reasoning_chain(Views(spark, sf_dir).requests.selectExpr(*PLAN_COLUMNS))

