"""Eligibility, rights, stories, documents, protocols and action plans."""

from pyspark.sql import functions as F

from ..functions.session import materialise
from ..operators import evidence as E
from ..operators import lookup as L
from ..operators import rules as K
from ..operators import textrules as X
from ..operators import triples as T
from .lookup_queries import EXPAND, lots
from .registry import Views, ctes, query, r_even

D = "CAST({} AS DOUBLE)".format


def q(s):
    return "'" + s.replace("'", "''") + "'"


def lit(v):
    return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else q(v)


def values(name, rows, cols):
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return (name, f"SELECT * FROM (VALUES {body}) AS x({cols})")


def size_case(table, size, default):
    return f"CASE {size} " + " ".join(f"WHEN {k} THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


FPL = f"CASE WHEN household_size > 8 THEN 52720 + (household_size - 8) * 5380 ELSE {size_case(K.POVERTY, 'household_size', 15060)} END"


@query("poverty_level", ctes("households", body=f"SELECT household_id, household_size, {FPL} AS fpl FROM households"))
def poverty_level(spark, sf_dir):
    return Views(spark, sf_dir).households.select("household_id", "household_size", K.poverty_level().alias("fpl"))


UNDER = lambda s: f"annual_income <= fpl * {D(s)}"
KIDS = "(has_pregnant OR has_children)"
MEDICAID = f"CASE WHEN {KIDS} THEN {UNDER(2.23)} ELSE {UNDER(1.38)} END"
SNAP = (f"CASE WHEN {UNDER(1.3)} THEN greatest(0, round_even({size_case(K.SNAP_MAX, 'least(household_size, 8)', 1756)} + "
        f"greatest(household_size - 8, 0) * 220 - {D(0.3)} * (annual_income / {D(12)} * {D(0.8)}), 0)) ELSE 0 END")
CASH = f"CASE WHEN {UNDER(1)} THEN {size_case(K.CASH, 'least(household_size, 6)', 721)} ELSE 0 END"
RULES = [("snap", UNDER(1.3), SNAP, None, "true"), ("medicaid", MEDICAID, "NULL", MEDICAID, "true"),
         ("wic", f"{KIDS} AND {UNDER(1.85)}", "NULL", f"{KIDS} AND {UNDER(1.85)}", "true"),
         ("cash_assistance", UNDER(1), CASH, None, "true"), ("school_meals", "has_children", "NULL", "has_children", "true"),
         ("emergency_shelter", "true", "NULL", "true", "housing_status IN ('homeless', 'at_risk')"),
         ("fair_fares", UNDER(1.2), "NULL", "true", "true"), ("document_assistance", "true", "NULL", "true", "NOT has_id")]


def programs_sql(frm, key):
    return "\nUNION ALL ".join(
        f"SELECT {key}, {i} AS i, '{k}' AS key, {q(K.PROGRAMS[k][0])} AS program, {ok} AS qualifies, CAST({amount} AS INT) AS amount, "
        + (f"CASE WHEN {when} THEN {q(K.ESTIMATE_TEXT[k])} END" if when else "NULL")
        + f" AS estimate, {q('; '.join(K.PROGRAMS[k][1]))} AS documents, {q(K.PROGRAMS[k][2])} AS where_to_apply, {q(K.PROGRAMS[k][3])} AS how_long "
        f"FROM (SELECT *, {FPL} AS fpl FROM {frm}) WHERE {only}" for i, (k, ok, amount, when, only) in enumerate(RULES))


@query("eligibility", ctes("households", ("p", programs_sql("households", "household_id")), body="SELECT * EXCLUDE (i) FROM p"))
def eligibility(spark, sf_dir):
    return K.eligibility(Views(spark, sf_dir).households)


@query("benefit_totals", ctes("households", ("p", programs_sql("households", "household_id")), body=f"""
    SELECT household_id, {FPL} AS fpl_for_household, {r_even(f'annual_income / ({FPL}) * {D(100)}')} AS pct_fpl,
           coalesce(t.programs, '') AS qualifying_programs, CAST(t.total AS BIGINT) AS estimated_monthly_benefits
    FROM households JOIN (SELECT household_id, string_agg(program, '; ' ORDER BY i) FILTER (qualifies) AS programs, sum(coalesce(amount, 0)) AS total
                          FROM p GROUP BY 1) t USING (household_id)"""))
def benefit_totals(spark, sf_dir):
    df = K.benefit_totals(Views(spark, sf_dir).households)
    return df.withColumn("qualifying_programs", F.array_join("qualifying_programs", "; "))


RIGHT = values("rights", [(t, i, r, d) for t, rs in K.RIGHTS.items() for i, (r, d) in enumerate(rs)], "kind, i, right_name, detail")
KIND = "CASE WHEN {0} IN (SELECT kind FROM {1}) THEN {0} ELSE 'default' END"


@query("rights_for_type", ctes("mart", RIGHT, body="""
    SELECT m.resource_id, CAST(i AS INT) AS position, right_name AS "right", detail FROM
      (SELECT resource_id, CASE WHEN resource_id LIKE '%7' THEN 'library' ELSE resource_type END AS k FROM mart) m
    JOIN rights r ON r.kind = CASE WHEN m.k IN (SELECT kind FROM rights) THEN m.k ELSE 'default' END WHERE i < 3"""))
def rights_for_type(spark, sf_dir):
    m = Views(spark, sf_dir).mart.withColumn("k", F.expr("CASE WHEN resource_id LIKE '%7' THEN 'library' ELSE resource_type END"))
    return m.select("resource_id", F.posexplode(K.rights_for_type("k", 3)).alias("position", "r")).select("resource_id", "position", "r.*")


STORY = values("story", [(i, s, n) for i, (s, ns, *_) in enumerate(K.STORIES) for n in ns], "i, id, need")


@query("stories_for_need", ctes("case_events", STORY, body="""
    , n AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE category END AS need FROM case_events),
    s AS (SELECT DISTINCT i, id FROM story), d AS (SELECT DISTINCT need FROM n),
    p AS (SELECT d.need, s.id, s.i FROM d JOIN s ON EXISTS (SELECT 1 FROM story x WHERE x.need = d.need AND x.id = s.id)
          OR NOT EXISTS (SELECT 1 FROM story x WHERE x.need = d.need))
    SELECT event_id, need, (SELECT string_agg(id, ', ' ORDER BY i) FROM (SELECT * FROM p WHERE p.need = n.need ORDER BY i LIMIT 3)) AS stories FROM n"""))
def stories_for_need(spark, sf_dir):
    df = Views(spark, sf_dir).case_events.select("event_id", F.expr("CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE category END").alias("need"))
    return df.withColumn("stories", F.array_join(K.stories_for_need("need"), ", "))


STORY_ROWS = values("told", [(i, *rest) for i, _, *rest in K.STORIES], "id, timeframe, name, age_range, situation, outcome, quote")


@query("story_details", ctes("case_events", STORY, STORY_ROWS, body="""
    , n AS (SELECT event_id, category AS need FROM case_events),
    p AS (SELECT need, i, id, row_number() OVER (PARTITION BY need ORDER BY i) AS rank FROM story)
    SELECT event_id, CAST(rank - 1 AS INT) AS position, t.* FROM n JOIN p USING (need) JOIN told t ON t.id = p.id WHERE rank <= 2
    UNION ALL SELECT event_id, CAST(s.i AS INT), t.* FROM n, (SELECT DISTINCT i, id FROM story WHERE i < 2) s JOIN told t ON t.id = s.id
      WHERE need NOT IN (SELECT need FROM story)"""))
def story_details(spark, sf_dir):
    df = Views(spark, sf_dir).case_events.select("event_id", K.stories_for_need("category", 2).alias("ids"))
    return df.select("event_id", F.posexplode(K.story_details("ids")).alias("position", "s")).select("event_id", "position", "s.*")


@query("profile_rights", ctes("households", body="""
    , h AS (SELECT *, household_id % 4 = 0 AS is_undocumented, household_id % 3 <> 0 AS has_insurance FROM households)
    """ + "\nUNION ALL ".join(f'SELECT household_id, {q(r)} AS "right", {q(d)} AS detail FROM h WHERE {c}' for c, r, d in K.PROFILE_RIGHTS)))
def profile_rights(spark, sf_dir):
    df = Views(spark, sf_dir).households.withColumns({
        "is_undocumented": F.expr("household_id % 4 = 0"), "has_insurance": F.expr("household_id % 3 <> 0")})
    return df.select("household_id", F.explode(K.profile_rights()).alias("r")).select("household_id", "r.*")


DOC = values("docs", [(t, i, *d) for t, ds in K.document_rows().items() for i, d in enumerate(ds)],
             "kind, i, doc, required, substitute, substitutes, fallback_process")


@query("required_documents", ctes("mart", DOC, body="""
    SELECT resource_id, CAST(i AS INT) AS position, doc, required, CASE WHEN required THEN 'high' ELSE 'low' END AS gap_risk, substitute, substitutes, fallback_process FROM
      (SELECT resource_id, CASE WHEN resource_id LIKE '%7' THEN 'library' ELSE resource_type END AS k FROM mart) m
    JOIN docs ON kind = CASE WHEN k IN (SELECT kind FROM docs) THEN k ELSE 'default' END"""))
def required_documents(spark, sf_dir):
    m = Views(spark, sf_dir).mart.withColumn("k", F.expr("CASE WHEN resource_id LIKE '%7' THEN 'library' ELSE resource_type END"))
    return m.select("resource_id", F.posexplode(K.required_documents("k")).alias("position", "d")).select("resource_id", "position", "d.*")


PROTOCOL = values("protocol", list(K.PROTOCOLS.items()), "kind, text")
OPEN = """SELECT c_custkey AS visit_id, CASE c_custkey % 4 WHEN 0 THEN {a}('id', 'medical', 'food') WHEN 1 THEN {a}('documents')
    WHEN 2 THEN {a}('senior') ELSE {a}('housing', 'legal') END AS needs,
    CASE c_custkey % 3 WHEN 0 THEN 'shelter' WHEN 1 THEN 'library' ELSE 'childcare' END AS kind FROM {t}"""


@query("service_protocol", ctes(("v", OPEN.format(a="list_value", t="customer")), PROTOCOL, body="""
    SELECT visit_id, coalesce((SELECT text FROM protocol p WHERE p.kind = list_filter(needs, lambda n: n IN (SELECT kind FROM protocol))[1]),
           (SELECT text FROM protocol p WHERE p.kind = v.kind), 'Standard intake process applies.') AS protocol FROM v""".replace(
    "list_filter(needs, lambda n: n IN (SELECT kind FROM protocol))[1]",
    "list_filter(needs, lambda n: list_contains([" + ", ".join(q(k) for k in K.PROTOCOLS) + "], n))[1]")))
def service_protocol(spark, sf_dir):
    df = spark.sql(OPEN.format(a="array", t="{c}"), c=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return df.select("visit_id", K.service_protocol("needs", "kind").alias("protocol"))


# ---- Action plan --------------------------------------------------------
# Needs and result sets per customer; sites answer by their key's remainder.

NEED_ROWS = """SELECT c_custkey AS request_id, 'housing' AS category, 3 AS priority FROM {t} UNION ALL
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'food' WHEN 1 THEN 'medical' WHEN 2 THEN 'school' WHEN 3 THEN 'benefits' WHEN 4 THEN 'pets' ELSE 'hospital+x' END, 2 FROM {t} UNION ALL
    SELECT c_custkey, 'senior_services', 1 FROM {t} WHERE c_custkey % 3 = 0"""
RESULT_ROWS = """SELECT c_custkey AS request_id, k.result_key, k.key_order, r.rank, concat('Site ', CAST((c_custkey * 7 + k.key_order * 3 + r.rank) % 500 AS VARCHAR)) AS name, k.kind AS resource_type
    FROM customer JOIN (SELECT 'shelter+nycha' AS result_key, 0 AS key_order, 'shelter' AS kind UNION ALL SELECT 'food_bank', 1, 'food_bank'
                   UNION ALL SELECT 'hospital', 2, 'hospital' UNION ALL SELECT 'school', 3, 'school') k ON (c_custkey + k.key_order) % 4 < 2
    JOIN (SELECT 1 AS rank UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) r ON r.rank <= c_custkey % 5 + 1"""
RESULT_SETS = """array(named_struct('result_key', 'shelter+nycha', 'key_order', 0, 'kind', 'shelter'),
    named_struct('result_key', 'food_bank', 'key_order', 1, 'kind', 'food_bank'),
    named_struct('result_key', 'hospital', 'key_order', 2, 'kind', 'hospital'),
    named_struct('result_key', 'school', 'key_order', 3, 'kind', 'school'))"""
PRIO = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.PRIORITY_ORDER.items()) + " ELSE priority END"
FRAME = "CASE prio " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in K.TIME_FRAMES.items()) + " ELSE 'SOON' END"


@query("action_plan", ctes("households", ("needs", NEED_ROWS.format(t="customer")), ("results", RESULT_ROWS),
    EXPAND, RIGHT, ("p", programs_sql("households", "household_id")), body=f"""
    , lv AS (SELECT n.request_id, n.category, r.result_key, r.key_order, CASE WHEN r.result_key = n.category THEN 0
             WHEN EXISTS (SELECT 1 FROM expand e WHERE e.cat = lower(n.category) AND contains(r.result_key, e.t))
                  OR (lower(n.category) NOT IN (SELECT cat FROM expand) AND contains(r.result_key, n.category)) THEN 1
             WHEN contains(r.result_key, n.category) OR contains(n.category, r.result_key) THEN 2 END AS level
             FROM needs n JOIN (SELECT DISTINCT request_id, result_key, key_order FROM results) r USING (request_id)),
    pick AS (SELECT * FROM lv WHERE level IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id, category ORDER BY level, key_order) = 1),
    st AS (SELECT n.request_id, n.category, {PRIO} AS prio, t.name AS top_resource, coalesce(t.resource_type, n.category) AS k,
           coalesce((SELECT string_agg(name, '; ' ORDER BY rank) FROM results a WHERE a.request_id = n.request_id AND a.result_key = pick.result_key AND a.rank BETWEEN 2 AND 4), '') AS alternatives
           FROM needs n LEFT JOIN pick USING (request_id, category)
           LEFT JOIN results t ON t.request_id = n.request_id AND t.result_key = pick.result_key AND t.rank = 1),
    rt AS (SELECT kind, string_agg(right_name, '; ' ORDER BY i) AS rights FROM rights WHERE i < 3 GROUP BY 1)
    SELECT request_id, category, CAST(prio AS INT) AS priority, {FRAME} AS timeframe, concat('Address ', replace(category, '_', ' '), ' need') AS action,
           top_resource, alternatives, rt.rights,
           CASE WHEN category IN ('benefits', 'documents', 'id', 'food', 'medical', 'school') THEN coalesce((
             SELECT string_agg(program, '; ' ORDER BY i) FROM p WHERE p.household_id = st.request_id AND qualifies AND (category IN ('benefits', 'documents', 'id')
               OR category = 'food' AND (contains(program, 'SNAP') OR contains(program, 'WIC') OR contains(lower(program), 'meal'))
               OR category = 'medical' AND contains(program, 'Medicaid') OR category = 'school' AND contains(program, 'School'))), '') END AS eligibility
    FROM st JOIN rt ON rt.kind = CASE WHEN st.k IN (SELECT kind FROM rt) THEN st.k ELSE 'default' END"""))
def action_plan(spark, sf_dir):
    cust = spark.read.parquet(f"{sf_dir}/customer.parquet")
    needs = spark.sql(NEED_ROWS.format(t="{c}"), c=cust)
    results = (cust.select("c_custkey", F.expr(RESULT_SETS).alias("k")).select("c_custkey", F.explode("k").alias("k"))
               .where("(c_custkey + k.key_order) % 4 < 2").select("c_custkey", "k", F.expr("explode(sequence(1, 5))").alias("rank"))
               .where("rank <= c_custkey % 5 + 1").selectExpr(
                   "c_custkey AS request_id", "k.result_key", "k.key_order", "rank", "k.kind AS resource_type",
                   "concat('Site ', CAST((c_custkey * 7 + k.key_order * 3 + rank) % 500 AS STRING)) AS name"))
    programs = K.benefit_totals(Views(spark, sf_dir).households).withColumnRenamed("household_id", "request_id")
    return K.action_plan(needs, results, programs)


@query("request_plan")   # the whole path from text to steps; its parts are checked one by one
def request_plan(spark, sf_dir):
    """Requests: screen, plan, look up, rules, and one step per need."""
    v = Views(spark, sf_dir)
    asked = X.intent_rules(v.requests.where(X.screen_reason("text").isNull()))
    # screened and planned once: searches, needs and profiles all read it
    return assessed(materialise(asked.where("intent = 'needs_assessment'").drop("resource_types", "ada"), "asked"), v.mart)


def assessed(asked, mart):
    """One step per need of planned requests."""
    spot = X.landmark_geocode()
    searches = asked.withColumn("g", spot).select("request_id", "borough", "g", F.posexplode("searches").alias("key_order", "s"))
    searches = searches.select(
        F.struct("request_id", "key_order").alias("search_id"), F.col("s.types").alias("types"), "borough",
        F.lit(False).alias("ada"), F.col("s.top").alias("top"), "g.lat", "g.lon",
        F.array_join("s.types", "+").alias("result_key"))
    found = L.batched_lookup(searches, mart, ("name", "resource_type"))
    results = found.join(searches.select("search_id", "result_key"), "search_id").select(
        "search_id.request_id", "search_id.key_order", "result_key", "rank", "name", "resource_type")
    needs = asked.select("request_id", F.explode("needs").alias("n")).select("request_id", "n.category", "n.priority")
    profile = X.household_profile(asked.drop("household_size"))
    return K.action_plan(needs, results, K.benefit_totals(profile, "request_id"))


OUTCOME = ["request_id", "outcome", "item", "kind", "name", "detail"]
LOOKUP_TOP = 5


def request_outcomes(requests, mart, lots):
    """What every request comes to, at least one row each: stopped, lookup, simulate, assessed, or as it is planned.

    ``item`` numbers the rows of a request. A stopped request has its reason as
    kind and the reply as detail. Searches list the best sites; a cold emergency
    the sites of its borough, with the people split over the shelters; a gap
    question the boroughs, worst served first; an assessment one row per need.
    The keyword rules plan no request as explain; a plan that does is answered
    with the evidence on its borough, or on all boroughs. A request that no row
    answers keeps one row with its intent and nulls.
    """
    screened = X.guardrail_screen(requests)
    planned = materialise(X.intent_rules(screened), "planned")
    stopped = planned.where("NOT allow").select(
        "request_id", F.lit("stopped").alias("outcome"), F.lit(1).alias("item"), F.col("reason").alias("kind"),
        F.lit(None).cast("string").alias("name"), F.col("replacement_response").alias("detail"))
    passed = planned.where("allow").drop("allow", "reason", "crisis_type", "replacement_response")
    answers = [answer(passed, mart, lots) for answer in (_looked_up, _emergencies, _gaps, _explained, _needs)]
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    rest = passed.withColumn("outcome", F.expr("CASE intent WHEN 'needs_assessment' THEN 'assessed' ELSE intent END"))
    return rest.select("request_id", "outcome").join(found, "request_id", "left").withColumn(
        "item", F.coalesce("item", F.lit(1))).select(*OUTCOME).unionByName(stopped)


def _rows(df, item, kind, name, detail):
    return df.select("request_id", F.expr(item).cast("int").alias("item"), F.expr(kind).alias("kind"),
                     F.expr(name).alias("name"), F.expr(detail).cast("string").alias("detail"))


def _looked_up(passed, mart, lots):
    asks = passed.where("intent = 'lookup'").withColumn("g", X.landmark_geocode()).select(
        F.col("request_id").alias("search_id"), F.col("resource_types").alias("types"), "borough",
        F.coalesce("ada", F.lit(False)).alias("ada"), F.lit(LOOKUP_TOP).alias("top"), "g.lat", "g.lon")
    found = L.batched_lookup(asks, mart, ("name", "resource_type")).withColumnRenamed("search_id", "request_id")
    return _rows(found, "rank", "resource_type", "name", "resource_id")


def _emergencies(passed, mart, lots):
    asks = passed.where("scenario = 'cold_emergency'").select("request_id", "borough", "people")
    sites = asks.join(L.emergency_plan(mart, lots).drop("assigned_people"), "borough")
    sites = L.even_allocation(sites, F.col("people"), ["request_id", "role"])
    order = "row_number() OVER (PARTITION BY request_id ORDER BY CASE role WHEN 'shelter' THEN 1 WHEN 'overflow' THEN 2 ELSE 3 END, rank)"
    return _rows(sites, order, "role", "detail", "CASE role WHEN 'shelter' THEN assigned_people END")


def _gaps(passed, mart, lots):
    asks = passed.where("scenario = 'resource_gap'").select("request_id")
    gap = asks.crossJoin(L.resource_gap(mart))
    order = "row_number() OVER (PARTITION BY request_id ORDER BY resources_per_100k, borough)"
    return _rows(gap, order, "'resource_gap'", "borough", "resources_per_100k")


def _explained(passed, mart, lots):
    asks = passed.where("intent = 'explain'").select("request_id", F.col("borough").alias("asked"))
    facts = asks.join(E.explain_underserved(T.density_triples(mart)), F.expr("coalesce(asked, borough) = borough"))
    return _rows(facts, "row_number() OVER (PARTITION BY request_id ORDER BY borough, hop)", "'evidence'", "borough", "fact")


def _needs(passed, mart, lots):
    asked = passed.where("intent = 'needs_assessment'").drop("resource_types", "ada")
    order = "row_number() OVER (PARTITION BY request_id ORDER BY priority, category)"
    return _rows(assessed(asked, mart), order, "category", "top_resource", "concat_ws('; ', action, timeframe, eligibility)")


@query("request_answers")   # request_plan holds the assessed requests only
def request_answers(spark, sf_dir):
    """Every request with what became of it."""
    v = Views(spark, sf_dir)
    return request_outcomes(v.requests, v.mart, lots(v))
