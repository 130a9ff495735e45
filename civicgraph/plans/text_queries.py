"""Text rules over requests, documents, conversations and derived replies."""

from pyspark.sql import functions as F

from ..functions.session import spread
from ..operators import textrules as X
from .registry import Views, ctes, query

D = "CAST({} AS DOUBLE)".format


def q(s):
    return "'" + s.replace("'", "''") + "'"


def words(c, ws):
    return "(" + " OR ".join(f"contains({c}, {q(w)})" for w in ws) + ")"


def rx(c, p, g=1):
    return f"nullif(regexp_extract({c}, {q(p)}, {g}), '')"


def rxs(c, ps):
    return "(" + " OR ".join(f"regexp_matches({c}, {q(p)})" for p in ps) + ")"


def table(name, rows, cols):
    vals = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else D(v) if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)
    return (name, f"SELECT * FROM (VALUES {vals}) AS x({cols})")


# ---- Intent -------------------------------------------------------------

# The requests as they are, and the same people asking in other words.
ASKED = """SELECT request_id, text FROM requests
    UNION ALL SELECT request_id + 1000000, CASE request_id % 8
      WHEN 0 THEN concat('Cold emergency in Queens, ', CAST(request_id AS {s}), ' people displaced at 12F')
      WHEN 1 THEN 'Which borough is most underserved?' WHEN 2 THEN 'Wheelchair accessible shelter beds in Staten Island'
      WHEN 3 THEN 'We''re a family, my mother is pregnant and needs a doctor' WHEN 4 THEN 'Soup kitchen or pantry'
      WHEN 5 THEN 'I am new here' WHEN 6 THEN 'daycare and school in the Bronx' ELSE 'overflow sites' END FROM requests"""


def asked(spark, sf_dir):
    text = ASKED.format(s="STRING").replace("We''re", "We\\'re").replace("requests", "{r}")
    return spark.sql(text, r=Views(spark, sf_dir).requests)


BORO = "CASE " + " ".join(f"WHEN contains(q, {q(k)}) THEN '{v}'" for k, v in X.BOROUGH_KEYWORDS.items()) + " END"
NEEDS = "list_filter([" + ", ".join(
    f"CASE WHEN {words('q', ws)} THEN '{cat}:{p}:{'+'.join(ts)}:{top}' END" for ws, cat, p, ts, top in X.NEED_RULES) + "], lambda n: n IS NOT NULL)"
KINDS = "flatten([" + ", ".join(f"CASE WHEN {words('q', ws)} THEN [{', '.join(q(t) for t in ts)}] ELSE [] END" for ws, ts in X.LOOKUP_RULES) + "])"
def intent_sql(needs):
    return ("planned", f"""
    SELECT *, CASE WHEN intent = 'simulate' THEN CASE WHEN {words('q', X.GAP_WORDS)} THEN 'resource_gap' ELSE 'cold_emergency' END END AS scenario,
           CASE WHEN len(n0) = 0 THEN ['housing:1:shelter:5'] ELSE {needs} END AS n FROM (
      SELECT *, CASE WHEN {words('q', X.SCENARIO_WORDS)} THEN 'simulate' WHEN {words('q', X.SITUATION_WORDS)} THEN 'needs_assessment' ELSE 'lookup' END AS intent,
             {BORO} AS b, {NEEDS} AS n0, {KINDS} AS k FROM (SELECT *, lower(text) AS q FROM asked))""")


INTENT = intent_sql("n0")
PLAN_SQL = f"""
    SELECT request_id, intent, scenario,
           CASE WHEN scenario = 'cold_emergency' THEN coalesce(b, 'BK') WHEN intent <> 'simulate' THEN b END AS borough,
           CASE WHEN scenario = 'cold_emergency' THEN coalesce(CAST({rx('q', X.PEOPLE_PATTERN)} AS INT), 200) END AS people,
           CASE WHEN scenario = 'cold_emergency' THEN coalesce(CAST({rx('q', X.TEMPERATURE_PATTERN)} AS INT), 15) END AS temperature,
           CASE WHEN intent = 'needs_assessment' THEN CAST({rx('q', X.SIZE_PATTERN)} AS INT) + 1 END AS household_size,
           CASE WHEN intent = 'needs_assessment' THEN text END AS situation,
           CASE WHEN intent = 'needs_assessment' THEN array_to_string(list_transform(n, lambda x: concat(split_part(x, ':', 1), ':', split_part(x, ':', 2))), ',') END AS needs,
           CASE WHEN intent = 'needs_assessment' THEN array_to_string(list_transform(n, lambda x: concat(split_part(x, ':', 3), ':', split_part(x, ':', 4))), ',') END AS searches,
           CASE WHEN intent = 'lookup' THEN CASE WHEN len(k) = 0 THEN 'shelter,food_bank,hospital' ELSE array_to_string(k, ',') END END AS resource_types,
           CASE WHEN intent = 'lookup' AND {words('q', X.ADA_WORDS)} THEN true END AS ada FROM planned"""


def planned(df):
    flat = lambda e: F.expr(f"array_join({e}, ',')")
    return df.select(
        "request_id", "intent", "scenario", "borough", "people", "temperature", "household_size", "situation",
        flat("transform(needs, n -> concat(n.category, ':', CAST(n.priority AS STRING)))").alias("needs"),
        flat("transform(searches, s -> concat(array_join(s.types, '+'), ':', CAST(s.top AS STRING)))").alias("searches"),
        F.array_join("resource_types", ",").alias("resource_types"), "ada")


@query("intent_rules", ctes("requests", ("asked", ASKED.format(s="VARCHAR")), INTENT, body=PLAN_SQL))
def intent_rules(spark, sf_dir):
    return planned(X.intent_rules(asked(spark, sf_dir)))


@query("intent_rules_first_needs", ctes("requests", ("asked", ASKED.format(s="VARCHAR")), intent_sql("n0[1:3]"),
                                        body=PLAN_SQL.replace("THEN text END AS situation", "THEN substring(text, 1, 80) END AS situation")))
def intent_rules_first_needs(spark, sf_dir):
    return planned(X.intent_rules(asked(spark, sf_dir), most_needs=3, situation_length=80))


PLANS = """event_id AS reply_id, CASE event_id % 7
    WHEN 0 THEN concat('<think>maybe {"intent":"x"}</think> {"intent":"lookup","resource_types":["shelter","', event_type, '"],"filters":{"borough":"BK","ada_accessible":true},"limit":', CAST(event_id % 9 AS STRING), '} hope {that} helps')
    WHEN 1 THEN concat('```json\n{"intent":"simulate","scenario":"cold_emergency","params":{"people":', CAST(user_id AS STRING), '}}\n```')
    WHEN 2 THEN '{"intent":"dance","limit":3}'
    WHEN 3 THEN '{"intent":"lookup","resource_types":["shel'
    WHEN 4 THEN 'I could not decide'
    WHEN 5 THEN concat('{"intent":"explain","question":"why_recommend","target":"site_', CAST(user_id AS STRING), '"}')
    ELSE CAST(NULL AS STRING) END AS text"""


@query("plan_json_parse", ctes(("replies", f"SELECT {PLANS.replace('AS STRING', 'AS VARCHAR')} FROM events"), body=r"""
    , b AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(coalesce(text, ''), '<think>.*?</think>', '', 'gs'), '```(json)?\s*', '', 'g'),
             '(\{[^{}]*(\{[^{}]*\})?[^{}]*\})', 1, 's') AS body FROM replies),
    j AS (SELECT *, CASE WHEN json_valid(body) AND body <> '' AND (CAST(body AS JSON)->>'intent') IN ('lookup', 'needs_assessment', 'simulate', 'explain') THEN CAST(body AS JSON) END AS j FROM b)
    SELECT reply_id, coalesce(j->>'intent', 'lookup') AS intent, j->>'scenario' AS scenario,
           CASE WHEN j IS NULL THEN 'shelter,food_bank,hospital' WHEN (j->'resource_types') IS NOT NULL THEN array_to_string(from_json((j->'resource_types'), '["VARCHAR"]'), ',') END AS resource_types,
           (j->'filters')->>'borough' AS borough, CASE WHEN j IS NULL THEN 5 ELSE CAST(j->>'limit' AS INT) END AS "limit",
           j->>'target' AS target, CASE WHEN j IS NULL THEN text END AS parse_error FROM j"""))
def plan_json_parse(spark, sf_dir):
    text = PLANS.replace("{", "{{").replace("}", "}}")
    replies = spark.sql(f"SELECT {text} FROM {{ev}}", ev=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return X.parse_plan(replies).select(
        "reply_id", "plan.intent", "plan.scenario", F.array_join("plan.resource_types", ",").alias("resource_types"),
        "plan.filters.borough", "plan.limit", "plan.target", "parse_error")


# ---- Places -------------------------------------------------------------

MARKS = table("marks", [(i, *r) for i, r in enumerate(X.LANDMARKS)], "i, key, display_name, lat, lon")


@query("landmark_geocode", ctes("requests", MARKS, body="""
    SELECT request_id, arg_min(display_name, i) AS display_name, arg_min(lat, i) AS lat, arg_min(lon, i) AS lon
    FROM requests LEFT JOIN marks ON contains(lower(text), key) GROUP BY 1"""))
def landmark_geocode(spark, sf_dir):
    df = Views(spark, sf_dir).requests.withColumn("g", X.landmark_geocode())
    return df.select("request_id", "g.display_name", "g.lat", "g.lon")


STREETS = """CASE request_id % 5 WHEN 0 THEN text WHEN 1 THEN concat('I sleep on East ', CAST(request_id % 80 AS {s}), 'th Street now')
    WHEN 2 THEN concat('meet at ', CAST(request_id AS {s}), ' Main St please') WHEN 3 THEN '53rd street and 3rd' ELSE 'somewhere' END AS text"""


@query("address_extract", ctes("requests", ("t", f"SELECT request_id, {STREETS.format(s='VARCHAR')} FROM requests"), body=f"""
    SELECT request_id, coalesce({', '.join(rx('text', '(?i)' + p) for p in X.ADDRESS_PATTERNS)}) AS address FROM t"""))
def address_extract(spark, sf_dir):
    df = Views(spark, sf_dir).requests.selectExpr("request_id", STREETS.format(s="STRING"))
    return df.select("request_id", X.address_extract().alias("address"))


PLACES = """SELECT c_custkey AS place_id, CASE c_custkey % 9 WHEN 0 THEN ' Flatbush, Brooklyn' WHEN 1 THEN 'ASTORIA, NY' WHEN 2 THEN 'harlem heights'
    WHEN 3 THEN 'atlantis' WHEN 4 THEN 'side' WHEN 5 THEN 'new york' WHEN 6 THEN concat('unit ', CAST(c_custkey AS {s}), ' soho, NYC')
    WHEN 7 THEN 'the bronx' ELSE ', nyc' END AS text FROM {t}"""
HOODS = table("hoods", [(i, *r) for i, r in enumerate(X.NEIGHBORHOODS)], "i, key, display_name, lat, lon")


def cleaned():
    e = "lower(trim(text))"
    for s in X.PLACE_SUFFIXES:
        e = f"trim(replace({e}, {q(s)}, ''))"
    return e


@query("neighborhood_geocode", ctes(("p", PLACES.format(s="VARCHAR", t="customer")), HOODS, body=f"""
    , c AS (SELECT *, {cleaned()} AS q FROM p),
    d AS (SELECT DISTINCT q FROM c),
    m AS (SELECT d.q, arg_min(h, (CASE WHEN h.key = d.q THEN 0 ELSE 1 END, h.i)) AS h FROM d JOIN hoods h
          ON h.key = d.q OR contains(d.q, h.key) OR contains(h.key, d.q) GROUP BY 1)
    SELECT place_id, CASE WHEN h.key = c.q THEN concat(trim(text), ', New York, NY') ELSE h.display_name || ', New York, NY' END AS display_name,
           h.lat AS lat, h.lon AS lon FROM c LEFT JOIN m USING (q)"""))
def neighborhood_geocode(spark, sf_dir):
    df = spark.sql(PLACES.format(s="STRING", t="{c}"), c=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return X.neighborhood_geocode(df).select("place_id", "display_name", "lat", "lon")


# ---- People -------------------------------------------------------------

LIVES = """SELECT request_id, text FROM requests UNION ALL
    SELECT request_id + 1000000, CASE request_id % 5 WHEN 0 THEN concat('Family of ', CAST(request_id % 7 AS {s}), ', making $2', CAST(request_id % 10 AS {s}), ',500k')
      WHEN 1 THEN concat('elderly veteran, income 1', CAST(1000 + request_id % 1000 AS {s}), ' a year, lost my ID') WHEN 2 THEN 'household of 9, kicked us out, expecting a baby'
      WHEN 3 THEN 'uninsured and broke, undocumented, no permanent address' ELSE 'on the street with a wheelchair' END FROM requests"""


def lives(spark, sf_dir):
    return spark.sql(LIVES.format(s="STRING").replace("requests", "{r}"), r=Views(spark, sf_dir).requests)


def profile_sql():
    n = lambda p: f"coalesce(CAST({rx('q', p)} AS INT){' + 1' if 'kids' in p else ''}, 1)"
    k = f"CAST(replace({rx('q', X.INCOME_K_PATTERN)}, ',', '') AS BIGINT)"
    flags = ", ".join(f"{rxs('q', [p])} AS {c}" for c, p in X.PROFILE_FLAGS.items())
    return f"""SELECT request_id, greatest(1, {n(X.KIDS_PATTERN)}, {n(X.FAMILY_PATTERN)}, {n(X.HOUSEHOLD_PATTERN)}) AS household_size,
        CAST(CASE WHEN {k} IS NOT NULL THEN CASE WHEN {k} < 1000 THEN {k} * 1000 ELSE {k} END
             ELSE coalesce(CAST({rx('q', X.INCOME_PATTERN)} AS BIGINT), 0) END AS DOUBLE) AS annual_income, {flags},
        CASE WHEN {rxs('q', [X.HOMELESS_PATTERN])} THEN 'homeless' WHEN {rxs('q', [X.AT_RISK_PATTERN])} THEN 'at_risk' ELSE '' END AS housing_status,
        NOT {rxs('q', [X.NO_ID_PATTERN])} AS has_id FROM (SELECT *, lower(text) AS q FROM lives)"""


@query("household_profile", ctes("requests", ("lives", LIVES.format(s="VARCHAR")), body=profile_sql()))
def household_profile(spark, sf_dir):
    return X.household_profile(lives(spark, sf_dir)).drop("text")


CONCERN = table("concern", [(i, w, c, X.REASSURANCE[c]) for i, (c, ws) in enumerate(X.CONCERNS) for w in ws], "i, w, concern, reassurance")


@query("concern_flags", ctes("requests", ("lives", LIVES.format(s="VARCHAR")), CONCERN, body="""
    SELECT DISTINCT request_id, concern, reassurance FROM lives JOIN concern ON contains(lower(text), w)"""))
def concern_flags(spark, sf_dir):
    return lives(spark, sf_dir).select("request_id", F.explode(X.concern_flags()).alias("c")).select("request_id", "c.*")


# ---- Screening ----------------------------------------------------------


def screen_sql(text, reply=None):
    t = f"lower({text})"
    harmful = f"WHEN {words(f'lower({reply})', X.HARMFUL_WORDS)} THEN 'harmful_output'" if reply else ""
    return f"""CASE WHEN NOT {words(t, X.PII_EXCEPTIONS)} AND {rxs(text, X.PII_PATTERNS)} THEN 'pii_detected'
        WHEN {words(t, X.SUICIDE_WORDS)} THEN 'crisis_suicide' WHEN {words(t, X.ABUSE_WORDS)} THEN 'crisis_abuse'
        WHEN {rxs(t, X.JAILBREAK_PATTERNS)} THEN 'jailbreak_attempt'
        WHEN len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')) >= 3 AND NOT {rxs(t, X.ON_TOPIC_PATTERNS)}
             AND {rxs(t, X.OFF_TOPIC_PATTERNS)} THEN 'off_topic' {harmful} END"""


RESPONSE = "CASE reason " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in X.SCREEN_RESPONSES.items()) + " END"
SCREENED = """SELECT *, reason IS NULL AS allow, CASE reason WHEN 'crisis_suicide' THEN 'suicide' WHEN 'crisis_abuse' THEN 'abuse' END AS crisis_type,
    {response} AS replacement_response FROM (SELECT {id}, {reason} AS reason FROM {frm})"""

# Requests and what a model might answer to them.
CHATS = """SELECT request_id, CASE WHEN request_id % 19 = 0 THEN 'I want to die' WHEN request_id % 23 = 0 THEN 'who wrote the best novel about Yankees'
      WHEN request_id % 29 = 0 THEN 'what is the weather of tomorrow' WHEN request_id % 31 = 0 THEN 'movie' ELSE text END AS text,
    CASE request_id % 6 WHEN 0 THEN 'You could forge a letter' WHEN 1 THEN 'I''m sorry but that is outside my role' WHEN 2 THEN 'Go to the shelter'
      ELSE concat('Call 311 about case ', CAST(request_id AS {s})) END AS reply FROM {t}"""


def chats(spark, sf_dir):
    return spark.sql(CHATS.format(s="STRING", t="{r}").replace("I''m", "I\\'m"), r=Views(spark, sf_dir).requests)


CHAT = ("chats", CHATS.format(s="VARCHAR", t="requests"))


@query("guardrail_screen", ctes("requests", CHAT, body=SCREENED.format(
    response=RESPONSE, id="request_id", reason=screen_sql("text", "reply"), frm="chats")))
def guardrail_screen(spark, sf_dir):
    return X.guardrail_screen(chats(spark, sf_dir), "text", "reply").drop("text", "reply")


@query("guardrail_documents", f"SELECT doc_id, {screen_sql('text')} AS reason FROM documents")
def guardrail_documents(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", X.screen_reason("text").alias("reason"))


@query("guardrail_summary", f"""
    SELECT role, coalesce(reason, 'allowed') AS reason, count(*) AS n FROM (SELECT role, {screen_sql('text')} AS reason FROM conversations) GROUP BY 1, 2""")
def guardrail_summary(spark, sf_dir):
    df = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("role", "text"))
    df = df.select("role", X.screen_reason("text").alias("reason"))
    return df.groupBy("role", F.coalesce("reason", F.lit("allowed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("refusal_phrases", ctes("requests", CHAT, body=f"""
    SELECT request_id, {words('lower(reply)', X.REFUSAL_PHRASES)} AS blocked FROM chats"""))
def refusal_phrases(spark, sf_dir):
    return chats(spark, sf_dir).select("request_id", X.is_refusal("reply").alias("blocked"))


NOTES = """SELECT event_id, concat('The place at ', CASE event_id % 4 WHEN 0 THEN concat('Site ', CAST(user_id AS {s}), ' Center') WHEN 1 THEN concat(CAST(user_id AS {s}), ' main st')
      WHEN 2 THEN 'unknown road' ELSE concat('HALL ', CAST(user_id AS {s}), '!') END, CASE event_id % 6 WHEN 0 THEN ' is full' WHEN 1 THEN ' was shut, wrong sign'
      WHEN 2 THEN ' moved away' WHEN 3 THEN ' felt scary' ELSE ' was fine' END) AS text,
    concat('Site ', CAST(user_id AS {s}), ' Center') AS n1, '9 ELM ST' AS a1, concat('Hall ', CAST(user_id AS {s})) AS n2, concat(CAST(user_id AS {s}), ' MAIN ST') AS a2 FROM {t}"""
ISSUE = "CASE " + " ".join(f"WHEN {words('lower(text)', ws)} THEN '{i}'" for ws, i in X.FEEDBACK_ISSUES) + " ELSE 'other' END"
HIT = lambda n, a: f"(contains(lower(text), lower({n})) OR contains(lower(text), lower({a})))"


@query("feedback_classify", ctes(("notes", NOTES.format(s="VARCHAR", t="events")), body=f"""
    SELECT event_id, CASE WHEN {HIT('n1', 'a1')} THEN n1 WHEN {HIT('n2', 'a2')} THEN n2 ELSE 'unknown' END AS resource_name,
           CASE WHEN {HIT('n1', 'a1')} OR {HIT('n2', 'a2')} THEN {ISSUE} ELSE 'other' END AS issue FROM notes"""))
def feedback_classify(spark, sf_dir):
    df = spark.sql(NOTES.format(s="STRING", t="{e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))
    shown = F.expr("array(named_struct('name', n1, 'address', a1), named_struct('name', n2, 'address', a2))")
    return X.feedback_classify(df.withColumn("resources", shown)).select("event_id", "resource_name", "issue")


# ---- Claims -------------------------------------------------------------

CLAIM = """concat('CLAIM: "Site ', CAST(user_id AS {s}), ' in Queens"\nVERDICT: ', CASE WHEN event_id % {n} = 0 THEN 'unverified' ELSE 'VERIFIED' END, '\nEVIDENCE: row ', CAST(event_id AS {s}), '\n')"""


def transcripts(s, frm):
    one = lambda n: CLAIM.format(s=s, n=n)
    return f"""SELECT event_id, concat('Checking.\n', {one(2)}, {one(3)}, CASE WHEN event_id % 4 > 1 THEN {one(2)} ELSE '' END,
        CASE WHEN event_id % 4 = 3 THEN 'CLAIM: no verdict given\n' ELSE '' END,
        CASE WHEN event_id % 5 = 0 THEN 'OVERALL: HIGH confidence\nSUMMARY: all good ' ELSE 'OVERALL: MEDIUM' END) AS text FROM {frm}
        UNION ALL SELECT -event_id - 1, 'nothing to check' FROM {frm} WHERE event_type = 'error'"""


def transcript_df(spark, sf_dir):
    return spark.sql(transcripts("STRING", "{e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))


BLOCKS = [("t", transcripts("VARCHAR", "events")),
          ("blocks", "SELECT event_id, unnest(string_split(text, 'CLAIM:')[2:]) AS b, generate_subscripts(string_split(text, 'CLAIM:')[2:], 1) - 1 AS i FROM t"),
          ("claims", r"""SELECT event_id, CAST(i AS INT) AS position,
              regexp_replace(regexp_replace(regexp_extract(b, '(?s)^(.*?)(VERDICT:|$)', 1), '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g') AS claim,
              coalesce(nullif(upper(regexp_extract(b, '(?i)VERDICT:\s*(VERIFIED|UNVERIFIED)', 1)), ''), 'UNKNOWN') AS verdict,
              regexp_replace(regexp_extract(b, '(?s)EVIDENCE:\s*(.*?)(CLAIM:|OVERALL:|$)', 1), '^\s+|\s+$', '', 'g') AS evidence FROM blocks""")]


@query("parse_claims", ctes(*BLOCKS, body="SELECT * FROM claims"))
def parse_claims(spark, sf_dir):
    df = X.parse_claims(transcript_df(spark, sf_dir))
    return df.select("event_id", F.posexplode("claims").alias("position", "c")).select("event_id", "position", "c.*")


@query("parse_claims_cut", ctes(*BLOCKS, body="SELECT * REPLACE (substring(claim, 1, 200) AS claim, substring(evidence, 1, 200) AS evidence) FROM claims"))
def parse_claims_cut(spark, sf_dir):
    df = X.parse_claims(transcript_df(spark, sf_dir), length=200)
    return df.select("event_id", F.posexplode("claims").alias("position", "c")).select("event_id", "position", "c.*")


@query("claims_rollup", ctes(*BLOCKS, body=r"""
    , g AS (SELECT t.event_id, any_value(text) AS text, CAST(count(*) FILTER (verdict = 'VERIFIED') AS INT) AS verified_count,
            CAST(greatest(count(claim), 1) AS INT) AS total_count, count(*) FILTER (verdict = 'UNVERIFIED') AS un
            FROM t LEFT JOIN claims USING (event_id) GROUP BY 1),
    l AS (SELECT *, CASE WHEN un > 2 THEN 'LOW' WHEN contains(lower(text), 'high') AND verified_count >= total_count * CAST(0.8 AS DOUBLE) THEN 'HIGH'
            WHEN verified_count >= total_count * CAST(0.5 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM g)
    SELECT event_id, verified_count, total_count, confidence, confidence <> 'LOW' AS verified,
           coalesce(nullif(regexp_extract(text, '(?m)SUMMARY:\s*(.*?)$', 1), ''), concat(verified_count, '/', total_count, ' claims verified')) AS summary FROM l"""))
def claims_rollup(spark, sf_dir):
    return X.claims_rollup(transcript_df(spark, sf_dir)).drop("text", "claims")


SAID = """SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat(' customer#', lpad(CAST(event_id % 2000 AS {s}), 9, '0'), ' ') ELSE concat('Customer#', lpad(CAST(event_id % 2000 AS {s}), 9, '0')) END AS name,
    CASE event_id % 4 WHEN 0 THEN 'BK' WHEN 1 THEN 'QN' WHEN 2 THEN 'MN' ELSE CAST(NULL AS {s}) END AS borough FROM {t}"""


@query("claims_check", ctes("mart", ("said", SAID.format(s="VARCHAR", t="events")), body="""
    SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM mart m WHERE lower(m.name) = lower(trim(s.name)) AND (s.borough IS NULL OR m.borough = s.borough))
                THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verdict FROM said s"""))
def claims_check(spark, sf_dir):
    said = spark.sql(SAID.format(s="STRING", t="{e}"), e=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return X.claims_check(said, Views(spark, sf_dir).mart)


# ---- Rewriting ----------------------------------------------------------

PROFILE = """request_id, text, request_id % 5 <> 0 AS has_id, request_id % 2 = 0 AS has_children, request_id % 7 = 0 AS has_pregnant,
    request_id % 11 = 0 AS has_disabled, request_id % 13 = 0 AS has_senior, request_id % 3 <> 0 AS has_insurance, request_id % 17 = 0 AS is_veteran,
    request_id % 4 = 0 AS is_undocumented, CASE request_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'near a school' END AS additional_info"""


@query("enrich_query", ctes("requests", ("p", f"SELECT {PROFILE} FROM requests"), body=f"""
    SELECT request_id, concat_ws(' ', text, {', '.join(f"CASE WHEN {c} THEN {q(t)} END" for c, t in X.PROFILE_TOKENS)}, nullif(additional_info, '')) AS enriched,
           concat(regexp_replace(text, '\\.+$', ''), '. Additional info: ', 'How many kids?', ' — ', coalesce(additional_info, 'none')) AS merged FROM p"""))
def enrich_query(spark, sf_dir):
    df = spark.sql(f"SELECT {PROFILE} FROM {{r}}", r=Views(spark, sf_dir).requests)
    return df.select("request_id", X.enrich_query().alias("enriched"),
                     X.merge_query("text", "'How many kids?'", "coalesce(additional_info, 'none')").alias("merged"))


# ---- Identity cards -----------------------------------------------------

CARD = """SELECT c_custkey AS card_id, concat('STATE ID CARD\n', CASE c_custkey % 4 WHEN 0 THEN 'DL D' WHEN 1 THEN 'pt: ' ELSE '' END, CAST(1000000 + c_custkey AS {s}),
    '\n', CASE c_custkey % 3 WHEN 0 THEN 'LN DOE' WHEN 1 THEN 'inSMITH' ELSE 'LN DRIVER' END, '\n', CASE c_custkey % 5 WHEN 0 THEN 'FN JOHN' WHEN 1 THEN 'rnMARY' ELSE 'FN ANN MARIE' END,
    '\n', CASE c_custkey % 2 WHEN 0 THEN concat(CAST(c_custkey AS {s}), ' Ocean Ave') ELSE concat('12', CAST(c_custkey % 10 AS {s}), ' PLAZA SQUARE') END, '\n',
    CASE c_custkey % 4 WHEN 0 THEN 'BROOKLYN, NY 11201' WHEN 1 THEN 'ALBANY, ZZ 12207' WHEN 2 THEN 'SAN JOSE, CA095112' ELSE '' END,
    '\nDOB ', lpad(CAST(c_custkey % 12 + 1 AS {s}), 2, '0'), '/15/1980 EXP: 01/0', CAST(c_custkey % 9 + 1 AS {s}), '/2030\nSEX ', CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'm' END,
    ' EYES BRN HAIR: blk HGT 5''-0{n}" WGT ', CAST(100 + c_custkey % 150 AS {s}), ' lb') AS text FROM {t}"""


def cards(spark, sf_dir):
    text = CARD.format(s="STRING", n="9", t="{c}").replace("''-0", "\\'0")
    return spark.sql(text, c=spark.read.parquet(f"{sf_dir}/customer.parquet"))


CARDS = ("cards", CARD.format(s="VARCHAR", n="9", t="customer").replace("''-0", "''0"))


def token(e):
    t = f"regexp_replace(regexp_replace(trim({e}), ',+$', ''), '\\.+$', '')"
    return f"CASE WHEN {t} = '' OR upper({t}) IN ({', '.join(q(d) for d in X.CARD_DENY)}) OR regexp_matches({t}, '\\d') THEN NULL ELSE upper({t}) END"


PLACED = f"({token(rx('text', X.CARD_CITY, 1))}) IS NOT NULL AND {rx('text', X.CARD_CITY, 2)} IN ({', '.join(q(s) for s in X.US_STATES)})"


@query("id_text_fields", ctes(CARDS, body=f"""
    SELECT card_id, coalesce({rx('text', X.CARD_NUMBER)}, list_filter(regexp_extract_all(text, {q(X.CARD_NUMBER_ANY)}, 1), lambda n: len(n) IN (7, 8, 9))[1], '') AS id_number,
           coalesce({rx('text', X.CARD_BIRTH)}, '') AS dob, coalesce({rx('text', X.CARD_EXPIRY)}, '') AS expiration,
           coalesce(upper(trim(coalesce({rx('text', X.CARD_ADDRESS)}, {rx('text', X.CARD_ADDRESS_LINE)}))), '') AS address,
           coalesce(CASE WHEN {PLACED} THEN {token(rx('text', X.CARD_CITY, 1))} END, '') AS city,
           coalesce(CASE WHEN {PLACED} THEN {rx('text', X.CARD_CITY, 2)} END, '') AS state, coalesce(CASE WHEN {PLACED} THEN {rx('text', X.CARD_CITY, 3)} END, '') AS zip,
           coalesce(upper({rx('text', X.CARD_SEX)}), '') AS sex, coalesce(upper({rx('text', X.CARD_EYES)}), '') AS eye_color,
           coalesce(upper({rx('text', X.CARD_HAIR)}), '') AS hair_color, coalesce({rx('text', X.CARD_HEIGHT)}, '') AS height,
           coalesce({rx('text', X.CARD_WEIGHT)} || ' lb', '') AS weight FROM cards"""))
def id_text_fields(spark, sf_dir):
    return X.id_text_fields(cards(spark, sf_dir)).drop("text", "first_name", "last_name", "full_name")


# The last-name pattern looks behind for a line start; the check engine has no
# look-behind, so here the line start is part of the match instead.
LAST_SQL = X.CARD_LAST.replace(r"(?<=\n)in|(?<=^)in", r"(?:^|\n)in")


def name_sql(pattern, tight):
    loose = rx("text", pattern)
    line = f"split_part({loose}, chr(10), 1)"
    return f"CASE WHEN {loose} IS NOT NULL THEN {token(line)} ELSE {token(rx('text', tight))} END"


@query("id_text_names", ctes(CARDS, body=f"""
    , n AS (SELECT card_id, coalesce({name_sql(LAST_SQL, X.CARD_LAST_TIGHT)}, '') AS last_name,
                   coalesce({name_sql(X.CARD_FIRST, X.CARD_FIRST_TIGHT)}, '') AS f FROM cards),
    m AS (SELECT card_id, last_name, CASE WHEN f <> last_name THEN f ELSE '' END AS first_name FROM n)
    SELECT *, trim(concat(first_name, ' ', last_name)) AS full_name FROM m"""))
def id_text_names(spark, sf_dir):
    return X.id_text_fields(cards(spark, sf_dir)).select("card_id", "first_name", "last_name", "full_name")


@query("form_answers", ctes(CARDS, body=f"""
    , n AS (SELECT card_id, coalesce({name_sql(LAST_SQL, X.CARD_LAST_TIGHT)}, '') AS last_name,
                   coalesce({name_sql(X.CARD_FIRST, X.CARD_FIRST_TIGHT)}, '') AS first0,
                   coalesce({rx('text', X.CARD_BIRTH)}, '') AS dob, coalesce(upper({rx('text', X.CARD_SEX)}), '') AS sex,
                   coalesce(upper(trim(coalesce({rx('text', X.CARD_ADDRESS)}, {rx('text', X.CARD_ADDRESS_LINE)}))), '') AS address,
                   coalesce(CASE WHEN {PLACED} THEN {token(rx('text', X.CARD_CITY, 1))} END, '') AS city FROM cards),
    f AS (SELECT *, CASE WHEN first0 <> last_name THEN first0 ELSE '' END AS first_name FROM n)
    """ + " UNION ALL ".join(f"SELECT card_id, '{label}' AS label, {c} AS value FROM f" for label, c in (
        ("last name", "last_name"), ("first name", "first_name"), ("date of birth", "dob"), ("sex", "sex"), ("address", "address"), ("city", "city")))))
def form_answers(spark, sf_dir):
    return X.form_answers(X.id_text_fields(cards(spark, sf_dir)), "card_id")
