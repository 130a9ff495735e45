"""Case views over the event log."""

from pyspark.sql import functions as F

from ..functions.session import materialise
from ..operators import cases as C
from ..operators import rules as K
from .registry import Views, ctes, query
from .rule_queries import DOC, PROTOCOL, RIGHT, q

# Tables a case consists of, read off the log by rule.
TABLES = {
    "needs": """SELECT case_id, category, CAST(min(event_id) % 5 + 1 AS INT) AS priority, max_by(CASE action WHEN 'identify' THEN 'open'
        WHEN 'choose' THEN 'in_progress' WHEN 'checkin_no' THEN 'open' ELSE 'resolved' END, event_id) AS status
        FROM {e} WHERE (case_id + event_id) % 7 > 3 OR action IN ('identify', 'resolve') GROUP BY case_id, category""",
    "failed": """SELECT case_id, event_id, ts, category, resource AS name, 'did not arrive' AS reason FROM {e} WHERE action = 'checkin_no' AND event_id % 11 = 0""",
    "feedback": """SELECT case_id, event_id, ts, resource, CASE event_id % 4 WHEN 0 THEN 'was Full' WHEN 1 THEN 'closed' WHEN 2 THEN 'nice' ELSE 'felt unsafe' END AS feedback
        FROM {e} WHERE action = 'checkin_no'""",
    "visits": """SELECT case_id, event_id, ts, concat('help with ', category) AS query FROM {e} WHERE action = 'choose'""",
    "visited": """SELECT case_id, event_id, ts, resource AS name, CASE WHEN event_id % 2 = 0 THEN 'arrived ok' END AS feedback FROM {e} WHERE action = 'checkin_yes'""",
    "intents": """SELECT case_id, event_id, ts, resource, CASE action WHEN 'choose' THEN 'intent_confirmed' WHEN 'checkin_yes' THEN 'arrived'
        WHEN 'checkin_no' THEN 'cancelled' ELSE 'resolved' END AS state FROM {e} WHERE action <> 'identify'""",
    "raised": """SELECT case_id, event_id, ts, CASE WHEN category IN ('housing', 'safety') THEN 'sponsored_ride' ELSE 'document_help' END AS type, category AS reason
        FROM {e} WHERE action = 'identify'""",
    "closed": """SELECT case_id, event_id, ts, CASE WHEN category IN ('housing', 'safety') THEN 'sponsored_ride' ELSE 'document_help' END AS type
        FROM {e} WHERE action = 'resolve' AND event_id % 3 = 0""",
}


class Tables:
    def __init__(self, spark, sf_dir):
        self.spark, self.events = spark, Views(spark, sf_dir).case_events

    def __getattr__(self, name):
        return self.spark.sql(TABLES[name], e=self.events)


def tables(*names):
    return ["case_events"] + [(n, TABLES[n].format(e="case_events")) for n in names]



@query("case_flatten", """
    SELECT event_id AS case_id, NULL AS category, NULL AS status FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, event_type, 'open' FROM events WHERE event_id % 3 > 0
    UNION ALL SELECT event_id, 'food', 'resolved' FROM events WHERE event_id % 3 = 2""")
def case_flatten(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS case_id", """CASE event_id % 3
        WHEN 1 THEN array(named_struct('category', event_type, 'status', 'open'))
        WHEN 2 THEN array(named_struct('category', event_type, 'status', 'open'), named_struct('category', 'food', 'status', 'resolved')) END AS needs""")
    return C.case_flatten(docs, "needs")


# One step of the fold per event of a case, for every category at once.
FOLD = """
    , ev AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS n FROM case_events),
    cats AS (SELECT DISTINCT case_id, category FROM case_events WHERE action = 'identify'),
    st(case_id, category, n, status, chosen, n_failed) AS (
      SELECT case_id, category, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0 FROM cats
      UNION ALL
      SELECT s.case_id, s.category, e.n,
        CASE WHEN e.action = 'identify' AND e.category = s.category AND s.status IS NULL THEN 'open'
             WHEN e.action = 'choose' AND e.category = s.category AND s.status = 'open' THEN 'in_progress'
             WHEN e.action = 'checkin_yes' AND s.status = 'in_progress' AND s.chosen = e.resource THEN 'resolved'
             WHEN e.action = 'checkin_no' AND s.status = 'in_progress' AND s.chosen = e.resource THEN 'open'
             WHEN e.action = 'resolve' AND e.category = s.category AND s.status IS NOT NULL THEN 'resolved' ELSE s.status END,
        CASE WHEN e.action = 'choose' AND e.category = s.category AND s.status = 'open' THEN e.resource
             WHEN e.action = 'checkin_no' AND s.status = 'in_progress' AND s.chosen = e.resource THEN NULL ELSE s.chosen END,
        s.n_failed + CASE WHEN e.action = 'checkin_no' AND s.status = 'in_progress' AND s.chosen = e.resource THEN 1 ELSE 0 END
      FROM st s JOIN ev e ON e.case_id = s.case_id AND e.n = s.n + 1)
    SELECT case_id, category, status, chosen AS chosen_resource, CAST(n_failed AS BIGINT) AS n_failed FROM st
    QUALIFY row_number() OVER (PARTITION BY case_id, category ORDER BY n DESC) = 1"""
FOLD_SQL = ctes("case_events", body=FOLD).replace("WITH ", "WITH RECURSIVE ", 1)


def folded(spark, sf_dir, **kw):
    needs = C.current_needs(C.fold_case_events(Views(spark, sf_dir).case_events, **kw))
    return needs.select("case_id", "category", "status", "chosen_resource", "n_failed")


@query("case_fold", FOLD_SQL)
def case_fold(spark, sf_dir):
    return folded(spark, sf_dir)


@query("case_fold_sliced", FOLD_SQL)   # the path of crowded cases, forced by a low bound
def case_fold_sliced(spark, sf_dir):
    return folded(spark, sf_dir, chunk_rows=40)


COUNT = lambda s: f"count(*) FILTER (status = '{s}')"


@query("case_progress", ctes(*tables("needs"), body=f"""
    SELECT case_id, count(*) AS total_needs, {COUNT('resolved')} AS resolved_count, {COUNT('in_progress')} AS in_progress_count,
           {COUNT('open')} AS open_count, string_agg(concat(category, ':', status, ':', CAST(priority AS VARCHAR)), ', ' ORDER BY priority, category) AS needs
    FROM needs GROUP BY 1"""))
def case_progress(spark, sf_dir):
    df = C.case_progress(Tables(spark, sf_dir).needs)
    return df.withColumn("needs", F.expr("array_join(transform(needs, n -> concat(n.category, ':', n.status, ':', CAST(n.priority AS STRING))), ', ')"))


@query("failed_resources", ctes(*tables("failed", "feedback"), body="""
    SELECT case_id, name FROM failed UNION SELECT case_id, resource FROM feedback"""))
def failed_resources(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.failed_resources(t.failed, t.feedback)


LIST = ("listed", """SELECT case_id, coalesce(open_needs, 0) AS open_needs, coalesce(total_visits, 0) AS total_visits, last_visit FROM
    (SELECT case_id, count(*) FILTER (status = 'open') AS open_needs FROM needs GROUP BY 1) FULL JOIN
    (SELECT case_id, count(*) AS total_visits, max(ts) AS last_visit FROM visits GROUP BY 1) USING (case_id)""")


@query("case_list", ctes(*tables("needs", "visits"), LIST, body="SELECT * FROM listed"))
def case_list(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.case_list(t.needs, t.visits)


def summary_sql(last_query, places):
    return """
    , n AS (SELECT case_id, coalesce(string_agg(category, ', ' ORDER BY priority, category) FILTER (status = 'open'), '') AS open_needs,
            coalesce(string_agg(category, ', ' ORDER BY priority, category) FILTER (status = 'resolved'), '') AS resolved FROM needs GROUP BY 1),
    v AS (SELECT case_id, max(ts) AS last_visit, {QUERY} AS last_query FROM visits GROUP BY 1),
    p AS (SELECT case_id, string_agg(name, ', ' ORDER BY ts, event_id) AS visited FROM (SELECT * FROM visited {PLACES}) GROUP BY 1),
    f AS (SELECT case_id, count(*) FILTER (regexp_matches(lower(feedback), 'full|closed|wrong|unsafe')) AS negative_reports FROM feedback GROUP BY 1)
    SELECT n.*, last_visit, last_query, visited, coalesce(negative_reports, 0) AS negative_reports
    FROM n LEFT JOIN v USING (case_id) LEFT JOIN p USING (case_id) LEFT JOIN f USING (case_id)""".replace("{QUERY}", last_query).replace("{PLACES}", places)


@query("case_summary", ctes(*tables("needs", "visits", "visited", "feedback"), body=summary_sql("arg_max(query, (ts, event_id))", "")))
def case_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.case_summary(t.needs, t.visits, t.visited, t.feedback)


@query("case_summary_short", ctes(*tables("needs", "visits", "visited", "feedback"), body=summary_sql(
    "substring(arg_max(query, (ts, event_id)), 1, 80)", "QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC) <= 3")))
def case_summary_short(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.case_summary(t.needs, t.visits, t.visited, t.feedback, places=3, query_length=80)


URGENT = ("urgent", """SELECT case_id, CASE WHEN crit THEN 'critical' WHEN hi THEN CASE WHEN f < 2 THEN 'high' ELSE 'critical' END
    WHEN op THEN 'medium' ELSE 'low' END AS urgency, f AS failed_count FROM (
    SELECT case_id, bool_or(status <> 'resolved' AND category IN ('safety', 'domestic_violence', 'emergency_services')) AS crit,
           bool_or(status <> 'resolved' AND category IN ('housing', 'shelter', 'medical', 'mental_health')) AS hi, bool_or(status <> 'resolved') AS op FROM needs GROUP BY 1)
    LEFT JOIN (SELECT case_id, count(*) AS f0 FROM failed GROUP BY 1) USING (case_id), LATERAL (SELECT coalesce(f0, 0) AS f)""")


@query("urgency", ctes(*tables("needs", "failed"), URGENT, body="SELECT * FROM urgent"))
def urgency(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.urgency(t.needs, t.failed)


DEST = ("dest", """SELECT case_id, resource, CAST(ts AS DATE) AS day, arg_max(state, (ts, event_id)) AS state, min(ts) AS intent_at, max(ts) AS updated_at
    FROM intents GROUP BY 1, 2, 3""")
BOARD = tables("needs", "visits", "failed", "intents") + [LIST, URGENT, DEST, ("board", """
    SELECT l.*, u.urgency, u.failed_count, coalesce(a.n, 0) AS active_destinations,
           CASE u.urgency WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS urgency_order
    FROM listed l LEFT JOIN urgent u USING (case_id)
    LEFT JOIN (SELECT case_id, count(*) AS n FROM dest WHERE state NOT IN ('resolved', 'cancelled') GROUP BY 1) a USING (case_id)""")]


def board(t):
    return C.admin_board(t.needs, t.visits, t.failed, C.destination_upsert(t.intents))


@query("admin_board", ctes(*BOARD, body="SELECT * FROM board"))
def admin_board(spark, sf_dir):
    return board(Tables(spark, sf_dir))


@query("city_stats", ctes(*tables("needs", "visits", "failed"), URGENT, body="""
    SELECT 'total_cases' AS stat, '' AS key, count(*) AS value FROM (SELECT case_id FROM needs UNION SELECT case_id FROM visits)
    UNION ALL SELECT 'total_visits', '', count(*) FROM visits
    UNION ALL SELECT 'open_needs', '', count(*) FROM needs WHERE status <> 'resolved'
    UNION ALL SELECT 'resolved_needs', '', count(*) FROM needs WHERE status = 'resolved'
    UNION ALL SELECT 'urgency', urgency, count(*) FROM urgent GROUP BY 2
    UNION ALL (SELECT 'need', category, count(*) AS n FROM needs GROUP BY 2 ORDER BY n DESC, category LIMIT 8)"""))
def city_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.city_stats(t.needs, t.visits, t.failed)


@query("open_tickets", ctes(*tables("raised", "closed"), body="""
    , c AS (SELECT case_id, type, max((ts, event_id)) AS last FROM closed GROUP BY 1, 2)
    SELECT r.case_id, r.type, min(r.ts) AS raised_at, arg_min(r.reason, (r.ts, r.event_id)) AS reason
    FROM raised r LEFT JOIN c USING (case_id, type) WHERE c.last IS NULL OR (r.ts, r.event_id) > c.last GROUP BY 1, 2"""))
def open_tickets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.open_tickets(t.raised, t.closed)


@query("destination_upsert", ctes(*tables("intents"), DEST, body="SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM dest"))
def destination_upsert(spark, sf_dir):
    return C.destination_upsert(Tables(spark, sf_dir).intents).withColumn("day", F.col("day").cast("string"))


@query("active_destinations", ctes(*tables("intents"), DEST, body="""
    SELECT case_id, resource, CAST(day AS VARCHAR) AS day, state FROM dest WHERE state NOT IN ('resolved', 'cancelled')"""))
def active_destinations(spark, sf_dir):
    df = C.active_destinations(C.destination_upsert(Tables(spark, sf_dir).intents))
    return df.select("case_id", "resource", F.col("day").cast("string").alias("day"), "state")


LAST = "QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC) <= {n}"
STAMP = "concat('[', strftime(ts, '%Y-%m-%d %H:%M'), '] ', {0})"
def history_sql(last, asked):
    return ("history", f"""
    SELECT case_id, kind, line, CAST(row_number() OVER (PARTITION BY case_id ORDER BY line, event_id, kind) AS INT) AS position FROM (
      (SELECT case_id, 'visit' AS kind, event_id, {STAMP.format(asked)} AS line FROM visits {last(8)})
      UNION ALL (SELECT case_id, 'feedback', event_id, {STAMP.format("'Feedback — ', resource, ': ', feedback")} FROM feedback {last(5)})
      UNION ALL (SELECT case_id, 'failed', event_id, {STAMP.format("'Failed resource: ', name, ' — ', reason")} FROM failed {last(5)})
      UNION ALL (SELECT case_id, 'visited', event_id, {STAMP.format("'Visited: ', name, ' — ', coalesce(feedback, 'arrived')")} FROM visited {last(5)}))""")


HISTORY = history_sql(lambda n: "", "'Query: ', query")
SHORT_HISTORY = history_sql(lambda n: LAST.format(n=n), "'Query: ', substring(query, 1, 100)")


@query("history_timeline", ctes(*tables("visits", "feedback", "failed", "visited"), HISTORY, body="SELECT * FROM history"))
def history_timeline(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.history_timeline(t.visits, t.feedback, t.failed, t.visited)


@query("history_timeline_short", ctes(*tables("visits", "feedback", "failed", "visited"), SHORT_HISTORY, body="SELECT * FROM history"))
def history_timeline_short(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.history_timeline(t.visits, t.feedback, t.failed, t.visited, keep=C.HISTORY_KEEP, query_length=100)


FOOD = "SELECT * FROM board WHERE case_id IN (SELECT case_id FROM needs WHERE category = 'food' AND status <> 'resolved')"


@query("case_filter", ctes(*BOARD, body=FOOD))
def case_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.case_filter(board(t), t.needs, open_need="Food")


@query("case_filter_first", ctes(*BOARD, body=FOOD + " ORDER BY least(urgency_order, 2), last_visit DESC, case_id LIMIT 20"))
def case_filter_first(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.case_filter(board(t), t.needs, open_need="Food", limit=20)


NEED = "CASE resource_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.TYPE_TO_NEED.items()) + " ELSE resource_type END"


@query("type_to_need", ctes("mart", body=f"SELECT resource_id, {NEED} AS need FROM mart"))
def type_to_need(spark, sf_dir):
    return Views(spark, sf_dir).mart.select("resource_id", C.type_to_need("resource_type").alias("need"))


# ---- Briefing -----------------------------------------------------------

ARRIVE = ("arrivals", """SELECT DISTINCT d.case_id, m.resource_id, m.name AS resource_name, m.resource_type, m.address
    FROM dest d JOIN mart m ON m.row_key = CAST(replace(d.resource, 'site_', '') AS BIGINT) WHERE d.state NOT IN ('resolved', 'cancelled')""")
STORY_LIST = "CASE " + " ".join(f"WHEN first = '{n}' THEN {q(', '.join([i for i, ns, *_ in K.STORIES if n in ns][:2]))}"
                                for n in sorted({n for _, ns, *_ in K.STORIES for n in ns})) + f" ELSE {q(', '.join(i for i, *_ in K.STORIES[:2]))} END"
PROTOCOL_FIRST = "list_filter(ol, lambda n: list_contains([" + ", ".join(q(k) for k in K.PROTOCOLS) + "], n))[1]"


@query("intake_briefing", ctes("mart", *tables("needs", "visits", "failed", "feedback", "visited", "intents"), DEST, URGENT, HISTORY, ARRIVE, DOC, RIGHT, PROTOCOL, body=f"""
    , n AS (SELECT case_id, coalesce(list(category ORDER BY priority, category) FILTER (status <> 'resolved'), []) AS ol,
            coalesce(string_agg(concat(category, ' (P', CAST(priority AS VARCHAR), ')'), ', ' ORDER BY priority, category) FILTER (status <> 'resolved'), 'None identified yet') AS os,
            count(*) FILTER (status = 'resolved') AS resolved_needs_count FROM needs GROUP BY 1),
    v AS (SELECT case_id, count(*) AS total_visits FROM visits GROUP BY 1),
    h AS (SELECT case_id, string_agg(line, chr(10) ORDER BY position) AS history FROM history GROUP BY 1),
    dc AS (SELECT kind, string_agg(concat(doc, ' [', CASE WHEN required THEN 'high' ELSE 'low' END, '] or ', substitute), '; ' ORDER BY i) AS docs FROM docs GROUP BY 1),
    rt AS (SELECT kind, string_agg(right_name, '; ' ORDER BY i) AS rights FROM rights GROUP BY 1),
    x AS (SELECT a.*, coalesce(n.ol, []) AS ol, coalesce(n.os, 'None identified yet') AS os, coalesce(n.resolved_needs_count, 0) AS resolved_needs_count, u.urgency,
          coalesce(u.failed_count, 0) AS failed_count, coalesce(total_visits, 0) AS total_visits, coalesce(history, 'No prior history on record.') AS history,
          coalesce(n.ol, [])[1] AS first FROM arrivals a LEFT JOIN n USING (case_id) LEFT JOIN urgent u USING (case_id) LEFT JOIN v USING (case_id) LEFT JOIN h USING (case_id))
    SELECT case_id, resource_id, resource_name, resource_type, address, urgency, failed_count, total_visits, resolved_needs_count, history,
           CAST(len(ol) AS INT) AS open_needs_count,
           coalesce((SELECT text FROM protocol p WHERE p.kind = {PROTOCOL_FIRST}), (SELECT text FROM protocol p WHERE p.kind = x.resource_type), 'Standard intake process applies.') AS service_protocol,
           dc.docs AS required_docs, rt.rights, {STORY_LIST} AS stories,
           concat('Client has ', len(ol), ' open need(s): ', os, '. Arriving at ', resource_name, ' after ',
                  CASE WHEN failed_count > 0 THEN concat('failing at ', failed_count, ' prior resource(s)') ELSE 'first attempt' END,
                  '. Confidence: medium (based on case data, no LLM analysis available).') AS diagnosis,
           concat('Follow standard ', resource_type, ' intake. Review ', len(ol), ' open need(s) before starting. Be patient — client may have experienced multiple service failures.') AS recommended_approach,
           concat('Please bring any ID you have and go to ', coalesce(nullif(address, ''), resource_name), '. Ask for the intake worker when you arrive.') AS pre_arrival_instructions
    FROM x JOIN dc ON dc.kind = CASE WHEN x.resource_type IN (SELECT kind FROM dc) THEN x.resource_type ELSE 'default' END
    JOIN rt ON rt.kind = CASE WHEN x.resource_type IN (SELECT kind FROM rt) THEN x.resource_type ELSE 'default' END"""))
def intake_briefing(spark, sf_dir):
    t, m = Tables(spark, sf_dir), Views(spark, sf_dir).mart
    return C.intake_briefing(arrivals(t, m), t.needs, t.visits, t.failed, C.history_timeline(t.visits, t.feedback, t.failed, t.visited))


def arrivals(t, mart):
    dest = C.active_destinations(C.destination_upsert(t.intents)).select(
        "case_id", F.expr("CAST(replace(resource, 'site_', '') AS BIGINT)").alias("row_key")).distinct()
    return dest.join(mart, "row_key").select("case_id", "resource_id", F.col("name").alias("resource_name"), "resource_type", "address")


@query("intake_briefing_full")   # with evidence and alternatives, whose own queries are checked
def intake_briefing_full(spark, sf_dir):
    from ..operators import evidence as G
    from ..operators import vectors as V
    from .triple_queries import whole_store
    from .vector_queries import feature_table
    t, v = Tables(spark, sf_dir), Views(spark, sf_dir)
    m = v.mart
    coming = materialise(arrivals(t, m), "arrivals")
    facts = G.explain_recommendation(whole_store(v))
    vectors = materialise(feature_table(spark, sf_dir).join(m.select("resource_id", "borough", "name"), "resource_id"), "vectors")
    asked = vectors.join(coming.select("resource_id").distinct(), "resource_id", "left_semi")
    near = V.similar_topk(vectors, asked, 3, group="borough", id_col="resource_id")
    near = near.join(m.select("resource_id", "name"), "resource_id")
    return C.intake_briefing(coming, t.needs, t.visits, t.failed,
                             C.history_timeline(t.visits, t.feedback, t.failed, t.visited), facts, near)
