"""Streaming queries over the event log, each checked like its batch twin."""

from pyspark.sql import functions as F

from ..functions.session import work_path
from ..operators.lookup import exclude_reported
from ..streaming import cases as S
from .case_queries import FOLD_SQL
from .registry import Views, ctes, query


#: Files of one micro-batch.
FILES = 64


def log(spark, sf_dir, copies=1):
    """The event log as it grows: one write per ten days."""
    S.prepare_session(spark)
    ev = Views(spark, sf_dir).case_events
    path = work_path(spark, "event-log")
    for i in range(3):
        part = ev.where(f"least(2, floor((dayofmonth(ts) - 1) / 10)) = {i}")
        for _ in range(copies):
            part.write.mode("append").parquet(path)
    return S.event_stream(spark, path, ev.schema, FILES)


@query("case_state_stream", FOLD_SQL.replace(
    "SELECT case_id, category, status, chosen AS chosen_resource, CAST(n_failed AS BIGINT) AS n_failed FROM st",
    "SELECT case_id, category, status FROM st"))
def case_state_stream(spark, sf_dir):
    changes = S.run_to_table(S.case_state_stream(log(spark, sf_dir)), "case-state")
    return changes.groupBy("case_id", "category").agg(F.max_by("to_status", F.struct("ts", "event_id")).alias("status"))


SLA = ctes("case_events", body="""
    , f AS (SELECT case_id, resource, min((ts, event_id)) AS o FROM case_events WHERE action = 'choose' GROUP BY 1, 2),
    j AS (SELECT f.case_id, f.resource, o[1] AS opened, min(e.ts) FILTER (e.action IN ('checkin_yes', 'checkin_no', 'resolve') AND (e.ts, e.event_id) > o) AS closed,
                 max(e.ts) AS last FROM f JOIN case_events e USING (case_id, resource) GROUP BY 1, 2, 3)
    SELECT case_id, resource, epoch_us(opened) // 1000 AS opened_at_ms, epoch_us(opened) // 1000 + 900000 AS due_at_ms FROM j
    WHERE (closed IS NULL OR closed > opened + INTERVAL 15 MINUTES)
      AND (last > opened + INTERVAL 15 MINUTES OR opened + INTERVAL 15 MINUTES <= (SELECT max(ts) FROM case_events) - INTERVAL 1 HOUR)""")


@query("sla_alerts", SLA)
def sla_alerts(spark, sf_dir):
    return S.sla_alerts(Views(spark, sf_dir).case_events)


@query("sla_alerts_stream", SLA)
def sla_alerts_stream(spark, sf_dir):
    return S.run_to_table(S.sla_alerts_stream(log(spark, sf_dir)), "sla-alerts")


FOLLOW = FOLD_SQL.replace("FROM case_events)", "FROM case_events JOIN (SELECT case_id AS c0, (epoch_us(min(ts)) // 1000) + 1800000 AS due FROM case_events GROUP BY 1) ON c0 = case_id AND (epoch_us(ts) // 1000) <= due)", 1)
FOLLOW = FOLLOW[:FOLLOW.rindex("SELECT case_id, category, status, chosen AS")] + """
    SELECT d.case_id, d.due AS due_at_ms, CAST(count(*) FILTER (status = 'open') AS INT) AS open_needs, CAST(count(*) FILTER (status = 'in_progress') AS INT) AS in_progress_needs
    FROM (SELECT case_id, (epoch_us(min(ts)) // 1000) + 1800000 AS due, (epoch_us(max(ts)) // 1000) AS last FROM case_events GROUP BY 1) d
    LEFT JOIN (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY case_id, category ORDER BY n DESC) = 1) s USING (case_id)
    WHERE last > due OR due <= (SELECT (epoch_us(max(ts)) // 1000) - 3600000 FROM case_events) GROUP BY 1, 2"""


@query("followups", FOLLOW)
def followups(spark, sf_dir):
    return S.followups(Views(spark, sf_dir).case_events)


@query("followup_once", FOLLOW)
def followup_once(spark, sf_dir):
    return S.run_to_table(S.followup_stream(log(spark, sf_dir)), "followups")


@query("event_dedup", ctes("case_events", body="SELECT event_id, case_id, action FROM case_events"))
def event_dedup(spark, sf_dir):
    return S.run_to_table(S.dedup_stream(log(spark, sf_dir, copies=2)).select("event_id", "case_id", "action"), "dedup")


@query("live_exclusions", ctes("mart", "case_events", body="""
    SELECT resource_id, name FROM mart WHERE concat('site_', CAST(row_key AS VARCHAR)) NOT IN (SELECT resource FROM case_events WHERE action = 'checkin_no')"""))
def live_exclusions(spark, sf_dir):
    table = work_path(spark, "exclusions")
    S.live_exclusions(log(spark, sf_dir).where("action = 'checkin_no'"), table, work_path(spark, "exclusions-checkpoint"))
    mart = Views(spark, sf_dir).mart.withColumn("display", F.col("name")).withColumn("name", F.expr("concat('site_', CAST(row_key AS STRING))"))
    return exclude_reported(mart, S.read_exclusions(spark, table)).select("resource_id", F.col("display").alias("name"))
