"""Live case tracking: the event log as a stream.

State is kept per key in the state store; event time drives every timer.
Rows of one call are put in (ts, event_id) order first. Events later than the
watermark are dropped, as the batch twins drop nothing: the two agree on a log
whose disorder stays within the delay.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.session import work_path
from ..functions.text import in_set
from ..operators.cases import (TRANSITION_COLUMNS, _changes, dump_state, fold_case_events,
                               load_state, replay, with_event_columns)

# Fixed values
SLA_MINUTES = 15
FOLLOWUP_MINUTES = 30
CLOSING_ACTIONS = ["checkin_yes", "checkin_no", "resolve"]
DELAY = "1 hour"
DELAY_MS = 3_600_000

# Timers compare event time with the watermark, so rows must show it in UTC.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.session.timeZone": "UTC",
}


def prepare_session(spark) -> None:
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)


def event_stream(spark, path: str, schema, files_per_trigger=2) -> DataFrame:
    """The event log as a stream with event time as TIMESTAMP."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
            .withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY))


def run_to_table(stream: DataFrame, name: str, mode="append") -> DataFrame:
    """Process all available input into a table and read it back."""
    spark = stream.sparkSession
    out, checkpoint = work_path(spark, name), work_path(spark, f"{name}-checkpoint")
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _in_order(rows):
    pdf = pd.concat(list(rows), ignore_index=True)
    return pdf.sort_values(["ts", "event_id"], kind="stable")


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


class CaseState(StatefulProcessor):
    """Needs of one case, changed by the same replay as the batch fold."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.needs = handle.getValueState("needs", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows, timerValues):
        state = load_state(self.needs.get()[0]) if self.needs.exists() else {}
        pdf = _in_order(rows)
        out = pd.DataFrame(_changes(pdf, state), columns=TRANSITION_COLUMNS)
        self.needs.update((dump_state(state),))
        if len(out):
            yield out

    def close(self) -> None:
        pass


CHANGE_SCHEMA = ("case_id long, event_id long, ts timestamp, category string, action string, resource string, "
                 "from_status string, to_status string, priority int")


def case_state_stream(events: DataFrame) -> DataFrame:
    """Need changes as they happen."""
    return with_event_columns(events).groupBy("case_id").transformWithStateInPandas(
        CaseState(), outputStructType=CHANGE_SCHEMA, outputMode="Append", timeMode="EventTime")


ALERT_SCHEMA = "case_id long, resource string, opened_at_ms long, due_at_ms long"


class SlaAlert(StatefulProcessor):
    """One alert for each place of a case when it was chosen and not settled in time.

    A row later than the deadline proves it passed even before the watermark
    does; the timer covers places that fall silent. A case keeps its places
    (place -> [opened, done]) and one timer, at the earliest deadline open.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([
            StructField("json", StringType()), StructField("timer", LongType())]))

    def _keep(self, places, timer):
        """Store the places, and have the timer stand at the earliest deadline; ``timer``: where it stands."""
        due = min((opened + SLA_MINUTES * 60_000 for opened, done in places.values() if not done), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((dump_state(places), due))

    def _alerts(self, key, places, late):
        return pd.DataFrame([(key[0], p, places[p][0], places[p][0] + SLA_MINUTES * 60_000) for p in late],
                            columns=["case_id", "resource", "opened_at_ms", "due_at_ms"])

    def handleInputRows(self, key, rows, timerValues):
        text, timer = self.state.get() if self.state.exists() else ("", None)
        places, late = load_state(text), []
        for e in _in_order(rows).itertuples(index=False):
            place = places.get(e.resource)
            if place is None:
                if e.action == "choose":
                    places[e.resource] = [_ms(e.ts), 0]
            elif place[1]:
                continue
            elif _ms(e.ts) > place[0] + SLA_MINUTES * 60_000:
                place[1] = 1
                late.append(e.resource)
            elif e.action in CLOSING_ACTIONS:
                place[1] = 1
        if places:
            self._keep(places, timer)
        if late:
            yield self._alerts(key, places, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        text, timer = self.state.get()
        places, fired = load_state(text), expiredTimerInfo.getExpiryTimeInMs()
        if timer != fired:
            return
        # deadlines that the watermark has passed as well would not get a timer of their own in this batch
        last = max(fired, timerValues.getCurrentWatermarkInMs())
        late = [p for p, (opened, done) in places.items() if not done and opened + SLA_MINUTES * 60_000 <= last]
        for p in late:
            places[p][1] = 1
        self._keep(places, None)   # the timer that fired is gone
        yield self._alerts(key, places, late)

    def close(self) -> None:
        pass


def sla_alerts_stream(events: DataFrame) -> DataFrame:
    cols = events.select("case_id", "resource", "event_id", "ts", "action")
    return cols.groupBy("case_id").transformWithStateInPandas(
        SlaAlert(), outputStructType=ALERT_SCHEMA, outputMode="Append", timeMode="EventTime")


def sla_alerts(events: DataFrame) -> DataFrame:
    """Batch twin: first choices not settled within the limit.

    Per (case, resource) the first choice, the first settling after it and
    the last event are all partial aggregates; no events are paired.
    """
    at = F.struct("ts", "event_id")
    limit = F.expr(f"INTERVAL {SLA_MINUTES} MINUTES")
    first = events.where("action = 'choose'").groupBy("case_id", "resource").agg(F.min(at).alias("_open"))
    closing = F.expr(in_set("action", CLOSING_ACTIONS))
    later = events.join(first, ["case_id", "resource"]).groupBy("case_id", "resource", "_open").agg(
        F.min(F.when(closing & (at > F.col("_open")), F.col("ts"))).alias("_closed"), F.max("ts").alias("_last"))
    due = F.col("_open.ts") + limit
    watermark = events.agg((F.max("ts") - F.expr(f"INTERVAL {DELAY}")).alias("w")).scalar()
    out = later.where((F.col("_closed").isNull() | (F.col("_closed") > due)) & ((F.col("_last") > due) | (due <= watermark)))
    ms = lambda c: F.expr(f"timestampdiff(MILLISECOND, CAST('1970-01-01 00:00:00' AS {events.schema['ts'].dataType.simpleString()}), {c})")
    return out.select("case_id", "resource", ms("_open.ts").alias("opened_at_ms"),
                      (ms("_open.ts") + SLA_MINUTES * 60_000).alias("due_at_ms"))


FOLLOWUP_SCHEMA = "case_id long, due_at_ms long, open_needs int, in_progress_needs int"


class Followup(StatefulProcessor):
    """One follow-up per case, half an hour after its first event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([
            StructField("due", LongType()), StructField("done", IntegerType()), StructField("json", StringType())]))

    def _report(self, key, due, needs):
        self.state.update((due, 1, ""))
        count = lambda s: sum(n[0] == s for n in needs.values())
        return pd.DataFrame([(key[0], due, count("open"), count("in_progress"))],
                            columns=["case_id", "due_at_ms", "open_needs", "in_progress_needs"])

    def handleInputRows(self, key, rows, timerValues):
        due, done, text = self.state.get() if self.state.exists() else (None, 0, "")
        if done:
            return
        needs, known = load_state(text), due is not None
        for e in _in_order(rows).itertuples(index=False):
            at = _ms(e.ts)
            if due is None:
                due = at + FOLLOWUP_MINUTES * 60_000
            if at > due:
                if known:
                    self.handle.deleteTimer(due)
                yield self._report(key, due, needs)
                return
            for _ in replay([e], needs):
                pass
        self.state.update((due, 0, dump_state(needs)))
        if not known:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due, done, text = self.state.get()
        if not done:
            yield self._report(key, due, load_state(text))

    def close(self) -> None:
        pass


def followup_stream(events: DataFrame) -> DataFrame:
    return with_event_columns(events).groupBy("case_id").transformWithStateInPandas(
        Followup(), outputStructType=FOLLOWUP_SCHEMA, outputMode="Append", timeMode="EventTime")


def followups(events: DataFrame) -> DataFrame:
    """Batch twin: the state of each case half an hour after its first event."""
    kind = events.schema["ts"].dataType.simpleString()
    ms = lambda c: F.expr(f"timestampdiff(MILLISECOND, CAST('1970-01-01 00:00:00' AS {kind}), {c})")
    first = events.groupBy("case_id").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    due = ms("_first") + FOLLOWUP_MINUTES * 60_000
    watermark = events.agg(F.max("ts").alias("_m")).select((ms("_m") - DELAY_MS).alias("w")).scalar()
    ready = first.withColumn("due_at_ms", due).where((ms("_last") > F.col("due_at_ms")) | (F.col("due_at_ms") <= watermark))
    early = events.join(ready.select("case_id", "due_at_ms"), "case_id").where(ms("ts") <= F.col("due_at_ms")).drop("due_at_ms")
    now = fold_case_events(early).groupBy("case_id", "category").agg(F.max_by("to_status", F.struct("ts", "event_id")).alias("s"))
    count = now.groupBy("case_id").agg(F.count_if(F.col("s") == "open").cast("int").alias("open_needs"),
                                       F.count_if(F.col("s") == "in_progress").cast("int").alias("in_progress_needs"))
    return ready.select("case_id", "due_at_ms").join(count, "case_id", "left").fillna(0)


def dedup_stream(events: DataFrame) -> DataFrame:
    """Each event once, however often it is delivered within the delay."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def live_exclusions(feedback: DataFrame, table: str, checkpoint: str) -> None:
    """Keep a table of reported resource names current from a feedback stream.

    Each micro-batch writes its new names under its own batch id, so a batch
    that is run again after a failure replaces itself.
    """
    def upsert(batch, batch_id):
        names = batch.select(F.col("resource").alias("name")).distinct()
        names.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
    q = (feedback.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_exclusions(spark, table: str) -> DataFrame:
    return spark.read.parquet(table).select("name").distinct()
