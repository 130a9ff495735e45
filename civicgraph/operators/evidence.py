"""Questions over the triple store: filters, multi-hop paths, explanations."""

from functools import reduce

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.numeric import round_even
from ..functions.text import lookup, quote

# ---- Fixed values -------------------------------------------------------

PRIORITY_PREDICATES = ["HAS_TYPE", "IN_BOROUGH", "SAFETY_SCORE", "QUALITY_SCORE", "NEAREST_TRANSIT",
                       "TRANSIT_WALK_MIN", "CRIME_VIOLENT_500M", "COMPLAINTS_UNSANITARY_500M"]
POPULATION_CONFIDENCE, MART_CONFIDENCE = 0.60, 0.75
# Emergency chain: (predicate or None, text, confidence, source)
EMERGENCY_HOPS = [
    ("COUNT_SHELTER", "Shelters in {b}: {v}", 0.95, "mart_derived"),
    ("LOTS_ASSEMBLY_COMMUNITY", "Assembly-zoned overflow sites in {b}: {v}", 0.90, "pluto"),
    ("COUNT_FOOD_BANK", "Food banks in {b}: {v}", 0.95, "mart_derived"),
    (None, "Shelter data source: DOHMH facilities registry (official)", 0.95, "dohmh"),
    (None, "Overflow sites from PLUTO zoning (landuse=08, assembly)", 0.90, "pluto"),
    (None, "Distance sort: Euclidean from borough centroid", 0.85, "spatial_derived"),
]
# Provenance hops per intent and scenario: (confidence, source)
INTENT_HOPS = {
    "lookup": [(1.0, "user_query"), (0.95, "dohmh"), (0.80, "nypd + 311 cross-dataset"), (0.95, "mart_derived")],
    "cold_emergency": [(1.0, "user_query"), (0.95, "dohmh_shelters"), (0.90, "pluto_zoning"),
                       (0.85, "spatial_derived"), (0.95, "dohmh")],
    "resource_gap": [(1.0, "user_query"), (0.95, "mart_derived"), (0.60, "acs_census (hardcoded)"),
                     (0.75, "mart_derived")],
    "capacity_change": [(1.0, "user_query"), (0.90, "simulation"), (0.75, "mart_derived")],
    "migrant_allocation": [(1.0, "user_query"), (0.70, "dohmh (language data sparse)"),
                           (0.85, "allocation_algorithm")],
}
NEEDS_HEAD = [(1.0, "user_query"), (0.85, "nemotron_planning")]
NEEDS_EACH = (0.85, "nemotron_planning")
NEEDS_TAIL = (0.95, "mart + graph")
HIGH_BAND, MODERATE_BAND = 0.7, 0.4


def query_triples(triples: DataFrame, subject=None, predicate=None, object_val=None, source=None,
                  min_confidence=0.0) -> DataFrame:
    """Any conjunction of conditions; all of them reach the scan."""
    given = {"subject": subject, "predicate": predicate, "object_val": object_val, "source": source}
    for c, v in given.items():
        if v is not None:
            triples = triples.where(F.col(c) == (str(v) if c != "source" else v))
    return triples.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else triples


def with_cumulative(hops: DataFrame, keys, order="hop") -> DataFrame:
    """Running product of confidence along each short chain."""
    run = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return hops.withColumn("cumulative", round_even(F.product("confidence").over(run), 3))


def best_triples(triples: DataFrame, predicate: str) -> DataFrame:
    """Per subject the most confident triple of one predicate, ties by object."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "object_val", "source")).alias("b")
    return (triples.where(F.col("predicate") == predicate).groupBy("subject").agg(best)
            .select(F.col("subject").alias("_s"), F.col("b.object_val").alias("object"),
                    (-F.col("b.c")).alias("confidence"), F.col("b.source").alias("source")))


def traverse_path(starts: DataFrame, triples: DataFrame, predicates, start="start") -> DataFrame:
    """Follow a chain of predicates from many starting subjects at once.

    An object that is itself a subject becomes the next hop's subject; a
    missing triple ends the path with NOT_FOUND. Each hop joins on a
    one-row-per-subject side, however many paths stand on one subject.
    """
    entities = triples.select(F.col("subject").alias("_e")).distinct()
    here = starts.select(F.col(start).alias("start"), F.col(start).alias("subject"), F.lit(1.0).alias("_cum"))
    hops = []
    for i, pred in enumerate(predicates):
        step = here.join(best_triples(triples, pred), F.col("subject") == F.col("_s"), "left")
        found = F.col("object").isNotNull()
        step = step.withColumn("_cum", F.when(found, F.col("_cum") * F.col("confidence")).otherwise(F.lit(0.0)))
        hops.append(step.select(
            "start", F.lit(i + 1).alias("hop"), "subject", F.lit(pred).alias("predicate"),
            F.coalesce("object", F.lit("NOT_FOUND")).alias("object"),
            F.coalesce(round_even("confidence", 3), F.lit(0.0)).alias("confidence"),
            round_even("_cum", 3).alias("cumulative"), F.coalesce("source", F.lit("—")).alias("source")))
        step = step.where(found).join(entities, F.col("object") == F.col("_e"), "left")
        here = step.select("start", F.when(F.col("_e").isNotNull(), F.col("object"))
                           .otherwise(F.col("subject")).alias("subject"), "_cum")
    return reduce(lambda a, b: a.unionByName(b), hops)


def explain_underserved(triples: DataFrame) -> DataFrame:
    """Per borough: population, totals, ranking and the three weakest types."""
    boro = triples.where(F.col("subject").startswith("boro_")).withColumn(
        "borough", F.expr("substring(subject, 6)"))
    first = lambda p: F.min(F.when(F.col("predicate") == p, F.col("object_val")))
    facts = boro.groupBy("borough").agg(
        F.coalesce(first("HAS_POPULATION").cast("long"), F.lit(0)).alias("pop"),
        F.coalesce(first("TOTAL_RESOURCES").cast("long"), F.lit(0)).alias("total"),
        F.coalesce(first("RESOURCES_PER_100K").cast("double"), F.lit(0.0)).alias("rate"),
        first("RESOURCES_PER_100K").cast("double").alias("_known"))
    ranking = facts.where("_known IS NOT NULL").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rate", "borough"))),
        lambda r: F.concat(r.borough, F.lit("="), r.rate.cast("string"))), ", ").alias("r")).scalar()
    hops = facts.withColumn("_ranking", ranking).select("borough", F.explode(F.expr(f"""array(
        named_struct('hop', 1, 'fact', concat(borough, ' has population ', format_number(pop, 0)),
                     'confidence', {POPULATION_CONFIDENCE}D, 'source', 'acs_census'),
        named_struct('hop', 2, 'fact', concat(borough, ' has ', format_number(total, 0), ' total resources'),
                     'confidence', {MART_CONFIDENCE}D, 'source', 'mart_derived'),
        named_struct('hop', 3, 'fact', concat("That's ", CAST(rate AS STRING), ' resources per 100K residents'),
                     'confidence', {MART_CONFIDENCE}D, 'source', 'mart_derived'),
        named_struct('hop', 4, 'fact', concat('Borough ranking (low→high): ', coalesce(_ranking, '')),
                     'confidence', {MART_CONFIDENCE}D, 'source', 'mart_derived'))""")).alias("h")).select("borough", "h.*")
    rates = boro.where(F.col("predicate").endswith("_PER_100K")).select(
        "borough", F.lower(F.replace("predicate", F.lit("_PER_100K"), F.lit(""))).alias("kind"),
        F.col("object_val").cast("double").alias("v"))
    low = W.partitionBy("borough").orderBy("v", "kind")
    weakest = rates.withColumn("rn", F.row_number().over(low)).where("rn <= 3").select(
        "borough", (F.col("rn") + 4).alias("hop"),
        F.concat(F.lit("Lowest coverage: "), "kind", F.lit(" at "), F.col("v").cast("string"), F.lit(" per 100K")).alias("fact"),
        F.lit(MART_CONFIDENCE).alias("confidence"), F.lit("mart_derived").alias("source"))
    return with_cumulative(hops.unionByName(weakest), ["borough"])


def explain_recommendation(triples: DataFrame) -> DataFrame:
    """The priority facts of every subject in order, with running confidence."""
    order = {p: i + 1 for i, p in enumerate(PRIORITY_PREDICATES)}
    total = triples.groupBy("subject").agg(F.count(F.lit(1)).alias("total_triples"))
    one = (triples.where(F.col("predicate").isin(PRIORITY_PREDICATES)).groupBy("subject", "predicate")
           .agg(F.max(F.struct("object_val", "confidence", "source")).alias("f")))
    hops = one.select("subject", F.expr(lookup("predicate", order, "0")).alias("hop"),
                      F.concat("predicate", F.lit(": "), "f.object_val").alias("fact"),
                      "f.confidence", "f.source")
    return with_cumulative(hops, ["subject"]).join(total, "subject")


def explain_emergency(triples: DataFrame) -> DataFrame:
    """Counts a cold-emergency plan rests on, then its fixed provenance hops."""
    boro = triples.where(F.col("subject").startswith("boro_")).withColumn(
        "borough", F.expr("substring(subject, 6)"))
    preds = [p for p, *_ in EMERGENCY_HOPS if p]
    facts = boro.groupBy("borough").agg(*[
        F.min(F.when(F.col("predicate") == p, F.col("object_val"))).alias(p) for p in preds])

    def hop(p, text, conf, source):
        if not p:
            fact = quote(text)
        else:
            a, b = text.split("{b}")
            fact = f"concat({quote(a)}, borough, {quote(b.split('{v}')[0])}, {p})"
        return f"named_struct('fact', {fact}, 'confidence', {conf}D, 'source', {quote(source)})"
    rows = ", ".join(hop(*h) for h in EMERGENCY_HOPS)
    hops = facts.select("borough", F.posexplode(F.expr(f"filter(array({rows}), h -> h.fact IS NOT NULL)")).alias("i", "h"))
    return with_cumulative(hops.select("borough", (F.col("i") + 1).alias("hop"), "h.*"), ["borough"])


def reasoning_chain(plans: DataFrame, key="request_id") -> DataFrame:
    """Provenance hops of every plan with running confidence and a band.

    ``plans``: key, intent, scenario (for simulate), n_needs. Chains are built
    and multiplied inside the row, so nothing is shuffled.
    """
    step = lambda c, s: f"named_struct('confidence', CAST({c} AS DOUBLE), 'source', {quote(s)})"
    arr = lambda hs: "array(" + ", ".join(step(*h) for h in hs) + ")"
    needs = f"concat({arr(NEEDS_HEAD)}, array_repeat({step(*NEEDS_EACH)}, CAST(n_needs AS INT)), array({step(*NEEDS_TAIL)}))"
    whens = " ".join(f"WHEN scenario = {quote(k)} THEN {arr(v)}" for k, v in INTENT_HOPS.items() if k != "lookup")
    chain = (f"CASE WHEN intent = 'lookup' THEN {arr(INTENT_HOPS['lookup'])} "
             f"WHEN intent = 'needs_assessment' THEN {needs} "
             f"WHEN intent = 'simulate' THEN CASE {whens} ELSE {arr([(1.0, 'user_query')])} END END")
    df = plans.withColumn("_h", F.expr(chain)).select(key, "intent", F.expr("""transform(_h, (h, i) -> named_struct(
        'hop', i + 1, 'confidence', h.confidence, 'source', h.source, 'cumulative',
        rint(aggregate(slice(_h, 1, i + 1), 1D, (a, x) -> a * x.confidence) * 1000D) / 1000D))""").alias("h"))
    df = df.withColumn("_last", F.element_at("h", -1)["cumulative"])
    band = F.when(F.col("_last") >= HIGH_BAND, "high").when(F.col("_last") >= MODERATE_BAND, "moderate").otherwise("limited")
    return df.withColumn("band", band).select(key, "intent", "band", F.explode("h").alias("h")).select(
        key, "intent", "band", "h.*")
