"""Subject / predicate / object rows with a confidence and a source."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_even
from ..functions.text import literal, lookup, quote
from .lookup import POPULATION
from .spatial import radius_count, radius_pairs

# ---- Fixed values -------------------------------------------------------

CONFIDENCE = {
    "spatial_exact": 1.00, "identity": 1.00, "classification": 0.95, "cross_dataset": 0.80,
    "computed": 0.75, "temporal_stale": 0.60, "pluto_zoning": 0.90,
}
RADIUS_DEGREES = 500 / 111320
# Places of one piece of a cell, paired with all places that reach the cell.
PLACE_ROWS = 500
CRIME_CATEGORIES = {
    "violent": ["FELONY ASSAULT", "ASSAULT 3 & RELATED OFFENSES", "ROBBERY", "SEX CRIMES",
                "DANGEROUS WEAPONS", "MURDER"],
    "property": ["PETIT LARCENY", "GRAND LARCENY", "BURGLARY", "GRAND LARCENY OF MOTOR VEHICLE",
                 "CRIMINAL MISCHIEF"],
    "drugs": ["DANGEROUS DRUGS", "INTOXICATED & IMPAIRED DRIVING"],
    "harassment": ["HARRASSMENT 2", "OFF. AGNST PUB ORD SENSBLTY &"],
}
COMPLAINT_CATEGORIES = {
    "unsanitary": ["UNSANITARY CONDITION"],
    "heating": ["HEAT/HOT WATER"],
    "structural": ["PLUMBING", "PAINT/PLASTER", "DOOR/WINDOW", "WATER LEAK", "FLOORING/STAIRS",
                   "OUTSIDE BUILDING"],
    "safety": ["SAFETY", "Safety", "ELEVATOR", "ELECTRIC"],
    "general": ["GENERAL", "APPLIANCE"],
}
LANDUSE_LABELS = {
    "01": "one_two_family", "02": "multi_family", "03": "mixed_residential", "04": "commercial",
    "05": "industrial", "06": "vacant", "07": "outdoor_recreation", "08": "assembly_community",
    "09": "open_space", "10": "parking", "11": "institutional",
}
# (complaint type, descriptor) -> issue, severity, who it affects
IMPACTS = {
    ("SAFETY", None): ("safety_hazard", "high", "all"),
    ("ELEVATOR", None): ("elevator_broken", "high", "elderly,disabled"),
    ("ELECTRIC", "NO LIGHTING"): ("no_lighting", "high", "all"),
    ("ELECTRIC", "POWER OUTAGE"): ("power_outage", "critical", "all"),
    ("UNSANITARY CONDITION", "PESTS"): ("pest_infestation", "high", "children,health"),
    ("UNSANITARY CONDITION", "MOLD"): ("mold", "high", "children,health"),
    ("UNSANITARY CONDITION", "GARBAGE/RECYCLING STORAGE"): ("garbage_hazard", "medium", "all"),
    ("HEAT/HOT WATER", "ENTIRE BUILDING"): ("no_heat_building", "critical", "all"),
    ("HEAT/HOT WATER", "APARTMENT ONLY"): ("no_heat_unit", "high", "all"),
    ("WATER LEAK", "HEAVY FLOW"): ("major_water_leak", "high", "all"),
    ("WATER LEAK", "SLOW LEAK"): ("minor_water_leak", "low", "property"),
    ("PLUMBING", "WATER SUPPLY"): ("no_water", "critical", "all"),
    ("PLUMBING", "TOILET"): ("toilet_broken", "high", "all"),
    ("PLUMBING", "BATHTUB/SHOWER"): ("plumbing_broken", "medium", "all"),
    ("FLOORING/STAIRS", "FLOOR"): ("floor_damage", "medium", "elderly,children"),
    ("DOOR/WINDOW", "DOOR"): ("broken_door", "medium", "security"),
    ("DOOR/WINDOW", "WINDOW FRAME"): ("broken_window", "medium", "all"),
    ("PAINT/PLASTER", "CEILING"): ("ceiling_damage", "medium", "all"),
    ("PAINT/PLASTER", "WALL"): ("wall_damage", "low", "all"),
}
TYPE_IMPACTS = {
    "HEAT/HOT WATER": ("heating_problem", "high", "all"),
    "UNSANITARY CONDITION": ("unsanitary", "high", "children,health"),
    "PLUMBING": ("plumbing_issue", "medium", "all"),
    "PAINT/PLASTER": ("structural_wear", "low", "all"),
    "DOOR/WINDOW": ("access_issue", "medium", "security"),
    "WATER LEAK": ("water_leak", "medium", "all"),
    "GENERAL": ("general_complaint", "low", "all"),
    "ELECTRIC": ("electrical_issue", "medium", "all"),
    "FLOORING/STAIRS": ("structural_hazard", "medium", "elderly,children"),
    "APPLIANCE": ("appliance_broken", "low", "all"),
    "SAFETY": ("safety_hazard", "high", "all"),
    "ELEVATOR": ("elevator_broken", "high", "elderly,disabled"),
    "OUTSIDE BUILDING": ("exterior_damage", "low", "all"),
}
SEVERITY_CONFIDENCE = {"critical": 0.95, "high": 0.85, "medium": 0.75, "low": 0.65}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
ISSUE_FACTOR, SEVERITY_FACTOR, AFFECTS_FACTOR, DATE_CONFIDENCE = 0.85, 0.90, 0.80, 0.95
MODEL_CONFIDENCE = 0.70

COLUMNS = ["subject", "predicate", "object_val", "confidence", "source"]

# ---- Building blocks ----------------------------------------------------


def emit(df: DataFrame, subject: str, rows, named=True) -> DataFrame:
    """Triples of each row: (predicate, object SQL, confidence, source).

    The predicate is a name, or SQL text with ``named=False``.

    One array per row is filtered and exploded, so a wide table becomes
    triples in a single pass. A null object gives no triple.
    """
    def one(p, o, c, s):
        pred = quote(p) if named else p
        conf = literal(c) if isinstance(c, float) else c
        return (f"named_struct('predicate', {pred}, 'object_val', CAST({o} AS STRING), "
                f"'confidence', {conf}, 'source', {quote(s)})")
    body = ", ".join(one(*r) for r in rows)
    df = df.select(F.expr(subject).alias("subject"),
                   F.explode(F.expr(f"filter(array({body}), t -> t.object_val IS NOT NULL)")).alias("t"))
    return df.select("subject", "t.*")


LOCATION = ("CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL "
            "THEN format_string('%.6f,%.6f', latitude, longitude) END")


def resource_triples(mart: DataFrame) -> DataFrame:
    c = CONFIDENCE
    return emit(mart, "resource_id", [
        ("HAS_TYPE", "resource_type", c["classification"], "dohmh"),
        ("HAS_NAME", "name", c["identity"], "dohmh"),
        ("HAS_ADDRESS", "address", c["identity"], "dohmh"),
        ("IN_BOROUGH", "borough", c["spatial_exact"], "dohmh"),
        ("HAS_LOCATION", LOCATION, c["spatial_exact"], "dohmh"),
        ("HAS_CAPACITY", "CASE WHEN capacity > 0 THEN CAST(capacity AS BIGINT) END", c["identity"], "dhs"),
        ("NEAREST_TRANSIT", "nearest_transit_name", c["cross_dataset"], "mta_gtfs"),
        ("TRANSIT_WALK_MIN", "CASE WHEN nearest_transit_name IS NOT NULL THEN "
                             "rint(nearest_transit_walk_min * 10D) / 10D END", c["cross_dataset"], "mta_gtfs"),
    ])


def category(c: str, categories: dict) -> Column:
    """Exact, case-sensitive category of a value; anything else is 'other'."""
    flat = {v: k for k, vs in categories.items() for v in vs}
    return F.expr(lookup(c, flat, "'other'"))


def crime_category(c="ofns_desc") -> Column:
    return category(c, CRIME_CATEGORIES)


def complaint_category(c="complaint_type") -> Column:
    return category(c, COMPLAINT_CATEGORIES)


def _near_counts(mart, points, cat, prefix, source):
    """Counts per (resource, category) in one grid join for all categories."""
    n = radius_count(mart.select("resource_id", "latitude", "longitude"),
                     points.withColumn("_cat", cat), RADIUS_DEGREES, "resource_id",
                     metric="degrees", by="_cat")
    return n.select(F.col("resource_id").alias("subject"),
                    F.concat(F.lit(prefix), F.upper("_cat"), F.lit("_500M")).alias("predicate"),
                    F.col("n").cast("string").alias("object_val"),
                    F.lit(CONFIDENCE["cross_dataset"]).alias("confidence"), F.lit(source).alias("source"))


def crime_triples(mart, incidents) -> DataFrame:
    return _near_counts(mart, incidents, crime_category(), "CRIME_", "nypd")


def complaint_triples(mart, complaints) -> DataFrame:
    return _near_counts(mart, complaints, complaint_category(), "COMPLAINTS_", "311")


def score_triples(mart: DataFrame) -> DataFrame:
    c = CONFIDENCE["computed"]
    return emit(mart, "resource_id", [
        ("SAFETY_SCORE", "rint(safety_score * 1000D) / 1000D", c, "nypd_derived"),
        ("QUALITY_SCORE", "rint(quality_score * 1000D) / 1000D", c, "311_derived")])


LANDUSE_LABEL = lookup("landuse", LANDUSE_LABELS, "landuse")


def lot_rollup_triples(lots: DataFrame) -> DataFrame:
    """Lots per borough, and per borough and land use, in one grouping pass."""
    known = lots.where(F.col("borough").isNotNull()).select("borough", "landuse")
    sets = known.groupingSets([["borough"], ["borough", "landuse"]], "borough", "landuse").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("landuse").alias("_total"))
    sets = sets.where("_total = 1 OR landuse IS NOT NULL")
    pred = F.when(F.col("_total") == 1, F.lit("TOTAL_LOTS")).otherwise(
        F.concat(F.lit("LOTS_"), F.upper(F.expr(LANDUSE_LABEL))))
    return sets.select(F.concat(F.lit("boro_"), "borough").alias("subject"), pred.alias("predicate"),
                       F.col("n").cast("string").alias("object_val"),
                       F.lit(CONFIDENCE["pluto_zoning"]).alias("confidence"), F.lit("pluto").alias("source"))


def lot_triples(lots: DataFrame) -> DataFrame:
    c = CONFIDENCE
    return emit(lots.where("is_overflow_candidate"), "CAST(bbl AS STRING)", [
        ("IS_OVERFLOW_CANDIDATE", "'True'", c["pluto_zoning"], "pluto"),
        ("HAS_ADDRESS", "address", c["identity"], "pluto"),
        ("IN_BOROUGH", "borough", c["spatial_exact"], "pluto"),
        ("LANDUSE", LANDUSE_LABEL, c["pluto_zoning"], "pluto"),
        ("OWNER", "ownername", c["identity"], "pluto"),
        ("NUM_FLOORS", "CAST(numfloors AS BIGINT)", c["identity"], "pluto"),
        ("YEAR_BUILT", "CASE WHEN yearbuilt > 0 THEN CAST(yearbuilt AS BIGINT) END", c["identity"], "pluto"),
        ("HAS_LOCATION", LOCATION, c["spatial_exact"], "pluto")])


def station_triples(stations: DataFrame) -> DataFrame:
    c = CONFIDENCE
    lines = "line_name" if "line_name" in stations.columns else "subway_lines"
    return emit(stations, "concat('station_', CAST(station_id AS STRING))", [
        ("HAS_TYPE", "'transit_station'", c["identity"], "mta_gtfs"),
        ("HAS_NAME", "name", c["identity"], "mta_gtfs"),
        ("IN_BOROUGH", "borough", c["spatial_exact"], "mta_gtfs"),
        ("HAS_LOCATION", LOCATION, c["spatial_exact"], "mta_gtfs"),
        ("SERVES_LINES", lines, c["identity"], "mta_gtfs")])


def colocation_pairs(mart: DataFrame, radius=RADIUS_DEGREES) -> DataFrame:
    """Pairs (a < b) of different types within the radius of each other; tasks share the places of a cell."""
    side = lambda p: mart.select(F.col("resource_id").alias(f"{p}_id"), F.col("resource_type").alias(f"{p}_type"),
                                 F.col("latitude").alias(f"{p}_lat"), F.col("longitude").alias(f"{p}_lon"))
    pairs = radius_pairs(side("l"), side("r"), radius, radius, "degrees", piece_rows=PLACE_ROWS)
    return pairs.where("l_id < r_id AND l_type <> r_type").select("l_id", "r_id")


def colocation_triples(mart: DataFrame) -> DataFrame:
    return colocation_pairs(mart).select(
        F.col("l_id").alias("subject"), F.lit("CO_LOCATED_WITH").alias("predicate"),
        F.col("r_id").alias("object_val"), F.lit(CONFIDENCE["cross_dataset"]).alias("confidence"),
        F.lit("spatial_derived").alias("source"))


def density_triples(mart: DataFrame) -> DataFrame:
    """Population, totals and per-100k rates by borough and borough x type."""
    spark, c = mart.sparkSession, CONFIDENCE["computed"]
    codes = ", ".join(f"named_struct('borough', {quote(b)}, 'p', {p})" for b, p in POPULATION.items())
    people = spark.range(1).select(F.explode(F.expr(f"array({codes})")).alias("b")).select("b.*")
    pop = emit(people, "concat('boro_', borough)", [
        ("HAS_POPULATION", "p", CONFIDENCE["temporal_stale"], "acs_census")])
    known = mart.where(F.col("borough").isin(list(POPULATION))).select("borough", "resource_type")
    sets = known.groupingSets([["borough"], ["borough", "resource_type"]], "borough", "resource_type").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("resource_type").alias("_total"))
    sets = sets.where("_total = 1 OR resource_type IS NOT NULL").withColumn(
        "rate", round_even(F.col("n") / F.expr(lookup("borough", POPULATION, "1")) * F.lit(100000.0), 1))
    name = "CASE WHEN _total = 1 THEN {0} ELSE {1} END"
    total = name.format("'TOTAL_RESOURCES'", "concat('COUNT_', upper(resource_type))")
    rate = name.format("'RESOURCES_PER_100K'", "concat(upper(resource_type), '_PER_100K')")
    rows = emit(sets, "concat('boro_', borough)", [
        (total, "n", c, "mart_derived"), (rate, "rate", c, "mart_derived")], named=False)
    return pop.unionByName(rows)


def triple_stats(triples: DataFrame) -> DataFrame:
    """One (stat, key, value) table: totals, per-source counts, top predicates."""
    one = triples.agg(F.count(F.lit(1)).cast("double").alias("n_triples"),
                      F.countDistinct("subject").cast("double").alias("n_subjects"),
                      F.countDistinct("predicate").cast("double").alias("n_predicates"),
                      round_even(F.avg("confidence"), 3).alias("mean_confidence"))
    names = ["n_triples", "n_subjects", "n_predicates", "mean_confidence"]
    totals = one.select(F.expr("stack(4, " + ", ".join(f"'{n}', {n}" for n in names) + ") AS (stat, value)"))
    count = lambda c: triples.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    by_source = count("source").select(F.lit("source").alias("stat"), "key", "value")
    top = (count("predicate").orderBy(F.desc("value"), "key").limit(20)
           .select(F.lit("predicate").alias("stat"), "key", "value"))
    return totals.select("stat", F.lit("").alias("key"), "value").unionByName(by_source).unionByName(top)


def build_triples(mart, incidents, complaints, lots, stations, colocated=True) -> DataFrame:
    """Triples of all kinds; without ``colocated`` the pairs of places are left for the caller to add."""
    parts = [resource_triples(mart), crime_triples(mart, incidents), complaint_triples(mart, complaints),
             score_triples(mart), lot_rollup_triples(lots), lot_triples(lots), station_triples(stations)]
    if colocated:
        parts.append(colocation_triples(mart))
    parts.append(density_triples(mart))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- Complaint facts ----------------------------------------------------


def issue_rules(complaints: DataFrame) -> DataFrame:
    """Add issue, severity, affects: by type and descriptor, by type, default."""
    impact = lambda v: "named_struct('issue', {}, 'severity', {}, 'affects', {})".format(*map(quote, v))
    table = lambda d: "map(" + ", ".join(f"{quote(k)}, {impact(v)}" for k, v in d.items()) + ")"
    exact = table({f"{t}|{d}": v for (t, d), v in IMPACTS.items() if d})
    typed = table({t: v for (t, d), v in IMPACTS.items() if d is None})
    default = ("named_struct('issue', lower(replace(complaint_type, '/', '_')), 'severity', 'low', 'affects', 'all')")
    rule = (f"coalesce(element_at({exact}, concat(complaint_type, '|', descriptor)), "
            f"element_at({typed}, complaint_type), element_at({table(TYPE_IMPACTS)}, complaint_type), {default})")
    return complaints.withColumn("_i", F.expr(rule)).select("*", "_i.*").drop("_i")


def complaint_fact_triples(complaints: DataFrame, address_length=None) -> DataFrame:
    """Three or four triples per complaint about its address.

    Addresses are kept in full unless ``address_length`` cuts them.
    """
    df = complaints.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
                          & F.col("complaint_type").isNotNull())
    conf = lambda f: lookup("severity", {s: round(v * f, 3) for s, v in SEVERITY_CONFIDENCE.items()},
                            literal(round(0.7 * f, 3)))
    address = "replace(coalesce(incident_address, 'unknown'), ' ', '_')"
    if address_length:
        address = f"substring({address}, 1, {address_length})"
    subject = f"concat('addr_', {address}, '_', coalesce(borough, ''))"
    return emit(issue_rules(df), subject, [
        ("HAS_ISSUE", "issue", conf(ISSUE_FACTOR), "311_txt2kg"),
        ("ISSUE_SEVERITY", "severity", conf(SEVERITY_FACTOR), "311_txt2kg"),
        ("AFFECTS_POPULATION", "affects", conf(AFFECTS_FACTOR), "311_txt2kg"),
        ("ISSUE_DATE", "nullif(substring(CAST(created_at AS STRING), 1, 10), '')", DATE_CONFIDENCE, "311_txt2kg")])


def address_issues(triples: DataFrame) -> DataFrame:
    """Per address: issue count, distinct issues, worst severity.

    One pass; the distinct issues are few kinds, so a busy address stays a
    small partial aggregate.
    """
    issue, severity = F.col("predicate") == "HAS_ISSUE", F.col("predicate") == "ISSUE_SEVERITY"
    rank = F.expr(lookup("object_val", SEVERITY_RANK, "0"))
    out = triples.where(issue | severity).groupBy("subject").agg(
        F.count_if(issue).alias("issue_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(issue, F.col("object_val")))), ", ").alias("issues"),
        F.max(F.when(severity, rank)).alias("_rank"))
    back = {v: k for k, v in SEVERITY_RANK.items()}
    return (out.where("issue_count > 0").withColumn("worst_severity", F.expr(lookup("_rank", back)))
            .drop("_rank"))


def worst_addresses(issues: DataFrame, n=10) -> DataFrame:
    return issues.orderBy(F.desc("issue_count"), "subject").limit(n)


def parse_model_triples(replies: DataFrame, text="text") -> DataFrame:
    """Add ``parsed``: the array of {s, p, o} a model reply holds, else null."""
    raw = F.regexp_replace(F.regexp_replace(text, r"```(?:json)?\s*", ""), r"^\s+|\s+$", "")
    start = F.locate("[", raw)
    body = F.when(raw.startswith("["), raw).when(start > 0, F.substring(raw, start, F.length(raw))).otherwise(raw)
    ends = body.endswith("]")
    parsed = F.from_json(F.when(ends, body), "array<struct<s: string, p: string, o: string>>")
    return replies.withColumn("parsed", parsed)


def model_triples(replies: DataFrame, text="text") -> DataFrame:
    """Triples of every reply that parses."""
    t = parse_model_triples(replies, text).select(F.explode("parsed").alias("t"))
    blank = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(""))
    return t.select(blank("s").alias("subject"), blank("p").alias("predicate"), blank("o").alias("object_val"),
                    F.lit(MODEL_CONFIDENCE).alias("confidence"), F.lit("311_llm_txt2kg").alias("source"))
