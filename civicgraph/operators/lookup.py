"""Ranked lookup over the mart and what-if aggregates."""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.numeric import WALK_M_PER_MIN, col, haversine_miles, planar_m2, round_even
from ..functions.session import materialise
from ..functions.text import first_match, literal, lookup, quote, structs
from .clean import norm_borough
from .spatial import knn

# ---- Fixed values -------------------------------------------------------

LOOKUP_BOROUGHS = {
    "manhattan": "MN", "mn": "MN", "midtown": "MN", "mta": "MN", "new york": "MN", "nyc": "MN",
    "brooklyn": "BK", "bk": "BK",
    "queens": "QN", "qn": "QN",
    "bronx": "BX", "bx": "BX", "the bronx": "BX",
    "staten island": "SI", "si": "SI",
}
TYPE_EXPANSION = {
    "medical": ["hospital", "clinic", "mental_health"],
    "healthcare": ["hospital", "clinic", "mental_health"],
    "health": ["hospital", "clinic", "mental_health"],
    "housing": ["shelter", "nycha", "dropin_center"],
    "food": ["food_bank"],
    "education": ["school", "childcare", "education"],
    "safety": ["domestic_violence", "emergency_services"],
    "legal": ["legal_aid"],
    "benefits": ["benefits_center"],
    "employment": ["community_center"],
    "documents": ["benefits_center"],
    "senior": ["senior_services"],
    "childcare": ["childcare"],
    "mental_health": ["mental_health"],
    "substance": ["mental_health"],
    "dv": ["domestic_violence"],
}
BOROUGH_CENTROIDS = {
    "MN": (40.7831, -73.9712), "BK": (40.6501, -73.9496), "QN": (40.7282, -73.7949),
    "BX": (40.8448, -73.8648), "SI": (40.5795, -74.1502),
}
# Ordered overlapping boxes as conditions on latitude and longitude.
BOROUGH_BOXES = [
    ("{lat} > 40.8 AND {lon} > -73.93", "BX"),
    ("{lat} > 40.7 AND {lon} > -74.01 AND {lon} < -73.9", "MN"),
    ("{lat} < 40.7 AND {lon} < -73.85", "BK"),
    ("{lat} > 40.7 AND {lon} > -73.85 AND {lon} < -73.7", "QN"),
    ("{lat} < 40.65 AND {lon} < -74.05", "SI"),
]
POPULATION = {"BK": 2600000, "QN": 2300000, "MN": 1600000, "BX": 1500000, "SI": 500000}
DEFAULT_POPULATION = 500000
GAP_TYPES = ["shelter", "food_bank", "hospital"]
MAP_COLUMNS = ["resource_id", "resource_type", "name", "address", "borough",
               "latitude", "longitude", "safety_score"]
SHELTER_SITES, OVERFLOW_SITES, FOOD_SITES = 8, 5, 3

# ---- Expressions --------------------------------------------------------


def expand_types(types: str) -> Column:
    """Categories to mart types, without repeats; unknown ones stay."""
    pairs = ", ".join(f"{quote(k)}, array({', '.join(quote(v) for v in vs)})" for k, vs in TYPE_EXPANSION.items())
    return F.expr(f"""array_distinct(flatten(transform({types},
        t -> coalesce(element_at(map({pairs}), lower(trim(t))), array(t)))))""")


def lookup_borough(c: str) -> Column:
    """Normalised borough of a request; empty counts as none."""
    return F.when(F.length(F.col(c)) > 0, norm_borough(c, LOOKUP_BOROUGHS))


def borough_from_point(lat="latitude", lon="longitude") -> Column:
    """First box that holds the point, else the nearest centroid in degrees."""
    near = "array_min(array({}))['code']".format(", ".join(
        f"named_struct('d', ({lat} - {la}D) * ({lat} - {la}D) + ({lon} - {lo}D) * ({lon} - {lo}D), "
        f"'i', {i}, 'code', {quote(code)})" for i, (code, (la, lo)) in enumerate(BOROUGH_CENTROIDS.items())))
    boxes = [(cond.format(lat=lat, lon=lon), quote(code)) for cond, code in BOROUGH_BOXES]
    return F.expr(first_match(boxes, near))


def with_distance(df: DataFrame, lat, lon) -> DataFrame:
    """Add distance_miles (999 without coordinates) and walk_min_est."""
    here = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    miles = haversine_miles(F.lit(lat) if isinstance(lat, float) else lat,
                            F.lit(lon) if isinstance(lon, float) else lon, "latitude", "longitude")
    df = df.withColumn("distance_miles", F.when(here, miles).otherwise(F.lit(999.0)))
    return df.withColumn("walk_min_est", round_even(F.col("distance_miles") * F.lit(20.0)).cast("int"))


def sort_by_distance(df: DataFrame, lat, lon, tie="resource_id") -> DataFrame:
    return with_distance(df, lat, lon).orderBy("distance_miles", tie)


def exclude_reported(df: DataFrame, reported: DataFrame, name="name") -> DataFrame:
    """Drop resources whose name was reported."""
    return df.join(reported.select(F.col(name)).distinct(), name, "left_anti")


def soft_filter(df: DataFrame, keys, match: Column) -> DataFrame:
    """Keep matching rows of each key, or all of its rows when none match.

    Whether a key has any match is a partially aggregated flag joined back,
    so no key's rows ever have to meet in one task.
    """
    df = df.withColumn("_match", F.coalesce(match, F.lit(False)))
    if not keys:
        hit = df.agg(F.coalesce(F.max("_match"), F.lit(False)).alias("_any")).scalar()
        return df.where(F.col("_match") | ~hit).drop("_match")
    hit = df.groupBy(*keys).agg(F.max("_match").alias("_any"))
    return df.join(hit, keys).where(F.col("_match") | ~F.col("_any")).drop("_match", "_any")


def _score_order():
    return [F.desc_nulls_last("safety_score"), F.desc_nulls_last("quality_score"), F.asc("resource_id")]


def ranked_lookup(mart: DataFrame, types, borough=None, ada=False, lat=None, lon=None,
                  limit=5, reported: DataFrame = None) -> DataFrame:
    """One search: types, exclusions, borough, ADA, then the best ``limit``.

    With a location the borough is the one the point lies in and becomes a
    soft filter, and rows rank by distance; otherwise by the two scores.
    """
    kinds = sorted({v for t in types for v in TYPE_EXPANSION.get(t.lower().strip(), [t])})
    df = mart if reported is None else exclude_reported(mart, reported)
    if kinds:
        df = df.where(F.col("resource_type").isin(kinds))
    if lat is not None:
        here = F.lit(lat).alias("latitude"), F.lit(lon).alias("longitude")
        spot = mart.sparkSession.range(1).select(*here).select(borough_from_point().alias("b")).scalar()
        df = soft_filter(df, [], F.col("borough") == spot)
    elif borough:
        code = LOOKUP_BOROUGHS.get(borough.strip().lower(), borough.strip().upper()[:2])
        df = df.where(F.col("borough") == code)
    if ada:
        df = soft_filter(df, [], F.col("ada_accessible"))
    if lat is not None:
        return sort_by_distance(df, lat, lon).limit(limit)
    return df.orderBy(*_score_order()).limit(limit)


def batched_lookup(searches: DataFrame, mart: DataFrame, keep=("name",)) -> DataFrame:
    """The best resources of every search at once.

    ``searches``: search_id, types array, borough, ada, top, lat, lon (lat/lon
    null or a known landmark). Searches that ask the same thing share one
    answer: distinct questions are few (types x boroughs x landmarks), so the
    mart is ranked once per question and the answer, at most ``top`` rows, is
    joined back to however many searches asked it.
    """
    ask = ["types", "borough", "ada", "top", "lat", "lon"]
    key = F.xxhash64(F.to_json(F.struct(*ask), {"ignoreNullFields": "false"})).alias("_ask")
    keyed = searches.select("search_id", key, *ask)
    asks = keyed.groupBy("_ask").agg(*[F.first(c).alias(c) for c in ask])
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    place = F.when(located, borough_from_point("lat", "lon")).otherwise(lookup_borough("borough"))
    asks = (asks.withColumn("_place", place).withColumn("_located", located)
            .withColumn("resource_type", F.explode(expand_types("types"))).drop("types", "borough"))
    df = mart.join(asks, "resource_type")
    df = df.where(F.col("_located") | F.col("_place").isNull() | (F.col("borough") == F.col("_place")))
    df = soft_filter(df, ["_ask"], ~F.col("_located") | F.col("_place").isNull() | (F.col("borough") == F.col("_place")))
    df = soft_filter(df, ["_ask"], ~F.coalesce("ada", F.lit(False)) | F.col("ada_accessible"))
    df = with_distance(df, F.col("lat"), F.col("lon"))
    df = df.withColumn("distance_miles", F.when(F.col("_located"), F.col("distance_miles")))
    order = W.partitionBy("_ask").orderBy(F.asc_nulls_last("distance_miles"), *_score_order())
    best = (df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top"))
            .select("_ask", "rank", "resource_id", "distance_miles", *keep))
    return keyed.select("search_id", "_ask").join(best, "_ask").drop("_ask")


def nearest_of_type(origins: DataFrame, mart: DataFrame, k, origin_id="origin_id") -> DataFrame:
    """k nearest resources of each origin's own type, planar, with walk minutes."""
    near = knn(origins, mart, k, origin_id, "resource_id", by=["resource_type"])
    return near.withColumn("walk_min", round_even(F.col("dist") / F.lit(WALK_M_PER_MIN), 1))


# ---- Allocation ---------------------------------------------------------


def centroids(spark) -> DataFrame:
    rows = structs([(k, la, lo) for k, (la, lo) in BOROUGH_CENTROIDS.items()], ["borough", "c_lat", "c_lon"])
    return spark.range(1).select(F.explode(F.expr(rows)).alias("c")).select("c.*")


def near_centroid(df: DataFrame, n, tie="resource_id") -> DataFrame:
    """Per borough, the n rows nearest to its centroid, with distance and rank.

    The centroid is an expression on the row, so nothing is joined, and the
    rank filter keeps n rows per borough and task before the shuffle.
    """
    lat = F.expr(lookup("borough", {k: v[0] for k, v in BOROUGH_CENTROIDS.items()}, "CAST(NULL AS DOUBLE)"))
    lon = F.expr(lookup("borough", {k: v[1] for k, v in BOROUGH_CENTROIDS.items()}, "CAST(NULL AS DOUBLE)"))
    df = df.withColumn("_d2", planar_m2("latitude", "longitude", lat, lon)).where(F.col("_d2").isNotNull())
    order = W.partitionBy("borough").orderBy("_d2", tie)
    return (df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
            .withColumn("dist_m", F.sqrt("_d2")).drop("_d2"))


def even_allocation(df: DataFrame, people: int, group=("borough",), rank="rank") -> DataFrame:
    """Split people over each group's ranked rows; the first ones take the rest."""
    n = F.count(F.lit(1)).over(W.partitionBy(*group))
    share = F.floor(F.lit(people) / n)
    return df.withColumn("assigned_people",
                         (share + F.when(F.col(rank) <= F.lit(people) % n, 1).otherwise(0)).cast("int"))


def cost_matrix(sites: DataFrame) -> DataFrame:
    """Walk minutes between the depot (rank 0) and the ranked sites of a borough.

    ``sites`` is the output of near_centroid: at most a handful per borough.
    """
    depot = centroids(sites.sparkSession).select(
        "borough", F.lit(0).alias("rank"), F.col("c_lat").alias("latitude"), F.col("c_lon").alias("longitude"))
    nodes = sites.select("borough", "rank", "latitude", "longitude").unionByName(
        depot.join(sites.select("borough").distinct(), "borough", "left_semi"))
    a = nodes.toDF("borough", "i", "_lat1", "_lon1")
    b = nodes.toDF("borough", "j", "_lat2", "_lon2")
    minutes = F.sqrt(planar_m2("_lat1", "_lon1", "_lat2", "_lon2")) / F.lit(WALK_M_PER_MIN)
    return a.join(b, "borough").select("borough", "i", "j", round_even(minutes, 1).alias("minutes"))


def emergency_plan(mart: DataFrame, lots: DataFrame, people=200) -> DataFrame:
    """Per borough: shelters with people assigned, overflow lots, food sites."""
    def part(role, df, id_col, detail, who=F.lit(None).cast("int")):
        return df.select("borough", F.lit(role).alias("role"), "rank", F.col(id_col).cast("string").alias("id"),
                         F.col(detail).cast("string").alias("detail"), round_even("dist_m", 1).alias("dist_m"),
                         who.alias("assigned_people"))
    of = lambda kind, n: near_centroid(mart.where(F.col("resource_type") == kind), n)
    shelters = even_allocation(of("shelter", SHELTER_SITES), people)
    overflow = near_centroid(lots.where(F.col("is_overflow_candidate")), OVERFLOW_SITES, "bbl")
    return (part("shelter", shelters, "resource_id", "name", F.col("assigned_people"))
            .unionByName(part("overflow", overflow, "bbl", "ownername"))
            .unionByName(part("food", of("food_bank", FOOD_SITES), "resource_id", "name")))


# ---- What-if aggregates -------------------------------------------------


def population(c="borough", default=str(DEFAULT_POPULATION)) -> Column:
    return F.expr(lookup(c, POPULATION, default))


def per_100k(n, pop) -> Column:
    return round_even(col(n) / col(pop) * F.lit(100000.0), 1)


def capacity_what_if(mart: DataFrame, borough: str, new_beds: int, kind="shelter") -> DataFrame:
    """Sites, beds and coverage per borough before and after adding beds.

    Beds are split evenly over the borough's sites. Site counts do not change,
    so bed totals are reported next to them.
    """
    sites = mart.where(F.col("resource_type") == kind)
    n_in = sites.agg(F.greatest(F.count_if(F.col("borough") == borough), F.lit(1)).alias("n")).scalar()
    each = F.floor(F.lit(new_beds) / n_in)
    after = F.when(F.col("borough") == borough, F.coalesce("capacity", F.lit(0.0)) + each).otherwise(F.col("capacity"))
    out = (sites.where(F.col("borough").isNotNull()).withColumn("_after", after).groupBy("borough")
           .agg(F.count(F.lit(1)).alias("sites_before"), F.count(F.lit(1)).alias("sites_after"),
                F.coalesce(F.sum("capacity"), F.lit(0.0)).alias("beds_before"),
                F.coalesce(F.sum("_after"), F.lit(0.0)).alias("beds_after")))
    out = out.withColumn("pop_estimate", population())
    out = (out.withColumn("coverage_per_100k_before", per_100k("sites_before", "pop_estimate"))
           .withColumn("coverage_per_100k_after", per_100k("sites_after", "pop_estimate"))
           .withColumn("beds_per_100k_before", per_100k("beds_before", "pop_estimate"))
           .withColumn("beds_per_100k_after", per_100k("beds_after", "pop_estimate")))
    return out.withColumn("improvement", round_even(
        F.col("coverage_per_100k_after") - F.col("coverage_per_100k_before"), 2))


def intake_allocation(mart: DataFrame, people, languages, needs, borough=None) -> DataFrame:
    """Top five sites per need by language match, people split over shelters."""
    df = mart.where(F.col("resource_type").isin(list(needs)))
    if borough:
        df = df.where(F.col("borough") == borough)
    spoken = ", ".join(quote(x.lower()) for x in languages)
    match = (F.expr(f"size(filter(array({spoken}), l -> coalesce(contains(lower(languages_spoken), l), false)))")
             if languages else F.lit(0))
    order = W.partitionBy("resource_type").orderBy(
        F.desc("lang_match"), F.desc_nulls_last("safety_score"), "resource_id")
    top = (df.withColumn("lang_match", match).withColumn("rank", F.row_number().over(order))
           .where(F.col("rank") <= 5))
    top = even_allocation(top, people, ["resource_type"])
    top = top.withColumn("assigned_people", F.when(F.col("resource_type") == "shelter", F.col("assigned_people")))
    sites = F.count("languages_spoken").over(W.partitionBy("resource_type"))
    return top.withColumn("language_sites", sites)


def resource_gap(mart: DataFrame) -> DataFrame:
    """Resources per 100k residents by borough, lowest first."""
    out = (mart.where(F.col("resource_type").isin(GAP_TYPES) & F.col("borough").isNotNull())
           .groupBy("borough").agg(F.count(F.lit(1)).alias("resource_count"))
           .withColumn("pop_estimate", population()))
    out = out.withColumn("resources_per_100k", per_100k("resource_count", "pop_estimate"))
    lowest = F.min(F.struct("resources_per_100k", "borough")).over(W.partitionBy())["borough"]
    return out.withColumn("most_underserved", lowest).orderBy("resources_per_100k", "borough")


def mart_status(mart: DataFrame) -> DataFrame:
    """Rows per type, with the total under the type 'ALL'."""
    return mart.rollup("resource_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("resource_type", F.lit("ALL")).alias("resource_type"), "n")


# Marker colours of the map, RGBA.
MAP_COLOURS = {
    "shelter": "255,99,71,220", "food_bank": "255,165,0,220", "hospital": "0,191,255,220",
    "benefits_center": "0,255,127,220", "domestic_violence": "255,105,180,220",
    "school": "255,215,0,220", "senior_services": "148,0,211,220", "childcare": "0,255,255,220",
    "community_center": "50,205,50,220", "transit_station": "180,180,180,200",
}
DEFAULT_COLOUR = "200,200,200,200"


def map_rows(mart: DataFrame, limit=None, colours=MAP_COLOURS) -> DataFrame:
    """Rows with coordinates, coloured by type; with ``limit`` the first by id, for a first view."""
    df = mart.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    colour = F.expr(lookup("resource_type", colours, quote(DEFAULT_COLOUR))).alias("color")
    rows = df.select(*MAP_COLUMNS, colour)
    return rows if limit is None else rows.orderBy("resource_id").limit(limit)


def map_centre(rows: DataFrame) -> DataFrame:
    return rows.agg(round_even(F.avg("latitude"), 6).alias("lat"), round_even(F.avg("longitude"), 6).alias("lon"))


GRAM = 3
COMMON_SHARE, COMMON_PARTS = 100, 64


def _grams(c, n) -> Column:
    """Distinct pieces of n characters of a text."""
    return F.expr(f"""CASE WHEN length({c}) >= {n}
        THEN array_distinct(transform(sequence(1, length({c}) - {n - 1}), i -> substring({c}, i, {n})))
        ELSE array() END""")


def name_lookup(names: DataFrame, mart: DataFrame, by="query") -> DataFrame:
    """First mart row (by id) whose name contains each text, ignoring case.

    Substring search as an equi-join: each distinct text is looked up through
    its rarest three-letter piece, so only names sharing that piece are
    compared. Shorter texts are pieces themselves; an empty text is in every
    name. A piece of more than one in COMMON_SHARE names is dealt over COMMON_PARTS
    parts, so that no task reads all names that share it.
    """
    texts = names.select(F.lower(by).alias("_q")).where(F.col("_q").isNotNull()).distinct()
    rows = mart.select("resource_id", "name", "resource_type", "address", F.lower("name").alias("_n"))
    all_grams = F.concat(*[_grams("_n", n) for n in range(1, GRAM + 1)])
    by_gram = rows.withColumn("_g", F.explode(all_grams))
    counts = by_gram.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    own = F.when(F.length("_q") >= GRAM, _grams("_q", GRAM)).otherwise(F.array("_q"))
    rarest = (texts.where("length(_q) > 0").withColumn("_g", F.explode(own)).join(counts, "_g")
              .groupBy("_q").agg(F.min(F.struct("_c", "_g")).alias("_r")).select("_q", "_r._c", "_r._g"))
    rarest = materialise(rarest, "rarest-grams")
    # a piece is common by its share of all names, so there are few of them however many names there are
    n = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    common = F.col("_c") * COMMON_SHARE > n
    listed = rarest.where(common).agg(F.collect_set("_g").alias("g")).scalar()
    texts_by_gram = rarest.select("_q", "_g", F.explode(F.when(common, F.sequence(F.lit(0), F.lit(COMMON_PARTS - 1)))
                                                        .otherwise(F.array(F.lit(0)))).alias("_part"))
    part = F.when(F.array_contains(listed, F.col("_g")), F.pmod(F.xxhash64("resource_id"), F.lit(COMMON_PARTS)).cast("int"))
    names_by_gram = by_gram.withColumn("_part", F.coalesce(part, F.lit(0)))
    row = F.struct("resource_id", "name", "resource_type", "address")
    found = (texts_by_gram.join(names_by_gram, ["_g", "_part"]).where(F.contains("_n", "_q"))
             .groupBy("_q").agg(F.min(row).alias("m")))
    blank = rows.where("_n IS NOT NULL").groupBy().agg(F.min(row).alias("m")).select(F.lit("").alias("_q"), "m")
    first = found.unionByName(blank)
    return names.join(first, F.lower(by) == F.col("_q")).select(by, "m.*")
