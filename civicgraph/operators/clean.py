"""Cleaning of messy source tables into one stage schema.

Each source is described by a CleanSpec; which source column feeds which
output column is decided from the schema, so every cleaner is one projection
and one filter over the scan.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.indexing import sequential_index
from ..functions.numeric import to_number, zero_pad
from ..functions.text import any_word, first_match, in_set, lookup, quote

# ---- Fixed values -------------------------------------------------------

BOROUGH_CODES = {
    "manhattan": "MN", "mn": "MN", "1": "MN", "new york": "MN",
    "brooklyn": "BK", "bk": "BK", "2": "BK",
    "queens": "QN", "qn": "QN", "4": "QN",
    "bronx": "BX", "bx": "BX", "the bronx": "BX", "3": "BX",
    "staten island": "SI", "si": "SI", "5": "SI",
}
CANDIDATE_LANDUSE = ["08", "09", "12"]
SHELTER_GROUPS = ["human services", "adult services"]
SHELTER_WORDS = ["shelter", "homeless", "transitional", "drop-in", "drop_in",
                 "overnight", "safe haven", "crisis", "residence"]
FOOD_WORDS = ["food pantry", "summer only feeding site", "soup kitchen", "food bank",
              "emergency food", "congregate meals", "food distribution", "food scrap",
              "meals on wheels"]
HOSPITAL_WORDS = ["hospital", "acute", "trauma"]
SCHOOL_CATEGORY_WORDS = ["school", "education", "literacy", "ged"]
JUNK_GROUPS = ["transportation", "solid waste", "historical sites", "cultural institutions",
               "parks and plazas", "city agency parking, maintenance, and storage",
               "water and wastewater", "telecommunications", "material supplies and markets"]
JUNK_TYPES = ["commercial garage & parking lot", "school bus depot", "tow truck company",
              "textiles", "compost", "garden", "triangle/plaza", "playground",
              "state historic place", "city council awards"]
# (type, words in the facility group, words in the facility type), first match wins.
FACILITY_RULES = [
    ("food_bank", [], ["food pantry", "soup kitchen", "feeding site", "food bank",
                       "emergency food", "congregate meal"]),
    ("hospital", ["health care"], ["hospital", "diagnostic", "treatment center", "urgent care",
                                   "ambulatory care", "health center"]),
    ("mental_health", [], ["mental health", "outpatient mental", "support mental",
                           "psychiatric", "substance"]),
    ("shelter", [], ["shelter", "transitional", "safe haven", "drop-in", "overnight",
                     "crisis residence"]),
    ("school", ["schools"], ["elementary school", "high school", "middle school", "k-12",
                             "public school", "non-public school"]),
    ("senior_services", [], ["senior center", "aged", "elderly", "meals on wheels", "home care"]),
    ("childcare", ["day care", "child"], ["day care", "early education", "head start", "pre-k",
                                          "childcare", "afterschool"]),
    ("shelter", ["human services", "adult services"], []),
    ("legal_aid", [], ["legal", "law", "court", "justice"]),
    ("youth_services", ["youth services"], []),
    ("education", ["higher education", "vocational"], []),
    ("library", ["libraries"], []),
    ("emergency_services", ["emergency services", "public safety"], []),
]
DEFAULT_FACILITY = "community_center"
TRUE_VALUES = ["1", "True", "true"]
WKT_POINT = r"POINT\s*\(\s*([-\d.]+)\s+([-\d.]+)\s*\)"

# ---- Column helpers -----------------------------------------------------


def snake_columns(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores for spaces."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def first_present(df: DataFrame, candidates):
    """Name of the first candidate column the table has, or None."""
    return next((c for c in candidates if c in df.columns), None)


def first_present_column(df: DataFrame, candidates, name) -> DataFrame:
    """Rename the first candidate that exists to ``name``."""
    found = first_present(df, candidates)
    return df.withColumnRenamed(found, name) if found else df


def find_geometry_column(df: DataFrame, words=("location", "point", "geom")):
    """First column whose name contains any of the words, or None."""
    return next((c for c in df.columns if any(w in c.lower() for w in words)), None)


def prune_columns(df: DataFrame, keep) -> DataFrame:
    return df.select(*[c for c in keep if c in df.columns])


def norm_borough(c, codes=BOROUGH_CODES) -> Column:
    """Known names and codes to two letters; else the first two, upper-cased."""
    text = f"trim(CAST({c} AS STRING))"
    return F.expr(lookup(f"lower({text})", codes, f"substring(upper({text}), 1, 2)"))


def wkt_point(c):
    """(latitude, longitude) of a POINT (lon lat) text; null when absent."""
    num = lambda g: F.nullif(F.regexp_extract(F.col(c), WKT_POINT, g), F.lit("")).try_cast("double")
    return num(2), num(1)


def polygon_centroid(c):
    """(latitude, longitude) as the mean of every vertex of a MultiPolygon.

    ``c`` is JSON text with a ``coordinates`` member or a struct holding one.
    """
    mean = lambda i: (f"aggregate(transform({c}, p -> p[{i}]), CAST(0 AS DOUBLE), (a, x) -> a + x)"
                      f" / nullif(size({c}), 0)")
    return F.expr(mean(1)), F.expr(mean(0))


def polygon_vertices(c) -> Column:
    """All [lon, lat] vertices of GeoJSON MultiPolygon text, flattened."""
    parsed = F.from_json(F.col(c), "struct<coordinates: array<array<array<array<double>>>>>")
    return F.flatten(F.flatten(parsed.coordinates))


def bool_coerce(c) -> Column:
    return F.expr(in_set(f"CAST({c} AS STRING)", TRUE_VALUES))


def contains_regex(c, pattern) -> Column:
    """Null-safe regex search."""
    return F.coalesce(F.col(c).rlike(pattern), F.lit(False))


def candidate_flag(c="landuse", codes=CANDIDATE_LANDUSE) -> Column:
    return F.expr(in_set(c, codes))


def keyword_any(group, groups, text, words) -> Column:
    """Group in the set, or text containing any keyword (case-insensitive)."""
    test = any_word(f"lower({text})", words)
    return F.expr(f"{in_set(f'lower({group})', groups)} OR {test}" if group else test)


def not_junk(group="facility_group", text="facility_type") -> Column:
    return F.expr(f"NOT ({in_set(f'lower({group})', JUNK_GROUPS)} OR {in_set(f'lower({text})', JUNK_TYPES)})")


def classify_facility(group="facility_group", text="facility_type") -> Column:
    """Ordered keyword rules over group and type; the first that fits wins."""
    cases = []
    for kind, group_words, type_words in FACILITY_RULES:
        tests = [any_word(f"lower({c})", ws) for c, ws in ((group, group_words), (text, type_words)) if ws]
        cases.append((" OR ".join(tests), quote(kind)))
    return F.expr(first_match(cases, quote(DEFAULT_FACILITY)))


def hospital_or_clinic(c) -> Column:
    return F.when(F.expr(any_word(f"lower({c})", HOSPITAL_WORDS)), "hospital").otherwise("clinic")


# ---- Specs --------------------------------------------------------------


@dataclass(frozen=True)
class CleanSpec:
    """How one source becomes stage rows."""

    prefix: str                                  # id prefix
    kind: object = None                          # type literal, or df -> Column
    name: tuple = ("name",)
    address: tuple = ("address",)
    borough: tuple = ("borough",)
    lat: tuple = ("latitude", "lat")
    lon: tuple = ("longitude", "lng")
    geometry: tuple = ()                         # words of a WKT column's name
    polygon: str = None                          # GeoJSON column
    lat_range: tuple = None
    numbers: dict = field(default_factory=dict)  # out -> candidates
    texts: dict = field(default_factory=dict)    # out -> candidates
    flags: dict = field(default_factory=dict)    # out -> candidates
    where: object = None                         # df -> Column, on source columns


def _pick(df, candidates, default=None, cast="string"):
    c = first_present(df, candidates)
    return F.col(c) if c else F.lit(default).cast(cast)


def _coordinates(df, spec):
    """Add _lat/_lon: numeric columns, else geometry, row by row.

    A row keeps its numbers if it has both; geometry fills in for the others,
    even where some rows of the table have numbers. Geometry is found before any
    renaming, so an address rename cannot hide it.
    """
    lat_c, lon_c = first_present(df, spec.lat), first_present(df, spec.lon)
    lat = to_number(lat_c) if lat_c else None
    lon = to_number(lon_c) if lon_c else None
    geo = None
    if spec.geometry:
        found = find_geometry_column(df, spec.geometry)
        geo = wkt_point(found) if found else None
    if spec.polygon and spec.polygon in df.columns:
        df = df.withColumn("_vertices", polygon_vertices(spec.polygon))
        geo = polygon_centroid("_vertices")
    if lat is None or lon is None:
        lat, lon = geo if geo else (F.lit(None).cast("double"),) * 2
    elif geo:
        given = lat.isNotNull() & lon.isNotNull()
        lat, lon = F.when(given, lat).otherwise(geo[0]), F.when(given, lon).otherwise(geo[1])
    return df.withColumn("_lat", lat).withColumn("_lon", lon)


def clean(df: DataFrame, spec: CleanSpec, key="row_key") -> DataFrame:
    """Stage rows: core columns, then the spec's own, ids in ``key`` order.

    A missing optional column becomes null, so the schema never varies.
    """
    if spec.where is not None:
        df = df.where(spec.where(df))
    df = _coordinates(df, spec)
    kind = spec.kind(df) if callable(spec.kind) else F.lit(spec.kind)
    boro = first_present(df, spec.borough)
    out = [F.col(key).alias("_key"), kind.alias("resource_type"),
           _pick(df, spec.name).alias("name"), _pick(df, spec.address, "").alias("address"),
           (norm_borough(boro) if boro else F.lit(None).cast("string")).alias("borough"),
           F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude")]
    out += [to_number(_pick(df, c)).alias(n) for n, c in spec.numbers.items()]
    out += [_pick(df, c, "").alias(n) for n, c in spec.texts.items()]
    for n, candidates in spec.flags.items():
        c = first_present(df, candidates)
        out.append((bool_coerce(c) if c else F.lit(False)).alias(n))
    df = df.select(*out).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    if spec.lat_range:
        df = df.where(F.col("latitude").between(*spec.lat_range))
    return _with_ids(df, spec.prefix)


def _with_ids(df, prefix, order=("_key",), key="_key", group=()):
    df = sequential_index(df, list(order), key, out="_idx", group=group)
    rest = [c for c in df.columns if c not in ("_idx", "_key", *group)]
    return df.select(F.concat(F.lit(prefix), F.col("_idx").cast("string")).alias("resource_id"), *rest)


CITY_LAT = (40.4, 40.95)

SHELTERS = CleanSpec(
    "shelter_", "shelter", name=("facname", "name"), borough=("boro", "borough"), lat_range=CITY_LAT,
    numbers={"capacity": ("capacity",)}, texts={"operator_name": ("opname", "operator_name")},
    where=lambda df: keyword_any("facgroup", SHELTER_GROUPS, "factype", SHELTER_WORDS))
FOOD_BANKS = CleanSpec(
    "food_", "food_bank", name=("facname", "name"), borough=("boro", "borough"), lat_range=CITY_LAT,
    texts={"operator_name": ("opname", "operator_name"), "facility_subtype": ("factype", "facility_type")},
    where=lambda df: keyword_any(None, None, first_present(df, ("factype", "facility_type")), FOOD_WORDS))
FACILITIES = CleanSpec(
    "dohmh_", lambda df: classify_facility("facgroup", "factype"), name=("facname", "name"),
    borough=("boro", "borough"), lat_range=CITY_LAT,
    texts={"facility_type": ("factype",), "facility_group": ("facgroup",),
           "facility_subgroup": ("facsubgrp",), "operator_name": ("opname",)},
    where=lambda df: not_junk("facgroup", "factype"))
HOSPITALS = CleanSpec(
    "hospital_", lambda df: hospital_or_clinic("facility_type"), name=("facility_name",),
    address=("cross_streets", "address"), geometry=("location", "point"),
    texts={"facility_type": ("facility_type",), "phone": ("phone",)})
STATIONS = CleanSpec(
    "transit_", "transit_station", name=("stop_name",), lat=("gtfs_latitude",), lon=("gtfs_longitude",),
    texts={"station_id": ("station_id",), "gtfs_stop_id": ("gtfs_stop_id",),
           "subway_lines": ("daytime_routes",), "line_name": ("line",),
           "division": ("division",), "structure": ("structure",)},
    flags={"ada_accessible": ("ada",)})
VIOLENCE = CleanSpec(
    "dv_", "domestic_violence", name=("organization_name", "program_name", "name", "agency_name"),
    address=("street_address", "address", "location"), geometry=("location", "point", "geom"),
    flags={"ada_accessible": ("ada_accessible",)})
DEVELOPMENTS = CleanSpec(
    "nycha_", "nycha", name=("developmen", "development_name", "developmentname", "name"),
    address=("address", "street_address", "location"), polygon="the_geom",
    numbers={"total_units": ("total_apartment_units", "units")})
BENEFITS = CleanSpec(
    "benefits_", "benefits_center", name=("center_name", "name", "facility_name"),
    address=("address", "street_address", "location_1"), geometry=("location", "geom"),
    texts={"phone": ("phone", "telephone"), "hours_open": ("hours_of_operation", "hours")})
COOLING = CleanSpec(
    "cool_", "cooling_center", name=("propertyname", "site_name", "facility_name", "name"),
    address=("street_address", "address", "location"), lat=("y", "latitude", "lat"),
    lon=("x", "longitude", "lng"), texts={"center_type": ("featuretype",), "status": ("status",)},
    flags={"ada_accessible": ("accessible", "ada")})
DROPIN = CleanSpec(
    "dropin_", "dropin_center", name=("center_name", "name", "facility_name", "site_name"),
    address=("address", "street_address", "location_1"), geometry=("location", "geom", "point"))
WOMENS_SCHOOLS = CleanSpec(
    "school_w_", "school", name=("site_name", "organization_name", "name"),
    address=("street_address", "address"),
    where=lambda df: contains_regex("category", "(?i)" + "|".join(SCHOOL_CATEGORY_WORDS)))


def clean_shelters(df, key="row_key"):
    return clean(snake_columns(df), SHELTERS, key)


def clean_food_banks(df, key="row_key"):
    return clean(snake_columns(df), FOOD_BANKS, key)


def clean_facilities(df, key="row_key"):
    return clean(snake_columns(df), FACILITIES, key)


def clean_hospitals(df, key="row_key"):
    return clean(snake_columns(df), HOSPITALS, key)


def clean_stations(df, key="row_key"):
    return clean(snake_columns(df), STATIONS, key)


def clean_violence(df, key="row_key"):
    return clean(snake_columns(df), VIOLENCE, key)


def clean_developments(df, key="row_key"):
    return clean(snake_columns(df), DEVELOPMENTS, key)


def clean_benefits(df, key="row_key"):
    return clean(snake_columns(df), BENEFITS, key)


def clean_cooling(df, key="row_key"):
    return clean(snake_columns(df), COOLING, key)


def clean_dropin(df, key="row_key"):
    return clean(snake_columns(df), DROPIN, key)


def clean_schools(facilities, womens, key="row_key"):
    """Schools among the staged facilities, then the directory's, one per
    (name, latitude), numbered afresh in that order."""
    cols = ["resource_id", "name", "address", "borough", "latitude", "longitude", "resource_type"]
    num = F.regexp_extract("resource_id", r"(\d+)$", 1).cast("long")
    a = facilities.where(F.col("resource_type") == "school").select(*cols).withColumn("_src", F.lit(0))
    b = clean(snake_columns(womens), WOMENS_SCHOOLS, key).select(*cols).withColumn("_src", F.lit(1))
    both = a.unionByName(b).withColumn("_key", num).drop("resource_id")
    first = W.partitionBy("name", "latitude").orderBy("_src", "_key")
    kept = both.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1).drop("_rn")
    return _with_ids(kept, "school_", ("_src", "_key"), "_key", ("_src",))


LOT_COLUMNS = ["bbl", "address", "borough", "zipcode", "landuse", "yearbuilt", "numfloors",
               "unitsres", "ownername", "latitude", "longitude"]


def clean_lots(df):
    """Tax lots with a padded land-use code and the overflow flag."""
    df = prune_columns(df, LOT_COLUMNS)
    for c in ("latitude", "longitude", "yearbuilt", "numfloors", "unitsres"):
        df = df.withColumn(c, to_number(_pick(df, (c,))))
    df = df.withColumn("borough", norm_borough("borough")).withColumn("landuse", zero_pad("landuse"))
    return (df.withColumn("is_overflow_candidate", candidate_flag())
            .where(F.col("latitude").between(*CITY_LAT) & F.col("longitude").between(-74.3, -73.6)))


def _clean_points(df, keep, borough):
    df = snake_columns(df)
    df = df.withColumn("latitude", to_number(_pick(df, ("latitude",)))).withColumn(
        "longitude", to_number(_pick(df, ("longitude",))))
    if borough in df.columns:
        df = df.withColumn(borough, norm_borough(borough))
    if "ofns_desc" in df.columns:
        df = df.withColumn("ofns_desc", F.trim("ofns_desc"))
    df = df.where(F.col("latitude").between(*CITY_LAT) & F.col("longitude").isNotNull())
    return prune_columns(df, keep)


def clean_incidents(df):
    return _clean_points(df, ["latitude", "longitude", "boro_nm", "ofns_desc", "cmplnt_fr_dt"], "boro_nm")


def clean_complaints(df):
    return _clean_points(df, ["latitude", "longitude", "borough", "complaint_type", "descriptor",
                              "incident_address", "created_date"], "borough")
