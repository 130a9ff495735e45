"""Cleaning: column picking, coercion, classification, and the 14 cleaners."""

from pyspark.sql import functions as F

from ..functions.numeric import to_number, zero_pad
from ..operators import clean as C
from ..operators import mart as M
from ..functions.indexing import sequential_index
from .registry import Views, ctes, query

# ---- SQL fragments ------------------------------------------------------


def q(s):
    return "'" + s.replace("'", "''") + "'"


def case_map(expr, table, default="NULL"):
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def boro(c, codes=C.BOROUGH_CODES):
    t = f"trim(CAST({c} AS VARCHAR))"
    return case_map(f"lower({t})", codes, f"substring(upper({t}), 1, 2)")


def num(c):
    return f"TRY_CAST({c} AS DOUBLE)"


def words(c, ws):
    return "coalesce(" + " OR ".join(f"contains(lower({c}), {q(w)})" for w in ws) + ", false)"


def members(c, vs):
    return f"coalesce(lower({c}) IN ({', '.join(q(v) for v in vs)}), false)"


def wkt(c):
    pat = r"'POINT\s*\(\s*([-\d.]+)\s+([-\d.]+)\s*\)'"
    g = lambda i: f"TRY_CAST(nullif(regexp_extract({c}, {pat}, {i}), '') AS DOUBLE)"
    return g(2), g(1)


def classify(group, kind):
    whens = []
    for name, gw, tw in C.FACILITY_RULES:
        tests = ([words(group, gw)] if gw else []) + ([words(kind, tw)] if tw else [])
        whens.append(f"WHEN {' OR '.join(tests)} THEN {q(name)}")
    return f"CASE {' '.join(whens)} ELSE 'community_center' END"


def stage(view, prefix, kind, name, address, borough, lat, lon, extra="", where="true",
          lat_range=True, key="row_key"):
    """SQL of one cleaner over a raw view."""
    box = "AND latitude BETWEEN CAST(40.4 AS DOUBLE) AND CAST(40.95 AS DOUBLE)" if lat_range else ""
    return ctes(view, body=f"""
        SELECT * EXCLUDE ({key}), concat('{prefix}', CAST(row_number() OVER (ORDER BY {key}) - 1 AS VARCHAR)) AS resource_id
        FROM (SELECT {key}, {kind} AS resource_type, {name} AS name, {address} AS address, {boro(borough)} AS borough,
              {lat} AS latitude, {lon} AS longitude {extra} FROM {view} WHERE {where}) t
        WHERE latitude IS NOT NULL AND longitude IS NOT NULL {box}""")


# ---- Column operators ---------------------------------------------------


@query("snake_columns", ctes("raw_facilities", body="""
    SELECT row_key, FacName AS facname, FacType AS factype, ZipCode AS zip_code FROM raw_facilities"""))
def snake_columns(spark, sf_dir):
    raw = Views(spark, sf_dir).raw_facilities.select("row_key", "FacName", "FacType", F.col("ZipCode").alias("Zip Code"))
    return C.snake_columns(raw)


@query("first_present_column", ctes("raw_womens", body="""
    SELECT row_key, Site_Name AS name, Organization_Name AS organization_name FROM raw_womens"""))
def first_present_column(spark, sf_dir):
    df = C.snake_columns(Views(spark, sf_dir).raw_womens)
    df = C.first_present_column(df, ["missing", "site_name", "organization_name"], "name")
    return df.select("row_key", "name", "organization_name")


@query("find_geometry_column", ctes("raw_hospitals", body="""
    SELECT row_key, Location_1 AS geometry, 'Location_1' AS found FROM raw_hospitals"""))
def find_geometry_column(spark, sf_dir):
    df = Views(spark, sf_dir).raw_hospitals
    found = C.find_geometry_column(df)
    return df.select("row_key", F.col(found).alias("geometry"), F.lit(found).alias("found"))


@query("to_number", ctes("raw_facilities", body=f"""
    SELECT row_key, {num('Capacity')} AS capacity, {num('Latitude')} AS latitude FROM raw_facilities"""))
def to_number_query(spark, sf_dir):
    return Views(spark, sf_dir).raw_facilities.select(
        "row_key", to_number("Capacity").alias("capacity"), to_number("Latitude").alias("latitude"))


@query("norm_borough", ctes("raw_facilities", body=f"""
    SELECT row_key, Boro AS raw, {boro('Boro')} AS borough FROM raw_facilities"""))
def norm_borough(spark, sf_dir):
    return Views(spark, sf_dir).raw_facilities.select(
        "row_key", F.col("Boro").alias("raw"), C.norm_borough("Boro").alias("borough"))


@query("wkt_point", ctes("raw_hospitals", body=f"""
    SELECT row_key, {wkt('Location_1')[0]} AS latitude, {wkt('Location_1')[1]} AS longitude FROM raw_hospitals"""))
def wkt_point(spark, sf_dir):
    lat, lon = C.wkt_point("Location_1")
    return Views(spark, sf_dir).raw_hospitals.select("row_key", lat.alias("latitude"), lon.alias("longitude"))


VERTICES = ("verts", """
    SELECT row_key, flatten(flatten(CAST(json_extract(the_geom, '$.coordinates') AS DOUBLE[][][][]))) AS v, *
    FROM raw_developments""")


def centroid(i):
    return f"list_sum(list_transform(v, lambda p: p[{i}])) / nullif(len(v), 0)"


@query("polygon_centroid", ctes("raw_developments", VERTICES, body=f"""
    SELECT row_key, {centroid(2)} AS latitude, {centroid(1)} AS longitude FROM verts"""))
def polygon_centroid(spark, sf_dir):
    df = Views(spark, sf_dir).raw_developments.withColumn("v", C.polygon_vertices("the_geom"))
    lat, lon = C.polygon_centroid("v")
    return df.select("row_key", lat.alias("latitude"), lon.alias("longitude"))


PAD = "CASE WHEN length(coalesce(landuse, '')) < 2 THEN lpad(coalesce(landuse, ''), 2, '0') ELSE landuse END"


@query("zero_pad", ctes("raw_lots", body=f"SELECT bbl, {PAD} AS landuse FROM raw_lots"))
def zero_pad_query(spark, sf_dir):
    return Views(spark, sf_dir).raw_lots.select("bbl", zero_pad("landuse").alias("landuse"))


@query("candidate_flag", ctes("raw_lots", body=f"""
    SELECT bbl, {PAD} IN ('08', '09', '12') AS is_overflow_candidate FROM raw_lots"""))
def candidate_flag(spark, sf_dir):
    df = Views(spark, sf_dir).raw_lots.withColumn("landuse", zero_pad("landuse"))
    return df.select("bbl", C.candidate_flag().alias("is_overflow_candidate"))


@query("bbox_filter", ctes("raw_lots", body=f"""
    SELECT bbl, {num('latitude')} AS latitude, {num('longitude')} AS longitude FROM raw_lots
    WHERE {num('latitude')} BETWEEN CAST(40.4 AS DOUBLE) AND CAST(40.95 AS DOUBLE)
      AND {num('longitude')} BETWEEN CAST(-74.3 AS DOUBLE) AND CAST(-73.6 AS DOUBLE)"""))
def bbox_filter(spark, sf_dir):
    df = Views(spark, sf_dir).raw_lots.select(
        "bbl", to_number("latitude").alias("latitude"), to_number("longitude").alias("longitude"))
    return M.in_city(df)


SHELTER = f"({members('FacGroup', C.SHELTER_GROUPS)} OR {words('FacType', C.SHELTER_WORDS)})"


@query("keyword_any_filter", ctes("raw_facilities", body=f"""
    SELECT row_key, FacGroup AS facgroup, FacType AS factype FROM raw_facilities WHERE {SHELTER}"""))
def keyword_any_filter(spark, sf_dir):
    df = C.snake_columns(Views(spark, sf_dir).raw_facilities).select("row_key", "facgroup", "factype")
    return df.where(C.keyword_any("facgroup", C.SHELTER_GROUPS, "factype", C.SHELTER_WORDS))


NOT_JUNK = f"NOT ({members('FacGroup', C.JUNK_GROUPS)} OR {members('FacType', C.JUNK_TYPES)})"


@query("junk_anti_filter", ctes("raw_facilities", body=f"""
    SELECT row_key, FacGroup AS facgroup, FacType AS factype FROM raw_facilities WHERE {NOT_JUNK}"""))
def junk_anti_filter(spark, sf_dir):
    df = C.snake_columns(Views(spark, sf_dir).raw_facilities).select("row_key", "facgroup", "factype")
    return df.where(C.not_junk("facgroup", "factype"))


@query("classify_facility", ctes("raw_facilities", body=f"""
    SELECT row_key, {classify('FacGroup', 'FacType')} AS resource_type FROM raw_facilities"""))
def classify_facility(spark, sf_dir):
    df = C.snake_columns(Views(spark, sf_dir).raw_facilities)
    return df.select("row_key", C.classify_facility("facgroup", "factype").alias("resource_type"))


HOSPITAL = f"CASE WHEN {words('Facility_Type', C.HOSPITAL_WORDS)} THEN 'hospital' ELSE 'clinic' END"


@query("hospital_or_clinic", ctes("raw_hospitals", body=f"""
    SELECT row_key, {HOSPITAL} AS resource_type FROM raw_hospitals"""))
def hospital_or_clinic(spark, sf_dir):
    return Views(spark, sf_dir).raw_hospitals.select("row_key", C.hospital_or_clinic("Facility_Type").alias("resource_type"))


def truth(c):
    return f"coalesce({c} IN ('1', 'True', 'true'), false)"


@query("bool_coerce", ctes("raw_stations", body=f"SELECT row_key, {truth('ADA')} AS ada_accessible FROM raw_stations"))
def bool_coerce(spark, sf_dir):
    return Views(spark, sf_dir).raw_stations.select("row_key", C.bool_coerce("ADA").alias("ada_accessible"))


CATEGORY = "coalesce(regexp_matches(lower(Category), 'school|education|literacy|ged'), false)"


@query("contains_regex", ctes("raw_womens", body=f"SELECT row_key, {CATEGORY} AS is_school FROM raw_womens"))
def contains_regex(spark, sf_dir):
    pattern = "(?i)" + "|".join(C.SCHOOL_CATEGORY_WORDS)
    return Views(spark, sf_dir).raw_womens.select("row_key", C.contains_regex("Category", pattern).alias("is_school"))


@query("sequential_id", ctes("complaints", body="""
    SELECT complaint_id, concat('c_', CAST(row_number() OVER (ORDER BY complaint_id) - 1 AS VARCHAR)) AS resource_id
    FROM complaints WHERE complaint_type <> 'SAFETY'"""))
def sequential_id(spark, sf_dir):
    df = Views(spark, sf_dir).complaints.where("complaint_type <> 'SAFETY'").select("complaint_id")
    df = sequential_index(df, ["complaint_id"], "complaint_id", width=1000)
    return df.select("complaint_id", F.concat(F.lit("c_"), F.col("idx").cast("string")).alias("resource_id"))


@query("fill_trim", ctes("raw_facilities", body="""
    SELECT row_key, trim(coalesce(FacName, 'Unknown')) AS name, trim(coalesce(Address, '')) AS address FROM raw_facilities"""))
def fill_trim(spark, sf_dir):
    return Views(spark, sf_dir).raw_facilities.select(
        "row_key", F.trim(F.coalesce("FacName", F.lit("Unknown"))).alias("name"),
        F.trim(F.coalesce("Address", F.lit(""))).alias("address"))


@query("prune_columns", ctes("raw_lots", body="SELECT bbl, borough, ownername FROM raw_lots"))
def prune_columns(spark, sf_dir):
    return C.prune_columns(Views(spark, sf_dir).raw_lots, ["bbl", "borough", "ownername", "not_there"])


# ---- The 14 cleaners ----------------------------------------------------


@query("clean_lots", ctes("raw_lots", body=f"""
    SELECT bbl, address, {boro('borough')} AS borough, zipcode, {PAD} AS landuse, {num('yearbuilt')} AS yearbuilt,
           {num('numfloors')} AS numfloors, {num('unitsres')} AS unitsres, ownername, {num('latitude')} AS latitude,
           {num('longitude')} AS longitude, {PAD} IN ('08', '09', '12') AS is_overflow_candidate
    FROM raw_lots WHERE {num('latitude')} BETWEEN CAST(40.4 AS DOUBLE) AND CAST(40.95 AS DOUBLE)
      AND {num('longitude')} BETWEEN CAST(-74.3 AS DOUBLE) AND CAST(-73.6 AS DOUBLE)"""))
def clean_lots(spark, sf_dir):
    return C.clean_lots(Views(spark, sf_dir).raw_lots)


@query("clean_shelters", stage(
    "raw_facilities", "shelter_", "'shelter'", "FacName", "Address", "Boro", num("Latitude"), num("Longitude"),
    f", {num('Capacity')} AS capacity, OpName AS operator_name", SHELTER))
def clean_shelters(spark, sf_dir):
    return C.clean_shelters(Views(spark, sf_dir).raw_facilities)


@query("clean_food_banks", stage(
    "raw_facilities", "food_", "'food_bank'", "FacName", "Address", "Boro", num("Latitude"), num("Longitude"),
    ", OpName AS operator_name, FacType AS facility_subtype", words("FacType", C.FOOD_WORDS)))
def clean_food_banks(spark, sf_dir):
    return C.clean_food_banks(Views(spark, sf_dir).raw_facilities)


FACILITIES_SQL = stage(
    "raw_facilities", "dohmh_", classify("FacGroup", "FacType"), "FacName", "Address", "Boro",
    num("Latitude"), num("Longitude"),
    ", FacType AS facility_type, FacGroup AS facility_group, FacSubGrp AS facility_subgroup, OpName AS operator_name",
    NOT_JUNK)


@query("clean_facilities", FACILITIES_SQL)
def clean_facilities(spark, sf_dir):
    return C.clean_facilities(Views(spark, sf_dir).raw_facilities)


def spaced(df):
    """Column names with blanks, as the CSV sources have them."""
    return df.toDF(*[c if c == "row_key" else f" {c.replace('_', ' ')}" for c in df.columns])


@query("clean_hospitals", stage(
    "raw_hospitals", "hospital_", HOSPITAL, "Facility_Name", "Cross_Streets", "Borough", *wkt("Location_1"),
    ", Facility_Type AS facility_type, Phone AS phone", lat_range=False))
def clean_hospitals(spark, sf_dir):
    return C.clean_hospitals(spaced(Views(spark, sf_dir).raw_hospitals))


@query("clean_stations", stage(
    "raw_stations", "transit_", "'transit_station'", "Stop_Name", "''", "Borough",
    num("GTFS_Latitude"), num("GTFS_Longitude"),
    f""", Station_ID AS station_id, GTFS_Stop_ID AS gtfs_stop_id, Daytime_Routes AS subway_lines, Line AS line_name,
    Division AS division, Structure AS structure, {truth('ADA')} AS ada_accessible""", lat_range=False))
def clean_stations(spark, sf_dir):
    return C.clean_stations(spaced(Views(spark, sf_dir).raw_stations))


@query("clean_violence", stage(
    "raw_violence", "dv_", "'domestic_violence'", "Program_Name", "Location", "Borough", *wkt("Location"),
    f", {truth('ADA_Accessible')} AS ada_accessible", lat_range=False))
def clean_violence(spark, sf_dir):
    return C.clean_violence(Views(spark, sf_dir).raw_violence)


@query("clean_developments", ctes("raw_developments", VERTICES, body=f"""
    SELECT concat('nycha_', CAST(row_number() OVER (ORDER BY row_key) - 1 AS VARCHAR)) AS resource_id,
           'nycha' AS resource_type, Developmen AS name, '' AS address, {boro('Borough')} AS borough,
           {centroid(2)} AS latitude, {centroid(1)} AS longitude, {num('Total_Apartment_Units')} AS total_units
    FROM verts WHERE len(v) > 0"""))
def clean_developments(spark, sf_dir):
    return C.clean_developments(Views(spark, sf_dir).raw_developments)


@query("clean_benefits", stage(
    "raw_benefits", "benefits_", "'benefits_center'", "Facility_Name", "Street_Address", "Borough",
    *wkt("Location_1"), ", Telephone AS phone, Hours AS hours_open", lat_range=False))
def clean_benefits(spark, sf_dir):
    return C.clean_benefits(Views(spark, sf_dir).raw_benefits)


@query("clean_cooling", stage(
    "raw_cooling", "cool_", "'cooling_center'", "PropertyName", "Address", "Borough", num("y"), num("x"),
    f", FeatureType AS center_type, Status AS status, {truth('Accessible')} AS ada_accessible", lat_range=False))
def clean_cooling(spark, sf_dir):
    return C.clean_cooling(Views(spark, sf_dir).raw_cooling)


@query("clean_dropin", stage(
    "raw_dropin", "dropin_", "'dropin_center'", "Center_Name", "Address", "Borough", *wkt("Location_1"),
    lat_range=False))
def clean_dropin(spark, sf_dir):
    return C.clean_dropin(Views(spark, sf_dir).raw_dropin)


@query("clean_incidents", ctes("raw_incidents", body=f"""
    SELECT {num('Latitude')} AS latitude, {num('Longitude')} AS longitude, {boro('BORO_NM')} AS boro_nm,
           trim(OFNS_DESC) AS ofns_desc, CMPLNT_FR_DT AS cmplnt_fr_dt FROM raw_incidents
    WHERE {num('Latitude')} BETWEEN CAST(40.4 AS DOUBLE) AND CAST(40.95 AS DOUBLE)"""))
def clean_incidents(spark, sf_dir):
    return C.clean_incidents(Views(spark, sf_dir).raw_incidents)


@query("clean_complaints", ctes("raw_complaints", body=f"""
    SELECT {num('Latitude')} AS latitude, {num('Longitude')} AS longitude, {boro('Borough')} AS borough,
           Complaint_Type AS complaint_type, Descriptor AS descriptor, Incident_Address AS incident_address,
           Created_Date AS created_date FROM raw_complaints
    WHERE {num('Latitude')} BETWEEN CAST(40.4 AS DOUBLE) AND CAST(40.95 AS DOUBLE)"""))
def clean_complaints(spark, sf_dir):
    return C.clean_complaints(Views(spark, sf_dir).raw_complaints)


SCHOOLS = ctes("raw_facilities", "raw_womens", body=f"""
    , fac AS (SELECT 0 AS src, row_key AS k, FacName AS name, Address AS address, {boro('Boro')} AS borough,
             {num('Latitude')} AS latitude, {num('Longitude')} AS longitude FROM raw_facilities
             WHERE {NOT_JUNK} AND {classify('FacGroup', 'FacType')} = 'school'
               AND {num('Latitude')} BETWEEN CAST(40.4 AS DOUBLE) AND CAST(40.95 AS DOUBLE)),
    wom AS (SELECT 1 AS src, row_key AS k, Site_Name AS name, Street_Address AS address, {boro('Borough')} AS borough,
             {num('Lat')} AS latitude, {num('Lng')} AS longitude FROM raw_womens
             WHERE {CATEGORY} AND {num('Lat')} IS NOT NULL),
    kept AS (SELECT * FROM (SELECT * FROM fac UNION ALL SELECT * FROM wom)
             QUALIFY row_number() OVER (PARTITION BY name, latitude ORDER BY src, k) = 1)
    SELECT concat('school_', CAST(row_number() OVER (ORDER BY src, k) - 1 AS VARCHAR)) AS resource_id,
           name, address, borough, latitude, longitude, 'school' AS resource_type FROM kept""")


@query("merge_schools", SCHOOLS)
def merge_schools(spark, sf_dir):
    v = Views(spark, sf_dir)
    return C.clean_schools(C.clean_facilities(v.raw_facilities), v.raw_womens)
