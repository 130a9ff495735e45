"""Values that must come out as published, written out here and not taken from the operators."""

import pytest
from pyspark.sql import functions as F

from civicgraph.operators import cases as C
from civicgraph.operators import lookup as L
from civicgraph.operators import rules as K
from civicgraph.operators import textrules as X
from civicgraph.operators import triples as T


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, x {kind}")
    return [r[0] for r in df.orderBy("k").select(expr).collect()]


def test_poverty_levels(spark):
    want = [15060, 20440, 25820, 31200, 36580, 41960, 47340, 52720, 58100, 63480]
    assert column(spark, K.poverty_level("x").cast("int"), range(1, 11), "int") == want


def test_crime_categories(spark):
    given = ["ROBBERY", "FELONY ASSAULT", "PETIT LARCENY", "BURGLARY", "DANGEROUS DRUGS", "HARRASSMENT 2", "FRAUDS"]
    got = column(spark, T.crime_category("x"), given)
    assert got == ["violent", "violent", "property", "property", "drugs", "harassment", "other"]


def test_complaint_categories(spark):
    given = ["UNSANITARY CONDITION", "HEAT/HOT WATER", "PLUMBING", "ELEVATOR", "APPLIANCE", "Noise"]
    assert column(spark, T.complaint_category("x"), given) == ["unsanitary", "heating", "structural", "safety", "general", "other"]


def test_expanded_types(spark):
    given = [["medical"], ["Housing "], ["food", "food"], ["education"], ["spa"]]
    assert column(spark, L.expand_types("x"), given, "array<string>") == [
        ["hospital", "clinic", "mental_health"], ["shelter", "nycha", "dropin_center"], ["food_bank"],
        ["school", "childcare", "education"], ["spa"]]


@pytest.mark.parametrize("lat, lon, want", [
    (40.85, -73.90, "BX"), (40.75, -73.98, "MN"), (40.65, -73.95, "BK"), (40.72, -73.80, "QN"),
    (40.58, -74.15, "BK"), (40.70, -74.30, "SI")])      # boxes overlap: the first that holds a point wins
def test_boroughs_of_points(spark, lat, lon, want):
    df = spark.createDataFrame([(lat, lon)], "latitude double, longitude double")
    assert df.select(L.borough_from_point()).first()[0] == want


def test_needs_of_types(spark):
    given = ["shelter", "nycha", "hospital", "food_bank", "school", "domestic_violence", "legal_aid", "spa"]
    got = column(spark, C.type_to_need("x"), given)
    assert got[0:2] == ["housing", "housing"] and got[3:] == ["food", "school", "safety", "legal", "spa"]


def test_confidence_of_triples(spark):
    row = spark.createDataFrame(
        [("r1", "shelter", "Home", "1 Main St", "BK", 40.7, -73.9, 10.0, "Stop", 3.0, 0.5, 0.5, True)],
        "resource_id string, resource_type string, name string, address string, borough string, latitude double, longitude double, "
        "capacity double, nearest_transit_name string, nearest_transit_walk_min double, safety_score double, quality_score double, "
        "ada_accessible boolean")
    got = {r.predicate: r.confidence for r in T.resource_triples(row).collect()}
    assert {k: got[k] for k in ("HAS_TYPE", "HAS_NAME", "IN_BOROUGH", "NEAREST_TRANSIT")} == {
        "HAS_TYPE": 0.95, "HAS_NAME": 1.0, "IN_BOROUGH": 1.0, "NEAREST_TRANSIT": 0.8}


def test_stories_by_need(spark):
    assert column(spark, K.stories_for_need("x"), ["food", "legal", "unknown"]) == [
        ["linh-newcomer"], ["ahmad-dv"], ["maria-housing", "james-reentry", "linh-newcomer"]]


def test_intents_of_texts(spark):
    texts = ["Cold emergency, 50 people at 20F in Queens", "Which area is most underserved?",
             "I'm homeless with two kids, hungry, pregnant and fleeing abuse in Flatbush", "food pantry in the Bronx"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    rows = X.intent_rules(df).orderBy("k").collect()
    assert [r.intent for r in rows] == ["simulate", "simulate", "needs_assessment", "lookup"]
    assert (rows[0].scenario, rows[0].people, rows[0].temperature, rows[0].borough) == ("cold_emergency", 50, 20, "QN")
    assert rows[1].scenario == "resource_gap" and rows[2].borough == "BK" and rows[3].resource_types == ["food_bank"]
    assert [(n.category, n.priority) for n in rows[2].needs] == [
        ("housing", 1), ("food", 2), ("school", 3), ("safety", 1), ("medical", 2)]
    cut = X.intent_rules(df, most_needs=3, situation_length=10).where(F.col("k") == 2).first()
    assert len(cut.needs) == 3 and cut.situation == texts[2][:10]
