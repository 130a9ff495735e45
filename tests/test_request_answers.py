"""Every request comes to at least one row, whatever becomes of it."""

import pytest

from civicgraph.operators import textrules as X
from civicgraph.plans import QUERIES, rule_queries
from civicgraph.plans.lookup_queries import lots
from civicgraph.plans.registry import Views
from civicgraph.sources.fixtures import view

TEXTS = {1: "My SSN is 123-45-6789", 2: "shelters in Brooklyn", 3: "cold emergency, 30 people outside in Brooklyn",
         4: "which boroughs are most underserved", 5: "I am homeless with 2 kids and need food", 6: None, 7: ""}


@pytest.fixture(scope="module")
def answered(spark, sf_dir):
    v = Views(spark, sf_dir)
    asked = spark.createDataFrame(list(TEXTS.items()), "request_id long, text string")
    rows = rule_queries.request_outcomes(asked, v.mart, lots(v)).collect()
    return {i: sorted((r for r in rows if r.request_id == i), key=lambda r: r.item) for i in TEXTS}


def test_each_kind_of_request_has_its_rows(answered):
    assert {i: rows[0].outcome for i, rows in answered.items()} == {
        1: "stopped", 2: "lookup", 3: "simulate", 4: "simulate", 5: "assessed", 6: "lookup", 7: "lookup"}
    assert all([r.item for r in rows] == list(range(1, len(rows) + 1)) for rows in answered.values())
    assert answered[1][0].kind == "pii_detected" and answered[1][0].detail
    assert len(answered[2]) == rule_queries.LOOKUP_TOP and "shelter" in {r.kind for r in answered[2]}
    assert sum(int(r.detail) for r in answered[3] if r.kind == "shelter") == 30
    rates = [float(r.detail) for r in answered[4]]
    assert len(rates) > 1 and rates == sorted(rates)


def test_no_request_is_lost(spark, sf_dir):
    got = {r.request_id: r.outcome for r in QUERIES["request_answers"](spark, sf_dir).collect()}
    asked = view(spark, sf_dir, "requests").select("request_id", X.screen_reason("text").alias("reason")).collect()
    assert set(got) == {r.request_id for r in asked}
    assert {i for i, o in got.items() if o == "stopped"} == {r.request_id for r in asked if r.reason}
    print(len(asked), len(got), {o: list(got.values()).count(o) for o in set(got.values())})
