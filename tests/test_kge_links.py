"""Pairs of places in the data for link prediction: made from the places, not written or shuffled as triples."""

from civicgraph.operators import triples as T
from civicgraph.operators import vectors as V

PLACES = "resource_id string, resource_type string, latitude double, longitude double"
TRIPLES = "subject string, predicate string, object_val string, confidence double, source string"


def both(spark, rows, other):
    places = spark.createDataFrame(rows, PLACES)
    named = spark.createDataFrame(other, TRIPLES)
    key = lambda df: sorted(map(tuple, df.collect()))
    got = V.kge_dataset(named, links=[(places, "resource_id", T.colocation_triples)])
    return key(got), key(V.kge_dataset(named.unionByName(T.colocation_triples(places))))


def test_pairs_as_links_give_the_same_rows(spark):
    rows = [("b", "x", 1.0, 1.0), ("a", "y", 1.0, 1.0), ("a", "y", 1.0, 1.0), ("é", "y", 1.0, 1.0), (None, "z", 1.0, 1.0),
            ("c", "x", 9.0, 9.0), ("d", "x", None, 1.0), ("e", None, 1.0, 1.0)]
    other = [("a", "P", "q", .5, "s"), ("c", "P", None, .5, "s"), (None, "Q", "q", .5, "s"), ("a", "P", "q", .5, "t")]
    got, want = both(spark, rows, other)        # b and é are in pairs only, c to e in none
    assert got == want and len(got) == 5
    assert len({x for r in got for x in (r[0], r[2])}) == 4


def test_a_link_without_pairs_gives_no_ids(spark):
    got, want = both(spark, [("a", "x", 1.0, 1.0), ("b", "x", 1.0, 1.0)], [("q", "P", "r", .5, "s"), ("q", "Z", "r", .5, "s")])
    assert got == want and len(got) == 2


def test_what_is_written_and_shuffled_grows_with_the_places(spark, monkeypatch):
    places = spark.range(0, 400, 1, 2).selectExpr(
        "concat('p', id) AS resource_id", "if(id % 2 = 0, 'shelter', 'school') AS resource_type",
        "40.7D + id * 1e-9D AS latitude", "-73.9D AS longitude")
    named = places.selectExpr("resource_id AS subject", "'HAS_TYPE' AS predicate", "resource_type AS object_val", "1D AS confidence", "'x' AS source")
    written, whole = [], V.materialise

    def seen(df, name):
        out = whole(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(V, "materialise", seen)
    data = V.kge_dataset(named, links=[(places, "resource_id", T.colocation_triples)])
    assert data.count() == 400 + 200 * 200 and max(written) <= 402
    # nothing above the join that makes the pairs shuffles them: both its sides are places
    plan = data._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan[plan.index("CO_LOCATED_WITH"):]
    assert "RepartitionByExpression" not in pairs.split("Join")[0]


def test_the_query_writes_no_pairs(spark, sf_dir, monkeypatch):
    from civicgraph.plans import QUERIES, vector_queries
    from civicgraph.plans.registry import Views
    written, whole = [], vector_queries.materialise
    monkeypatch.setattr(vector_queries, "materialise", lambda df, name: written.append(whole(df, name)) or written[-1])
    rows = QUERIES["kge_dataset_store"](spark, sf_dir).count()
    pairs = T.colocation_triples(Views(spark, sf_dir).mart).count()
    assert [w.where("predicate = 'CO_LOCATED_WITH'").count() for w in written] == [0]
    assert rows == written[0].where(V.WHOLE).count() + pairs
