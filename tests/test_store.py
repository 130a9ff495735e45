"""What reads the triple store reads all of it."""

from pyspark.sql import functions as F

from civicgraph.operators import evidence as G
from civicgraph.plans import QUERIES


def test_briefing_names_crime_and_complaint_facts(spark, sf_dir):
    seen = QUERIES["intake_briefing_full"](spark, sf_dir).agg(
        *[F.count_if(F.contains("reasoning", F.lit(p))).alias(p) for p in ("CRIME_", "COMPLAINTS_")]).first()
    assert any(p.startswith("CRIME_") for p in G.PRIORITY_PREDICATES)
    assert seen["CRIME_"] > 0 and seen["COMPLAINTS_"] > 0


def some_store(spark, sf_dir):
    from civicgraph.operators.store import TripleStore
    from civicgraph.plans.registry import Views
    from civicgraph.plans.triple_queries import store
    triples = store(Views(spark, sf_dir))
    return triples, TripleStore.write(triples)


def test_each_question_uses_the_copy_whose_first_columns_it_fixes(spark, sf_dir):
    from civicgraph.operators.store import order_for
    triples, found = some_store(spark, sf_dir)
    asked = triples.where("predicate = 'HAS_TYPE'").orderBy("subject").first()
    cases = {"spo": {"subject": asked.subject}, "pos": {"predicate": "HAS_TYPE", "object_val": asked.object_val},
             "osp": {"object_val": asked.object_val}}
    for order, fixed in cases.items():
        assert order_for(**fixed) == order
        df = found.match(**fixed)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"/{order}]" in plan
        if order == "pos":
            assert "PartitionFilters: [isnotnull(predicate" in plan and "EqualTo(o," in plan
        else:
            assert f"EqualTo({order[0]}," in plan
        want = triples.where(" and ".join(f"{k} = '{v}'" for k, v in fixed.items()))
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())) != []
    both = found.match(subject=asked.subject, object_val=asked.object_val, predicate="HAS_TYPE", source=asked.source)
    assert [r.object_val for r in both.collect()] == [asked.object_val]
    assert found.match(subject="no such term").count() == found.match(predicate="NO_SUCH").count() == 0
    assert found.match().count() == triples.where("object_val is not null").count()


def test_row_groups_without_the_number_are_skipped(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    from civicgraph.operators import store as S
    rows = spark.range(200_000).selectExpr("concat('subject ', id % 5000) as subject", "concat('P', id % 3) as predicate",
                                           "concat('object ', id % 20011) as object_val", "0.5D as confidence", "'x' as source")
    before, S.GROUP_BYTES = S.GROUP_BYTES, 1 << 14
    try:
        store = S.TripleStore.write(rows, str(tmp_path / "store"))
    finally:
        S.GROUP_BYTES = before
    for order, column in (("spo", "s"), ("osp", "o")):
        number = store.number("subject 77" if column == "s" else "object 77")
        groups = [g.column(j).statistics for f in glob.glob(f"{store.folder}/{order}/*.parquet")
                  for g in [pq.ParquetFile(f).metadata.row_group(k) for k in range(pq.ParquetFile(f).num_row_groups)]
                  for j in range(g.num_columns) if g.column(j).path_in_schema == column]
        hit = [s for s in groups if s.min <= number <= s.max]
        assert len(groups) >= 4 and 1 <= len(hit) <= 2
    assert store.match(subject="subject 77").count() == 40


def test_terms_sort_as_their_numbers_and_nulls_are_left_out(spark):
    from civicgraph.operators.store import TripleStore
    rows = [("b", "P", "é", .5, "x"), ("a", "P", "b", .5, None), ("a", "P", "b", .5, "y"), ("c", "Q", None, 1., "x"), (None, "P", "b", 1., "x"),
            ("a", None, "b", 1., "x"), ("", "P", "", 1., "x")]
    store = TripleStore.write(spark.createDataFrame(rows, "subject string, predicate string, object_val string, confidence double, source string"))
    terms = [r.term for r in store.table("terms").orderBy("id").collect()]
    assert terms == ["", "a", "b", "é"]
    assert sorted(map(str, store.match().collect())) == sorted(map(str, store.match().collect()))
    assert store.match().count() == 4 and store.match(subject="").first().object_val == ""
    assert [r.subject for r in store.subjects_with(("P", "b"), ("P", "b")).collect()] == ["a"]
    assert store.subjects_with(("P", "b"), ("P", "é")).count() == 0


def test_pairs_made_from_numbers_give_the_same_store(spark, sf_dir):
    """Pairs as links: the same triples in every copy, and no name of a pair is looked up."""
    from civicgraph.operators import triples as T
    from civicgraph.operators.store import ORDERS, TripleStore
    from civicgraph.plans.registry import Views
    from civicgraph.plans.triple_queries import store, written_store
    v = Views(spark, sf_dir)
    found, want = written_store(v), store(v)
    assert sorted(map(tuple, found.match().collect())) == sorted(map(tuple, want.collect()))
    for order in ORDERS:
        assert found.table(order).count() == want.count()
    # names may repeat or be null, and some are in pairs only
    rows = [("b", "x", 1.0, 1.0), ("a", "y", 1.0, 1.0), ("a", "y", 1.0, 1.0), ("é", "y", 1.0, 1.0), (None, "z", 1.0, 1.0), ("c", "x", 9.0, 9.0)]
    places = spark.createDataFrame(rows, "resource_id string, resource_type string, latitude double, longitude double")
    other = spark.createDataFrame([("a", "P", "q", .5, "s")], "subject string, predicate string, object_val string, confidence double, source string")
    got = TripleStore.write(other, links=[(places, "resource_id", T.colocation_triples)])
    pairs = sorted((r.subject, r.object_val) for r in got.match(predicate="CO_LOCATED_WITH").collect())
    assert pairs == sorted((r.subject, r.object_val) for r in T.colocation_triples(places).collect()) == [("a", "b"), ("a", "b"), ("b", "é")]
    assert got.table("coded").count() == 1 and all(got.table(order).count() == 4 for order in ORDERS)
    assert [r.id for r in got.table("terms").orderBy("term").collect()] == [0, 1, 2, 3, 4]


def test_pairs_are_written_as_lists(spark):
    """What is written for pairs of places grows with the places, and a question reads only the lists that it needs."""
    import glob

    import pyarrow.parquet as pq
    from civicgraph.operators import store as S
    from civicgraph.operators import triples as T
    places = spark.range(0, 300, 1, 2).selectExpr(
        "concat('p', id) AS resource_id", "if(id % 2 = 0, 'shelter', 'school') AS resource_type",
        "40.7D + id * 1e-9D AS latitude", "-73.9D AS longitude")
    named = places.selectExpr("resource_id AS subject", "'HAS_TYPE' AS predicate", "resource_type AS object_val", "1D AS confidence", "'x' AS source")
    made = []

    def once(df):
        pairs = T.colocation_triples(df)
        made.append(pairs)
        return pairs

    found = S.TripleStore.write(named, links=[(places, "resource_id", once)])
    rows = lambda part: sum(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{found.folder}/{part}/**/*.parquet", recursive=True))
    assert len(made) == 1 and all(rows(order) == 300 for order in S.ORDERS) and rows("lists") < 5000
    want = sorted(map(tuple, T.colocation_triples(places).unionByName(named).collect()))
    assert sorted(map(tuple, found.match().collect())) == want and len(want) == 300 + 150 * 150
    for fixed in ({"subject": "p7"}, {"object_val": "p8"}, {"subject": "p17", "object_val": "p8"}, {"predicate": "CO_LOCATED_WITH", "object_val": "p8"},
                  {"subject": "p17", "predicate": "CO_LOCATED_WITH", "object_val": "p8"}, {"subject": "p7", "source": "x"},
                  {"subject": "p7", "min_confidence": 0.9}):
        keep = lambda r: all(r[k] == v for k, v in zip(("subject", "predicate", "object_val", "source"),
                                                       map(fixed.get, ("subject", "predicate", "object_val", "source"))) if v is not None)
        named_rows = [r for r in map(lambda r: dict(zip(T.COLUMNS, r)), want) if keep(r) and r["confidence"] >= fixed.get("min_confidence", 0)]
        assert sorted(map(tuple, found.match(**fixed).collect())) == sorted(tuple(r.values()) for r in named_rows) != []
    plan = found.match(object_val="p8")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key," in plan and "PartitionFilters: [isnotnull(side" in plan
    assert sorted(r.subject for r in found.subjects_with(("CO_LOCATED_WITH", "p8"), ("HAS_TYPE", "school")).collect()) == \
        [r[0] for r in want if r[2] == "p8"] != []


def test_links_of_several_kinds_and_none(spark, monkeypatch):
    from civicgraph.operators import store as S
    monkeypatch.setattr(S, "PACK_ROWS", 50)
    table = spark.createDataFrame([(c,) for c in "abcdefgh"] + [(None,)], "name string")
    other = spark.createDataFrame([("a", "P", "q", .5, "s")], "subject string, predicate string, object_val string, confidence double, source string")

    def make(t):
        pairs = t.crossJoin(t.withColumnRenamed("name", "o")).where("name <= o")
        return pairs.selectExpr("name AS subject", "if(name = o, 'SAME', '1') AS predicate", "o AS object_val",
                                "if(name = o, CAST(NULL AS DOUBLE), 0.5D) AS confidence", "if(name < o, 'y', CAST(NULL AS STRING)) AS source")

    key = lambda df: sorted(map(str, df.collect()))
    got = S.TripleStore.write(other, links=[(table, "name", make), (table, "name", lambda t: make(t).where("predicate = '1'"))])
    want = other.unionByName(make(table)).unionByName(make(table).where("predicate = '1'"))
    assert key(got.match()) == key(want)
    assert key(got.match(predicate="1", object_val="c")) == key(want.where("predicate = '1' and object_val = 'c'"))
    none = S.TripleStore.write(other, links=[(table, "name", lambda t: make(t).where("predicate = 'no'"))])
    assert key(none.match()) == key(other) and none.match(predicate="SAME").count() == 0


def test_numbers_of_lists_come_back():
    import numpy as np
    from civicgraph.operators import store as S
    values = np.r_[0, 1, 127, 128, 16383, 16384, 2 ** 31, 2 ** 40, 2 ** 62 - 1]
    assert (S._from_varints(S._varints(values)[0]) == values).all() and not len(S._from_varints(S._varints(values[:0])[0]))
    rnd = np.random.default_rng(5)
    for top in (40, 1 << 33):
        s, o = rnd.integers(0, top, 500), rnd.integers(0, top, 500)
        key, low, n, gaps = S._lists(s % 7, o)
        got = [(k, x) for k, first, m, g in zip(key, low, n, gaps.to_pylist())
               for x in first + np.r_[0, np.cumsum(S._from_varints(np.frombuffer(g, np.uint8)))] if len(g) >= m - 1]
        assert got == sorted(zip(s % 7, o)) and list(key) == sorted(set(s % 7))
