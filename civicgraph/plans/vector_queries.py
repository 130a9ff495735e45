"""Feature vectors and similarity search."""

from pyspark.sql import functions as F

from ..functions.numeric import round_even
from ..functions.session import materialise
from ..operators import triples as T
from ..operators import vectors as V
from .registry import Views, ctes, query, r_even
from .triple_queries import COLOCATED, COMPLAINT, CRIME, EVERY, parted_store, store, union

D = "CAST({} AS DOUBLE)".format


def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


# Every vector component as SQL, in the layout's order, over t (counts) and mart.
TYPES = ["benefits_center", "food_bank", "hospital", "school", "shelter"]


def component_sql():
    f32 = lambda e: f"CAST({e} AS FLOAT)"
    cnt = lambda p: f"coalesce(least(1, ln(1 + max(CASE WHEN predicate = '{p}' THEN CAST(object_val AS DOUBLE) END)) / 7), 0)"
    rows = [f"CASE WHEN resource_type = '{t}' THEN 1 ELSE 0 END" for t in TYPES]
    rows += [f"CASE WHEN borough = '{b}' THEN 1 ELSE 0 END" for b in V.BOROUGHS]
    rows += ["coalesce(safety_score, 0)", "coalesce(quality_score, 0)",
             f"coalesce(greatest(0, 1 - nearest_transit_walk_min / {D(30)}), 0)"]
    rows += [cnt(f"CRIME_{c}_500M") for c in V.CRIMES] + [cnt(f"COMPLAINTS_{c}_500M") for c in V.COMPLAINTS]
    rows += ["CASE WHEN capacity > 0 THEN 1 ELSE 0 END", "CASE WHEN nearest_transit_walk_min < 10 THEN 1 ELSE 0 END",
             "least(1, count(*) FILTER (predicate = 'CO_LOCATED_WITH') / 20)"]
    return "[" + ", ".join(f32(r) for r in rows) + "]"


FEATURES = ["mart", "incidents", "complaints", ("t", union(CRIME, COMPLAINT, COLOCATED)),
            ("v", f"""SELECT resource_id, {component_sql()} AS vec FROM mart m LEFT JOIN t ON t.subject = m.resource_id
             GROUP BY m.resource_id, resource_type, borough, safety_score, quality_score, nearest_transit_walk_min, capacity""")]
NAMES = V.feature_names(TYPES)
NAME_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def feature_table(spark, sf_dir):
    v = Views(spark, sf_dir)
    triples = (T.crime_triples(v.mart, v.incidents).unionByName(T.complaint_triples(v.mart, v.complaints))
               .unionByName(T.colocation_triples(v.mart)))
    return V.feature_vectors(v.mart, triples, TYPES)


@query("feature_vectors", ctes(*FEATURES, body=f"""
    , x AS (SELECT resource_id, unnest(vec) AS value, generate_subscripts(vec, 1) AS i FROM v)
    SELECT resource_id, {NAME_LIST}[i] AS feature, {r_even('value', 5)} AS value FROM x"""))
def feature_vectors(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in NAMES])
    long = feature_table(spark, sf_dir).select("resource_id", F.posexplode("vec").alias("i", "v"))
    return long.select("resource_id", F.element_at(names, F.col("i") + 1).alias("feature"), round_even("v", 5).alias("value"))


LEARNED = "vec_id, concat('shelter_', CAST(vec_id AS {s})) AS resource_id"


@query("learned_subset", ctes("mart", body=f"""
    SELECT vec_id, resource_id FROM (SELECT {LEARNED.format(s='VARCHAR')} FROM embeddings)
    WHERE resource_id IN (SELECT resource_id FROM mart)"""))
def learned_subset(spark, sf_dir):
    vec = embeddings(spark, sf_dir).selectExpr("vec_id", "concat('shelter_', CAST(vec_id AS STRING)) AS resource_id")
    return V.learned_subset(vec, Views(spark, sf_dir).mart).select("vec_id", "resource_id")


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def dot(a, b):
    return DOT.format(a=a, b=b)


def cos(a, b):
    return f"coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0), 0)"


@query("l2_normalize", f"""
    WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, sqrt({dot('embedding', 'embedding')}) AS l FROM embeddings),
    x AS (SELECT vec_id, unnest(e) / coalesce(nullif(l, 0), 1) AS value, generate_subscripts(e, 1) AS i FROM n)
    SELECT vec_id, CAST(i - 1 AS INT) AS i, {r_even('value', 6)} AS value FROM x""")
def l2_normalize(spark, sf_dir):
    unit = embeddings(spark, sf_dir).select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("i", "v"))
    return unit.select("vec_id", "i", round_even("v", 6).alias("value"))


@query("cosine", f"""
    SELECT a.vec_id, {r_even(cos('a.embedding', 'b.embedding'), 6)} AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf_dir):
    a = embeddings(spark, sf_dir)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", round_even(V.cosine("embedding", "other"), 6).alias("similarity"))


SIMILAR = """
    WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    n AS (SELECT vec_id, label, e, sqrt({nn}) AS l FROM u),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, {sim} AS s FROM n a JOIN n b ON a.vec_id <> b.vec_id {cond})
    SELECT query_id, vec_id, {r4} AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS INT) AS rank
    FROM s QUALIFY rank <= 5"""


def similar_sql(cond):
    inner = "list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))"
    return SIMILAR.format(nn="list_sum(list_transform(e, lambda x: x * x))", cond=cond, r4=r_even("s", 4),
                          sim=r_even(f"coalesce({inner} / nullif(a.l * b.l, 0), 0)", 9))


@query("similar_topk", similar_sql(""))
def similar_topk(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return V.similar_topk(e, e, 5, id_col="vec_id", vec="embedding")


@query("similar_topk_same_type", similar_sql("AND a.label = b.label"))
def similar_topk_same_type(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return V.similar_topk(e, e, 5, group="label", id_col="vec_id", vec="embedding")


PROFILE = V.profile_vector(TYPES, ["shelter", "food_bank"], "BK")


@query("profile_topk", ctes(*FEATURES, body=f"""
    , p AS (SELECT resource_id, {cos('vec', '[' + ', '.join(D(x) for x in PROFILE) + ']')} AS s FROM v)
    SELECT resource_id, {r_even('s', 4)} AS similarity FROM p ORDER BY similarity DESC, resource_id LIMIT 5"""))
def profile_topk(spark, sf_dir):
    return V.profile_topk(feature_table(spark, sf_dir), PROFILE)


@query("explain_vector", ctes(*FEATURES, body=f"""
    , x AS (SELECT resource_id, sqrt({dot('vec', 'vec')}) AS l, unnest(vec) AS value, generate_subscripts(vec, 1) AS i FROM v),
    z AS (SELECT *, count(*) OVER (PARTITION BY resource_id) AS n,
                 row_number() OVER (PARTITION BY resource_id ORDER BY abs(value) DESC, i) AS rank FROM x WHERE value <> 0)
    SELECT resource_id, CAST(n AS INT) AS nonzero_features, {r_even('l', 6)} AS vector_norm, CAST(rank AS INT) AS rank,
           {NAME_LIST}[i] AS feature, {r_even('value', 5)} AS value FROM z WHERE rank <= 15"""))
def explain_vector(spark, sf_dir):
    out = V.explain_vector(feature_table(spark, sf_dir), NAMES)
    return out.withColumn("value", round_even("value", 5))


HASH = "CAST(('0x' || substring(md5({c}), 1, 15)) AS BIGINT)"


def kge_sql(cut):
    return f"""
    , k AS (SELECT {cut("subject")} AS head, predicate AS relation, {cut("object_val")} AS tail FROM t),
    n AS (SELECT DISTINCT head AS label FROM k UNION SELECT DISTINCT tail FROM k),
    ent AS (SELECT label, row_number() OVER (ORDER BY {HASH.format(c='label')}, label) - 1 AS id FROM n),
    rel AS (SELECT relation, row_number() OVER (ORDER BY {HASH.format(c='relation')}, relation) - 1 AS id FROM (SELECT DISTINCT relation FROM k)),
    d AS (SELECT *, {HASH.format(c="concat_ws('|', head, relation, tail, '42')")} % 100 AS draw FROM k)
    SELECT h.id AS head_id, rel.id AS relation_id, o.id AS tail_id,
           CASE WHEN draw < 90 THEN 'train' WHEN draw < 95 THEN 'valid' ELSE 'test' END AS split
    FROM d JOIN ent h ON h.label = head JOIN ent o ON o.label = tail JOIN rel USING (relation)"""


@query("kge_dataset", ctes(*EVERY, body=kge_sql("{}".format)))
@query("kge_dataset_store", ctes(*EVERY, body=kge_sql("{}".format)))
def kge_dataset_store(spark, sf_dir):
    named, links = parted_store(Views(spark, sf_dir))
    return V.kge_dataset(materialise(named, "store"), links=links)      # pairs of places are written nowhere


@query("kge_dataset_short_names", ctes(*EVERY, body=kge_sql("substring({}, 1, 10)".format)))
@query("kge_dataset_store_short_names", ctes(*EVERY, body=kge_sql("substring({}, 1, 10)".format)))
def kge_dataset_store_short_names(spark, sf_dir):
    return V.kge_dataset(store(Views(spark, sf_dir)), name_length=10)   # read once
