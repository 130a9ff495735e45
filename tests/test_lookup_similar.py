"""Names that share a piece, and nearest vectors with ties."""

import numpy as np

from civicgraph.operators import lookup, vectors


def test_a_piece_in_all_names_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(lookup, "COMMON_PARTS", 5)
    rows = [(f"r_{i:03d}", f"Customer#{i:05d}", "shelter", None) for i in range(300)] + [("r_none", None, "shelter", "x")]
    mart = spark.createDataFrame(rows, "resource_id string, name string, resource_type string, address string")
    asked = ["r#", "R#00", "customer#00299", "29", "nowhere", "", "z", None, "r#"]
    names = spark.createDataFrame([(a,) for a in asked], "query string")
    want = [(a, *min(r for r in rows if r[1] and a.lower() in r[1].lower())) for a in asked
            if a is not None and any(r[1] and a.lower() in r[1].lower() for r in rows)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, lookup.name_lookup(names, mart).collect()), key=key) == sorted(want, key=key)


def test_ties_and_unusable_vectors_in_a_block():
    import pandas as pd
    rnd = np.random.default_rng(4)
    vecs = [list(v) for v in rnd.integers(0, 2, (80, 3)).astype(float)] + [[float("nan")] * 3, [0.0] * 3]
    ids = list(range(len(vecs)))
    rows = pd.DataFrame({"_side": [0] * len(ids) + [1] * len(ids), "_id": ids * 2, "_vec": vecs * 2})
    for k in (1, 4, 100):
        got = vectors._block_best(rows, k)
        unit = vectors._unit(vecs)
        for q in ids:
            sims = {i: round(float(unit[q] @ unit[i]), 9) for i in ids if i != q}
            want = sorted((i for i in sims if np.isfinite(sims[i])), key=lambda i: (-sims[i], i))[:k]
            assert got["_id"][got["query_id"] == q].tolist() == want


def test_tiles_of_a_block_keep_the_best_and_the_first_of_ties(monkeypatch):
    import pandas as pd
    rnd = np.random.default_rng(9)
    vecs = [list(v) for v in np.r_[rnd.normal(size=(90, 4)), np.repeat(rnd.normal(size=(5, 4)), 12, axis=0)]]
    vecs += [[float("nan")] * 4, [0.0] * 4, [0.0] * 4]
    ids = [int(i) for i in rnd.permutation(len(vecs))]
    rows = pd.DataFrame({"_side": [0] * len(ids) + [1] * len(ids), "_id": ids * 2, "_vec": vecs * 2})
    for tiles, share in (((7, 20, 9), 0.2), ((200, 13, 8), 1.0), ((50, 11, 11), 0.0)):
        for name, value in zip(("TILE_ROWS", "TILE_COLUMNS", "FIRST_COLUMNS", "DENSE_SHARE"), (*tiles, share)):
            monkeypatch.setattr(vectors, name, value)
        for k in (1, 5, 300):
            got, unit = vectors._block_best(rows, k), vectors._unit(vecs)
            for a, q in enumerate(ids):
                sims = {i: round(float(unit[a] @ unit[b]), 9) for b, i in enumerate(ids) if i != q}
                want = sorted((i for i in sims if np.isfinite(sims[i])), key=lambda i: (-sims[i], i))[:k]
                assert got["_id"][got["query_id"] == q].tolist() == want


def test_a_vector_is_copied_to_a_bounded_number_of_blocks(spark, monkeypatch):
    import pandas as pd

    def seen(k):
        def run(frames):
            for pdf in frames:
                yield pd.DataFrame({"query_id": pdf["_id"] * 10_000 + pdf["_i"] * 200 + pdf["_j"] * 2 + pdf["_side"], "_id": 1, "similarity": 0.0})
        return run

    df = spark.range(600).selectExpr("id", "array(1D, CAST(id AS DOUBLE)) AS vec")
    monkeypatch.setattr(vectors, "_best_of_blocks", seen)
    assert vectors.similar_topk(df, df, block_rows=10).count() <= 2 * 16 * 600
    monkeypatch.setattr(vectors, "BLOCK_CELLS", 60)         # blocks of 30 rows: memory comes first
    assert vectors.similar_topk(df, df, block_rows=10).count() == 2 * 20 * 600
