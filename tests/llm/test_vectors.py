"""Vector near-copies against all pairs."""

import numpy as np
import pytest

from civicgraph.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, label int, node string"


def brute(rows, cosine=.95):
    clean = [(k, vectors._clean(v)) for k, (_, v, *_) in enumerate(rows)]
    label = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, x in clean:
        for b, y in clean[:a]:
            if x is not None and y is not None and len(x) == len(y) and \
                    x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine - 1e-12:
                links[a] += 1
                links[b] += 1
                label[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, links[k], least[root(k)], i == least[root(k)]) for k, (i, *_) in enumerate(rows))


def found(spark, rows):
    df = vectors.near_copies(spark.createDataFrame(rows, SCHEMA))
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def groups(seed, centres, each, noise, dim=32):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(centres):
        c = rng.normal(size=dim)
        out += [c + rng.normal(size=dim) * noise for _ in range(each)]
    return [x.tolist() for x in out]


def test_close_groups_are_exact(spark):
    data = groups(1, 20, 6, .05) + groups(2, 60, 1, 0)
    data += data[:15] + [[2 * v for v in x] for x in data[:5]]
    rows = [(500 - k, x, k % 3, "n") for k, x in enumerate(data)]
    assert found(spark, rows) == brute(rows)


def test_one_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = [(k, x, 0, "n") for k, x in enumerate(groups(3, 1, 90, .08) + groups(4, 30, 1, 0))]
    got, want = found(spark, rows), brute(rows)
    assert sum(r[1] for r in got) >= .98 * sum(r[1] for r in want)
    assert all(a[1] <= b[1] for a, b in zip(got, want)) and [r[2] for r in got] == [r[2] for r in want]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 0, None), (2 * k + 1, (.9501 * a + np.sqrt(1 - .9501 ** 2) * b).tolist(), 0, None)]
    assert sum(r[1] for r in found(spark, rows)) >= .95 * 800


def test_edge_cases(spark):
    x = groups(6, 1, 1, 0, dim=4)[0]
    rows = [(1, None, 0, None), (2, [0.0] * 4, 0, None), (3, [1.0, None, 2.0, 3.0], 0, None),
            (4, [1.0, float("nan"), 2.0, 3.0], 0, None), (5, [float("inf"), 1.0, 2.0, 3.0], 0, None), (6, [], 0, None),
            (7, x, 0, None), (8, x, 1, None), (9, [-v for v in x], 0, None), (10, x[:3], 0, None), (7, x, 0, None),
            (11, [1e-200 * v for v in x], 0, None), (12, [1e200 * v for v in x], 0, None)]
    assert found(spark, rows) == brute([r if r[0] not in (11, 12) else (r[0], x, 0, None) for r in rows])
    assert found(spark, []) == []
    none = vectors.near_copies(spark.createDataFrame([(None, x, 0, None), (4, x, 0, None)], SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in none) == [("4", 1, 4, True), ("None", 1, 4, False)]


@pytest.mark.parametrize("n", [2, 1000, 10 ** 9])
def test_plan_meets_close_pairs_and_few_strangers(n):
    k, tables = vectors.plan(n)
    near, far = vectors._together(np.sqrt(.1)), vectors._together(np.sqrt(2))
    assert 1 - (1 - near ** k) ** tables >= vectors.RECALL and n * far ** k <= vectors.STRANGERS
