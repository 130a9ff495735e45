"""The n-gram Jaccard join against all pairs."""

import random
import re

import pytest

from civicgraph.llm import jaccard
from civicgraph.llm.components import components

SCHEMA = "doc_id long, text string"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = words_of(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """[(doc_id, size, component)] by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def found(spark, rows, schema=SCHEMA):
    df = jaccard.ngram_components(spark.createDataFrame(rows, schema))
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def near_copies(seed, n, words=90, edits=6, base=None):
    rng = random.Random(seed)
    text = base or [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(text)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(copy))
    return out


def test_against_all_pairs(spark):
    rng = random.Random(1)
    texts = [t for s in range(12) for t in near_copies(s, 9)]
    texts += [" ".join(f"v{rng.randrange(60)}" for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    passage = [f"p{k}" for k in range(30)]                        # shared by many otherwise different texts
    texts += [" ".join(passage + [f"q{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(4, 30))]) for _ in range(40)]
    texts += texts[:20] + [texts[0].upper()]
    rng.shuffle(texts)
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    assert found(spark, rows) == brute(rows)


def test_threshold_is_exact(spark):
    base = [f"a{k}" for k in range(32)]                           # 28 shingles
    rows = [(1, " ".join(base))]
    rows += [(k, " ".join(base + [f"z{k}_{j}" for j in range(k)])) for k in (8, 9, 10, 11)]
    assert found(spark, rows) == brute(rows)


def test_one_group_of_near_copies_is_not_compared_pairwise(spark):
    rows = [(k, t) for k, t in enumerate(near_copies(3, 260, words=120, edits=4))]
    assert found(spark, rows) == brute(rows)


def test_long_lists_go_through_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    rows = [(k, t) for k, t in enumerate(near_copies(5, 70, words=60, edits=5) + near_copies(6, 40, words=20))]
    import itertools
    import numpy as np
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    ids = np.arange(50, dtype=np.int64)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(np.ones(50, np.int64)), pa.array(ids), pa.array(ids),
                                        pa.array(np.sort(40 + ids % 20)), pa.array(np.full(50, 40))],
                                       names=["sig", "cls", "comp", "size", "rest"])
    out = list(jaccard._cross(iter([batch])))
    packed = [b for b in out if b.column(0)[0].as_py() is None]
    pairs = {(a, b) for x in jaccard._blocks(iter(packed)) for a, b in zip(*(c.to_pylist() for c in x.columns))}
    size, rest = np.sort(40 + ids % 20), np.full(50, 40)
    assert pairs == {(a, b) for a, b in itertools.combinations(range(50), 2)
                     if jaccard._fits(size[a], rest[a], size[b], rest[b])}
    assert found(spark, rows) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"L{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (7, "one"), (8, long),
            (9, long + " end"), (10, "a a a a a a a"), (11, "a a a a a a a a a"), (12, "é É b c d"), (13, "é é b c d"),
            (14, "x y z")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_repeated_rows_null_ids_and_extra_columns(spark):
    rows = [(5, "a b c d e f", "x", 1), (5, "a b c d e f", "y", 2), (None, "a b c d e f", "z", 3), (7, None, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, n int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.ngram_components(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (7, 0, 7)], key=str)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [5, 7, None]


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(1, 2)], [(2, 1), (1, 2)], [(k, k + 1) for k in range(60)],
    [(0, k) for k in range(1, 200)], [(5, 3), (3, 9), (7, 8), (None, 2)]])
def test_components(spark, edges):
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            x, y = label.get(a, {a}), label.get(b, {b})
            for k in x | y:
                label[k] = x | y
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: min(v) for k, v in label.items()}


def test_rows_without_an_id_link_others(spark):
    words = [f"w{k}" for k in range(120)]
    left, right = list(words), list(words)
    for k in (10, 22):
        left[k], right[k + 60] = "x", "y"
    rows = [(1, " ".join(left)), (None, " ".join(words)), (3, " ".join(right)), (None, " ".join(words)), (None, "some other text here now"),
            (8, "u " * 3), (None, None)]
    one, two = shingles(rows[0][1]), shingles(rows[2][1])
    assert 100 * len(one & two) < 75 * len(one | two)       # only the row without an id links them
    got = {(r.doc_id, r.n_shingles): r.component_id for r in
           jaccard.ngram_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 116] == got[None, 116] == got[3, 116] == 1
    assert got[None, 1] is None and got[8, 1] == 8 and got[None, 0] is None


def near_misses(seed, n, size, most):
    """A set, and sets that differ from it in up to ``most`` of its entries, some by the same changes."""
    import numpy as np
    rng = np.random.default_rng(seed)
    base = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
    changes = rng.integers(0, 1 << 64, 3 * most, dtype=np.uint64)
    out = []
    for _ in range(n):
        k = rng.integers(0, most + 1)
        kept = np.delete(base, rng.choice(len(base), k, replace=False))
        out.append(np.unique(np.r_[kept, rng.choice(changes, k), rng.integers(0, 1 << 64, k // 4, dtype=np.uint64)]))
        if rng.random() < 0.5:                                      # and some differ little from such a set
            last = out[-1]
            again = np.delete(last, rng.choice(len(last), len(last) // 12, replace=False))
            out.append(np.unique(np.r_[again, rng.integers(0, 1 << 64, len(last) // 20, dtype=np.uint64)]))
    return base, out


@pytest.mark.parametrize("seed, size, most", [(1, 60, 30), (2, 200, 60), (3, 8, 6)])
def test_differences_answer_for_pairs(seed, size, most):
    import itertools
    import numpy as np
    base, sets = near_misses(seed, 60, size, most)
    order = np.random.default_rng(9).integers(0, 50, 1 << jaccard.BUCKET_BITS)

    def links(x, y):
        both = len(np.intersect1d(x, y))
        return 100 * both >= 75 * (len(x) + len(y) - both)
    told = [jaccard._difference(base, s, order) for s in sets]
    checked = 0
    for (x, one), (y, two) in itertools.combinations(zip(sets, told), 2):
        if one is None or two is None:
            continue
        by_base = [t[2] <= 25 * len(base) for t in (one, two)]
        assert by_base == [links(base, x), links(base, y)]          # R's answers follow from the need alone
        if links(x, y) and not all(by_base):                        # every other link shares an entry in reach
            rest = {int(e): int(r) for e, r in zip(one[0], one[1])}
            assert any(350 * min(rest.get(int(e), -1), int(r)) >= one[2] + two[2] for e, r in zip(two[0], two[1]))
            checked += 1
    assert checked


def test_sketches_rule_out_no_link():
    import numpy as np
    for seed, size, most in ((4, 40, 12), (5, 300, 60), (6, 3000, 700)):
        _, sets = near_misses(seed, 40, size, most)
        n, words = len(sets), jaccard.SKETCH // 64
        sketch = np.frombuffer(b"".join(map(jaccard._sketch, sets)), np.int64).reshape(n, words)
        ids, size = np.arange(n), np.array([len(s) for s in sets])
        cols = [ids, ids, ids, size, size, 0 * size, *sketch.T]
        a, b = jaccard._block_pairs(cols, cols, True)
        kept, linked = set(zip(a.tolist(), b.tolist())), set()
        for i in range(n):
            for j in range(i + 1, n):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    linked.add((i, j))
        assert linked <= kept and linked
        if len(sets[0]) < 1000:
            assert len(kept - linked) < n * (n - 1) / 8             # and they rule out most others


def test_group_whose_members_nearly_link(spark, monkeypatch):
    checked = []
    verify = jaccard._links

    def count(pairs, sets, scratch):
        checked.append(pairs.count())
        return verify(pairs, sets, scratch)
    monkeypatch.setattr(jaccard, "_links", count)
    texts = near_copies(11, 200, words=120, edits=14)
    rows = [(k, t) for k, t in enumerate(texts + near_copies(12, 30, edits=12, base=texts[7].split()))]
    assert found(spark, rows) == brute(rows)
    assert checked[-1] < 8 * len(rows)              # all pairs: 26335
