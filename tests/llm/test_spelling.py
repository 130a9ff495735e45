"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from civicgraph.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int"


def words(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    n = words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, rows):
    df = spelling.spelling_groups(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def rows_of(seed):
    rng = random.Random(seed)
    stems = ["research", "RESEARCH", "façadeÿs", "over×seas", "aaaaaaa", "ababababa", "naïveté", "straßenbahn", "longword" * 40]
    letters = "abcdeéèÿ"
    variants = []
    for stem in stems:
        for _ in range(30):
            w, k = stem, rng.randrange(len(stem) + 1)
            kind = rng.randrange(3)
            w = w[:k] + rng.choice(letters) + w[k + (kind == 0):] if kind else w[:k] + w[k + 1:]
            variants += [w] * rng.choice([1, 2, 3])
    text = [v for s in stems for v in [s] * 40] + variants + ["short", "ABCDEF", "x" * 6, "y" * 7, "y" * 7]
    rng.shuffle(text)
    rows = [(k, " ".join(text[k::25]) + rng.choice(["", ".", " 12"]), "clash", 1) for k in range(25)]
    return rows + [(None, " ".join(stems * 3), None, None), (7, "research;research", "x", 2), (7, "research;research", "x", 2),
                   (8, None, "x", 0), (9, "", "x", 0), (-3, "fácade façades façades", "x", 0)]


def test_equals_all_pairs(spark):
    for seed in range(2):
        rows = rows_of(seed)
        want = brute(rows)
        assert len(want) > 100 and any(r[1] for r in want)
        assert found(spark, rows) == want


def test_crowded_lists_in_pieces(spark):
    rng = random.Random(9)
    vocabulary = sorted({"abc" + "".join(rng.choice("abé") for _ in range(rng.choice([4, 5]))) for _ in range(150)})
    df = spark.createDataFrame([(w, k) for k, w in enumerate(vocabulary)], "word string, n long")
    want = sorted(sorted((a, b)) for k, a in enumerate(vocabulary) for b in vocabulary[:k] if one_edit(a, b))
    for limit in (2, 2048):
        got = [sorted((r.a, r.b)) for r in spelling.near_pairs(df, limit).collect()]
        assert sorted(got) == want


def test_chains_are_followed_to_their_end(spark):
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb"]
    rows = [(k, " ".join([w] * 2 * 10 ** k), "x", 1) for k, w in enumerate(chain)]
    want = brute(rows)
    assert found(spark, rows) == want
    assert any(r[1] and r[1] != r[2] for r in want)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None, None), (2, "one word each only", None, None)]) == []
