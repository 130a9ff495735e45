"""The manifest against trees built in plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from civicgraph.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, part int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, k):
    out = []
    for level in levels[:-1]:
        out.append((k & 1, level[k ^ 1] if k ^ 1 < len(level) else None))
        k >>= 1
    return out


def brute(rows):
    trees = {}
    for doc_id, source, lang, n_chars, text, *_ in rows:
        forged = n_chars if doc_id is None or n_chars is None or zlib.crc32(str(doc_id).encode()) % 7 else n_chars + 1
        trees.setdefault(lang, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text),
                                           leaf(doc_id, source, lang, forged, text)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    grown = {lang: levels_of([r[1] for r in trees[lang]]) for lang in langs}
    over = levels_of([grown[lang][-1][0] for lang in langs])
    out = []
    for t, lang in enumerate(langs):
        for k, (doc_id, own, forged) in enumerate(trees[lang]):
            steps = path(grown[lang], k) + path(over, t)
            for right, other in steps:
                forged = H(forged) if other is None else H(other, forged) if right else H(forged, other)
            out.append((doc_id, own, grown[lang][-1][0], over[-1][0], H(*(d for _, d in steps if d)), forged,
                        forged == over[-1][0]))
    return Counter(out)


def found(spark, rows, **how):
    df = merkle.proofs(spark.createDataFrame(rows, SCHEMA), **how).drop("siblings")
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, df.collect()))


def some_rows(n, langs, seed):
    rng = random.Random(seed)
    rows = [(k * 3 - 50, rng.choice(["web", None, ""]), rng.choice(langs), rng.choice([None, k, 2 ** 31 - 1]),
             rng.choice([None, "", "é" * k, "text"]), "clash", 1) for k in range(n)]
    rows += rows[:5] + [(7, "x", "de", 1, "another text", None, None)] * 3 + [(None, None, None, None, None, None, None)] * 2
    rows += [(1, "s", "de", 5, "word " * 50_000, "a", 2)]
    rng.shuffle(rows)
    return rows


def test_equals_plain_trees(spark):
    rows = some_rows(150, ["de", "en", None, "", "z", "é", "\U0001f600", "￿"], 1)
    want = brute(rows)
    assert found(spark, rows) == want
    assert {r[-1] for r in want} == {True, False}


def test_short_runs_and_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FIRST", 3)
    monkeypatch.setattr(merkle, "STEP", 2)
    monkeypatch.setattr(merkle, "TOP", 4)
    rows = some_rows(120, ["de"] * 9 + [None, "en"], 2) + [(k, None, f"lang {k}", 1, "t", None, 0) for k in range(30)]
    want = brute(rows)
    for longest in (1, 5, 8):
        assert found(spark, rows, run_rows=longest) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_small_tables(spark, n):
    rows = [(k, "s", "en", 3, "abc", None, 0) for k in range(n)]
    assert found(spark, rows) == brute(rows)


def test_largest_count_can_be_tampered_with(spark):
    at = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 0)
    df = spark.createDataFrame([(at, "s", "en", 2 ** 63 - 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.manifest(df).first()
    assert row.folded_root == leaf(at, "s", "en", 2 ** 63, "t") and not row.verified


def test_siblings_are_the_proof(spark):
    rows = some_rows(40, ["de", "en"], 3)
    for r in merkle.proofs(spark.createDataFrame(rows, SCHEMA)).collect():
        assert H(*r.siblings) == r.proof_sha256


def test_lacking_is_the_least_set():
    rng = np.random.default_rng(4)
    for size in (1, 2, 7, 16, 33):
        for _ in range(10):
            want = np.unique(rng.integers(0, size, rng.integers(1, size + 1)))
            need, at = set(), set(want.tolist())
            known = {(0, p) for p in at}
            for level in range(merkle.height(size)):
                for p in sorted(at):
                    if p ^ 1 < merkle.level_size(size, level) and (level, p ^ 1) not in known:
                        need.add((level, p ^ 1))
                at = {p >> 1 for p in at}
                known |= {(level + 1, p) for p in at}
            got = merkle.lacking(want, size)
            assert len(got) == len(set(got)) and set(got) == need
