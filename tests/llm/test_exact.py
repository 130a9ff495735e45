"""Exact duplicates against a dictionary of texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from civicgraph.llm import exact

SCHEMA = "doc_id long, text string, keep_id string, tag string, digest int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(lower(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        kept = ids.index(keep)
        for k, i in enumerate(ids):
            out.append((i, keep, len(ids), k == kept, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


def found(spark, rows, parts):
    df = exact.exact_groups(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return Counter(map(tuple, df.collect()))


def test_groups_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["", None, "A", "a", "É", "é", " a", "Straße", "STRASSE", "İ", "word " * 100_000, "WORD " * 100_000, "\x00"]
    texts += ["".join(rng.choice("abAB") for _ in range(rng.randrange(6))) for _ in range(400)]
    texts += ["the hot text of a third of all rows"] * 300
    rows = [(k, t, "clash", None, 1) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(None, "no id", "x", "x", None), (None, "NO ID", "x", "x", None), (None, "alone", "x", "x", None),
             (None, "one id", "x", "x", None), (9000, "one id", "x", "x", None), (9000, "One Id", "x", "x", None),
             (-2 ** 63, "least", "x", "x", None), (2 ** 63 - 1, "least", "x", "x", None), (77, "again", None, None, 0),
             (77, "again", None, None, 0), (77, "another text of the id", None, None, 0)]
    want = brute(rows)
    for parts in (1, 7):
        assert found(spark, rows, parts) == want


def test_no_rows_and_no_texts(spark):
    assert found(spark, [], 2) == Counter()
    assert found(spark, [(1, None, None, None, None), (2, "", None, None, None)], 2) == brute([(1, None), (2, "")])


def test_keep_last(spark):
    rows = [(1, "x", "a", "a", 1), (2, "X", "b", "b", 2), (3, "y", "c", "c", 3), (None, "z", "d", "d", 4)]
    got = exact.keep_last(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows[1:], key=str)


@pytest.mark.parametrize("seed", range(6))
def test_golomb_code_round_trip(seed):
    rng = np.random.default_rng(seed)
    for span, n in [(1, 1), (2, 2), (1000, 1000), (10 ** 6, 3000), (2 ** 50, 500), (2 ** 40, 0), (7, 3)]:
        values = np.unique(rng.integers(0, span, n))
        bits, code = exact.golomb_encode(values, span)
        assert (exact.golomb_decode(code, len(values), bits) == values).all()
    values = np.unique(rng.integers(0, 2 ** 30, 100_000))
    _, code = exact.golomb_encode(values, 2 ** 30)
    assert 8 * len(code) / len(values) < np.log2(2 ** 30 / len(values)) + 2


def test_fingerprints_that_collide_are_parted_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact.Plan, "__init__", lambda self, rows, parts: self.__dict__.update(bits=2, owners=2, width=2))
    rows = [(k, f"text {k // 2}", None, None, None) for k in range(60)]
    assert found(spark, rows, 5) == brute(rows)
