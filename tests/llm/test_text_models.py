"""Toxicity and quality: held-out accuracy, determinism and edge cases."""

import random

import pytest

from civicgraph.llm import quality, toxicity
from civicgraph.llm.common import table

SF = "/root/testdata/sf0.1"
DOCS, LABELS = "doc_id long, text string, lang string, source string", "doc_id long, quality int, toxic int"


def corpus(n=500, seed=2):
    """Half the documents carry the marks that their labels are about."""
    rng = random.Random(seed)
    stems = ["ner", "tion", "ble", "the", "ing", "sha", "ou", "reat", "hol"]
    bad = ["grumble", "snark", "vilest"]
    docs, labels = [], []
    for k in range(n):
        words = ["".join(rng.choices(stems, k=rng.randrange(1, 4))) for _ in range(rng.randrange(30, 120))]
        toxic, junk = rng.random() < .4, rng.random() < .4
        if toxic:
            for _ in range(len(words) // 12 + 2):
                words[rng.randrange(len(words))] = rng.choice(bad)
        text = " ".join(w + "%%%" if junk and rng.random() < .6 else w for w in words)
        docs.append((k, text, "en", "s"))
        labels.append((k, 0 if junk else 1, int(toxic)))
    return docs, labels


def accuracy(df, labels, at):
    truth = {r[0]: r[at] for r in labels}
    rows = [r for r in df.collect() if r.held_out]
    assert rows and all(0 <= r.score <= 1 for r in rows)
    return sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows)


def test_learns_both_labels(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert accuracy(toxicity.score(d, y), labels, 2) > .95
    assert accuracy(quality.score(d, y), labels, 1) > .95


def test_scores_do_not_depend_on_held_out_labels_or_metadata(spark):
    docs, labels = corpus(200)
    from zlib import crc32
    held = {k for k, *_ in docs if crc32(str(k).encode()) % 5 == 0}
    flipped = [(k, 1 - q, 1 - t) if k in held else (k, q, t) for k, q, t in labels]
    other = [(k, t, "xx", f"src{k}") for k, t, *_ in docs]
    for model in (toxicity, quality):
        one = model.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
        two = model.score(spark.createDataFrame(other, DOCS), spark.createDataFrame(flipped, LABELS)).collect()
        assert sorted((r.doc_id, r.score) for r in one) == sorted((r.doc_id, r.score) for r in two)
        assert {r.doc_id for r in one if r.held_out} == held


@pytest.mark.parametrize("model", [toxicity, quality])
def test_edge_cases(spark, model):
    docs, labels = corpus(120)
    odd = [(1001, None, None, None), (1002, "", "en", "s"), (None, "the sha", "en", "s"), (1003, " \n", "en", "s"),
           (1004, "word " * 40_000, "en", "s"), (3, docs[3][1], "en", "s")]
    d = spark.createDataFrame(docs + odd, DOCS)
    y = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (9999, 1, 1), (7, *labels[7][1:])], LABELS)
    rows = model.score(d, y).collect()
    assert len(rows) == len(docs) + len(odd) and all(r.score is not None for r in rows)
    score = {r.doc_id: r.score for r in rows}
    assert score[1001] == score[1002] == score[1003] and not [r for r in rows if r.doc_id is None][0].held_out
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in model.score(d, none).collect()} == {0.0}
    assert model.score(spark.createDataFrame([], DOCS), y).count() == 0
    ones = spark.createDataFrame([(k, 1, 1) for k in range(50)], LABELS)
    assert {r.score for r in model.score(d, ones).collect()} == {1.0}


def test_filter_keeps_columns_and_clean_rows(spark):
    docs, labels = corpus(300)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    kept = toxicity.keep_clean(d, y)
    rejected = {r.doc_id for r in toxicity.score(d, y).where("predicted = 1").collect()}
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, *_ in docs} - rejected


def test_quality_on_the_given_tables(spark):
    labels = table(spark, SF, "labels")
    got = quality.score(table(spark, SF, "documents"), labels).where("held_out").join(labels, "doc_id")
    good, n = got.selectExpr("sum(cast(predicted = quality as int))", "count(*)").first()
    assert good / n > .98


def test_linear_time_score_equals_all_pairs():
    machine, slots = quality.Machine(), quality._Slots()
    machine.w += .1
    at, x = quality.features(b"one two two three! 42", slots)
    pairs = sum(float(machine.v[at[i]] @ machine.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert machine.raw(at, x) == pytest.approx(float(x @ machine.w[at]) + pairs)


def test_pieces_are_what_sets_toxic_texts_apart():
    docs, labels = corpus(400)
    parts = [[t for (_, t, *_), (_, _, y) in zip(docs, labels) if y == k] for k in (0, 1)]
    pieces = {p.strip() for p in toxicity.toxic_pieces(*parts)}
    assert pieces and all(any(p in w for w in ("grumble", "snark", "vilest")) for p in pieces)
