"""The pipeline, stage by stage, against plain Python, and its registration."""

import __spark_entry__ as entry
import corpus_pipeline
from civicgraph.llm import bpe, decontaminate, jaccard, pii, queries, toxicity
from civicgraph.llm.common import table, work_path
from civicgraph.llm.labelled import labelled_sample

from .test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.QUERIES) <= names


def test_stages_decide_as_plain_python(spark):
    docs = table(spark, SF, "documents")
    columns, state = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        path = work_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        got[name] = docs
        assert docs.columns == columns or name == "byte_bpe"

    scorer = toxicity.Scorer(toxicity.fit(*labelled_sample(
        table(spark, SF, "documents"), table(spark, SF, "labels"), "toxic", toxicity.PER_CLASS, toxicity.MAX_BYTES)))
    state = {i: t for i, t in state.items() if scorer(t) < .5}
    assert {r.doc_id for r in got["toxicity"].collect()} == set(state)
    state = {i: state[i] for i, _, least in brute(sorted(state.items())) if i == least}
    assert {r.doc_id for r in got["ngram_jaccard_join"].collect()} == set(state)
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    state = {i: t for i, t in state.items() if not any(x in t for x in items)}
    assert {r.doc_id for r in got["decontamination"].collect()} == set(state)
    change = pii.Pseudonyms()
    state = {i: change.replace(t)[0] for i, t in state.items()}
    assert {r.doc_id: r.text for r in got["pii"].collect()} == state
    coder = bpe.public_bpe()
    assert {r.doc_id: (list(r.ids), r.decoded) for r in got["byte_bpe"].collect()} == \
        {i: (coder.encode(t), t) for i, t in state.items()}


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_operators_used_by_stages_keep_extra_columns(spark):
    docs = table(spark, SF, "documents").limit(30).selectExpr("*", "1 as cls", "'x' as comp")
    assert jaccard.keep_one(docs).columns == docs.columns
    assert decontaminate.keep_clean(docs, table(spark, SF, "benchmark")).columns == docs.columns
