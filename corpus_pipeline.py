"""The corpus pipeline: documents through five operators, each stage written and read again."""

from civicgraph.llm import bpe, decontaminate, jaccard, pii, toxicity
from civicgraph.llm.common import table, work_path


def drop_toxic(spark, docs, sf_dir):
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays: that of the smallest id."""
    return jaccard.keep_one(docs)


def drop_leaks(spark, docs, sf_dir):
    """Documents that a benchmark item leaks into go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark, docs, sf_dir):
    """Personal data become pseudonyms of the same format."""
    return pii.replace_in(docs)


def encode(spark, docs, sf_dir):
    """Token ids of each document, and the text that they decode to."""
    return bpe.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies),
          ("decontamination", drop_leaks), ("pii", hide_personal_data), ("byte_bpe", encode)]

#: SQL can express neither the trained classifier nor the merges; tests use brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply STAGES to the documents; every stage is written as Parquet and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
