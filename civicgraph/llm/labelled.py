"""A bounded, deterministic sample of labelled documents, for fitting on the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, max_bytes: int):
    """(zeros, ones): texts of at most ``per_class`` training documents of each label.

    Rows are chosen from the label table alone, by a hash order of the id, so the
    documents meet a table of at most 2 * per_class ids. Held-out ids never take
    part. An id with several labels counts with the largest one; null labels and
    ids, texts that are null, and texts over ``max_bytes`` are not fitted on.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = []
    for y in (0, 1):
        chosen += ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    if not chosen:
        return [], []
    spark = docs.sparkSession
    small = spark.createDataFrame([(r.doc_id, r.y) for r in chosen], "doc_id long, y int")
    texts = id_text(docs).where(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(small), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows if r.y == 0], [r.text for r in rows if r.y == 1]
