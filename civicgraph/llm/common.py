"""Small helpers the operators of this folder share."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import materialise, work_path  # noqa: F401

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the cluster is set up for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Just the id and the text, under fixed names, whatever else the table has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.col(text_col).cast("string").alias("text"))


def raw_texts(batch, name="text"):
    """One column of an Arrow batch as UTF-8 bytes; None stays None."""
    import pyarrow as pa
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def ids_of(batch, name):
    """One integer column of an Arrow batch as a list; null ids stay None."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit integers that spreads every input bit."""
    m = U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * m
    x = x ^ (x >> U64(32))
    x = x * m
    return x ^ (x >> U64(32))


#: What drops the memos that operators keep in this process from task to task.
REMEMBERED = {}


def forget_memos():
    """Called where a process turns to work that needs its memory: the memos of other operators go."""
    for forget in REMEMBERED.values():
        forget()


def give_back():
    """Hand freed memory back to the system: this process lives on, beside others that need it."""
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):     # glibc only
        trim(0)


def lean(run, forget=True):
    """A task's function that first drops the memos of this process and at its end gives back what it freed."""
    def task(batches):
        if forget:
            forget_memos()
        yield from run(batches)
        give_back()
    return task


class Scratch:
    """Tables that are needed only until a result has been written down."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = work_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def write_by(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table in buckets of ``key``: joins on it move only their other side."""
        path, n = work_path(self.spark, name), partitions(self.spark)
        self.paths.append(path)
        self.tables.append(path.rsplit("/", 1)[1].replace("-", "_"))
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(self.tables[-1])
        return self.spark.table(self.tables[-1])

    def drop(self) -> None:
        """Delete the tables; nothing that is still to run may read them."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        for path in self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.paths, self.tables = [], []


def held_out(col="doc_id"):
    """True where crc32 of the id's decimal text leaves no remainder by five."""
    return F.crc32(F.col(col).cast("string")) % 5 == 0
