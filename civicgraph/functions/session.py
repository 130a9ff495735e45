"""Where a job may keep intermediate data, and how it cuts lineage.

Both live under ``spark.checkpoint.dir``, the shared folder the cluster names,
so that a lost executor never loses them. Only a local session without that
setting gets a folder of its own.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    path = tempfile.mkdtemp(prefix="civicgraph-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise reliably and drop the plan behind it (iterative jobs)."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back, for inputs used several times."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows of heavy work out evenly; Spark sizes and may split the partitions."""
    return df.hint("rebalance")


#: Tasks for each core where few rows make many: one that takes longer than others then holds up little.
TASKS_PER_CORE = 4


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows that each make many by ``keys``: into as many parts as asked for, however few bytes they are."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def materialise_by(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write a table in buckets of ``keys``: joins on them move and sort only their other side."""
    spark = df.sparkSession
    path, n = work_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)
