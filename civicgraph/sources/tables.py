"""Reading and writing tables: landing, scans, sinks, stage unions."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.session import path_exists
from ..operators.clean import prune_columns, trim_columns
from ..operators.mart import CORE_COLUMNS


@dataclass(frozen=True)
class Dataset:
    """One registered source: where it is and how much of it to land."""

    path: str
    format: str = "parquet"
    limit: int = None          # the source's own row limit, of the first rows by ``order``
    where: str = None
    select: tuple = None
    order: tuple = ()


def land(spark: SparkSession, dataset: Dataset, out: str) -> DataFrame:
    """Copy one source to ``out`` unless it is already there.

    Predicate and projection reach the scan; nothing is fetched twice.
    """
    df = spark.read.format(dataset.format).load(dataset.path)
    if dataset.where:
        df = df.where(dataset.where)
    if dataset.select:
        df = df.select(*dataset.select)
    if dataset.limit:
        if not dataset.order:
            raise ValueError("a row limit needs an order")
        df = df.orderBy(*dataset.order).limit(dataset.limit)
    df.write.mode("ignore").parquet(out)
    return spark.read.parquet(out)


def land_all(spark, registry: dict, folder: str) -> dict:
    return {name: land(spark, d, f"{folder}/{name}") for name, d in registry.items()}


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: every column text, names trimmed."""
    return trim_columns(spark.read.csv(path, header=True))


def save(df: DataFrame, path: str, partition_by=()) -> int:
    """Overwrite a Parquet table and return its row count, counted on the way."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get["rows"]


_STRINGS = lambda *names: [T.StructField(n, T.StringType()) for n in names]
_FAILED = T.ArrayType(T.StructType(_STRINGS("name", "reason", "timestamp")))
_PLACE = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
                       T.StructField("display_name", T.StringType())])
CASE_SCHEMA = T.StructType(_STRINGS("case_id", "name", "created_at", "last_visit", "admin_notes") + [
    T.StructField("current_location", _PLACE), T.StructField("notes", T.StringType()),
    T.StructField("needs", T.ArrayType(T.StructType(
        _STRINGS("category", "status", "identified_at", "resolved_at", "chosen_resource",
                 "chosen_address", "chosen_type", "chosen_at", "notes")
        + [T.StructField("priority", T.IntegerType()), T.StructField("failed_resources", _FAILED)]))),
    T.StructField("visits", T.ArrayType(T.StructType(_STRINGS("timestamp", "query", "answer_summary") + [
        T.StructField("resources_shown", T.ArrayType(T.StructType(_STRINGS("name", "type", "address", "borough")))),
        T.StructField("location", _PLACE)]))),
    T.StructField("resources_visited", T.ArrayType(T.StructType(_STRINGS("name", "visited_at", "feedback")))),
    T.StructField("feedback", T.ArrayType(T.StructType(_STRINGS("resource", "feedback", "timestamp")))),
    T.StructField("destination_intents", T.ArrayType(T.StructType(
        _STRINGS("resource_name", "resource_type", "address", "borough", "category", "state",
                 "intent_at", "updated_at", "thread_id", "thread_url") + [T.StructField("acknowledged", T.BooleanType())]))),
    T.StructField("tickets", T.ArrayType(T.StructType(_STRINGS("type", "raised_at", "status", "reason")))),
    T.StructField("emergency_contact", T.MapType(T.StringType(), T.StringType())),
])


def scan_case_docs(spark: SparkSession, path: str, one_per_file=False) -> DataFrame:
    """Case documents as JSON lines, or one document per file.

    Fields a document lacks read as null; a document that does not parse is
    skipped, as is one without an id.
    """
    schema = T.StructType(CASE_SCHEMA.fields + _STRINGS("_corrupt_record"))
    df = (spark.read.schema(schema).option("mode", "PERMISSIVE")
          .option("multiLine", str(one_per_file).lower()).json(path))
    return df.where(F.col("_corrupt_record").isNull() & F.col("case_id").isNotNull()).drop("_corrupt_record")


def load_stage(spark: SparkSession, folder: str, names) -> dict:
    """The stage tables that exist, by name; missing ones are left out."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names if path_exists(spark, f"{folder}/{n}")}


def union_stages(stages) -> DataFrame:
    """All stage tables by name: core columns first, extras null where absent."""
    def with_core(df):
        for c in CORE_COLUMNS:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast("double" if c in ("latitude", "longitude") else "string"))
        return df.select(*CORE_COLUMNS, *[c for c in df.columns if c not in CORE_COLUMNS])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [with_core(s) for s in stages])


LOT_LAYER = ["bbl", "address", "borough", "latitude", "longitude", "landuse", "numfloors",
             "yearbuilt", "ownername", "unitsres", "is_overflow_candidate"]


def save_lot_layer(lots: DataFrame, path: str) -> int:
    """The second-tier lot table, one folder per borough."""
    return save(prune_columns(lots, LOT_LAYER), path, ["borough"])


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Node and edge tables; edges are split by type so scans can skip types."""
    save(nodes, f"{folder}/nodes", ["node_type"])
    save(edges, f"{folder}/edges", ["edge_type"])


def load_graph(spark, folder: str):
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
