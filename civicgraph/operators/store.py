"""A dictionary-encoded triple store in three orders.

Subjects and objects become numbers that sort as their terms do. The triples
are written three times: by subject (SPO), by predicate (POS, one folder each,
ordered by object), and by object (OSP). A question is answered from the order
in which the positions it fixes come first, so that Spark prunes folders and
Parquet skips row groups whose range of numbers does not hold the one asked
for; only the positions left open are turned back into terms.

Where names of one table are paired with each other, the pairs can be far more
than the names. ``write`` takes such triples as links, made from the numbers of
the names: no name is looked up, shuffled or counted once per pair. The task
that makes them packs them into lists of numbers, which are what is shuffled and
written: by subject, for questions to SPO, and by object, for those to POS and
OSP, with a folder for each predicate and sorted. Questions turn the lists
that they need back into triples.

Predicates stay names: they are few, name the folders, and need no join.
Objects that many triples share are one row of the dictionary; the joins that
encode them are split by Spark where a key is skewed.
"""

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.indexing import sequential_index
from ..functions.session import TASKS_PER_CORE, materialise, path_exists, work_path

#: Bytes of a row group: what a question reads at least.
GROUP_BYTES = 8 << 20
#: Triples that one task should sort, and bytes of them that it should read to sort, so that it need not spill.
PART_ROWS, PART_BYTES = 2_000_000, 16 << 20
#: Order of columns in each copy, and the positions it answers first.
ORDERS = {"spo": ["s", "predicate", "o"], "pos": ["predicate", "o", "s"], "osp": ["o", "s", "predicate"]}
#: Lists of linked numbers: of objects by subject, and of subjects by object.
LISTS = {"spo": ("s", "o"), "pos": ("o", "s"), "osp": ("o", "s")}
LIST = "part int, side string, key long, low long, n int, gaps binary, confidence double, source string, predicate string"
LISTED = "s long, predicate string, o long, confidence double, source string"
#: Made triples that a task packs at a time, and linked names that one part of the lists should hold.
PACK_ROWS, PART_NAMES = 1 << 20, 50_000


def order_for(subject=None, predicate=None, object_val=None) -> str:
    """The copy whose leading columns are fixed."""
    if subject is not None:
        return "osp" if object_val is not None and predicate is None else "spo"
    return "pos" if predicate is not None else "osp" if object_val is not None else "spo"


class TripleStore:
    """A store in a folder: ``terms`` (id, term) and one table for each order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.rows(name) if name in ORDERS else self.spark.read.parquet(f"{self.folder}/{name}")

    @classmethod
    def write(cls, triples: DataFrame, folder=None, links=()) -> "TripleStore":
        """Encode (subject, predicate, object_val, confidence, source); triples with a null among the first three are left out.

        Each of ``links`` is (table, name, make): ``make`` gets the table with numbers in place of the
        names in column ``name``, which sort as the names do, and returns triples of such numbers.
        All names of the table become terms.
        """
        spark = triples.sparkSession
        store = cls(spark, folder or work_path(spark, "triple-store"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        whole = "subject is not null and predicate is not null and object_val is not null"
        triples = materialise(triples.where(whole), "triples")
        terms = triples.select(F.explode(F.array("subject", "object_val")).alias("term"))
        for table, key, _ in links:
            terms = terms.unionByName(table.select(F.col(key).alias("term")).where("term is not null"))
        terms = materialise(terms.distinct().repartitionByRange(parts, "term").sortWithinPartitions("term")
                            .select(F.monotonically_increasing_id().alias("_id"), "term"), "terms")
        # numbers without gaps are short: what is shuffled and written below is little else
        store._put(sequential_index(terms, ["_id"], "_id", width=1 << 33, out="id").select("id", "term"), "terms")
        name = lambda term, number: store.table("terms").select(F.col("term").alias(term), F.col("id").alias(number))
        coded = triples.join(name("subject", "s"), "subject").join(name("object_val", "o"), "object_val")
        store._put(coded.select("s", "predicate", "o", "confidence", "source"), "coded")
        rows = store.table("coded")
        for table, key, make in links:
            numbered = materialise(table.join(name(key, "_number"), key).withColumn(key, F.col("_number")).drop("_number"), "numbered")
            store._put_lists(make(numbered).where(whole).select(
                F.col("subject").alias("s"), "predicate", F.col("object_val").alias("o"), "confidence", "source"), numbered, key)
        parts = max(parts, -(-rows.count() // PART_ROWS))
        for order in ("spo", "osp"):
            columns = ORDERS[order]
            # confidence last, so that equal triples from many sources can be dealt apart
            ordered = rows.repartitionByRange(parts, *columns, "confidence", "source").sortWithinPartitions(*columns)
            store._put(ordered, order)
            rows = spark.read.parquet(f"{store.folder}/spo")
        # sorted by object already: a task sorts what it reads by predicate, and nothing is shuffled
        size = "spark.sql.files.maxPartitionBytes"
        before = spark.conf.get(size)
        spark.conf.set(size, str(PART_BYTES))
        try:
            store._put(spark.read.parquet(f"{store.folder}/osp").sortWithinPartitions(*ORDERS["pos"]), "pos", "predicate")
        finally:
            spark.conf.set(size, before)
        return store

    def _put(self, df, name, by=None):
        out = df.write.option("parquet.block.size", GROUP_BYTES).option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(f"{self.folder}/{name}")

    def _put_lists(self, rows, numbered, key):
        """Packs made triples of the numbers in ``key``; parts are cut from the numbers, so the triples are made once."""
        shuffled = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(shuffled, TASKS_PER_CORE * self.spark.sparkContext.defaultParallelism, -(-numbered.count() // PART_NAMES))
        cuts = numbered.approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts)
        lists = rows.mapInArrow(_pack(np.array(cuts)), LIST).repartitionById(parts, "part").drop("part")
        lists = lists.sortWithinPartitions("side", "predicate", "key", "low")
        lists.write.mode("append").option("parquet.block.size", GROUP_BYTES).option("compression", "zstd") \
            .partitionBy("side", "predicate").parquet(f"{self.folder}/lists")

    def rows(self, order, **conditions) -> DataFrame:
        """The triples of one copy that meet ``conditions``, each named by the column that it is about."""
        def met(df, columns):
            for column in columns:
                df = df.where(conditions[column])
            return df
        found = met(self.spark.read.parquet(f"{self.folder}/{order}"), conditions)
        if not path_exists(self.spark, f"{self.folder}/lists"):
            return found
        by, other = LISTS[order]
        lists = self.spark.read.schema(LIST).parquet(f"{self.folder}/lists").where(F.col("side") == by)
        lists = met(lists.withColumnRenamed("key", by), [c for c in conditions if c != other])
        columns = [by, "low", "n", "gaps", "confidence", "source", "predicate"]
        made = met(lists.select(*columns).mapInArrow(_unpack(by), LISTED), [c for c in conditions if c == other])
        return found.withColumn("predicate", F.col("predicate").cast("string")).unionByName(made)

    def number(self, term) -> int:
        """The number of a term, or one that no term has."""
        row = self.table("terms").where(F.col("term") == str(term)).select("id").first()
        return row.id if row else -1

    def match(self, subject=None, predicate=None, object_val=None, source=None, min_confidence=0.0) -> DataFrame:
        """(subject, predicate, object_val, confidence, source) of the triples that meet all conditions."""
        fixed = {"s": subject, "o": object_val}
        conditions = {c: F.col(c) == self.number(term) for c, term in fixed.items() if term is not None}
        if predicate is not None:
            conditions["predicate"] = F.col("predicate") == predicate
        if source is not None:
            conditions["source"] = F.col("source") == source
        if min_confidence > 0:
            conditions["confidence"] = F.col("confidence") >= min_confidence
        found = self.rows(order_for(subject, predicate, object_val), **conditions)
        for column, name, term in (("s", "subject", subject), ("o", "object_val", object_val)):
            if term is not None:
                found = found.withColumn(name, F.lit(str(term)))
            else:
                terms = self.table("terms").select(F.col("id").alias(column), F.col("term").alias(name))
                found = found.join(terms, column)
        return found.select("subject", F.col("predicate").cast("string").alias("predicate"), "object_val", "confidence", "source")

    def subjects_with(self, *conditions) -> DataFrame:
        """(subject): those that meet every (predicate, object) of ``conditions``, found on numbers alone."""
        both = None
        for predicate, object_val in conditions:
            one = self.rows("pos", predicate=F.col("predicate") == predicate, o=F.col("o") == self.number(object_val)) \
                .select("s").distinct()
            both = one if both is None else both.join(one, "s", "left_semi")
        terms = self.table("terms").select(F.col("id").alias("s"), F.col("term").alias("subject"))
        return both.join(terms, "s").select("subject")


# ---- Lists of numbers ----------------------------------------------------


def _varints(values):
    """(bytes, ends): whole numbers in as few groups of seven bits as each needs, the lowest first."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        more = values >> bits > 0
        if not more.any():
            break
        size += more
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for j in range(size.max(initial=0)):
        has = size > j
        out[ends[has] - size[has] + j] = (values[has] >> 7 * j & 0x7F) | np.where(size[has] > j + 1, 0x80, 0)
    return out, ends


def _from_varints(data):
    last = np.flatnonzero(data < 0x80)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    values = np.zeros(len(last), np.int64)
    size = last - first + 1
    for j in range(size.max(initial=0)):
        has = size > j
        values[has] |= (data[first[has] + j] & 0x7F).astype(np.int64) << 7 * j
    return values


def _lists(key, other):
    """(key, low, n, gaps) arrays: the sorted ``other`` of each key, as its least and the gaps after it."""
    import pyarrow as pa
    if max(key.max(), other.max()) < 1 << 31 and min(key.min(), other.min()) >= 0:
        both = np.sort(key << 32 | other)
        key, other = both >> 32, both & (1 << 32) - 1
    else:
        order = np.lexsort((other, key))
        key, other = key[order], other[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    gap = np.diff(other, prepend=0)
    gap[first] = 0
    data, ends = _varints(gap)
    # the zero byte of the first of each list is left out
    kept = np.ones(len(data), bool)
    kept[ends[first] - 1] = False
    n = np.diff(np.r_[first, len(key)])
    stops = ends[first + n - 1] - np.arange(1, len(first) + 1)
    offsets = np.r_[0, stops].astype(np.int32)
    gaps = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
    return key[first], other[first], n.astype(np.int32), gaps


def _pack(cuts):
    """Triples of numbers in, lists for both sides out, each with the part of the numbers that its key lies in."""
    def run(batches):
        import pyarrow as pa

        def packed(held):
            table = pa.Table.from_batches(held)
            column = lambda c: table.column(c).combine_chunks()
            kinds = [column(c).dictionary_encode() for c in ("predicate", "confidence", "source")]
            codes = [k.indices.fill_null(len(k.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) for k in kinds]
            values = [k.dictionary.to_pylist() + [None] for k in kinds]
            code = (codes[0] * len(values[1]) + codes[1]) * len(values[2]) + codes[2]
            s, o = column("s").to_numpy(), column("o").to_numpy()
            for one in np.unique(code):
                here = slice(None) if len(held) and (code == one).all() else code == one
                predicate, confidence, source = (values[0][one // len(values[2]) // len(values[1])],
                                                 values[1][one // len(values[2]) % len(values[1])], values[2][one % len(values[2])])
                for side, a, b in (("s", s[here], o[here]), ("o", o[here], s[here])):
                    key, low, n, gaps = _lists(a, b)
                    same = lambda v, t: pa.repeat(pa.scalar(v, t), len(key))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.searchsorted(cuts, key, "right").astype(np.int32)), same(side, pa.string()), pa.array(key),
                         pa.array(low), pa.array(n), gaps, same(confidence, pa.float64()), same(source, pa.string()),
                         same(predicate, pa.string())], names=[c.split()[0] for c in LIST.split(", ")])

        held, rows = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if held and (batch is None or rows >= PACK_ROWS):
                yield from packed(held)
                held, rows = [], 0
    return run


def _unpack(by):
    """Lists of ``by`` as triples of numbers."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            size = column("n").to_numpy().astype(np.int64)
            for low, high in _spans(size):
                n = size[low:high]
                part = lambda c: column(c).slice(low, high - low)  # noqa: E731, B023
                first = np.cumsum(n) - n
                values = np.zeros(n.sum(), np.int64)
                later = np.ones(len(values), bool)
                later[first] = False
                values[later] = _from_varints(np.frombuffer(b"".join(part("gaps").to_pylist()), np.uint8))
                values = np.cumsum(values)
                values += np.repeat(part("low").to_numpy() - values[first], n)
                ends = {by: np.repeat(part(by).to_numpy(), n), "o" if by == "s" else "s": values}
                each = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ends["s"]), part("predicate").take(each), pa.array(ends["o"]), part("confidence").take(each),
                     part("source").take(each)], names=[c.split()[0] for c in LISTED.split(", ")])
    return run


def _spans(size, most=PACK_ROWS):
    """Runs of lists of together about ``most`` numbers."""
    turn = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.r_[True, turn[1:] != turn[:-1]]) if len(size) else []
    return zip(cuts, [*cuts[1:], len(size)])
