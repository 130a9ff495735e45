"""Near-copies among vectors by Euclidean p-stable hashing, with exact cosine checks.

Unit vectors of cosine c lie sqrt(2 - 2c) apart. A projection on a Gaussian
direction, shifted and cut into cells of ``WIDTH``, keeps a pair at that distance
together with a known probability; K projections make one bucket and T tables
make up for the pairs that one misses. K grows with the logarithm of the number
of vectors, so that strangers seldom meet, and T follows from K so that a pair
exactly at the threshold is met with probability ``RECALL``; closer pairs more.

Equal vectors are one node with a count. A bucket of several nodes is cut into
blocks of ``BLOCK``; a task holds one pair of blocks, multiplies them in double
precision and adds up, per node, the vectors linked. A pair is counted in the
first table that brings it together, so nothing is counted twice, and pairs
themselves are never written: per block only counts and one link from each node
to the smallest node of its group there.

Defined results: null vectors, zero vectors and vectors with null or non-finite
components link with nothing; vectors of different lengths never link; rows that
repeat an id count as vectors of their own. A null id is never a component's name
while the component has another. Extra columns, labels included, are ignored.
"""

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, materialise, mix, partitions
from .components import components

COSINE = 0.95
WIDTH = 2.0
RECALL = 0.98
#: Strangers that a vector should meet in one table, on average.
STRANGERS = 0.05
BLOCK = 1024
SEED = 20240517


def _together(distance, width=WIDTH):
    """Chance that two points at this distance share a cell of one projection."""
    r = width / distance
    below = .5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n, cosine=COSINE):
    """(projections per table, tables) for n vectors."""
    near, far = _together(math.sqrt(2 - 2 * cosine)), _together(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2) / STRANGERS) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log1p(-near ** k)))


def _clean(values):
    """The vector as doubles, or None when it links with nothing."""
    if values is None or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    return x if len(x) and np.isfinite(x).all() and x.any() else None


def _nodes(batches):
    """(vec_id, node, unit): equal vectors get one node; the unit vector as bytes."""
    import pyarrow as pa
    from xxhash import xxh3_64_intdigest
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("vec_id")).to_pylist()
        nodes, units = [], []
        for cell in batch.column(batch.schema.get_field_index("embedding")):
            x = _clean(cell.as_py())
            if x is None:
                nodes.append(None)
                units.append(None)
                continue
            x = x + 0.0                     # one zero, not two
            x = x / np.abs(x).max()         # lengths whose squares would not fit
            unit = (x / np.sqrt(x @ x)).tobytes()
            nodes.append(xxh3_64_intdigest(unit) - (1 << 63))
            units.append(unit)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()),
                                          pa.array(units, pa.binary())], names=["vec_id", "node", "unit"])


def _projections(dim, k, tables):
    rng = np.random.default_rng([SEED, dim])
    return rng.normal(size=(dim, k * tables)), rng.uniform(0, WIDTH, k * tables)


def _bucket_keys(x, k, tables):
    """One 64-bit key per vector and table; the key holds the table and the length."""
    a, b = _projections(x.shape[1], k, tables)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(U64).reshape(len(x), tables, k)
    key = np.broadcast_to(mix(np.arange(tables, dtype=U64) + U64(x.shape[1] << 20)), (len(x), tables)).copy()
    for j in range(k):
        key = mix(key ^ cells[:, :, j])
    return key.view(np.int64)


def _by_length(units):
    """{bytes: places} of the unit vectors."""
    groups = {}
    for place, unit in enumerate(units):
        groups.setdefault(len(unit), []).append(place)
    return groups


def _hash(k, tables, per_batch=512):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            nodes = batch.column(batch.schema.get_field_index("node")).to_numpy()
            units = batch.column(batch.schema.get_field_index("unit")).to_pylist()
            for size, places in _by_length(units).items():
                for at in range(0, len(places), per_batch):
                    some = places[at:at + per_batch]
                    x = np.frombuffer(b"".join(units[p] for p in some), np.float64).reshape(len(some), -1)
                    keys = _bucket_keys(x, k, tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(nodes[some], tables))], names=["bucket", "node"])
    return run


def _local_groups(linked):
    """For each row of a symmetric link table, the first row of its group."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label[None], n).min(axis=1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


COUNTS = "node long, links long, low long"


def _count(k, tables, cosine):
    """Links within one pair of blocks; rows come sorted by bucket and block pair."""
    def run(batches):
        import pyarrow as pa

        def one(same, node, m, side, units):
            x = np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)
            if same:                                # a block with itself
                linked = x @ x.T >= cosine
                np.fill_diagonal(linked, False)
                i, j = np.nonzero(np.triu(linked, 1))
            else:
                left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                linked = np.zeros((len(node), len(node)), bool)
                linked[np.ix_(left, right)] = x[left] @ x[right].T >= cosine
                i, j = np.nonzero(linked)
                linked |= linked.T
            if not len(i):
                return None
            some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            keys = _bucket_keys(x[some], k, tables)     # only of vectors that link here
            return node, m, keys, i, j, at[:len(i)], at[len(i):], _local_groups(linked)

        def emit(found, bucket):
            node, m, keys, i, j, key_i, key_j, group = found
            links = np.zeros(len(node), np.int64)
            for at in range(0, len(i), 1 << 14):
                some = slice(at, at + (1 << 14))
                a, b = i[some], j[some]
                first = np.argmax(keys[key_i[some]] == keys[key_j[some]], axis=1)
                here = keys[key_i[some], first] == bucket
                np.add.at(links, a[here], m[b[here]])
                np.add.at(links, b[here], m[a[here]])
            low = node[group]
            some = np.flatnonzero((links > 0) | (low != node))
            return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(low[some])],
                                              names=["node", "links", "low"])

        names = ("bucket", "i", "j", "node", "m", "side", "unit")
        rows, at = [], None
        for batch in itertools.chain(batches, [None]):
            block = [] if batch is None else zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                                   for c in names))
            for row in itertools.chain(block, [None] if batch is None else []):
                if rows and (row is None or row[:3] != at):
                    node, m, side = (np.array(c) for c in zip(*(r[3:6] for r in rows)))
                    found = one(at[1] == at[2], node, m, side, [r[6] for r in rows]) if len(rows) > 1 else None
                    if found:
                        yield emit(found, at[0])
                    rows = []
                if row is not None:
                    at = row[:3]
                    rows.append(row)
    return run


def near_copies(embeddings: DataFrame, cosine=COSINE, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = embeddings.sparkSession
    parts = partitions(spark)
    source = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = materialise(source.mapInArrow(_nodes, "vec_id long, node long, unit binary"), "op10-rows")
    nodes = materialise(rows.where("node is not null").groupBy("node")
                        .agg(F.count(F.lit(1)).alias("m"), F.first("unit").alias("unit")), "op10-nodes")
    k, tables = plan(nodes.count(), cosine)

    slim = materialise(nodes.repartition(parts).mapInArrow(_hash(k, tables), "bucket long, node long"), "op10-hashes")
    sizes = slim.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = slim.join(sizes, "bucket").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select("bucket", "node", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"),
                         (F.col("own") > F.col("with")).cast("int").alias("side"))
    blocks = dealt.join(nodes, "node").repartition(parts, "bucket", "i", "j") \
        .sortWithinPartitions("bucket", "i", "j")
    counted = materialise(blocks.mapInArrow(_count(k, tables, cosine), COUNTS), "op10-counts")

    groups = components(counted, "node", "low")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    named = rows.drop("unit").join(nodes.select("node", "m"), "node", "left").join(links, "node", "left") \
        .join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    low = named.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("least"))
    out = named.join(low, "comp", "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("m") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
