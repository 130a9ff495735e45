"""A Merkle manifest of a table, with every row's proof by an octopus multiproof.

How it runs
  1. Leaves are hashed in the scan, written, and sorted by tree (one for each
     language) and id with one range exchange of digests; texts never move.
  2. A task packs what it holds of a tree into *runs* of at most RUN consecutive
     leaves. Only the lengths of runs are added up to find where each begins.
  3. A run computes the roots of the largest aligned subtrees within it. These
     few nodes are all that leaves a run; joining them over ever wider ranges of
     leaves gives the upper nodes, the subroots and the tree over the subroots.
  4. Each run is a leaf partition of the multiproof. It lists the least set of
     node coordinates that it lacks for the proofs of all its leaves, at most
     two on a level, and fetches each once. Nodes of the top levels, of which
     there are few, are broadcast; the others are joined by coordinate.
  5. With its leaves and what it fetched, a run derives shared interiors once,
     cuts each leaf's proof out of them, and folds it again.

Definitions: H is lower-case hex SHA-256 over concatenated inputs, digests as
hex text. A leaf is H of doc_id, source, lang, n_chars and text, each as `-` if
null, else UTF-8 byte count, `:` and value. Each two consecutive nodes of a
level, and an odd last one alone, become their H until one node is left.

Defined results: rows without an id come first in their tree, rows without a
language form the first tree, and rows that repeat an id are ordered by leaf;
they all get a proof. Tampering leaves null ids and null counts as they are. A
tree of one leaf has that leaf as its subroot, and with one tree its subroot is
the root. An empty table gives an empty result; further columns are ignored.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, partitions

#: Leaves of one run at most.
RUN = 1 << 15
#: Levels that are put together at first, and in each further round.
FIRST, STEP = 20, 14
#: Nodes of the levels that are broadcast: at most four times this number.
TOP = 1 << 12
#: Where 7 divides the hash of an id, tampering is tried.
TAMPER = 7
#: Number of the tree over the subroots.
OVER = -1


def node(*digests: bytes) -> bytes:
    """H of one or two digests, all of them as 32 bytes."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def level_size(size, level):
    return -(-size >> level) if level else size


def height(size):
    return max(0, int(size - 1).bit_length())


# ---- leaves and runs -----------------------------------------------------

def _leaf(id_col, n_chars):
    fields = [F.col(id_col), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame, id_col="doc_id") -> DataFrame:
    """(doc_id, lang, leaf, forged): each row's digest, and that of the tampered row where tampering is tried."""
    tried = F.crc32(F.col(id_col).cast("string")) % TAMPER == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       _leaf(id_col, F.col("n_chars")).alias("leaf"), F.when(tried, _leaf(id_col, more)).alias("forged"))


RUNS = "part int, seq int, lang string, n int, ids array<bigint>, leaves binary, forged binary"


def _pack(longest):
    """Sorted leaves as runs; where a leaf has no forged twin, it stands for it."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        part, seq, held, last = TaskContext.get().partitionId(), 0, [], None
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in RUNS.split(", ")]

        def packed():
            ids, own, forged = zip(*held)
            values = [part, seq, last, len(held), list(ids), b"".join(own), b"".join(f or x for f, x in zip(forged, own))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "lang", "leaf", "forged")]
            for doc_id, lang, own, forged in zip(*cols):
                if held and (lang != last or len(held) >= longest):
                    yield packed()
                    held, seq = [], seq + 1
                last = lang
                held.append((doc_id, own, forged))
        if held:
            yield packed()
    return run


def _place(runs: DataFrame) -> DataFrame:
    """(part, seq, n, tree, start, size) of each run; tree numbers follow the order of languages."""
    heads = runs.select("part", "seq", "lang", "n")
    before = W.partitionBy("lang").orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    placed = heads.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
                          F.sum("n").over(W.partitionBy("lang")).alias("size"),
                          F.min("part").over(W.partitionBy("lang")).alias("home"))
    # a task sorted its languages, so a tree's number is that of the trees that begin in earlier tasks and before it
    trees = placed.where("start = 0").select("lang", "home")
    sums = trees.groupBy("home").agg(F.count(F.lit(1)).alias("k"))
    earlier = sums.select("home", F.coalesce(F.sum("k").over(
        W.orderBy("home").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.row_number().over(W.partitionBy("home").orderBy(F.col("lang").asc_nulls_first())) - 1
    numbered = trees.withColumn("within", within).join(earlier, "home") \
        .select(F.col("lang").alias("_lang"), (F.col("earlier") + F.col("within")).cast("long").alias("tree"))
    return placed.join(numbered, F.col("lang").eqNullSafe(F.col("_lang"))).select("part", "seq", "n", "tree", "start", "size")


# ---- nodes ---------------------------------------------------------------

NODES = "tree long, size long, level int, idx long, digest binary"


def _grow(level_nodes, size, level):
    """The next level of {index: digest}: parents whose children are all here."""
    last = level_size(size, level) - 1
    out = {}
    for i, digest in level_nodes.items():
        if i % 2 == 0:
            if i == last:
                out[i >> 1] = node(digest)
            elif i + 1 in level_nodes:
                out[i >> 1] = node(digest, level_nodes[i + 1])
    return out


def _peaks(batches):
    """The roots of the largest aligned subtrees of each run."""
    import pyarrow as pa
    for batch in batches:
        for tree, size, start, n, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                               for c in ("tree", "size", "start", "n", "leaves"))):
            out, here = [], {start + k: raw[32 * k:32 * k + 32] for k in range(n)}
            for level in range(height(size) + 1):
                above = _grow(here, size, level) if level < height(size) else {}
                out += [(tree, size, level, i, d) for i, d in here.items() if i >> 1 not in above]
                here = above
            yield _node_batch(pa, out)


def _node_batch(pa, rows):
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)],
                                      names=[c.split()[0] for c in NODES.split(", ")])


def _join_up(top):
    """All nodes up to level ``top`` above those given; rows come by (tree, range of leaves)."""
    def run(batches):
        import pyarrow as pa
        groups = {}
        for batch in batches:
            for tree, size, level, i, digest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                                      for c in ("tree", "size", "level", "idx", "digest"))):
                groups.setdefault((tree, size, i >> (top - level)), {}).setdefault(level, {})[i] = digest
        for (tree, size, _), levels in groups.items():
            out = []
            for level in range(min(top, height(size))):
                for i, digest in _grow(levels.get(level, {}), size, level).items():
                    levels.setdefault(level + 1, {})[i] = digest
                    out.append((tree, size, level + 1, i, digest))
            yield _node_batch(pa, out)
    return run


def _upwards(nodes: DataFrame, largest: int, scratch: Scratch) -> list[DataFrame]:
    """``nodes`` and the nodes above them, round by round, up to the root of each tree."""
    tables, top, parts = [nodes], FIRST, partitions(nodes.sparkSession)
    done = -1
    while True:
        # what can still grow: nodes that no round has put under a parent yet
        open_nodes = tables[0] if done < 0 else tables[-1].where(F.col("level") == done).unionByName(
            tables[0].where(F.col("level") >= done))
        dealt = open_nodes.where(F.col("level") <= top).repartition(
            parts, "tree", F.expr(f"shiftright(idx, {top} - level)"))
        tables.append(scratch.write(dealt.mapInArrow(_join_up(top), NODES), "op13-upper"))
        if height(largest) <= top:
            return tables
        done, top = top, top + STEP


def _forest(nodes, largest, scratch):
    tables = _upwards(nodes, largest, scratch)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


# ---- the multiproof ------------------------------------------------------

def lacking(positions, size):
    """[(level, index)]: the least set of nodes that the proofs of these leaves need beside the leaves.

    ``positions`` are sorted and distinct. On each level a node whose sibling
    is neither given nor derived asks for it.
    """
    out, at = [], np.asarray(positions, np.int64)
    for level in range(height(size)):
        other = at ^ 1
        there = other < level_size(size, level)
        spot = np.minimum(np.searchsorted(at, other), len(at) - 1)
        out += [(level, int(i)) for i in other[there & (at[spot] != other)]]
        at = np.unique(at >> 1)
    return out


ASKS = "part int, seq int, tree long, level int, idx long"


def _ask(trees):
    """The coordinates each run lacks, in its own tree and in the tree over the subroots."""
    def run(batches):
        import pyarrow as pa
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            out = []
            for part, seq, n, tree, start, size in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                                         for c in ("part", "seq", "n", "tree", "start", "size"))):
                own = lacking(np.arange(start, start + n), size)
                out += [(part, seq, tree, level, i) for level, i in own]
                out += [(part, seq, OVER, level, i) for level, i in lacking([tree], trees)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)],
                                             names=[c.split()[0] for c in ASKS.split(", ")])
    return run


PROOFS = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean, siblings array<string>")


def _expand(trees):
    """Each leaf's proof, from its run's leaves and the nodes fetched."""
    def run(batches):
        import pyarrow as pa
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string())]
        names = [c.split()[0] for c in PROOFS.split(", ")]
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            for tree, start, size, ids, own, forged, fetched in zip(*(
                    batch.column(batch.schema.get_field_index(c)).to_pylist()
                    for c in ("tree", "start", "size", "ids", "leaves", "forged", "fetched"))):
                known = {(f["tree"], f["level"], f["idx"]): f["digest"].hex() for f in fetched or ()}
                levels, first = [[own[32 * k:32 * k + 32].hex() for k in range(len(ids))]], [start]
                for level in range(height(size)):       # shared interiors, derived once
                    row, at = list(levels[-1]), first[-1]
                    last = level_size(size, level) - 1
                    if at % 2:
                        row, at = [known[tree, level, at - 1], *row], at - 1
                    if (at + len(row)) % 2 and at + len(row) <= last:
                        row.append(known[tree, level, at + len(row)])
                    levels[-1], first[-1] = row, at
                    levels.append([sha("".join(row[k:k + 2])) for k in range(0, len(row), 2)])
                    first.append(at >> 1)
                subroot, over, here, above = levels[-1][0], [], tree, levels[-1][0]
                for level in range(height(trees)):
                    other = known.get((OVER, level, here ^ 1))
                    over.append((here & 1, other))
                    above = _fold_one(sha, above, here & 1, other)
                    here >>= 1
                root, out = above, []
                for k, doc_id in enumerate(ids):
                    path, at = [], start + k
                    for level in range(height(size)):
                        spot = (at ^ 1) - first[level]
                        path.append((at & 1, levels[level][spot] if 0 <= spot < len(levels[level]) else None))
                        at >>= 1
                    path += over
                    proof = [d for _, d in path if d is not None]
                    folded = forged[32 * k:32 * k + 32].hex()
                    for right, other in path:
                        folded = _fold_one(sha, folded, right, other)
                    out.append((doc_id, own[32 * k:32 * k + 32].hex(), subroot, root, sha("".join(proof)),
                                folded, folded == root, proof))
                    if len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
    return run


def _fold_one(sha, digest, right, other):
    if other is None:
        return sha(digest)
    return sha(other + digest) if right else sha(digest + other)


def _fetch(asks: DataFrame, nodes: DataFrame, leaf_count: int) -> DataFrame:
    """(part, seq, fetched): the nodes each run asked for.

    A node on a high level is asked for by many runs. There are at most 4 * TOP
    nodes on the levels from which a tree's nodes cover a TOP-th of all leaves
    each, so these are broadcast; a lower one has few runs below its sibling.
    """
    split = max(0, height(leaf_count) - (TOP.bit_length() - 1))
    digest = nodes.select("tree", "level", "idx", "digest")
    key = ["tree", "level", "idx"]
    high = asks.where(F.col("level") >= split).join(F.broadcast(digest.where(F.col("level") >= split)), key)
    low = asks.where(F.col("level") < split).join(digest.where(F.col("level") < split), key)
    # at most two nodes a level, so a list is as long as the trees are high
    return high.unionByName(low).groupBy("part", "seq").agg(
        F.collect_list(F.struct("tree", "level", "idx", "digest")).alias("fetched"))


def proofs(docs: DataFrame, id_col="doc_id", run_rows=RUN) -> DataFrame:
    """The columns of PROOFS for each row of ``docs``; siblings go from the leaf's level up to the root.

    ``run_rows`` must be at most 2 ** FIRST, so that the first round of joining reaches over every run.
    """
    spark = docs.sparkSession
    parts, scratch = partitions(spark), Scratch(spark)
    hashed = scratch.write(leaves(docs, id_col).withColumn("_tie", F.monotonically_increasing_id()), "op13-leaves")
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_tie")]
    ordered = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    runs = scratch.write(ordered.select("doc_id", "lang", "leaf", "forged").mapInArrow(_pack(run_rows), RUNS), "op13-runs")
    placed = scratch.write(_place(runs), "op13-places")
    totals = placed.agg(F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max("tree") + 1, F.lit(0)),
                        F.coalesce(F.sum("n"), F.lit(0))).first()
    largest, trees, count = totals
    packed = runs.select("part", "seq", "ids", "leaves", "forged").join(placed, ["part", "seq"])

    peaks = scratch.write(packed.select("tree", "size", "start", "n", "leaves").mapInArrow(_peaks, NODES), "op13-peaks")
    nodes = _forest(peaks, largest, scratch)
    summit = F.expr("size - 1")
    subroots = nodes.where((F.col("idx") == 0) & (F.col("level") == F.when(summit == 0, 0).otherwise(
        F.length(F.regexp_replace(F.bin(summit), "^0+", ""))))).select(
        F.lit(OVER).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), F.lit(0).alias("level"),
        F.col("tree").alias("idx"), "digest")
    subroots = scratch.write(subroots, "op13-subroots")
    nodes = nodes.unionByName(_forest(subroots, trees, scratch))

    asks = placed.mapInArrow(_ask(trees), ASKS)
    fetched = _fetch(asks, nodes, count)
    told = packed.join(fetched, ["part", "seq"], "left")
    return told.select("tree", "start", "size", "ids", "leaves", "forged", "fetched") \
        .mapInArrow(_expand(trees), PROOFS)


def manifest(docs: DataFrame, id_col="doc_id") -> DataFrame:
    """The result of the query: proofs as digests."""
    return proofs(docs, id_col).drop("siblings")


# ---- check SQL -----------------------------------------------------------

def _oracle():
    """What manifest returns, as DuckDB states it: levels, siblings and folds by recursion."""
    field = lambda x: f"coalesce(concat(strlen({x}), ':', {x}), '-')" if x in ("source", "lang", "text") else \
        f"coalesce(concat(strlen(CAST({x} AS VARCHAR)), ':', CAST({x} AS VARCHAR)), '-')"
    leaf = lambda n: "sha256(concat(" + ", ".join(field(x) for x in ("doc_id", "source", "lang", n, "text")) + "))"
    return f"""
    WITH RECURSIVE crc AS (
        SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
    d AS (SELECT *, n_chars + 1 AS n_more, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
              string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))),
              lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM documents, crc),
    l AS (SELECT doc_id, lang, {leaf("n_chars")} AS leaf, CASE WHEN h % {TAMPER} = 0 THEN {leaf("n_more")} ELSE {leaf("n_chars")} END AS forged
          FROM d),
    p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                 dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM l),
    up(tree, level, idx, digest, size) AS (
        SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM p
        UNION ALL
        SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(size) + 1) // 2
        FROM up WHERE size > 1 GROUP BY tree, level, idx // 2),
    sub AS (SELECT tree, digest FROM up WHERE size = 1),
    over_(tree, level, idx, digest, size) AS (
        SELECT 0, 0, tree, digest, count(*) OVER () FROM sub
        UNION ALL
        SELECT 0, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(size) + 1) // 2
        FROM over_ WHERE size > 1 GROUP BY level, idx // 2),
    steps AS (SELECT p.tree, p.pos, u.level, 0 AS stage, u.idx, s.digest AS other
              FROM p JOIN up u ON u.tree = p.tree AND u.idx = p.pos >> u.level AND u.size > 1
              LEFT JOIN up s ON s.tree = u.tree AND s.level = u.level AND s.idx = xor(u.idx, 1)
              UNION ALL
              SELECT p.tree, p.pos, o.level, 1, o.idx, s.digest FROM p JOIN over_ o ON o.idx = p.tree >> o.level AND o.size > 1
              LEFT JOIN over_ s ON s.level = o.level AND s.idx = xor(o.idx, 1)),
    paths AS (SELECT tree, pos, list({{'r': idx % 2, 'o': other}} ORDER BY stage, level) AS path,
                     coalesce(string_agg(other, '' ORDER BY stage, level), '') AS flat FROM steps GROUP BY 1, 2),
    folded AS (SELECT p.*, coalesce(flat, '') AS flat, list_reduce(list_prepend({{'r': CAST(0 AS BIGINT), 'o': forged}},
                   coalesce(path, [])), lambda a, s: {{'r': CAST(0 AS BIGINT), 'o': CASE WHEN s.o IS NULL THEN sha256(a.o)
                   WHEN s.r = 1 THEN sha256(concat(s.o, a.o)) ELSE sha256(concat(a.o, s.o)) END}}).o AS folded_root
               FROM p LEFT JOIN paths USING (tree, pos))
    SELECT doc_id, leaf, sub.digest AS subroot, (SELECT digest FROM over_ WHERE size = 1) AS root, sha256(flat) AS proof_sha256,
           folded_root, folded_root = (SELECT digest FROM over_ WHERE size = 1) AS verified
    FROM folded JOIN sub USING (tree)"""


ORACLE_SQL = _oracle()
