"""Exact duplicates by an exchange of Golomb-coded fingerprints.

How it runs
  1. Keep and send. A task reads its documents once. It keeps the normalised
     texts in a file of its own in the shared folder (one *block*) and sends
     only short fingerprints: the block's distinct ones, sorted, cut by owner,
     the gaps between them Golomb-coded. Owners are ranges of fingerprints.
  2. Answer. An owner decodes all messages of its range, finds fingerprints
     that several blocks sent, and answers every message with a bitmap. A text
     that a third of all rows hold costs one entry for each block.
  3. Suspects. A block's task reads its file back and puts its bitmaps onto
     its sorted fingerprints. Rows whose fingerprint other blocks have too, or
     that the block has twice, are suspects; all others are settled.
  4. Verify. Only suspects' texts are shuffled. They are grouped by their bytes
     (Spark combines equal ones in each task first), which gives each group its
     size and the row that stays.
  5. Suspects take their group's answer by SHA-256, after step 4 has shown that
     no two different texts share one. Groups with at least a HOT-th of all
     rows, of which there are at most HOT, are broadcast; the rest is joined.

Fingerprints are FALSE_BITS longer than it takes to number the rows, so that a
text without a copy is a suspect once in 2 ** FALSE_BITS times.

Defined results: null text counts as empty; equal texts differ at most in the
case of A-Z; of equal texts the row with the largest doc_id stays, a null id
only if the group has no other; of rows that repeat that id as well, exactly
one is kept. keep_id is null where all ids of a group are. An empty table gives
an empty result; further columns of the input are ignored.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import U64, Scratch, id_text, ids_of, partitions, raw_texts, work_path

FALSE_BITS = 10
#: Rows of one block at most.
BLOCK_ROWS = 1 << 18
#: Fingerprints of one owner, on average, at most.
OWNER_ROWS = 1 << 21
#: Share of all rows from which a group's answer is broadcast: 1 / HOT.
HOT = 1000
#: Bytes of text written at a time.
FLUSH = 1 << 22

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- Golomb code ---------------------------------------------------------

def golomb_encode(values, span):
    """Sorted distinct numbers below ``span`` as bytes: (divisor's bits, code).

    Gaps are divided by a power of two close to 0.69 times the mean gap.
    Quotients are written in unary, then all remainders with equal width.
    """
    if not len(values):
        return 0, b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    bits = max(0, int(np.floor(np.log2(max(1.0, 0.69 * span / len(values))))))
    ends = np.cumsum((gaps >> bits) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    rest = (gaps[:, None] >> np.arange(bits)) & 1
    return bits, np.packbits(np.concatenate([unary, rest.astype(np.uint8).ravel()])).tobytes()


def golomb_decode(code, count, bits):
    """The ``count`` numbers behind a code of golomb_encode."""
    if not count:
        return np.empty(0, np.int64)
    stream = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(stream)[:count]
    quotients = np.diff(ends, prepend=-1) - 1
    tail = stream[ends[-1] + 1:ends[-1] + 1 + count * bits].reshape(count, bits).astype(np.int64)
    rest = (tail << np.arange(bits)).sum(axis=1) if bits else 0
    return np.cumsum((quotients.astype(np.int64) << bits) + rest + 1) - 1


# ---- fingerprints --------------------------------------------------------

class Plan:
    """How long fingerprints are and who owns them; follows from the number of rows."""

    def __init__(self, rows, parts):
        self.bits = min(62, max(1, int(rows).bit_length()) + FALSE_BITS)
        self.owners = max(1, parts, -(-int(rows) // OWNER_ROWS))
        self.width = -(-(1 << self.bits) // self.owners)

    def prints(self, digests):
        """Fingerprints of an (n, 32) array of digests: their leading bits."""
        head = np.ascontiguousarray(digests[:, :8]).view(">u8").ravel()
        return (head >> U64(64 - self.bits)).astype(np.int64)

    def cuts(self, values):
        """(owner, first, last) of each owner's run in sorted fingerprints."""
        owner = values // self.width
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(values) else np.empty(0, np.int64)
        return zip(owner[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)])


MESSAGE = "block string, owner int, n int, width int, code binary"


def _send(plan, folder):
    """Writes blocks and sends each one's fingerprints to their owners; one row without owner names its file."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("digest", pa.binary(32)), ("text", pa.binary())])
        base = TaskContext.get().partitionId() << 33
        names = [c.split()[0] for c in MESSAGE.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        state = {"rows": 0, "path": None, "digests": []}

        def write(rows):
            if state["path"] is None:
                state["path"], state["sink"] = files.create(folder, ".block")
                options = pa.ipc.IpcWriteOptions(compression="zstd")
                state["file"] = pa.ipc.new_stream(state["sink"], schema, options=options)
            state["file"].write_batch(pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema))
            state["digests"].append(b"".join(r[2] for r in rows))

        def close():
            state["file"].close()
            state["sink"].close()
            digests = np.frombuffer(b"".join(state["digests"]), np.uint8).reshape(-1, 32)
            sent = np.unique(plan.prints(digests))
            out = [(state["path"], None, len(sent), 0, None)]
            for owner, i, j in plan.cuts(sent):
                out.append((state["path"], owner, j - i, *golomb_encode(sent[i:j] - owner * plan.width, plan.width)))
            state.update(path=None, digests=[])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        rows, held, in_block = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for doc_id, raw in zip(ids_of(part, "doc_id"), raw_texts(part)):
                    text = raw.lower() if raw else b""
                    rows.append((doc_id, base + state["rows"], hashlib.sha256(text).digest(), text))
                    state["rows"] += 1
                    held += len(text) + 64
                    in_block += 1
                    if held > FLUSH:
                        write(rows)
                        rows, held = [], 0
                    if in_block >= BLOCK_ROWS:
                        if rows:
                            write(rows)
                        rows, held, in_block = [], 0, 0
                        yield close()
        if rows:
            write(rows)
        if in_block:
            yield close()
    return run


ANSWER = "block string, owner int, repeated binary"


def _answer(plan):
    """A bitmap for each message: which of its fingerprints another block sent too."""
    def run(batches):
        import pyarrow as pa
        names, got = [c.split()[0] for c in ANSWER.split(", ")], {}
        for batch in batches:
            for block, owner, n, width, code in zip(*(c.to_pylist() for c in batch.columns)):
                got.setdefault(owner, []).append((block, golomb_decode(code, n, width)))
        for owner, messages in got.items():
            values, counts = np.unique(np.concatenate([v for _, v in messages]), return_counts=True)
            twice = values[counts > 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in messages]), pa.array([owner] * len(messages), pa.int32()),
                 pa.array([np.packbits(np.isin(v, twice, assume_unique=True)).tobytes() for _, v in messages],
                          pa.binary())], names=names)
    return run


MARKED = "doc_id long, tag long, digest binary, text binary"


def read_block(path):
    """The record batches of a block file, in the order they were written."""
    import pyarrow as pa
    with files.read(path) as source, pa.ipc.open_stream(source) as stream:
        yield from stream


def _mark(plan):
    """All rows of each block; only suspects with their text."""
    def run(batches):
        import pyarrow as pa
        names = [c.split()[0] for c in MARKED.split(", ")]

        def digests(batch):
            return np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, 32)

        for batch in batches:
            for path, answers in zip(*(batch.column(k).to_pylist() for k in range(2))):
                prints = [plan.prints(digests(b)) for b in read_block(path)]
                sent, counts = np.unique(np.concatenate(prints), return_counts=True)
                bitmaps, suspect = {a["owner"]: a["repeated"] for a in answers}, counts > 1
                for owner, i, j in plan.cuts(sent):
                    suspect[i:j] |= np.unpackbits(np.frombuffer(bitmaps[owner], np.uint8), count=j - i).astype(bool)
                suspects = sent[suspect]
                for part, values in zip(read_block(path), prints):
                    clean = pa.array(~np.isin(values, suspects))
                    text = pa.compute.if_else(clean, pa.scalar(None, pa.binary()), part.column(3))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2).cast(pa.binary()), text], names=names)
    return run


def exact_groups(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``."""
    spark = docs.sparkSession
    early, scratch, parts = Scratch(spark), Scratch(spark), partitions(spark)
    texts = id_text(docs, id_col, text_col)
    rows = docs.count()
    plan = Plan(rows, parts)
    folder = work_path(spark, "op12-blocks")
    early.paths.append(folder)
    sent = early.write(texts.mapInArrow(_send(plan, folder), MESSAGE), "op12-sent")
    answers = sent.where("owner is not null").repartition(plan.owners, "owner").mapInArrow(_answer(plan), ANSWER)
    # a block has one bitmap for each owner, with one bit for each of its at most BLOCK_ROWS rows
    mine = answers.repartition(parts, "block").groupBy("block") \
        .agg(F.collect_list(F.struct("owner", "repeated")).alias("answers"))
    marked = scratch.write(mine.mapInArrow(_mark(plan), MARKED), "op12-marked")
    early.drop()

    suspects = marked.where("text is not null")
    first = F.coalesce("doc_id", F.lit(-2 ** 63))
    groups = suspects.groupBy("digest", "text").agg(
        F.max("doc_id").alias("keep_id"), F.max_by("tag", first).alias("keep_tag"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("keep_tag").alias("keep_tag"), F.max("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("texts"))
    alike = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share one SHA-256"))).otherwise(F.col("keep_tag"))
    groups = scratch.write(groups.select("digest", "keep_id", alike.alias("keep_tag"), "group_size"), "op12-groups")

    hot = groups.where(F.col("group_size") >= max(1, -(-rows // HOT)))
    ask = suspects.select("doc_id", "tag", "digest")
    told = ask.join(F.broadcast(hot), "digest", "left")
    rest = told.where("keep_tag is null").select("doc_id", "tag", "digest").join(groups, "digest")
    alone = marked.where("text is null").select("doc_id", "tag", "digest", F.col("doc_id").alias("keep_id"),
                                                F.col("tag").alias("keep_tag"), F.lit(1).cast("long").alias("group_size"))
    every = alone.unionByName(told.where("keep_tag is not null")).unionByName(rest)
    return every.select("doc_id", "keep_id", "group_size", (F.col("tag") == F.col("keep_tag")).alias("kept"),
                        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_last(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with one row of each group of equal texts left, for tables whose ids are unique."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_keep"))
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(F.col("_keep")), "left_semi")


#: What exact_groups returns for the documents, as DuckDB states it.
ORACLE_SQL = f"""
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents)"""
