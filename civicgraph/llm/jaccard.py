"""Exact Jaccard join of documents on word 5-grams, with set-relation skipping.

How it runs
  1. One pass over the texts makes every document's shingle set. It yields the
     set's size and a 64-bit digest (equal sets share one *class* and are
     joined only once) and adds the shingles into a counter table of fixed
     size, from which everybody takes the same order: rare shingles first.
  2. A second pass puts the prefix of each set (the first quarter plus one, in
     that order) into an inverted index. Any two sets that link share an entry.
     Entries carry the set's size and what is left of the set from that
     position on, and lists of one class are thrown away at once.
  3. Answer-level skipping. A round gives each group of classes (at first each
     class) a promising partner from its lists, checks those pairs exactly, and
     merges what links. From then on a class takes over the answers of its group:
     classes known to be connected are not compared. Crowded lists get more rounds.
  4. Answers by differences. Of the classes left in several groups each names a
     similar class R that many others name too, and is kept as what it lacks of
     R (d shingles) and adds to it (a shingles). Sets X and Z of one R have
     |R| - d(X) - d(Z) + common differences in common, so they link just when
     their differences share (w(X) + w(Z)) / 350 entries, where
     w = 200 d + 150 a - 25 |R|. What R answers for X follows from w alone;
     pairs that R links are connected by it; any other pair has to share
     differences, and only an index over these proposes it. Texts
     that were each changed elsewhere share hardly any, and are never paired.
  5. Index-level skipping. What is left, classes of different R, is compared
     across groups. A list is cut into blocks ordered by size; a block is
     skipped as a whole when its sizes or its best remaining position cannot
     reach the overlap needed. Long lists are dealt out as pairs of blocks.
  6. Bounds first, full sets last. A set's sketch has one bit for the parity of
     each of SKETCH classes of its shingles, so shingles in common cancel out: odd
     bits of two sketches are no more than the shingles that only one set has.
     Pairs that steps 4 and 5 propose and whose sketches allow a link are checked
     on the full sets, so no link between different texts is lost. Sets of more
     than about four SKETCH shingles have sketches that rule out little.

Defined results: null, empty or blank text has no shingles and links with
nothing; a text of one to four words is one shingle; rows that repeat an id
count as one document each and share its class; a null id is kept and never
chosen as a component's name unless all ids there are null. Extra columns are
ignored. Shingles are compared by 64-bit hashes, equal sets by 64-bit digests.
"""

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import U64, Scratch, id_text, ids_of, lean, materialise, mix, partitions, raw_texts
from .components import components

WORDS = 5
#: Links need 100 * common >= PERCENT * union.
PERCENT = 75
#: Counters of the order table; its size does not depend on the data.
BUCKET_BITS = 20
CHUNK = 1 << 14
#: Rounds of step 3 go on while the lists hold more than CROSSING pairs across groups
#: for each of their entries and a round leaves at most GAIN of them, at most ROUNDS
#: times. Steps 4 and 5 are complete in any case.
CROSSING = 64
GAIN = 0.8
ROUNDS = 8
#: Entries of one block of a long list.
BLOCK = 1024
#: Entries above which a list's counter makes it split before the shuffle.
HOT = 1 << 20
#: Longest list whose entries are compared where the lists are made.
WIDE = 32
#: Bits of a sketch.
SKETCH = 512
MEMO = 120_000
SLICE = 200

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                     0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=U64)


class _WordHash(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word):
        from xxhash import xxh3_64_intdigest
        if len(self) > MEMO:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value


def shingle_set(raw, memo) -> np.ndarray:
    """Sorted distinct shingle hashes of one UTF-8 text."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, U64)
    h = np.fromiter(map(memo.__getitem__, words), dtype=U64, count=len(words))
    n = max(1, len(words) - WORDS + 1)
    x = np.full(n, 0 if len(words) >= WORDS else len(words), dtype=U64)
    for k in range(min(WORDS, len(words))):
        x += h[k:k + n] * _FACTORS[k]
    return np.unique(mix(x))


def _digest(s):
    """(class id, second half of the digest) of a set, as signed longs."""
    one = mix(s + _FACTORS[0]).sum(dtype=U64) ^ mix(np.array([len(s)], U64))[0]
    two = mix(s ^ _FACTORS[1]).sum(dtype=U64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _slot(s):
    return (s >> U64(64 - BUCKET_BITS)).astype(np.int64)


def _rows(batches, *ids):
    """(ids..., text bytes) row by row, taking few rows of a batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield from zip(*(ids_of(part, c) for c in ids), raw_texts(part))


# ---- pass 1: sizes, digests, counters ------------------------------------

SCAN = "doc_id long, n long, cls long, alt long, chunk int, slots binary, counts binary"


def _scan(batches):
    import pyarrow as pa
    counts, memo = np.zeros(1 << BUCKET_BITS, np.int64), _WordHash()
    names = [c.split()[0] for c in SCAN.split(", ")]

    def block(rows):
        doc_id, n, cls, alt = zip(*rows)
        none = [None] * len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (doc_id, n, cls, alt)] +
            [pa.array(none, pa.int32()), pa.array(none, pa.binary()), pa.array(none, pa.binary())], names=names)
    rows, pending, held = [], [], 0
    for doc_id, raw in _rows(batches, "doc_id"):
        s = shingle_set(raw, memo)
        rows.append((doc_id, len(s), *_digest(s)) if len(s) else (doc_id, 0, None, None))
        pending.append(_slot(s))
        held += len(s)
        if held > 1 << 18:
            counts += np.bincount(np.concatenate(pending), minlength=1 << BUCKET_BITS)
            pending, held = [], 0
        if len(rows) >= 10_000:
            yield block(rows)
            rows = []
    if rows:
        counts += np.bincount(np.concatenate(pending), minlength=1 << BUCKET_BITS) if pending else 0
        yield block(rows)
    for k in range(0, len(counts), CHUNK):
        part = counts[k:k + CHUNK]
        slots = np.flatnonzero(part)
        if len(slots):
            yield pa.RecordBatch.from_arrays(
                [pa.array([None], pa.int64())] * 4 +
                [pa.array([k // CHUNK], pa.int32()), pa.array([slots.astype(np.uint16).tobytes()], pa.binary()),
                 pa.array([part[slots].tobytes()], pa.binary())], names=names)


def _add_up(batches):
    """Sums the counters of each chunk; holds one chunk's table per chunk id."""
    import pyarrow as pa
    total = {}
    for batch in batches:
        for k, slots, counts in zip(*(c.to_pylist() for c in batch.columns)):
            part = total.setdefault(k, np.zeros(CHUNK, np.int64))
            part[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts, np.int64)
    for k, part in total.items():
        slots = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([slots.astype(np.uint16).tobytes()], pa.binary()),
             pa.array([part[slots].tobytes()], pa.binary())], names=["chunk", "slots", "counts"])


def _order_table(scan: DataFrame) -> np.ndarray:
    """The counters of all documents: 2 ** BUCKET_BITS numbers, whatever the input."""
    part = "chunk int, slots binary, counts binary"
    parts = scan.where("chunk is not null").select("chunk", "slots", "counts")
    lanes = parts.repartition(partitions(scan.sparkSession), "chunk", F.crc32("counts") % 16)
    summed = lanes.mapInArrow(_add_up, part)
    table = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in summed.repartition(8, "chunk").mapInArrow(_add_up, part).toLocalIterator():
        table[row.chunk * CHUNK + np.frombuffer(row.slots, np.uint16).astype(np.int64)] = \
            np.frombuffer(row.counts, np.int64)
    return table


# ---- pass 2: the inverted index ------------------------------------------

_ENTRY = np.dtype([("sig", "<u8"), ("cls", "<i8"), ("size", "<i4"), ("rest", "<i4")])


def _prefix(s, order):
    """The set's prefix, rare shingles first, and what is left at each position."""
    n = len(s)
    need = (PERCENT * n + 99) // 100
    k = n - need + 1
    ranked = s[np.lexsort((s, order[_slot(s)]))[:k]]
    return ranked, n - np.arange(k)


def _postings(order, parts):
    def run(batches):
        import pyarrow as pa
        table, memo, seen = order.value, _WordHash(), set()

        def flush(entries):
            e = np.concatenate(entries)
            key = mix(e["sig"])
            hot = table[_slot(e["sig"])] > HOT
            if hot.any():   # a list that may be huge is cut by class
                pieces = (table[_slot(e["sig"][hot])] // HOT + 1).astype(U64)
                key[hot] += mix(e["cls"][hot].view(U64)) % pieces
            to = (key % U64(parts)).astype(np.int64)
            at = np.argsort(to, kind="stable")
            e, to = e[at], to[at]
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            ends = np.r_[cuts[1:], len(e)]
            return pa.RecordBatch.from_arrays(
                [pa.array(to[cuts], pa.int32()),
                 pa.array([e[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary())], names=["part", "packed"])

        entries, held = [], 0
        for (raw,) in _rows(batches):
            s = shingle_set(raw, memo)
            if not len(s):
                continue
            cls = _digest(s)[0]
            if cls in seen:             # a copy met in this task adds nothing
                continue
            if len(seen) < MEMO:
                seen.add(cls)
            sig, rest = _prefix(s, table)
            e = np.empty(len(sig), _ENTRY)
            e["sig"], e["cls"], e["size"], e["rest"] = sig, cls, len(s), rest
            entries.append(e)
            held += len(e)
            if held > 1 << 18:
                yield flush(entries)
                entries, held = [], 0
        if held:
            yield flush(entries)
    return run


LISTS = "sig long, cls long, size int, rest int"


def _has_partner(e):
    """Which entries have another one in their list that they can link with.

    Compares every entry with the next, the one after it, and so on, in all lists
    at once; entries of lists longer than ``WIDE`` are all kept for later.
    """
    sig, size, rest = e["sig"], e["size"].astype(np.int64), e["rest"].astype(np.int64)
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    length = np.diff(np.r_[first, len(e)])
    found = np.repeat(length > WIDE, length)
    for d in range(1, min(WIDE, int(length.max()))):
        fit = (sig[d:] == sig[:-d]) & _fits(size[:-d], rest[:-d], size[d:], rest[d:])
        found[:-d] |= fit
        found[d:] |= fit
    return found


def _shared(order):
    """Keeps the entries of shingles that more than one class has."""
    def run(batches):
        import pyarrow as pa
        table = order.value
        packed = [np.frombuffer(x, _ENTRY) for b in batches
                  for x in b.column(b.schema.get_field_index("packed")).to_pylist()]
        if not packed:
            return
        e = np.concatenate(packed)
        del packed
        e = e[np.lexsort((e["cls"], e["sig"]))]
        new = np.r_[True, (e["sig"][1:] != e["sig"][:-1]) | (e["cls"][1:] != e["cls"][:-1])]
        e = e[new]
        e = e[_has_partner(e) | (table[_slot(e["sig"])] > HOT)]
        for k in range(0, len(e), 100_000):
            c = e[k:k + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c["sig"].view(np.int64)), pa.array(np.ascontiguousarray(c["cls"])),
                 pa.array(np.ascontiguousarray(c["size"])), pa.array(np.ascontiguousarray(c["rest"]))],
                names=["sig", "cls", "size", "rest"])
    return run


# ---- answers by differences ----------------------------------------------

DIFFERENCES = "sig long, cls long, comp long, rep long, size int, rest int, need int, linked boolean, sketch binary"


def _sketch(s):
    """The parities of the shingles in each of SKETCH classes, as bytes."""
    return np.packbits((np.bincount((mix(s ^ _FACTORS[4]) % U64(SKETCH)).astype(np.int64),
                                    minlength=SKETCH) & 1).astype(bool)).tobytes()


def _likenesses(several: DataFrame) -> DataFrame:
    """(cls, comp, rep): the class that each class of a list is to be told apart from.

    It names the most central of its lists' pivots, among those met at least half
    as often as any, which names one in its turn: two jumps bring neighbours together.
    """
    rank = F.struct((-F.floor(4 * F.log2("entries"))).alias("near"), F.xxhash64("cls").alias("by"))
    pivot = several.groupBy("sig").agg(F.min(F.struct(rank.alias("r"), "cls", "size")).alias("p"))
    met = several.join(pivot, "sig").where("2 * least(size, p.size) >= greatest(size, p.size)")
    often = met.groupBy("cls", "comp", F.col("p.r").alias("r"), F.col("p.cls").alias("b")) \
        .agg(F.count(F.lit(1)).alias("times"))
    most = often.withColumn("most", F.max("times").over(W.partitionBy("cls")))
    best = most.where("2 * times >= most").groupBy("cls", "comp").agg(F.min(F.struct("r", "b")).alias("x"))
    named = materialise(best.select("cls", "comp", F.col("x.b").alias("rep")), "op1-named")
    for _ in range(2):
        onto = named.select(F.col("cls").alias("rep"), F.col("rep").alias("to"))
        named = materialise(named.join(onto, "rep", "left")
                            .select("cls", "comp", F.coalesce("to", "rep").alias("rep")), "op1-named")
    return named


def _difference(base, s, order):
    """(entries, rest, need) of a set told apart from ``base``, or None if they are too unlike.

    Entries are hashes of what it adds, rare shingles first, and then of what it
    lacks, common ones first, as few sets lack the same of those. Only the
    positions stay from which a set that ``base`` does not answer for can be reached.
    """
    added = np.setdiff1d(s, base, assume_unique=True)
    lacked = np.setdiff1d(base, s, assume_unique=True)
    d, a, r = len(lacked), len(added), len(base)
    if 2 * (r - d) < max(r, len(s)):            # less than half of the larger one in common
        return None
    need = 200 * d + 150 * a - 25 * r
    added = added[np.lexsort((added, order[_slot(added)]))]
    lacked = lacked[np.lexsort((lacked, -order[_slot(lacked)]))]
    entries = np.concatenate([mix(added ^ _FACTORS[2]), mix(lacked ^ _FACTORS[3])])
    rest = d + a - np.arange(d + a)
    least = need + 25 * r if need <= 25 * r else need - 25 * r  # need of itself and of any partner in another group
    far = 350 * rest >= least
    return entries[far], rest[far], need


def _differences(order):
    """Index entries of each member's differences, after a row (without sig) for the member itself.

    A member too unlike its class is told apart from itself and has no entries.
    """
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("comp", pa.int64()), ("rep", pa.int64()),
                            ("size", pa.int32()), ("rest", pa.int32()), ("need", pa.int32()),
                            ("linked", pa.bool_()), ("sketch", pa.binary())])
        table = order.value
        out, held = [], 0
        for batch in batches:
            raw, base = (batch.column(batch.schema.get_field_index(c)) for c in ("shingles", "base"))
            for k, cls, comp, rep in zip(range(batch.num_rows), *(ids_of(batch, c) for c in ("cls", "comp", "rep"))):
                s, b = np.frombuffer(raw[k].as_buffer(), U64), np.frombuffer(base[k].as_buffer(), U64)
                entries, rest, need = _difference(b, s, table) or (np.empty(0, U64), np.empty(0, np.int64), None)
                if need is None:
                    rep, need, linked = cls, 0, False
                else:
                    linked = need <= 25 * len(b)
                n = len(entries) + 1
                key = mix(entries ^ np.array([rep], np.int64).view(U64)).view(np.int64)
                out.append(pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(key)])] +
                    [pa.array(np.full(n, x), f.type) for x, f in zip((cls, comp, rep, len(s)), list(schema)[1:5])] +
                    [pa.array(np.r_[0, rest], pa.int32()), pa.array(np.full(n, need), pa.int32()),
                     pa.array(np.full(n, linked)), pa.array([_sketch(s)] * n, pa.binary())], schema=schema))
                held += n
                if held > 50_000:
                    yield from pa.Table.from_batches(out, schema).combine_chunks().to_batches()
                    out, held = [], 0
        if held:
            yield from pa.Table.from_batches(out, schema).combine_chunks().to_batches()
    return run


def _told_apart(several, sets, order, scratch):
    """The rows of ``_differences`` for all classes of these lists; many members of one R go to several tasks."""
    members = _likenesses(several)
    crowd = members.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("lanes"))
    base = crowd.join(sets.select(F.col("cls").alias("rep"), F.col("shingles").alias("base")), "rep") \
        .withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    full = members.join(crowd, "rep").withColumn("lane", F.pmod(F.xxhash64("cls"), "lanes").cast("int")) \
        .drop("lanes").join(sets, "cls")
    both = full.join(base.drop("lanes"), ["rep", "lane"]).select("cls", "comp", "rep", "shingles", "base")
    return scratch.write(both.mapInArrow(lean(_differences(order)), DIFFERENCES), "op1-differences")


# ---- candidates and exact checks -----------------------------------------

def _fits(size_a, rest_a, size_b, rest_b):
    """Whether sets of these sizes, first meeting at these positions, can link."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    return ((100 * small >= PERCENT * large) &
            ((100 + PERCENT) * np.minimum(rest_a, rest_b) >= PERCENT * (size_a + size_b)))


def _promising(lists: DataFrame, turn: int, central: bool) -> DataFrame:
    """(a, b): for each group, the outside pivot that one of its classes meets most often.

    A list's pivot is its least class in an order that changes every turn; a
    central one comes from those with the most entries in all lists, texts close
    to many others. A crowded list so proposes one pair per group and not all.
    """
    rank = F.struct(-F.floor(4 * F.log2("entries")) if central else F.lit(0), F.xxhash64("cls", F.lit(turn)))
    pivot = lists.groupBy("sig").agg(F.min(F.struct(rank.alias("r"), "cls", "comp", "size", "rest")).alias("p"))
    met = lists.join(pivot, "sig").where("comp <> p.comp").where(
        f"100 * least(size, p.size) >= {PERCENT} * greatest(size, p.size)"
        f" and {100 + PERCENT} * least(rest, p.rest) >= {PERCENT} * (size + p.size)")
    often = met.groupBy("comp", "cls", F.col("p.cls").alias("b"), F.col("p.r").alias("r")) \
        .agg(F.count("*").alias("times"))
    best = often.groupBy("comp").agg(F.max(F.struct("times", "r", "cls", "b")).alias("x"))
    return best.select(F.least("x.cls", "x.b").alias("a"), F.greatest("x.cls", "x.b").alias("b")).distinct()


def _cross(batches):
    """All pairs of a list that can link across groups; long lists as block pairs.

    Rows come sorted by shingle and need. Yields pairs (a, b), or two packed
    blocks that another task compares. Without other columns a set needs 150
    times its size (two sets link at 350 common shingles for what they need
    together), is told apart from itself and has an empty sketch.
    """
    import pyarrow as pa
    names = ["a", "b", "left", "right"]

    def pairs(a, b):
        none = pa.nulls(len(a), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none], names=names)

    def columns(batch):
        found = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(batch.schema.names)}
        rows, words = batch.num_rows, SKETCH // 64
        found.setdefault("rep", found["cls"])
        found.setdefault("need", 150 * found["size"].astype(np.int64))
        sketch = np.frombuffer(b"".join(found["sketch"]), np.int64).reshape(rows, words) if "sketch" in found \
            else np.zeros((rows, words), np.int64)
        return [found["sig"], *(found[c].astype(np.int64) for c in ("cls", "comp", "rep", "size", "rest", "need")), *sketch.T]

    def one_list(*cols):
        size, rest, need = cols[3:6]
        n = len(size)
        cuts = range(0, n, BLOCK)
        for i in cuts:
            for j in cuts:
                if j < i:
                    continue
                x, y = slice(i, i + BLOCK), slice(j, j + BLOCK)
                if 100 * size[x].max() < PERCENT * size[y].min() or 100 * size[y].max() < PERCENT * size[x].min() or \
                        350 * min(rest[x].max(), rest[y].max()) < need[x].min() + need[y].min():
                    continue    # no pair of these blocks can link
                if n <= BLOCK:
                    yield _block_pairs([c[x] for c in cols], [c[y] for c in cols], i == j)
                else:
                    pack = [np.stack([c[z] for c in cols]).astype("<i8").tobytes() for z in (x, y)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                         pa.array([pack[0]], pa.binary()), pa.array([pack[1]], pa.binary())], names=names)

    held, out_a, out_b, count = None, [], [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            cols = columns(batch)
            if held is not None:
                cols = [np.concatenate(z) for z in zip(held, cols)]
            sig = cols[0]
            if not len(sig):
                continue
            cuts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            held = [c[cuts[-1]:] for c in cols]     # the last list may go on
            done = [c[:cuts[-1]] for c in cols]
            cuts = np.r_[cuts[:-1], cuts[-1]]
        else:
            if held is None:
                break
            done, cuts = held, np.array([0, len(held[0])])
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j - i < 2:
                continue
            for found in one_list(*(c[i:j] for c in done[1:])):
                if isinstance(found, tuple):
                    out_a.append(found[0])
                    out_b.append(found[1])
                    count += len(found[0])
                else:
                    yield found
            if count > 200_000:
                yield pairs(*_unique(out_a, out_b))
                out_a, out_b, count = [], [], 0
    if count:
        yield pairs(*_unique(out_a, out_b))


def _unique(a, b):
    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return both[0], both[1]


def _block_pairs(left, right, same):
    """The pairs of two blocks of a list that can link, of different groups and told apart from different classes."""
    cls, comp, rep, size, rest, need = (c[:, None] for c in left[:6])
    cls2, comp2, rep2, size2, rest2, need2 = (c[None] for c in right[:6])
    ok = ((100 * np.minimum(size, size2) >= PERCENT * np.maximum(size, size2)) &
          (350 * np.minimum(rest, rest2) >= need + need2) & (comp != comp2) & (rep != rep2))
    cls, cls2 = cls[:, 0], cls2[0]
    if same:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    odd = np.zeros(len(i), np.int64)
    for one, two in zip(left[6:], right[6:]):
        odd += np.bitwise_count((one[i] ^ two[j]).view(U64))
    # linked sets differ in at most (100 - PERCENT) of (100 + PERCENT) parts of their sizes
    may = (100 + PERCENT) * odd <= (100 - PERCENT) * (left[3][i] + right[3][j])
    i, j = i[may], j[may]
    return np.minimum(cls[i], cls2[j]), np.maximum(cls[i], cls2[j])


def _blocks(batches):
    import pyarrow as pa
    for batch in batches:
        for left, right in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("left", "right"))):
            x, y = (np.frombuffer(z, "<i8").reshape(6 + SKETCH // 64, -1) for z in (left, right))
            a, b = _block_pairs(x, y, left == right)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sets(batches):
    """The full set of each chosen document, in blocks of bytes; rows come by doc_id."""
    import pyarrow as pa
    memo = _WordHash()

    def block(keys, out):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())],
                                          names=["cls", "shingles"])
    out, keys, held, last, done = [], [], 0, None, set()
    for doc_id, cls, raw in _rows(batches, "doc_id", "cls"):
        if doc_id != last:
            last, done = doc_id, set()
        if cls in done:
            continue
        s = shingle_set(raw, memo)
        if not len(s) or cls is not None and _digest(s)[0] != cls:
            continue                        # another row under the same id
        if cls is None:                     # a row without an id speaks for its own class
            cls = _digest(s)[0]
        else:
            done.add(cls)
        out.append(s.tobytes())
        keys.append(cls)
        held += len(out[-1])
        if held > 1 << 22:
            yield block(keys, out)
            out, keys, held = [], [], 0
    if out:
        yield block(keys, out)


def _verify(batches):
    import pyarrow as pa
    for batch in batches:
        keep = []
        cols = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "left", "right")]
        for k in range(batch.num_rows):
            x, y = np.frombuffer(cols[2][k].as_buffer(), U64), np.frombuffer(cols[3][k].as_buffer(), U64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                keep.append(k)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([cols[0].take(at), cols[1].take(at)], names=["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs whose full sets link. Written first, so that few pairs need no shuffle of the sets."""
    pairs = scratch.write(pairs, "op1-pairs")
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right") \
        .mapInArrow(lean(_verify), "a long, b long")


def _crossing(lists: DataFrame) -> float:
    """Pairs across groups in all lists, for each entry."""
    alike = lists.groupBy("sig", "comp").agg(F.count(F.lit(1)).cast("double").alias("n"))
    each = alike.groupBy("sig").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("inside"))
    total = each.agg(F.sum((F.col("all") * F.col("all") - F.col("inside")) / 2).alias("x"), F.sum("all").alias("n")).first()
    return (total.x or 0) / (total.n or 1)


def _relabel(groups, links, scratch):
    """Group labels after more links; a class without a label is its own group."""
    found = scratch.write(links, "op1-links")
    if groups is not None:
        g = groups.select(F.col("node").alias("k"), F.col("comp").alias("c"))
        ends = found.join(g.toDF("a", "ca"), "a", "left").join(g.toDF("b", "cb"), "b", "left")
        found = ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    fresh = components(found)
    if groups is None:
        return fresh
    onto = fresh.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    moved = groups.join(onto, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = fresh.join(groups.select("node"), "node", "left_anti")
    return materialise(moved.unionByName(new), "op1-groups")


def ngram_components(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row of ``docs``.

    component_id is the smallest doc_id that links reach, the row's own
    included; class_id is equal for equal shingle sets and null for empty ones.
    """
    spark = docs.sparkSession
    parts, scratch = partitions(spark), Scratch(spark)
    texts = id_text(docs, id_col, text_col)
    scan = materialise(texts.mapInArrow(lean(_scan), SCAN), "op1-scan")
    order = spark.sparkContext.broadcast(_order_table(scan))
    rows = scan.where("chunk is null").select("doc_id", "n", "cls")

    packed = texts.select("text").mapInArrow(lean(_postings(order, parts)), "part int, packed binary")
    lists = scratch.write(packed.repartition(parts, "part").mapInArrow(lean(_shared(order)), LISTS), "op1-lists")
    entries = lists.groupBy("cls").agg(F.count(F.lit(1)).alias("entries"))
    lists = scratch.write(lists.join(entries, "cls"), "op1-ranked")

    # one document stands for each class that shares an entry
    chosen = rows.join(lists.select("cls").distinct(), "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    stand_in = texts.join(chosen, "doc_id").select("doc_id", "cls", "text")
    sets = stand_in.mapInArrow(lean(_sets), "cls long, shingles binary")
    # a class of which no row has an id is spoken for by any of its rows
    nameless = texts.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("cls"), "text")
    nameless = nameless.mapInArrow(lean(_sets), "cls long, shingles binary") \
        .join(chosen.where("doc_id is null").select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    sets = scratch.write_by(sets.unionByName(nameless), "op1-sets", "cls")

    mixed, groups, before = _with_groups(lists, None), None, float("inf")
    for turn in range(ROUNDS):
        proposed = _promising(mixed, turn, True).union(_promising(mixed, turn, False)).distinct()
        groups = _relabel(groups, _links(proposed, sets, scratch), scratch)
        mixed = scratch.write(_with_groups(lists, groups), "op1-mixed")
        crossing = _crossing(mixed)
        if crossing <= CROSSING or crossing > GAIN * before:
            break
        before = crossing
    several = scratch.write(_of_several(mixed, "comp"), "op1-several")
    apart = _told_apart(several, sets, order, scratch)
    members = apart.where("sig is null").select("cls", "rep", "linked", "sketch")
    direct = several.join(members, "cls").withColumn("need", 150 * F.col("size"))
    changed = _of_several(apart.where("sig is not null"), "comp").withColumn("rep", F.col("cls"))
    columns = ["sig", "cls", "comp", "rep", "size", "rest", "need", "sketch"]
    left = _of_several(direct, "rep").select(columns).unionByName(changed.select(columns))
    found = scratch.write(left.repartition(parts, "sig").sortWithinPartitions("sig", "need")
                          .mapInArrow(lean(_cross), "a long, b long, left binary, right binary"), "op1-cross")
    dealt = found.where("a is null").select("left", "right").repartition(parts, F.crc32("left"), F.crc32("right"))
    pairs = found.where("a is not null").select("a", "b").union(dealt.mapInArrow(lean(_blocks), "a long, b long")).distinct()
    derived = members.where("linked and cls <> rep").select(F.col("cls").alias("a"), F.col("rep").alias("b"))
    groups = _relabel(groups, _links(pairs, sets, scratch).union(derived), scratch)
    scratch.drop()

    named = rows.join(groups.select(F.col("node").alias("cls"), "comp"), "cls", "left")
    named = named.select("doc_id", "n", "cls", F.coalesce("comp", "cls").alias("comp"))
    least = named.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.coalesce("least", "doc_id").alias("component_id"), F.col("cls").alias("class_id"))


def _of_several(lists, by):
    """The lists that hold more than one value of a column."""
    ends = lists.groupBy("sig").agg(F.min(by).alias("lo"), F.max(by).alias("hi")).where("lo <> hi")
    return lists.join(ends.select("sig"), "sig")


def _with_groups(lists, groups):
    if groups is None:
        return lists.withColumn("comp", F.col("cls"))
    g = groups.select(F.col("node").alias("cls"), "comp")
    return lists.join(g, "cls", "left").select(*lists.columns, F.coalesce("comp", "cls").alias("comp"))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with one row of each component left: that of its smallest id.

    An id names one document: of rows that repeat it one stays. Documents without
    words link with nothing and all stay, and so do rows without an id.
    """
    comps = ngram_components(docs, id_col, text_col)
    best = comps.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(best, docs[id_col].cast("long") == F.col("_keep"), "left_semi")
    return kept.dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
