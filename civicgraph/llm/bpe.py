"""Byte-level BPE: text to token ids and back, from a public rank file.

Two tiers. A pre-token that is itself a vocabulary entry is found by a minimal
perfect hash: a first hash picks a bucket, the bucket's displacement makes a
second hash unique, and one comparison with the stored bytes confirms the hit.
Any other pre-token is merged from its bytes: they form a doubly linked list,
a heap hands out the neighbours of the lowest rank (leftmost first), and each
merge links the list anew and offers at most two new pairs. Up to ``SHORT`` bytes
the lowest rank is looked for among all neighbours instead, with the same result.

The table is built once on the driver and broadcast; it is as large as the
vocabulary file, whatever the corpus. Processes remember what stands between
blanks, a bounded number of strings of bounded length.

Defined results: null and empty texts have no tokens; bytes that no merge
covers stay single-byte tokens; ids of equal texts are equal.
"""

import base64
import hashlib
import heapq
import uuid
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import id_text, ids_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Keys for each displacement of the perfect hash, on average.
LOAD = 2
#: A process remembers up to twice MEMO pre-tokens and as many strings between blanks,
#: each of at most LONGEST characters; up to twice BESIDE where whole documents are
#: encoded, which is done beside other operators.
MEMO = 300_000
BESIDE = 40_000
LONGEST = 24
#: Bytes up to which a scan over all neighbours costs less than a heap.
SHORT = 32


def read_ranks(path):
    """{token bytes: rank} of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _hash(token, seed=0):
    from xxhash import xxh3_64_intdigest
    return xxh3_64_intdigest(token, seed)


class PerfectHash:
    """A minimal perfect hash over a fixed set of byte strings, by displacement."""

    def __init__(self, keys):
        n = self.n = len(keys)
        self.buckets = max(1, n // LOAD)
        first = [_hash(k) for k in keys]
        groups = {}
        for k, h in enumerate(first):
            groups.setdefault(h % self.buckets, []).append(k)
        self.shift = [0] * self.buckets
        taken = [False] * n
        self.slot_of = [0] * n
        for bucket, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:
                break                       # the rest takes what is free
            d = 0
            while True:
                slots = [self._slot(first[k], d) for k in members]
                if len(set(slots)) == len(members) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for k, s in zip(members, slots):
                self.slot_of[k], taken[s] = s, True
        free = (s for s in range(n) if not taken[s])
        for bucket, members in groups.items():
            if len(members) == 1:           # a lone key names its slot outright
                s = self.slot_of[members[0]] = next(free)
                self.shift[bucket] = -1 - s

    def _slot(self, h, d):
        h = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        h = (h ^ (h >> 31)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        return (h ^ (h >> 32)) % self.n

    def __call__(self, token):
        h = _hash(token)
        d = self.shift[h % self.buckets]
        return self._slot(h, d) if d >= 0 else -1 - d


class Bpe:
    """Encoder and decoder over a rank table."""

    def __init__(self, ranks, pattern):
        self.ranks, self.pattern, self.key = ranks, pattern, uuid.uuid4().hex
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.keys, self.ids = [b""] * len(tokens), [0] * len(tokens)
        for k, token in enumerate(tokens):
            slot = self.hash.slot_of[k]
            self.keys[slot], self.ids[slot] = token, ranks[token]
        self.hash.slot_of = None
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def lookup(self, token):
        """The id of a token of the vocabulary, else None."""
        slot = self.hash(token)
        return self.ids[slot] if self.keys[slot] == token else None

    def merge(self, piece):
        """Ids of a byte string that is no token itself."""
        return self._merge_short(piece) if len(piece) <= SHORT else self._merge_long(piece)

    def _merge_short(self, piece):
        """Merge the leftmost pair of the lowest rank, over and over."""
        rank_of, none = self.ranks.get, len(self.bytes_of)
        cuts = list(range(len(piece) + 1))
        pairs = [rank_of(piece[k:k + 2], none) for k in cuts[:-2]]
        while pairs and (low := min(pairs)) < none:
            k = pairs.index(low)
            del pairs[k], cuts[k + 1]
            if k < len(pairs):
                pairs[k] = rank_of(piece[cuts[k]:cuts[k + 2]], none)
            if k:
                pairs[k - 1] = rank_of(piece[cuts[k - 1]:cuts[k + 1]], none)
        return [rank_of(piece[i:j]) for i, j in zip(cuts, cuts[1:])]

    def _merge_long(self, piece):
        """The same by a heap over the linked bytes."""
        n, rank_of, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, k + 1, k + 2) for k in range(n - 1) if (r := rank_of(piece[k:k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, left, middle, stop = pop(heap)
            if end[left] != middle or (right := after[left]) >= n or end[right] != stop:
                continue                    # either part has been merged since
            end[left], end[right] = stop, -1
            after[left] = beyond = after[right]
            if beyond < n:
                before[beyond] = left
                if (r := rank_of(piece[left:end[beyond]])) is not None:
                    push(heap, (r, left, stop, end[beyond]))
            back = before[left]
            if back >= 0 and (r := rank_of(piece[back:stop])) is not None:
                push(heap, (r, back, left, stop))
        ids, k = [], 0
        while k < n:
            ids.append(rank_of(piece[k:end[k]]))
            k = after[k]
        return ids

    def piece(self, token):
        found = self.lookup(token)
        return [found] if found is not None else self.merge(token)

    def split(self):
        """The pre-tokeniser, compiled in the process that uses it."""
        import regex
        return regex.compile(self.pattern).findall

    def encode(self, text):
        return [i for token in self.split()(text) for i in self.piece(token.encode())] if text else []

    def decode(self, ids):
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Memo(dict):
    """Remembers up to twice ``most`` results of short keys; what is asked for again survives a turnover."""

    def __init__(self, work, most):
        super().__init__()
        self.work, self.most, self.old = work, most, {}

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.work(key)
        found = self.old.pop(key, None)
        if found is None:
            found = self.work(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found

    def forget(self):
        self.clear()
        self.old = {}


class Encoder:
    """Text -> ids, remembering what stands between blanks, up to a bound.

    A blank followed by anything but white space always starts a pre-token, so
    the text can be cut there first. Where white space meets a blank the
    pre-tokeniser sees the whole text.
    """

    def __init__(self, bpe, most=None):
        self.split, self.most = bpe.split(), MEMO if most is None else most
        self.pieces = _Memo(lambda token: tuple(bpe.piece(token.encode())), self.most)
        self.chunks = _Memo(lambda chunk: self._whole(f" {chunk}"), self.most)

    def forget(self):
        """Drop what is remembered; the tables stay."""
        self.pieces.forget()
        self.chunks.forget()

    def _whole(self, text):
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def __call__(self, text):
        if not text:
            return []
        chunks = text.split(" ")
        for c in chunks:
            if not c or c[0].isspace() or c[-1].isspace():
                return list(self._whole(text))
        ids = list(self._whole(chunks[0]))
        ids.extend(chain.from_iterable(map(self.chunks.__getitem__, chunks[1:])))
        return ids


_ENCODERS = {}


def _encoder(shared, most=None):
    """This process's encoder for a broadcast table, kept from task to task."""
    if shared.value.key not in _ENCODERS:
        _ENCODERS.clear()
        common.REMEMBERED.pop("bpe", None)
        common.give_back()
        _ENCODERS[shared.value.key] = Encoder(shared.value, most)
        common.REMEMBERED["bpe"] = _ENCODERS[shared.value.key].forget
    return _ENCODERS[shared.value.key]


def public_bpe(ranks=RANKS):
    """The encoder of a rank file of the public tokenizers."""
    import public_tokenizers
    return Bpe(read_ranks(public_tokenizers.path(ranks)), public_tokenizers.PATTERN)


def encoded(texts: DataFrame, bpe: Bpe) -> DataFrame:
    """(doc_id, ids, decoded): ids as an array, and the bytes they decode to."""
    return _apply(texts, bpe, "doc_id long, ids array<int>, decoded binary", False)


def digests(texts: DataFrame, bpe: Bpe) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without shipping the ids."""
    return _apply(texts, bpe, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", True)


def _apply(texts, bpe, schema, digest):
    shared = texts.sparkSession.sparkContext.broadcast(bpe)

    def run(batches):
        import pyarrow as pa
        bpe = shared.value
        encode = _encoder(shared, None if digest else BESIDE)
        number = [str(k) for k in range(len(bpe.bytes_of))] if digest else None
        names = [c.split()[0] for c in schema.split(", ")]

        def out(rows):
            doc_id, ids, third = zip(*rows)
            if not digest:
                return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                                                   pa.array(third, pa.binary())], names=names)
            n, sha = zip(*ids)
            return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()),
                                               pa.array(sha, pa.string()), pa.array(third, pa.string())], names=names)
        for batch in batches:
            rows, held = [], 0
            column = batch.column(batch.schema.get_field_index("text"))
            for doc_id, text in zip(ids_of(batch, "doc_id"), column):
                ids = encode(text.as_py())
                back = bpe.decode(ids)
                if digest:
                    sha = hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest()
                    rows.append((doc_id, (len(ids), sha), hashlib.sha256(back).hexdigest()))
                else:
                    rows.append((doc_id, np.array(ids, np.int32), back))
                    held += 5 * len(back)
                if held > 1 << 23:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)
    return texts.mapInArrow(common.lean(run, forget=False), schema)


def encode_digests(docs: DataFrame, ranks=RANKS, id_col="doc_id", text_col="text") -> DataFrame:
    return digests(id_text(docs, id_col, text_col), public_bpe(ranks))


def encode_documents(docs: DataFrame, ranks=RANKS) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): the ids of each document and the text they stand for."""
    out = encoded(id_text(docs), public_bpe(ranks))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.col("decoded").cast("string").alias("decoded"))
