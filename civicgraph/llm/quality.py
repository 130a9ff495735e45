"""Document quality by a factorisation machine.

A document is a sparse vector: the share of each hashed word (2 ** HASH_BITS
places), structure statistics of the whole text (letter, symbol, digit and
punctuation shares, repeated words and lines, word and line lengths) and its
length as metadata. The model is linear plus all pairwise products, weighted by
inner products of RANK-dimensional factors. The products are never formed:
    sum over pairs of <v_i, v_j> x_i x_j = half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2
so that scoring takes one pass over a document's features.

Fitted on a bounded sample of labelled documents (``PER_CLASS`` of each label,
texts up to ``MAX_BYTES``) by Adagrad; the intercept is then moved to the share
of labels in all training rows. Scoring reads every whole text.

Defined results: null, empty and blank texts are scored from the intercept and an empty
structure vector; without labels of both kinds the score is the share of label 1
(0 without labels). Labels, language, source, ids and extra columns are no input.
"""

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text, ids_of, raw_texts
from .labelled import labelled_sample

HASH_BITS = 15
RANK = 8
PER_CLASS = 2000
MAX_BYTES = 32_768
EPOCHS = 8
RATE = .1
RIDGE = 1e-5
CUT = 0.3
MEMO = 200_000

_CLASSES = 9


def _class_table():
    """Byte -> character class."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
    kinds[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
    kinds[list(b"0123456789")] = 3
    kinds[list(b" \t\r\x0b\x0c")] = 4
    kinds[list(b"\n")] = 5
    kinds[list(b".,;:?'\"()-")] = 6
    kinds[list(b"!")] = 7
    kinds[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 8
    return kinds.tobytes()


_KINDS = _class_table()
STRUCTURE = ("lower", "upper", "digit", "blank", "line end", "punctuation", "exclamation", "symbol", "repeated word",
             "distinct words", "repeated line", "word length", "line length", "length", "has text")


class _Slots(dict):
    """Word -> hashed place, up to a bound."""

    def __missing__(self, word):
        from xxhash import xxh3_64_intdigest
        if len(self) > MEMO:
            self.clear()
        slot = self[word] = xxh3_64_intdigest(word) >> (64 - HASH_BITS)
        return slot


def features(raw, slots):
    """(places, values): hashed words first, then the structure statistics."""
    raw = raw if raw and not raw.isspace() else b""
    words = raw.lower().split()
    n = len(words)
    h = np.fromiter(map(slots.__getitem__, words), dtype=np.int64, count=n)
    at, times = np.unique(h, return_counts=True) if n else (h, h)
    kinds = np.bincount(np.frombuffer(raw.translate(_KINDS), np.uint8), minlength=_CLASSES) if raw else np.zeros(_CLASSES)
    size = max(1, len(raw))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    s = np.array([
        kinds[1] / size, 3 * kinds[2] / size, 3 * kinds[3] / size, kinds[4] / size, 5 * kinds[5] / size,
        5 * kinds[6] / size, 10 * kinds[7] / size, 10 * kinds[8] / size,
        3 * float((h[1:] == h[:-1]).sum()) / max(1, n), len(at) / max(1, n),
        2 * (1 - len(set(lines)) / len(lines)) if lines else 0.0,
        (size - kinds[4] - kinds[5]) / max(1, n) / 10, math.log1p(size / max(1, len(lines))) / 10,
        math.log1p(n) / 10, 1.0 if n else 0.0])
    return (np.concatenate([at, (1 << HASH_BITS) + np.arange(len(s))]),
            np.concatenate([times / max(1, n), s]))


class Machine:
    """Weights w, factors v and the intercept."""

    def __init__(self, seed=11):
        size = (1 << HASH_BITS) + len(STRUCTURE)
        self.w0, self.w = 0.0, np.zeros(size)
        self.v = np.random.default_rng(seed).normal(0, .05, (size, RANK))

    def raw(self, at, x):
        v = self.v[at]
        summed = x @ v
        return self.w0 + float(x @ self.w[at]) + .5 * float(summed @ summed - (x * x) @ (v * v).sum(axis=1))

    def score(self, at, x):
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.raw(at, x)))))

    def fit(self, rows, epochs=EPOCHS, seed=5):
        """Adagrad over ((places, values), label) rows in a fixed shuffled order."""
        gw, gv, g0 = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                (at, x), y = rows[k]
                v = self.v[at]
                summed = x @ v
                z = self.w0 + float(x @ self.w[at]) + .5 * float(summed @ summed - (x * x) @ (v * v).sum(axis=1))
                off = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
                dw = off * x + RIDGE * self.w[at]
                dv = off * (x[:, None] * summed[None] - (x * x)[:, None] * v) + RIDGE * v
                g0 += off * off
                gw[at] += dw * dw
                gv[at] += dv * dv
                self.w0 -= RATE * off / math.sqrt(g0)
                self.w[at] -= RATE * dw / np.sqrt(gw[at])
                self.v[at] -= RATE * dv / np.sqrt(gv[at])
        return self


def fit(zeros, ones, share):
    """A machine for texts of either label; ``share`` is that of label 1 in all training rows."""
    if not zeros or not ones:
        return share
    slots = _Slots()
    rows = [(features(t.encode(), slots), y) for y, texts in ((0, zeros), (1, ones)) for t in texts]
    machine = Machine().fit(rows)
    seen = len(ones) / len(rows)
    machine.w0 += math.log(share / (1 - share)) - math.log(seen / (1 - seen))
    machine.w, machine.v = machine.w.astype(np.float32), machine.v.astype(np.float32)
    return machine


def label_share(labels: DataFrame, target="quality") -> float:
    """Share of label 1 among the rows one may learn from; 0 without any."""
    rows = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    return rows.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    texts = id_text(docs, id_col, text_col)
    sample = labelled_sample(texts, labels, "quality", PER_CLASS, MAX_BYTES)
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample, label_share(labels)))

    def run(batches):
        import pyarrow as pa
        machine, slots = model.value, _Slots()
        for batch in batches:
            if isinstance(machine, float):
                scores = [machine] * batch.num_rows
            else:
                scores = [machine.score(*features(raw, slots)) for raw in raw_texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(batch, "doc_id"), pa.int64()),
                                              pa.array(scores, pa.float64())], names=["doc_id", "score"])
    out = texts.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"))
