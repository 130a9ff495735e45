"""Toxicity by compression distance: two zstandard dictionaries, one window at a time.

Fitting, on a bounded sample of labelled documents (``PER_CLASS`` of each label,
texts up to ``MAX_BYTES``):
  * One half of the sample makes the dictionaries. Both start from what
    ordinary text has in common, a dictionary trained by zstandard on windows
    of ordinary documents. The toxic one adds the pieces of words that toxic
    documents have and ordinary ones lack, found by a likelihood-ratio test
    over letter 5-grams, the strongest first, each grown to the word part its
    words share.
  * The other half calibrates: how many bytes shorter the toxic dictionary must
    make a window, and a logistic curve from the density of such windows in a
    document to its score.
Scoring cuts each whole text into windows of ``WINDOW`` words and compresses
every window with either dictionary. An ordinary window costs the same with
both, a toxic one less with the toxic dictionary.

Defined results: null, empty and blank texts have no windows and get the score
of a document without any sign; without labels of both kinds every score is the
share of label 1 (0 without labels). Ids and extra columns never matter.
"""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, id_text, ids_of, lean
from .labelled import labelled_sample

PER_CLASS = 2000
MAX_BYTES = 32_768
WINDOW = 12
BASE_BYTES = 16_384
LEVEL = 6
#: Shortest match: shorter ones would count letters that any two words share.
MATCH = 5
GRAM = 5
#: A piece must be this many times likelier in toxic documents.
LIFT = 8
#: Ordinary words kept for every four letters that a toxic piece shares with them.
LOOK_ALIKES = 12


def windows(text, words=WINDOW):
    """Lower-cased windows of a text as bytes, each framed by blanks."""
    w = text.lower().split() if text else []
    return [(" " + " ".join(w[i:i + words]) + " ").encode() for i in range(0, len(w), words)]


def _grams(word):
    framed = f" {word}"
    return {framed[i:i + GRAM] for i in range(len(framed) - GRAM + 1)}


def _document_counts(texts):
    df = Counter()
    for text in texts:
        df.update(set().union(*map(_grams, set(text.lower().split()))))
    return df


def _ratio(a, n1, b, n0):
    """Log-likelihood ratio of a piece in a of n1 toxic and b of n0 ordinary texts."""
    p = (a + b) / (n1 + n0)

    def ll(k, n, q):
        return (k * math.log(q) if k else 0) + ((n - k) * math.log(1 - q) if n > k else 0)
    return 2 * (ll(a, n1, a / n1) + ll(b, n0, b / n0) - ll(a, n1, p) - ll(b, n0, p))


def _grow(piece, words):
    """The piece with the neighbours that nine in ten of its words share."""
    total = sum(words.values())
    for side in (1, -1):
        while True:
            beside = Counter()
            for word, n in words.items():
                framed = f" {word} "
                k = framed.find(piece)
                if k >= 0:
                    beside[framed[k + len(piece):][:1] if side == 1 else framed[:k][-1:]] += n
            char, n = beside.most_common(1)[0]
            if not char or n < .9 * total:
                break
            piece = piece + char if side == 1 else char + piece
            if char == " ":
                break
    return piece


def toxic_pieces(ordinary, toxic):
    """Word parts that set the toxic texts apart, the most telling first."""
    df0, df1 = _document_counts(ordinary), _document_counts(toxic)
    n0, n1 = len(ordinary), len(toxic)
    bar = 2 * math.log(max(2, len(df1))) + 12
    telling = {g for g, a in df1.items() if a >= 3 and a / n1 >= LIFT * (df0[g] + .5) / n0
               and _ratio(a, n1, df0[g], n0) > bar}
    met = defaultdict(lambda: defaultdict(set))
    for k, text in enumerate(toxic):
        for word in set(text.lower().split()):
            for g in _grams(word) & telling:
                met[g][word].add(k)
    pieces, used = [], set()
    while telling:
        reach = {g: set().union(*(d for w, d in met[g].items() if w not in used)) for g in telling}
        best = min(telling, key=lambda g: (3 * df0[g] - len(reach[g]), not g.startswith(" "), g))
        a = len(reach[best])
        if a < max(3, .005 * n1) or a / n1 < LIFT * (df0[best] + .5) / n0 or _ratio(a, n1, df0[best], n0) <= bar:
            break
        words = {w: len(d) for w, d in met[best].items() if w not in used}
        pieces.append(_grow(best, words))
        used |= words.keys()
        telling.discard(best)
    return pieces


def _compressor(content):
    import zstandard
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MATCH, write_content_size=False, write_checksum=False, write_dict_id=False,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=params)


def train_dictionaries(ordinary, toxic):
    """(ordinary, toxic) dictionary contents."""
    import zstandard
    samples = [w for text in ordinary for w in windows(text)]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, samples).as_bytes()
    except zstandard.ZstdError:     # too little text to train on: the text itself serves
        base = b"".join(samples)[-BASE_BYTES:]
    pieces = toxic_pieces(ordinary, toxic) if ordinary and toxic else []
    base = _look_alikes(ordinary, pieces) + base
    return base, "".join(p if p.startswith(" ") else f" {p}" for p in reversed(pieces)).encode() + b" " + base


def _look_alikes(ordinary, pieces):
    """Ordinary words that share letters with the pieces; both dictionaries know them."""
    parts = {p.strip()[k:k + 4] for p in pieces for k in range(len(p.strip()) - 3)}
    if not parts:
        return b""
    words = Counter(w for text in ordinary for w in set(text.lower().split()) if not any(p.strip() in w for p in pieces))
    alike = {}
    for word in sorted(words, key=lambda w: (-words[w], w)):
        for part in {word[k:k + 4] for k in range(len(word) - 3)} & parts:
            if len(alike.setdefault(part, [])) < LOOK_ALIKES:
                alike[part].append(word)
    return "".join(f" {w} " for w in sorted({w for part in alike.values() for w in part})).encode()


class Gains:
    """Bytes that the toxic dictionary saves in each window of a text."""

    def __init__(self, ordinary, toxic):
        self.ordinary, self.toxic = _compressor(ordinary).compress, _compressor(toxic).compress

    def __call__(self, text):
        return [len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text)]


def _signs(gains, bars):
    """How densely a document's windows pass each bar, on a log scale, and the best window.

    Densities, not counts: chance matches add up with a text's length.
    """
    g = np.array(gains or [0])
    dense = [math.log((int((g >= bar).sum()) + .05) / (len(g) + 4)) for bar in bars]
    return [1.0, *dense, min(float(g.max()), 8.0) / 4]


def _logistic(x, y, ridge=.05, rounds=40):
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fit(ordinary, toxic):
    """A model: two dictionaries, the window thresholds and the curve over a document's signs."""
    share = len(toxic) / max(1, len(ordinary) + len(toxic))
    if not ordinary or not toxic:
        return {"base": share}
    rng = random.Random(7)
    ordinary, toxic = rng.sample(ordinary, len(ordinary)), rng.sample(toxic, len(toxic))
    cut0, cut1 = (len(ordinary) + 1) // 2, (len(toxic) + 1) // 2
    dicts = train_dictionaries(ordinary[:cut0], toxic[:cut1])
    gains = Gains(*dicts)
    held = [(gains(t), y) for y, texts in ((0, ordinary[cut0:] or ordinary), (1, toxic[cut1:] or toxic)) for t in texts]
    y = np.array([k for _, k in held], float)
    tried = [(low, low + 1, low + 2) for low in (1, 2, 3)]
    fits = [(*_logistic(np.array([_signs(g, bars) for g, _ in held]), y), bars) for bars in tried]
    curve, _, bars = min(fits, key=lambda f: f[1])
    return {"dicts": dicts, "curve": curve, "bars": bars}


class Scorer:
    def __init__(self, model):
        self.model = model
        self.gains = Gains(*model["dicts"]) if "dicts" in model else None

    def __call__(self, text):
        if self.gains is None:
            return self.model["base"]
        z = float(np.dot(_signs(self.gains(text), self.model["bars"]), self.model["curve"]))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    model = spark.sparkContext.broadcast(fit(*labelled_sample(texts, labels, "toxic", PER_CLASS, MAX_BYTES)))

    def run(batches):
        import pyarrow as pa
        scorer = Scorer(model.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            scores = [scorer(x.as_py()) for x in column]
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(batch, "doc_id"), pa.int64()),
                                              pa.array(scores, pa.float64())], names=["doc_id", "score"])
    out = texts.mapInArrow(lean(run), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose score reaches 0.5; every column stays as it is."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(*labelled_sample(docs, labels, "toxic", PER_CLASS, MAX_BYTES)))
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa
        scorer = Scorer(model.value)
        for batch in batches:
            keep = [k for k, x in enumerate(batch.column(at)) if scorer(x.as_py()) < 0.5]
            yield batch.take(pa.array(keep, pa.int64()))
    return docs.mapInArrow(lean(run), docs.schema)
