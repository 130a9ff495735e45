"""Benchmark decontamination: a BM25 index of test items, queried with every passage.

Index. Items are split into words (case and punctuation put aside) and, where
longer than ``SEGMENT`` words, into overlapping segments. A posting holds a
segment's BM25 weight for a word, as a share of what the segment would score
against itself, so that a score of 1 means that a passage holds all of it. The
postings are cut into blocks of ``BLOCK`` segments; each word knows its largest
weight in a block.

Search. Every document is cut into passages of two half-passages of ``HALF``
words, one starting at each half. For each passage the block maxima of its
distinct words are added up; a block whose sum stays under ``THRESHOLD`` cannot
hold a match and is skipped with all its postings (block-max WAND). Words that
many segments share are left out of the sums, and the most that they can add to
a segment of the block is added instead. Segments of the blocks that are
left are scored in full; all at or above the threshold are candidates.

Check. For each candidate, the words around the passage are compared with the
item's question (everything but the answer) and answer (its last sentence) by
word ``GRAM``-grams. An item leaks where both are found to ``OVERLAP``, or where
``WHOLE`` of all its grams are.

The benchmark is indexed in shards of at most about ``SHARD`` segments, each
broadcast for one pass over the documents, so what a task holds has a bound
whatever the size of the benchmark. Word statistics are taken over all items.

Defined results: null and empty texts and items match nothing; equal items are
reported each; an item of one sentence takes its last quarter as its answer;
items of fewer words than a gram are compared as one. Extra columns are ignored.
"""

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, ids_of, lean

SEGMENT = 48
HALF = 48
BLOCK = 4
THRESHOLD = 0.5
GRAM = 4
OVERLAP = 0.6
#: Share of all its grams from which an item leaks even if one of its parts was changed.
WHOLE = 0.8
SHARD = 2000
K1, B = 1.2, 0.75
#: Words in more than this share of the segments are left out of the block sums.
COMMON = 0.05

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACED = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+|\n")


def words_of(text):
    """Lower-cased words of a text as UTF-8, without ASCII punctuation."""
    return text.lower().encode("utf-8", "replace").translate(_SPACED).split() if text else []


def split_item(text):
    """(question words, answer words) of an item."""
    parts = [w for w in (words_of(s) for s in _SENTENCE.split(text or "")) if w]
    words = [w for part in parts for w in part]
    n = len(parts[-1]) if len(parts) > 1 else max(1, len(words) // 4) if len(words) > 1 else 0
    return words[:len(words) - n], words[len(words) - n:]


def _grams(words, size=GRAM):
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if words else set()


class _Part:
    """A question or an answer as word n-grams; shorter parts are compared whole."""

    def __init__(self, words):
        self.size = min(GRAM, len(words))
        self.grams = _grams(words, self.size)

    def found(self, words):
        """How many of the part's grams occur among the words."""
        return len(self.grams & _grams(words, self.size)) if self.grams else 0


def segments_of(words):
    """Overlapping segments that cover an item; a short item is one."""
    if len(words) <= SEGMENT:
        return [words] if words else []
    step = SEGMENT // 2
    starts = list(range(0, len(words) - SEGMENT, step)) + [len(words) - SEGMENT]
    return [words[k:k + SEGMENT] for k in starts]


class Index:
    """Postings of one shard of items, in blocks."""

    def __init__(self, items, df, n, mean):
        """items: (item_id, text); df: segments with a word; n: segments; mean: their average length."""
        self.items, segments, self.owner = [], [], []
        for item_id, text in items:
            question, answer = split_item(text)
            self.items.append((item_id, _Part(question), _Part(answer), len(question) + len(answer)))
            for segment in segments_of(question + answer):
                segments.append(segment)
                self.owner.append(len(self.items) - 1)
        self.vocabulary = {}
        rows = []
        for k, segment in enumerate(segments):
            weights = {}
            for w in set(segment):
                tf = segment.count(w)
                idf = math.log(1 + (n - df[w] + .5) / (df[w] + .5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(segment) / mean))
            own = sum(weights.values())
            rows += [(self.vocabulary.setdefault(w, len(self.vocabulary)), k, x / own) for w, x in weights.items()]
        size = len(self.vocabulary)
        word, segment, weight = (np.array(c) for c in zip(*rows)) if rows else (np.empty(0, int),) * 3
        order = np.lexsort((segment, word))
        self.word, self.segment, self.weight = word[order], segment[order].astype(np.int64), weight[order].astype(float)
        self.n_segments, self.n_blocks = len(segments), -(-len(segments) // BLOCK)
        self.start = np.searchsorted(self.word, np.arange(size + 1))
        #: common words have long lists and weigh little: summed up beforehand
        self.heavy = np.diff(self.start) <= max(1, COMMON * self.n_segments)
        slight = np.bincount(self.segment[~self.heavy[self.word]],
                             self.weight[~self.heavy[self.word]], minlength=self.n_segments)
        #: what the slight words can add to any segment of a block
        self.rest = np.zeros(self.n_blocks)
        np.maximum.at(self.rest, np.arange(self.n_segments) // BLOCK, slight)
        # block maxima of the words that weigh something
        key = self.word * max(1, self.n_blocks) + self.segment // BLOCK
        keep = self.heavy[self.word]
        keys, at = np.unique(key[keep], return_inverse=True)
        most = np.zeros(len(keys))
        np.maximum.at(most, at, self.weight[keep])
        self.top_block, self.top = keys % max(1, self.n_blocks), most
        self.top_start = np.searchsorted(keys // max(1, self.n_blocks), np.arange(size + 1))

    def _expand(self, start, terms):
        """Places of all entries of the given words, and which word each belongs to."""
        count = start[terms + 1] - start[terms]
        of = np.repeat(np.arange(len(terms)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[terms][of]
        return place, of

    def candidates(self, terms):
        """(half where the passage starts, segment, score) of all matches in one document.

        terms: the document's words as numbers of the vocabulary, -1 for others.
        """
        half = np.arange(len(terms)) // HALF
        known = np.flatnonzero(terms >= 0)
        halves = int(half[-1]) + 1
        size = len(self.vocabulary)
        distinct = np.unique(half[known] * size + terms[known])
        term, h = distinct % size, distinct // size
        heavy = self.heavy[term]
        place, of = self._expand(self.top_start, term[heavy])
        bound = np.bincount(h[heavy][of] * self.n_blocks + self.top_block[place], self.top[place],
                            minlength=halves * self.n_blocks).reshape(halves, self.n_blocks)
        bound[:-1] += bound[1:].copy()      # a passage is a half and the next one
        live = bound + self.rest >= THRESHOLD
        left = np.flatnonzero(live.any(axis=1))
        if not len(left):
            return []
        place_of = np.full(halves + 1, -1)
        place_of[left] = np.arange(len(left))
        here, before = place_of[h], place_of[h - 1]     # a half serves the passage before it, too
        pairs = np.unique(np.concatenate([(here * size + term)[here >= 0], (before * size + term)[before >= 0]]))
        passage, term = pairs // size, pairs % size
        entry, of = self._expand(self.start, term)
        passage = passage[of]
        keep = live[left][passage, self.segment[entry] // BLOCK]
        entry, passage = entry[keep], passage[keep]
        score = np.bincount(passage * self.n_segments + self.segment[entry], self.weight[entry])
        hit = np.flatnonzero(score >= THRESHOLD)
        return [(int(left[x // self.n_segments]), int(x % self.n_segments), float(score[x])) for x in hit]

    def matches(self, words):
        """{item place: (leaked, score, question overlap, answer overlap)} of a document's words."""
        if not words or not self.vocabulary:
            return {}
        get = self.vocabulary.get
        terms = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        best = {}
        for s, k, score in self.candidates(terms):
            item = self.owner[k]
            _, question, answer, size = self.items[item]
            reach = max(HALF, size)
            around = words[max(0, s * HALF - reach):(s + 2) * HALF + reach]
            q, a = question.found(around), answer.found(around)
            q_all, a_all = len(question.grams), len(answer.grams)
            q_share, a_share = q / q_all if q_all else 1.0, a / a_all if a_all else 1.0
            leaked = min(q_share, a_share) >= OVERLAP or q + a >= WHOLE * (q_all + a_all)
            now = leaked, score, q_share, a_share
            best[item] = max(best.get(item, now), now)
        return best


def build_shards(benchmark: DataFrame):
    """Index shards, one after the other; each is built from a bounded part of the items."""
    items = id_text(benchmark, "item_id", "text").where("text is not null").dropDuplicates()

    def cut(batches):
        import pyarrow as pa
        for batch in batches:
            parts = []
            for item_id, text in zip(ids_of(batch, "doc_id"), batch.column(batch.schema.get_field_index("text"))):
                question, answer = split_item(text.as_py())
                parts += [(item_id, len(s), sorted(set(s))) for s in segments_of(question + answer)]
            if parts:
                a, b, c = zip(*parts)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                                  pa.array(c, pa.list_(pa.binary()))], names=["item", "n", "words"])
    segments = items.mapInArrow(cut, "item long, n long, words array<binary>")
    total = segments.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean")).first()
    if not total.n:
        return
    df = segments.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    shards = -(-total.n // SHARD)
    of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))
    for k in range(shards):
        part = items.where(of == k)
        mine = part.mapInArrow(cut, "item long, n long, words array<binary>") \
            .select(F.explode("words").alias("word")).distinct()
        counts = {bytes(r.word): r.df for r in df.join(mine, "word").collect()}
        yield Index(sorted(((r.doc_id, r.text) for r in part.collect()), key=repr), counts, total.n, total.mean)


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _search(shared):
    def run(batches):
        import pyarrow as pa
        index = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(ids_of(batch, "doc_id"), batch.column(batch.schema.get_field_index("text"))):
                for item, found in index.matches(words_of(text.as_py())).items():
                    if found[0]:
                        rows.append((doc_id, index.items[item][0], *found[1:]))
            if rows:
                names = [c.split()[0] for c in LEAKS.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document and benchmark item that leaks into it, with the best scores."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col)
    found = None
    for index in build_shards(benchmark):
        shard = texts.mapInArrow(lean(_search(spark.sparkContext.broadcast(index))), LEAKS)
        found = shard if found is None else found.unionByName(shard)
    if found is None:
        return spark.createDataFrame([], LEAKS)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("score", "question_overlap", "answer_overlap")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that any benchmark item leaks into; columns stay as they are."""
    spark = docs.sparkSession
    at = docs.columns.index("text")

    def drop(shared):
        def run(batches):
            import pyarrow as pa
            index = shared.value
            for batch in batches:
                keep = [k for k, text in enumerate(batch.column(at))
                        if not any(found[0] for found in index.matches(words_of(text.as_py())).values())]
                yield batch.take(pa.array(keep, pa.int64()))
        return run
    for index in build_shards(benchmark):
        docs = docs.mapInArrow(lean(drop(spark.sparkContext.broadcast(index))), docs.schema)
    return docs
