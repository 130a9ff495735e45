"""Spelling variants of the corpus' words by an asymmetric join of q-chunks.

How it runs
  1. Words and their numbers come from one pass over the texts and one partial
     aggregation. A run that is too short never leaves the scan.
  2. Asymmetric signatures. Of two words that are one edit apart, the shorter
     one, of length L, contributes two disjoint chunks, its first and its second
     L // 2 letters. The other contributes its positional grams of that length.
     One edit leaves a chunk whole, and moves it by at most one place, so the
     words share a chunk and a gram within shift one. Grams at places that no
     chunk can reach are not written. Words of equal length do both, and a pair
     is taken from the one that comes first.
  3. Join and verify. Chunks meet grams by text, place and length, and the edit
     distance of what meets is computed at once, so candidates are never
     written. Hashes of the two parts beside a chunk, of which one edit spares
     one, go along and save most of these computations. A pair that shares both chunks is taken by the first one only.
     The words of a chunk that more than LIST of them have are cut into pieces
     of about that size, and grams go to every piece, so that no task holds a
     crowded list alone.
  4. Each word keeps its most frequent near word if that is RATIO times as
     frequent. Following these forms multiplies the count each time, so chains
     are short, and pointer doubling ends after a few joins.

All of it is DataFrame functions. Letters are code points throughout; only A-Z
are lower-cased. Defined results: null texts have no words; a null id counts as
an empty one in the hash that deletes letters; rows that repeat an id count
each; a table without words gives an empty result; further columns are ignored.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, id_text

MIN_LETTERS = 7
MIN_COUNT = 2
RATIO = 10
#: Words of one chunk that a task compares with all its grams.
LIST = 2048
#: One in so many runs loses a letter.
NOISE = 31
#: A chain of forms has less than 20 links, as counts grow tenfold; doubling needs five rounds.
ROUNDS = 6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(word, n): the words of all texts, some with a letter deleted, and how often they occur."""
    run = F.expr(rf"regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{MIN_LETTERS},}}', 0)")
    runs = id_text(docs, id_col, text_col).select("doc_id", F.explode(run).alias("run"))
    runs = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % NOISE == 0, short).otherwise(F.col("run"))
    named = runs.withColumn("h", h).withColumn("at", at).select(word.alias("word"))
    counted = named.where(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def _signatures(size, shift):
    """Both chunks of words of length ``size``, as a word with ``shift`` letters more has them as grams.

    What is left of the word beside a chunk is cut in two as well: one edit spares one of its parts.
    """
    piece = lambda at, width: F.substring("word", at + 1, width)
    cut = lambda x: F.floor(x / 2).cast("int")
    half = cut(size)
    rest, begin = cut(size - half), cut(half)
    tail = size - half - rest
    row = lambda place, at, one, two: F.struct(
        size.alias("len"), place.alias("place"), piece(at, half).alias("chunk"),
        F.xxhash64(one).alias("one"), F.xxhash64(two).alias("two"))
    return [row(F.lit(0), F.lit(0), piece(half, rest), piece(size + shift - tail, tail)),
            row(half, half + shift, piece(F.lit(0), begin), piece(begin + shift, half - begin))]


def near_pairs(vocabulary: DataFrame, limit=LIST) -> DataFrame:
    """(a, na, b, nb): each two words that are one edit apart once, with their numbers."""
    size = F.length("word").cast("int")
    signed = lambda word, n, rows: vocabulary.select(
        F.col("word").alias(word), F.col("n").alias(n), F.explode(F.array(*rows)).alias("s")).select(word, n, "s.*")
    chunks = signed("a", "na", _signatures(size, 0))
    grams = signed("b", "nb", _signatures(size, 0) + _signatures(size - 1, 1))

    key = ["len", "place", "chunk"]
    crowded = chunks.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("pieces")).where("pieces > 1")
    pieces = F.coalesce("pieces", F.lit(1))
    chunks = chunks.join(crowded, key, "left").withColumn("piece", F.pmod(F.xxhash64("a"), pieces).cast("int"))
    grams = grams.join(crowded, key, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    grams = grams.drop("pieces").withColumnsRenamed({"one": "one_b", "two": "two_b"})
    met = chunks.drop("pieces").join(grams, [*key, "piece"])
    half = F.floor(F.col("len") / 2).cast("int")
    first = F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half)
    one_way = (F.length("b") > F.col("len")) | (F.col("a") < F.col("b"))
    spared = (F.col("one") == F.col("one_b")) | (F.col("two") == F.col("two_b"))
    return met.where(spared & one_way & ((F.col("place") == 0) | ~first)) \
        .where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words that have a form: where following forms ends."""
    roots = scratch.write(forms.select("word", F.col("form").alias("root")), "op11-roots")
    for _ in range(ROUNDS):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("on"))
        moved = scratch.write(roots.join(onward, "root", "left")
                              .select("word", F.coalesce("on", "root").alias("root"), "on"), "op11-roots")
        roots = moved.select("word", "root")
        if moved.where("on is not null").isEmpty():
            return roots
    raise RuntimeError("a chain of forms is longer than counts allow")


def spelling_groups(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the texts of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    vocabulary = scratch.write(words(docs, id_col, text_col), "op11-words")
    pairs = scratch.write(near_pairs(vocabulary), "op11-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("n"), F.col("b").alias("other")).alias("o")) \
        .unionByName(pairs.select(F.col("b").alias("word"),
                                  F.struct((-F.col("na")).alias("n"), F.col("a").alias("other")).alias("o")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("o").alias("best"))
    told = vocabulary.join(near, "word", "left")
    leads = -F.col("best.n") >= RATIO * F.col("n")
    told = scratch.write(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(leads, F.col("best.other")).alias("form"),
                                     F.when(leads, -F.col("best.n")).alias("form_n")), "op11-told")
    roots = _roots(told.where("form is not null"), scratch)
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"),
                                                   "n", "n_near", "form_n")


# ---- check SQL -----------------------------------------------------------

def _oracle():
    """What spelling_groups returns, as DuckDB states it: all words against all words."""
    latin = "".join(chr(c) for c in range(0xC0, 0x100))
    single = "".join(chr(c) for c in range(33, 127) if chr(c) not in _LOWER + "'")[:len(latin)]
    return rf"""
    WITH RECURSIVE crc AS (
        SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))),
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{MIN_LETTERS},}}')), '{_UPPER}', '{_LOWER}') AS run
             FROM documents),
    uniq AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY 1, 2),
    coded AS (SELECT run, k, flatten(list_transform(string_split(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run), ''),
                  lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS b FROM uniq),
    hashed AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b),
                  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM coded, crc),
    named AS (SELECT k, CASE WHEN h % {NOISE} = 0 THEN concat(left(run, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2))
                        ELSE run END AS word FROM hashed),
    w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n, translate(word, '{latin}', '{single}') AS code, length(word) AS l
          FROM named WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
    p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM w a JOIN w b ON abs(a.l - b.l) <= 1 AND a.word <> b.word
          WHERE levenshtein(a.code, b.code) = 1),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM p GROUP BY 1),
    told AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form,
                    CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
    chain(word, reached) AS (SELECT word, word FROM told
                        UNION ALL SELECT c.word, t.form FROM chain c JOIN told t ON t.word = c.reached WHERE t.form IS NOT NULL)
    SELECT t.word, t.form, c.reached AS root, t.n, t.n_near, t.form_n
    FROM told t JOIN chain c USING (word) JOIN told e ON e.word = c.reached WHERE e.form IS NULL"""


ORACLE_SQL = _oracle()
