"""One query per operator, each over its whole table with production parameters."""

from . import bpe, decontaminate, exact, htmltext, jaccard, merkle, pii, quality, records, spelling, toxicity, vectors, warc
from .common import table
from .registry import ORACLES, QUERIES, query  # noqa: F401


@query("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    return jaccard.ngram_components(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_byte_bpe")
def op3(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


@query("op4_decontamination")
def op4(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_pii")
def op5(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


@query("op6_token_records")
def op6(spark, sf_dir):
    return records.read_back(records.write(table(spark, sf_dir, "documents")))


@query("op7_warc")
def op7(spark, sf_dir):
    return warc.read_back(warc.write(table(spark, sf_dir, "pages"))).drop("url")


@query("op8_html_text")
def op8(spark, sf_dir):
    return htmltext.main_text(table(spark, sf_dir, "pages"))


@query("op9_quality")
def op9(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_vector_near_copies")
def op10(spark, sf_dir):
    return vectors.near_copies(table(spark, sf_dir, "embeddings"))


@query("op11_spelling_groups", spelling.ORACLE_SQL)
def op11(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@query("op12_exact_groups", exact.ORACLE_SQL)
def op12(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query("op13_merkle_manifest", merkle.ORACLE_SQL)
def op13(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))
