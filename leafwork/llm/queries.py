"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, html_extract, language_id, license_scan, ngram_join, pii, quality_cascade, spelling_variants, url_filter, vector_codes, vector_graph

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract_text(pages, html_extract.fit(pages))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table labels isn't read: its labels are of documents, not of pages.
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "fired")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.where(~language_id.held_out()))
    told = language_id.predict(docs.select("doc_id", "text"), profiles)
    return told.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_graph.search(vectors, vectors.where("vec_id % 50 = 0"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.sql(r"SELECT -7L AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select(*odd.columns).unionByName(odd)
    return chat_format.digest(chat_format.windows(turns))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(vector_codes.compress(table(spark, sf_dir, "embeddings")))


def op12_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade.digest(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.group(spelling_variants.vocabulary(table(spark, sf_dir, "documents"), slip=spelling_variants.SLIP))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_html_extract, op3_decontaminate, op4_license_scan, op5_url_filter, op6_byte_bpe, op7_language_id, op8_pii, op9_vector_graph, op10_chat_format, op11_vector_codes, op12_quality_cascade, op13_spelling_variants)}
ORACLE: dict[str, str] = {"op1_ngram_join": ngram_join.ORACLE, "op3_decontaminate": decontaminate.ORACLE, "op4_license_scan": license_scan.oracle(), "op10_chat_format": chat_format.ORACLE} | {
    "op11_vector_codes": vector_codes.ORACLE, "op12_quality_cascade": quality_cascade.ORACLE, "op13_spelling_variants": spelling_variants.ORACLE
}
