"""The operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.llm import codec, langid, near, packing, quality, search, secrets, tokencount, urls, windows
from graphfold.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; what is learned comes from documents that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(~langid.held_out()), vocabulary("piece_bpe_32k.model"))
    marked = documents.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.identify(marked, model, carry=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the pieces and scores of a public vocabulary."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other vectors for each vector whose id is divisible by 50."""
    vectors = search.whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


#: The rules that come before the reputation.
URL_RULES = (urls.Rule("net", "/", "block"), urls.Rule("example.net", "/en/", "allow"), urls.Rule("example.com", "/de/", "block"), urls.Rule("org", "/fr/", "allow"))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged; a page's label is that of the document of its number."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))).alias("bad"))
    return urls.judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed id matrices."""
    import public_tokenizers

    return packing.pack_sequences(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50256)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = quality.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 4096 ids at most."""
    return windows.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), table_bytes=150_000_000)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return codec.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_token_counts, op3_pivot_search, op4_url_reputation, op5_packed_sequences, op6_quality_rules, op7_packed_windows, op8_near_duplicates, op9_secret_scan, op10_bpe_round_trip)
}
