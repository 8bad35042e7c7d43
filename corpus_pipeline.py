"""A training corpus from documents: quality, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns
of documents; the last returns the pieces of packed sequences. Columns beyond the documents' own stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphfold.llm import langid, near, quality, secrets, windows
from graphfold.plans.lineage import cut as written
from graphfold.llm.queries import table, vocabulary

#: A document stays if its language has at least this posterior.
LANGUAGE_SCORE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the adaptive thresholds let pass."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language can be told; what is learned comes from those that aren't held out."""
    model = langid.fit(docs.where(~langid.held_out()), vocabulary("piece_bpe_32k.model"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("gf_row"), "doc_id", "text")
    told = langid.identify(whole, model, carry=("gf_row",))
    return told.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LANGUAGE_SCORE)).select("gf_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest id."""
    return near.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    return secrets.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids, the ids with them."""
    return windows.pack_documents(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality rules", quality_rules), ("language id", language_id), ("near dedup", near_dedup), ("secret scan", secret_scan), ("packing", packing)]

#: Tokenisation is beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
