"""A corpus pipeline of five stages: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, and every stage keeps
further columns that the documents have. No documents give no rows.

The third stage takes operator 7's SimHash over five words, with an exact check. Its distance can't reach all of the stage's
pairs: texts of similarity 0.8 differ in some 10 of 64 bits, and segments short enough for one wildcard would then be
shared by unlike texts. What lies beyond is found with MinHash bands; the README has the figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import discard, hidden, materialize, materialize_alone, shown
from assayer.llm.line_dedup import dedup_lines
from assayer.llm.mixing import mix_documents
from assayer.llm.near_copies import near_copies
from assayer.llm.packing import pack, token_pieces
from assayer.llm.quality import fit, quality_scores

#: Documents scored under this are rejected.
LEAST_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels of these documents.

    Rows of a repeated or null id are scored one by one; null text counts as empty. Without labels all stay.
    """
    weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_scores(docs.select(*hidden(docs, "text")), weights)
    return scored.filter(F.col("score") >= LEAST_SCORE).select(*shown(docs, "text"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller doc_id holds; none is dropped, ``n_chars`` follows the text."""
    used = ("doc_id", "text", "n_chars")
    kept = dedup_lines(docs.select(*hidden(docs, *used)))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*shown(docs, *used))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash and MinHash of five words, similarity 0.8): that of smallest doc_id, null ids last, and the first of its rows."""
    used = ("doc_id", "text")
    keyed = materialize(docs.select(*hidden(docs, *used), F.monotonically_increasing_id().alias("__key")), "keyed", spread=True)
    rows = keyed.select(F.col("__key").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = near_copies(rows).groupBy("component").agg(F.min_by("key", order).alias("__key"))
    return keyed.join(first, "__key", "left_semi").select(*shown(docs, *used))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that the sources' words come to their targets; each row has copies of its own."""
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 1024 tokens.

    A document is a row: copies, rows of null or repeated ids and null texts (the end id alone) have places of their own.
    """
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: Neither the classifier nor the near copies can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize_alone(lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
