"""Cleaning pipeline over `documents`: toxicity, near duplicates, benchmark passages, secrets, pieces.

Each stage takes what its predecessor kept, and its decisions take effect; all but the last return the columns of
documents. Stages are written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriskill.llm import decontaminate, ngram_join, pieces, secrets, toxicity
from veriskill.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar rejects go. It is learned from the labelled rows among `docs`."""
    grammar = toxicity.fit_grammar(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, grammar).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five-word shingles, similarity 0.8) the row with the least doc_id stays.

    Rows are told apart by a key of their own, so that a doc_id may be null or repeated: null ids come last, the key
    decides among equal ones. Rows without words are linked with none and stay.
    """
    keyed = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), "keyed")  # written: keys stay as they are
    joined = ngram_join.jaccard_join(keyed, number=5, least=80, doc_id="row_key").select(F.col("doc_id").alias("row_key"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = joined.join(keyed.select("row_key", "doc_id"), "row_key").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row_key")
    return keyed.join(first, "row_key", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark phrases cover a twentieth or more of the words go."""
    matched = decontaminate.match_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(matched).where(~F.col("contaminated")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are masked in the text; every document stays."""
    scanned = secrets.scan_secrets(docs, secrets.default_model(spark))
    return scanned.withColumn("text", F.col("redacted")).withColumn("n_chars", F.when(F.size("secrets") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, checked by decoding."""
    return pieces.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("decontamination", drop_contaminated), ("secret_scan", mask_secrets), ("pieces", encode)]

#: SQL can express neither the learned grammar nor the forest; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
