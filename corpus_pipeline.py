"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source weights, pieces.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on:
the columns of ``documents``, but for the last stage, which adds piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import mixing, pieces, quality, setjoin, suffix_dedup
from keystrata.llm.queries import tokenizer_file
from keystrata.llm.util import stored, table

PIECES = "piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or the robust distance reject go."""
    return quality.passed(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by five-word shingles at a similarity of 0.75 or more, the one with the smallest id stays."""
    return setjoin.one_of_each(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than fifty words that are found elsewhere are cut out; every document stays."""
    return suffix_dedup.deduplicated(spark, docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the sources' target weights."""
    return mixing.mixed(spark, docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text's pieces, their number, and whether they decode to the text exactly."""
    back = pieces.round_trip(docs, tokenizer_file(PIECES))
    exact = F.col("text").eqNullSafe(F.col("decoded"))
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), exact.alias("exact"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("source weights", source_weights),
    ("piece ids", piece_ids),
]

#: SQL can't express the robust estimates and the piece search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
