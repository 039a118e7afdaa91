"""The queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, oracles, pieces, quality, setjoin, suffix_dedup, token_files, urltree, warc, winnow
from .util import table

URL_RULES = [
    urltree.Rule("block", "com", "/en/"),
    urltree.Rule("allow", "example.com", "/en/7"),
    urltree.Rule("allow", "net", "/de/"),
    urltree.Rule("block", "example.net", "/de/8"),
    urltree.Rule("block", "org", "/es/"),
]



def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.with_verdicts(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(spark, table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str, file: str | None = None) -> DataFrame:
    return token_files.round_trip(spark, table(spark, sf_dir, "documents"), file or tokenizer_file("byte_bpe_50k.json"), end_id=2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(spark, table(spark, sf_dir, "documents"))


def op5_pieces(spark: SparkSession, sf_dir: str, file: str | None = None) -> DataFrame:
    """Per document: its pieces, and whether decoding gives the text back."""
    back = pieces.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), file or tokenizer_file("piece_bpe_32k.model"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.col("text").eqNullSafe(F.col("decoded")).alias("exact"), "ids")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.joined(spark, table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judged(spark, table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    out = langid.predicted(spark, docs, docs.where(~held).select("doc_id", "text", "lang"))
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: robust estimates, hashes, vocabularies, a trained network."""
    return {
        "op4_suffix_dedup": oracles.suffix_dedup(),
        "op6_jaccard_join": oracles.jaccard_join(),
        "op7_mixing": oracles.mix(),
        "op8_url_tree": oracles.url_tree(URL_RULES),
        "op9_warc": oracles.warc(),
    }
