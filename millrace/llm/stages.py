"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what stays, in the columns of documents (the last: sequences)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name
from .queries import _table, _vocabulary


def _beside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with its columns of these names (in any case) put into one of another name, and all its columns from what an operator makes of it."""
    clash = [c for c in docs.columns if c.lower() in names]
    if not clash:
        return docs, [F.col(f"`{c}`") for c in docs.columns]
    aside = free_name(docs, "set_aside")
    hidden = docs.withColumn(aside, F.struct(*[F.col(f"`{c}`") for c in clash])).drop(*clash)
    return hidden, [F.col(aside)[c].alias(c) if c in clash else F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, trained on `labels`, rejects."""
    from .cotrain import score_quality

    docs, columns = _beside(docs, "p_text", "p_meta", "p_quality", "keep")
    return score_quality(docs, _table(spark, sf_dir, "labels")).where("keep").select(columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With later repeated runs of lines deleted; documents of which nothing is left go."""
    from .lines import line_dedup

    docs, columns = _beside(docs, "n_lines", "n_removed")
    return line_dedup(docs).where("n_removed = 0 or n_removed < n_lines").withColumn("n_chars", F.length("text").cast("long")).select(columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Each row has its own text's decision, also where ids are null or shared (see near_duplicates): a row with a null id goes
    only if its set of shingles is that of a row with an id, and rows with equal id and text stay or go together.
    """
    from .minhash import near_duplicates

    own_id, own_key = free_name(docs, "kept_id"), free_name(docs, "kept_key")
    kept = near_duplicates(docs.select("doc_id", "text"), text_key="text_key").where("kept").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key))
    return docs.join(kept, same, "left_semi").select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With repeated windows of 20 words deleted; a text that loses nothing stays as it is, documents of which nothing is left go."""
    from .substrings import substring_dedup

    docs, columns = _beside(docs, "n_words", "n_removed", "removed_spans")
    out = substring_dedup(docs, tidy=False).where("n_removed = 0 or n_removed < n_words")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, a row for each piece of a document."""
    from .packing import pack

    return pack(docs, _vocabulary("word_bpe_49k.json"))
