"""The corpus pipeline: toxicity, line dedup, near-dedup, source mixing and byte-level BPE, one stage after another.

Every stage takes the documents that its predecessor kept, as written and read again, and all but the last return the
columns of its input. Columns beside doc_id, text, source and n_chars pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from palimpsest.scratch import drop_stash, stash


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Set n_chars, where there is such a column, to the length of the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; the model learns from those of them that labels names."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="_toxicity").filter(F.col("_toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites, but for each one's first occurrence."""
    return _with_length(line_dedup.line_dedup(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates; rows that share an id stay together, and rows
    without one are told apart by their texts."""
    keyed = docs.withColumn("_key", near_dedup.row_key())
    kept = near_dedup.near_duplicates(keyed, id_col="_key").filter("kept").select(F.col("_key").alias("_kept")).distinct()
    return keyed.join(kept.hint("shuffle_hash"), F.col("_key") == F.col("_kept"), "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a document taken in part keeps its first words, one taken more than once has its text followed
    by the words taken again, one not taken goes. Rows that agree in id and size are taken alike."""
    size = mixing.n_words(F.col("text"))
    plan = mixing.mix(docs).filter("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size")).agg(F.max("taken").alias("_taken"))
    out = docs.withColumn("_words", size).join(plan.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size")))
    part = lambda n: F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({mixing.WORD})"), 1), F.lit(1), n.cast("int")), " ")
    again = F.col("_taken") - F.col("_words")
    text = F.when(again == 0, F.col("text")).when(again < 0, part(F.col("_taken"))).when(again == F.col("_words"), F.concat_ws("\n", "text", "text")).otherwise(F.concat_ws("\n", "text", part(again)))
    return _with_length(out.withColumn("text", text), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every document. Chunks are smaller than by default, as the ids take memory."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), chunk_chars=3_000_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near-dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]
#: The classifier, the mix's hashes and the merges can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = stash(stage(spark, docs, sf_dir), f"stage{k}")
        drop_stash(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
