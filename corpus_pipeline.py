"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. Rows may have null ids, texts and languages; a null or wordless text is rejected by the first stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import bpe, decontamination, language_id, line_dedup, near_dup
from tapewright.llm.common import bounded_batches, delete, shared_folder, table, written_paths
from tapewright.llm.queries import BPE_RANKS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in a known language and puts it into lang. Those without a letter (und) go."""
    found = language_id.identify(F.col("text"), language_id.learn_profiles(docs))
    names = docs.columns
    kept = docs.withColumn("_found", found).where(F.col("_found.lang") != language_id.UNKNOWN)
    return kept.withColumn("lang", F.col("_found.lang")).select(*names)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated multi-line chunks out of the texts. A document of which nothing is left goes."""
    names = docs.columns
    cleaned = line_dedup.dedup_lines(docs)
    left = cleaned.where(~((F.col("lines_removed") > 0) & ~F.col("text").rlike(r"\S"))).withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*names)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the least id."""
    return near_dup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, and whether they decode to the text's bytes."""
    path = public_tokenizers.path(BPE_RANKS)
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256")
    keep = ["doc_id", "lang", "source", "text_sha256"]
    encoded = bpe.encode(docs.select(*keep[:-1], digest, "text"), path, public_tokenizers.PATTERN, keep)
    same = F.sha2(bpe.decode(F.col("ids"), path), 256) == F.col("text_sha256")
    checked = encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "packed", same.alias("round_trip"))
    return checked.withColumnRenamed("packed", "ids")


#: Tables that the stage called last has written for itself.
_of_last_stage: list[str] = []


def in_bounded_batches(stage: Stage) -> Stage:
    """The stage with small Arrow batches. A stage's output is written before the next one is called, so the tables that it wrote for itself go then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        delete(spark, _of_last_stage)
        _of_last_stage.clear()
        before = len(written_paths)
        out = stage(spark, docs, sf_dir)
        _of_last_stage.extend(written_paths[before:])
        del written_paths[before:]
        return out

    return run_stage


STAGES = [
    ("language_id", in_bounded_batches(identify_language)),
    ("line_dedup", in_bounded_batches(dedup_lines)),
    ("near_dedup", in_bounded_batches(dedup_near)),
    ("decontamination", in_bounded_batches(decontaminate)),
    ("byte_bpe", in_bounded_batches(encode_tokens)),
]

#: SQL has no banded signatures, rank-order profiles or merges, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from its written table; all other tables that the stages wrote are deleted."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    done = []
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}_{name}")
        docs = spark.read.parquet(f"{folder}/{i}_{name}")
        done.append(f"{folder}/{i}_{name}")
    delete(spark, done[:-1] + _of_last_stage)
    _of_last_stage.clear()
    return docs
