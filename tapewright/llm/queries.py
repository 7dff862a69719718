"""The registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import bpe, decontamination, filter_audit, html_template, language_id, line_dedup, merkle, near_dup, quality, subword_lattice, token_counts, toxicity, url_graph
from tapewright.llm.common import bounded_batches, held_out, table

BPE_RANKS, PIECE_SCORES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
TOXIC_FROM = 0.3


def op1_toxic_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words, stems, reporting, weights = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    counted = docs.select("doc_id", held_out().alias("held_out"), toxicity.counts(F.col("text"), words, stems, reporting).alias("c"))
    scored = counted.withColumn("score", toxicity.score(F.col("c"), weights))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "c.*")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_RANKS)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"])
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op4_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it holds."""
    rows = decontamination.leak_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "lines_removed", "text")


def op7_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def three_edits(text: Column) -> Column:
    """12 characters cut at a quarter, a note put in at the half, 5 characters replaced at three quarters."""
    n = F.coalesce(F.length(text), F.lit(0))
    edit = lambda at, removed, added: F.struct(F.floor(n * at).cast("int").alias("at"), F.lit(removed).alias("removed"), F.lit(added).alias("added"))
    return F.array(edit(0.25, 12, ""), edit(0.5, 0, " [edited: see note 12]\n"), edit(0.75, 5, "it's"))


def op8_edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits: trees are built once, then edited."""
    path = public_tokenizers.path(BPE_RANKS)
    docs = table(spark, sf_dir, "documents")
    kept = docs.select("doc_id", "text", token_counts.trees(F.col("text"), path, public_tokenizers.PATTERN).alias("leaves"))
    counted = token_counts.edited(F.col("text"), F.col("leaves"), three_edits(F.col("text")), path, public_tokenizers.PATTERN)
    return kept.select("doc_id", counted.alias("c")).select("doc_id", "c.before", "c.after", "c.text_chars", "c.reencoded_chars")


def op9_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = docs.select("doc_id", quality.judge(F.col("text"), quality.references(docs)).alias("q"))
    return judged.select("doc_id", "q.*")


def op10_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(F.col("text"), language_id.learn_profiles(docs))
    return docs.select("doc_id", held_out().alias("held_out"), found.alias("f")).select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"))


def op11_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    vocabulary = subword_lattice.read_vocabulary(public_tokenizers.path(PIECE_SCORES))
    model = subword_lattice.learn(docs, remainder != 2, vocabulary)
    return subword_lattice.score(docs.withColumn("held_out", F.coalesce(remainder == 2, F.lit(False))), model, ["doc_id", "held_out"])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; of the ids whose crc32 is divisible by 5 the folded root is that of the text in lower case."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = table(spark, sf_dir, "documents").select("doc_id", "source", merkle.leaf(fields).alias("leaf"), F.when(tampered, merkle.leaf([*fields[:-1], lowered])).alias("tampered_leaf"))
    return merkle.manifest(leaves)


def op13_lattice_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def in_bounded_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: in_bounded_batches(f)
    for f in (
        op1_toxic_automata,
        op2_byte_bpe,
        op3_dart_minhash,
        op4_link_graph,
        op5_benchmark_leaks,
        op6_line_chunks,
        op7_template_text,
        op8_edited_counts,
        op9_quality_divergence,
        op10_rank_order_language,
        op11_subword_lattice,
        op12_merkle_manifest,
        op13_lattice_audit,
    )
}
#: What SQL can say; the others are tested against brute force and libraries (tests/llm).
ORACLES: dict[str, str] = {"op4_link_graph": url_graph.sql(URL_RULES), "op12_merkle_manifest": merkle.sql(), "op13_lattice_audit": filter_audit.sql()}
