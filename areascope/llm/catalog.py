"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, jaccard_join, language, mixing, neighbour_quality, quality_rules, suffix_dedup
from . import byte_bpe, prefix_trie, token_alignment, toxicity, url_rules
from .common import held_out, table
from .oracle import ORACLE

__all__ = ["QUERIES", "ORACLE"]

#: Rules of op9: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """doc_id, text, label of the labelled documents that may be learnt from."""
    labels = (table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col(label).alias("label"))
              .filter(F.col("label").isNotNull()).dropDuplicates(["id"]))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    return docs.join(labels, F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, p_severe, p_varied, p_toxic, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return toxicity.score(docs, toxicity.fit(_labelled(spark, sf_dir, "toxic")), ["doc_id", "held_out"])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document that stay when repeated 400-byte strings go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup(docs, ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document by its nearest labelled neighbours."""
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return neighbour_quality.quality(docs, _labelled(spark, sf_dir, "quality"), ["doc_id", "held_out"])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under links of Jaccard similarity 0.75 or more."""
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and line verdicts of each document."""
    return quality_rules.judge_lines(table(spark, sf_dir, "documents"), ["doc_id"]).drop("clean_text")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in each document."""
    out = decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by its nearest centroid."""
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "lang")
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.identify(docs, model, ["doc_id", "held_out"])


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of each page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules, ["page_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix at the target weights takes from each document."""
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.word_size()).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by the public byte-level ranks, and the text that they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"], ranks, public_tokenizers.PATTERN)
    told = ids.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return byte_bpe.decode(told, ["doc_id", "n_tokens", "ids_sha256"], ranks).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens that a byte-level and a piece tokenizer make of each document."""
    import public_tokenizers

    aligned = token_alignment.align(table(spark, sf_dir, "documents"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"),
                                    public_tokenizers.path("piece_bpe_32k.model"), pattern=public_tokenizers.PATTERN)
    told = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    scored = token_alignment.score_links(aligned.withColumn("groups_sha256", told).drop("groups"))
    return scored.select("kept.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_suffix_dedup, op3_quality, op4_jaccard_join, op5_quality_rules, op6_decontaminate, op7_language,
    op8_html_text, op9_url_rules, op10_mixing, op11_byte_bpe, op12_token_alignment, op13_prefix_trie)}

