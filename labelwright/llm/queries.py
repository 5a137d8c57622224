"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm import (
    alignment, cotrain, factors, html_crf, langid, line_dedup, minhash, packing, quality_rules, sql, toxicity, url_templates, whitening, winnow,
)
from labelwright.llm.common import crc_of


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def public_encoder():
    """The tokenizer of the packing query; the vocabulary's place comes from its package."""
    import public_tokenizers

    return packing.byte_bpe(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents with their place; see ``packing.pack``."""
    return packing.pack(table(spark, folder, "documents"), public_encoder).select(
        F.col("doc").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        F.col("sequence").alias("sequence_id"), "offset")


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict for every text; see ``quality_rules``."""
    return quality_rules.judged(table(spark, folder, "documents").select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


TOXIC_FROM = 0.7


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every text, learned outside the held-out third; see ``toxicity``."""
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    learn = crc_of("doc_id") % 3 != 1
    model = toxicity.train(docs.where(learn), labels.where(learn))
    score = F.col("score")
    return toxicity.scored(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), (crc_of("row.doc_id") % 3 == 1).alias("held_out"), score,
        (score >= TOXIC_FROM).cast("int").alias("predicted"))


def op5_quality_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document from both views; see ``cotrain``."""
    docs = table(spark, folder, "documents")
    return cotrain.scored(docs, table(spark, folder, "labels")).select(
        F.col("row.doc_id").alias("doc_id"), "score", (F.col("score") >= cotrain.KEEP_FROM).alias("kept"))


URL_RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
]


def op6_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every url of ``pages``; see ``url_templates``."""
    return url_templates.judged(table(spark, folder, "pages").select("page_id", "url"), URL_RULES).select(
        F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learned outside the held-out quarter; see ``langid``."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(crc_of("doc_id") % 4 != 2))
    return langid.identified(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), (crc_of("row.doc_id") % 4 == 2).alias("held_out"),
        F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op9_html_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page; see ``html_crf``."""
    pages = table(spark, folder, "pages")
    return html_crf.extracted(pages, html_crf.train(pages)).select(
        F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text",
        F.char_length("text").cast("long").alias("n_chars"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines before and after, and the digest of the kept text; see ``line_dedup``."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, counts=True).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of near copies on four-word shingles; see ``minhash``."""
    groups = minhash.near_duplicates(table(spark, folder, "documents"), words=4)
    return groups.select(
        F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"),
        F.col("doc").eqNullSafe(F.col("component")).alias("kept"))


def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document inside benchmark windows; see ``winnow``."""
    found = winnow.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        winnow.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op11_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words before and removed, and the digest of the kept words; see ``factors``."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return factors.without_repeats(docs, counts=True).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def public_readers():
    """The two tokenizers of the alignment query."""
    import public_tokenizers

    return (
        alignment.byte_level_reader(
            public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        alignment.piece_reader(public_tokenizers.path("piece_bpe_32k.model")))


def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers over every text; see ``alignment``."""
    return alignment.alignment(table(spark, folder, "documents"), public_readers).withColumnRenamed("doc", "doc_id")


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable vector's first sixteen whitened components; see ``whitening``."""
    vectors = table(spark, folder, "embeddings")
    model = whitening.train(vectors)
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    rows = whitening.whitened(vectors, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.element_at(explained.cast("array<double>"), F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_quality_rules, op3_toxicity, op4_line_dedup, op5_quality_cotraining, op6_url_templates,
        op7_minhash_near_dedup, op8_language_id, op9_html_crf, op10_benchmark_decontamination, op11_substring_dedup, op12_tokenizer_alignment,
        op13_embedding_whitening)
}

# Models, groups and packings are not SQL's; their queries are tested against plain Python.
ORACLE = {
    "op2_quality_rules": sql.OP2, "op4_line_dedup": sql.OP4, "op10_benchmark_decontamination": sql.OP10,
}
