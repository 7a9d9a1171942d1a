"""The training-corpus pipeline: five stages over ``documents``, each on what the one before kept.

Quality rules drop failing documents, near-duplicate classes keep one document
each, secrets are cut out of the texts, documents are drawn to the target mix, and
the rest is encoded. A stage takes (spark, docs, sf_dir); all but the last return
the columns of ``documents``.

Every stage takes nulls in any column, empty tables and repeated rows; columns
beside those of ``documents`` are dropped at its start, so their names cannot clash.
Decisions are per (doc_id, text), so rows that share a doc_id by mistake are judged
apart; equal rows are one document and leave the near-duplicate stage once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm import mixing, near, pieces, rules, secrets
from updraft.llm.common import read, shared_folder, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Decisions up to this many rows (about 20 MB) are broadcast to the texts; more go by a shuffle.
BROADCAST_ROWS = 300_000
#: Most spans that are broadcast with them.
BROADCAST_SPANS = 1_000_000


def text_key() -> Column:
    """A number for the text; null and empty are alike."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _by_decision(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of documents with a stored table of (doc_id, text_key)."""
    few = decided.count() <= BROADCAST_ROWS
    d = docs.withColumn("text_key", text_key()).alias("d")
    k = (F.broadcast(decided) if few else decided).alias("k")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_key") == F.col("k.text_key"))
    return d.join(k, same, how).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes."""
    docs = docs.select(*COLUMNS)
    judged = rules.judge_documents(docs, key=text_key())
    rejected = written(judged.where("not kept").select("doc_id", F.col("key").alias("text_key")).distinct(), "rejected")
    return _by_decision(docs, rejected, "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that with the smallest doc_id."""
    docs = docs.select(*COLUMNS)
    classes = written(near.classify(docs, key=text_key()), "classes")
    # A row of a class is one of several if the rows of its doc_id are copies, too.
    kept = classes.where("kept").groupBy("doc_id", "class", "component_id").agg(
        F.min("key").alias("text_key"), F.count("*").alias("n"))
    several = written(kept.where("n > 1 and doc_id is not null and class is not null"), "several")
    dropped = written(classes.where("not kept").select("doc_id", F.col("key").alias("text_key")).unionByName(
        classes.where("kept").join(several.select("doc_id", "class"), ["doc_id", "class"], "left_semi").select(
            "doc_id", F.col("key").alias("text_key"))).distinct(), "dropped")
    once = _by_decision(docs, several.select("doc_id", "text_key").distinct(), "left_semi")
    return _by_decision(docs, dropped, "left_anti").unionByName(
        once.withColumn("text_key", text_key()).dropDuplicates(["doc_id", "text_key"]).drop("text_key"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows the new text."""
    docs = docs.select(*COLUMNS)
    _, _, findings = secrets.scan_history(secrets.history_of(docs))
    spans = written(secrets.spans_by_blob(findings), "spans")
    size = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    few = size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_SPANS
    addressed = docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = addressed.join(F.broadcast(spans) if few else spans, "blob", "left")
    return found.select(
        "doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(
            secrets.redacted(F.col("text"), F.col("spans"))).alias("text"), "lang", "source",
        "n_chars", "spans").withColumn(
        "n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities of the raked mix."""
    docs = docs.select(*COLUMNS)
    cells = mixing.calibrated(mixing.features(docs))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.struct(*COLUMNS).alias("row"), mixing.level("source").alias("source"),
                       mixing.level("lang").alias("lang"), mixing.topic_of(text).alias("topic"))
    return mixing.draw(rows, cells).where("kept").select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids with the end id, and the decoded text's SHA-256."""
    import public_tokenizers

    encoded = pieces.encode_documents(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mixing_weights),
    ("sentencepiece", sentencepiece),
]
#: Near-duplicate classes, raking and byte-pair merges are not expressible in SQL at a fair length.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
