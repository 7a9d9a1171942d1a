"""Line dedup over all documents: lines that many documents share stay in one of them.

Each text is split at line feeds and exploded into lines; a line's key is the line
without white space at its ends, ASCII letters in lower case. Keys of enough
characters are hashed to 128 bits, distinct documents are counted per hash, and a
hash found in enough documents loses its lines everywhere but in the largest doc_id
that holds it. Documents are reassembled from the positions that are left.

A hash may hold a third of all lines. Counting combines within tasks, first per
(hash, document), then per hash. In the join back to the lines, hashes in at least
one of ``HOT_SHARE`` line rows are at most ``HOT_SHARE`` many and are broadcast; the
rest are joined by a shuffle in which no key holds more than that share.

* Null text counts as empty: one empty line, which stays, since its key is short.
* Documents are told apart by doc_id: rows that share one are one document in the
  counts, and all of them keep a line whose largest doc_id is theirs. Rows without
  doc_id count as one document that comes before all others.
* Repeated rows are all returned. Very long texts are split, filtered and joined in
  time linear in their lines. An empty table gives no rows.
* Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm.common import read, written

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
#: A hash with this fraction (one in so many) of all line rows is joined by broadcast: at most so many are.
HOT_SHARE = 10_000
WHITE = " \t\n\x0b\x0c\r"
HASH = ("hash_a", "hash_b")
ROW = ("doc_id", "text_key")


def lines_of(text: Column) -> Column:
    """The text's lines; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case (other letters as they are)."""
    bare = F.btrim(line, F.lit(WHITE))
    # Lower-casing whole strings is the quick form where all characters are ASCII.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def text_key() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_hashes(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_key, position and 128-bit hash of every line whose key is long enough."""
    each = docs.select("doc_id", text_key().alias("text_key"),
                       F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keyed = each.select("doc_id", "text_key", "at", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= least_chars).select(
        "doc_id", "text_key", "at", F.xxhash64("key").alias("hash_a"), F.xxhash64(F.lit(1), "key").alias("hash_b"))


def shared_hashes(lines: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Hashes in enough documents: n_documents, n_lines and ``keeper``, the largest doc_id that holds the hash."""
    per_document = lines.groupBy(*HASH, "doc_id").agg(F.count("*").alias("n"))
    return per_document.groupBy(*HASH).agg(
        F.count("*").alias("n_documents"), F.sum("n").alias("n_lines"), F.max("doc_id").alias("keeper")).where(
        F.col("n_documents") >= least_documents)


def lost_lines(lines: DataFrame, shared: DataFrame, n_lines: int) -> DataFrame:
    """doc_id, text_key and position of the lines that go. ``lines`` and ``shared`` are stored tables."""
    hot = F.col("n_lines") * HOT_SHARE >= n_lines
    same = [F.col(f"l.{h}") == F.col(f"s.{h}") for h in HASH]
    elsewhere = ~F.col("l.doc_id").eqNullSafe(F.col("s.keeper"))
    few, many = F.broadcast(shared.where(hot)).alias("s"), shared.where(~hot).alias("s")
    by_broadcast = lines.alias("l").join(few, [*same, elsewhere], "left_semi")
    others = lines.join(F.broadcast(shared.where(hot).select(*HASH)), list(HASH), "left_anti").alias("l")
    by_shuffle = others.join(many.hint("shuffle_merge"), [*same, elsewhere], "left_semi")
    return by_broadcast.unionByName(by_shuffle).select(*ROW, "at")


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept_text of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    lines = written(line_hashes(docs, least_chars), "lines")
    shared = written(shared_hashes(lines, least_documents), "shared")
    gone = lost_lines(lines, shared, lines.count()).groupBy(*ROW).agg(F.collect_set("at").alias("gone")).alias("g")
    keyed = docs.withColumn("text_key", text_key()).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_key") == F.col("g.text_key"))
    joined = keyed.join(gone, same, "left").select("d.doc_id", "d.text", "g.gone")
    lines_now, none = lines_of(F.col("text")), F.expr("cast(array() as array<int>)")
    left = F.array_except(F.sequence(F.lit(0), F.size("line") - 1), F.coalesce("gone", none))
    rebuilt = F.array_join(F.transform(F.col("left"), lambda i: F.get("line", i)), "\n")
    return joined.withColumn("line", lines_now).withColumn("left", left).select(
        "doc_id", F.size("line").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(rebuilt).alias("kept_text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB SQL, with keys in place of hashes.
OP11_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () rid, doc_id, coalesce(doc_id::VARCHAR, 'none') doc, coalesce(text, '') t FROM documents
), l AS (
  SELECT rid, doc_id, doc, unnest(range(1, len(ls) + 1)) i, unnest(ls) line
  FROM (SELECT rid, doc_id, doc, string_split(t, chr(10)) ls FROM d)
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
    '{string.ascii_uppercase}', '{string.ascii_lowercase}') key FROM l
), s AS (
  SELECT key, max(doc_id) keeper FROM k WHERE length(key) >= {LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT doc) >= {LEAST_DOCUMENTS}
), j AS (
  SELECT rid, k.doc_id, i, line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM keeper gone
  FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*) n_lines, count(*) FILTER (WHERE gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) kept_sha256
FROM j GROUP BY rid, doc_id
"""
