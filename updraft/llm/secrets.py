"""Secret scans over every version of every path, each content scanned once per rule version.

A version's content is addressed by its SHA-256 (the blob). The ledger holds the
(blob, rule, rule version) triples that have been scanned; a run scans only the
triples it lacks, on one text per blob, and findings are joined back to all paths
and versions that hold the blob. Columns and SQL functions only.

* Null text counts as empty; an empty text has no findings.
* Repeated rows and equal texts share a blob, are scanned once and all reported.
* Null paths are kept; columns beside the named ones are not read.
* Positions are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from updraft.llm.common import read, written

SALTS = 32


@dataclass(frozen=True)
class Rule:
    """A pattern, matched from the left without overlaps; matches whose group is too short are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: In the order in which kinds are listed. A changed pattern needs a new version.
RULES = (
    Rule("assign", 1,
         r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
         r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    # Runs are maximal, so a longer run cannot hide in a shorter one: the length goes into the pattern.
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
LEDGER = "blob string, rule string, rule_version int"
FINDINGS = "blob string, kind string, rule_version int, kind_order int, start long, end long"


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table of the schema."""
    parts = [p.split() for p in schema.split(", ")]
    return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in parts])


def addressed(history: DataFrame) -> DataFrame:
    """path, version and blob of every row."""
    return history.select("path", "version", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))


def unseen_pairs(blobs: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """blob, path, version of one holder, and the rules under which it has not been scanned."""
    holders = blobs.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("holder"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    pairs = holders.select("blob", "holder", F.inline(wanted))
    fresh = pairs.join(ledger, ["blob", "rule", "rule_version"], "left_anti")
    return fresh.groupBy("blob", "holder").agg(F.collect_set("rule").alias("rules")).select(
        "blob", "holder.path", "holder.version", "rules")


def scan(texts: DataFrame, rules=RULES) -> DataFrame:
    """Findings of (blob, text, rules): per match the text before it and its own length, summed along the text."""
    def hits(r: Rule) -> Column:
        text, pattern = F.col("text"), F.lit(r.pattern)
        gaps = F.transform(F.split(text, r.pattern, -1), F.length)
        whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
        held = F.transform(F.regexp_extract_all(text, pattern, F.lit(r.group)), F.length) if r.group else whole
        # The last gap follows the last match and pairs with none.
        found = F.when(F.array_contains("rules", r.kind) & text.rlike(r.pattern),
                       F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"),
                                    held.alias("held")))
        return F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"),
                        F.lit(rules.index(r)).alias("kind_order"), F.lit(r.least).alias("least"), found.alias("found"))

    each = texts.select("blob", F.explode(F.array(*[hits(r) for r in rules])).alias("k")).where("k.found is not null")
    rows = each.select("blob", "k.kind", "k.rule_version", "k.kind_order", "k.least", F.posexplode("k.found").alias(
        "at", "m")).select("blob", "kind", "rule_version", "kind_order", "least", "at", "m.*")
    before = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.col("whole")).over(before)
    return rows.dropDuplicates(["blob", "kind", "at"]).withColumn("end", end).where("held >= least").select(
        "blob", "kind", "rule_version", "kind_order", (F.col("end") - F.col("whole")).alias("start"), "end")


def scan_history(history: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None,
                 rules=RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One increment over ``history`` (path, version, text).

    Returns the blob of every path and version, the extended ledger and the
    extended findings. Texts are moved only for blobs with something to scan.
    """
    spark = history.sparkSession
    ledger = nothing(spark, LEDGER) if ledger is None else ledger
    findings = nothing(spark, FINDINGS) if findings is None else findings
    blobs = written(addressed(history), "blobs")
    fresh = written(unseen_pairs(blobs, ledger, rules), "unseen")
    # The address is part of the key: paths may be null, and a repeated path and version may hold another text.
    text = F.coalesce("text", F.lit(""))
    h = history.select("path", "version", text.alias("text"), F.sha2(text, 256).alias("blob")).alias("h")
    u = fresh.alias("u")
    texts = h.join(u, (F.col("h.blob") == F.col("u.blob")) & F.col("h.path").eqNullSafe(F.col("u.path"))
                   & F.col("h.version").eqNullSafe(F.col("u.version"))).select("u.blob", "rules", "text")
    found = written(scan(texts, rules), "findings")
    versions = {r.kind: r.version for r in rules}
    current = F.create_map(*[F.lit(x) for kv in versions.items() for x in kv])
    done = fresh.select("blob", F.explode("rules").alias("rule")).select(
        "blob", "rule", current[F.col("rule")].alias("rule_version"))
    return blobs, ledger.unionByName(done), findings.unionByName(found)


def spans_by_blob(findings: DataFrame, rules=RULES) -> DataFrame:
    """blob and its spans in order, under the current rule versions."""
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("kind") == r.kind) & (F.col("rule_version") == r.version))
    span = F.struct("start", "kind_order", "end", "kind")
    return findings.where(now).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def by_path(blobs: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """Every path and version with the spans of its blob.

    A blob with very many copies is spread over ``SALTS`` join keys.
    """
    copies = spans_by_blob(findings, rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = blobs.withColumn("salt", F.pmod(F.xxhash64("path", "version"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["blob", "salt"], "left").drop("salt")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.coalesce(F.array_join(one, ","), F.lit(""))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span (overlaps joined) replaced by ``[REDACTED]``."""
    merged = F.aggregate(
        spans, F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"),
                F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))
    state = F.aggregate(
        merged, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(
            F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                     F.lit("[REDACTED]")).alias("out"), s["end"].alias("at")))
    rest = F.substring(text, (state["at"] + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) > 0, F.concat(state["out"], rest)).otherwise(text)


def history_of(docs: DataFrame) -> DataFrame:
    """``documents`` as a history of one version a path."""
    return docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs, _, findings = scan_history(history_of(read(spark, sf_dir, "documents")))
    out = by_path(blobs, findings)

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("long")

    spans = span_text(F.col("spans"))
    return out.select(
        F.col("path").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
