"""Quality rules per document, with a verdict per host.

Each document is judged by five rules on its whole text. Failures are summed per
host (the ``source``). A host's failure rate of a rule is shrunk towards the rate
of all hosts with a beta prior whose two parameters come from the hosts themselves
by the method of moments. A host fails if some shrunk rate passes that rule's
limit, and its documents go with it.

* Null text counts as empty: no words, so the base rule fails.
* Documents without a source belong to no host: only their base rules count.
* Repeated rows are judged each; columns beside ``doc_id, text, source`` are not read.
* With fewer than two hosts, or hosts that do not differ, the prior has the
  strength ``MAX_PRIOR``: single hosts then hardly differ from the whole.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm.common import batch_rows, read, whole_text, written

MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOL_PERCENT = 20      # symbols per character of words
DUP_LINE_PERCENT = 50    # repeated lines per line with a word
WORD_LENGTH = (2, 15)    # mean characters of a word
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: Shrunk failure rate above which a host fails, per rule.
HOST_LIMIT = 0.75
RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")
MIN_PRIOR, MAX_PRIOR = 2.0, 10_000.0
SALTS = 32
SIGNALS = ("doc_id long, key long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, n_lines long")


def repeat_words(words: list, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(window))))
    counts = Counter(windows)
    if len(counts) == n:
        return 0
    covered, end = 0, 0
    for at, w in enumerate(windows):
        if counts[w] > 1:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def _signal_row(doc_id, key, source, text: bytes) -> tuple:
    words = text.split()     # ASCII white space, as bytes
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if not line.isspace() and line]
    return (doc_id, key, source, len(words), len(joined.decode("utf-8", "replace")), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words), len(lines))


def signals(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """The counts of every document that the rules read; ``key`` goes along to tell rows of one doc_id apart."""
    key = F.lit(0) if key is None else key
    return batch_rows(docs.select("doc_id", key.cast("long").alias("key"), "source", whole_text().alias("text")),
                      _signal_row, SIGNALS)


def with_rules(counted: DataFrame) -> DataFrame:
    """``counted`` with one boolean per rule (true: fails) and ``base_failed``."""
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return counted.withColumns({
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > DUP_LINE_PERCENT * F.col("n_lines"),
        "word_length": (mean < WORD_LENGTH[0]) | (mean > WORD_LENGTH[1]),
    }).withColumn("base_failed", F.col("short") | F.col("repeats"))


def host_failures(judged: DataFrame) -> DataFrame:
    """source, n documents and failures per rule; combined within tasks before the shuffle."""
    return judged.where("source is not null").groupBy("source").agg(
        F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(f"{r}_failed") for r in RULES])


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(alpha, beta) per rule by the method of moments over hosts; one row reaches the driver.

    The spread of host rates is the sum of the spread of true rates and of the
    binomial noise of a host with n documents; the first part alone sets the
    prior's strength.
    """
    parts = [F.count("*").alias("hosts"), F.sum("n").alias("n"), F.avg(1 / F.col("n")).alias("inverse")]
    for r in RULES:
        rate = F.col(f"{r}_failed") / F.col("n")
        parts += [F.avg(rate).alias(f"{r}_mean"), F.var_pop(rate).alias(f"{r}_var")]
    row = hosts.agg(*parts).first()
    priors = {}
    for r in RULES:
        mean, var = row[f"{r}_mean"] or 0.0, row[f"{r}_var"] or 0.0
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        noise = mean * (1 - mean) * (row["inverse"] or 1.0)
        between = var - noise
        strength = mean * (1 - mean) / between - 1 if between > 0 and row["hosts"] > 1 else MAX_PRIOR
        strength = min(max(strength, MIN_PRIOR), MAX_PRIOR)
        priors[r] = (mean * strength, (1 - mean) * strength)
    return priors


def host_verdicts(hosts: DataFrame, priors: dict[str, tuple[float, float]], limit: float = HOST_LIMIT) -> DataFrame:
    """``hosts`` with the shrunk rate of each rule and ``host_failed``."""
    for r in RULES:
        alpha, beta = priors[r]
        hosts = hosts.withColumn(f"{r}_rate", (F.col(f"{r}_failed") + alpha) / (F.col("n") + alpha + beta))
    return hosts.withColumn("host_failed", F.greatest(*[f"{r}_rate" for r in RULES]) > limit)


def judge_documents(docs: DataFrame, limit: float = HOST_LIMIT, key: Column | None = None) -> DataFrame:
    """Signals, rule results, ``host_failed`` and ``kept`` of every document.

    The signals are stored once, since the host table and the result read them.
    A hot host is spread over ``SALTS`` join keys; the host table is copied that often.
    """
    judged = with_rules(written(signals(docs, key), "signals"))
    hosts = host_failures(judged)
    failing = host_verdicts(hosts, beta_priors(hosts), limit).where("host_failed").select(
        "source", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "host_failed")
    salted = judged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(SALTS)).cast("int"))
    out = salted.join(failing, ["source", "salt"], "left")
    return out.withColumn("host_failed", F.coalesce("host_failed", F.lit(False))).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_failed")).drop("salt")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host_failed", *RULES)


#: The same in DuckDB SQL: windows by list, moments over hosts, verdicts joined back.
OP8_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () rid, doc_id, source, coalesce(text, '') t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) i FROM w WHERE len(ws) >= {WINDOW})
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) n FROM win) WHERE n > 1
), cov AS (
  SELECT rid, count(DISTINCT p) n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + {WINDOW})) p FROM rep) GROUP BY rid
), s AS (
  SELECT w.rid, doc_id, source, len(ws)::BIGINT n_words,
    length(array_to_string(ws, ''))::BIGINT word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT n_repeat_words, len(ls) n_lines
  FROM w LEFT JOIN cov USING (rid)
), j AS (
  SELECT *, n_words < {MIN_WORDS} short, 100 * n_repeat_words > {REPEAT_PERCENT} * n_words repeats,
    100 * n_symbols > {SYMBOL_PERCENT} * word_chars symbols,
    100 * n_dup_lines > {DUP_LINE_PERCENT} * n_lines dup_lines,
    word_chars / greatest(n_words, 1) < {WORD_LENGTH[0]} OR word_chars / greatest(n_words, 1) > {WORD_LENGTH[1]}
      word_length
  FROM s
), h AS (
  SELECT source, rule, count(*) n, sum(f::INT) f FROM (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'dup_lines', 'word_length']) rule,
      unnest([short, repeats, symbols, dup_lines, word_length]) f FROM j WHERE source IS NOT NULL)
  GROUP BY ALL
), m AS (
  SELECT rule, count(*) hosts, least(greatest(avg(f / n), 1e-6), 1 - 1e-6) mu, var_pop(f / n) v, avg(1 / n) inv
  FROM h GROUP BY rule
), p AS (
  SELECT rule, mu, least(greatest(CASE WHEN hosts > 1 AND v - mu * (1 - mu) * inv > 0
    THEN mu * (1 - mu) / (v - mu * (1 - mu) * inv) - 1 ELSE {MAX_PRIOR} END, {MIN_PRIOR}), {MAX_PRIOR}) k FROM m
), bad AS (
  SELECT DISTINCT source FROM h JOIN p USING (rule) WHERE (f + mu * k) / (n + k) > {HOST_LIMIT}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats base_failed,
  NOT (short OR repeats) AND bad.source IS NULL kept, bad.source IS NOT NULL host_failed,
  short, repeats, symbols, dup_lines, word_length
FROM j LEFT JOIN bad USING (source)
"""
