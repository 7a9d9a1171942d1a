"""Merkle manifest of a dataset: a digest per row, a tree per source, a tree over sources, and proofs.

Leaves of a source ascend by doc_id. While a level has more than one node, every
three consecutive nodes (the last run: fewer, even one) become the digest of their
concatenation; the last node is the source's subroot. Subroots in the order of their
sources give the root in the same way.

Levels are computed by lag and lead windows. A source is cut into blocks of
``3 ** LEVELS`` positions. On the leaf rows of a block, level j lives on the rows
whose position is a multiple of ``3 ** j``; lags and leads by ``3 ** j`` and twice
that, masked by the node's slot in its run and by the run's length, are its
siblings, and the rows of first children hash the parents. All levels of a block
share one partitioning and order, so a block costs one shuffle. The nodes above the
blocks are a table of ``3 ** LEVELS`` times fewer rows, treated alike until each tree
has one node. A hot source is thus many blocks. Positions come from a range
partitioning by (source, doc_id), counted per part and source.

* Nulls: a null field is ``-`` in its leaf; a null source is a source, ordered first;
  null doc_ids come first within their source and are never tampered with.
* Rows that share a doc_id are ordered by their leaves; repeated rows are all leaves.
* Empty texts differ from null ones. Very long texts are hashed as they are, and no
  text is moved by a shuffle.
* An empty table has no leaves and gives no rows; one row is its own subroot and root.
* Columns beside those of ``documents`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from updraft.llm.common import read, written

FANOUT = 3
LEVELS = 7      # of a block: 2,187 positions
SALTS = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ROW_BITS = (1 << 33) - 1    # monotonically_increasing_id counts a partition's rows in these


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def framed(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """The leaf digest of a row of ``documents``, some fields replaced."""
    return digest(*[framed(changed.get(f, F.col(f))) for f in FIELDS])


def positioned(leaves: DataFrame) -> DataFrame:
    """``leaves`` (a stored table with source, doc_id, leaf) with ``source_no``, ``at`` and ``n``.

    ``source_no`` numbers sources in order, ``at`` a source's leaves, both from 0; ``n`` is the source's size.
    """
    order = ("source", "doc_id", "leaf", "tie")
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(
        *order).drop("tie")
    # Part and row within it hold for this one job only, so they are stored with the rows.
    parts = written(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(
        _ROW_BITS).alias("row")), "ordered")
    runs = written(parts.groupBy("part", "source").agg(F.min("row").alias("first"), F.count("*").alias("rows")), "runs")
    within = Window.partitionBy("source")
    before = within.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.select("part", "source", "first", F.sum("rows").over(within).alias("n"),
                         F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    numbers = source_numbers(runs)
    p, s = placed.alias("p"), numbers.alias("s")
    spots = p.join(s, F.col("p.source").eqNullSafe(F.col("s.source"))).select(
        "part", F.col("p.source").alias("source"), "source_no", "n", (F.col("base") - F.col("first")).alias("shift"))
    a, b = parts.alias("a"), spots.alias("b")
    out = a.join(b, (F.col("a.part") == F.col("b.part")) & F.col("a.source").eqNullSafe(F.col("b.source")))
    return out.select(*[f"a.{c}" for c in leaves.columns], "source_no",
                      (F.col("row") + F.col("shift")).alias("at"), "n")


def source_numbers(runs: DataFrame) -> DataFrame:
    """source and its number in order, nulls first.

    A source's number is the count of sources that begin in earlier parts, plus those before it in its own
    part: two windows, over the sources of a part and over one row a part.
    """
    begins = runs.groupBy("source").agg(F.min(F.struct("part", "first")).alias("b")).select(
        "source", "b.part", "b.first")
    counts = begins.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    return begins.withColumn("inside", inside).join(before, "part").select(
        "source", (F.col("before") + F.col("inside")).alias("source_no"))


def climb(nodes: DataFrame, tree: str) -> DataFrame:
    """``LEVELS`` levels over ``nodes`` (tree, at, n, digest).

    Adds ``steps``, the left and right siblings of each level that is hashed, lowest
    first, and on the first row of a block ``top``, the node above the block.
    """
    block = F.floor(F.col("at") / FANOUT ** LEVELS)
    rows = nodes.withColumn("block", block).withColumn("d", F.col("digest"))
    order = Window.partitionBy(tree, "block").orderBy("at")
    steps = []
    for level in range(LEVELS):
        stride = FANOUT ** level
        number = F.floor(F.col("at") / stride)
        slot, count = number % FANOUT, F.ceil(F.col("n") / stride)
        length = F.least(F.lit(FANOUT), count - (number - slot))
        rows = rows.withColumns({
            **{f"back{k}": F.lag("d", k * stride).over(order) for k in range(1, FANOUT)},
            **{f"next{k}": F.lead("d", k * stride).over(order) for k in range(1, FANOUT)}})
        none = F.lit("")
        left = F.concat(*[F.when(slot >= k, F.col(f"back{k}")).otherwise(none) for k in range(FANOUT - 1, 0, -1)])
        right = F.concat(*[F.when(slot + k < length, F.col(f"next{k}")).otherwise(none) for k in range(1, FANOUT)])
        node, hashed = F.col("at") % stride == 0, count > 1
        step = F.when(node, F.struct(left.alias("left"), right.alias("right"), hashed.alias("hashed")))
        first_child = F.col("at") % (stride * FANOUT) == 0
        parent = F.when(first_child, F.when(hashed, digest(F.col("d"), right)).otherwise(F.col("d")))
        rows = rows.withColumns({f"s{level}": step, "above": parent}).drop("d").withColumnRenamed("above", "d").drop(
            *[f"{side}{k}" for side in ("back", "next") for k in range(1, FANOUT)])
        steps.append(f"s{level}")
    # A node's siblings stand on its first leaf: the last such row at or before a leaf is its ancestor's.
    seen = order.rowsBetween(Window.unboundedPreceding, 0)
    carried = F.array(*[F.last(s, ignorenulls=True).over(seen) for s in steps])
    return rows.withColumn("carried", carried).withColumn("steps", F.transform(
        F.filter("carried", lambda s: s["hashed"]),
        lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")))).withColumnRenamed("d", "top").drop(
            "carried", *steps)


def tree_paths(nodes: DataFrame, tree: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Paths of all nodes and the root of each tree.

    ``nodes`` (tree, at, n, digest and ``keep``) are the lowest level. Returns the
    nodes with ``path`` up to their root, and (tree, root).
    """
    tiers = []
    while True:
        tier = written(climb(nodes, tree), "tier")
        tiers.append(tier)
        nodes = tier.where(F.col("at") % FANOUT ** LEVELS == 0).select(
            tree, F.col("block").alias("at"), F.ceil(F.col("n") / FANOUT ** LEVELS).alias("n"),
            F.col("top").alias("digest"))
        if (tier.agg(F.max("n")).first()[0] or 0) <= FANOUT ** LEVELS:
            break
    path = None
    for tier in reversed(tiers):
        if path is None:
            path = tier.withColumnRenamed("steps", "path")
        else:
            upper = path.select(tree, F.col("at").alias("block"), F.col("path").alias("upper"))
            path = tier.join(upper, [tree, "block"]).withColumn("path", F.concat("steps", "upper"))
    return path.select(tree, "at", *keep, "path"), nodes.select(tree, F.col("digest").alias("root"))


def proof(path: Column) -> Column:
    """Digest of all siblings from leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda d, s: digest(s["left"], d, s["right"]))


def manifest(docs: DataFrame, checked: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path to the root, and ``checked_leaf``.

    ``checked`` replaces fields of a row before it is hashed for verification: the
    copy of the dataset that is checked against the manifest.
    """
    leaves = written(docs.select("doc_id", "source", leaf_of().alias("leaf"), leaf_of(**(checked or {})).alias(
        "checked_leaf")), "leaves")
    placed = positioned(leaves).withColumnRenamed("leaf", "digest")
    paths, subroots = tree_paths(placed, "source_no", ("doc_id", "source", "digest", "checked_leaf"))
    sources = written(subroots, "subroots")
    tops = sources.select(F.lit(0).alias("dataset"), F.col("source_no").alias("at"), F.col("root").alias("digest"))
    upper, roots = tree_paths(tops.withColumn("n", F.lit(sources.count())), "dataset", ("digest",))
    root = roots.first()
    up = upper.select(F.col("at").alias("source_no"), F.col("digest").alias("subroot"), F.col("path").alias("upper"))
    return salted(paths, up).select(
        "doc_id", "source", F.col("digest").alias("leaf"), "checked_leaf", "subroot",
        F.lit(root and root["root"]).cast("string").alias("root"), F.concat("path", "upper").alias("path"))


def salted(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """Join by source; a hot source is spread over ``SALTS`` keys by the leaf's position."""
    copies = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return paths.withColumn("salt", (F.col("at") % SALTS).cast("int")).join(copies, ["source_no", "salt"])


def verified(entries: DataFrame) -> DataFrame:
    """``entries`` of a manifest with proof_sha256, folded_root and verified."""
    return entries.withColumns({"proof_sha256": proof(F.col("path")),
                                "folded_root": folded(F.col("checked_leaf"), F.col("path"))}).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return verified(manifest(docs, {"text": text})).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _framed_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(_framed_sql(v) for v in (*FIELDS[:-1], text))})"


def _crc_sql(value: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    step = "CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384) ELSE u // 2 END"
    each = f"list_reduce(list_prepend(xor(a, b), range(8)), lambda u, i: {step})"
    codes = f"list_transform(string_split({value}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {each}), 4294967295)"


def _levels_sql(name: str, key: str, start: str) -> str:
    """Recursive levels of trees and, as ``name``_step, the siblings of each node that is hashed."""
    run = f"OVER (PARTITION BY {key}, l, i // 3 ORDER BY i ROWS BETWEEN"
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT {key}, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM {name}
  WHERE n > 1 GROUP BY {key}, l, i // 3, n
), {name}_step AS (
  SELECT {key}, l, i, coalesce(string_agg(d, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') lhs,
    coalesce(string_agg(d, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') rhs
  FROM {name} WHERE n > 1
)"""


#: The same in DuckDB SQL, by recursion over levels.
OP13_SQL = f"""
WITH RECURSIVE c AS (
  SELECT row_number() OVER () rid, *, CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 2 = 0
    THEN replace(text, chr(10), '') ELSE text END copy FROM documents
), f AS (
  SELECT rid, doc_id, source, {_leaf_sql('text')} leaf, {_leaf_sql('copy')} checked FROM c
), o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 i,
    count(*) OVER (PARTITION BY source) n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 k FROM f
), {_levels_sql('lv', 'k', 'SELECT k, 0 l, i, n, leaf d FROM o')}, sub AS (
  SELECT k, l depth, d FROM lv WHERE n = 1
), {_levels_sql('tp', 'z', 'SELECT 0 z, 0 l, k i, (SELECT count(*) FROM sub) n, d FROM sub')}, w AS (
  SELECT rid, k, 0 l, i, checked d, '' p FROM o
  UNION ALL
  SELECT rid, k, l + 1, w.i // 3, sha256(lhs || d || rhs), p || lhs || rhs FROM w JOIN lv_step s USING (k, l)
  WHERE s.i = w.i
), v AS (
  SELECT rid, 0 l, k i, w.d, p FROM w JOIN sub USING (k) WHERE l = depth
  UNION ALL
  SELECT rid, l + 1, v.i // 3, sha256(lhs || d || rhs), p || lhs || rhs FROM v JOIN tp_step s USING (l) WHERE s.i = v.i
), e AS (
  SELECT rid, arg_max(d, l) d, arg_max(p, l) p FROM v GROUP BY rid
)
SELECT doc_id, leaf, sub.d subroot, r.d root, sha256(e.p) proof_sha256, e.d folded_root, e.d = r.d verified
FROM o JOIN e USING (rid) JOIN sub USING (k) CROSS JOIN (SELECT d FROM tp WHERE n = 1) r
"""
