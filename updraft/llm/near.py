"""Near-duplicate documents by an LSH forest over word-shingle sets.

Each distinct set has a min-hash signature. A tree of the forest is one order of
the signature's values: the sets sorted by these values, where neighbours share
the longest prefixes. Sets sharing fewer than ``DEPTH`` values with every other
set in all trees have no near copy and leave early. The rest are sorted by every
tree, and neighbours that share the first ``DEPTH`` values at least are confirmed
on their full sets; a large group of near copies is joined by such few links. Then
they are sorted by other trees, and each meets its ``REACH`` nearest on either side
that share ``DEPTH`` values, of which those in another component are confirmed. That
is every pair of a region of up to ``REACH + 1`` rows. The rows of larger regions with
several components, and of regions cut by the border of two tasks, meet in an exact
prefix-filter join: two similar sets share one of the first shingles of either, in an
order of all shingles from rare to common. Components meet there before sets do, and
only if their balls of parity maps come near enough to each other; neither test can
part a similar pair.

* Copies are one node (the digest of their set); links and components are of nodes.
* Null or wordless texts have the empty set, are linked with nothing and kept.
* A row without a doc_id takes part as a copy; a class without any doc_id has a
  null component and each of its rows is kept.
* Repeated rows have the same component; ``kept`` is true for each row whose
  doc_id is the smallest of its component.
* Ties do not matter: the outcome depends on links alone. Other columns are not read.

A true link is missed only if the two sets share no ``DEPTH`` values in any tree
(at the threshold less than 1 in 400,000) or, outside of large regions, if their
signatures estimate them below ``ESTIMATE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm import shingles
from updraft.llm.common import arrow_schema, batch_rows, read, small_batches, whole_text, written
from updraft.llm.components import components

THRESHOLD = 75      # per cent of the union
DEPTH = 3
SCREEN_TREES = 24   # orders in which sets without partners are screened out
FIRST_TREES = 32    # orders whose neighbours are confirmed first
OTHER_TREES = 64    # further orders, for pairs across components
LEVELS = 12         # values of a signature order that sort a tree
REACH = 8
SKETCH = 128        # one byte of each signature value goes along to estimate likeness
#: Estimated likeness below which a candidate is not confirmed: 4.4 standard errors under the threshold.
ESTIMATE = 0.58
SET_BYTES = 6       # of each shingle hash in a set that is moved
SALTS = 16
BUCKETS = 1 << 21   # counters by which shingles are ordered from rare to common
SALT_ROOTS = 256    # components that share a shingle, per salt of that shingle
TOLD = 100_000      # nodes a task remembers to have named already
POSTINGS = 50_000   # rows of a batch of postings
WORDS = 16          # 64-bit words of a set's parity map
#: Ids up to this many (about 20 MB) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 300_000

_ORDERS = np.stack([np.random.default_rng(1000 + t).permutation(shingles.HASHES)[:LEVELS] for t in range(FIRST_TREES + OTHER_TREES)])


def _shingled_row(doc_id, key, text: bytes) -> tuple:
    s = shingles.shingle_set(text)
    if not len(s):
        return doc_id, key, 0, None, None
    return doc_id, key, len(s), xxhash.xxh3_128_digest(s.tobytes()), shingles.signature(s).tobytes()


def shingled(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, key, n_shingles, node (digest of the set, null if empty) and signature of every row."""
    key = F.lit(0) if key is None else key
    return batch_rows(docs.select("doc_id", key.cast("long").alias("key"), whole_text().alias("text")), _shingled_row,
                      "doc_id long, key long, n_shingles long, node binary, signature binary")


def _columns(batch: pa.RecordBatch, name: str, width: int, kind) -> np.ndarray:
    """A binary column of fixed width as a matrix."""
    joined = b"".join(batch.column(batch.schema.get_field_index(name)).to_pylist())
    return np.frombuffer(joined, kind).reshape(-1, width)


def _emit(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows_as_bytes(matrix: np.ndarray) -> list[bytes]:
    matrix = np.ascontiguousarray(matrix)
    data, width = matrix.tobytes(), matrix.shape[1] * matrix.itemsize
    return [data[i:i + width] for i in range(0, len(data), width)]


def active_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes that share the first ``DEPTH`` values of some tree with a set of similar size.

    Rows are sorted by those values and then by size, so that a partner of fitting
    size exists exactly if a neighbour fits. The first and last row of a task stay
    in, since their neighbours may be in the next one.
    """
    spark = nodes.sparkSession
    small_batches(spark)
    keyed_schema = arrow_schema(spark, "region long, n_shingles long, node binary")

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            sig = _columns(batch, "signature", shingles.HASHES, np.uint16)
            sizes, ids = batch.column(1), batch.column(0).to_pylist()
            for t in range(SCREEN_TREES):
                region = np.zeros(len(sig), np.uint64)
                for place in _ORDERS[t, :DEPTH]:
                    region = (region << np.uint64(16)) | sig[:, place]
                region |= np.uint64(t) << np.uint64(16 * DEPTH)
                yield _emit(keyed_schema, [region.view(np.int64), sizes, ids])

    def partners(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema_node
        last, last_active, first = None, True, True
        for batch in it:
            if not batch.num_rows:
                continue
            region, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids = batch.column(2).to_pylist()
            if last is not None:
                region = np.concatenate(([last[0]], region))
                size = np.concatenate(([last[1]], size))
                ids.insert(0, last[2])
            fit = (region[1:] == region[:-1]) & (4 * size[:-1] >= 3 * size[1:])
            active = np.zeros(len(ids), bool)
            active[0] = first or last_active
            active[1:] |= fit
            active[:-1] |= fit
            first = False
            last, last_active = (region[-1], size[-1], ids[-1]), bool(active[-1])
            yield _emit(schema, [[i for i, a in zip(ids[:-1], active[:-1]) if a]])
        if last is not None:
            yield _emit(schema, [[last[2]]])

    arrow_schema_node = arrow_schema(spark, "node binary")
    keyed = nodes.select("node", "n_shingles", "signature").mapInArrow(
        keys, "region long, n_shingles long, node binary")
    ordered = keyed.repartitionByRange("region", "n_shingles", "node").sortWithinPartitions(
        "region", "n_shingles", "node")
    return ordered.mapInArrow(partners, "node binary").distinct()


class _Unsearched:
    """Nodes of the regions of one task's sorted rows that ``reach`` does not search in full.

    These are regions of more than ``reach + 1`` rows and several roots, and the first
    and last region of the task, which may go on in another one. A region's rows are
    held only as long as it has one root.
    """

    def __init__(self, reach: int):
        self.reach, self.region, self.first = reach, None, True
        self.held: list[np.ndarray] = []
        self.rows, self.root, self.mixed = 0, b"", False

    def _extend(self, node: np.ndarray, root: np.ndarray) -> list[np.ndarray]:
        self.held.append(node)
        self.rows += len(node)
        self.mixed = self.mixed or bool((root != self.root).any())
        return self._release() if self.first or (self.mixed and self.rows > self.reach + 1) else []

    def _release(self) -> list[np.ndarray]:
        held, self.held = self.held, []
        return held

    def add(self, region: np.ndarray, node: np.ndarray, root: np.ndarray) -> list[np.ndarray]:
        """The next rows; returns the nodes known to be unsearched by now."""
        cuts = np.flatnonzero((region[1:] != region[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(region)]))
        out: list[np.ndarray] = []
        begun = 0
        if self.region is not None and (region[0] == self.region).all():
            out += self._extend(node[:ends[0]], root[:ends[0]])
            begun = 1
        for s, e in zip(starts[begun:], ends[begun:]):
            if self.region is None or e == len(region):       # may go on on either side
                self.first, self.held, self.rows, self.mixed = self.region is None, [], 0, False
                self.region, self.root = region[s], root[s]
                out += self._extend(node[s:e], root[s:e])
            elif e - s > self.reach + 1 and (root[s:e] != root[s]).any():
                out.append(node[s:e])
        return out

    def end(self) -> list[np.ndarray]:
        return self._release()


def candidates(nodes: DataFrame, trees: range, reach: int, rest: bool = False) -> DataFrame:
    """Pairs a < b of nodes of different components that are within ``reach`` in one of the trees.

    ``nodes`` has node, root, n_shingles and signature. Pairs that the whole
    signatures estimate below ``ESTIMATE`` are left out. With ``rest``, the nodes of
    regions that are not searched in full come too, as rows with a null b.
    """
    spark = nodes.sparkSession
    small_batches(spark)
    keyed_ddl, pair_ddl = "key binary, node binary, root binary, n_shingles long, sketch binary", "a binary, b binary"
    keyed_schema, pair_schema = arrow_schema(spark, keyed_ddl), arrow_schema(spark, pair_ddl)
    prefix = 1 + 2 * DEPTH

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            sig = _columns(batch, "signature", shingles.HASHES, np.uint16)
            sketch = _rows_as_bytes(sig[:, :SKETCH].astype(np.uint8))
            ids, roots, sizes = (batch.column(i) for i in range(3))
            for t in trees:
                mark = bytes([t])
                values = _rows_as_bytes(sig[:, _ORDERS[t]].astype(">u2"))
                yield _emit(keyed_schema, [[mark + v for v in values], ids, roots, sizes, sketch])

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, unsearched, told = None, _Unsearched(reach), set()

        def new(found: list[np.ndarray]) -> list[bytes]:
            ids = {i for part in found for i in _rows_as_bytes(part)} - told
            if len(told) + len(ids) > TOLD:
                told.clear()
            told.update(ids)
            return list(ids)

        for batch in it:
            if not batch.num_rows:
                continue
            now = (_columns(batch, "key", 1 + 2 * LEVELS, np.uint8), _columns(batch, "node", 16, np.uint8),
                   _columns(batch, "root", 16, np.uint8), batch.column(3).to_numpy(),
                   _columns(batch, "sketch", SKETCH, np.uint8))
            if rest and (ids := new(unsearched.add(now[0][:, :prefix], now[1], now[2]))):
                yield _emit(pair_schema, [ids, [None] * len(ids)])
            old = 0
            if held is not None:
                old = len(held[3])
                now = tuple(np.concatenate(x) for x in zip(held, now))
            key, node, root, size, sketch = now
            for shift in range(1, reach + 1):
                right = np.arange(max(old, shift), len(size))
                left = right - shift
                small, large = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
                ok = (key[left, :prefix] == key[right, :prefix]).all(axis=1) & (100 * small >= THRESHOLD * large)
                left, right = left[ok], right[ok]
                ok = (root[left] != root[right]).any(axis=1)
                left, right = left[ok], right[ok]
                ok = (sketch[left] == sketch[right]).mean(axis=1) >= ESTIMATE
                left, right = left[ok], right[ok]
                if len(left):
                    one, two = _rows_as_bytes(node[left]), _rows_as_bytes(node[right])
                    yield _emit(pair_schema, [list(map(min, one, two)), list(map(max, one, two))])
            held = tuple(x[-reach:] for x in now)
        if rest and (ids := new(unsearched.end())):
            yield _emit(pair_schema, [ids, [None] * len(ids)])

    keyed = nodes.select("node", "root", "n_shingles", "signature").mapInArrow(keys, keyed_ddl)
    ordered = keyed.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(pairs, pair_ddl).distinct()


def _set_row(node: bytes, text: bytes) -> tuple:
    s = shingles.shingle_set(text)
    if xxhash.xxh3_128_digest(s.tobytes()) != node:
        return None, None      # another text under the same doc_id
    # Equal low bytes of two hashes of a pair are as good as equal hashes: 2**48 values.
    low = np.unique(s & np.uint64((1 << 8 * SET_BYTES) - 1))
    return node, low.view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def node_sets(docs: DataFrame, holders: DataFrame) -> DataFrame:
    """node and packed set of every row of ``holders`` (node, doc_id)."""
    few = holders.count() <= BROADCAST_IDS
    h = (F.broadcast(holders) if few else holders).alias("h")
    d = docs.select("doc_id", whole_text().alias("text")).alias("d")
    texts = d.join(h, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))).select("h.node", "d.text")
    return batch_rows(texts, _set_row, "node binary, hashes binary").where("node is not null").dropDuplicates(["node"])


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    return wide.view(np.uint64).ravel()


def _confirm_row(a: bytes, b: bytes, one: bytes, two: bytes) -> tuple:
    x, y = _unpacked(one), _unpacked(two)
    both = shingles.overlap(x, y)
    return a, b, 100 * both >= THRESHOLD * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("one")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("two")), "b")
    return batch_rows(both.select("a", "b", "one", "two"), _confirm_row, "a binary, b binary, linked boolean").where(
        "linked").select("a", "b")


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often shingles of each bucket occur in the sets."""
    spark = sets.sparkSession
    ddl = "bucket int, n long"
    schema = arrow_schema(spark, ddl)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int32)
        for batch in it:
            for data in batch.column(0).to_pylist():
                np.add.at(counts, _bucket(_unpacked(data)), 1)
        used = np.flatnonzero(counts)
        for at in range(0, len(used), POSTINGS):
            part = used[at:at + POSTINGS]
            yield _emit(schema, [part.astype(np.int32), counts[part].astype(np.int64)])

    out = np.zeros(BUCKETS, np.int32)
    counted = sets.select("hashes").mapInArrow(run, ddl).groupBy("bucket").agg(F.sum("n").alias("n"))
    found = counted.select("bucket", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _parity(hashes: np.ndarray) -> list[int]:
    """Which of ``64 * WORDS`` buckets hold an odd number of the hashes.

    Two such maps differ in no more bits than the two sets differ in elements.
    """
    bits = ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.int64) % (64 * WORDS)
    odd = (np.bincount(bits, minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _parity_row(node: bytes, root: bytes, data: bytes) -> tuple:
    hashes = _unpacked(data)
    return node, root, len(hashes), *_parity(hashes)


_MAPS = [f"m{i}" for i in range(WORDS)]


def _differ(x: str, y: str) -> Column:
    """In how many bits the maps of two sides of a join differ."""
    total = F.bit_count(F.col(f"{x}.m0").bitwiseXOR(F.col(f"{y}.m0")))
    for name in _MAPS[1:]:
        total = total + F.bit_count(F.col(f"{x}.{name}").bitwiseXOR(F.col(f"{y}.{name}")))
    return total


def _may_differ(n: Column) -> Column:
    """Elements in which two similar sets of ``n`` elements together differ at most."""
    return n * (100 - THRESHOLD) / (100 + THRESHOLD)


def postings(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """The first shingles of each set (node, root, hashes) with the set's size and how many follow in it.

    Shingles are ordered by ``counts``, rare ones first. A set of n shingles has
    n - ceil(0.75 n) + 1 first ones; of two similar sets these have one in common.
    Those that no other set has are left out.
    """
    spark = sets.sparkSession
    small_batches(spark)
    ddl = "token long, root binary, n int, rest int"
    schema = arrow_schema(spark, ddl)
    shared = spark.sparkContext.broadcast(counts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, held = [[], [], [], []], 0
            for root, data in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = _unpacked(data)
                n, seen = len(hashes), shared.value[_bucket(hashes)]
                order = np.lexsort((hashes, seen))[:n - (THRESHOLD * n + 99) // 100 + 1]
                place = np.flatnonzero(seen[order] > 1)
                if not len(place):
                    continue
                for column, values in zip(out, (hashes[order[place]].view(np.int64).tolist(), [root] * len(place),
                                                [n] * len(place), (n - place).tolist())):
                    column += values
                held += len(place)
                if held >= POSTINGS:
                    yield _emit(schema, out)
                    out, held = [[], [], [], []], 0
            if held:
                yield _emit(schema, out)

    return sets.select("root", "hashes").mapInArrow(run, ddl)


def _balls(members: DataFrame) -> DataFrame:
    """Per root the map of its smallest set, how far the maps of others are from it, and the largest size."""
    first = members.groupBy("root").agg(F.min(F.struct("node", *_MAPS)).alias("r")).select("root", *(f"r.{m}" for m in _MAPS))
    far = members.alias("a").join(first.alias("b"), "root").groupBy("root").agg(
        F.max(_differ("a", "b")).alias("radius"), F.max("a.n").alias("most"))
    return first.join(far, "root")


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """All pairs a < b of sets (node, root, hashes) with different roots that may be similar.

    Roots that share a first shingle meet before their sets do, so copies within a
    component never meet; shingles of many roots are salted. A meeting must pass, in
    the join itself, what any similar pair of the two roots passes: from the first
    shingle in common on, both sets hold enough for the threshold, and the maps of the
    roots' smallest sets differ by no more than both radii and what a similar pair may
    differ in. Pairs of roots are then made distinct. Sets of either root near enough
    to the other's ball are picked, and meet if their own maps may be of a similar pair.
    """
    members = written(batch_rows(sets.select("node", "root", "hashes"), _parity_row,
                                 "node binary, root binary, n int, " + ", ".join(f"{m} long" for m in _MAPS)), "maps")
    balls = written(_balls(members), "balls")
    heads = written(postings(sets, _shingle_counts(sets)).groupBy("token", "root").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest")), "postings")
    common = heads.groupBy("token").agg(F.count("*").alias("roots")).where("roots > 1").select(
        "token", F.ceil(F.col("roots") / SALT_ROOTS).cast("int").alias("salts"))
    heads = written(heads.join(common, "token").join(balls.drop("most"), "root"), "heads")
    dealt = heads.withColumn("salt", F.pmod(F.xxhash64("root"), F.col("salts")).cast("int"))
    copied = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    x, y = dealt.alias("x"), copied.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt"))
                 & (F.col("x.root") < F.col("y.root")) & (100 * F.col("x.high") >= THRESHOLD * F.col("y.low"))
                 & (100 * F.col("y.high") >= THRESHOLD * F.col("x.low"))
                 & ((100 + THRESHOLD) * F.least("x.rest", "y.rest") >= THRESHOLD * (F.col("x.low") + F.col("y.low")))
                 & (_differ("x", "y") <= F.col("x.radius") + F.col("y.radius")
                    + _may_differ(F.col("x.high") + F.col("y.high")))).select(
        F.col("x.root").alias("one"), F.col("y.root").alias("two"))
    met = written(met.distinct(), "met")

    def side(own: str, other: str) -> DataFrame:
        """Sets of the ``own`` root that may be similar to one in the ball of the ``other``."""
        facing = met.join(balls.withColumnRenamed("root", other), other).alias("o")
        return facing.join(members.alias("s"), (F.col(f"o.{own}") == F.col("s.root")) & (
            _differ("s", "o") <= F.col("o.radius") + _may_differ(F.col("s.n") + F.col("o.most")))).select(
            F.col("o.one").alias("one"), F.col("o.two").alias("two"), "s.node", "s.n", *(f"s.{m}" for m in _MAPS))

    a, b = side("one", "two").alias("a"), side("two", "one").alias("b")
    return a.join(b, (F.col("a.one") == F.col("b.one")) & (F.col("a.two") == F.col("b.two"))
                  & (100 * F.least("a.n", "b.n") >= THRESHOLD * F.greatest("a.n", "b.n"))
                  & (_differ("a", "b") <= _may_differ(F.col("a.n") + F.col("b.n")))).select(
        F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))


def near_links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) of nodes whose components are those of all similar sets."""
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "n_shingles", "signature")).alias("r")).select("node", "r.*")
    nodes = written(nodes, "nodes")
    active = written(nodes.join(active_nodes(nodes), "node", "left_semi"), "active")

    def sets_of(ids: DataFrame) -> DataFrame:
        holders = written(active.select("node", "doc_id").join(ids, "node", "left_semi"), "holders")
        return written(node_sets(docs, holders), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return written(confirmed(pairs, sets_of(ids)), "links")

    first = confirm(written(candidates(active.withColumn("root", F.col("node")), range(FIRST_TREES), 1), "candidates"))
    rooted = active.join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = written(candidates(rooted, range(FIRST_TREES, FIRST_TREES + OTHER_TREES), REACH, rest=True), "candidates")
    links = first.unionByName(confirm(found.where("b is not null")))
    left = found.where("b is null").select(F.col("a").alias("node"))
    if left.isEmpty():
        return links
    roots = components(links).withColumnRenamed("root", "joined")
    sets = sets_of(left).join(rooted.select("node", "root"), "node").join(roots, "node", "left").withColumn(
        "root", F.coalesce("joined", "root")).drop("joined")
    pairs = written(prefix_pairs(sets), "pairs")
    return links.unionByName(written(confirmed(pairs, sets), "links"))


def classify(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, key, n_shingles, class (a node of the component), component_id and kept of every row.

    ``key`` is a number that goes along, to tell rows of one doc_id apart.
    """
    rows = written(shingled(docs, key), "shingled")
    roots = components(near_links(docs, rows))
    # Only nodes with links or several rows have a component other than their row's id.
    counted = rows.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.count("*").alias("n"))
    placed = counted.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    linked = placed.where("root is not null")
    lows = linked.groupBy("class").agg(F.min("low").alias("component_id"))
    labels = linked.join(lows, "class").select("node", "class", "component_id").unionByName(
        placed.where("root is null and n > 1").select("node", "class", F.col("low").alias("component_id")))
    labels = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn(
        "placed", F.lit(True))
    salted = rows.drop("signature").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(labels, ["node", "salt"], "left")
    component = F.when(F.col("placed"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "key", "n_shingles", F.coalesce("class", "node").alias("class"),
                      component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
