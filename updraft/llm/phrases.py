"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases' names into longer phrases, and so on
up to one name. Where a phrase starts is decided by deterministic coin tossing:
runs of equal symbols become one symbol, each symbol gets the place and value of
the lowest bit in which it differs from the one before, three more rounds of the
same leave labels below six, and a phrase starts at each label larger than both
neighbours. That depends on a few symbols nearby only, so equal substrings are
parsed alike inside, whatever their offset, and share names on every level.

The fingerprint keeps the smallest name of each of ``SLOTS`` slots over the levels
from ``FIRST_LEVEL`` on (phrases of a few bytes and more), whatever the text's length,
and the top name.
Likeness is Dice's coefficient from the slots: 1 for equal, about the shared part
of two texts of one length.

* Null text counts as empty; the empty fingerprint is like itself only.
* Rows are ordered by descending doc_id, equal ones by text, null ones last; the
  row after the last is the first, so a single row follows itself.
* Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm.common import arrow_schema, read, small_batches, whole_text

SLOTS = 64
FIRST_LEVEL = 1
EMPTY = 0xFFFF
PART = 1 << 20      # bytes of text parsed side by side
LOWEST = -(1 << 63)
ROWS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")

_RANDOM = np.random.default_rng(424242)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = _RANDOM.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STIR, _RUN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _toss_table() -> np.ndarray:
    """New label of a symbol below 256 after another, at index 256 * symbol + other."""
    a, b = np.divmod(np.arange(1 << 16), 256)
    differing = a ^ b
    low = np.bitwise_count((differing & -differing) - 1)
    return np.where(differing == 0, 0, 2 * low + ((a >> np.minimum(low, 7)) & 1)).astype(np.uint8)


_TOSS = _toss_table()


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _STIR
    return x ^ (x >> np.uint64(29))


def _tossed(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(labels)
    before[1:] = labels[:-1]
    before[first] = labels[first] ^ np.uint8(1)
    return _TOSS[(labels.astype(np.uint16) << np.uint16(8)) | before]


def _phrase_starts(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start; names that follow each other in a text differ."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = names[first] ^ np.uint64(1)
    differing = names ^ before
    low = np.bitwise_count((differing & (~differing + np.uint64(1))) - np.uint64(1))
    labels = (2 * low + ((names >> low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        labels = _tossed(labels, first)
    start = np.zeros(len(labels), bool)
    start[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    last = first[1:] - 1
    start[last] = False           # a last symbol has no right neighbour
    start[first] = True
    return np.flatnonzero(start)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """The slots of each text as rows of 16-bit values; all texts are parsed side by side."""
    out = np.full((len(texts), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    names = _BYTES[np.frombuffer(b"".join(texts), np.uint8)]
    doc = np.repeat(np.arange(len(texts)), sizes)
    level = 0
    while len(names):
        # Runs become one symbol, named by symbol and length.
        edge = np.empty(len(names), bool)
        edge[0] = True
        edge[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(edge)
        if len(at) < len(names):
            length = np.diff(at, append=len(names)).astype(np.uint64)
            names, doc = names[at], doc[at]
            long = length > 1
            names[long] = _stirred(names[long] + length[long] * _RUN)
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        count = np.diff(first, append=len(names))
        done = count == 1
        if level >= FIRST_LEVEL:
            _keep(out, doc, names)
        elif done.any():
            _keep(out, doc[first[done]], names[first[done]])
        if done.any():            # texts parsed up to one name leave
            alive = ~done[np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))]
            names, doc = names[alive], doc[alive]
            if not len(names):
                break
            first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        starts = _phrase_starts(names, first)
        place = np.arange(len(names)) - np.repeat(starts, np.diff(starts, append=len(names)))
        names = _stirred(np.add.reduceat(names * _PLACES[place & 63], starts))
        doc = doc[starts]
        level += 1
    values = ((out * _STIR) >> np.uint64(48)).astype(np.uint16)
    values[values == EMPTY] = 0
    values[out == np.iinfo(np.uint64).max] = EMPTY
    return values


def _keep(out: np.ndarray, doc: np.ndarray, names: np.ndarray) -> None:
    slot = (names & np.uint64(SLOTS - 1)).astype(np.int64)
    np.minimum.at(out.reshape(-1), doc * SLOTS + slot, names >> np.uint64(6))


def all_fingerprints(texts: list[bytes]) -> np.ndarray:
    """As ``fingerprints``, about ``PART`` bytes at a time."""
    parts, now, held = [], [], 0
    for t in texts:
        if now and held + len(t) > PART:
            parts.append(fingerprints(now))
            now, held = [], 0
        now.append(t)
        held += len(t)
    if now:
        parts.append(fingerprints(now))
    return np.concatenate(parts) if parts else np.zeros((0, SLOTS), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dice's coefficient of two rows of slots each, from the share of used slots that agree."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    share = np.where(used > 0, same / np.maximum(used, 1), 1.0)
    return 2 * share / (1 + share)


def edited(text: str, following: str) -> str:
    """``text`` with its last half exchanged for the start of ``following``, by code points."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(ids: list, texts: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    """Result rows of all texts but the last, which follows them."""
    plain = [t.decode("utf-8", "replace") for t in texts]
    changed = [edited(a, b).encode() for a, b in zip(plain, plain[1:])]
    own, new = all_fingerprints(texts), all_fingerprints(changed)
    hexed = [[row.astype(">u2").tobytes().hex() for row in m] for m in (own[:-1], new)]
    columns = [ids[:-1], [len(p) for p in plain[:-1]], [hashlib.sha256(c).hexdigest() for c in changed], *hexed,
               likeness(own[:-1], new), likeness(own[:-1], own[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Texts are dealt into ranges of doc_id whose borders are quantiles. Each range
    also gets the first row of the range after it, so a row's successor is always
    in its own task. One shuffle moves the texts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = arrow_schema(spark, ROWS)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(LOWEST)).alias("place"), whole_text().alias("text"))
    cuts: list[int] = []
    if ranges > 1:
        shares = [k / ranges for k in range(1, ranges)]
        found = docs.where("doc_id is not null").agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0]
        cuts = sorted(set(found or []))
    # Range 0 holds the largest doc_ids, so ranges and rows run the same way.
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("place"))) if cuts else F.lit(0)
    ranged = keyed.withColumn("range", above.cast("int"))
    tops = [tuple(r) for r in ranged.groupBy("range").agg(F.max("place")).orderBy("range").collect()]   # one row a range
    needed_by = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}
    if needed_by:
        by = F.create_map(*[F.lit(x) for kv in needed_by.items() for x in kv])
        guests = ranged.where(F.col("place").isin(list(needed_by))).withColumn("range", by[F.col("place")])
        ranged = ranged.withColumn("guest", F.lit(0)).unionByName(guests.withColumn("guest", F.lit(1)))
    else:
        ranged = ranged.withColumn("guest", F.lit(0))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held_text, open_ = None, b"", False     # the row whose successor comes next
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = batch.column(2).to_pylist().count(0)
            if own < len(ids):           # the first guest follows the last row, others are its equals
                ids, texts = ids[:own + 1], texts[:own + 1]
            if open_:
                ids, texts = [held_id, *ids], [held_text, *texts]
            if len(texts) > 1:
                yield _rows(ids, texts, schema)
            if own < batch.num_rows:
                return
            if ids:
                held_id, held_text, open_ = ids[-1], texts[-1], True

    ordered = ranged.repartitionById(max(1, len(cuts) + 1), "range").sortWithinPartitions(
        "guest", F.col("place").desc(), "text")
    return ordered.select("doc_id", "text", "guest").mapInArrow(run, ROWS)


def op2_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read(spark, sf_dir, "documents"))
