"""Token sequences as length-delimited binary records with a separate offset index.

A shard file is a sequence of records:

    length   u64 little-endian, bytes of the payload
    check    u32, masked CRC-32C of the 8 length bytes
    payload  version u8, id width u8 (2 or 4), doc_id present u8, doc_id i64, ids
    check    u32, masked CRC-32C of the payload

Its index file holds, per record in the same order, doc_id i64, present u8, offset
u64, payload bytes u64 and ids u64, so that any order of reads can be planned from
the indexes alone. Shards are ranges of doc_id and numbered in that order; a task
writes its shard under a name of its own and renames it when whole, so that a task
that runs again replaces equal bytes.

* Null text counts as empty: such a record holds the end id alone.
* Null doc_ids come first; equal ones are ordered by text. Other columns are not read.
* An empty table writes no shards and reads back as no rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from updraft.llm.common import arrow_schema, read, shared_folder, small_batches, whole_text, written

MANIFEST = "folder string, shard long, records long, tokens long, bytes long"
INDEX = "folder string, shard long, base long, doc_id long, start long, n_tokens long, offset long, bytes long"
DIGESTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
VERSION = 1
HEADER = np.dtype([("version", "u1"), ("width", "u1"), ("present", "u1"), ("doc_id", "<i8")])
ENTRY = np.dtype([("doc_id", "<i8"), ("present", "u1"), ("offset", "<u8"), ("bytes", "<u8"), ("ids", "<u8")])
FRAME = 16          # bytes around a payload
CACHE = 800_000     # words kept per worker process
BLOCK = 512         # bytes that one lane of the checksum takes
PIECE = 8 << 20     # payload bytes checked and written at once
MASK = 0xA282EAD8   # fixed value of the record format

#: The vocabulary's splitting pattern for texts of the characters below; other texts go to the library whole.
SIMPLE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|"
                    r" ?[^ \t\n\r\f\v0-9A-Za-zÀ-ÖØ-öø-ÿ]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")
OTHER = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]")
_ENCODERS: dict[str, "Encoder"] = {}


def _step_table() -> np.ndarray:
    """CRC-32C of every 16-bit value: one step takes two bytes."""
    c = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0x82F63B78), np.uint32(0))
    return c


_STEP = _step_table()


def _zeros_tables() -> tuple[np.ndarray, np.ndarray]:
    """State after ``BLOCK`` zero bytes, for the low and the high half of the state before."""
    def after(s: np.ndarray) -> np.ndarray:
        for _ in range(BLOCK // 2):
            s = _STEP[s & np.uint32(0xFFFF)] ^ (s >> np.uint32(16))
        return s

    half = np.arange(1 << 16, dtype=np.uint32)
    return after(half), after(half << np.uint32(16))


_LOW, _HIGH = _zeros_tables()


def masked_crc32c(payloads: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each payload (of four bytes or more), blocks of all payloads side by side.

    Payloads are aligned to the end of whole blocks: zeros before the first byte do
    not change a zero state, and the state of all ones is the first four bytes inverted.
    """
    if not payloads:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(p) for p in payloads], np.int64)
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
    for p, size, end in zip(payloads, sizes.tolist(), (ends * BLOCK).tolist()):
        data[end - size:end] = np.frombuffer(p, np.uint8)
    for k in range(4):
        data[ends * BLOCK - sizes + k] ^= 0xFF
    lanes = np.ascontiguousarray(data.view("<u2").reshape(-1, BLOCK // 2).T)
    state = np.zeros(lanes.shape[1], np.uint32)
    for word in lanes:
        state = _STEP[(state ^ word) & np.uint32(0xFFFF)] ^ (state >> np.uint32(16))
    first = ends - blocks
    total = state[first].copy()
    order = np.argsort(-blocks, kind="stable")
    counts = blocks[order]
    for k in range(1, int(counts[0])):
        live = order[:np.searchsorted(-counts, -k, "left")]      # payloads with more than k blocks
        s = total[live]
        total[live] = _LOW[s & np.uint32(0xFFFF)] ^ _HIGH[s >> np.uint32(16)] ^ state[first[live] + k]
    c = (total ^ np.uint32(0xFFFFFFFF)).astype(np.uint64)
    return ((((c >> np.uint64(15)) | (c << np.uint64(17))) + np.uint64(MASK)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Encoder(dict):
    """Ids of whole texts by the tokenizers library, word by word: words repeat, merges never cross them."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = self.whole(word)
        return value

    def whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian integers of the encoder's width."""
        if text.isascii():
            other = any(c in text for c in "\x1c\x1d\x1e\x1f")
        else:
            other = OTHER.search(text)
        if other or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, SIMPLE.findall(text)))


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path.rstrip("/")


class _ShardWriter:
    """Frames payloads into a data file and an index file that appear under their names when whole."""

    def __init__(self, folder: str, shard: int, attempt: int):
        self.system, path = _open(folder)
        self.system.create_dir(path, recursive=True)
        self.name = f"{path}/shard-{shard:06d}"
        self.temporary = f"{self.name}.{attempt}"
        self.data = self.system.open_output_stream(f"{self.temporary}.rec.tmp")
        self.index = self.system.open_output_stream(f"{self.temporary}.idx.tmp")
        self.offset = self.records = self.tokens = 0

    def add(self, ids: list[int | None], payloads: list[bytes], counts: list[int]) -> None:
        sizes = np.array([len(p) for p in payloads], "<u8")
        heads = [s.tobytes() for s in sizes]
        head_checks, checks = masked_crc32c(heads), masked_crc32c(payloads)
        parts = []
        for head, a, payload, b in zip(heads, head_checks.astype("<u4"), payloads, checks.astype("<u4")):
            parts += (head, a.tobytes(), payload, b.tobytes())
        self.data.write(b"".join(parts))
        entries = np.zeros(len(ids), ENTRY)
        entries["doc_id"] = [i or 0 for i in ids]
        entries["present"] = [i is not None for i in ids]
        step = sizes.astype(np.int64) + FRAME
        entries["offset"] = self.offset + np.cumsum(step) - step
        entries["bytes"], entries["ids"] = sizes, counts
        self.index.write(entries.tobytes())
        self.offset += int(step.sum())
        self.records += len(ids)
        self.tokens += sum(counts)

    def close(self) -> None:
        for stream, end in ((self.data, "rec"), (self.index, "idx")):
            stream.close()
            self.system.move(f"{self.temporary}.{end}.tmp", f"{self.name}.{end}")


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the shards of ``docs`` below ``folder``; one manifest row a shard. Lazy: store it to run it."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = arrow_schema(spark, MANIFEST)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, shard = TaskContext.get(), None
        encode = encoder(tokenizer)
        end = np.array([end_id], encode.kind).tobytes()
        for batch in it:
            if not batch.num_rows:
                continue
            if shard is None:
                shard = _ShardWriter(folder, context.partitionId(), context.taskAttemptId())
            ids, payloads, counts, held = [], [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = encode.encode(text.decode("utf-8", "replace")) + end
                head = np.array((VERSION, encode.width, doc_id is not None, doc_id or 0), HEADER).tobytes()
                ids.append(doc_id)
                payloads.append(head + tokens)
                counts.append(len(tokens) // encode.width)
                held += len(tokens)
                if held >= PIECE:
                    shard.add(ids, payloads, counts)
                    ids, payloads, counts, held = [], [], [], 0
            if ids:
                shard.add(ids, payloads, counts)
        if shard is not None:
            shard.close()
            row = (folder, context.partitionId(), shard.records, shard.tokens, shard.offset)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    # Ranges of doc_id alone, so that no text is among the keys that the driver samples.
    ordered = docs.select("doc_id", whole_text().alias("text")).repartitionByRange("doc_id").sortWithinPartitions(
        "doc_id", "text")
    return ordered.mapInArrow(run, MANIFEST)


def index_rows(manifest: DataFrame) -> DataFrame:
    """One row per record of the shards in ``manifest``, in file order within a shard.

    ``start`` counts the ids of all records before it; the sums over shards are a
    window over one row a shard.
    """
    spark = manifest.sparkSession
    small_batches(spark)
    schema = arrow_schema(spark, INDEX)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("folder", "shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for folder, shard, base in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = _open(folder)
                with system.open_input_stream(f"{path}/shard-{shard:06d}.idx") as f:
                    e = np.frombuffer(f.read(), ENTRY)
                n = len(e)
                ids = pa.array(e["doc_id"].astype(np.int64), mask=e["present"] == 0)
                counts = e["ids"].astype(np.int64)
                columns = [pa.array([folder] * n), pa.array(np.full(n, shard)), pa.array(np.full(n, base)), ids,
                           pa.array(base + np.cumsum(counts) - counts), pa.array(counts),
                           pa.array(e["offset"].astype(np.int64)), pa.array(e["bytes"].astype(np.int64))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    # A number of tasks of its own: the rows are few and small, the files behind them are not.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(tasks, "shard").mapInArrow(run, INDEX)


def fetched(index: DataFrame, row, ddl: str) -> DataFrame:
    """``row(index row, ids)`` for each index row, its record read at its offset and both checksums compared.

    Any order and subset of index rows will do: shuffle them for shuffled reads.
    """
    spark = index.sparkSession
    small_batches(spark)
    schema = arrow_schema(spark, ddl)
    names = index.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in it:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                part, size = [], 0
                while at < len(rows) and (not part or size + rows[at]["bytes"] <= PIECE):
                    part.append(rows[at])
                    size += rows[at]["bytes"]
                    at += 1
                frames = []
                for r in part:
                    if (r["folder"], r["shard"]) != name:
                        name = r["folder"], r["shard"]
                        system, path = _open(name[0])
                        file = system.open_input_file(f"{path}/shard-{name[1]:06d}.rec")
                    file.seek(r["offset"])
                    frames.append(file.read(r["bytes"] + FRAME))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*map(row, part, unframed(frames))), schema)], schema=schema)

    return index.select(*names).mapInArrow(run, ddl)


def unframed(frames: list[bytes]) -> list[tuple[int | None, np.ndarray]]:
    """doc_id and ids of whole records; a wrong length or checksum is an error."""
    heads, payloads = [f[:8] for f in frames], [f[12:-4] for f in frames]
    said = np.array([int.from_bytes(h, "little") for h in heads])
    checks = np.array([[int.from_bytes(f[8:12], "little"), int.from_bytes(f[-4:], "little")] for f in frames], np.uint32)
    if not ((said == [len(p) for p in payloads]).all() and (checks[:, 0] == masked_crc32c(heads)).all()
            and (checks[:, 1] == masked_crc32c(payloads)).all()):
        raise ValueError("a record is damaged")
    out = []
    for p in payloads:
        head = np.frombuffer(p, HEADER, 1)[0]
        out.append((int(head["doc_id"]) if head["present"] else None,
                    np.frombuffer(p, f"<u{head['width']}", offset=HEADER.itemsize)))
    return out


def _digest(entry: dict, record: tuple[int | None, np.ndarray]) -> tuple:
    doc_id, ids = record
    return doc_id, entry["start"], len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def _whole(entry: dict, record: tuple[int | None, np.ndarray]) -> tuple:
    return record[0], entry["start"], record[1]


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """doc_id, start and ids of every record, in an order drawn by ``seed``."""
    index = index_rows(manifest)
    mixed = index.withColumn("draw", F.xxhash64("shard", "offset", F.lit(seed)))
    ordered = mixed.repartition("draw").sortWithinPartitions("draw").drop("draw")
    return fetched(ordered, _whole, "doc_id long, start long, ids array<int>")


def op3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "records")
    manifest = written(write_records(read(spark, sf_dir, "documents"), folder,
                                     public_tokenizers.path("byte_bpe_50k.json")), "manifest")
    return fetched(index_rows(manifest), _digest, DIGESTS)
