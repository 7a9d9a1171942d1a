"""Tokenizer operators against their libraries, and the record files' round trip."""

import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from updraft.llm import pieces, records
from updraft.llm.common import SLICE_ROWS, shared_folder, written

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "\n", "é", "日", "本", "١", "²", "½", ".", "'s", "'ll", "0", "12", "the", "▁", "\x00", "\t", "İ",
         "<s>", "</s>", "́", "😀", "(", "ing", "  ", "ﬁ", "_", "ß", "word", "THE", "!", "\r\n", "\x1c", "\x85", "\xa0", "µ", "ª"]
ROWS = [(None, None), (3, "a b"), (1, ""), (3, "a a"), (3, "a a"), (-5, "z"), (9, "long " * 30_000)]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_pieces_equal_the_library():
    m = pieces.model(PIECES)
    for t in [*texts(5000, 1), "ab" * 5000 + "日本" * 300 + " " * 500 + "a" * 3000, "x" * 2000]:
        want = m.processor.encode(t) + [m.end_id]
        assert m.encode(t) == want
        assert m.decode(want) == m.processor.decode(want)


def test_prefix_table_equals_the_merges():
    m = pieces.model(PIECES)
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice("abcdefgh ist") for _ in range(rng.randint(1, 20)))
        assert m.tokens(t) == m.merged(t)


def test_what_a_worker_keeps_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_BYTES", 2 << 20, raising=False)
    monkeypatch.setattr(pieces, "PAIRS", 1000, raising=False)
    m, rng, most, pairs = pieces.PieceModel(PIECES), random.Random(4), 0, 0
    for _ in range(40):
        t = " ".join("".join(rng.choices("abcdefghinorst", k=8)) for _ in range(500)) + " " + "日本" * rng.randint(1, 20_000)
        want = m.processor.encode(t)
        ids = m.encode(t)
        assert ids == [*want, m.end_id] and m.decode(ids) == m.processor.decode(want)
        held = [x for k, v in m.chunks.items() for x in (k, *([v] if isinstance(v, bytes) else v))]
        most = max(most, sum(map(sys.getsizeof, held)) + sys.getsizeof(m.chunks))
        pairs = max(pairs, sum(len(known) for _, known, _ in m.automaton.values()))
    assert 0 < most <= 3 << 20 and 0 < pairs <= 1000


def test_batches_are_cut_into_slices(spark):
    n = 2 * SLICE_ROWS + 7
    df = spark.range(n).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("row "), "id").alias("text"))
    m = pieces.model(PIECES)
    got = {r.doc_id: r.ids for r in pieces.encode_documents(df, PIECES).collect()}
    assert got == {i: m.encode(f"row {i}") for i in range(n)}


def test_op6_rows(spark):
    m = pieces.model(PIECES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pieces.op6_pieces(spark, SF).collect():
        ids = m.processor.encode(docs[r.doc_id] or "") + [m.end_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(m.processor.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, path int")
    got = pieces.encode_documents(df, PIECES).collect()
    assert sorted(len(r.ids) for r in got)[:2] == [1, 1] and len(got) == len(ROWS)
    assert pieces.encode_documents(df.where("false"), PIECES).count() == 0


def test_words_encode_like_whole_texts():
    e = records.encoder(BYTES)
    for t in [*texts(5000, 3), "x<|endoftext|>y"]:
        assert np.frombuffer(e.encode(t), e.kind).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_checksums():
    def bitwise(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert bitwise(b"123456789") == 0xE3069283      # published check value
    data = [random.Random(n).randbytes(n) for n in (4, 8, 11, 511, 512, 513, 1024, 3000, 5)]
    for d, got in zip(data, records.masked_crc32c(data)):
        c = bitwise(d)
        assert int(got) == (((c >> 15) | (c << 17)) + records.MASK) & 0xFFFFFFFF


def test_op3_rows(spark):
    e, start, want = records.encoder(BYTES), 0, []
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = e.tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in records.op3_records(spark, SF).collect()) == want


def write(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string")
    return written(records.write_records(df, shared_folder(spark, "records"), BYTES), "manifest")


def test_records_of_odd_rows(spark):
    got = sorted(records.fetched(records.index_rows(write(spark, ROWS)), records._digest, records.DIGESTS).collect(),
                 key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -5, 1, 3, 3, 3, 9]
    assert [r.n_tokens for r in got][:3] == [1, 2, 1]
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    empty = write(spark, [])
    assert records.fetched(records.index_rows(empty), records._digest, records.DIGESTS).count() == 0


def test_shuffled_reads(spark):
    manifest = write(spark, [(i, f"text number {i}") for i in range(200)])
    one, two = (records.read_shuffled(manifest, s).collect() for s in (1, 2))
    assert sorted(map(tuple, [(r.doc_id, r.start) for r in one])) == sorted((r.doc_id, r.start) for r in two)
    assert [r.doc_id for r in one] != [r.doc_id for r in two]


def test_damage_is_an_error():
    payload = np.array((1, 2, 1, 7), records.HEADER).tobytes() + b"\x01\x00"
    head = len(payload).to_bytes(8, "little")
    checks = [int(records.masked_crc32c([x])[0]).to_bytes(4, "little") for x in (head, payload)]
    frame = head + checks[0] + payload + checks[1]
    assert records.unframed([frame])[0][0] == 7
    for at in (0, 9, 20, len(frame) - 1):
        broken = bytearray(frame)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.unframed([bytes(broken)])
