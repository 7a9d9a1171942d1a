"""Line dedup, whitening and the Merkle manifest against brute force."""

import hashlib
import random
import zlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from updraft.llm import lines, merkle, whitening
from updraft.llm.common import written
from updraft.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows, extra=()):
    """``documents`` rows (doc_id, text, lang, source, n_chars) with columns whose names clash with helper columns."""
    df = spark.createDataFrame(rows, DOCS)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    return df


# ---------------------------------------------------------------- line dedup

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def dedup_brute(rows, least_chars, least_documents):
    """(doc_id, n_lines, n_dropped, kept text) per row."""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if len(holders.get(key(x), ())) < least_documents
                or doc_id == max(h for h in [*holders[key(x)], None] if h is not None)]
        out.append((doc_id, len(split), len(split) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def dedup_spark(df, least_chars=lines.LEAST_CHARS, least_documents=lines.LEAST_DOCUMENTS):
    return sorted((tuple(r) for r in lines.dedup_lines(df, least_chars, least_documents).select(
        "doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pieces = ["Aa é", " aA É", "aa é\t", "\x0baa é", "bb", "", " ", " bb", "cc\r", "CC", "Ääb", "ääB"]
    rows = [(rng.choice([None, 0, 1, 2, 3, 4, 5, 6]), rng.choice([None, "", "\n", "\n\n"]) if rng.random() < 0.1 else
             "\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))) for _ in range(120)]
    df = docs_frame(spark, [(i, t, None, None, None) for i, t in rows],
                    ("at", "line", "key", "gone", "left", "text_key", "hash_a", "n", "keeper"))
    for least in (2, 4, 7):
        assert dedup_spark(df, 2, least) == dedup_brute(rows, 2, least)
    assert any(r[2] for r in dedup_brute(rows, 2, 4))


def test_hot_lines_go_by_broadcast_and_rare_ones_by_shuffle(spark, monkeypatch):
    hot, rare = "h" * 50, "r" * 50
    rows = [(i, f"{hot}\nown line {i}") for i in range(60)] + [(100 + i, f"{rare}\n{hot.upper()} ") for i in range(6)]
    df = docs_frame(spark, [(i, t, None, None, None) for i, t in rows])
    for share in (2, 1, 10_000):      # the hot hash alone, none, and both are broadcast
        monkeypatch.setattr(lines, "HOT_SHARE", share)
        assert dedup_spark(df) == dedup_brute(rows, 40, 5)


def test_long_texts_and_empty_tables_of_lines(spark):
    shared = "s" * 40
    long = "\n".join([shared, "x" * 2_000_000] * 3 + [shared, "short"] * 40_000)
    rows = [(1, long)] + [(i, shared) for i in range(2, 7)]
    got = dedup_spark(docs_frame(spark, [(i, t, None, None, None) for i, t in rows]))
    assert got == dedup_brute(rows, 40, 5)
    assert dedup_spark(docs_frame(spark, [])) == []


# ---------------------------------------------------------------- Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, i):
    for nodes in levels[:-1]:
        first = i - i % 3
        run = nodes[first:first + 3]
        yield "".join(run[:i - first]), "".join(run[i - first + 1:])
        i //= 3


def manifest_brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) per row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for members in groups.values():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            d = leaf((r[0], r[1].replace("\n", ""), *r[2:])) if hit else leaf(r)
            for left, right in path:
                d = sha(left + d + right)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), d,
                        d == top[-1][0]))
    return sorted(out, key=repr)


def manifest_spark(df):
    text = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
                  F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.verified(merkle.manifest(df, {"text": text}))
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                                                "verified").collect()), key=repr)


def test_manifest_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    sources = [None, "", "a", "B", "é", "\U0001f600"]
    rows = [(rng.choice([None, i, i, -i]), rng.choice([None, "", "é\n", "x\ny", "-", f"text {i}"]),
             rng.choice([None, "en"]), rng.choice(sources[:rng.choice([2, 6])]), rng.choice([None, i])) for i in range(150)]
    rows += rows[:10] + [(7, "lone", None, "zz", 1)]
    df = docs_frame(spark, rows, ("leaf", "tie", "part", "row", "at", "n", "block", "d", "path", "salt", "root"))
    whole = manifest_brute(rows)
    assert manifest_spark(df) == whole
    monkeypatch.setattr(merkle, "LEVELS", 1)      # many blocks: paths are put together from tiers
    assert manifest_spark(df) == whole


def test_trees_of_every_shape_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    sizes = [1, 2, 3, 4, 9, 10, 28, *[1] * 23]      # of 30 sources
    rows = [(100 * k + i, "t\n" * (1 << 18 if i == 1 else 1), "en", f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    assert manifest_spark(docs_frame(spark, rows)) == manifest_brute(rows)


def test_empty_and_single_manifests(spark):
    assert manifest_spark(docs_frame(spark, [])) == []
    assert manifest_spark(docs_frame(spark, [(3, None, None, None, None)])) == manifest_brute([(3, None, None, None, None)])


def test_tampering_shows(spark):
    out = QUERIES["op13_merkle"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").collect()
    for r in out:
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (r.text or "")
        assert r.verified is not changed


# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, n string, ids string"


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)


def whiten_brute(rows, wanted=whitening.COMPONENTS):
    """Integers, eigenvalues and eigenvectors of the valid rows, with numpy's own solver."""
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) and abs(c) < whitening.LIMIT for c in v)]
    x = np.floor(1024 * np.array([v for _, v in good], np.float32).astype(float)) + 100000
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    return [i for i, _ in good], x, values[::-1][:wanted], vectors[:, ::-1][:, :wanted], values.sum()


def check_whitened(rows, got):
    ids, x, values, vectors, trace = whiten_brute(rows)
    n = len(ids)
    sums = [int(s) for s in x.sum(axis=0)]
    table = {(r.vec_id, r.component): r for r in got}
    k = max(r.component for r in got)
    assert len(got) == n * k and {r.n for r in got} == {n}
    scores = np.array([[table[i, j + 1].whitened for j in range(k)] for i in ids])
    for j in range(k):
        theirs = (x - x.mean(axis=0)) @ vectors[:, j] / np.sqrt(values[j])
        assert min(np.abs(scores[:, j] - s * theirs).max() for s in (1, -1)) < 1e-6
        assert abs(table[ids[0], j + 1].explained / (values[j] / trace) - 1) < 1e-9
    for i, row in zip(ids, x):
        assert table[i, 1].deviation == sum((n * int(v) - s) ** 2 for v, s in zip(row, sums))
    error = np.abs(np.cov(scores.T, bias=True) - np.eye(k)).max()
    assert error < 1e-9 and all(r.identity_error < 1e-9 for r in got)


def test_whitening_against_a_dense_solver(spark):
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((40, 40)) * np.linspace(3, 0.2, 40)
    rows = [(i, (rng.standard_normal(40) @ mix).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000, None), (1001, rows[0][1][:39] + [None]), (1002, rows[0][1][:39] + [float("nan")]),
             (1003, rows[0][1][:39] + [float("inf")]), (1004, []), (1005, rows[0][1][:7]), (1006, rows[3][1]),
             (1007, rows[0][1][:39] + [1e30])]
    got = whitening.whiten(vectors_frame(spark, rows)).collect()
    check_whitened([r for r in rows if r[1] is None or len(r[1]) == 40], got)


def test_query_on_the_smallest_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(rows, QUERIES["op12_chebyshev"](spark, SF).collect())


def test_few_degenerate_and_empty_vectors(spark):
    assert whitening.whiten(vectors_frame(spark, [])).collect() == []
    assert whitening.whiten(vectors_frame(spark, [(1, [1.0, 2.0])] * 3)).collect() == []
    line = whitening.whiten(vectors_frame(spark, [(None, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 5 and all(abs(r.explained - 1) < 1e-12 for r in line)
    assert all(r.vec_id is None for r in line)
    tied = [(i, v) for i, v in enumerate(np.vstack([np.eye(3), -np.eye(3)]).tolist())]
    got = whitening.whiten(vectors_frame(spark, tied)).collect()
    assert len(got) == 18 and all(abs(r.identity_error) < 1e-9 for r in got)


def test_exact_sums_of_large_entries(spark):
    rows = [(i, [float(v), -float(v)]) for i, v in enumerate([2 ** 34, 3 * 2 ** 30, -2 ** 33, 5, 2 ** 22])]
    blocks = written(whitening.pack(whitening.valid_vectors(vectors_frame(spark, rows))), "blocks")
    z = [[int(np.floor(1024 * np.float64(np.float32(c)))) for c in v] for _, v in rows]
    n, sums, squares = whitening.block_sums(blocks)
    assert n == 5 and squares == sum(c * c for v in z for c in v)
    assert [int(s) for s in sums] == [sum(c) for c in zip(*z)]
    assert all(r.deviation is None for r in whitening.whiten(vectors_frame(spark, rows)).collect())


def test_iteration_certifies_or_fails():
    rng = np.random.default_rng(2)
    for dim, gap in ((3, 0.5), (64, 1e-4), (200, 0.01)):
        values = np.sort(np.concatenate([1 + gap * np.arange(min(dim, 10)), rng.random(max(0, dim - 10))]))[::-1]
        basis, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        v = (basis * values) @ basis.T
        got, vectors, passes, residual = whitening.leading_components(lambda q: v @ q, dim)
        k = min(dim, 8)
        assert np.abs(got - values[:k]).max() < 1e-12 and residual <= whitening.CERTIFIED
        assert np.abs(np.abs((vectors * basis[:, :k]).sum(axis=0)) - 1).max() < 1e-10
    with pytest.raises(RuntimeError):
        whitening.leading_components(lambda q: rng.standard_normal(q.shape), 50)


def test_wide_rows_keep_their_digits(spark):
    assert whitening._packed([1], np.array([[2 ** 40, -3]]))[2:] == (
        True, np.array([2 ** 40, -3], "<i8").tobytes(), [2 ** 40, -3], 2 ** 80 + 9)
    assert whitening._decimals([5], whitening.arrow_schema(spark, "s decimal(38,0)")[0].type) == [Decimal(5)]
