"""Near-duplicate classes, components and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from updraft.llm import near, phrases
from updraft.llm.components import components

SF = "/root/testdata/sf0.001"


def classes(rows):
    """(doc_id, set size, smallest doc_id of the component) of each row, by all shared shingles."""
    sets, holders, root = [], {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, text) in enumerate(rows):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        s = set() if not w else {tuple(w)} if len(w) < 5 else set(zip(*(w[j:] for j in range(5))))
        sets.append(s)
        common = {}
        for g in s:
            for o in holders.get(g, ()):
                common[o] = common.get(o, 0) + 1
            holders.setdefault(g, []).append(k)
        for o, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = find(k), find(o)
                root[max(a, b)] = min(a, b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_op5_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = near.op5_lsh_forest(spark, SF)
    assert got(out) == classes(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_odd_rows(spark):
    rows = [(5, "a b c d e f g h"), (3, "A B c d e f g h"), (None, "a b c d e f g h"), (None, "solo text here no id ok"),
            (7, ""), (8, None), (9, " \n\t "), (10, "one two"), (11, "ONE two"), (12, "one two three"), (5, "other text"),
            (5, "other text"), (2, "other text"), (13, "É b c d e"), (14, "é b c d e")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, key string")
    out = near.classify(df)
    assert got(out) == classes(rows)
    assert [r.kept for r in out.where("doc_id is null").collect()].count(True) == 1     # the lone one
    assert near.classify(df.where("false")).count() == 0


def test_dense_group_and_borderline(spark):
    """A large group of near copies around the threshold, most of whose pairs are under it."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(300):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3))):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"v{k}_{i}" for i in range(60))) for k in range(50)]
    assert got(near.classify(spark.createDataFrame(rows, "doc_id long, text string"))) == classes(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    links += [(2000, 2000 + i) for i in range(80)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root) if any(find(y) == find(x) for y in root if y != x)}
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def following(rows):
    low = -(1 << 63)
    rows = sorted(rows, key=lambda r: (-(low if r[0] is None else r[0]), (r[1] or "").encode()))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - half] + n[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [
    [(1, "héllo wörld"), (5, None), (None, "x y z"), (None, None), (5, "zz top zz"), (3, ""), (3, ""), (9, "😀😀😀")],
    [(1, "abc")], [(None, "abcd"), (None, "ef")], [(i, f"text {i} " * i) for i in range(40)]])
def test_edited_texts(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, range int")
    out = phrases.fingerprint_documents(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=str) == following(rows)


def test_op2_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = phrases.op2_phrases(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in out), key=str) == following(rows)
    texts, prints = dict(rows), {}
    for r in out:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = [r for r in out if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.4 > 0.1 > np.mean([r.near_next for r in long])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert phrases.fingerprint_documents(empty).count() == 0


def test_equal_substrings_share_names_at_any_offset():
    rng = random.Random(9)
    a, b = rng.randbytes(6000), rng.randbytes(6000)
    f = phrases.fingerprints([a, b"xyz" + a, b, a[:3000] + b[:3000], rng.randbytes(3001) + a, b"", b"q", b"a" * 50])
    like = phrases.likeness(np.repeat(f[:1], len(f), axis=0), f)
    assert like[1] > 0.9 and like[2] < 0.1 and 0.3 < like[3] < 0.7 and like[4] > 0.6
    assert phrases.likeness(f[5:6], f[5:6])[0] == 1 and phrases.likeness(f[5:6], f[6:7])[0] == 0
    assert (phrases.fingerprints([b"q", a])[1] == f[0]).all()      # whatever is parsed beside it


def test_labels_are_local():
    """A change far to the left leaves later phrase starts where they were."""
    rng = np.random.default_rng(3)
    names = rng.integers(1, 1 << 62, 500, dtype=np.uint64)
    other = names.copy()
    other[:20] = rng.integers(1, 1 << 62, 20, dtype=np.uint64)
    first = np.array([0])
    a, b = phrases._phrase_starts(names, first), phrases._phrase_starts(other, first)
    assert a[a > 30].tolist() == b[b > 30].tolist()
    assert np.diff(a).max() <= 12


def test_pairs_in_dense_regions_are_all_found(spark, monkeypatch):
    """Texts of one template, too unlike to be linked, hide the pairs among them when few neighbours are in reach."""
    monkeypatch.setattr(near, "FIRST_TREES", 1)
    monkeypatch.setattr(near, "OTHER_TREES", 24)
    monkeypatch.setattr(near, "REACH", 1)
    rng = random.Random(8)
    template, texts = [f"w{i}" for i in range(104)], []
    for k in range(400):
        texts.append(template + [f"u{k}_{i}" for i in range(20)])
    for k in range(0, 400, 10):        # a partner whose likeness is little above the threshold
        words = list(texts[k])
        for at in rng.sample(range(4, 120, 8), 3):
            words[at] = f"y{k}_{at}"
        texts.append(words)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    assert got(near.classify(spark.createDataFrame(rows, "doc_id long, text string"))) == classes(rows)


def test_prefix_join_is_exact(spark):
    """The join alone finds every similar pair of different roots, and only pairs of different roots."""
    rng = random.Random(5)
    sets = []
    for k in range(60):
        base = rng.sample(range(1, 4000), rng.choice((1, 2, 3, 30, 80)))
        for _ in range(4):
            kept = [x for x in base if rng.random() > rng.choice((0, 0.05, 0.15))] or base[:1]
            sets.append(np.unique(np.array(kept + rng.sample(range(1, 4000), rng.choice((0, 1, 5))), np.uint64)))
    names = [bytes([k // 250, k % 250] + [0] * 14) for k in range(len(sets))]
    roots = [names[k - k % 2] for k in range(len(sets))]
    rows = [(n, r, s.view(np.uint8).reshape(-1, 8)[:, :near.SET_BYTES].tobytes()) for n, r, s in zip(names, roots, sets)]
    df = spark.createDataFrame(rows, "node binary, root binary, hashes binary")
    pairs = near.prefix_pairs(df)
    root = dict(zip(names, roots))
    assert all(root[bytes(p.a)] != root[bytes(p.b)] for p in pairs.collect())
    want = {(names[i], names[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if roots[i] != roots[j]
            and 4 * (both := near.shingles.overlap(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j]) - both)}
    assert want and {(bytes(p.a), bytes(p.b)) for p in near.confirmed(pairs, df).collect()} == want


def test_near_copies_of_any_length_share_names():
    """Texts on either side of 256 bytes, and a text of one run parsed beside a short one."""
    rng = random.Random(6)
    likes = []
    for _ in range(20):
        long = bytes(rng.choice(b"abcdefghij klmnop") for _ in range(260))
        f = phrases.fingerprints([long, long[:250]])
        likes.append(phrases.likeness(f[:1], f[1:])[0])
    assert np.mean(likes) > 0.85
    run = b"-" * 300 + b"\n"
    alone = phrases.fingerprints([run])[0]
    assert (alone != phrases.EMPTY).any()
    assert (phrases.fingerprints([run, b"some short text"])[0] == alone).all()
