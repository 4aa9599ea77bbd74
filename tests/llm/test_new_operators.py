import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from ductwise.llm import suffixes, trie, whitening

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_whitening(rows):
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    return kept, n, sums, np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])


def test_whitening_equals_a_plain_computation(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    kept, n, sums, centred = plain_whitening([(r.vec_id, r.embedding) for r in vectors.collect()])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    rows = whitening.whiten(*whitening.fit(vectors)).collect()
    assert len(rows) == 16 * len(kept) and {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-9
    got = {(r.vec_id, r.component): r for r in rows}
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in kept}
    for k in range(16):
        want = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for _, x in kept]) @ axes[:, k] / np.sqrt(values[k])
        have = np.array([got[i, k + 1].whitened for i, _ in kept])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-8
        assert abs(got[kept[0][0], k + 1].explained / (values[k] / values.sum()) - 1) < 1e-10
    assert all(r.deviation == deviation[r.vec_id] for r in rows)


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 33):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        scale = 10.0 ** -np.arange(d)[: max(d, 1)] if d <= 8 else np.linspace(1, 9, d)
        m = np.diag(scale) @ (q @ np.diag(np.linspace(1, 3, d)) @ q.T) @ np.diag(scale)
        values, axes = whitening.jacobi(m)
        assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-12) and np.allclose(axes @ np.diag(values) @ axes.T, m, atol=1e-12)
        assert abs(np.log(values).sum() - (2 * np.log(scale).sum() + np.log(np.linspace(1, 3, d)).sum())) < 1e-8  # the determinant holds the smallest


def test_whitening_takes_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [1.0, 0.5]), (None, [0.25, -1.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, []), (8, [1.0]), (9, [1.0, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n string")
    got = whitening.whiten(*whitening.fit(df)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, k) for i in (1, 1, 2, 0, 9) for k in (1, 2))
    assert {r.n for r in got} == {3} and max(r.identity_error for r in got) < 1e-12
    for few in (df.where("vec_id = 1"), df.limit(0), df.where("vec_id = 7")):
        assert whitening.whiten(*whitening.fit(few)).count() == 0
    large = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(*whitening.fit(large)).count() == 3  # the other direction is rounding beside the first


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    full = {c: own.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + v[h:] for c, v in own.items()}
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
            if d:
                children[tuple(full[c][: d - 1])].add(tuple(full[c][:d]))
        ends[tuple(full[c])].append(c)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves = sum(out[b][5] for b in below) or 1
        saved = (len(members[node]) - 1) * len(WORDS.findall(node[-1][1])) if node else 0
        saved += sum(out[b][6] for b in below)
        out[node] = (members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(below), leaves, saved, hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
    return sorted(out.values(), key=str)


CONVERSATIONS = "text string, conv_id long, role string, turn int, n long"


def test_trie_equals_a_plain_computation(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = plain_trie([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert sorted((tuple(r)[:8] for r in trie.trie(table).collect()), key=str) == want


@pytest.mark.parametrize("seed", [0, 1])
def test_trie_of_odd_conversations(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(str(rng.choice(["a b", "a", "", "c  d e"])), int(c), str(rng.choice(["u", "v"])), int(t), 9) for c in rng.integers(0, 60, 40) for t in range(rng.integers(1, 13))]
    rows += [("x", 3, "u", None, 1), (None, 4, None, None, 1), (None, 4, None, None, 1), ("lost", None, "u", 1, 1), ("a", 77, "u", 1, 1), ("a" * 5000, 78, "u", 1, 1), ("a", 61, None, 5, 1), ("a", -7, "u", 5, 1)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    got = trie.trie(df).collect()
    plain = [(r.conv_id, r.turn, r.role, r.text) for r in df.where("conv_id >= 0 OR conv_id IS NULL").collect()]
    assert sorted((tuple(r)[:8] for r in trie.trie(df.where("conv_id >= 0 OR conv_id IS NULL")).collect()), key=str) == sorted(plain_trie(plain), key=str)
    assert len({r.preorder for r in got}) == len(got) == max(r.subtree_end for r in got) + 1 and all(r.preorder <= r.subtree_end for r in got)
    assert trie.trie(df.limit(0)).count() == 0
    lone = trie.trie(df.where("conv_id = 77")).collect()  # crc32 decides what is left of it
    assert lone[0].n_convs == 1 and [tuple(r)[:8] for r in sorted(lone, key=lambda r: r.depth)] == sorted(plain_trie([(77, 1, "u", "a")]), key=lambda r: r[1])


def plain_repeats(rows, length):
    """(doc_id, spans, kept) of each row, from a table of all windows."""
    least = {}
    for i, text in rows:
        b = (text or "").encode()
        if i is not None:
            for s in range(len(b) - length + 1):
                w = b[s : s + length]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        if i is not None:
            for s in range(len(b) - length + 1):
                if least[b[s : s + length]] < i:
                    gone[s + 1 : s + length + 1] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2).tolist()
        out.append((i, len(b), tuple(map(tuple, edge)), bytes(c for c, g in zip(b, gone[1:]) if not g)))
    return sorted(out, key=str)


def cleaned(df, length=50, **sizes):
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(df, length, **sizes).collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_repeats_equal_a_plain_search(spark, seed):
    rng = np.random.default_rng(seed)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passages = [text(n) for n in (50, 51, 63, 80, 120, 49, 500)] + ["a" * 130, "ab" * 60]
    rows = []
    for i in range(160):
        parts = [text(int(rng.integers(0, 60)))]
        for _ in range(int(rng.integers(0, 4))):
            p = str(rng.choice(passages))
            cut = int(rng.integers(0, 8))
            parts += [p[cut:] if rng.random() < 0.5 else p, text(int(rng.integers(0, 40)))]
        rows.append((int(rng.permutation(1000)[0]), "".join(parts)))
    for _ in range(20):  # near copies
        t = list(rows[int(rng.integers(160))][1])
        for k in rng.integers(0, max(len(t), 1), 3 if t else 0):
            t[k] = "x"
        rows.append((int(rng.integers(1000, 1100)), "".join(t)))
    rows += [(int(k), passages[4]) for k in range(2000, 2060)]  # one passage in a third of all rows
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_repeats(rows, 50)
    assert sum(len(r[2]) for r in want) > 100
    assert cleaned(df) == want
    assert cleaned(df, bucket_bytes=2000, bucket_windows=100) == want  # many buckets, runs over several of them


def test_repeats_of_other_lengths_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("abc "), 900))) for i in range(12)]
    rows += [(i + 20, t[100:400] + "-" + t[500:590]) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (48, 77, 130):
        assert cleaned(df, length, bucket_bytes=3000) == plain_repeats(rows, length)
    data = "".join(t for _, t in rows).encode()
    edges = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])
    whole = suffixes.units(np.frombuffer(data, np.uint8), edges, 50)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    parts = suffixes.units(np.frombuffer(data, np.uint8), edges, 50)
    windows = lambda x: {(u["d"], o) for u in x for o in range(u["o"], u["o"] + u["n"] + 1)}
    assert windows(whole) == windows(parts) == {(d, o) for d, (_, t) in enumerate(rows) for o in range(len(t) - 49)}
    with pytest.raises(ValueError):
        suffixes.repeats(df, 20)


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, k, 30_000).astype(np.uint64) for k in (3, 50, 2**62)]
    order = suffixes.multikey_quicksort(words, few=16)
    assert (np.diff([words[0][order].astype(float), words[1][order].astype(float)]) >= 0)[0].all()
    rows = list(zip(*(w[order].tolist() for w in words)))
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(30_000))


def test_repeats_take_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert cleaned(odd_docs) == plain_repeats(rows, 50)
    assert cleaned(no_docs) == []
    same = "a passage that is long enough to be found in several of the documents here"
    rows = [(1, same), (1, same + "!"), (2, same), (2, "-" + same), (2, same), (None, same), (3, None), (0, "short")]
    df = spark.createDataFrame([(None, i, t) for i, t in rows], "h string, doc_id long, text string")
    assert cleaned(df) == plain_repeats(rows, 50)


def test_repeats_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert cleaned(docs, bucket_bytes=50_000, bucket_windows=5000) == plain_repeats(rows, 50)
