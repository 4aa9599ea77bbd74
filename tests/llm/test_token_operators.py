import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ductwise.llm import bpe, packing, queries, tokenbin
from ductwise.llm.tokens import BatchEncoder

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="session")
def own():
    return BatchEncoder(JSON, P.PATTERN)


def split(ids, counts):
    edge = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(edge[:-1], edge[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z9,.!'\n\t\r\0é日😀  s"), max_size=40), max_size=5))
def test_units_give_the_ids_of_whole_texts(texts):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}) if not hasattr(test_units_give_the_ids_of_whole_texts, "enc") else test_units_give_the_ids_of_whole_texts.enc
    test_units_give_the_ids_of_whole_texts.enc = enc
    mine = getattr(test_units_give_the_ids_of_whole_texts, "mine", None) or BatchEncoder(JSON, P.PATTERN, cache_units=50)
    test_units_give_the_ids_of_whole_texts.mine = mine
    assert split(*mine.encode(texts)) == [enc.encode_ordinary(t) for t in texts]


def test_op4_equals_tiktoken(spark, odd_docs, no_docs, tik):
    rows = bpe.digests(odd_docs, RANKS, P.PATTERN).collect()
    texts = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    want = sorted((str(i), len(x := tik.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe.digests(no_docs, RANKS, P.PATTERN).count() == 0


def test_offsets_of_the_query(spark, odd_docs):
    rows = odd_docs.where("doc_id IN (10, 13)")
    want = {r.doc_id: zlib.crc32(np.array([*r.byte_start, *r.char_start], "<u4").tobytes()) for r in bpe.encode_frame(rows, RANKS, P.PATTERN).collect()}
    assert {r.doc_id: r.offsets_crc32 for r in bpe.digests(rows, RANKS, P.PATTERN).collect()} == want


def test_another_pattern_is_an_error():
    with pytest.raises(ValueError):
        BatchEncoder(JSON, r"\S+|\s+")


def test_reduction_fixes_triples():
    fixed, left = packing.reduce_instance({12: 1, 5: 1, 3: 1, 4: 1}, 20)
    assert fixed[0] == ((12, 5, 3), 1) and left == {} or left == {4: 1}


def test_offsets_point_at_the_characters(spark, odd_docs):
    for r in bpe.encode_frame(odd_docs.where("doc_id = 10"), RANKS, P.PATTERN).collect():
        text = bytes(r.decoded).decode()
        raw = text.encode()
        assert r.byte_start[0] == 0 and len(r.ids) == len(r.byte_start) == len(r.char_start)
        for b, c in zip(r.byte_start, r.char_start):
            before = len(text[:c].encode())
            assert before <= b < before + len(text[c].encode()) <= len(raw)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, offsets = tokenbin.pack(v)
    assert (tokenbin.unpack(words, offsets, len(v)) == v).all()


def brute_ids(texts, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    return [tok.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_op6(docs, rows):
    by = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = brute_ids([t for _, t in by], 0)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted((str(d), len(x), crc(x)) for (d, _), x in zip(by, ids))
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_op6(spark, odd_docs, no_docs):
    out = tokenbin.read_tokens(tokenbin.write_tokens(odd_docs, JSON, P.PATTERN)).collect()
    check_op6([(r.doc_id, r.text) for r in odd_docs.collect()], out)
    assert tokenbin.read_tokens(tokenbin.write_tokens(no_docs, JSON, P.PATTERN)).count() == 0
    sf = "/root/testdata/sf0.001"
    check_op6([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], queries.op6_token_binary(spark, sf).collect())


def check_op8(docs, rows, capacity=1024):
    whole = sorted((str(d), len(x)) for (d, _), x in zip(docs, brute_ids([t for _, t in docs], 2)))
    got, per = {}, {}
    for r in rows:
        assert 0 < r.length <= capacity
        per.setdefault(r.sequence_id, []).append(r)
        got.setdefault(r.doc_id, []).append(r)
    assert sum(n for _, n in whole) == sum(r.length for r in rows)
    for xs in per.values():
        at = 0
        for r in sorted(xs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for d, t in docs:
        if sum(x[0] == d for x in docs) > 1:
            continue
        ids = brute_ids([t], 2)[0]
        for r in got[d]:
            assert crc(ids[r.start : r.start + r.length]) == r.ids_crc32
            assert r.length == capacity or r.piece == 0
    return len(per)


def test_op8(spark, odd_docs, no_docs):
    check_op8([(r.doc_id, r.text) for r in odd_docs.collect()], packing.pack(odd_docs, JSON, P.PATTERN).collect())
    assert packing.pack(no_docs, JSON, P.PATTERN).count() == 0
    sf = "/root/testdata/sf0.001"
    rows = queries.op8_best_fit_packing(spark, sf).collect()
    used = check_op8([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], rows)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def optimum(items, capacity):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                go(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [capacity - items[i]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_keeps_the_optimum(items):
    counts = {k: items.count(k) for k in set(items)}
    fixed, left = packing.reduce_instance(counts, 20)
    rest = sorted((k for k, n in left.items() for _ in range(n)), reverse=True)
    assert sorted([x for s, n in fixed for x in s * n] + rest) == sorted(items)
    assert sum(n for _, n in fixed) + optimum(rest, 20) == optimum(sorted(items, reverse=True), 20)
    sets = packing.plan(counts, 20)
    assert sorted(x for s, n in sets for x in s * n) == sorted(items)
    assert all(sum(s) <= 20 for s, _ in sets)
