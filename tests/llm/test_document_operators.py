import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ductwise.llm import langid, media, neardup, quality, queries, rules, secrets, toxicity

SF = "/root/testdata/sf0.001"
LABELS = "toxic int, quality int, doc_id long, text string"


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="session")
def labelled(spark):
    good = ["the quick brown fox and a lazy dog walk by the river", "in the morning we read of ships and of the sea", "she said that it was for the best of the town"]
    bad = ["buy!! now!! $$$ win### cheap%%% pills", "click | here | free | deal | click | here", "xxx### yyy$$$ zzz%%% www&&&"]
    docs, labels = [], []
    for i in range(240):
        toxic, poor = i % 4 == 0, i % 3 == 0
        text = " ".join((bad if poor else good)[(i + k) % 3] + f" n{i}x{k}" for k in range(6)) + (" you idiot, utter scum" if toxic else "")
        docs.append((None, i, text, "en", f"s{i % 3}", "x"))
        labels.append((int(toxic), int(not poor), i, "clash"))
    labels += [(None, None, 3, None), (1, 0, None, None), (2, 5, 7, None)]
    return spark.createDataFrame(docs, "n_chars string, doc_id long, text string, lang string, source string, score string"), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores(spark, labelled, odd_docs, no_docs, module):
    docs, labels = labelled
    model = module.fit(docs, labels, 200)
    got = {r.doc_id: r for r in module.score(docs, model).collect()}
    column = "toxic" if module is toxicity else "quality"
    want = {r.doc_id: r[column] for r in labels.where(f"{column} IN (0, 1) AND doc_id IS NOT NULL").collect()}
    held = [i for i in want if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i].score >= 0.5) == want[i] for i in held) >= 0.9 * len(held)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    odd = module.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    by_text = defaultdict(set)
    texts = rows_of(odd_docs)
    for r in odd:
        for i, t in texts:
            if i == r.doc_id and sum(x[0] == i for x in texts) == 1:
                by_text[t or ""].add(r.score)
    assert all(len(v) == 1 for v in by_text.values())
    assert module.score(no_docs, model).count() == 0
    untrained = module.fit(no_docs, labels.limit(0))
    assert {r.score for r in module.score(odd_docs, untrained).collect()} == {0.5}


def test_training_never_sees_the_held_out_fold(spark, labelled):
    from ductwise.llm._runtime import training_rows

    seen = training_rows(*labelled, "quality", 50)
    assert seen and all(zlib.crc32(str(i).encode()) % 3 != 1 for i, _, _ in seen)
    assert max(Counter(y for _, _, y in seen).values()) <= 50


def test_toxic_spans_are_the_words(spark, labelled):
    docs, labels = labelled
    text = {i: t for i, t in rows_of(docs)}
    found = Counter()
    for r in toxicity.score(docs, toxicity.fit(docs, labels, 200)).collect():
        for s in r.spans:
            found.update(re.findall(r"\w+", text[r.doc_id][s.start : s.end].lower()))
    assert found and set(found) <= {"you", "idiot", "utter", "scum"}


def test_field_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    field = toxicity.Field()
    field.trans, field.start = np.array([[0.7, 0.3], [0.4, 1.6]]), np.array([0.8, 0.5])
    e = rng.normal(0, 2, 150)
    first = np.zeros(150, bool)
    first[[0, 3, 9, 16, 27]] = True
    _, _, p = field.chain(e, first)
    for a, b in ((0, 3), (3, 9), (9, 16), (16, 27)):
        total, on = 0.0, np.zeros(b - a)
        for tags in itertools.product((0, 1), repeat=b - a):
            w = field.start[tags[0]] * np.prod([field.trans[x, y] for x, y in zip(tags, tags[1:])]) * np.exp(sum(v for v, t in zip(e[a:b], tags) if t))
            total += w
            on += w * np.array(tags)
        assert np.allclose(on / total, p[a:b])


def test_language(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    want = {r.doc_id: r.lang for r in docs.collect()}
    assert got.keys() == want.keys() and sum(got[i].lang == want[i] for i in want) >= 0.97 * len(want)
    odd = langid.identify(langid.document_columns(odd_docs), model).collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang for r in odd if r.doc_id in (1, 2, 3, 9)} == {"und"} and not any(r.accepted for r in odd if r.doc_id in (1, 2))
    assert langid.identify(langid.document_columns(no_docs), model).count() == 0
    assert {r.lang for r in langid.identify(langid.document_columns(odd_docs), langid.fit(no_docs)).collect()} == {"und"}
    pages = queries.language_id_pages(spark, SF).collect()
    assert sum(r.lang == r.declared for r in pages) >= 0.97 * len(pages)


def test_language_on_rows_it_was_not_fitted_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("crc32(cast(doc_id AS string)) % 3 <> 1"))
    got = langid.identify(langid.document_columns(docs), model).join(docs.select("doc_id", docs.lang.alias("want")), "doc_id").where("crc32(cast(doc_id AS string)) % 3 = 1").collect()
    assert len(got) > 250 and sum(r.lang == r.want for r in got) >= 0.97 * len(got)


def test_fusion_equals_a_plain_computation(spark):
    import math

    texts = ["alpha beta gamma", "delta epsilon zeta", "eta theta iota"]
    model = langid.Model(list(zip(texts, ("aa", "bb", "cc"))))
    rows = [(i, texts[i % 3] if i % 5 else "al", ("h1", "h2", None)[i % 3 if i % 4 else 0], ("com", None, "org")[i % 3 if i % 4 else 0], (None, "aa", "bb", "xx")[i % 4]) for i in range(40)] + [(90, None, "h1", "com", "aa"), (91, "", None, None, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string, declared string"), model).collect()}
    import pyarrow as pa

    logs, n = model.evidence(pa.array([r[1] for r in rows], pa.string()))
    own = [[math.exp(v - max(x)) / sum(math.exp(w - max(x)) for w in x) for v in x] for x in logs.tolist()]
    total = lambda keep: [sum(p[k] for r, p, m in zip(rows, own, n) if m and keep(r)) for k in range(3)]
    smooth = lambda c, parent: [(max(x, 0) + langid.KAPPA * p) / (max(sum(c), 0) + langid.KAPPA) for x, p in zip(c, parent)]
    root = [x + 1 for x in total(lambda r: True)]
    root = [x / sum(root) for x in root]
    spoken = total(lambda r: r[4] is not None)
    for r, x, p, m in zip(rows, logs.tolist(), own, n):
        if not m:
            assert got[r[0]].lang == "und" and not got[r[0]].accepted
            continue
        suffix = smooth(total(lambda q: q[3] == r[3]), root)
        prior = smooth([a - b for a, b in zip(total(lambda q: q[2:4] == r[2:4]), p)], suffix)
        said = [math.log((c + 0.5) / (t + 1.5)) for c, t in zip(total(lambda q: q[4] == r[4]), spoken)] if r[4] else [0.0] * 3
        logit = [a + b + math.log(c) for a, b, c in zip(x, said, prior)]
        best = max(range(3), key=lambda k: logit[k])
        posterior = 1 / sum(math.exp(v - logit[best]) for v in logit)
        assert got[r[0]].lang == model.languages[best] and abs(got[r[0]].confidence - posterior) < 1e-9 and abs(got[r[0]].host_prior - prior[best]) < 1e-9


def test_every_language_with_texts_is_fitted(spark):
    rows = [(k, f"{chr(0x4E00 + k % 250)}{chr(0x5E00 + k % 250)} wort{k}", f"l{k % 250:03}") for k in range(1000)] + [(5000, "only one", "zz")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{k:03}" for k in range(250)]


def test_quality_features_are_differences_of_compressed_sizes():
    import zstandard

    good, bad = "the sea and the ships of the town ", "buy!! now!! $$$ win### cheap%%% "
    rows = [(i, (good if i % 4 < 2 else bad) * (3 + i % 5) + f" n{i}", int(i % 4 < 2)) for i in range(80)]
    model = quality.Model(rows, {0: 0.5, 1: 0.5})
    size = lambda block, d: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False).compress(block))
    for text in (good * 40, bad * 40, "x", ""):
        data = text.encode()
        gaps = [size(data[i : i + quality.BLOCK], model.dictionaries[1]) - size(data[i : i + quality.BLOCK], model.dictionaries[0]) for i in range(0, len(data), quality.BLOCK)]
        trust = len(data) / (len(data) + quality.SHORT)
        want = (trust * sum(gaps) / len(data), trust * sum(gaps) / len(data) ** 0.5, trust * min([0, *gaps]) / quality.BLOCK) if data else (0, 0, 0)
        assert all(abs(a - b) < 1e-12 for a, b in zip(model.features(data), want))
    scores, _ = model.scores([good * 40, bad * 40])
    assert scores[0] > 0.9 and scores[1] < 0.1


def test_a_score_does_not_depend_on_the_place_of_a_row(spark, labelled):
    import random

    import pyarrow as pa

    rng, docs = random.Random(4), [r.text for r in labelled[0].collect()]
    model = toxicity.fit(*labelled, 200)
    probe, seen = "it was the best of you idiot " * 30, set()
    for _ in range(60):
        batch = [rng.choice(docs) for _ in range(rng.randrange(30))]
        at = rng.randrange(len(batch) + 1)
        batch.insert(at, probe)
        x, _ = model.evidence(*toxicity.words(pa.array(batch)))
        seen.add(float(model.calibrated(x)[at]))
    assert len(seen) == 1


def test_host_prior_decides_where_text_is_weak(spark):
    model = langid.Model([("alpha beta gamma", "aa"), ("delta epsilon zeta", "bb")])
    rows = [(i, "delta epsilon", "h1", "com", None) for i in range(60)] + [(100, "q", "h1", "com", None), (101, "q", None, None, "aa")]
    rows += [(200 + i, "alpha beta", "h2", "org", "aa") for i in range(60)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string, declared string"), model).collect()}
    assert got[100].lang == "bb" and got[101].lang == "aa"


def test_media(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(odd_docs)
    out = media.load(*media.store(docs)).collect()
    assert len(out) == docs.count()
    want = Counter()
    for i, t in rows_of(docs):
        raw = (t or "").encode()
        data = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        want[(i, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    same = defaultdict(set)
    for r in out:
        same[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())
    assert media.load(*media.store(no_docs)).count() == 0


def test_stored_form_holds_each_chunk_once():
    import zstandard

    body = b"0123456789abcdef" * 4096
    (chunks,) = media.cut([body])
    assert len(set(chunks)) < len(chunks)
    import struct

    manifest = media.MAGIC + struct.pack("<QI", len(body), len(chunks)) + b"".join(struct.pack("<I", len(c)) + media.digest(c) for c in chunks)
    blobs = {media.digest(c): zstandard.compress(c) for c in chunks}
    data, stored = media.rebuild(manifest, blobs, zstandard.decompress)
    assert data == body and len(stored) == len(manifest) + sum(map(len, blobs.values()))


def test_cuts_follow_content():
    import random

    rng = random.Random(5)
    body = bytes(rng.randrange(256) for _ in range(60_000))
    (a,), (b,) = media.cut([body]), media.cut([b"prefix" + body])
    assert b"".join(a) == body and all(media.LEAST <= len(c) <= media.MOST for c in a[:-1])
    assert len(set(a) & set(b)) >= len(a) - 3


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_rules(spark, odd_docs, no_docs):
    spark_docs = odd_docs.unionByName(spark.createDataFrame([(None, 50, "a b c d e f g h " * 4 + "x", None, None, None), (None, 51, "x a b c d e f g h\ny\nx a b c d e f g h\ny\n" + " ".join(map(str, range(30))), None, None, None)], odd_docs.schema))
    got = Counter((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(spark_docs).collect())
    assert got == Counter((str(i), *brute_rules(t)) for i, t in rows_of(spark_docs))
    assert rules.judge(no_docs).count() == 0
    assert all(not r.kept for r in rules.judge(spark_docs).where("base_failed").collect())


def brute_components(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, sets


def test_near_duplicates(spark, odd_docs, no_docs):
    docs = [(i, t) for i, t in rows_of(odd_docs) if i is not None]
    base = " ".join(f"tok{i}" for i in range(120))
    docs += [(100 + k, base.replace(f"tok{k * 7} ", f"new{k} ")) for k in range(12)] + [(200, base), (201, base.upper()), (300, "Alone"), (301, "alone")]
    frame = spark.createDataFrame([(None, i, t, None, None, None) for i, t in docs] + [(None, None, base, None, None, None)], odd_docs.schema)
    out = neardup.near_duplicates(frame, size=2, percent=80).collect()
    want, sets = brute_components(docs, 2, 80)
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
    assert len(out) == len(docs) + 1 and all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert all(r.n_shingles in {len(s) for s in sets[r.doc_id]} for r in out if r.doc_id is not None)
    assert neardup.near_duplicates(no_docs, size=2).count() == 0


def test_rows_that_share_an_id(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    rows = [(3, a), (5, a), (5, b), (5, b), (7, b + " fifteen"), (9, a.upper()), (11, "x y z"), (11, "x y w"), (12, ""), (12, " "), (None, a)]
    docs = spark.createDataFrame([(t, i, k) for k, (i, t) in enumerate(rows)], "text string, doc_id long, extra int")
    want, _ = brute_components([r for r in rows if r[0] is not None], 2, 80)
    out = neardup.near_duplicates(docs, size=2, percent=80).collect()
    got = defaultdict(set)
    for r in out:
        got[r.doc_id].add((r.component_id, r.kept))
    assert len(out) == len(rows) and got.pop(None) == {(None, True)}
    assert dict(got) == {i: {(want[i], want[i] == i)} for i in want}
    # by texts: each text of a group once, unlike texts and rows without words or id all stay
    kept = neardup.one_of_each(docs, size=2, percent=80)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(3, a), (5, b), (11, "x y z"), (11, "x y w"), (12, ""), (12, " "), (None, a)])


def test_links_do_not_depend_on_the_size_of_a_bucket(spark, monkeypatch):
    import random

    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(w if rng.random() > 0.08 else f"x{rng.randrange(99)}" for w in base)) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want, _ = brute_components(docs, 2, 80)
    for paired, slice_ in ((10**9, neardup.SLICE), (0, 500)):
        monkeypatch.setattr(neardup, "PAIRED", paired)
        monkeypatch.setattr(neardup, "SLICE", slice_)
        assert {r.doc_id: r.component_id for r in neardup.near_duplicates(frame, size=2, percent=80, rows=1).collect()} == want


def test_near_duplicates_of_a_table(spark):
    docs = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    want, _ = brute_components(docs, 2, 80)
    assert {r.doc_id: r.component_id for r in queries.op9_minhash_near_dedup(spark, SF).collect()} == want


def test_components(spark):
    import random

    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 540)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


SECRET = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f00"


def test_secret_candidates_equal_a_plain_search(spark, odd_docs):
    text = f'token = "{SECRET}" and 4785380592391139 then api_key: {SECRET}\nnext aaaaaaaaaaaaaaaaaaaaaaaa b1'
    frame = odd_docs.unionByName(spark.createDataFrame([(None, 60, text, None, None, None), (None, 61, SECRET, None, "p/test", None)], odd_docs.schema))
    got = Counter((r.doc_id, r.start, r.candidate) for r in secrets.candidates(frame).collect())
    want = Counter((i, m.start(), m.group()) for i, t in rows_of(frame) for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}", t or ""))
    assert got == want and want


def test_secret_candidates_have_no_length_limit(spark):
    text = "k" * 450 + "=" + SECRET + " and " + "y" * 5000 + "7"
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert [(r.start, r.candidate) for r in secrets.candidates(docs).orderBy("start").collect()] == [(0, "k" * 450 + "=" + SECRET), (496, "y" * 5000 + "7")]


def test_assigned_values_and_features(spark):
    text = f"password = 'hunterzwei' API_TOKEN={SECRET} secret: \"abc\" commit {SECRET}"
    docs = spark.createDataFrame([(1, text, None)], "doc_id long, text string, source string")
    (value,) = secrets.assigned_values(docs).collect()
    assert (value.candidate, value.start, value.after[:1]) == ("hunterzwei", 12, "'")
    rows = {r.start: r for r in secrets.features(secrets.candidates(docs), ["hunt", "hunter"]).collect()}
    inner, plain = rows[text.index("API_TOKEN")], rows[text.rindex(SECRET)]
    assert (inner.keyword, inner.assigned, inner.harmless, inner.length, inner.hex) == (1, 1, 0, 40, 1)
    assert (plain.assigned, plain.harmless, plain.digit_share) == (0, 1, sum(map(str.isdigit, SECRET)) / 40)
    assert secrets.features(secrets.assigned_values(docs), ["hunt", "hunter"]).first().coverage == 0.6


def test_secrets_of_odd_rows(spark, odd_docs):
    doc = f'token = "{SECRET}" then token = "{SECRET}ff01" end'
    noise = " ".join(f"id {10**15 + i}" for i in range(40))
    rows = [(None, None, doc, None, None, None)] * 3 + [(None, 1, noise + doc, None, None, None), (None, 2, "A" + doc, None, "p/test.py", None)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema))
    found = secrets.scan(docs).where("is_secret").collect()
    assert Counter((r.doc_id, r.candidate) for r in found) == Counter({(None, SECRET): 3, (None, SECRET + "ff01"): 3, (1, SECRET): 1, (1, SECRET + "ff01"): 1, (2, SECRET): 1, (2, SECRET + "ff01"): 1})
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    want = Counter((i, t and t.replace(SECRET + "ff01", "[SECRET]").replace(SECRET, "[SECRET]")) for i, t in rows_of(docs))
    assert Counter(rows_of(clean)) == want


def test_secrets_are_found_and_redacted(spark, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = dict(rows_of(docs))
    found = {(r.doc_id, r.start) for r in secrets.scan(docs).where("is_secret").collect()}
    assert found == {(i, m.start(1)) for i, t in text.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    cleaned = dict(rows_of(secrets.redact(docs)))
    assert all(not re.search(r'(?i)token = "[0-9a-f]{40}"', t) for t in cleaned.values())
    assert {i for i in text if text[i] != cleaned[i]} == {i for i, _ in found}
    assert secrets.scan(no_docs).count() == 0 and secrets.redact(no_docs).count() == 0


def test_scan_with_reviewed_findings(spark):
    docs = spark.createDataFrame([(i, f"value {'%040x' % (i * 7919 ** 9)} id {10**15 + i}", "s") for i in range(1, 61)], "doc_id long, text string, source string")
    truth = secrets.candidates(docs).selectExpr("doc_id", "start", "CASE WHEN length(candidate) > 20 THEN 1 ELSE 0 END AS label")
    out = secrets.scan(docs, labelled=truth).collect()
    assert len(out) == 120 and sum(r.is_secret == (r.length > 20) for r in out) >= 114


def test_values_of_any_length_are_found(spark):
    texts = [f"password = '{'q' * n}'" for n in (5, 6, 199, 200, 201, 5000)] + [f"my_token{'_x' * 40} {' ' * 9}=  'abcdef'", "api_key:'short1'"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'' AS source")
    got = {r.doc_id: (r.start, r.candidate) for r in secrets.assigned_values(docs).collect()}
    assert got == {i: (t.index("'") + 1, t.split("'")[1]) for i, t in enumerate(texts) if len(t.split("'")[1]) >= 6}


@pytest.mark.parametrize("n", [1, 255, 256, 257, 700])
def test_places_of_many_candidates(spark, n):
    text = "".join(f"ü{'.' * (k % 5)} key{k:016d}" for k in range(n))
    docs = spark.createDataFrame([(1, text, "s"), (1, text, "s")], "doc_id long, text string, source string")
    want = sorted(2 * [(m.start(), m.group()) for m in re.finditer(r"key\d{16}", text)])
    assert sorted((r.start, r.candidate) for r in secrets.candidates(docs).collect()) == want


def test_spans_behind_letters_that_engines_know_unlike(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels, 200)
    odd = [chr(0x1C89), chr(0x88F), "İ ǅ ẞ", "\x01 a\x01b", "𐐀𐐨 x", "é́"]
    texts = [f"{x} the quick {x}here by the river of the town utter scum by the sea {x} in the town of ships you idiot" for x in odd]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(rows, model).collect():
        found = " ".join(texts[r.doc_id][s.start : s.end] for s in r.spans)
        assert found and set(re.findall(r"[a-z]+", found)) <= {"you", "idiot", "utter", "scum"} and r.n_toxic_tokens == len(found.split())


def test_a_node_meets_the_centre_that_it_shares_most_tables_with(spark, monkeypatch):
    import random

    rng, written, write = random.Random(4), {}, neardup.materialise

    def keep(df, name, *a, **k):
        out = write(df, name, *a, **k)
        if name in ("tables", "centres"):
            written[name] = out.collect()
        return out

    monkeypatch.setattr(neardup, "materialise", keep)
    base = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join(w if rng.random() > 0.06 else f"x{rng.randrange(999)}" for w in base)) for i in range(120)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=2, percent=80).collect()}
    assert got == brute_components(docs, 2, 80)[0]
    tables = defaultdict(list)
    for r in written["tables"]:
        tables[r.key].append(r.node)
    common = Counter((a, min(nodes)) for nodes in tables.values() for a in nodes if a != min(nodes))
    most = {}
    for (a, _), n in common.items():
        most[a] = max(n, most.get(a, 0))
    met = {r.a: r.b for r in written["centres"] if r.a != r.b}
    assert len(met) > 60 and all(common[a, b] == most[a] for a, b in met.items()) and set(met) == set(most)


def test_copies_of_a_payload_are_rebuilt_once(spark, monkeypatch):
    written, write = {}, media.materialise

    def keep(df, name, *a, **k):
        out = write(df, name, *a, **k)
        written[name] = out.count()
        return out

    monkeypatch.setattr(media, "materialise", keep)
    rows = [(i, "a" if i % 3 else "a\0") for i in range(60)] + [(100, "alone " * 50), (101, None), (102, "")]
    out = {r.doc_id: r for r in media.load(*media.store(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))).collect()}
    assert len(out) == 63 and written["media"] == 63 and written["read"] == 2  # all of a; the empty ones
    for i, text in rows:
        data = media.payload((text or "").encode())
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256) == (len(text or ""), len(data), hashlib.sha256(data).hexdigest())
    assert len({(r.media_sha256, r.feature) for i, r in out.items() if i < 60}) == 1
