"""Toxic spans by a linear-chain conditional random field of two tags, and document scores from its marginals.

Only documents carry labels, so tokens are labelled first: in toxic training documents a token is toxic if
one of its features (word or prefix) is found in significantly more toxic than clean documents and hardly in
clean ones; all tokens of clean documents are clean.  The field has hashed word, prefix and suffix features and transitions
between the tags, fitted by gradient steps on the exact likelihood.  Forward-backward marginals of all tokens give
the expected number of toxic tokens, which is calibrated to the document's score, and the offending spans.

Documents are run side by side in blocks of tokens; a document starts a block of its own and its blocks are joined by their
transition products, which is exact.  No number of a document depends on its neighbours in a batch.

Defined results: null and empty texts have no tokens and get the lowest evidence, so a low score; equal texts get
equal scores; other columns are ignored; without both labels the score is the share of label 1, 0.5 without any.
A text of any length is tagged whole, in blocks; only training leaves texts above ``LONGEST`` characters out.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import class_shares, fold, tidy, training_rows, tune
from .calibration import Logistic, class_weights

#: Labelled texts of each class that are learnt from at most.
PER_CLASS = 1500
#: Texts of each class that the field itself is fitted on at most: those of least hash.
FIELD_TEXTS = 500
BUCKETS = 1 << 18
#: G statistic from which a feature counts as toxic evidence, and the least share of its documents that are toxic.
EVIDENCE, PRECISION = 25.0, 0.95
CACHE_WORDS = 300_000
BLOCK = 64
TOKEN_CHARACTER = r"[\p{L}\p{N}]"
SCORED = "doc_id long, held_out boolean, score double, predicted int, n_toxic_tokens long, spans array<struct<start:int,end:int>>"


def words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of each token's word, tokens of each text) in lower case; a text without words has the word ''."""
    flat = pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+", " "))
    split = pc.split_pattern(flat, " ")
    coded = split.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.array(pc.list_value_length(split), np.int64)


def _stems(word: str) -> list[str]:
    """The features that token labels are drawn from."""
    return ["=" + word, *("^" + word[:k] for k in (3, 4, 5, 6) if len(word) > k)]


def _buckets(word: str) -> list[int]:
    """The hashed features of a word."""
    names = [*_stems(word), "$" + word[-3:], "$" + word[-4:], "#" + str(min(len(word), 12))]
    names += ["="] * (8 - len(names))  # a fixed number of columns
    return [zlib.crc32(n.encode("utf-8", "replace")) % BUCKETS for n in names]


class Field:
    """Tag 1 is toxic. ``weights`` are by bucket; ``trans`` and ``start`` are factors."""

    def __init__(self):
        self.weights = np.zeros(BUCKETS)
        self.trans = np.array([[0.99, 0.01], [0.9, 0.1]])
        self.start = np.array([0.99, 0.01])

    def _factors(self, e: np.ndarray, first: np.ndarray):
        """Transition factors (block place, block), whether a block begins a chain, place of each token."""
        begin = np.flatnonzero(first)
        sizes = np.diff(begin, append=len(e))
        blocks = -(-sizes // BLOCK)
        head = np.zeros(int(blocks.sum()), bool)
        head[np.cumsum(blocks) - blocks] = True
        place = np.arange(len(e)) + np.repeat((np.cumsum(blocks) - blocks) * BLOCK - begin, sizes)
        up = np.ones(len(head) * BLOCK)
        up[place] = np.exp(np.clip(e, -30, 30))
        real = np.zeros(len(up), bool)
        real[place] = True
        up, real = np.ascontiguousarray(up.reshape(-1, BLOCK).T), np.ascontiguousarray(real.reshape(-1, BLOCK).T)
        heads = np.zeros_like(real)
        heads[0] = head

        def pick(a: int, b: int) -> np.ndarray:
            factor = np.where(heads, self.start[b], self.trans[a, b]) * (up if b else 1.0)
            return np.where(real, factor, float(a == b))  # what fills a chain's last block changes nothing

        return pick(0, 0), pick(0, 1), pick(1, 0), pick(1, 1), head, place

    def chain(self, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(odds of toxic given what precedes, given what follows, marginal probability) of each token; ``first`` marks where chains begin."""
        if not len(e):
            return e, e, e
        m00, m01, m10, m11, head, place = self._factors(e, first)
        blocks = m00.shape[1]
        a, b, c, d = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
        for t in range(BLOCK):
            a, b, c, d = a * m00[t] + b * m10[t], a * m01[t] + b * m11[t], c * m00[t] + d * m10[t], c * m01[t] + d * m11[t]
            scale = 1 / (a + b + c + d)
            a, b, c, d = a * scale, b * scale, c * scale, d * scale
        into, out = np.ones(blocks), np.ones(blocks)
        product, begins, r, q = list(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())), head.tolist(), 1.0, 1.0
        for k, (w, x, y, z) in enumerate(product):
            into[k] = r = 1.0 if begins[k] else r
            r = (x + r * z) / (w + r * y)
        for k in range(blocks - 1, -1, -1):
            out[k] = q
            w, x, y, z = product[k]
            q = 1.0 if begins[k] else (y + z * q) / (w + x * q)
        ahead, behind = np.empty_like(m00), np.empty_like(m00)
        r, q = into, out
        for t in range(BLOCK):
            r = (m01[t] + r * m11[t]) / (m00[t] + r * m10[t])
            ahead[t] = r
        for t in range(BLOCK - 1, -1, -1):
            behind[t] = q
            q = (m10[t] + m11[t] * q) / (m00[t] + m01[t] * q)
        ahead, behind = ahead.T.ravel()[place], behind.T.ravel()[place]
        odds = ahead * behind
        return ahead, behind, odds / (1 + odds)

    def pairs(self, e: np.ndarray, first: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """Expected number of transitions between the tags."""
        rest = np.flatnonzero(~first)
        r, q, up = ahead[rest - 1], behind[rest], np.exp(np.clip(e[rest], -30, 30))
        cells = np.stack([self.trans[0, 0] + 0 * r, self.trans[0, 1] * up * q, r * self.trans[1, 0], r * self.trans[1, 1] * up * q])
        return (cells / cells.sum(0)).sum(1).reshape(2, 2)

    def fit(self, buckets: np.ndarray, index: np.ndarray, first: np.ndarray, tags: np.ndarray, steps: int = 60, rate: float = 0.4, ridge: float = 1e-3) -> None:
        """Adaptive gradient steps on the penalised log likelihood. ``buckets`` has a row for each distinct word."""
        log_trans, log_start = np.log(self.trans), np.log(self.start)
        size = np.full(BUCKETS, 1e-3)
        rest = np.flatnonzero(~first)
        seen = np.bincount(tags[rest - 1] * 2 + tags[rest], minlength=4).reshape(2, 2)
        begun = np.bincount(tags[first], minlength=2)
        big_t, big_s = np.full((2, 2), 1e-3), np.full(2, 1e-3)
        for _ in range(steps):
            self.trans, self.start = np.exp(log_trans), np.exp(log_start)
            e = self.weights[buckets].sum(1)[index]
            ahead, behind, p = self.chain(e, first)
            by_word = np.bincount(index, weights=p - tags, minlength=len(buckets))
            slope = np.bincount(buckets.ravel(), weights=np.repeat(by_word, buckets.shape[1]), minlength=BUCKETS) + ridge * self.weights
            size += slope * slope
            self.weights -= rate * slope / np.sqrt(size)
            slope = self.pairs(e, first, ahead, behind) - seen
            big_t += slope * slope
            log_trans -= rate * slope / np.sqrt(big_t)
            head = p[first]
            slope = np.array([(1 - head).sum(), head.sum()]) - begun
            big_s += slope * slope
            log_start -= rate * slope / np.sqrt(big_s)
        self.trans, self.start = np.exp(log_trans), np.exp(log_start)
        self.weights = self.weights.astype(np.float32)


def toxic_stems(texts: list[list[str]], labels: list[int]) -> set[str]:
    """Features that mark toxic documents: G statistic and precision over distinct texts."""
    have = {0: Counter(), 1: Counter()}
    total = Counter(labels)
    for tokens, y in zip(texts, labels):
        have[y].update({s for w in set(tokens) for s in _stems(w)})
    found = set()
    rate = {c: max(total[c], 1) / max(len(labels), 1) for c in (0, 1)}
    for stem, k in have[1].items():
        n = k + have[0][stem]
        if k < PRECISION * n or not total[0]:
            continue
        g = 2 * k * np.log(k / n / rate[1]) + (2 * (n - k) * np.log((n - k) / n / rate[0]) if n > k else 0)
        if g >= EVIDENCE and k / n > rate[1]:
            found.add(stem)
    return found


class Model:
    def __init__(self, rows: list[tuple[int, str, int]], shares: dict[int, float]):
        self.prior = shares.get(1, 0.0) if shares else 0.5
        self.calibrated = None
        rows = list({t: (t, y) for _, t, y in rows}.values())  # a text once
        y = np.array([y for _, y in rows], np.int64)
        if len(set(y.tolist())) < 2:
            return
        names, index, counts = words(pa.array([t for t, _ in rows], pa.string()))
        edge = np.concatenate([[0], np.cumsum(counts)])
        texts = [[names[i] for i in index[a:b].tolist()] for a, b in zip(edge[:-1], edge[1:])]
        stems = toxic_stems(texts, y.tolist())
        marked = np.fromiter((bool(w) and any(s in stems for s in _stems(w)) for w in names), bool, len(names))
        tags = (marked[index] & (np.repeat(y, counts) == 1)).astype(np.int64)
        has = np.add.reduceat(tags, edge[:-1]) > 0
        chosen = np.zeros(len(rows), bool)
        for of in (np.flatnonzero((y == 1) & has), np.flatnonzero(y == 0)):
            chosen[of[:FIELD_TEXTS]] = True
        use = np.repeat(chosen, counts)
        first = np.zeros(len(index), bool)
        first[edge[:-1]] = True
        kept, index_used = np.unique(index[use], return_inverse=True)
        buckets = np.array([_buckets(names[i]) for i in kept.tolist()], np.int64).reshape(-1, 8)
        self.field = Field()
        self.field.fit(buckets, index_used, first[use], tags[use])
        x, _ = self.evidence(names, index, counts)
        self.calibrated = Logistic(x, y, class_weights(y, shares))

    def _emissions(self, names: list[str]) -> np.ndarray:
        cache = self.__dict__.setdefault("_cache", {})
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = [w for w in names if w not in cache]
        if new:
            cache.update(zip(new, self.field.weights[np.array([_buckets(w) for w in new])].sum(1).tolist()))
            cache[""] = -30.0
        return np.fromiter(map(cache.__getitem__, names), float, len(names))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def evidence(self, names: list[str], index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(features of each text, toxic marginal of each token)."""
        starts = np.cumsum(counts) - counts
        first = np.zeros(len(index), bool)
        first[starts] = True
        _, _, p = self.field.chain(self._emissions(names)[index], first)
        if not len(counts):
            return np.zeros((0, 3)), p
        total = np.add.reduceat(p, starts)
        return np.column_stack([np.log(total + 1e-2), np.maximum.reduceat(p, starts), np.log(total / counts + 1e-4)]), p


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return Model(training_rows(docs, labels, "toxic", per_class), class_shares(labels, "toxic"))


def _spans(text: pa.Array, toxic: np.ndarray) -> list[dict]:
    """Character ranges of runs of toxic tokens of the one text in ``text``, whose tokens are those of ``words``."""
    marked = pc.replace_substring_regex(pc.replace_substring(pc.utf8_lower(text), "\x01", " "), TOKEN_CHARACTER, "\x01")  # a character for each character
    inside = np.frombuffer(marked[0].as_py().encode("utf-32-le", "replace"), "<u4") == 1
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).reshape(-1, 2).tolist()
    found, last = [], -2
    for k, (start, end) in enumerate(edges):
        if toxic[k]:
            if last == k - 1:
                found[-1]["end"] = end
            else:
                found.append({"start": start, "end": end})
            last = k
    return found


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """A row for each document. Columns: ``SCORED``."""
    tune(docs.sparkSession)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches):
        own = shared.value
        for batch in batches:
            n = len(batch)
            if own.calibrated is None:
                score, toxic, spans = np.full(n, own.prior), np.zeros(n, np.int64), [[]] * n
            elif not n:
                continue
            else:
                names, index, counts = words(batch.column(1))
                x, p = own.evidence(names, index, counts)
                score, starts = own.calibrated(x), np.cumsum(counts) - counts
                toxic = np.add.reduceat((p > 0.5).astype(np.int64), starts)
                spans = [[] for _ in range(n)]
                for i in np.flatnonzero(toxic).tolist():
                    spans[i] = _spans(batch.column(1).slice(i, 1), p[starts[i] : starts[i] + counts[i]] > 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(toxic), pa.array(spans, spans_type)],
                ["doc_id", "held_out", "score", "predicted", "n_toxic_tokens", "spans"],
            )

    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held_out).mapInArrow(tidy(run), SCORED)
