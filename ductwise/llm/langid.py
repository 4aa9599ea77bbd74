"""Language identification by Bayesian fusion of evidence.

log posterior(language) = log likelihood of the text + log likelihood of the declared markup language
+ log prior of the host.  Text likelihoods come from character trigrams of words.  Priors are grouped sums of
the text's own posteriors, smoothed down a hierarchy: all rows, address suffix, host; a row's own share is
taken out of its host's sum.  The declared language's likelihood is its smoothed share among rows of a language.

Defined results: a text without words (null or empty) has no evidence of its own, gets language 'und' and is not
accepted; null host, suffix and declared language are groups of their own or no evidence; equal rows get equal results; other
columns are ignored; without labelled text every row is 'und'; of languages with equal posteriors the first by name wins.
A text of any length counts whole; only training leaves texts above ``LONGEST`` characters out.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import LONGEST, materialise, tidy, tune
from .toxicity import words

#: Texts of each language that the trigram model is fitted on: at most, and at least (rarer names are likely errors).
PER_LANGUAGE = 400
LEAST_TEXTS = 3
BUCKETS = 1 << 16
CACHE_WORDS = 200_000
#: Trigrams after which further text adds less and less evidence.
EVIDENCE = 200.0
#: The language that a document's first tag declares.
DECLARED = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})"
#: Weight of a level's parent, in rows.
KAPPA = 20.0


def _trigrams(word: str) -> list[int]:
    padded = f"^{word}$"
    return [zlib.crc32(padded[i : i + 3].encode("utf-8", "replace")) % BUCKETS for i in range(max(len(padded) - 2, 1))]


class Model:
    """log probability of each hashed trigram by language."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.languages = sorted({lang for _, lang in rows})
        self.logs = np.zeros((BUCKETS, max(len(self.languages), 1)), np.float32)
        for k, lang in enumerate(self.languages):
            names, index, _ = words(pa.array([t for t, x in rows if x == lang], pa.string()))
            often = np.bincount(index, minlength=len(names))
            counts = np.full(BUCKETS, 0.05)
            for w, n in zip(names, often.tolist()):
                if w:
                    np.add.at(counts, _trigrams(w), n)
            self.logs[:, k] = np.log(counts / counts.sum())
        self._clear()

    def _clear(self):
        self._rows: dict[str, int] = {"": 0}
        self._table = np.zeros((1, self.logs.shape[1] + 1), np.float64)

    def __getstate__(self):
        return {"languages": self.languages, "logs": self.logs}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._clear()

    def _known(self, names: list[str]) -> np.ndarray:
        """For each word its log likelihoods and number of trigrams."""
        if len(self._rows) > CACHE_WORDS:
            self._clear()
        new = [w for w in names if w not in self._rows]
        if new:
            grams = [_trigrams(w) for w in new]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            flat = np.fromiter((g for x in grams for g in x), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(self.logs[flat].astype(np.float64), np.cumsum(sizes) - sizes)
            self._rows.update(zip(new, range(len(self._table), len(self._table) + len(new))))
            self._table = np.concatenate([self._table, np.column_stack([sums, sizes])])
        return self._table[np.fromiter(map(self._rows.__getitem__, names), np.int64, len(names))]

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tempered log likelihoods, number of trigrams) of each text."""
        names, index, counts = words(texts)
        if not len(counts):
            return np.zeros((0, self.logs.shape[1])), np.zeros(0)
        sums = np.add.reduceat(self._known(names)[index], np.cumsum(counts) - counts)
        n = sums[:, -1]
        return sums[:, :-1] / (1 + n / EVIDENCE)[:, None], n


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of every language that (doc_id, text, lang) has ``LEAST_TEXTS`` texts of; the ``per_language`` texts of least hash reach the driver.

    Texts of more than ``LONGEST`` characters aren't learnt from.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") <= LONGEST)).select("text", "lang", F.xxhash64("doc_id", "text").alias("place"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().where(f"count >= {LEAST_TEXTS}").collect()}
    if not counts:
        return Model([])
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1_000_000, math.ceil(1e6 * per_language / n))))))
    sample = rows.where(F.pmod("place", F.lit(1_000_000)) < F.element_at(share, F.col("lang"))).distinct()
    got, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(sample.collect(), key=lambda r: (r["place"], r["text"])):
        if taken[r["lang"]] < per_language:
            taken[r["lang"]] += 1
            got.append((r["text"], r["lang"]))
    return Model(got)


def _softmax(logs: Column) -> Column:
    powers = F.transform(F.array(F.struct(logs.alias("x"), F.array_max(logs).alias("m"))), lambda s: F.transform(s["x"], lambda v: F.exp(v - s["m"])))[0]
    return F.transform(F.transform(F.array(powers), lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0.0), lambda a, b: a + b).alias("t"))), lambda s: F.transform(s["p"], lambda v: v / s["t"]))[0]


def identify(docs: DataFrame, model: Model, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """``docs`` has the key, text, host, suffix and declared; any but the key may be null.

    Columns: key, lang, confidence, text_lang, declared, host_prior, accepted.
    """
    tune(docs.sparkSession)
    size = len(model.languages)
    columns = docs.select(key, "text", "host", "suffix", "declared")
    if not size:
        return columns.select(key, F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_lang"), "declared", F.lit(0.0).alias("host_prior"), F.lit(False).alias("accepted"))
    kind = dict(columns.dtypes)[key]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, a column for each language that has labelled texts

    def run(batches):
        for batch in batches:
            logs, n = shared.value.evidence(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * size, pa.int32()), pa.array(logs.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), lists, pa.array(n > 0)], [key, "host", "suffix", "declared", "logs", "worded"])
        shared.value._clear()  # a worker that goes on to other operators needs the room

    rows = columns.mapInArrow(tidy(run), f"`{key}` {kind}, host string, suffix string, declared string, logs array<double>, worded boolean")
    rows = materialise(rows.select("*", _softmax(F.col("logs")).alias("own")), "languages")
    heard = rows.where("worded")
    sums = [F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(size)]
    packed = F.array(*(F.col(f"s{i}") for i in range(size)))
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]

    by_host = materialise(heard.groupBy("host", "suffix").agg(*sums), "hosts")
    whole = by_host.agg(*again).first()
    total = [float(whole[i] or 0.0) + 1.0 for i in range(size)]
    root = F.array(*(F.lit(x / sum(total)) for x in total))

    def smooth(counts: Column, parent: Column) -> Column:
        mass = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, parent, lambda c, p: (F.greatest(c, F.lit(0.0)) + KAPPA * p) / (F.greatest(mass, F.lit(0.0)) + KAPPA))

    by_suffix = by_host.groupBy("suffix").agg(*again).select(F.col("suffix").alias("x"), smooth(packed, root).alias("suffix_prior"))
    hosts = by_host.select(F.col("host").alias("h"), "suffix", packed.alias("host_sum")).join(by_suffix, F.col("suffix").eqNullSafe(F.col("x"))).select("h", "x", "host_sum", "suffix_prior")
    by_declared = heard.where("declared IS NOT NULL").groupBy("declared").agg(*sums)
    spoken = by_declared.agg(*again).first()
    spoken = F.array(*(F.lit(float(spoken[i] or 0.0)) for i in range(size)))
    declared = by_declared.select(F.col("declared").alias("d"), F.zip_with(packed, spoken, lambda c, t: F.log((c + 0.5) / (t + 0.5 * size))).alias("declared_log"))

    none = F.array(*(F.lit(0.0) for _ in range(size)))
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("h")) & F.col("suffix").eqNullSafe(F.col("x")), "left").join(declared, F.col("declared") == F.col("d"), "left")
    others = F.zip_with("host_sum", "own", lambda a, b: a - b)
    prior = F.coalesce(smooth(others, F.col("suffix_prior")), root)
    fused = joined.select(key, "logs", "declared", "worded", F.coalesce("declared_log", none).alias("declared_log"), prior.alias("prior"))
    fused = fused.withColumn("posterior", _softmax(F.zip_with(F.zip_with("logs", "declared_log", lambda a, b: a + b), "prior", lambda a, b: a + F.log(b))))
    names = F.array(*map(F.lit, model.languages))

    def best(values: str) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    return fused.select(
        key,
        F.when(F.col("worded"), best("posterior")).otherwise("und").alias("lang"),
        F.when(F.col("worded"), F.array_max("posterior")).otherwise(0.0).alias("confidence"),
        F.when(F.col("worded"), best("logs")).otherwise("und").alias("text_lang"),
        "declared",
        F.element_at("prior", F.array_position("posterior", F.array_max("posterior")).cast("int")).alias("host_prior"),
        (F.col("worded") & (F.array_max("posterior") >= threshold)).alias("accepted"),
    )


def document_columns(docs: DataFrame) -> DataFrame:
    """Documents: the source is the host, its last part (after a full stop) the suffix; markup in the text may declare a language."""
    suffix = F.nullif(F.regexp_extract("source", r"\.([A-Za-z]+)$", 1), F.lit(""))
    return docs.select("doc_id", "text", F.col("source").alias("host"), F.lower(suffix).alias("suffix"), F.nullif(F.lower(F.regexp_extract("text", DECLARED, 1)), F.lit("")).alias("declared"))


def page_columns(pages: DataFrame) -> DataFrame:
    """Pages: host and suffix of the address, language of the html tag, text without scripts, styles and tags."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1))
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    declared = F.lower(F.regexp_extract("html", DECLARED, 1))
    return pages.select("page_id", bare.alias("text"), F.nullif(host, F.lit("")).alias("host"), F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit("")).alias("suffix"), F.nullif(declared, F.lit("")).alias("declared"))
