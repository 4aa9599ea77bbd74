"""Secret scan: candidates by pattern, false positives removed by a random forest; DataFrame operations only.

A candidate is a run of at least 16 characters of keys and tokens that holds a digit, or a quoted value of 6 characters and more that is
assigned to a secret's name.  Its features are its length, character classes and transitions between them, entropy, how much of
it words of the corpus' dictionary cover, its path, and the words next to it; a run like ``NAME=value`` is judged by its value, the name counts as
a neighbour.  The forest is trained from labelled findings: either a table (doc_id, start, label) of reviewed
findings, or, where there is none, ``weak_labels``, a rule on neighbours and entropy.  Half of the training rows lose
their neighbours' features, so that the forest also learns what a secret itself looks like.

Defined results: null and empty texts have no candidates; repeated rows have their findings repeated; a null path is
an empty path; other columns are ignored; without both labels every candidate has the score of the labels' share,
0 without any; ties in the dictionary and the training sample go by word and candidate; an empty table gives an empty result.
A text of any length is searched whole and a candidate may have any length.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import materialise, tune

#: Labelled findings that the forest is trained on at most, by hash order, and its size.
LABELLED = 6000
TREES, DEPTH = 20, 6
#: Words of the dictionary: the most frequent ones of four letters and more in all documents.
DICTIONARY_WORDS = 2000
#: Characters kept on each side of a candidate.
CONTEXT = 48
#: Matches whose places are summed in one go.
SUMMED = 256
#: Paths are told apart by so many groups of equal hash.
PATH_GROUPS = 16

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+"
NAMES = r"token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer"
KEYWORD = rf"(?i)({NAMES})"
ASSIGNED_VALUE = rf"(?i)(?:{NAMES})[A-Za-z0-9_]*+[\"']?[ \t]*+[:=][ \t]*+[\"'][^\"'\s]{{6,}}+[\"']"
HARMLESS = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|uuid|guid|isbn|phone|card|order|invoice|version)"
ASSIGNED = r"[:=]\s*[\"'`]?$"

CHARACTER = ["length", "digit_share", "upper_share", "lower_share", "hex", "digits_only", "transitions", "entropy", "coverage"]
NEIGHBOURS = ["keyword", "harmless", "assigned", "quoted", "path_depth", "path_sample"]
PATHS = [f"path_{k}" for k in range(PATH_GROUPS)]


def _starts(gaps: Column, sizes: Column) -> Column:
    """Where each of the pieces of ``sizes`` starts that lie between ``gaps``: sums within blocks, then of blocks, so an array is never copied for each of its entries."""
    none = F.array().cast("array<int>")
    pairs = F.arrays_zip(gaps.alias("gap"), sizes.alias("own"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / SUMMED).cast("int")), lambda b: F.slice(pairs, b * SUMMED + 1, SUMMED))
    inner = F.transform(blocks, lambda block: F.aggregate(
        block, F.struct(F.lit(0).alias("at"), none.alias("starts")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + F.coalesce(x["own"], F.lit(0))).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts")),
    ))
    bases = F.aggregate(inner, F.struct(F.lit(0).alias("at"), none.alias("bases")), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["bases"], F.array(acc["at"])).alias("bases")), lambda acc: acc["bases"])
    return F.flatten(F.zip_with(inner, bases, lambda block, base: F.transform(block["starts"], lambda at: at + base)))


def _matches(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row for each match: doc_id, path, text_key (hash of the text), start (characters before it), candidate, before, after."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col(path), F.lit("")).alias("path"), F.xxhash64("text").alias("text_key"), "text").where(text.rlike(pattern))
    rows = rows.select("doc_id", "path", "text_key", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"), F.split("text", pattern, -1).alias("parts"))
    rows = rows.withColumn("starts", _starts(F.transform("parts", F.length), F.transform("found", F.length))).select("doc_id", "path", "text_key", "parts", "starts", F.posexplode("found").alias("k", "candidate"))
    return rows.select(
        "doc_id", "path", "text_key", F.get("starts", F.col("k")).alias("start"), "candidate",
        F.right(F.get("parts", F.col("k")), F.lit(CONTEXT)).alias("before"), F.left(F.get("parts", F.col("k") + 1), F.lit(CONTEXT)).alias("after"),
    )


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """A row for each run that may be a secret: doc_id, path, text_key, start, candidate, before, after."""
    return _matches(docs, path, CANDIDATE)


def assigned_values(docs: DataFrame, path: str = "source") -> DataFrame:
    """The same for quoted values of secrets' names that hold no candidate, such as short or digit-free passwords."""
    rows = _matches(docs, path, ASSIGNED_VALUE)
    whole, quote = F.col("candidate"), F.right("candidate", F.lit(1))
    value = F.regexp_extract(whole, r"[\"']([^\"'\s]+)[\"']$", 1)
    size = F.length(value)
    return rows.where(~value.rlike(CANDIDATE)).select(
        "doc_id", "path", "text_key", (F.col("start") + F.length(whole) - 1 - size).alias("start"), value.alias("candidate"),
        F.right(F.concat("before", F.left(whole, F.length(whole) - 1 - size)), F.lit(CONTEXT)).alias("before"), F.left(F.concat(quote, "after"), F.lit(CONTEXT)).alias("after"),
    )


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of four letters and more in all texts; ``size`` rows reach the driver at most."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("length(word) BETWEEN 4 AND 30")
    return [r["word"] for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).collect()]


def _any_of(words: list[str]) -> str:
    """A pattern of the longest word that stands at a place, with common beginnings merged."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [re.escape(c) + pattern(below) for c, below in sorted(at.items()) if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)}){'?' if '' in at else ''}"

    return pattern(tree)


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with the columns ``CHARACTER``, ``NEIGHBOURS`` and ``PATHS``, all double."""
    run = F.col("candidate")
    name = F.regexp_extract(run, "^(.*=)[^=]{8}", 1)  # NAME= of NAME=value
    c = F.right(run, F.length(run) - F.length(name))
    before = F.concat("before", name)
    n = F.length(c).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / n

    letters = F.array_distinct(F.split(c, ""))
    entropy = F.aggregate(
        F.transform(letters, lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / n),
        F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0),
    )
    known = _any_of(words)
    coverage = 1 - F.length(F.regexp_replace(F.lower(c), known, "")) / n if known else F.lit(0.0)
    columns = {
        "length": n, "digit_share": share("[0-9]"), "upper_share": share("[A-Z]"), "lower_share": share("[a-z]"),
        "hex": c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "digits_only": c.rlike("^[0-9]+$"),
        "transitions": F.regexp_count(c, F.lit("(?<=[0-9])[^0-9]|(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]")) / n, "entropy": entropy, "coverage": coverage,
        "keyword": before.rlike(KEYWORD), "harmless": before.rlike(HARMLESS), "assigned": before.rlike(ASSIGNED),
        "quoted": F.col("after").rlike("^[\"'`]"), "path_depth": F.size(F.split("path", "/")), "path_sample": F.col("path").rlike("(?i)(test|example|sample|fixture|mock)"),
    } | {x: F.pmod(F.xxhash64("path"), F.lit(PATH_GROUPS)) == k for k, x in enumerate(PATHS)}
    return found.select("*", *(columns[x].cast("double").alias(x) for x in CHARACTER + NEIGHBOURS + PATHS))


def weak_labels(rows: DataFrame) -> DataFrame:
    """Findings labelled by a rule: 1 for a mixed value assigned to a secret's name, 0 without either sign or of digits only; others are not labelled."""
    named, assigned = F.col("keyword") > 0, F.col("assigned") > 0
    random = (F.col("entropy") >= 3.0) & (F.col("digits_only") == 0) & (F.col("harmless") == 0)
    label = F.when(named & assigned & random, 1.0).when(F.col("digits_only") > 0, 0.0).when(F.col("harmless") > 0, 0.0).when(~named & ~assigned & (F.col("coverage") > 0.3), 0.0)
    return rows.withColumn("label", label).where("label IS NOT NULL")


def _with_gaps(rows: DataFrame) -> DataFrame:
    """Half of the rows without their neighbours' features."""
    hidden = F.pmod(F.xxhash64("candidate", "start"), F.lit(2)) == 0
    return rows.withColumns({x: F.when(hidden, 0.0).otherwise(F.col(x)) for x in ("keyword", "harmless", "assigned", "quoted")})


def _scored(docs: DataFrame, path: str, labelled: DataFrame | None, threshold: float) -> DataFrame:
    tune(docs.sparkSession)
    found = materialise(candidates(docs, path).unionByName(assigned_values(docs, path)), "candidates")
    rows = features(found, [] if found.isEmpty() else dictionary(docs))
    known = weak_labels(rows) if labelled is None else rows.join(labelled.select("doc_id", "start", F.col("label").cast("double").alias("label")), ["doc_id", "start"])
    inputs = CHARACTER + NEIGHBOURS + PATHS
    sample = known.select("candidate", "start", "label", *inputs).distinct().orderBy(F.xxhash64("candidate", "start"), "candidate", "start", "label", "path_depth").limit(LABELLED)
    sample = materialise(_with_gaps(sample), "findings")
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    out = rows.select("doc_id", "text_key", "start", F.col("candidate"), F.length("candidate").alias("run_length"), *inputs)
    if len(counts) < 2:
        score = F.lit(float(next(iter(counts), 0.0)))
    else:
        assembler = VectorAssembler(inputCols=inputs, outputCol="features_")
        forest = RandomForestClassifier(featuresCol="features_", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=17, probabilityCol="probability_", rawPredictionCol="raw_", predictionCol="prediction_")
        out = forest.fit(assembler.transform(sample)).transform(assembler.transform(out))
        score = vector_to_array("probability_")[1]
    out = out.select("doc_id", "text_key", "start", F.col("run_length").alias("length"), "candidate", F.round(score, 6).alias("score"))
    return out.withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, path: str = "source", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """A row for each candidate. Columns: doc_id, start, length, candidate, score, is_secret."""
    return _scored(docs, path, labelled, threshold).drop("text_key")


def redact(docs: DataFrame, path: str = "source", mark: str = "[SECRET]", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every secret of a text replaced by ``mark``, longer ones first, so that none leaves a part of another behind."""
    found = _scored(docs, path, labelled, threshold).where("is_secret")
    found = found.groupBy(F.col("text_key").alias("of_")).agg(F.sort_array(F.collect_set(F.struct((-F.length("candidate")).alias("order"), "candidate"))).alias("secrets_"))
    found = materialise(found, "secrets")  # a text's secrets are no more than the text
    text = F.aggregate("secrets_", F.col("text"), lambda t, s: F.replace(t, s["candidate"], F.lit(mark)))
    rows = docs.join(found, F.xxhash64("text") == F.col("of_"), "left")
    return rows.withColumn("text", F.when(F.col("secrets_").isNotNull(), text).otherwise(F.col("text"))).select(*docs.columns)
