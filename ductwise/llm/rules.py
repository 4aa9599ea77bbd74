"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` computes counts of a text in one projection; every array is bound once per row.  ``THRESHOLDS`` lists
rules (name, measure, least, most); a document is kept if every measure lies within its bounds.  Windows of eight
words are compared by 64-bit hashes of their words' hashes.

Defined results: null and empty texts have no words, all counts 0 and fail; ratios over nothing are 0;
repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
A text of any length is judged whole, in one expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Symbols.
SYMBOLS = "#*$%&|<>"
#: Very frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with was on be by this are at from or a an "
    "der die das und ist von mit des den ein eine nicht sich auch für auf zu im dem als "
    "le la les de du des et un une que qui dans pour par est en au pas sur ce "
    "el los las y que se del por con una su para es lo como no al"
).split()

#: name, measure, least, most (None: unbounded)
THRESHOLDS = (
    ("length", "n_words", 20, 100_000),
    ("word length", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("stop words", "stop_ratio", 0.02, None),
    ("repeated lines", "dup_line_ratio", None, 0.3),
    ("cut lines", "ellipsis_line_ratio", None, 0.3),
    ("listed lines", "bullet_line_ratio", None, 0.9),
    ("shouting", "mark_ratio", None, 0.3),
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order of their first word."""

    def positions(ranked: Column) -> Column:
        n = F.size(ranked)

        def at(k: Column) -> Column:
            own = F.get(ranked, k)
            before, after = (F.coalesce(F.get(ranked, x)["h"] == own["h"], F.lit(False)) for x in (k - 1, k + 1))
            return F.when(before | after, own["i"])

        return F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), n - 1), at), lambda i: i.isNotNull()))

    def length(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b).cast("long")

    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    heavy = bind(ranked, lambda r: bind(positions(r), length))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(heavy)


def _windows(words: Column) -> Column:
    """A hash for each window of eight words: pairs of words, of pairs and of fours are hashed in turn."""

    def paired(values: Column, apart: int) -> Column:
        return F.zip_with(values, F.slice(values, apart + 1, F.greatest(F.size(values), F.lit(1))), lambda x, y: F.xxhash64(x, y))

    whole = bind(paired(words, 1), lambda two: bind(paired(two, 2), lambda four: paired(four, 4)))
    return F.slice(whole, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    raw = F.coalesce(text, F.lit(""))

    def per_text(t: Column) -> Column:
        signs = F.regexp_replace(t, f"[^{SYMBOLS}!?]+", "")  # most texts have few
        words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def of_words(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                bind(_windows(w), _covered).alias("n_repeat_words"),
            )

        def of_lines(x: Column) -> Column:
            ending = F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))
            bullets = F.filter(x, lambda y: F.substring(F.ltrim(y), 1, 1).isin("•", "-", "*"))
            return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.size(ending).alias("n_ellipsis_lines"), F.size(bullets).alias("n_bullet_lines"))

        def of_signs(x: Column) -> Column:
            symbols = F.length(F.translate(x, "!?", ""))
            return F.struct(symbols.cast("long").alias("n_symbols"), (F.length(x) - symbols).cast("long").alias("n_marks"))

        return F.struct(bind(signs, of_signs).alias("s"), bind(words, of_words).alias("w"), bind(lines, of_lines).alias("l"))

    return bind(raw, per_text)


def compiled(thresholds=THRESHOLDS) -> Column:
    """Names of the rules that a row of measures breaks."""
    tests = []
    for name, measure, least, most in thresholds:
        broken = F.lit(False)
        if least is not None:
            broken = broken | (F.col(measure) < F.lit(least))
        if most is not None:
            broken = broken | (F.col(measure) > F.lit(most))
        tests.append(F.when(broken, F.lit(name)))
    return F.array_compact(F.array(*tests))


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """A row for each document with its counts, broken rules and verdict."""
    rows = docs.select("doc_id", measures(F.col("text")).alias("m")).select(
        "doc_id", F.col("m.w.n_words").alias("n_words"), F.col("m.w.word_chars").alias("word_chars"), F.col("m.s.n_symbols").alias("n_symbols"),
        F.col("m.l.n_dup_lines").alias("n_dup_lines"), F.col("m.w.n_repeat_words").alias("n_repeat_words"), F.col("m.w.n_stop_words").alias("n_stop_words"),
        F.col("m.l.n_lines").alias("n_lines"), F.col("m.l.n_ellipsis_lines").alias("n_ellipsis"), F.col("m.l.n_bullet_lines").alias("n_bullets"), F.col("m.s.n_marks").alias("n_marks"),
    )
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"), _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_ratio"), _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_ellipsis"), F.col("n_lines")).alias("ellipsis_line_ratio"), _ratio(F.col("n_bullets"), F.col("n_lines")).alias("bullet_line_ratio"),
        _ratio(F.col("n_marks"), F.col("n_words")).alias("mark_ratio"),
    )
    return rows.withColumn("n_broken", F.size(compiled(thresholds)).cast("long")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("n_broken") == 0)).alias("kept"), "n_broken",
    )


def sql(thresholds=THRESHOLDS) -> str:
    """The same in DuckDB's SQL."""
    broken = []
    for _, measure, least, most in thresholds:
        tests = [f"{measure} < {least}"] * (least is not None) + [f"{measure} > {most}"] * (most is not None)
        broken.append(f"(CASE WHEN {' OR '.join(tests)} THEN 1 ELSE 0 END)")
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
d AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt
      FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM d GROUP BY rid),
c AS (SELECT w.rid, doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::BIGINT AS n_marks,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(lines) AS n_lines,
             len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis,
             len(list_filter(lines, lambda x: substr(ltrim(x), 1, 1) IN ('•', '-', '*'))) AS n_bullets
      FROM w LEFT JOIN r ON w.rid = r.rid),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_chars,
             CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_ratio,
             CASE WHEN n_words > 0 THEN n_stop_words::DOUBLE / n_words ELSE 0 END AS stop_ratio,
             CASE WHEN n_words > 0 THEN n_marks::DOUBLE / n_words ELSE 0 END AS mark_ratio,
             CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
             CASE WHEN n_lines > 0 THEN n_ellipsis::DOUBLE / n_lines ELSE 0 END AS ellipsis_line_ratio,
             CASE WHEN n_lines > 0 THEN n_bullets::DOUBLE / n_lines ELSE 0 END AS bullet_line_ratio FROM c),
v AS (SELECT *, ({' + '.join(broken)})::BIGINT AS n_broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_broken = 0 AS kept, n_broken FROM v
"""
