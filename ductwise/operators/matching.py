"""Joins by more than equality: cascades, substrings, globs, prefixes, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import norm

#: Scenario type suffixes of sample ids, prefixes of derived ids.
TYPE_SUFFIX = r"_(na_single_system|a_single_system|na_cross_system|a_cross_system|na_no_fault|no_fault|na_low_confidence|a_low_confidence)_\d+$"
DERIVED = ("a_lc_", "na_lc_", "a_", "nf_")


def id_candidates(sample_id: Column) -> Column:
    """Ids to look up in order: as it is, without type suffix, without its first derived prefix."""
    sid = F.coalesce(sample_id.cast("string"), F.lit(""))
    bare = F.regexp_replace(sid, TYPE_SUFFIX, "")
    cut = F.when(F.lit(False), "")
    for p in DERIVED:
        cut = cut.when(bare.startswith(p), F.substring(bare, len(p) + 1, 1 << 30))
    return F.array_distinct(F.filter(F.array(sid, bare, cut), lambda x: x.isNotNull() & (x != "")))


def type_rank(actual: Column, expected: Column) -> Column:
    a, e = norm(actual), norm(expected)
    alike = [F.contains(a, F.lit(x)) & F.contains(e, F.lit(x)) for x in ("low_confidence", "no_fault")]
    return F.when(e == "", 1).when(a == e, 0).when(alike[0] | alike[1], 1).otherwise(5)


def match_scenarios(samples: DataFrame, scenarios: DataFrame, fallback: bool = True) -> DataFrame:
    """samples(sample_id, scenario_type, root_cause_system, root_cause_node, fault_type) to scenarios(scenario_id, ...).

    Columns: sample_id, matched_id, strategy.  Candidates are tried in order; what none matches falls back to the best
    scenario of the same ground truth.  Ground truths are matched once each, so a frequent one is no hot key of the ranking.
    """
    tried = samples.select("sample_id", F.posexplode(id_candidates(F.col("sample_id"))).alias("pos", "cand"))
    hits = tried.join(scenarios.select(F.col("scenario_id").alias("cand")).distinct(), "cand").groupBy("sample_id").agg(F.min_by("cand", "pos").alias("matched_id"))
    out = samples.join(hits, "sample_id", "left")
    if not fallback:
        return out.select("sample_id", "matched_id", F.when(F.col("matched_id").isNull(), "missing").otherwise("direct_or_suffix").alias("strategy"))
    truth = ["scenario_type", "root_cause_system", "root_cause_node", "fault_type"]
    keys = out.where("matched_id IS NULL").select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in truth)).distinct()
    # of scenarios with one ground truth only the first can be the best
    s = scenarios.groupBy(*(F.coalesce(F.col(c), F.lit("")).alias(f"s_{c}") for c in truth)).agg(F.min("scenario_id").alias("scenario_id"))
    clean = norm(F.col("fault_type")).isin("normal", "no_fault", "none", "") | norm(F.col("root_cause_node")).isin("none", "")
    as_clean = F.contains(norm(F.col("s_scenario_type")), F.lit("no_fault")) | norm(F.col("s_fault_type")).isin("normal", "no_fault") | norm(F.col("s_root_cause_node")).isin("none", "")
    as_fault = (F.col("s_fault_type") == F.col("fault_type")) & ((F.col("root_cause_node") == "") | (F.col("s_root_cause_node") == "") | (F.col("s_root_cause_node") == F.col("root_cause_node")))
    found = keys.join(s, (F.col("s_root_cause_system") == F.col("root_cause_system")) & F.when(clean, as_clean).otherwise(as_fault))
    best = found.groupBy(*truth).agg(F.min(F.struct(type_rank(F.col("s_scenario_type"), F.col("scenario_type")).alias("r"), F.col("scenario_id").alias("id"))).alias("best_")).select(*(F.col(c).alias(f"k_{c}") for c in truth), F.col("best_.id").alias("by_truth"))
    same = None
    for c in truth:
        test = F.coalesce(F.col(c), F.lit("")) == F.col(f"k_{c}")
        same = test if same is None else same & test
    out = out.join(best, same & F.col("matched_id").isNull(), "left")
    strategy = F.when(F.col("matched_id").isNotNull(), "direct_or_suffix").when(F.col("by_truth").isNotNull(), "ground_truth").otherwise("missing")
    return out.select("sample_id", F.coalesce("matched_id", "by_truth", F.lit("")).alias("matched_id"), strategy.alias("strategy"))


#: Characters of the anchor of a needle that has no two whole words inside.
GRAM = 4


def _word_pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _anchor(needle: Column) -> Column:
    """What every text that contains the needle must hold: the longest pair of whole words inside of it, or else its first characters."""
    words = F.filter(F.split(needle, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    inner = _word_pairs(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))  # the outermost words may be cut off
    best = F.array_max(F.transform(inner, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))
    return F.when(F.size(inner) > 0, F.concat(F.lit("w"), best["p"])).otherwise(F.concat(F.least(F.length(needle), F.lit(GRAM)).cast("string"), F.left(needle, F.lit(GRAM))))


def _anchors(text: Column, kinds: list[str]) -> Column:
    """All anchors of the kinds ('w', or a number of characters) that a text holds."""
    parts = []
    for k in kinds:
        if k == "w":
            words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
            parts.append(F.transform(_word_pairs(words), lambda p: F.concat(F.lit("w"), p)))
        else:
            last = F.length(text) - int(k) + 1
            grams = F.transform(F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit(k), F.substring(text, i, F.lit(int(k)))))
            parts.append(grams)
    return F.array_distinct(F.concat(*parts)) if parts else F.array().cast("array<string>")


def substring_pairs(needles: DataFrame, needle: str, texts: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``texts`` (key, text) with each needle that they contain.

    Needles are joined by an anchor, a stretch that any text with the needle must hold; what meets is confirmed with the whole needle.
    """
    own = needles.select(needle).where(F.col(needle) != "").distinct().withColumn("anchor_", _anchor(F.col(needle)))
    kinds = sorted(r["k"] for r in own.select(F.left("anchor_", F.lit(1)).alias("k")).distinct().collect())  # at most GRAM + 1
    held = texts.select(key, F.explode(_anchors(F.col(text), kinds)).alias("anchor_"))
    met = held.join(own, "anchor_").select(key, needle).distinct()
    return texts.join(met, key).where(F.contains(F.col(text), F.col(needle)))


def substring_links(left: DataFrame, needle: str, right: DataFrame, text: str, order: str) -> DataFrame:
    """The first ``right`` row by ``order`` whose text contains the needle, and how many do."""
    found = substring_pairs(left, needle, right.select(order, text), text, order)
    return found.groupBy(needle).agg(F.min(order).alias(order), F.count("*").alias("n_matches"))


def glob_pattern(pattern: Column) -> Column:
    """A regular expression for a glob of * and ?."""
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, r"([.+(){}|^$\[\]\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))


def resolve_globs(patterns: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pattern, node_id): the first node by id whose name matches, else one whose name contains the pattern's bare text."""
    bare = F.lower(F.regexp_replace("pattern", r"[*?]", ""))
    kind = F.when(F.regexp_like(F.col("name"), glob_pattern(F.col("pattern"))), 0).when((bare != "") & F.contains(F.lower("name"), bare), 1)
    hit = nodes.join(patterns.select("pattern").distinct(), kind.isNotNull())  # a short list of templates; Spark broadcasts it if its size allows
    return hit.groupBy("pattern").agg(F.min(F.struct(kind.alias("k"), "node_id")).alias("b")).select("pattern", F.col("b.node_id").alias("node_id"), F.col("b.k").alias("kind"))


def prefixes(label: Column) -> Column:
    """The label and its progressively shorter prefixes of '_' parts, longest first."""
    parts = F.split(label, "_")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "_"))


def longest_prefix(labels: DataFrame, label: str, templates: DataFrame, key: str) -> DataFrame:
    """Each label with the template of its longest prefix, null if there is none."""
    tried = labels.select(label).distinct().select(label, F.explode(prefixes(F.col(label))).alias(key))
    best = tried.join(templates.select(key), key).groupBy(label).agg(F.max_by(key, F.length(key)).alias(key))
    return labels.join(best, label, "left")


def keyword_component(faults: DataFrame, components: DataFrame, keywords: DataFrame) -> DataFrame:
    """faults(system_id, fault) to components(system_id, node_id, name, rank) by keywords(keyword, part, rank): first keyword, exact name before substring, then first component."""
    hit = faults.join(keywords, F.contains(F.lower("fault"), F.col("keyword"))).withColumnRenamed("rank", "k_rank")  # a short list
    found = hit.join(components, "system_id")
    kind = F.when(F.lower("name") == F.col("part"), 0).when(F.contains(F.lower("name"), F.col("part")), 1)
    best = found.where(kind.isNotNull()).groupBy("system_id", "fault").agg(F.min(F.struct("k_rank", kind.alias("kind"), "rank", "node_id")).alias("b"))
    first = components.groupBy("system_id").agg(F.min_by("node_id", "rank").alias("first_"))
    return faults.join(best, ["system_id", "fault"], "left").join(first, "system_id", "left").select("system_id", "fault", F.coalesce("b.node_id", "first_").alias("node_id"))


def positional_pairs(calls: Column, results: Column) -> Column:
    """call[i] with result[i] after results that are no JSON object were dropped (their places close up)."""
    kept = F.filter(results, lambda r: r.isNotNull() & F.try_parse_json(r).isNotNull() & F.ltrim(r).startswith("{"))
    return F.zip_with(calls, F.slice(F.concat(kept, F.array_repeat(F.lit("{}"), F.size(calls))), F.lit(1), F.greatest(F.size(calls), F.lit(0))), lambda c, r: F.struct(c.alias("call"), r.alias("result")))


def modular_tile(df: DataFrame, index: str, length: int, count: int) -> DataFrame:
    """Rows 0..length-1, taking row i % count of ``df`` (a short baseline repeated to fill a window)."""
    ids = df.sparkSession.range(length).select(F.col("id").alias("tile_idx"), (F.col("id") % count).alias(index))
    return ids.join(df, index)


def overlap_counts(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that two splits share, for each pair of splits."""
    per = df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s_"))  # a few splits
    pairs = per.where("size(s_) > 1").select(F.explode("s_").alias("split_a"), "s_").select("split_a", F.explode("s_").alias("split_b")).where("split_a < split_b")
    return pairs.groupBy("split_a", "split_b").agg(F.count("*").alias("n_shared"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("position") <= k)
