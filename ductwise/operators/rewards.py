"""Rewards of episodes, a table for each term, and their weighted total.

episodes and calls are those of ``metrics``; a call's row holds its result, so status, fault_type, confidence and targets are what it returned.
Every term is one or two grouped passes over calls; what is seen before a call comes from the first step at which an episode saw a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import exact_match, is_no_fault_label, is_no_fault_node, mutual_substring, node_system, norm, same_family
from .metrics import accuracy_reward, efficiency_reward, undiscovered

#: Weights of the total, statuses that speak of a fault, and plants whose faults reach other systems.
WEIGHTS = {
    "accuracy": 0.65, "efficiency": 0.08, "format": 0.04, "reasoning": 0.04, "completeness": 0.05, "topology": 0.06,
    "consistency": 0.06, "evidence": 0.04, "sensor_verification": 0.08, "cross_trace": 0.06, "process": 0.04, "epo": 0.20,
}
ABNORMAL = ("fault", "warning", "abnormal")
PLANTS = ("boiler_plant", "chiller_plant")


def _has() -> Column:
    return F.col("diag_node").isNotNull() | F.col("diag_fault").isNotNull()


def _says_no_fault() -> Column:
    return _has() & is_no_fault_label(F.col("diag_fault")) & is_no_fault_node(F.col("diag_node"))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def accuracy_terms(episodes: DataFrame, calls: DataFrame, max_steps: int = 15) -> DataFrame:
    """episode_id, accuracy, efficiency, completeness (three required fields and two that count half)."""
    filled = lambda c: (~F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", "None", "null")).cast("double")
    required, optional = ("diag_node", "diag_fault", "diag_confidence"), [c for c in ("diag_affected", "diag_status") if c in episodes.columns]
    complete = (sum((filled(c) for c in required), F.lit(0.0)) + 0.5 * sum((filled(c) for c in optional), F.lit(0.0))) / 4
    system = F.coalesce(F.nullif(norm(F.col("diag_system")), F.lit("")), node_system(F.col("diag_node"))) == norm(F.col("gt_system"))
    both = (F.coalesce("diag_node", F.lit("")) != "") & (F.coalesce("diag_fault", F.lit("")) != "")
    acc = accuracy_reward(_has(), is_no_fault_label(F.col("gt_fault")), _says_no_fault(), mutual_substring(F.col("gt_node"), F.col("diag_node")), exact_match(F.col("gt_fault"), F.col("diag_fault")), same_family(F.col("gt_fault"), F.col("diag_fault")), system, both)
    n = calls.groupBy("episode_id").agg(F.count("*").alias("n"))
    rows = episodes.join(n, "episode_id", "left")
    return rows.select("episode_id", acc.alias("accuracy"), efficiency_reward(_zero("n"), F.coalesce("optimal", F.lit(3)), max_steps).alias("efficiency"), F.when(_has(), complete).otherwise(0.0).alias("completeness"))


def topology_reward(episodes: DataFrame, calls: DataFrame) -> DataFrame:
    """episode_id, topology: share of diagnoses whose node some result of the episode listed, whenever it did."""
    listed = calls.select("episode_id", F.explode("targets").alias("node_id")).distinct().withColumn("l_", F.lit(True))
    asked = calls.where("tool = 'diagnose_node'").join(listed, ["episode_id", "node_id"], "left")
    found = asked.groupBy("episode_id").agg(F.avg((F.col("l_").isNotNull() | F.col("node_id").startswith("system::")).cast("double")).alias("topology"))
    return episodes.select("episode_id").join(found, "episode_id", "left").select("episode_id", F.coalesce("topology", F.lit(0.0)).alias("topology"))


def consistency_reward(episodes: DataFrame, calls: DataFrame, weak: Column | None = None) -> DataFrame:
    """episode_id, consistency: does what was observed back the diagnosis? ``weak`` marks results of a weak fall-back model."""
    c = calls.withColumn("weak_", F.coalesce(weak, F.lit(False)) if weak is not None else F.lit(False)).select("episode_id", "i", F.col("node_id").alias("n_"), norm(F.col("status")).alias("s_"), F.col("fault_type").alias("f_"), "weak_")
    j = episodes.select("episode_id", "diag_node", "diag_fault", _has().alias("has"), _says_no_fault().alias("free")).join(c, "episode_id", "left")
    bad, own = F.col("s_").isin(*ABNORMAL), norm(F.col("n_")) == norm(F.col("diag_node"))
    backs = bad & own & (norm(F.col("f_")).isin("", "none", "uncertain") | exact_match(F.col("f_"), F.col("diag_fault")) | same_family(F.col("f_"), F.col("diag_fault")))
    g = j.groupBy("episode_id", "diag_node", "has", "free").agg(
        F.count("i").alias("n"), F.count_if(bad).alias("bad"), F.count_if(own).alias("own"), F.count_if(own & bad).alias("own_bad"), F.count_if(own & (F.col("s_") == "normal")).alias("own_normal"),
        F.min_by("weak_", F.when(backs, F.col("i"))).alias("weak"), F.count_if(backs).alias("backs"),
    )
    some = F.col("bad") > 0
    at_node = F.when(F.col("backs") > 0, F.when(F.col("weak"), 0.25).otherwise(1.0)).when(F.col("own_bad") > 0, 0.5).when(F.col("own_normal") > 0, -0.4).otherwise(F.when(some, 0.4).otherwise(-0.3))
    value = (
        F.when(~F.col("has") | (F.col("n") == 0), 0.0).when(F.col("free"), F.when(some, -1.0).otherwise(0.7))
        .when((norm(F.col("diag_node")) != "") & (F.col("own") > 0), at_node).otherwise(F.when(some, -0.5).otherwise(-0.3))
    )
    return g.select("episode_id", value.alias("consistency"))


def sensor_summary(calls: DataFrame, useful: Column | None = None) -> DataFrame:
    """Per episode: sensor calls, uncertain and verified nodes, and calls that no open doubt explains.

    A node's doubt is open from an uncertain diagnosis until a useful reading of the node. ``useful`` tells readings with values.
    """
    s = norm(F.col("status"))
    diagnosis, reading = F.col("tool") == "diagnose_node", F.col("tool") == "get_node_sensors"
    doubt = diagnosis & (s.isin("warning", "indeterminate") | ((norm(F.col("fault_type")) == "uncertain") & ~s.isin("normal", "unknown", "error", "data_unavailable")))
    good = reading & F.coalesce(useful if useful is not None else s != "error", F.lit(False))
    sure = diagnosis & ~doubt & (s == "fault") & (F.coalesce("confidence", F.lit(0.0)) >= 0.70)
    rows = calls.select("episode_id", "node_id", "i", reading.alias("reading"), F.coalesce(doubt, F.lit(False)).alias("doubt"), F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(sure, F.lit(False)).alias("sure"))
    node = Window.partitionBy("episode_id", "node_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("episode_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda flag: F.max(F.when(F.col(flag), F.col("i"))).over(node)
    rows = rows.withColumns({"d_": last("doubt"), "g_": last("good"), "s_": last("sure"), "any_": F.max("doubt").over(whole)})
    open_ = F.col("d_").isNotNull() & (F.col("g_").isNull() | (F.col("g_") < F.col("d_")))
    rows = rows.withColumns({"verifies": F.col("good") & open_, "blind": F.col("reading") & ~open_ & ~F.coalesce("any_", F.lit(False)), "stale": F.col("reading") & ~open_ & F.coalesce("any_", F.lit(False)), "late": F.col("reading") & ~open_ & F.col("s_").isNotNull()})
    nodes = rows.groupBy("episode_id", "node_id").agg(
        F.max("doubt").alias("doubted"), F.max("verifies").alias("verified"), F.max(F.when(F.col("doubt"), F.col("i"))).alias("d"), F.max(F.when(F.col("good"), F.col("i"))).alias("g"),
        *(F.count_if(c).alias(c) for c in ("reading", "blind", "stale", "late")), F.count_if("good").alias("useful"),
    )
    pending = F.col("doubted") & (F.col("g").isNull() | (F.col("g") < F.col("d")))
    return nodes.groupBy("episode_id").agg(
        F.sum("reading").alias("sensor_calls"), F.sum("useful").alias("useful_sensor_calls"), F.count_if("verified").alias("verified_nodes"), F.count_if(pending).alias("pending_nodes"),
        F.sum("blind").alias("blind_calls"), F.sum("stale").alias("stale_calls"), F.sum("late").alias("post_fault_calls"),
    ).withColumn("uncertain_nodes", F.col("verified_nodes") + F.col("pending_nodes"))


def sensor_reward(episodes: DataFrame, calls: DataFrame, useful: Column | None = None) -> DataFrame:
    """episode_id, sensor_verification."""
    s = episodes.select("episode_id").join(sensor_summary(calls, useful), "episode_id", "left")
    misuse, cover = _zero("blind_calls") + _zero("post_fault_calls"), F.col("verified_nodes") / F.col("uncertain_nodes")
    stale = F.least(F.lit(0.25), 0.08 * F.col("stale_calls"))
    value = (
        F.when(_zero("uncertain_nodes") == 0, F.when(misuse > 0, F.greatest(F.lit(-0.5), -0.25 - 0.10 * (misuse - 1))).otherwise(0.0))
        .when(cover >= 0.999, F.greatest(F.lit(0.75), 1.0 - stale)).when(cover > 0, F.greatest(F.lit(-0.2), 0.5 * cover - stale)).otherwise(-1.0)
    )
    return s.select("episode_id", value.alias("sensor_verification"))


def process_reward(episodes: DataFrame, calls: DataFrame, max_steps: int = 15) -> DataFrame:
    """episode_id, process: 1 less penalties for no answer, excess, repeats, errors, undiscovered nodes and calls long after a finding; in buckets. 0 without calls."""
    s = norm(F.col("status"))
    again = F.row_number().over(Window.partitionBy("episode_id", F.lower("tool"), F.coalesce("node_id", F.lit(""))).orderBy("i")) > 2
    g = calls.withColumn("r_", again).groupBy("episode_id").agg(F.count("*").alias("n"), F.count_if("r_").alias("repeats"), F.count_if(s == "error").alias("errors"), F.min(F.when(s.isin(*ABNORMAL), F.col("i"))).alias("hit"), F.max("i").alias("last"))
    ghosts = undiscovered(calls).groupBy("episode_id").agg(F.count("*").alias("ghosts"))
    e = episodes.select("episode_id", F.greatest(F.coalesce("optimal", F.lit(3)), F.lit(1)).alias("optimal"), _has().alias("has")).join(g, "episode_id", "left").join(ghosts, "episode_id", "left")
    later = F.greatest(F.coalesce(F.col("last") - F.col("hit"), F.lit(0)) - 3, F.lit(0))
    raw = (
        1.0 - F.when(F.col("has"), 0.0).when(_zero("n") >= max_steps, 1.2).otherwise(0.6) - F.least(F.lit(0.5), 0.08 * F.greatest(_zero("n") - F.col("optimal"), F.lit(0)))
        - F.least(F.lit(0.5), 0.12 * _zero("repeats")) - F.least(F.lit(0.8), 0.30 * _zero("errors")) - F.least(F.lit(0.7), 0.25 * _zero("ghosts")) - F.least(F.lit(0.4), 0.08 * later)
    )
    raw = F.round(raw, 9)
    return e.select("episode_id", F.when(_zero("n") == 0, 0.0).when(raw >= 0.8, 1.0).when(raw >= 0.4, 0.5).when(raw >= 0, 0.0).otherwise(F.greatest(F.lit(-1.0), raw)).alias("process"))


def cross_trace_reward(episodes: DataFrame, calls: DataFrame, plants: tuple[str, ...] = PLANTS) -> DataFrame:
    """episode_id, cross_trace: tracing to the root system where a fault crosses systems, a small penalty for it elsewhere.

    A fault crosses systems if ``gt_affected`` names several, or if its node is one of a plant.
    """
    named = F.array_distinct(F.filter(F.transform("gt_affected", norm), lambda x: ~x.isin("", "none", "normal"))) if "gt_affected" in episodes.columns else F.array().cast("array<string>")
    system, node = norm(F.col("gt_system")), norm(F.col("gt_node"))
    within = lambda n: n.startswith(F.concat(system, F.lit("::")))
    crosses = (F.size(named) > 1) | (system.isin(*plants) & within(node))
    said = F.coalesce(F.nullif(norm(F.col("diag_system")), F.lit("")), node_system(F.col("diag_node")))
    c = calls.select("episode_id", F.col("tool").alias("t_"), norm(F.col("node_id")).alias("n_"))
    j = episodes.select("episode_id", crosses.alias("crosses"), _has().alias("has"), _says_no_fault().alias("free"), said.alias("said"), node_system(F.col("diag_node")).alias("of_node"), system.alias("system"), node.alias("node"), F.concat(system, F.lit("::")).alias("within")).join(c, "episode_id", "left")
    asks = F.col("t_") == "diagnose_node"
    g = j.groupBy("episode_id", "crosses", "has", "free", "said", "of_node", "system").agg(
        F.max(F.coalesce(F.col("t_").isin("get_related_systems", "get_upstream_nodes"), F.lit(False))).alias("traced"), F.max(F.coalesce(F.col("t_") == "get_upstream_nodes", F.lit(False))).alias("up"),
        F.max(F.coalesce(asks & F.col("n_").startswith(F.col("within")), F.lit(False))).alias("in_system"), F.max(F.coalesce(asks & (F.col("n_") == F.col("node")), F.lit(False))).alias("at_node"),
    )
    bit = lambda c, v: F.when(c, v).otherwise(0.0)
    elsewhere = -0.25 - F.when(~F.col("has"), 0.25).when((F.col("said") != "") & (F.col("system") != "") & (F.col("said") != F.col("system")), 0.20).otherwise(0.0) - bit(F.col("up"), 0.10)
    answer = F.when(~F.col("has"), 0.0).when(F.col("free"), -0.70).when((F.col("of_node") != "") & (F.col("of_node") != F.col("system")), -0.45).when(F.col("of_node") == F.col("system"), 0.10).otherwise(0.0)
    score = bit(F.col("traced"), 0.15) + bit(F.col("up"), 0.15) + bit(F.col("in_system"), 0.35) + bit(F.col("at_node"), 0.35) + answer - bit(~F.col("in_system"), 0.35) - bit(~F.col("has"), 0.45)
    bounded = lambda x, high: F.greatest(F.lit(-1.0), F.least(F.lit(high), x))
    return g.select("episode_id", F.when(F.col("crosses"), bounded(score, 1.0)).when(F.col("traced"), bounded(elsewhere, 0.0)).otherwise(0.0).alias("cross_trace"))


def total_reward(terms: DataFrame, weights: dict[str, float] = WEIGHTS, max_steps: int = 15, digits: int = 4) -> DataFrame:
    """episode_id, total: weighted terms behind their gates, less explicit penalties.

    terms: episode_id, has, n_calls, conflict, grounding, epo_violation and a column for each weight.
    """
    t = {k: F.col(k) for k in weights}
    wrong, gated = F.col("accuracy") <= 0, F.col("accuracy") < 0.3
    t["efficiency"] = F.when(gated, 0.0).otherwise(t["efficiency"])
    t["completeness"] = F.when(gated | (F.col("has") & wrong), 0.0).otherwise(t["completeness"])
    t["reasoning"] = F.when(F.col("has"), t["reasoning"]).otherwise(F.least(t["reasoning"], F.lit(0.3)))
    t["topology"] = F.when(F.col("has"), t["topology"]).otherwise(0.0)
    t["evidence"] = F.when(F.col("has") & wrong, F.least(t["evidence"], F.lit(0.20))).otherwise(t["evidence"])
    total = sum((w * t[k] for k, w in weights.items()), F.lit(0.0))
    total -= F.when(~F.col("has"), 0.30 + F.when(F.col("n_calls") >= max_steps, 0.15).otherwise(0.0)).when(wrong, 0.12).otherwise(0.0)
    for name, w in (("consistency", 0.15), ("sensor_verification", 0.10), ("cross_trace", 0.10), ("process", 0.08)):
        total += w * F.least(F.col(name), F.lit(0.0))
    total += F.col("grounding") - 0.05 * F.greatest(F.col("conflict"), F.lit(0.0)) - 0.08 * F.greatest(F.col("epo_violation"), F.lit(0.0)) - 0.001 * F.col("n_calls")
    return terms.select("episode_id", F.round(total, digits).alias("total"))


def tool_support(episodes: DataFrame, calls: DataFrame) -> DataFrame:
    """episode_id, consistency (1, 0.5 or 0: is the diagnosis what tools showed?) and unsupported (null unless a fault is named)."""
    clean = is_no_fault_label(F.col("gt_fault"))
    c = calls.where(norm(F.col("status")).isin(*ABNORMAL)).select("episode_id", norm(F.col("node_id")).alias("n_"), F.col("fault_type").alias("f_"))
    j = episodes.select("episode_id", "diag_node", "diag_fault", _has().alias("has"), _says_no_fault().alias("free"), clean.alias("clean")).join(c, "episode_id", "left")
    own = F.col("n_") == norm(F.col("diag_node"))
    backs = own & (norm(F.col("f_")).isin("", "none", "uncertain") | exact_match(F.col("f_"), F.col("diag_fault")) | same_family(F.col("f_"), F.col("diag_fault")))
    g = j.groupBy("episode_id", "has", "free", "clean").agg(F.count("n_").alias("n"), F.count_if(own).alias("own"), F.count_if(backs).alias("backs"))
    value = F.when(~F.col("has"), 0.0).when(F.col("free"), ((F.col("n") == 0) & F.col("clean")).cast("double")).when(F.col("own") == 0, 0.0).when(F.col("backs") > 0, 1.0).otherwise(0.5)
    return g.select("episode_id", value.alias("consistency"), F.when(F.col("has") & ~F.col("free"), (F.col("own") == 0).cast("double")).alias("unsupported"))


#: Weights of the score that selects a model.
SELECTION = {
    "balanced_da": 0.34, "root_node": 0.19, "family": 0.15, "se": 0.10, "tir": 0.10, "oracle_consistency": 0.04, "support": 0.05, "sensor_verification": 0.02, "cross_balanced_da": 0.04,
    "cross_trace": 0.02, "authenticity": 0.03, "conflict": -0.03, "no_action": -0.08, "truncated": -0.04, "tool_error": -0.05, "timeout": -0.03,
}


def balanced(a: Column, b: Column) -> Column:
    """Mean of two accuracies; the one that there is, 0 without any."""
    return F.coalesce((a + b) / 2, a, b, F.lit(0.0))


def selection_score(metrics: DataFrame, weights: dict[str, float] = SELECTION) -> DataFrame:
    """``metrics`` with selection_score and paper_mean (of da, tr, ecr and se)."""
    score = sum((w * F.coalesce(F.col(k), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0)) - 0.05 * F.greatest(F.lit(0.0), 0.40 - F.col("cross_balanced_da"))
    return metrics.withColumn("selection_score", score).withColumn("paper_mean", (F.col("da") + F.col("tr") + F.col("ecr") + F.col("se")) / 4)
