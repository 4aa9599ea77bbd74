"""Episode metrics and rewards.

episodes: episode_id, scenario_type, difficulty, gt_system, gt_node, gt_fault, optimal, ref_nodes array<string>, perhaps ref_edges
array<struct<src,dst>> (the relations on the way from symptom to cause, which then make up ``tr``), diag_node, diag_fault, diag_system, diag_confidence (null without a diagnosis).
calls: episode_id, i, tool, node_id, system_id, valid, status, fault_type, confidence, targets array<string>; one row a call with its result.
Every per-episode measure is a column of ``episode_scores``; empty input gives 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import exact_match, is_no_fault_label, is_no_fault_node, mutual_substring, node_system, norm, same_family
from ..functions.maths import ABNORMAL, reliability
from .evidence import belief, episode_masses, fuse, support

#: Weights of the composites, and the reliability from which a normal result reviews a node.
REVIEWED = 0.20
AGGREGATE = {"da": 0.25, "format": 0.15, "completeness": 0.15, "se": 0.15, "tir": 0.15, "tr": 0.15}
NAVIGATION = ("get_system_overview", "get_node_children", "get_downstream_nodes", "get_upstream_nodes", "get_related_systems")


def _flag(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def first_seen(calls: DataFrame, own: bool = True) -> DataFrame:
    """(episode_id, node, seen): the first step whose result shows a node; with ``own`` a result also shows the node that was asked about."""
    shown = F.coalesce("targets", F.array().cast("array<string>"))
    shown = F.concat(shown, F.array("node_id")) if own else shown
    rows = calls.select("episode_id", "i", F.explode(shown).alias("node"))
    return rows.where(F.contains("node", F.lit("::"))).groupBy("episode_id", "node").agg(F.min("i").alias("seen"))


def undiscovered(calls: DataFrame, own: bool = True) -> DataFrame:
    """Diagnoses of nodes that no earlier result had shown, once something had been shown: (episode_id, i)."""
    seen = first_seen(calls, own)
    began = seen.groupBy("episode_id").agg(F.min("seen").alias("began"))
    asked = calls.where((F.col("tool") == "diagnose_node") & (F.coalesce("node_id", F.lit("")) != "") & ~F.col("node_id").startswith("system::")).select("episode_id", "i", F.col("node_id").alias("node"))
    rows = asked.join(began, "episode_id").where("began < i").join(seen, ["episode_id", "node"], "left")
    return rows.where(F.col("seen").isNull() | (F.col("seen") >= F.col("i"))).select("episode_id", "i")


def call_flags(calls: DataFrame) -> DataFrame:
    """Per call: repeated, undiscovered, after a fault, wrong opening, and irrational if any holds or it is invalid."""
    w = Window.partitionBy("episode_id").orderBy("i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    again = F.row_number().over(Window.partitionBy("episode_id", "tool", "node_id").orderBy("i")) > 1
    faulted = F.coalesce(F.max((F.lower("status") == "fault").cast("int")).over(before), F.lit(0)) == 1
    rows = calls.withColumn("first_", F.row_number().over(w) == 1).withColumn("faulted_", faulted).withColumn("again_", again)
    rows = rows.join(undiscovered(calls, own=False).withColumn("ghost_", F.lit(True)), ["episode_id", "i"], "left")
    flags = {
        "repeated": F.col("again_") & F.col("tool").isin("get_node_children", "diagnose_node"), "undiscovered": F.col("ghost_"),
        "after_fault": F.col("faulted_") & F.col("tool").isin("get_system_overview", "get_related_systems", "get_node_children"),
        "wrong_opening": F.col("first_") & ~F.col("tool").isin("get_system_overview", "get_node_children"),
    }
    rows = rows.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
    return rows.withColumn("irrational", ~F.coalesce("valid", F.lit(False)) | F.col("repeated") | F.col("undiscovered") | F.col("after_fault") | F.col("wrong_opening")).drop("first_", "ghost_", "faulted_", "again_")


def sensor_checks(calls: DataFrame) -> DataFrame:
    """Per episode: an uncertain diagnosis, and whether a later sensor reading of such a node verified it."""
    s = norm(F.col("status"))
    uncertain = (F.col("tool") == "diagnose_node") & (s.isin("unknown", "warning", "indeterminate") | (F.coalesce("confidence", F.lit(1.0)) < 0.6))
    w = Window.partitionBy("episode_id", "node_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pending = F.coalesce(F.max(uncertain.cast("int")).over(w), F.lit(0)) == 1
    reading = (F.col("tool") == "get_node_sensors") & (s == "success")
    rows = calls.withColumn("u_", uncertain).withColumn("v_", reading & pending).withColumn("blind_", (F.col("tool") == "get_node_sensors") & ~pending)
    return rows.groupBy("episode_id").agg(F.max(F.coalesce("u_", F.lit(False))).alias("eligible"), F.max(F.coalesce("v_", F.lit(False))).alias("verified"), F.count_if("blind_").alias("n_blind"), F.count_if(F.col("tool") == "get_node_sensors").alias("n_sensor"))


def edge_coverage(episodes: DataFrame, calls: DataFrame) -> DataFrame:
    """episode_id, edges: share of the reference relations that results showed, in either direction; null without any."""
    ends = lambda a, b: (F.least(a, b).alias("a_"), F.greatest(a, b).alias("b_"))
    refs = episodes.select("episode_id", F.explode("ref_edges").alias("e")).select("episode_id", *ends(norm(F.col("e.src")), norm(F.col("e.dst"))))
    seen = calls.select("episode_id", norm(F.col("node_id")).alias("n_"), F.explode("targets").alias("t_")).select("episode_id", *ends(F.col("n_"), norm(F.col("t_")))).distinct().withColumn("seen_", F.lit(1.0))
    return refs.join(seen, ["episode_id", "a_", "b_"], "left").groupBy("episode_id").agg(F.avg(F.coalesce("seen_", F.lit(0.0))).alias("edges"))


def episode_scores(episodes: DataFrame, calls: DataFrame) -> DataFrame:
    """One row for each episode with its measures (see the module)."""
    flagged = call_flags(calls).groupBy("episode_id").agg(
        F.count("*").alias("n_calls"), F.count_if("valid").alias("n_valid"), F.count_if("irrational").alias("n_irrational"),
        F.count_if(norm(F.col("status")) == "error").alias("n_errors"), F.max(norm(F.col("status")).isin(*ABNORMAL)).alias("any_abnormal"),
        F.count_if(F.col("tool") == "diagnose_node").alias("n_diagnosed"), F.max((F.col("tool") == "get_related_systems").cast("int")).alias("related_"),
        F.collect_set(F.when((norm(F.col("status")) == "normal") & (reliability(F.col("status"), F.col("node_id"), F.col("confidence")) >= REVIEWED), F.col("node_id"))).alias("calm"),
        F.array_distinct(F.flatten(F.collect_list(F.concat(F.array(F.coalesce("node_id", F.lit(""))), F.coalesce("targets", F.array().cast("array<string>")))))).alias("visited"),
    )
    fused = fuse(calls)
    masses = episode_masses(fused)
    own = belief(fused.select("episode_id", "node_id", "score")).select("episode_id", "node_id", "score", "belief")
    named = calls.where(norm(F.col("status")).isin(*ABNORMAL)).groupBy("episode_id", "node_id").agg(F.max("fault_type").alias("seen_fault"))
    e = episodes.join(flagged, "episode_id", "left").join(masses, "episode_id", "left").join(sensor_checks(calls), "episode_id", "left")
    e = e.join(edge_coverage(episodes, calls), "episode_id", "left") if "ref_edges" in episodes.columns else e.withColumn("edges", F.lit(None).cast("double"))
    e = e.join(own.withColumnRenamed("node_id", "diag_node"), ["episode_id", "diag_node"], "left").join(named.withColumnRenamed("node_id", "diag_node"), ["episode_id", "diag_node"], "left")
    has = F.col("diag_node").isNotNull() | F.col("diag_fault").isNotNull()
    clean = is_no_fault_label(F.col("gt_fault"))
    says = is_no_fault_label(F.col("diag_fault")) & is_no_fault_node(F.col("diag_node"))
    strict = has & says & ~F.coalesce("any_abnormal", F.lit(False))
    node, exact = mutual_substring(F.col("gt_node"), F.col("diag_node")), exact_match(F.col("gt_fault"), F.col("diag_fault"))
    right = node & exact
    n = F.coalesce("n_calls", F.lit(0)).cast("double")
    optimal = F.when(F.col("optimal") > 0, F.col("optimal")).otherwise(3).cast("double")
    system = F.coalesce(F.nullif(norm(F.col("diag_system")), F.lit("")), node_system(F.col("diag_node")))
    refs, calm = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in ("ref_nodes", "calm"))
    hit = F.size(F.array_intersect(refs, F.coalesce("visited", F.array().cast("array<string>")))).cast("double")
    backing = support(has & says, F.coalesce("any_abnormal", F.lit(False)), F.coalesce("n_diagnosed", F.lit(0)), F.coalesce("negative_mass", F.lit(0.0)), F.col("seen_fault").isNotNull(), F.col("score"), F.col("belief"), F.col("diag_fault"), F.col("seen_fault"), F.col("conflict"))
    tir = F.when(n > 0, 1 - (F.coalesce("n_irrational", F.lit(0)) + F.when(has, 0).otherwise(1)) / (n + F.when(has, 0).otherwise(1))).otherwise(0.0)
    filled = sum((_flag(F.coalesce(F.col(c).cast("string"), F.lit("")) != "") for c in ("diag_node", "diag_fault", "diag_confidence")), F.lit(0.0)) / 3
    out = e.select(
        "episode_id", "scenario_type", "difficulty", clean.alias("is_no_fault"),
        _flag(F.when(clean, strict).otherwise(has & right)).alias("da"), _flag(F.when(clean, strict).otherwise(has & (system != "") & (system == norm(F.col("gt_system"))))).alias("root_system"),
        _flag(F.when(clean, strict).otherwise(has & node)).alias("root_node"), _flag(F.when(clean, strict).otherwise(has & node & (exact | same_family(F.col("gt_fault"), F.col("diag_fault"))))).alias("family"),
        F.when(has & (n > 0), F.least(F.lit(1.0), optimal / n)).otherwise(0.0).alias("se"), (F.coalesce("n_valid", F.lit(0)) / F.greatest(n, F.lit(1.0))).alias("format"), filled.alias("completeness"),
        F.coalesce("edges", F.when(F.size(refs) > 0, hit / F.size(refs)).otherwise(tir)).alias("tr"), tir.alias("tir"), F.when(has, backing).otherwise(0.0).alias("support"), F.coalesce("conflict", F.lit(0.0)).alias("conflict"),
        _flag(F.col("eligible")).alias("eligible"), _flag(F.col("eligible") & F.col("verified")).alias("verified"), F.coalesce("n_errors", F.lit(0)).alias("n_errors"), n.alias("n_calls"), _flag(~has).alias("no_diagnosis"),
        _flag(F.col("related_") == 1).alias("cross_trace"), F.when(~clean, 0.0).when(F.size(refs) == 0, _flag(strict)).otherwise(F.size(F.array_intersect(refs, calm)) / F.size(refs)).alias("review"),
        (strict & F.when(F.size(refs) == 0, F.size(calm) > 0).otherwise(F.size(F.array_except(refs, calm)) == 0)).alias("reviewed_"),
    )
    closed = F.when(F.col("is_no_fault"), F.col("reviewed_") & (F.col("conflict") <= 0.05)).otherwise((F.col("no_diagnosis") == 0) & (F.col("support") >= 0.55) & (F.col("conflict") <= 0.35))
    return out.withColumn("ecr", _flag(closed)).drop("reviewed_")


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def report(scores: DataFrame) -> DataFrame:
    """Overall, by scenario type and by difficulty, in one pass of grouping sets."""
    cols = ["da", "root_system", "root_node", "family", "se", "format", "completeness", "tr", "tir", "ecr", "support", "conflict", "no_diagnosis"]
    aggs = [F.count("*").alias("n"), *(_mean(F.col(c)).alias(c) for c in cols)]
    aggs += [(F.sum("verified") / F.greatest(F.sum("eligible"), F.lit(1.0))).alias("sensor_verification"), (F.sum("n_errors") / F.greatest(F.sum("n_calls"), F.lit(1.0))).alias("tool_error_rate")]
    aggs += [F.coalesce(F.avg(F.when(F.col("is_no_fault"), F.col("review"))), F.lit(0.0)).alias("no_fault_review"), F.coalesce(F.avg(F.when(F.col("is_no_fault"), F.col("da"))), F.lit(0.0)).alias("no_fault_da"), F.coalesce(F.avg(F.when(~F.col("is_no_fault"), F.col("da"))), F.lit(0.0)).alias("fault_da")]
    out = scores.groupingSets([[], ["scenario_type"], ["difficulty"]], "scenario_type", "difficulty").agg(*aggs, F.grouping_id().cast("long").alias("gid"))
    out = out.withColumn("balanced_da", (F.col("no_fault_da") + F.col("fault_da")) / 2)
    return out.withColumn("aggregate", sum((F.col(k) * w for k, w in AGGREGATE.items()), F.lit(0.0)))


def behaviour(episodes: DataFrame, calls: DataFrame, max_steps: int = 15) -> DataFrame:
    """Per episode what the rates of ``selection`` count: wrong_system (null without a fault), root_belief, n_blind, n_sensor, and flags, null where they don't apply.

    root_belief is the share of belief that the fused evidence gives the true root; without a fault, how well it backs that there is none.
    """
    used = lambda *names: F.max(F.col("tool").isin(*names))
    seen = calls.groupBy("episode_id").agg(
        F.count("*").alias("n_"), used("get_node_sensors").alias("read_"), used("get_related_systems", "get_upstream_nodes").alias("traced_"), F.max(norm(F.col("status")).isin(*ABNORMAL)).alias("bad_"), F.count_if(F.col("tool") == "diagnose_node").alias("asked_"),
    )
    fused = fuse(calls)
    of_root = belief(fused.select("episode_id", "node_id", "score")).select("episode_id", F.col("node_id").alias("gt_node"), "belief")
    e = episodes.join(seen, "episode_id", "left").join(episode_masses(fused), "episode_id", "left").join(of_root, ["episode_id", "gt_node"], "left").join(sensor_checks(calls).select("episode_id", "n_blind", "n_sensor"), "episode_id", "left")
    clean = is_no_fault_node(F.col("gt_node")) | is_no_fault_label(F.col("gt_fault"))
    has = F.col("diag_node").isNotNull() | F.col("diag_fault").isNotNull()
    system = F.coalesce(F.nullif(norm(F.col("diag_system")), F.lit("")), node_system(F.col("diag_node")), F.lit(""))
    no = F.lit(None).cast("string")
    calm = support(F.lit(True), F.coalesce("bad_", F.lit(False)), F.coalesce("asked_", F.lit(0)), F.coalesce("negative_mass", F.lit(0.0)), F.lit(False), F.lit(0.0), F.lit(0.0), no, no, F.lit(0.0))
    kind = norm(F.col("scenario_type"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return e.select(
        "episode_id", F.when(~clean, flag(~has | (system == "") | (system != norm(F.col("gt_system"))))).alias("wrong_system"), F.when(clean, calm).otherwise(F.round(F.coalesce("belief", F.lit(0.0)), 4)).alias("root_belief"),
        F.coalesce("n_blind", F.lit(0)).alias("n_blind"), F.coalesce("n_sensor", F.lit(0)).alias("n_sensor"), F.when(F.contains(kind, F.lit("low_confidence")), flag(F.col("read_"))).alias("low_confidence_read"),
        F.when(F.contains(kind, F.lit("cross_system")), flag(F.col("traced_"))).alias("cross_traced"), flag(~has & (F.coalesce("n_", F.lit(0)) >= max_steps)).alias("ran_out"),
    )


def output_rates(outputs: DataFrame) -> DataFrame:
    """One row of rates of outputs(episode_id, event, truncated, timeout), one row an agent's text: without action, truncated, over time, and with action."""
    rate = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    out = outputs.agg(F.count("*").alias("n_outputs"), rate(F.col("event") == "no_action").alias("no_action"), rate(F.col("truncated")).alias("truncated"), rate(F.col("timeout")).alias("timeout"))
    return out.withColumn("action_completion", 1 - F.col("no_action"))


def selection(scores: DataFrame, acts: DataFrame, backed: DataFrame, rates: DataFrame) -> DataFrame:
    """One row of what a model is selected by: means of ``episode_scores``, of ``behaviour`` and of ``rewards.tool_support``, with the row of ``output_rates``.

    Accuracies with and without a fault, and of plain and ambiguous cross-system scenarios, are balanced; a kind that isn't there doesn't count.
    """
    from .rewards import balanced

    j = scores.join(acts, "episode_id").join(backed, "episode_id", "left")
    part = lambda c: F.avg(F.when(c, F.col("da")))
    kind, clean = norm(F.col("scenario_type")), F.col("is_no_fault")
    share = lambda a, b: F.sum(a) / F.greatest(F.sum(b), F.lit(1.0))
    one = j.agg(
        F.count("*").alias("n"), *(_mean(F.col(c)).alias(c) for c in ("da", "root_system", "root_node", "family", "se", "tr", "tir", "ecr", "support", "conflict", "wrong_system", "root_belief", "ran_out")),
        _mean(F.col("consistency")).alias("oracle_consistency"), _mean(F.col("unsupported")).alias("unsupported"), _mean(F.col("low_confidence_read")).alias("low_confidence_read"), _mean(F.col("cross_traced")).alias("cross_trace"),
        _mean(F.when(F.contains(kind, F.lit("cross_system")), F.col("root_system"))).alias("cross_root_system"), share("n_blind", "n_sensor").alias("blind_rate"), share("verified", "eligible").alias("sensor_verification"), share("n_errors", "n_calls").alias("tool_error"),
        balanced(part(clean), part(~clean)).alias("balanced_da"), balanced(part(kind == "cross_system"), part(kind == "a_cross_system")).alias("cross_balanced_da"),
    )
    single = lambda df: df.withColumn("one_", F.lit(1))  # noqa: E731  two single rows side by side
    return single(one).join(single(rates), "one_").drop("one_")


def accuracy_reward(has: Column, gt_no_fault: Column, says_no_fault: Column, node: Column, exact: Column, fam: Column, system: Column, complete: Column) -> Column:
    """The first rule that holds: see the ladder below."""
    return (
        F.when(~has, 0.0).when(gt_no_fault, F.when(says_no_fault, 1.0).otherwise(-0.3)).when(says_no_fault, -0.6).when(~complete, 0.0)
        .when(node & exact, 1.0).when(node & fam, 0.70).when(node, 0.45).when(system & exact, 0.25).when(system & fam, 0.20).when(system, 0.10).otherwise(0.0)
    )


def efficiency_reward(n_calls: Column, optimal: Column, max_steps: int = 15) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.greatest(n_calls - optimal, F.lit(0)) / F.lit(float(max_steps)))
