"""Evidence fusion over observations(episode_id, step, node_id, system_id, status, fault_type, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import canonical_label, family
from ..functions.maths import ABNORMAL, NORMAL, clip, polarity, reliability


def signed(observations: DataFrame, audit: bool = False) -> DataFrame:
    """With reliability and polarity; rows that carry no evidence are left out."""
    extra = {"model_source": F.col("model_source"), "calibration": F.col("calibration"), "coverage": F.col("feature_coverage")} if audit else {}
    rows = observations.withColumn("reliability", reliability(F.col("status"), F.col("node_id"), F.col("confidence"), **extra))
    rows = rows.withColumn("polarity", polarity(F.col("status"), F.col("reliability")))
    s = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    useful = (F.coalesce("node_id", F.lit("")) != "") | s.isin(*ABNORMAL, *NORMAL)
    return rows.where(useful & ((F.col("reliability") > 0) | (s == "unknown")))


def _in_order(rows: DataFrame, by: list[str], values: dict[str, Column], order: str) -> DataFrame:
    """Sums of ``values`` and the count ``n`` of each group, its rows added one by one by ``order``.

    Sums of doubles that should be zero end a bit above or below it by the order of adding; partial sums of tasks come in any order, these don't.
    """
    w = Window.partitionBy(*by).orderBy(order, *values).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*by, order, *(v.alias(k) for k, v in values.items()))
    rows = rows.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(order, *values)).alias("n"), *(F.sum(k).over(w).alias(k) for k in values))
    return rows.groupBy(*by).agg(*(F.max_by(k, "n").alias(k) for k in values), F.max("n").cast("long").alias("n"))


def fuse(observations: DataFrame, order: str | None = None) -> DataFrame:
    """Signed, positive and negative mass of each (episode, node); with ``order`` the rows are added in that order, so the sign of a score near zero is the same in every run."""
    p = F.col("polarity")
    masses = {"score": p, "positive": F.greatest(p, F.lit(0.0)), "negative": F.greatest(-p, F.lit(0.0))}
    if order:
        return _in_order(signed(observations), ["episode_id", "node_id"], masses, order)
    return signed(observations).groupBy("episode_id", "node_id").agg(*(F.sum(v).alias(k) for k, v in masses.items()), F.count("*").alias("n"))


def system_scores(observations: DataFrame, order: str | None = None) -> DataFrame:
    """score of each (episode, system); ``order`` as in ``fuse``."""
    rows, by, score = signed(observations).where("system_id IS NOT NULL AND system_id <> ''"), ["episode_id", "system_id"], F.col("polarity") * 0.75
    if order:
        return _in_order(rows, by, {"score": score}, order).drop("n")
    return rows.groupBy(*by).agg(F.sum(score).alias("score"))


def votes(observations: DataFrame) -> DataFrame:
    """Evidence of abnormal observations for each (node, fault)."""
    rows = signed(observations).where(F.lower(F.trim("status")).isin(*ABNORMAL))
    return rows.groupBy("episode_id", "node_id", "fault_type").agg(F.sum("polarity").alias("votes"))


def episode_masses(fused: DataFrame) -> DataFrame:
    """Masses of an episode and its conflict: mean over nodes with both signs of smaller by larger mass."""
    both = (F.col("positive") > 0) & (F.col("negative") > 0)
    ratio = F.when(both, F.least("positive", "negative") / F.greatest("positive", "negative"))
    return fused.groupBy("episode_id").agg(F.sum("positive").alias("positive_mass"), F.sum("negative").alias("negative_mass"), F.coalesce(F.avg(ratio), F.lit(0.0)).alias("conflict"))


def belief(scores: DataFrame, by: str = "episode_id") -> DataFrame:
    """Softmax over the positive scores of each episode."""
    pos = scores.where("score > 0")
    w = Window.partitionBy(by)
    power = F.exp(F.col("score") - F.max("score").over(w))
    return pos.withColumn("power_", power).withColumn("belief", F.col("power_") / F.sum("power_").over(w)).drop("power_")


def candidates(observations: DataFrame, k: int = 5) -> DataFrame:
    """The k worst nodes of each episode by severity, confidence and id."""
    s = F.lower(F.trim("status"))
    severity = F.when(s == "fault", 3).when(s.isin("alert", "warning"), 2).when(s == "abnormal", 1)
    w = Window.partitionBy("episode_id").orderBy(F.desc("severity"), F.desc_nulls_last("confidence"), "node_id", "step")
    rows = observations.withColumn("severity", severity).where("severity IS NOT NULL")
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def next_actions(candidates_: DataFrame, beliefs: DataFrame, checked: DataFrame, k: int = 5) -> DataFrame:
    """candidates(episode_id, node_id, system_id, position) scored .50 system belief + .35 (1 - .35 if checked); top k."""
    rows = candidates_.join(beliefs.select("episode_id", "system_id", "belief"), ["episode_id", "system_id"], "left")
    rows = rows.join(checked.select("episode_id", "node_id").distinct().withColumn("checked_", F.lit(1.0)), ["episode_id", "node_id"], "left")
    score = 0.5 * F.coalesce("belief", F.lit(0.0)) + 0.35 * (1 - 0.35 * F.coalesce("checked_", F.lit(0.0)))
    w = Window.partitionBy("episode_id").orderBy(F.desc("score"), "position")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def support(no_fault: Column, any_abnormal: Column, n_observed: Column, negative_mass: Column, has_abnormal: Column, score: Column, belief_: Column, fault: Column, observed_fault: Column, conflict: Column) -> Column:
    """Support of a diagnosis by the evidence on its own node."""
    bonus = F.when(canonical_label(fault) == canonical_label(observed_fault), 0.35).when(family(fault) == family(observed_fault), 0.25).when(canonical_label(observed_fault).isin("", "none", "uncertain"), 0.10).otherwise(0.0)
    named = clip(0.25 + 0.35 * clip(F.coalesce(score, F.lit(0.0))) + 0.25 * F.coalesce(belief_, F.lit(0.0)) + bonus - 0.25 * F.coalesce(conflict, F.lit(0.0)))
    clean = F.when(any_abnormal, 0.0).when(n_observed == 0, 0.3).otherwise(clip(0.45 + 0.45 * clip(negative_mass)))
    return F.round(F.when(no_fault, clean).when(has_abnormal, named).otherwise(0.0), 4)


def gap(beliefs: DataFrame, by: str = "episode_id") -> DataFrame:
    """How far the strongest belief of each episode leads the next; a single one leads by all of it."""
    top = F.slice(F.sort_array(F.collect_list("belief"), asc=False), 1, 2)  # an episode's nodes
    return beliefs.groupBy(by).agg(top.alias("t_")).select(by, (F.get("t_", F.lit(0)) - F.coalesce(F.get("t_", F.lit(1)), F.lit(0.0))).alias("gap"))


def flatten_results(results: DataFrame, by: list[str]) -> DataFrame:
    """Results as single observations: by, node_id, status.

    results(by, node_id, status, node_statuses, candidate_nodes): a result itself if it names a node or a diagnostic status, what it lists of
    node statuses, and candidates that it has not named already.
    """
    s = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    own = (F.coalesce("node_id", F.lit("")) != "") | s.isin(*ABNORMAL, "normal", "unknown")
    one = F.struct("node_id", "status")
    none = F.array().cast("array<struct<node_id:string,status:string>>")
    listed = F.concat(F.when(own, F.array(one)).otherwise(none), F.coalesce("node_statuses", none))
    more = F.filter(F.array_distinct(F.coalesce("candidate_nodes", none)), lambda c: ~F.array_contains(listed, c))
    return results.select(*by, F.explode(F.concat(listed, more)).alias("x_")).select(*by, "x_.node_id", "x_.status")
