"""Evidence-potential state machine: one ordered fold per episode over sorted partitions.

The state of an episode is at most ``LIMIT`` candidates with their belief, the links seen so far, the mode and the
potential.  Steps are dealt by episode and sorted, then folded as Arrow batches pass, so a task holds one episode's state at a time.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import exact_match, is_no_fault_label, is_no_fault_node, norm
from ..functions.maths import clip, reliability
from .lineage import cut

LIMIT = 24
#: Fixed values of the update, the terminal rewards and the review of episodes without a fault.
CONFIG = {
    "close": 0.25, "reopen": 0.10, "conflict_on": 0.35, "conflict_off": 0.15, "conflict_reliability": 0.55, "gap_conflict": 0.45, "gap_entropy": 0.20,
    "conflict_potential": 0.65, "scale": 0.75, "step_cost": 0.025, "other_tool": 0.35, "smooth": 1e-3, "start": 0.25, "least_confidence": 0.05, "normal_elsewhere": 0.15,
    "unclear": 0.05, "correct": 1.0, "wrong": 1.0, "open": 0.35, "normal_reliability": 0.20, "review": 1.0,
}
SEVERITY = {"fault": 1.0, "alert": 1.0, "warning": 0.72, "abnormal": 0.55}
TRACE = "episode_id string, step int, reliability double, gap double, entropy double, conflict double, closure double, potential double, potential_delta double, mode string, shaping_reward double, top_candidate string, top_belief double, n_candidates int"
STEP = ["episode_id", "step", "tool", "node_id", "status", "confidence", "targets", "trust"]


def trust(columns: list[str]) -> Column:
    """Reliability of each step's result; model_source, calibration and feature_coverage count where there are such columns."""
    extra = {k: F.col(c) for k, c in (("model_source", "model_source"), ("calibration", "calibration"), ("coverage", "feature_coverage")) if c in columns}
    return reliability(F.col("status"), F.col("node_id"), F.col("confidence"), **extra)


def _plain_trust(r: dict) -> float:
    """The same of a plain result without a model's columns."""
    if str(r.get("status") or "").strip().lower() in ("error", "unknown"):
        return 0.0
    c = r.get("confidence")
    c = 0.5 if c is None else min(1.0, max(0.0, float(c)))
    return round(min(1.0, (0.40 if r.get("node_id") else 0.15) * (0.35 + 0.65 * c)), 4)


def _distance(a: str, b: str, links: dict[str, set]) -> int | None:
    if a == b:
        return 0
    near = links.get(a, set())
    if b in near:
        return 1
    return 2 if any(b in links.get(x, set()) for x in near) else None


def _fit(a: str, b: str, links: dict[str, set]) -> float:
    d = _distance(a, b, links)
    if d is not None:
        return (1.0, 0.55, 0.30)[d]
    own = lambda n: n.split("::")[1 if n.startswith("system::") else 0] if "::" in n else ""
    return 0.18 if own(a) and own(a) == own(b) else 0.0


def _normal(d: dict[str, float]) -> dict[str, float]:
    s = sum(d.values())
    return {k: v / s for k, v in d.items()} if s > 0 else {k: 1 / len(d) for k in d}


def start() -> dict:
    return {"candidates": [], "belief": {}, "links": {}, "mode": "open", "potential": CONFIG["start"]}


def step(state: dict, tool: str, result: dict) -> tuple[dict, dict]:
    """(next state, trace row) after one tool result; ``result`` may list nodes under 'targets'."""
    c = CONFIG
    status, node = str(result.get("status") or "").strip().lower(), result.get("node_id") or ""
    names, links = list(state["candidates"]), state["links"]
    targets = [t for t in result.get("targets") or [] if t]
    if targets:
        links = {k: set(v) for k, v in links.items()}
        for t in targets:
            if node and t != node:
                links.setdefault(node, set()).add(t)
                links.setdefault(t, set()).add(node)
    new = []
    if tool == "diagnose_node":
        new = [node] if node and (status in SEVERITY or not names) else []
    elif tool == "get_node_sensors":
        new = [node] if node and not names else []
    elif tool in ("get_upstream_nodes", "get_downstream_nodes", "get_node_children", "get_related_systems"):
        new = targets
    for n in new:
        if n not in names and len(names) < LIMIT:
            names.append(n)
    out = {"reliability": 0.0, "gap": 0.0, "entropy": 0.0, "conflict": 0.0}
    belief = _normal({n: state["belief"].get(n, c["smooth"]) for n in names}) if names else {}
    if names:
        rho = (_plain_trust(result) if result.get("trust") is None else result["trust"]) * (1.0 if tool == "diagnose_node" else c["other_tool"])
        seen = node if tool in ("diagnose_node", "get_node_sensors") else ""
        evidence = dict.fromkeys(names, c["smooth"])
        if not seen:
            evidence = dict.fromkeys(names, 1.0)
        elif status in SEVERITY:
            strength = min(1.0, max(c["least_confidence"], float(result.get("confidence") or 0.0))) * SEVERITY[status]
            for n in names:
                evidence[n] += strength * _fit(n, seen, links)
        elif status in ("normal", "success"):
            for n in names:
                evidence[n] += c["smooth"] if n == seen else c["normal_elsewhere"] * (1 - 0.5 * _fit(n, seen, links))
        elif seen in evidence:
            evidence[seen] += c["unclear"]
        evidence = _normal(evidence)
        js = 0.0
        for n in names:
            p, q = evidence[n], belief[n]
            m = (p + q) / 2
            js += ((p * math.log(p / m) if p > 0 else 0) + (q * math.log(q / m) if q > 0 else 0)) / 2
        conflict = rho * min(1.0, max(0.0, js))
        belief = _normal({n: belief[n] ** (1 - rho) * evidence[n] ** rho for n in names})
        top = sorted(belief.values(), reverse=True)
        h = -sum(p * math.log(p) for p in top if p > 0) / math.log(len(top)) if len(top) > 1 else 0.0
        out = {"reliability": rho, "gap": top[0] - top[1] if len(top) > 1 else 1.0, "entropy": h, "conflict": conflict}
    closure = out["gap"] - c["gap_conflict"] * out["conflict"] - c["gap_entropy"] * out["entropy"]
    mode = state["mode"]
    if out["reliability"] >= c["conflict_reliability"] and out["conflict"] >= c["conflict_on"]:
        mode = "conflict"
    elif mode != "conflict" and closure >= c["close"]:
        mode = "closed"
    elif (mode == "closed" and closure < c["reopen"]) or (mode == "conflict" and out["conflict"] <= c["conflict_off"]):
        mode = "open"
    potential = max(0.0, c["close"] - closure) + (c["conflict_potential"] if mode == "conflict" else 0.0)
    delta = state["potential"] - potential
    row = out | {"closure": closure, "potential": potential, "potential_delta": delta, "mode": mode, "shaping_reward": c["scale"] * delta - c["step_cost"], "top_candidate": max(belief, key=belief.get) if belief else "", "top_belief": max(belief.values(), default=0.0), "n_candidates": len(names)}
    return {"candidates": names, "belief": belief, "links": links, "mode": mode, "potential": potential}, row


def trace(steps: DataFrame) -> DataFrame:
    """steps(episode_id, step, tool, node_id, status, confidence, targets array<string>) to one row a step. Columns: ``TRACE``."""
    names = [x.split()[0] for x in TRACE.split(", ")]

    def run(batches):
        current, state = None, start()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in names}
            for r in batch.to_pylist():
                if r["episode_id"] != current:
                    current, state = r["episode_id"], start()
                state, row = step(state, r["tool"], r)
                row |= {"episode_id": current, "step": r["step"]}
                for n in names:
                    out[n].append(row[n])
            kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds[x.split()[1]]) for n, x in zip(names, TRACE.split(", "))], names)

    rows = steps.withColumn("trust", trust(steps.columns)).select(*STEP)
    return rows.repartition("episode_id").sortWithinPartitions("episode_id", "step").mapInArrow(run, TRACE)


def terminal_reward(stopped: Column, correct: Column, closed: Column, no_fault: Column, n_calls: Column, max_steps: int = 15) -> Column:
    """What the end of an episode adds: for the right answer, less if its evidence is open, which costs faults once more."""
    c = CONFIG
    answer = F.when(correct & closed, c["correct"]).when(correct, c["correct"] - c["open"]).otherwise(-c["wrong"])
    return F.when(stopped, answer).when(n_calls >= max_steps, -c["open"]).otherwise(0.0)


def _judged(episodes: DataFrame, calls: DataFrame, max_steps: int, t: DataFrame | None = None) -> DataFrame:
    """Episodes with what their trace and their end come to: n, shaped, raw, terminal, and what ``rewards`` reports."""
    c = CONFIG
    steps = calls.drop("step").withColumnRenamed("i", "step")
    t = trace(steps) if t is None else t
    per = t.groupBy("episode_id").agg(
        F.sum("shaping_reward").alias("shaped"), F.count("*").alias("n"), F.count_if(F.col("mode") == "closed").alias("closed_"), F.count_if(F.col("mode") == "conflict").alias("conflict_"),
        F.greatest(F.max("closure"), F.lit(0.0)).alias("most"), F.max_by(F.struct("closure", "potential", "conflict", "reliability", "mode", "top_candidate", "top_belief", "n_candidates"), "step").alias("last"),
    )
    calm = steps.where((norm(F.col("status")) == "normal") & (F.coalesce("node_id", F.lit("")) != "") & (trust(steps.columns) >= c["normal_reliability"]))
    calm = calm.groupBy("episode_id").agg(F.collect_set("node_id").alias("calm"))  # at most an episode's calls
    e = episodes.join(per, "episode_id", "left").join(calm, "episode_id", "left")
    stopped = F.col("diag_node").isNotNull() | F.col("diag_fault").isNotNull()
    free = is_no_fault_label(F.col("gt_fault"))
    right = F.when(free, is_no_fault_label(F.col("diag_fault")) & is_no_fault_node(F.col("diag_node"))).otherwise((norm(F.col("gt_node")) != "") & (norm(F.col("gt_node")) == norm(F.col("diag_node"))) & exact_match(F.col("gt_fault"), F.col("diag_fault")))
    refs = F.array_distinct(F.coalesce("ref_nodes", F.array().cast("array<string>")))
    covered = F.when(~free, 0.0).when(F.size(refs) == 0, 1.0).otherwise(F.size(F.array_intersect(refs, F.coalesce("calm", F.array().cast("array<string>")))) / F.size(refs))
    n = F.coalesce("n", F.lit(0))
    e = e.withColumns({"stopped": stopped, "free": free, "right": stopped & F.coalesce(right, F.lit(False)), "review": covered, "n": n, "violations": F.coalesce("conflict_", F.lit(0)) / F.greatest(n, F.lit(1)), "closed_rate": F.coalesce("closed_", F.lit(0)) / F.greatest(n, F.lit(1))})
    mode = F.coalesce("last.mode", F.lit("open"))
    review_closed = F.col("free") & (F.col("review") >= c["review"])
    open_end = F.col("stopped") & (mode != "closed") & ~F.col("free")
    end = terminal_reward(F.col("stopped"), F.col("right"), (mode == "closed") | review_closed, F.col("free"), F.col("n"), max_steps) - F.when(open_end, c["open"]).otherwise(0.0)
    return e.withColumns({"mode": mode, "review_closed": review_closed, "terminal": end, "raw": F.coalesce("shaped", F.lit(0.0)) + end})


def step_rewards(episodes: DataFrame, calls: DataFrame, max_steps: int = 15) -> DataFrame:
    """A row for each step: its shaping reward, the terminal reward where it is the last, their sum, what is still to come, and what the potential's fall comes to.

    telescoped is the start's potential less the episode's last one, fallen the sum of the steps' falls: equal but for rounding.
    """
    t = cut(trace(calls.drop("step").withColumnRenamed("i", "step")))
    e = _judged(episodes, calls, max_steps, t).select("episode_id", "terminal")
    whole = Window.partitionBy("episode_id")
    last = F.col("step") == F.max("step").over(whole)
    rows = t.join(e, "episode_id").withColumn("terminal_reward", F.when(last, F.col("terminal")).otherwise(0.0)).withColumn("reward", F.col("shaping_reward") + F.col("terminal_reward"))
    ahead = F.sum("reward").over(whole.orderBy(F.desc("step")))
    fallen = F.sum("potential_delta").over(whole)
    final = F.max(F.when(last, F.col("potential"))).over(whole)
    return rows.select("episode_id", "step", "mode", "shaping_reward", "terminal_reward", "reward", ahead.alias("return"), fallen.alias("fallen"), (F.lit(CONFIG["start"]) - final).alias("telescoped"))


def rewards(episodes: DataFrame, calls: DataFrame, max_steps: int = 15) -> DataFrame:
    """The trajectory reward of each episode from its trace. Episodes and calls are those of ``metrics``."""
    c = CONFIG
    e = _judged(episodes, calls, max_steps)
    mode, review_closed, raw = F.col("mode"), F.col("review_closed"), F.col("raw")
    scaled = clip(0.5 + 0.25 * raw)
    scaled = F.greatest(F.lit(0.0), scaled - 0.25 * F.col("violations"))
    scaled = F.when(F.col("stopped") & ~F.col("right"), F.greatest(F.lit(0.0), scaled - 0.20)).when(F.col("right"), F.least(F.lit(1.0), scaled + 0.10 * F.least(F.lit(1.0), F.greatest(F.coalesce("optimal", F.lit(3)), F.lit(1)) / F.greatest(F.col("n"), F.lit(1))))).otherwise(scaled)
    last = lambda name: F.coalesce(F.col(f"last.{name}"), F.lit(c["start"] if name == "potential" else 0.0))
    half = lambda x: clip((x + 1.0) / 2.0)
    out = {
        "epo": scaled, "epo_raw": raw, "epo_closure": half(last("closure")), "epo_max_closure": half(F.coalesce("most", F.lit(0.0))), "epo_violation_rate": F.col("violations"), "epo_closed_rate": F.col("closed_rate"),
        "epo_final_potential": last("potential"), "epo_conflict": last("conflict"), "epo_last_reliability": last("reliability"), "epo_belief_top": last("top_belief"), "epo_mode_closed": (mode == "closed").cast("double"),
        "epo_mode_violated": (mode == "conflict").cast("double"), "epo_candidate_count": F.coalesce("last.n_candidates", F.lit(0)).cast("double"),
        "epo_top_candidate_is_gt": F.coalesce((F.col("last.top_candidate") != "") & (norm(F.col("last.top_candidate")) == norm(F.col("gt_node"))), F.lit(False)).cast("double"),
        "epo_no_fault_review_coverage": F.col("review"), "epo_no_fault_closed": review_closed.cast("double"),
    }
    return e.select("episode_id", *(F.round(v, 4).alias(k) for k, v in out.items()))


def state_json(state: dict) -> str:
    return json.dumps(state | {"links": {k: sorted(v) for k, v in state["links"].items()}}, sort_keys=True)
