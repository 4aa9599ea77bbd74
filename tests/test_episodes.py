"""Folds, rewards, transcripts and trajectories against plain Python."""

import json
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ductwise.functions import labels as L
from ductwise.operators import matching, oracle, potential, rewards, scenarios, statistics, trajectories, transcripts
from ductwise.operators import windows as W
from ductwise.plans import registry, training, worlds

SF = "/root/testdata/sf0.001"


def by_episode(rows, order="i"):
    out = defaultdict(list)
    for r in rows:
        out[r["episode_id"]].append(r.asDict())
    return {k: sorted(v, key=lambda r: r[order]) for k, v in out.items()}


def plain_trace(calls):
    """The update written out for one episode, dictionaries only."""
    severity = {"fault": 1.0, "warning": 0.72, "abnormal": 0.55}
    names, belief, links, mode, before, rows = [], {}, defaultdict(set), "open", 0.25, []
    norm = lambda d: {k: v / sum(d.values()) for k, v in d.items()}
    for c in calls:
        node, tool, status, conf = c["node_id"], c["tool"], c["status"], c["confidence"]
        targets = c["targets"] or []
        for t in targets:
            if t != node:
                links[node].add(t)
                links[t].add(node)
        new = targets if tool in ("get_upstream_nodes", "get_node_children") else [node] if (tool == "diagnose_node" and (status in severity or not names)) or (tool == "get_node_sensors" and not names) else []
        names += [x for x in dict.fromkeys(new) if x not in names]
        gap = entropy = conflict = rho = 0.0
        if names:
            base = 0.0 if status in ("error", "unknown") else round(0.4 * (0.35 + 0.65 * min(1, max(0, 0.5 if conf is None else conf))), 4)
            rho = base * (1 if tool == "diagnose_node" else 0.35)

            def fit(x, node=node):
                if x == node:
                    return 1.0
                if node in links[x]:
                    return 0.55
                if any(node in links[y] for y in links[x]):
                    return 0.30
                return 0.18 if x.split("::")[0] == node.split("::")[0] else 0.0

            if tool not in ("diagnose_node", "get_node_sensors"):
                e = {x: 1.0 for x in names}
            elif status in severity:
                e = {x: 1e-3 + max(0.05, min(1, conf or 0)) * severity[status] * fit(x) for x in names}
            elif status in ("normal", "success"):
                e = {x: 1e-3 + (1e-3 if x == node else 0.15 * (1 - 0.5 * fit(x))) for x in names}
            else:
                e = {x: 1e-3 + (0.05 if x == node else 0) for x in names}
            e, belief = norm(e), norm({x: belief.get(x, 1e-3) for x in names})
            m = {x: (e[x] + belief[x]) / 2 for x in names}
            js = sum(e[x] * math.log(e[x] / m[x]) + belief[x] * math.log(belief[x] / m[x]) for x in names) / 2
            conflict = rho * min(1, max(0, js))
            belief = norm({x: belief[x] ** (1 - rho) * e[x] ** rho for x in names})
            top = sorted(belief.values())[::-1]
            gap = top[0] - top[1] if len(top) > 1 else 1.0
            entropy = -sum(p * math.log(p) for p in top) / math.log(len(top)) if len(top) > 1 else 0.0
        closure = gap - 0.45 * conflict - 0.20 * entropy
        if rho >= 0.55 and conflict >= 0.35:
            mode = "conflict"
        elif mode != "conflict" and closure >= 0.25:
            mode = "closed"
        elif (mode == "closed" and closure < 0.10) or (mode == "conflict" and conflict <= 0.15):
            mode = "open"
        now = max(0, 0.25 - closure) + (0.65 if mode == "conflict" else 0)
        rows.append({"closure": closure, "potential": now, "mode": mode, "shaping": 0.75 * (before - now) - 0.025, "n": len(names), "rho": rho, "top": max(belief, key=belief.get) if belief else ""})
        before = now
    return rows


@pytest.fixture(scope="module")
def world(spark):
    return training.world(spark, SF)


def test_trace_equals_a_plain_fold(spark, world):
    calls = world[1]
    got = by_episode(registry.QUERIES["epo_trace"](spark, SF).collect(), "step")
    want = by_episode(calls.collect())
    assert got.keys() == want.keys()
    for k, rows in want.items():
        for a, b in zip(got[k], plain_trace(rows), strict=True):
            assert a["mode"] == b["mode"] and a["n_candidates"] == b["n"]
            assert all(abs(a[x] - b[y]) < 1e-9 for x, y in (("closure", "closure"), ("potential", "potential"), ("shaping_reward", "shaping"), ("reliability", "rho")))


def test_trajectory_reward_from_the_fold(spark, world):
    eps, calls = world
    got = {r.episode_id: r for r in potential.rewards(eps, calls).collect()}
    runs, truth = by_episode(calls.collect()), {r.episode_id: r for r in eps.collect()}
    assert got.keys() == truth.keys()
    for k, e in truth.items():
        t, n = plain_trace(runs[k]), len(runs[k])
        free, said = e.gt_fault == "normal", e.diag_node is not None
        right = said and (e.diag_fault == "no_fault" if free else e.gt_node == e.diag_node and e.gt_fault == e.diag_fault)
        calm = {c["node_id"] for c in runs[k] if c["status"] == "normal" and round(0.4 * (0.35 + 0.65 * min(1, c["confidence"])), 4) >= 0.2}
        review = len(set(e.ref_nodes) & calm) / len(set(e.ref_nodes)) if free else 0.0
        closed, total = t[-1]["mode"] == "closed", sum(r["shaping"] for r in t)
        if said:
            total += (1.0 if closed or (free and review >= 1) else 0.65) if right else -1.0
            total -= 0.35 if not closed and not free else 0.0
        bad = sum(r["mode"] == "conflict" for r in t) / n
        score = max(0, min(1, 0.5 + 0.25 * total) - 0 if total > -2 else 0)
        score = max(0.0, score - 0.25 * bad)
        if said and not right:
            score = max(0.0, score - 0.2)
        if right:
            score = min(1.0, score + 0.1 * min(1, 4 / n))
        assert abs(got[k].epo - score) < 1e-3 and abs(got[k].epo_raw - total) < 1e-3 and got[k].epo_candidate_count == t[-1]["n"]
        assert got[k].epo_no_fault_review_coverage == round(review, 4) and got[k].epo_closed_rate == pytest.approx(sum(r["mode"] == "closed" for r in t) / n, abs=1e-4)


def test_missing_confidence_is_weak_but_counts(spark):
    rows = [("e", 0, "get_node_children", "a::x", "success", None, ["a::n1", "a::n2"]), ("e", 1, "diagnose_node", "a::n1", "fault", None, None), ("e", 2, "diagnose_node", "a::n2", "fault", 0.0, None)]
    out = potential.trace(spark.createDataFrame(rows, "episode_id string, step int, tool string, node_id string, status string, confidence double, targets array<string>")).collect()
    want = plain_trace([dict(zip(("episode_id", "i", "tool", "node_id", "status", "confidence", "targets"), r)) for r in rows])
    assert [r.potential for r in sorted(out, key=lambda r: r.step)] == pytest.approx([r["potential"] for r in want])


def test_trust_knows_models(spark):
    rows = [("e", 0, "diagnose_node", "a::n1", "fault", 1.0, None, "system_oracle", None, 1.0), ("e", 1, "diagnose_node", "a::n1", "fault", 1.0, None, "per_node", "weak_fallback_model", 0.375)]
    out = potential.trace(spark.createDataFrame(rows, "episode_id string, step int, tool string, node_id string, status string, confidence double, targets array<string>, model_source string, calibration string, feature_coverage double")).collect()
    assert [r.reliability for r in sorted(out, key=lambda r: r.step)] == pytest.approx([0.9, 0.125])


def test_visible_state_equals_a_plain_fold(spark, world):
    got = defaultdict(dict)
    for r in registry.QUERIES["visible_state_fold"](spark, SF).collect():
        got[r.conv_id][r.turn] = r
    for k, rows in by_episode(world[1].collect()).items():
        nodes, edges, cands, front, done = [], [], [], [], []
        put = lambda to, x: to.append(x) if x not in to else None
        for c in rows:
            if c["status"] != "error":
                for x in [c["node_id"], *(c["targets"] or [])]:
                    put(nodes, x)
                if c["tool"] in ("get_node_children", "get_upstream_nodes"):
                    for t in c["targets"] or []:
                        put(edges, f"{t}>{c['node_id']}" if c["tool"] == "get_upstream_nodes" else f"{c['node_id']}>{t}")
                        put(front, t)
                elif c["tool"] in ("diagnose_node", "get_node_sensors"):
                    put(done, c["node_id"])
                    if c["tool"] == "diagnose_node":
                        front = [x for x in front if x != c["node_id"]]
                        if c["status"] in ("fault", "warning", "abnormal", "alert"):
                            put(cands, f"{c['node_id']}:{c['fault_type']}")
            r = got[k][c["i"]]
            assert (r.nodes, r.edges, r.candidates, r.frontier, r.checked) == (nodes[-8:], edges[-8:], cands[-4:], front[-4:], done[-8:]) and (r.n_nodes, r.n_edges) == (len(nodes), len(edges))


def test_process_reward_cases(spark):
    eps = spark.createDataFrame([("none", 3, None, None), ("late", 3, "a::n", "f"), ("ok", 3, "a::n", "f")], "episode_id string, optimal int, diag_node string, diag_fault string")
    call = lambda e, i, status, node="a::n": (e, i, "diagnose_node", node, status, None)
    calls = [call("late", 0, "warning")] + [call("late", i, "normal", f"a::n{i}") for i in range(1, 10)] + [call("ok", 0, "normal"), call("ok", 1, "fault")]
    got = {r.episode_id: r.process for r in rewards.process_reward(eps, spark.createDataFrame(calls, "episode_id string, i int, tool string, node_id string, status string, targets array<string>")).collect()}
    assert got["none"] == 0.0 and got["ok"] == 1.0
    raw = 1 - min(0.5, 0.08 * 7) - min(0.7, 0.25 * 9) - min(0.4, 0.08 * 6)
    assert got["late"] == pytest.approx(raw if raw < 0 else 0.0)


def plain_action_first(text, most=360):
    text = re.sub(r"(?s)<topoitl_(state|action)>.*?</topoitl_\1>\s*", "", text or "").strip()
    m = re.search(r"(?s)<tool_call>\s*\{.*?\}\s*</tool_call>|<diagnosis>\s*\{.*?\}\s*</diagnosis>", text)
    if not m:
        return text
    before, after = text[: m.start()], text[m.end() :]
    think = re.search(r"(?s)<think>(.*?)</think>", before)
    if not think:
        return text
    idea = re.sub(r"\s+", " ", think[1]).strip()
    if len(idea) > most:
        kept = ""
        for s in re.split(r"(?<=[.!?])\s+", idea):
            if kept and len(kept) + 1 + len(s) > most:
                break
            kept = f"{kept} {s}" if kept else s
        idea = kept
    prose = before.replace(think[0], "").strip()
    return "\n".join(x for x in (f"<think>{idea}</think>", m[0], prose, after.strip()) if x)


def test_actions_come_first(spark):
    long = "One sentence here. " * 40
    texts = [
        "<think>a  b\n c</think>\n\nSome prose.\n<diagnosis>{\"x\": 1}</diagnosis> tail", f"<think>{long}</think><tool_call>{{\"name\": \"t\"}}</tool_call><topoitl_state>{{}}</topoitl_state>", "<think>no action</think>", "<tool_call>{\"n\": 1}</tool_call>", "", None,
        "<topoitl_action>{\"a\": {}}</topoitl_action> <think>x.</think> p <tool_call>{\"n\": {\"m\": 1}}</tool_call> q <tool_call>{}</tool_call>",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: r.x for r in frame.select("i", transcripts.action_first(F.col("text")).alias("x")).collect()}
    assert got == {i: plain_action_first(t) for i, t in enumerate(texts)}


def test_gates_stop_a_load(spark):
    good = spark.createDataFrame([(0,) * len(transcripts.FATAL)], ", ".join(f"{c} int" for c in transcripts.FATAL))
    transcripts.check_load(good)
    with pytest.raises(ValueError, match="missing_system"):
        transcripts.check_load(good.withColumn("missing_system", F.lit(2)))


def test_columns_are_resolved(spark):
    columns = ["OA_TEMP", "DMPR", "SupplyAirTempC", "x", "Fan Speed", "ReturnTemp", "Return_Temp2"]
    wanted = ["sys::OA_TEMP", "oa temp", "Damper_Command", "SupplyAirTemp", "temp", "fan_speed", "OA_TEMP", "b::ReturnTemperature", "ReturnTemp", "ReturnTemp2"]
    cols = [("f", i, c) for i, c in enumerate(columns)] + [("g", 0, "x"), ("h", 0, "oa-temp")]
    asks = [("f", i, w) for i, w in enumerate(wanted)] + [("g", 0, "OA_TEMP"), ("h", 0, "a::OA_TEMP"), ("i", 0, "x")]
    got = oracle.resolve_columns(
        spark.createDataFrame(cols, "file string, at int, column string"), spark.createDataFrame(asks, "file string, k int, name string"), spark.createDataFrame([("Damper_Command", "dmpr")], "name string, alias string"),
    )
    rows = sorted((r.file, r.k, r.column) for r in got.collect())
    # the seventh name takes ReturnTemp as what it holds, so the eighth falls to the column that holds it
    assert rows == [("f", 0, "OA_TEMP"), ("f", 2, "DMPR"), ("f", 3, "SupplyAirTempC"), ("f", 5, "Fan Speed"), ("f", 7, "ReturnTemp"), ("f", 8, "Return_Temp2"), ("h", 0, "oa-temp")]


def test_trajectories(spark):
    s = worlds.flow_scenarios(spark, SF).cache()
    graph, systems = worlds.flow_graph(spark), list(worlds.SYSTEMS)
    outcome = trajectories.results(trajectories.plan(s, *graph, systems), s, *graph).cache()
    ways = {(r.symptom, r.root): r.trace for r in trajectories.traces(graph[1], s.selectExpr("path[0] AS symptom", "root_cause_node AS root")).collect()}
    truth = {r.scenario_id: r for r in s.collect()}
    runs = defaultdict(list)
    for r in outcome.collect():
        runs[r.scenario_id].append(r)
    assert runs.keys() == truth.keys()
    for k, rows in runs.items():
        rows.sort(key=lambda r: r.i)
        t = truth[k]
        assert [r.i for r in rows] == list(range(len(rows))) and rows[0].tool == "get_system_overview" and rows[0].status == "success"
        asked = [r.node_id for r in rows if r.tool == "diagnose_node"]
        if t.scenario_type == "no_fault":
            assert 2 <= len(asked) <= 3 and len(set(asked)) == len(asked) and all(r.status == "Normal" for r in rows if r.tool == "diagnose_node")
        else:
            assert asked[-1] == t.root_cause_node
            for r in rows:
                if r.tool == "diagnose_node":
                    low = "low_confidence" in t.scenario_type
                    way = [] if low else ways.get((t.path[0], t.root_cause_node), [])
                    want = ("Warning" if low else "Fault") if r.node_id == t.root_cause_node else "Abnormal" if r.node_id in t.path or r.node_id in way else "Normal"
                    assert r.status == want
        if t.symptom_system != t.root_cause_system and "cross" in t.scenario_type:
            assert [r.tool for r in rows].index("get_related_systems") < [r.node_id for r in rows].index(t.root_cause_node)
        if "low_confidence" in t.scenario_type:
            assert rows[-1].tool == "get_node_sensors" and rows[-1].node_id == t.root_cause_node
        way = ways.get((t.path[0], t.root_cause_node)) if t.scenario_type in ("single_system", "a_single_system", "cross_system", "na_cross_system") else None
        if way:
            assert [r.node_id for r in rows if r.tool == "get_upstream_nodes"] == way[:-1] and [n for n in asked if n in way] == way
        shown = set()
        for r in rows:  # whatever is asked about was listed before
            assert r.node_id is None or r.node_id.startswith("system::") or r.node_id in shown
            shown |= set(r.targets or [])
        assert all(r.error is None and r.status != "error" for r in rows)
        passing = {f"system::{n.split('::')[0]}" for n in way or []}
        wrong = {r.node_id for r in rows if r.tool == "get_node_children"} - passing - {f"system::{t.symptom_system}", f"system::{t.root_cause_system}"}
        assert len(wrong) <= (2 if t.scenario_type == "a_single_system" else 0)
    turns, passed, _ = trajectories.generate(s, *graph, systems)
    flags = {r.scenario_id: r for r in passed.collect()}
    assert flags.keys() == truth.keys() and all(r.admitted == (r.label_consistent and r.tool_faithful) for r in flags.values()) and sum(r.admitted for r in flags.values()) > 0.9 * len(flags)
    talks = defaultdict(list)
    for r in turns.collect():
        talks[r.scenario_id].append(r)
    assert set(talks) == {k for k, r in flags.items() if r.admitted}
    for k, rows in talks.items():
        rows.sort(key=lambda r: r.turn)
        assert [r.turn for r in rows] == list(range(len(rows))) and [r.role for r in rows] == ["human"] + ["gpt", "observation"] * (len(rows) // 2 - 1) + ["gpt"]
        said = json.loads(re.search(r"(?s)<diagnosis>(.*)</diagnosis>", rows[-1].text)[1])
        assert said["root_cause_node"] == ("none" if truth[k].scenario_type == "no_fault" else truth[k].root_cause_node)
        assert all(json.loads(r.text)["nodes"] for r in rows if r.role == "observation" and '"nodes"' in r.text and "n5" not in r.text)
        assert all(json.loads(re.search(r"(?s)<tool_call>(.*)</tool_call>", r.text)[1])["name"] for r in rows[1:-1] if r.role == "gpt")


def test_a_batch_with_many_failures_stops(spark):
    s = spark.range(200).select(F.concat(F.lit("s"), "id").alias("scenario_id"))
    final = s.where("scenario_id <> 's0'")
    flags = lambda bad: final.select("scenario_id", (F.substring("scenario_id", 2, 9).cast("int") > bad).alias("label_consistent"), (F.col("scenario_id") != "s199").alias("tool_faithful"))
    failed = trajectories.failures(s, final, flags(40))
    assert trajectories.check_budget(s, failed) == {"no_diagnosis": 1, "label": 40, "evidence": 1}
    with pytest.raises(ValueError, match="'label': 80"):
        trajectories.check_budget(s, trajectories.failures(s, final, flags(80)))
    assert trajectories.check_budget(s, trajectories.failures(s, final, flags(68))) == {"no_diagnosis": 1, "label": 68, "evidence": 1}  # 70 of 200 are allowed


def test_traces_take_the_shortest_way(spark):
    edges = spark.createDataFrame([("a", "b", "feeds"), ("b", "c", "feeds"), ("a", "x", "cross_system"), ("x", "c", "feeds"), ("c", "a", "feeds"), ("q", "c", "has_part"), ("r", "a", "feeds"), ("a", "b", "feeds")], "src string, dst string, relation string")
    pairs = spark.createDataFrame([("c", "a"), ("c", "r"), ("c", "q"), ("c", "c"), ("b", "x"), (None, "a"), ("c", "a")], "symptom string, root string")
    got = {(r.symptom, r.root): r.trace for r in trajectories.traces(edges, pairs).collect()}
    assert got == {("c", "a"): ["c", "b", "a"], ("c", "r"): ["c", "b", "a", "r"], ("c", "c"): ["c"], ("b", "x"): ["b", "a", "c", "x"]}
    assert {(r.symptom, r.root) for r in trajectories.traces(edges, pairs, hops=2).collect()} == {("c", "a"), ("c", "c")}


def test_gates_reject_what_tools_contradict(spark):
    truth = spark.createDataFrame([(i, "single_system", "a::n1", "fan_stuck") for i in "abcde"] + [("f", "no_fault", "none", "normal")], "scenario_id string, scenario_type string, root_cause_node string, fault_type string")
    final = spark.createDataFrame([("a", "a::n1", "fan_stuck", 0.9, "Fault"), ("b", "a::n1", "fan_stuck", 0.5, "Fault"), ("c", "a::n2", "fan_stuck", 0.9, "Fault"), ("d", "a::n1", "fan_stuck", 0.9, "Fault"), ("f", "none", "no_fault", 0.9, "Normal")], "scenario_id string, node string, fault string, confidence double, status string")
    seen = spark.createDataFrame([("a", "diagnose_node", "a::n1", "Fault", "fan_stuck"), ("b", "diagnose_node", "a::n1", "Fault", "fan_stuck"), ("d", "diagnose_node", "a::n1", "Fault", "pump"), ("f", "diagnose_node", "a::n9", "Fault", "pump")], "scenario_id string, tool string, node_id string, status string, fault_type string")
    got = {r.scenario_id: (r.label_consistent, r.tool_faithful, r.confidence_supported, r.admitted) for r in trajectories.gates(final, truth, seen).collect()}
    assert got == {"a": (True, True, True, True), "b": (False, True, False, False), "c": (False, True, True, False), "d": (True, False, True, False), "e": (False, False, False, False), "f": (True, False, True, False)}


def test_substring_pairs_find_all(spark):
    needles = ["web", "a", "new line", "one two three four five", "two three four", "x.y", "", "日本", "end of text"]
    texts = [(1, "the web is new lines"), (2, "one two three four five six"), (3, "fifty-one two three four fives"), (4, "日本語 x.y"), (5, "xay"), (6, ""), (7, "the end of textures"), (7, "web web"), (8, None)]
    got = matching.substring_pairs(spark.createDataFrame([(n,) for n in needles], "n string"), "n", spark.createDataFrame(texts, "k int, t string"), "t", "k")
    assert sorted((r.k, r.t, r.n) for r in got.collect()) == sorted((k, t, n) for k, t in texts if t for n in needles if n and n in t)


@pytest.mark.parametrize("discount", [0.0, 0.3, 0.9, 0.99, 1.0])
def test_returns_of_long_episodes(spark, discount):
    n = 3000
    rows = spark.range(n).select(F.lit("u").alias("u"), "id", (F.col("id") % 7 - 3).cast("double").alias("r"))
    got = [r.ret for r in W.returns_to_go(rows, ["u"], ["id"], "r", discount).orderBy("step").collect()]
    want, acc = [], 0.0
    for i in reversed(range(n)):
        acc = (i % 7 - 3) + discount * acc
        want.append(acc)
    assert got == pytest.approx(want[::-1], abs=1e-9)


def test_first_by_hash_takes_exactly_the_limit(spark):
    import hashlib

    rows = [(i, "hot" if i % 3 else f"k{i % 9}") for i in range(5000)] + [(9000, None)]
    frame = spark.createDataFrame(rows, "id long, kind string")
    limits = spark.createDataFrame([("hot", 777), ("k0", 5), ("k3", 10**6), (None, 1)], "kind string, limit long")
    got = {r.id for r in statistics.first_by_hash(frame, "kind", F.col("id"), limits).where("taken").collect()}
    want, most = set(), {"hot": 777, "k0": 5, "k3": 10**6, "k6": 0, None: 1}
    for kind, m in most.items():
        want |= set(sorted((i for i, k in rows if k == kind), key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())[:m])
    assert got == want


def test_paths_and_types(spark):
    row = spark.range(1).select(F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("p"))
    assert row.select(*(scenarios.node_role(F.col("p"), F.lit(x)).alias(x) for x in "abcz")).first().asDict() == {"a": "symptom", "b": "intermediate", "c": "root_cause", "z": None}
    assert L.expand_types([" Cross_System", ""]) == {"cross_system", "na_cross_system"}


def test_closing_examples_pass_the_loader(spark):
    s, graph = worlds.flow_scenarios(spark, SF).where("substring(scenario_id, 2, 9) % 5 = 0").cache(), worlds.flow_graph(spark)
    turns, _, outcome = trajectories.generate(s, *graph, list(worlds.SYSTEMS))
    turns = turns.withColumnRenamed("scenario_id", "conv_id").cache()
    said = transcripts.final_diagnosis(turns).join(s.selectExpr("scenario_id AS conv_id", "scenario_type"), "conv_id").selectExpr("conv_id", "scenario_type", "root_cause_node AS node", "fault_type AS fault")
    kept = transcripts.closing_events(outcome.selectExpr("scenario_id AS conv_id", "i", "tool", "node_id", "status", "confidence", "true AS has_readings"), said).cache()
    out = transcripts.closing_examples(turns, kept)
    talks = defaultdict(list)
    for r in out.collect():
        talks[r.conv_id].append(r)
    assert len(talks) == s.count()
    types = {r.scenario_id: r for r in s.collect()}
    for k, rows in talks.items():
        rows.sort(key=lambda r: r.turn)
        t = types[k.split("__")[0]]
        assert [r.role for r in rows] == ["human"] + ["gpt", "observation"] * (len(rows) // 2 - 1) + ["gpt"] and "<diagnosis>" in rows[-1].text and "get_system_overview" in rows[1].text
        asked = [json.loads(re.search(r"(?s)<tool_call>(.*?)</tool_call>", r.text)[1]) for r in rows[1:-1:2]]
        last = [a for a in asked if a["name"] == "diagnose_node"][-1]["arguments"]["node_id"]
        assert ("low_confidence" in t.scenario_type and asked[-1]["name"] == "get_node_sensors") or "no_fault" in t.scenario_type or last == t.root_cause_node
        assert len(asked) <= 8 + 2 + 3
    records = out.select("conv_id").distinct().selectExpr("conv_id", "'s' AS system", "'v' AS design_version", "'h' AS prompt_sha256", "'terminal_closure' AS augmentation")
    gates = transcripts.loader_gates(records, out, "v", "h")
    transcripts.check_load(gates)
    assert gates.first().bad_first_tool == 0


def test_token_weights_equal_a_plain_computation(spark):
    rng = random.Random(9)
    blocks = {"state": "<topoitl_state>{\"k\": 1}</topoitl_state>", "label": "<topoitl_action>{}</topoitl_action>", "exec": "<tool_call>{\"a\": 1}</tool_call>", "end": "<diagnosis>{}</diagnosis>", "prose": "some words "}
    turns = [(c, t, ("human", "gpt")[t % 2], "".join(blocks[rng.choice(list(blocks))] for _ in range(rng.randint(0, 6))) if rng.random() < 0.95 else None) for c in range(40) for t in range(5)]
    tokens = [(c, t, a, min(a + 7, len(x or ""))) for c, t, _, x in turns for a in range(0, max(len(x or ""), 1), 7)]
    got = {(r.conv_id, r.turn, r.start): (r.trained, r.weight) for r in transcripts.token_weights(spark.createDataFrame(tokens, "conv_id int, turn int, start int, end int"), spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"), {"base": 0.5}).collect()}
    text = {(c, t): (r, x or "") for c, t, r, x in turns}
    first = {}
    for c, t, r, x in turns:
        for m in re.finditer(r"(?s)<topoitl_state>.*?</topoitl_state>", x or ""):
            if r == "gpt":
                first.setdefault(c, (t, m.start()))
    for c, t, a, b in tokens:
        role, x = text[c, t]
        mid = (a + b) / 2 if b > a else a
        hit = lambda p: [m.start() for m in re.finditer(p, x) if m.start() <= mid < m.end()]  # noqa: E731,B023
        state, act = hit(r"(?s)<topoitl_state>.*?</topoitl_state>"), hit(r"(?s)<topoitl_action>.*?</topoitl_action>|<tool_call>.*?</tool_call>|<diagnosis>.*?</diagnosis>")
        want = 0.0 if role != "gpt" else (1.0 if first[c] == (t, state[0]) else 1.5) if state else 1.0 if act else 0.5
        assert got[c, t, a] == (role == "gpt", want)
