"""Registered queries on episodes: rewards, metrics, transcripts and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets, metrics, potential, rewards, trajectories, transcripts
from ..operators.lineage import by_key
from .catalog import TOOLS, episodes
from .registry import query, rounded, table

# --- episodes in SQL -------------------------------------------------------------------------------------------------
BASE = f"""b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events),
calls AS (SELECT user_id || '-' || (rn // 8) AS episode_id, (rn % 8)::INT AS i, CASE WHEN rn % 8 = 0 THEN 'get_system_overview' ELSE {list(TOOLS)}[1 + event_id % 5] END AS tool,
 'sys' || (event_id % 3) || '::n' || (event_id % 6) AS node_id, 'sys' || (event_id % 3) AS system_id, event_id % 11 <> 0 AS valid,
 CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 5 <> 2 THEN 'success' WHEN event_type = 'error' THEN 'fault' WHEN event_type = 'signup' THEN 'warning' WHEN event_type = 'purchase' THEN 'abnormal' ELSE 'normal' END AS status,
 event_type AS fault_type, floor(value / 50) / 10 AS confidence, event_id AS step,
 CASE WHEN event_id % 5 = 1 THEN ['sys' || (event_id % 3) || '::n0', 'sys' || (event_id % 3) || '::n1', 'sys' || (event_id % 3) || '::n3'] END AS targets FROM b),
last AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY i DESC) AS l, first_value(node_id) OVER (PARTITION BY episode_id ORDER BY confidence DESC, i DESC) AS t_node, first_value(fault_type) OVER (PARTITION BY episode_id ORDER BY confidence DESC, i DESC) AS t_fault FROM calls),
eps AS (SELECT episode_id, step, step % 4 = 0 AS clean, step % 9 <> 0 AS said, CASE WHEN step % 4 = 0 THEN 'no_fault' WHEN step % 4 = 1 THEN 'cross_system' ELSE 'single_system' END AS scenario_type, split_part(t_node, '::', 1) AS gt_system, t_node,
 CASE WHEN step % 4 = 0 THEN 'none' ELSE t_node END AS gt_node, CASE WHEN step % 4 = 0 THEN 'normal' ELSE t_fault END AS gt_fault, CASE WHEN step % 9 <> 0 THEN CASE WHEN step % 4 = 0 THEN 'none' ELSE node_id END END AS diag_node,
 CASE WHEN step % 9 <> 0 THEN CASE WHEN step % 4 = 0 THEN 'no_fault' ELSE fault_type END END AS diag_fault, CASE WHEN step % 9 <> 0 THEN system_id END AS diag_system, CASE WHEN step % 9 <> 0 THEN confidence END AS diag_confidence, step % 9 <> 0 AND step % 4 = 0 AS free FROM last WHERE l = 1),
n AS (SELECT episode_id, count(*) AS n FROM calls GROUP BY 1)"""


def world(spark, sf_dir):
    """(episodes with a diagnosed status, affected systems and reference relations, calls with their step)."""
    eps, calls = episodes(spark, sf_dir, with_step=True)
    last = calls.groupBy("episode_id").agg(F.max_by("step", "i").alias("step"))
    cross = F.col("scenario_type") == "cross_system"
    nodes = [F.concat("gt_system", F.lit(x)) for x in ("::n0", "::n1", "::n5")]
    eps = eps.join(last, "episode_id").withColumns({
        "diag_status": F.when(F.col("step") % 5 == 0, F.lit("fault")), "gt_affected": F.when(cross, F.array("gt_system", F.lit("elsewhere"))).otherwise(F.array("gt_system")),
        "ref_edges": F.when(F.col("scenario_type") != "no_fault", F.array(*(F.struct(F.col("gt_node").alias("src"), x.alias("dst")) for x in nodes))),
    })
    return eps, calls


ACC = """acc AS (SELECT episode_id, CASE WHEN NOT said THEN 0.0 WHEN clean THEN CASE WHEN free THEN 1.0 ELSE -0.3 END WHEN free THEN -0.6 WHEN gt_node = diag_node AND gt_fault = diag_fault THEN 1.0 WHEN gt_node = diag_node THEN 0.45
 WHEN gt_system = diag_system AND gt_fault = diag_fault THEN 0.25 WHEN gt_system = diag_system THEN 0.10 ELSE 0.0 END::DOUBLE AS accuracy,
 greatest(0, 1 - greatest(n - 4, 0) / 15.0)::DOUBLE AS efficiency, CASE WHEN said THEN (3 + CASE WHEN step % 5 = 0 THEN 0.5 ELSE 0 END) / 4 ELSE 0 END::DOUBLE AS completeness FROM eps JOIN n USING (episode_id))"""
TOPO = """topo AS (SELECT e.episode_id, coalesce(avg((d.node_id IS NOT NULL)::INT) FILTER (c.tool = 'diagnose_node'), 0)::DOUBLE AS topology FROM eps e LEFT JOIN calls c USING (episode_id) LEFT JOIN (SELECT DISTINCT episode_id, unnest(targets) AS node_id FROM calls) d ON d.episode_id = c.episode_id AND d.node_id = c.node_id GROUP BY 1)"""
BAD = "status IN ('fault', 'warning', 'abnormal')"
CONS = f"""cons AS (SELECT episode_id, CASE WHEN NOT said THEN 0 WHEN free THEN CASE WHEN bad > 0 THEN -1 ELSE 0.7 END WHEN own > 0 THEN CASE WHEN backs > 0 THEN CASE WHEN weak THEN 0.25 ELSE 1 END WHEN own_bad > 0 THEN 0.5 WHEN own_normal > 0 THEN -0.4 WHEN bad > 0 THEN 0.4 ELSE -0.3 END WHEN bad > 0 THEN -0.5 ELSE -0.3 END::DOUBLE AS consistency FROM (
 SELECT e.episode_id, said, free, count(*) FILTER ({BAD}) AS bad, count(*) FILTER (c.node_id = diag_node) AS own, count(*) FILTER (c.node_id = diag_node AND {BAD}) AS own_bad, count(*) FILTER (c.node_id = diag_node AND status = 'normal') AS own_normal,
 count(*) FILTER (c.node_id = diag_node AND {BAD} AND c.fault_type = diag_fault) AS backs, arg_min(c.step % 7 = 0, c.i) FILTER (c.node_id = diag_node AND {BAD} AND c.fault_type = diag_fault) AS weak FROM eps e JOIN calls c USING (episode_id) GROUP BY ALL))"""
SENS = """r AS (SELECT c.*, c.tool = 'get_node_sensors' AND c.step % 3 <> 1 AS good, tool = 'diagnose_node' AND status = 'warning' AS doubt FROM calls c),
o AS (SELECT r.*, EXISTS (SELECT 1 FROM r d WHERE d.episode_id = r.episode_id AND d.node_id = r.node_id AND d.doubt AND d.i < r.i AND NOT EXISTS (SELECT 1 FROM r g WHERE g.episode_id = r.episode_id AND g.node_id = r.node_id AND g.good AND g.i > d.i AND g.i < r.i)) AS open,
 EXISTS (SELECT 1 FROM r d WHERE d.episode_id = r.episode_id AND d.doubt AND d.i < r.i) AS saw, EXISTS (SELECT 1 FROM r d WHERE d.episode_id = r.episode_id AND d.node_id = r.node_id AND d.tool = 'diagnose_node' AND d.status = 'fault' AND d.confidence >= 0.7 AND d.i < r.i) AS sure FROM r WHERE tool = 'get_node_sensors'),
v AS (SELECT episode_id, count(*) AS sensor_calls, count(*) FILTER (good) AS useful_sensor_calls, count(DISTINCT node_id) FILTER (good AND open) AS verified_nodes, count(*) FILTER (NOT open AND NOT saw) AS blind_calls, count(*) FILTER (NOT open AND saw) AS stale_calls, count(*) FILTER (NOT open AND sure) AS post_fault_calls FROM o GROUP BY 1),
q AS (SELECT episode_id, count(DISTINCT node_id) AS pending_nodes FROM r d WHERE doubt AND NOT EXISTS (SELECT 1 FROM r g WHERE g.episode_id = d.episode_id AND g.node_id = d.node_id AND g.good AND g.i > d.i) GROUP BY 1),
summ AS (SELECT n.episode_id, coalesce(sensor_calls, 0) AS sensor_calls, coalesce(useful_sensor_calls, 0) AS useful_sensor_calls, coalesce(verified_nodes, 0) AS verified_nodes, coalesce(pending_nodes, 0) AS pending_nodes, coalesce(blind_calls, 0) AS blind_calls, coalesce(stale_calls, 0) AS stale_calls, coalesce(post_fault_calls, 0) AS post_fault_calls,
 coalesce(verified_nodes, 0) + coalesce(pending_nodes, 0) AS uncertain_nodes FROM n LEFT JOIN v USING (episode_id) LEFT JOIN q USING (episode_id)),
sens AS (SELECT episode_id, CASE WHEN uncertain_nodes = 0 THEN CASE WHEN blind_calls + post_fault_calls > 0 THEN greatest(-0.5, -0.25 - 0.1 * (blind_calls + post_fault_calls - 1)) ELSE 0 END WHEN pending_nodes = 0 THEN greatest(0.75, 1 - least(0.25, 0.08 * stale_calls))
 WHEN verified_nodes > 0 THEN greatest(-0.2, 0.5 * verified_nodes / uncertain_nodes - least(0.25, 0.08 * stale_calls)) ELSE -1 END::DOUBLE AS sensor_verification FROM summ)"""
PROC = f"""shown AS (SELECT episode_id, i, unnest(list_append(coalesce(targets, []), node_id)) AS node FROM calls),
ghost AS (SELECT c.episode_id, count(*) AS ghosts FROM calls c WHERE tool = 'diagnose_node' AND EXISTS (SELECT 1 FROM shown s WHERE s.episode_id = c.episode_id AND s.i < c.i) AND NOT EXISTS (SELECT 1 FROM shown s WHERE s.episode_id = c.episode_id AND s.i < c.i AND s.node = c.node_id) GROUP BY 1),
rep AS (SELECT episode_id, sum(greatest(k - 2, 0)) AS repeats FROM (SELECT episode_id, tool, node_id, count(*) AS k FROM calls GROUP BY ALL) GROUP BY 1),
raw AS (SELECT episode_id, 1 - CASE WHEN said THEN 0 WHEN n >= 15 THEN 1.2 ELSE 0.6 END - least(0.5, 0.08 * greatest(n - 4, 0)) - least(0.5, 0.12 * repeats) - least(0.8, 0.3 * errors) - least(0.7, 0.25 * coalesce(ghosts, 0)) - least(0.4, 0.08 * greatest(coalesce(m - hit, 0) - 3, 0)) AS x
 FROM eps JOIN n USING (episode_id) JOIN rep USING (episode_id) LEFT JOIN ghost USING (episode_id) JOIN (SELECT episode_id, count(*) FILTER (status = 'error') AS errors, min(i) FILTER ({BAD}) AS hit, max(i) AS m FROM calls GROUP BY 1) USING (episode_id)),
proc AS (SELECT episode_id, CASE WHEN x >= 0.8 THEN 1 WHEN x >= 0.4 THEN 0.5 WHEN x >= 0 THEN 0 ELSE greatest(-1, x) END::DOUBLE AS process FROM raw)"""
CROSS = """tr AS (SELECT e.episode_id, e.scenario_type = 'cross_system' OR (gt_system = 'sys0' AND starts_with(gt_node, 'sys0::')) AS crosses, said, free, gt_system, diag_system, CASE WHEN contains(coalesce(diag_node, ''), '::') THEN split_part(diag_node, '::', 1) ELSE '' END AS of_node,
 bool_or(tool IN ('get_related_systems', 'get_upstream_nodes')) AS traced, bool_or(tool = 'get_upstream_nodes') AS up, bool_or(tool = 'diagnose_node' AND starts_with(c.node_id, gt_system || '::')) AS ins, bool_or(tool = 'diagnose_node' AND c.node_id = gt_node) AS att FROM eps e JOIN calls c USING (episode_id) GROUP BY ALL),
xt AS (SELECT episode_id, CASE WHEN crosses THEN greatest(-1, least(1, 0.15 * traced::INT + 0.15 * up::INT + 0.35 * ins::INT + 0.35 * att::INT + CASE WHEN NOT said THEN 0 WHEN free THEN -0.7 WHEN of_node <> '' AND of_node <> gt_system THEN -0.45 WHEN of_node = gt_system THEN 0.1 ELSE 0 END - 0.35 * (NOT ins)::INT - 0.45 * (NOT said)::INT))
 WHEN traced THEN greatest(-1, -0.25 - CASE WHEN NOT said THEN 0.25 WHEN diag_system <> gt_system THEN 0.2 ELSE 0 END - 0.1 * up::INT) ELSE 0 END::DOUBLE AS cross_trace FROM tr)"""
#: The text of a call's turn, in words that both engines read.
TEXT = """CASE WHEN step % 13 = 0 THEN '' WHEN step % 7 = 0 THEN '<think>ok</think>' ELSE '<think>' || CASE step % 4 WHEN 0 THEN 'The sensor reading shows a fault at ' || node_id || '.' WHEN 1 THEN 'check it' WHEN 2 THEN 'Highest anomaly: system health is low, so go upstream' ELSE 'now the source' END || '</think>' END || chr(10) ||
 CASE WHEN step % 6 = 0 THEN '<tool_call>{"name": "' || tool || '"}</tool_call>' WHEN step % 17 = 0 THEN '<tool_call> {"name": broken} </tool_call>' WHEN step % 5 = 4 THEN 'no call' ELSE '<tool_call>{"name": "' || tool || '", "arguments": {"node_id": "' || node_id || '"}}</tool_call>' END"""
_CALL = r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"
_CLAIMS = " + ".join(f"len(regexp_extract_all(lower(text), '{p}'))" for p in transcripts.HEALTH_CLAIMS)
TXT = rf"""t AS (SELECT episode_id, i, {TEXT} AS text FROM calls),
tx AS (SELECT episode_id, regexp_extract_all(text, '{_CALL}', 1) AS tc, contains(text, '<tool_call>') AS h, length(trim(regexp_extract(text, '(?s)<think>(.*?)</think>', 1))) AS th, {_CLAIMS} AS claims FROM t),
txt AS (SELECT episode_id, coalesce(sum(list_sum(list_transform(tc, lambda j: CASE WHEN NOT json_valid(j) THEN 0.0 WHEN json_exists(j, '$.name') AND json_exists(j, '$.arguments') THEN 1.0 WHEN json_exists(j, '$.name') THEN 0.5 ELSE 0.0 END))) / nullif(sum(len(tc)), 0), 0.5)::DOUBLE AS format,
 coalesce(sum(CASE WHEN h AND th >= 20 THEN 1.0 WHEN h AND th >= 5 THEN 0.5 ELSE 0.0 END) / nullif(count(*) FILTER (h), 0), 0.5)::DOUBLE AS reasoning, -least(0.3, 0.08 * sum(claims))::DOUBLE AS grounding FROM tx GROUP BY 1)"""


def agent_turns(calls):
    return calls.select("episode_id", "i", F.expr(TEXT).alias("text"))


def useful():
    return F.col("step") % 3 != 1


@query(f"WITH {BASE}, {ACC} SELECT episode_id, round(accuracy, 6) AS accuracy, round(efficiency, 6) AS efficiency, round(completeness, 6) AS completeness FROM acc")
def accuracy_terms(spark, sf_dir):
    return rounded(rewards.accuracy_terms(*world(spark, sf_dir)), "accuracy", "efficiency", "completeness")


@query(f"WITH {BASE}, {TXT} SELECT episode_id, round(format, 6) AS format, round(reasoning, 6) AS reasoning, round(grounding, 6) AS grounding FROM txt")
def text_rewards(spark, sf_dir):
    return rounded(transcripts.text_rewards(agent_turns(world(spark, sf_dir)[1])), "format", "reasoning", "grounding")


@query(f"WITH {BASE}, {TOPO} SELECT episode_id, round(topology, 6) AS topology FROM topo")
def topology_reward(spark, sf_dir):
    return rounded(rewards.topology_reward(*world(spark, sf_dir)), "topology")


@query(f"WITH {BASE}, {CONS} SELECT * FROM cons")
def consistency_reward(spark, sf_dir):
    return rewards.consistency_reward(*world(spark, sf_dir), weak=F.col("step") % 7 == 0)


@query(f"WITH {BASE}, {SENS} SELECT * FROM summ")
def sensor_summary(spark, sf_dir):
    return rewards.sensor_summary(world(spark, sf_dir)[1], useful())


@query(f"WITH {BASE}, {SENS} SELECT episode_id, round(sensor_verification, 6) AS sensor_verification FROM sens")
def sensor_reward(spark, sf_dir):
    return rounded(rewards.sensor_reward(*world(spark, sf_dir), useful()), "sensor_verification")


@query(f"WITH {BASE}, {PROC} SELECT episode_id, round(process, 6) AS process FROM proc")
def process_reward(spark, sf_dir):
    return rounded(rewards.process_reward(*world(spark, sf_dir)), "process")


@query(f"WITH {BASE}, {CROSS} SELECT episode_id, round(cross_trace, 6) AS cross_trace FROM xt")
def cross_trace_reward(spark, sf_dir):
    return rounded(rewards.cross_trace_reward(*world(spark, sf_dir), plants=("sys0",)), "cross_trace")


#: The weights without the potential's term, which SQL can't fold.
PLAIN = {k: w for k, w in rewards.WEIGHTS.items() if k != "epo"}
EVID = """s2 AS (SELECT episode_id, node_id, status, fault_type, i, round(CASE WHEN status IN ('error') THEN 0 ELSE round(0.4::DOUBLE * (0.35::DOUBLE + 0.65::DOUBLE * least(confidence, 1::DOUBLE)), 4) END * CASE status WHEN 'fault' THEN 1.0::DOUBLE WHEN 'warning' THEN 0.72::DOUBLE WHEN 'abnormal' THEN 0.55::DOUBLE WHEN 'error' THEN 0 ELSE -0.55::DOUBLE END, 4) AS p FROM calls),
f2 AS (SELECT episode_id, node_id, sum(p) AS score, sum(greatest(p, 0)) AS pos, sum(greatest(-p, 0)) AS neg FROM s2 WHERE status <> 'error' GROUP BY 1, 2),
conf AS (SELECT episode_id, coalesce(avg(CASE WHEN pos > 0 AND neg > 0 THEN least(pos, neg) / greatest(pos, neg) END), 0) AS conflict, sum(neg) AS neg FROM f2 GROUP BY 1),
bel AS (SELECT episode_id, node_id, score, exp(score) / sum(exp(score)) OVER (PARTITION BY episode_id) AS belief FROM f2 WHERE score > 0),
nam AS (SELECT episode_id, node_id, max(fault_type) AS seen FROM calls WHERE status IN ('fault', 'warning', 'abnormal') GROUP BY 1, 2),
anyb AS (SELECT episode_id, bool_or(status IN ('fault', 'warning', 'abnormal')) AS ab, count(*) FILTER (tool = 'diagnose_node') AS nd FROM calls GROUP BY 1),
evid AS (SELECT e.episode_id, coalesce(conflict, 0) AS conflict, CASE WHEN NOT said THEN 0 ELSE round(CASE WHEN free THEN CASE WHEN ab THEN 0 WHEN nd = 0 THEN 0.3 ELSE least(1, 0.45 + 0.45 * least(1, coalesce(conf.neg, 0))) END
 WHEN seen IS NOT NULL THEN greatest(0, least(1, 0.25 + 0.35 * greatest(0, least(1, coalesce(score, 0))) + 0.25 * coalesce(belief, 0) + CASE WHEN seen = diag_fault THEN 0.35 ELSE 0 END - 0.25 * coalesce(conflict, 0))) ELSE 0 END, 4) END::DOUBLE AS evidence
 FROM eps e JOIN anyb USING (episode_id) LEFT JOIN conf USING (episode_id) LEFT JOIN bel ON bel.episode_id = e.episode_id AND bel.node_id = e.diag_node LEFT JOIN nam ON nam.episode_id = e.episode_id AND nam.node_id = e.diag_node)"""
_W = PLAIN
TOTAL = f"""{ACC}, {TXT}, {TOPO}, {CONS}, {SENS}, {PROC}, {CROSS}, {EVID},
tot AS (SELECT e.episode_id, {_W["accuracy"]} * accuracy + CASE WHEN accuracy < 0.3 THEN 0 ELSE {_W["efficiency"]} * efficiency + {_W["completeness"]} * completeness END + {_W["format"]} * format + {_W["reasoning"]} * CASE WHEN said THEN reasoning ELSE least(reasoning, 0.3) END
 + {_W["topology"]} * CASE WHEN said THEN topology ELSE 0 END + {_W["consistency"]} * consistency + {_W["evidence"]} * CASE WHEN said AND accuracy <= 0 THEN least(evidence, 0.2) ELSE evidence END + {_W["sensor_verification"]} * sensor_verification + {_W["cross_trace"]} * cross_trace + {_W["process"]} * process
 - CASE WHEN NOT said THEN 0.3 + CASE WHEN n >= 15 THEN 0.15 ELSE 0 END WHEN accuracy <= 0 THEN 0.12 ELSE 0 END + 0.15 * least(consistency, 0) + 0.1 * least(sensor_verification, 0) + 0.1 * least(cross_trace, 0) + 0.08 * least(process, 0) + grounding - 0.05 * conflict - 0.001 * n AS total
 FROM eps e JOIN n USING (episode_id) JOIN acc USING (episode_id) JOIN txt USING (episode_id) JOIN topo USING (episode_id) JOIN cons USING (episode_id) JOIN sens USING (episode_id) JOIN proc USING (episode_id) JOIN xt USING (episode_id) JOIN evid USING (episode_id))"""


def reward_terms(spark, sf_dir):
    """All terms of the total for each episode, without the potential's; episodes and calls are written once, dealt by episode."""
    eps, calls = (by_key(df, "episode_id") for df in world(spark, sf_dir))
    scores = metrics.episode_scores(eps, calls).select("episode_id", "n_calls", F.col("support").alias("evidence"), "conflict", (F.col("no_diagnosis") == 0).alias("has"))
    terms = scores.withColumn("epo_violation", F.lit(0.0))
    for part in (
        rewards.accuracy_terms(eps, calls), transcripts.text_rewards(agent_turns(calls)), rewards.topology_reward(eps, calls), rewards.consistency_reward(eps, calls, F.col("step") % 7 == 0), rewards.sensor_reward(eps, calls, useful()),
        rewards.process_reward(eps, calls), rewards.cross_trace_reward(eps, calls, ("sys0",)),
    ):
        terms = terms.join(part, "episode_id")
    return terms


@query(f"WITH {BASE}, {TOTAL} SELECT episode_id, round(total, 8) AS total FROM tot")
def total_reward(spark, sf_dir):
    return rewards.total_reward(reward_terms(spark, sf_dir), PLAIN, digits=8)


@query()
def epo_reward(spark, sf_dir):
    return potential.rewards(*world(spark, sf_dir))


# --- metrics ---------------------------------------------------------------------------------------------------------
@query(f"""WITH {BASE}, ref AS (SELECT episode_id, unnest([gt_system || '::n0', gt_system || '::n1', gt_system || '::n5']) AS dst, gt_node AS src FROM eps WHERE NOT clean),
seen AS (SELECT DISTINCT episode_id, node_id AS a, unnest(targets) AS b FROM calls)
SELECT r.episode_id, round(avg((EXISTS (SELECT 1 FROM seen s WHERE s.episode_id = r.episode_id AND ((s.a = r.src AND s.b = r.dst) OR (s.a = r.dst AND s.b = r.src))))::INT), 6) AS edges FROM ref r GROUP BY 1""")
def topology_rationality(spark, sf_dir):
    return rounded(metrics.edge_coverage(*world(spark, sf_dir)), "edges")


@query(f"""WITH {BASE} SELECT episode_id, CASE WHEN NOT said THEN 0 WHEN free THEN (clean AND bad = 0)::INT WHEN own = 0 THEN 0 WHEN backs > 0 THEN 1 ELSE 0.5 END::DOUBLE AS consistency, CASE WHEN said AND NOT free THEN (own = 0)::INT END::DOUBLE AS unsupported FROM (
SELECT e.episode_id, said, free, clean, count(*) FILTER ({BAD}) AS bad, count(*) FILTER ({BAD} AND c.node_id = diag_node) AS own, count(*) FILTER ({BAD} AND c.node_id = diag_node AND c.fault_type = diag_fault) AS backs FROM eps e JOIN calls c USING (episode_id) GROUP BY ALL)""")
def oracle_consistency(spark, sf_dir):
    return rewards.tool_support(*world(spark, sf_dir))


def _words(words):
    return "regexp_matches(lower(think), '" + "|".join(words) + "')"


_TIED = " ".join(f"WHEN '{k}' THEN {_words(w)}" for k, w in transcripts.TOOL_WORDS.items())


@query(rf"""WITH {BASE}, {TXT}, k AS (SELECT episode_id, i, text, contains(text, '<think>') AS has, trim(regexp_extract(text, '(?s)<think>(.*?)</think>', 1)) AS think, regexp_extract(text, '"name":\s*"(\w+)"', 1) AS tool FROM t WHERE contains(text, '<tool_call>'))
SELECT count(*) AS n_calls, round(avg(CASE WHEN NOT has THEN 0 ELSE least(1, CASE WHEN length(think) >= 30 THEN 0.4 WHEN length(think) >= 15 THEN 0.2 ELSE 0 END + CASE WHEN i = 0 THEN 0 WHEN {_words(transcripts.RESULT_WORDS)} THEN 0.3 ELSE 0.1 END + CASE WHEN tool = '' THEN 0 WHEN CASE tool {_TIED} ELSE false END THEN 0.3 ELSE 0.1 END) END), 6) AS authenticity FROM k""")
def reasoning_authenticity(spark, sf_dir):
    t = agent_turns(world(spark, sf_dir)[1])
    score = transcripts.authenticity(F.col("text"), F.col("i") > 0)
    return rounded(t.agg(F.count(score).alias("n_calls"), F.avg(score).alias("authenticity")), "authenticity")


_BAL = "coalesce((avg(da) FILTER ({a}) + avg(da) FILTER ({b})) / 2, avg(da) FILTER ({a}), avg(da) FILTER ({b}), 0)"


@query(f"""WITH {BASE}, d AS (SELECT e.episode_id, scenario_type, clean, CASE WHEN clean THEN free AND NOT ab ELSE said AND gt_node = diag_node AND gt_fault = diag_fault END::INT AS da, CASE WHEN said AND n > 0 THEN least(1, 4.0 / n) ELSE 0 END AS se, CASE WHEN clean THEN free AND NOT ab ELSE said AND gt_node = diag_node END::INT AS node FROM eps e JOIN n USING (episode_id)
 JOIN (SELECT episode_id, bool_or({BAD}) AS ab FROM calls GROUP BY 1) USING (episode_id))
SELECT count(*) AS n, round(avg(da), 6) AS da, round(avg(se), 6) AS se, round(avg(node), 6) AS root_node, round({_BAL.format(a="clean", b="NOT clean")}, 6) AS balanced_da, round({_BAL.format(a="scenario_type = 'cross_system'", b="scenario_type = 'a_cross_system'")}, 6) AS cross_balanced_da FROM d""")
def balanced_accuracy(spark, sf_dir):
    s = metrics.episode_scores(*episodes(spark, sf_dir))
    part = lambda c: F.avg(F.when(c, F.col("da")))
    kind = F.col("scenario_type")
    out = s.agg(F.count("*").alias("n"), F.avg("da").alias("da"), F.avg("se").alias("se"), F.avg("root_node").alias("root_node"), rewards.balanced(part(F.col("is_no_fault")), part(~F.col("is_no_fault"))).alias("balanced_da"), rewards.balanced(part(kind == "cross_system"), part(kind == "a_cross_system")).alias("cross_balanced_da"))
    return rounded(out, "da", "se", "root_node", "balanced_da", "cross_balanced_da")


@query(f"""WITH {BASE}, {EVID} SELECT episode_id, round(evidence, 3) AS support, round(conflict, 6) AS conflict FROM evid""")
def evidence_support(spark, sf_dir):
    s = metrics.episode_scores(*episodes(spark, sf_dir))
    return s.select("episode_id", F.round("support", 3).alias("support"), F.round("conflict", 6).alias("conflict"))


_FLAGS = """q0 AS (SELECT *, row_number() OVER (PARTITION BY episode_id, tool, node_id ORDER BY i) AS rr, coalesce(max((status = 'fault')::INT) OVER (PARTITION BY episode_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS af FROM calls),
sh AS (SELECT episode_id, i, unnest(targets) AS node FROM calls),
fl AS (SELECT q0.*, NOT valid OR (rr > 1 AND tool IN ('get_node_children', 'diagnose_node')) OR (tool = 'diagnose_node' AND EXISTS (SELECT 1 FROM sh WHERE sh.episode_id = q0.episode_id AND sh.i < q0.i) AND NOT EXISTS (SELECT 1 FROM sh WHERE sh.episode_id = q0.episode_id AND sh.node = q0.node_id AND sh.i < q0.i))
 OR (af = 1 AND tool IN ('get_system_overview', 'get_related_systems', 'get_node_children')) OR (i = 0 AND tool NOT IN ('get_system_overview', 'get_node_children')) AS irr FROM q0),
ag AS (SELECT episode_id, count(*) FILTER (valid) AS n_valid, count(*) FILTER (irr) AS n_irr, count(*) FILTER (status = 'error') AS n_err, list(DISTINCT node_id) FILTER (status = 'normal' AND round(0.4::DOUBLE * (0.35::DOUBLE + 0.65::DOUBLE * least(confidence, 1::DOUBLE)), 4) >= 0.2) AS calm FROM fl GROUP BY 1),
vi AS (SELECT DISTINCT episode_id, node_id AS node FROM calls UNION SELECT episode_id, node FROM sh)"""
_CHECKS = """u AS (SELECT *, tool = 'diagnose_node' AND (status IN ('unknown', 'warning', 'indeterminate') OR confidence < 0.6) AS unc FROM calls),
pe AS (SELECT u.*, EXISTS (SELECT 1 FROM u x WHERE x.episode_id = u.episode_id AND x.node_id = u.node_id AND x.unc AND x.i < u.i) AS pend FROM u),
sc AS (SELECT episode_id, bool_or(unc) AS eligible, bool_or(tool = 'get_node_sensors' AND status = 'success' AND pend) AS verified, count(*) FILTER (tool = 'get_node_sensors' AND NOT pend) AS n_blind, count(*) FILTER (tool = 'get_node_sensors') AS n_sensor FROM pe GROUP BY 1)"""
_SCORES = """m AS (SELECT e.episode_id, e.scenario_type, CASE WHEN step % 3 = 0 THEN 'easy' ELSE 'hard' END AS difficulty, clean, n, n_err, CASE WHEN clean THEN free AND NOT ab ELSE said AND gt_node = diag_node AND gt_fault = diag_fault END::INT AS da, CASE WHEN clean THEN free AND NOT ab ELSE said AND gt_system = diag_system END::INT AS root_system,
 CASE WHEN clean THEN free AND NOT ab ELSE said AND gt_node = diag_node END::INT AS root_node, CASE WHEN clean THEN free AND NOT ab ELSE said AND gt_node = diag_node AND gt_fault = diag_fault END::INT AS family, CASE WHEN said THEN least(1, 4.0::DOUBLE / n) ELSE 0 END AS se, n_valid::DOUBLE / n AS format, said::INT AS completeness,
 (EXISTS (SELECT 1 FROM vi WHERE vi.episode_id = e.episode_id AND vi.node = e.t_node))::INT AS tr, 1 - (n_irr + (NOT said)::INT)::DOUBLE / (n + (NOT said)::INT) AS tir, evidence AS support, conflict, (NOT said)::INT AS no_diagnosis, (eligible)::INT AS eligible, (eligible AND verified)::INT AS verified,
 CASE WHEN clean THEN list_contains(coalesce(calm, []), t_node) ELSE false END::INT AS review, CASE WHEN clean THEN free AND NOT ab AND list_contains(coalesce(calm, []), t_node) AND conflict <= 0.05 ELSE said AND evidence >= 0.55 AND conflict <= 0.35 END::INT AS ecr
 FROM eps e JOIN n USING (episode_id) JOIN ag USING (episode_id) JOIN anyb USING (episode_id) JOIN evid USING (episode_id) JOIN sc USING (episode_id))"""
_MEANS = ("da", "root_system", "root_node", "family", "se", "format", "completeness", "tr", "tir", "ecr", "support", "conflict", "no_diagnosis")


@query(f"WITH {BASE}, {_CHECKS} SELECT * FROM sc")
def sensor_verification(spark, sf_dir):
    return metrics.sensor_checks(episodes(spark, sf_dir)[1])


@query(f"""WITH {BASE}, {EVID}, {_FLAGS}, {_CHECKS},
{_SCORES},
r AS (SELECT scenario_type, difficulty, grouping_id(scenario_type, difficulty)::BIGINT AS gid, count(*) AS n, {", ".join(f"avg({c}) AS {c}" for c in _MEANS)}, sum(verified) / greatest(sum(eligible), 1) AS sensor_verification, sum(n_err) / greatest(sum(n), 1) AS tool_error_rate,
 coalesce(avg(review) FILTER (clean), 0) AS no_fault_review, coalesce(avg(da) FILTER (clean), 0) AS no_fault_da, coalesce(avg(da) FILTER (NOT clean), 0) AS fault_da FROM m GROUP BY GROUPING SETS ((), (scenario_type), (difficulty)))
SELECT scenario_type, difficulty, gid, n, {", ".join(f"round({c}, 5) AS {c}" for c in (*_MEANS, "sensor_verification", "tool_error_rate", "no_fault_review", "no_fault_da", "fault_da"))}, round((no_fault_da + fault_da) / 2, 5) AS balanced_da, round(0.25 * da + 0.15 * (format + completeness + se + tir + tr), 5) AS aggregate FROM r""")
def episode_metrics(spark, sf_dir):
    out = metrics.report(metrics.episode_scores(*(by_key(df, "episode_id") for df in episodes(spark, sf_dir))))
    return out.withColumns({c: F.round(c, 5) for c, t in out.dtypes if t == "double"})


_RATES = ("da", "root_system", "root_node", "family", "se", "tr", "tir", "ecr", "support", "conflict")
_SUPPORT = f"""SELECT e.episode_id, CASE WHEN NOT said THEN 0 WHEN free THEN (clean AND bad = 0)::INT WHEN own = 0 THEN 0 WHEN backs > 0 THEN 1 ELSE 0.5 END::DOUBLE AS consistency, CASE WHEN said AND NOT free THEN (own = 0)::INT END::DOUBLE AS unsupported FROM (
 SELECT e.episode_id, said, free, clean, count(*) FILTER ({BAD}) AS bad, count(*) FILTER ({BAD} AND c.node_id = diag_node) AS own, count(*) FILTER ({BAD} AND c.node_id = diag_node AND c.fault_type = diag_fault) AS backs FROM eps e JOIN calls c USING (episode_id) GROUP BY ALL) e"""
_SELECTED = ("wrong_system", "root_belief", "ran_out", "oracle_consistency", "unsupported", "low_confidence_read", "cross_trace", "cross_root_system", "blind_rate", "sensor_verification", "tool_error", "balanced_da", "cross_balanced_da", "no_action", "truncated", "timeout", "action_completion")
_CHOICE = {"balanced_da": "balanced_da", "cross_balanced_da": "cross_balanced_da"} | {k: k for k in rewards.SELECTION if k != "authenticity"}


@query(f"""WITH {BASE}, {EVID}, {_FLAGS}, {_CHECKS}, {_SCORES}, su AS ({_SUPPORT}),
u1 AS (SELECT episode_id, bool_or(tool = 'get_node_sensors') AS reads, bool_or(tool IN ('get_related_systems', 'get_upstream_nodes')) AS traces FROM calls GROUP BY 1),
b1 AS (SELECT e.episode_id, CASE WHEN step % 7 = 0 AND NOT clean THEN 'na_low_confidence' ELSE scenario_type END AS kind, CASE WHEN NOT clean THEN (NOT said OR diag_system <> gt_system)::INT END::DOUBLE AS wrong_system,
 round(CASE WHEN clean THEN CASE WHEN ab THEN 0 WHEN nd = 0 THEN 0.3 ELSE least(1, 0.45 + 0.45 * least(1, coalesce(conf.neg, 0))) END ELSE coalesce(bel.belief, 0) END, 4)::DOUBLE AS root_belief, n_blind, n_sensor, reads, traces, (NOT said AND n.n >= 8)::INT AS ran_out
 FROM eps e JOIN n USING (episode_id) JOIN anyb USING (episode_id) JOIN u1 USING (episode_id) JOIN sc USING (episode_id) LEFT JOIN conf USING (episode_id) LEFT JOIN bel ON bel.episode_id = e.episode_id AND bel.node_id = e.gt_node),
r1 AS (SELECT count(*) AS n, {", ".join(f"avg({c}) AS {c}" for c in _RATES)}, coalesce(avg(wrong_system), 0) AS wrong_system, avg(root_belief) AS root_belief, avg(ran_out) AS ran_out, avg(consistency) AS oracle_consistency, coalesce(avg(unsupported), 0) AS unsupported,
 coalesce(avg(reads::INT) FILTER (kind = 'na_low_confidence'), 0) AS low_confidence_read, coalesce(avg(traces::INT) FILTER (kind = 'cross_system'), 0) AS cross_trace, coalesce(avg(root_system) FILTER (kind = 'cross_system'), 0) AS cross_root_system, sum(n_blind) / greatest(sum(n_sensor), 1) AS blind_rate,
 sum(verified) / greatest(sum(eligible), 1) AS sensor_verification, sum(n_err) / greatest(sum(n), 1) AS tool_error, {_BAL.format(a="clean", b="NOT clean")} AS balanced_da, {_BAL.format(a="kind = 'cross_system'", b="kind = 'a_cross_system'")} AS cross_balanced_da FROM m JOIN b1 USING (episode_id) JOIN su USING (episode_id)),
o1 AS (SELECT count(*) AS n_outputs, avg((step % 6 = 5)::INT) AS no_action, avg((step % 13 = 0)::INT) AS truncated, avg((step % 29 = 0)::INT) AS timeout, 1 - avg((step % 6 = 5)::INT) AS action_completion FROM calls)
SELECT n, n_outputs, {", ".join(f"round({c}, 5) AS {c}" for c in (*_RATES, *_SELECTED))}, round({" + ".join(f"({rewards.SELECTION[k]}) * {c}" for k, c in _CHOICE.items())} - 0.05 * greatest(0, 0.40 - cross_balanced_da), 5) AS selection_score, round((da + tr + ecr + se) / 4, 5) AS paper_mean FROM r1, o1""")
def selection_report(spark, sf_dir):
    eps, calls = world(spark, sf_dir)
    eps = eps.withColumn("scenario_type", F.when((F.col("step") % 7 == 0) & (F.col("gt_fault") != "normal"), "na_low_confidence").otherwise(F.col("scenario_type")))
    outputs = calls.select("episode_id", F.when(F.col("step") % 6 == 5, "no_action").otherwise("tool").alias("event"), (F.col("step") % 13 == 0).alias("truncated"), (F.col("step") % 29 == 0).alias("timeout"))
    scores = metrics.episode_scores(eps.drop("ref_edges"), calls)
    one = metrics.selection(scores, metrics.behaviour(eps, calls, max_steps=8), rewards.tool_support(eps, calls), metrics.output_rates(outputs))
    out = rewards.selection_score(one.withColumn("authenticity", F.lit(0.0))).drop("authenticity")
    return out.withColumns({c: F.round(c, 5) for c, t in out.dtypes if t == "double"})


# --- transcripts -----------------------------------------------------------------------------------------------------
#: Turns made of conversations: assistant texts with thoughts, calls, diagnoses and labels, some of them broken.
TURN = """CASE WHEN role <> 'assistant' THEN text ELSE CASE WHEN turn % 7 = 3 THEN '' ELSE '<think>a ' || conv_id || '</think>' END || CASE WHEN turn % 11 = 5 THEN '<think>b</think>' ELSE '' END ||
 CASE WHEN conv_id % 3 = 0 THEN '<diagnosis>{"root_cause_node": "n' || (conv_id % 5) || '", "fault_type": "f' || (turn % 2) || '", "status": "Fault", "confidence": 0.5}</diagnosis>' WHEN conv_id % 13 = 1 THEN '<tool_call>{"name": </tool_call>' ELSE '<tool_call> {"name": "diagnose_node", "arguments": {"node_id": "n' || (conv_id % 5) || '"}} </tool_call>' END ||
 CASE WHEN conv_id % 17 = 0 THEN '<tool_call>{"name": "x"}</tool_call>' ELSE '' END || CASE WHEN turn % 9 = 7 THEN '' ELSE '<topoitl_state>{"k": 1}</topoitl_state>' END ||
 CASE WHEN conv_id % 3 = 0 THEN '<topoitl_action>{"type": "final_diagnosis", "primitive": "conclude", "diagnosis": {"root_cause_node": "n' || (conv_id % 4) || '", "fault_type": "f' || (turn % 2) || '", "status": "Fault"}}</topoitl_action>'
 ELSE '<topoitl_action>{"tool": "' || CASE WHEN conv_id % 4 = 1 THEN 'other' ELSE 'diagnose_node' END || '", "arguments": {"node_id": "n' || (conv_id % 6) || '"}}</topoitl_action>' END END"""
_TURNS = f"SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'gpt' WHEN 'user' THEN 'human' ELSE role END AS role, {TURN} AS text FROM conversations"


def turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.when(F.col("role") == "assistant", "gpt").when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("role"), F.expr(TURN).alias("text"))


_AT = "strpos(text, '<{0}>')"
_ONE = "regexp_extract(text, '(?s)<{0}>(.*?)</{0}>', 1)"


@query(rf"""WITH g AS (SELECT *, len(regexp_extract_all(text, '(?s)<think>.*?</think>')) AS nt, len(regexp_extract_all(text, '(?s)<topoitl_state>.*?</topoitl_state>')) AS ns, len(regexp_extract_all(text, '(?s)<topoitl_action>.*?</topoitl_action>')) AS na, contains(text, '<tool_call>') AS hc, contains(text, '<diagnosis>') AS hd,
 nullif(regexp_extract(text, '(?s)<tool_call>\s*(\{{.*?\}}|\s*)\s*</tool_call>', 1), '') AS c, nullif(regexp_extract(text, '(?s)<diagnosis>\s*(\{{.*?\}}|\s*)\s*</diagnosis>', 1), '') AS d, {_ONE.format("topoitl_state")} AS s, {_ONE.format("topoitl_action")} AS a FROM ({_TURNS}) WHERE role = 'gpt'),
j AS (SELECT *, coalesce(json_valid(c), false) AS cv, coalesce(json_valid(d), false) AS dv, na = 1 AND json_valid(a) AS av, ns = 1 AND json_valid(s) AS sv FROM g),
x AS (SELECT *, CASE WHEN cv THEN c END AS cj, CASE WHEN dv THEN d END AS dj, CASE WHEN av THEN a END AS aj FROM j)
SELECT conv_id, turn, nt <> 1 AS think, hc = hd AS action, ns <> 1 AS state, na <> 1 AS label, hc AND NOT cv AS call_json, hd AND NOT dv AS diagnosis_json, ns = 1 AND NOT sv AS state_json, na = 1 AND NOT av AS label_json,
 hc AND cv AND av AND json_extract_string(aj, '$.tool') IS DISTINCT FROM json_extract_string(cj, '$.name') AS tool_differs, hc AND cv AND av AND json_extract_string(aj, '$.arguments.node_id') IS DISTINCT FROM json_extract_string(cj, '$.arguments.node_id') AS argument_differs,
 coalesce(hc AND cv AND av AND json_extract_string(cj, '$.arguments.node_id') = 'n4', false) AS unknown_node, hd AND dv AND av AND (json_extract_string(aj, '$.type') IS DISTINCT FROM 'final_diagnosis' OR json_extract_string(aj, '$.primitive') IS DISTINCT FROM 'conclude') AS conclusion,
 hd AND dv AND av AND (json_extract_string(aj, '$.diagnosis.root_cause_node') IS DISTINCT FROM json_extract_string(dj, '$.root_cause_node') OR json_extract_string(aj, '$.diagnosis.fault_type') IS DISTINCT FROM json_extract_string(dj, '$.fault_type') OR json_extract_string(aj, '$.diagnosis.status') IS DISTINCT FROM json_extract_string(dj, '$.status')) AS diagnosis_differs,
 NOT (CASE WHEN hc THEN {_AT.format("tool_call")} ELSE {_AT.format("diagnosis")} END BETWEEN 1 AND {_AT.format("topoitl_state")} - 1 AND {_AT.format("topoitl_state")} < {_AT.format("topoitl_action")}) AS "order",
 len(regexp_extract_all(text, '<tool_call>')) > 1 OR len(regexp_extract_all(text, '<diagnosis>')) > 1 AS several FROM x""")
def turn_errors(spark, sf_dir):
    known = spark.createDataFrame([(f"n{i}",) for i in range(4)], "node_id string")
    return transcripts.turn_errors(turns(spark, sf_dir), known)


@query(rf"""SELECT conv_id, turn, json_extract_string(d, '$.root_cause_node') AS root_cause_node, json_extract_string(d, '$.fault_type') AS fault_type, json_extract(d, '$.confidence')::DOUBLE AS confidence FROM (
SELECT conv_id, turn, list_last(regexp_extract_all(text, '(?s)<diagnosis>\s*(\{{.*?\}})\s*</diagnosis>', 1)) AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM ({_TURNS}) WHERE contains(text, '<diagnosis>')) WHERE k = 1""")
def final_diagnosis(spark, sf_dir):
    return transcripts.final_diagnosis(turns(spark, sf_dir))


@query(f"""WITH {BASE}, u AS (SELECT episode_id, i, unnest(targets) AS node_id FROM calls)
SELECT episode_id AS conv_id, i AS turn, node_id FROM calls c WHERE tool IN ('get_node_children', 'get_downstream_nodes', 'get_upstream_nodes', 'diagnose_node', 'get_node_sensors') AND NOT EXISTS (SELECT 1 FROM u WHERE u.episode_id = c.episode_id AND u.node_id = c.node_id AND u.i < c.i)""")
def skipped_steps(spark, sf_dir):
    c = world(spark, sf_dir)[1]
    return transcripts.skipped_steps(c.select(F.col("episode_id").alias("conv_id"), F.col("i").alias("turn"), "tool", "node_id", "targets"))


@query(f"""WITH {BASE} SELECT episode_id, CASE WHEN gt_node = 'none' THEN NOT (diag_node IS NOT DISTINCT FROM 'none' AND diag_fault IS NOT DISTINCT FROM 'no_fault') ELSE NOT (diag_node IS NOT DISTINCT FROM gt_node AND diag_fault IS NOT DISTINCT FROM gt_fault) END AS wrong FROM eps""")
def wrong_conclusions(spark, sf_dir):
    e = world(spark, sf_dir)[0]
    return e.select("episode_id", transcripts.wrong_conclusion(F.col("gt_node"), F.col("gt_fault"), F.col("diag_node"), F.col("diag_fault")).alias("wrong"))


_PROMPTS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 = 0 THEN []::VARCHAR[] WHEN o_orderkey % 7 = 0 THEN ['user'] WHEN o_orderkey % 11 = 0 THEN ['system'] ELSE ['system', 'user'] END AS roles, ['rtu', 'fcu', 'moon', '', 'sdahu'][1 + o_custkey % 5] AS gt_system,
 CASE WHEN o_orderkey % 13 = 0 THEN 'x' WHEN o_orderkey % 17 = 0 THEN '-1' WHEN o_orderkey % 5 = 0 THEN NULL ELSE '4' END AS optimal, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 's' END AS scenario_id, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'g' END AS group_key FROM orders"""


@query(f"""SELECT id, len(roles) = 0 AS no_messages, NOT list_contains(roles, 'system') AS no_system, NOT list_contains(roles, 'user') AS no_user, gt_system = 'moon' AS bad_system, coalesce(try_cast(optimal AS BIGINT) < 0, false) AS negative_length,
optimal IS NOT NULL AND try_cast(optimal AS BIGINT) IS NULL AS bad_length, scenario_id = '' AS no_scenario, coalesce(group_key, '') = '' AS no_group FROM ({_PROMPTS})""")
def prompt_errors(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    roles = F.when(k % 19 == 0, F.array().cast("array<string>")).when(k % 7 == 0, F.array(F.lit("user"))).when(k % 11 == 0, F.array(F.lit("system"))).otherwise(F.array(F.lit("system"), F.lit("user")))
    records = table(spark, sf_dir, "orders").select(
        k.alias("id"), roles.alias("roles"), F.get(F.array(*map(F.lit, ("rtu", "fcu", "moon", "", "sdahu"))), (c % 5).cast("int")).alias("gt_system"),
        F.when(k % 13 == 0, "x").when(k % 17 == 0, "-1").when(k % 5 == 0, None).otherwise("4").alias("optimal"), F.when(k % 23 == 0, "").otherwise("s").alias("scenario_id"), F.when(k % 29 == 0, None).otherwise("g").alias("group_key"),
    )
    return transcripts.prompt_errors(records)


PROMPT = "You find faults in buildings."


@query(rf"""WITH t AS ({_TURNS}), r AS (SELECT DISTINCT conv_id, conv_id % 6 <> 0 AS sys, conv_id % 4 <> 0 AS ver, conv_id % 5 <> 0 AS hash, conv_id % 2 = 0 AS closure FROM t),
p AS (SELECT conv_id, bool_or(contains(text, '<diagnosis>')) AS ends, sum((role = 'gpt' AND len(regexp_extract_all(text, '<think>')) > 1)::INT) AS multi, arg_min(json_extract_string(j, '$.name'), turn) FILTER (json_extract_string(j, '$.name') IS NOT NULL) AS tool,
 sum(coalesce(role = 'gpt' AND least(nullif({_AT.format("topoitl_state")}, 0), nullif({_AT.format("topoitl_action")}, 0)) < least(nullif({_AT.format("tool_call")}, 0), nullif({_AT.format("diagnosis")}, 0)), false)::INT) AS late
 FROM (SELECT *, CASE WHEN role = 'gpt' AND json_valid(b) THEN b END AS j FROM (SELECT *, regexp_extract(text, '{_CALL}', 1) AS b FROM t)) GROUP BY 1)
SELECT sum(multi)::BIGINT AS multi_think, 0::BIGINT AS empty_conversations, count(*) FILTER (NOT sys) AS missing_system, count(*) FILTER (NOT ends) AS missing_final_diagnosis, count(*) FILTER (NOT ver) AS stale_design_version, count(*) FILTER (NOT hash) AS prompt_hash_mismatch,
 count(*) FILTER (closure AND tool IS DISTINCT FROM 'get_system_overview') AS bad_first_tool, sum(late)::BIGINT AS label_before_action FROM r JOIN p USING (conv_id)""")
def loader_gates(spark, sf_dir):
    t, k = turns(spark, sf_dir), F.col("conv_id")
    now = F.sha2(F.lit(PROMPT), 256)
    records = t.select("conv_id").distinct().select("conv_id", F.when(k % 6 != 0, PROMPT).alias("system"), F.when(k % 4 != 0, "v2").otherwise("v1").alias("design_version"), F.when(k % 5 != 0, now).otherwise("old").alias("prompt_sha256"), F.when(k % 2 == 0, "terminal_closure").alias("augmentation"))
    import hashlib

    return transcripts.loader_gates(records, t, "v2", hashlib.sha256(PROMPT.encode()).hexdigest())


@query(f"""SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'old' ELSE '{PROMPT}' END <> '{PROMPT}' AS refreshed, '{PROMPT}' AS system, sha256('{PROMPT}') AS prompt_sha256 FROM (SELECT DISTINCT conv_id FROM conversations)""")
def refresh_prompt(spark, sf_dir):
    k = F.col("conv_id")
    records = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("system", F.when(k % 3 == 0, "old").otherwise(PROMPT)).withColumn("prompt_sha256", F.sha2("system", 256))
    return transcripts.refresh_prompt(records, PROMPT)


_SPANS = "SELECT conv_id, turn, ['state', 'label', 'executable', 'prose', 'human'][1 + (conv_id + turn) % 5] AS kind, length(text) / 100 AS loss FROM conversations"


@query(f"""SELECT round(sum(w * loss) / greatest(sum(w), 1), 6) AS loss FROM (SELECT loss, CASE kind WHEN 'state' THEN CASE WHEN row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) > 1 THEN 1.5 ELSE 1.0 END WHEN 'label' THEN 1.0 WHEN 'executable' THEN 1.0 WHEN 'prose' THEN 0.5 ELSE 0 END::DOUBLE AS w FROM ({_SPANS}))""")
def weighted_loss(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("state", "label", "executable", "prose", "human")))
    spans = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(kinds, ((F.col("conv_id") + F.col("turn")) % 5).cast("int")).alias("kind"), (F.length("text") / 100).alias("loss"))
    return rounded(transcripts.weighted_loss(transcripts.span_weights(spans)), "loss")


@query("""WITH k AS (SELECT DISTINCT conv_id, 'type' || (conv_id % 4) AS scenario_type FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY scenario_type ORDER BY md5(conv_id::VARCHAR), conv_id) AS k, count(*) OVER (PARTITION BY scenario_type) AS n FROM k)
SELECT r.conv_id, scenario_type, arg_min(c.text, c.turn) AS prompt FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.role = 'user' WHERE k <= greatest(1, floor(n * 0.1::DOUBLE)) GROUP BY ALL""")
def first_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "user", "human").otherwise(F.col("role")))
    kinds = c.select("conv_id").distinct().withColumn("scenario_type", F.concat(F.lit("type"), (F.col("conv_id") % 4).cast("string")))
    return transcripts.first_prompts(c, kinds)


@query(rf"""SELECT conv_id, turn, CASE WHEN e > 0 THEN left(text, e) ELSE text END AS cut, trim(regexp_replace(text, '(?s)<topoitl_(state|action)>.*?</topoitl_(state|action)>\s*', '', 'g')) AS bare FROM (SELECT *, CASE WHEN strpos(text, '</tool_call>') > 0 AND (strpos(text, '</diagnosis>') = 0 OR strpos(text, '</tool_call>') < strpos(text, '</diagnosis>')) THEN strpos(text, '</tool_call>') + 11 WHEN strpos(text, '</diagnosis>') > 0 THEN strpos(text, '</diagnosis>') + 11 ELSE 0 END AS e FROM ({_TURNS}) WHERE role = 'gpt')""")
def cut_turns(spark, sf_dir):
    t = turns(spark, sf_dir).where("role = 'gpt'")
    return t.select("conv_id", "turn", transcripts.to_first_action(F.col("text")).alias("cut"), transcripts.strip_labels(F.col("text")).alias("bare"))


@query(f"""WITH {BASE}, c AS (SELECT episode_id, count(DISTINCT node_id) AS k FROM calls WHERE tool = 'diagnose_node' GROUP BY 1) SELECT gt_system, count(*) AS n_episodes, count(DISTINCT gt_node || '|' || gt_fault) AS n_groups, round(count(DISTINCT gt_node || '|' || gt_fault)::DOUBLE / count(*), 6) AS unique_rate, round(avg(n), 6) AS mean_calls, round(avg(coalesce(k, 0)), 6) AS mean_diagnosed FROM eps JOIN n USING (episode_id) LEFT JOIN c USING (episode_id) GROUP BY 1""")
def split_statistics(spark, sf_dir):
    eps, calls = world(spark, sf_dir)
    n = calls.groupBy("episode_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("tool") == "diagnose_node", F.col("node_id"))).alias("k"))
    j = eps.join(n, "episode_id")
    groups = F.count_distinct(F.concat_ws("|", "gt_node", "gt_fault"))
    return rounded(j.groupBy("gt_system").agg(F.count("*").alias("n_episodes"), groups.alias("n_groups"), (groups / F.count("*")).alias("unique_rate"), F.avg("n").alias("mean_calls"), F.avg("k").alias("mean_diagnosed")), "unique_rate", "mean_calls", "mean_diagnosed")


# --- what a loss sees -------------------------------------------------------------------------------------------------
_IN = "list_contains(list_transform({0}, lambda s: s[1] <= mid AND mid < s[2]), true)"


@query(f"""WITH t AS ({_TURNS}), b AS (SELECT conv_id, turn, role, text, regexp_extract_all(text, '(?s)<tool_call>.*?</tool_call>|<diagnosis>.*?</diagnosis>') AS e,
 CASE WHEN contains(text, '<topoitl_state>') THEN [[strpos(text, '<topoitl_state>') - 1, strpos(text, '</topoitl_state>') + 15]] ELSE [] END AS st, CASE WHEN contains(text, '<topoitl_action>') THEN [[strpos(text, '<topoitl_action>') - 1, strpos(text, '</topoitl_action>') + 16]] ELSE [] END AS la FROM t),
p AS (SELECT *, list_transform(e, lambda x: [strpos(text, x) - 1, strpos(text, x) - 1 + length(x)]) AS ex FROM b),
f AS (SELECT conv_id, min(turn) AS first_turn FROM p WHERE role = 'gpt' AND len(st) > 0 GROUP BY 1),
k AS (SELECT p.*, first_turn, unnest(range(0, greatest(length(text), 1), 16)) AS a FROM p LEFT JOIN f USING (conv_id)),
m AS (SELECT *, CASE WHEN least(a + 16, length(text)) > a THEN (a + least(a + 16, length(text))) / 2 ELSE a END AS mid FROM k)
SELECT conv_id, turn, a::INT AS start, role = 'gpt' AS trained, CASE WHEN role <> 'gpt' THEN 0 WHEN {_IN.format("st")} THEN CASE WHEN turn = first_turn THEN 1 ELSE 1.5 END WHEN {_IN.format("la")} OR {_IN.format("ex")} THEN 0.75 ELSE 0.25 END::DOUBLE AS weight FROM m""")
def token_weights(spark, sf_dir):
    t = turns(spark, sf_dir)
    tokens = t.select("conv_id", "turn", F.length("text").alias("n_"), F.explode(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(16))).alias("start"))
    tokens = tokens.select("conv_id", "turn", "start", F.least(F.col("start") + 16, F.col("n_")).alias("end"))
    return transcripts.token_weights(tokens, t, {"action": 0.75, "base": 0.25}).drop("end")


#: Sentences that differ in case and blanks are made of the conversations' own ones.
@query(r"""WITH s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(trim(regexp_replace(text || ' ' || lower(text[:40]) || '. ' || text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM conversations),
w AS (SELECT conv_id, turn, list_filter(list_transform(parts, lambda y: lower(y)), lambda x, i: list_position(list_transform(parts, lambda y: lower(y)), x) = i) AS own FROM s)
SELECT conv_id, turn, len(own)::INT AS n_sentences, md5(array_to_string(own, '|')) AS digest FROM w""")
def unique_sentences(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = transcripts.unique_sentences(F.concat("text", F.lit(" "), F.lower(F.left("text", F.lit(40))), F.lit(". "), "text"))
    own = F.transform(F.filter(F.split(said, r"(?<=[.!?])\s+"), lambda x: x != ""), F.lower)
    return c.select("conv_id", "turn", F.size(own).alias("n_sentences"), F.md5(F.array_join(own, "|")).alias("digest"))


@query(f"""WITH {BASE}, k AS (SELECT e.episode_id, e.free AS calm_end, CASE WHEN step % 7 = 0 AND NOT clean THEN 'na_low_confidence' ELSE scenario_type END AS kind, diag_node AS root, e.free OR scenario_type = 'no_fault' AND NOT (step % 7 = 0 AND NOT clean) AS fr FROM eps e WHERE said),
x AS (SELECT c.episode_id, c.i, c.tool, c.node_id, kind, fr, tool = 'diagnose_node' AS asks, tool = 'diagnose_node' AND status = 'normal' AND confidence >= 0.1 AS calm0, tool = 'diagnose_node' AND status = 'normal' AND 0.85 <= confidence * 3 AS calm, tool = 'diagnose_node' AND c.node_id = root AS own,
 tool = 'get_node_sensors' AND c.node_id = root AND c.step % 3 <> 1 AS reads, tool = 'diagnose_node' AND status IN ('abnormal', 'warning', 'fault') AS bad FROM calls c JOIN k USING (episode_id)),
y AS (SELECT *, sum(calm::INT) OVER b AS n_calm, sum(own::INT) OVER b AS n_own, sum(reads::INT) OVER b AS n_read, sum(asks::INT) OVER b AS n_ask, row_number() OVER b AS n_any, sum(calm::INT) OVER w AS all_calm, bool_or(own) OVER w AS any_own, bool_or(reads) OVER w AS any_read, bool_or(asks) OVER w AS any_ask FROM x WINDOW b AS (PARTITION BY episode_id ORDER BY i DESC), w AS (PARTITION BY episode_id)),
z AS (SELECT *, CASE WHEN fr THEN calm AND n_calm <= 3 AND all_calm >= 2 WHEN kind = 'na_low_confidence' AND (any_own OR any_read) THEN (own AND n_own = 1) OR (reads AND n_read = 1) WHEN any_own THEN own AND n_own = 1 WHEN any_ask THEN asks AND n_ask = 1 ELSE n_any = 1 END AS chosen FROM y),
u AS (SELECT *, min(i) FILTER (chosen) OVER (PARTITION BY episode_id) AS lo FROM z),
v AS (SELECT *, i < lo AND (tool IN {transcripts._TOPOLOGY} OR bad) AS near, min(i) FILTER (i < lo AND tool = 'get_system_overview') OVER (PARTITION BY episode_id) AS ov, min(i) FILTER (i < lo AND tool = 'get_node_children' AND starts_with(node_id, 'system::')) OVER (PARTITION BY episode_id) AS ch FROM u WHERE lo IS NOT NULL),
q AS (SELECT *, i < lo AND (coalesce(i = ov, false) OR coalesce(i = ch, false) OR (near AND sum(near::INT) OVER (PARTITION BY episode_id ORDER BY i DESC) <= CASE WHEN contains(kind, 'no_fault') THEN 6 WHEN contains(kind, 'cross_system') THEN 8 ELSE 5 END)) AS ctx FROM v),
g AS (SELECT *, bool_or(ctx) OVER (PARTITION BY episode_id) AS kept, bool_or(asks AND i = lo) OVER (PARTITION BY episode_id) AS opens FROM q)
SELECT episode_id AS conv_id, i, CASE WHEN chosen THEN 'evidence' ELSE 'context' END AS part FROM g WHERE (chosen OR ctx) AND (kept OR NOT opens)""")
def closing_events(spark, sf_dir):
    eps, calls = world(spark, sf_dir)
    low = (F.col("step") % 7 == 0) & (F.col("gt_fault") != "normal")
    final = eps.where("diag_node IS NOT NULL").select(F.col("episode_id").alias("conv_id"), F.when(low, "na_low_confidence").otherwise(F.col("scenario_type")).alias("scenario_type"), F.col("diag_node").alias("node"), F.col("diag_fault").alias("fault"))
    events = calls.select(F.col("episode_id").alias("conv_id"), "i", "tool", "node_id", "status", (F.col("confidence") * 3).alias("confidence"), (F.col("step") % 3 != 1).alias("has_readings"))
    return transcripts.closing_events(events, final)


@query("""WITH r AS (SELECT conv_id, max(turn)::INT AS m, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE ['single', 'cross', 'no_fault'][1 + conv_id % 3] END AS kind, CASE WHEN conv_id % 4 = 0 THEN 'terminal_closure' END AS aug, count(*) AS n FROM conversations GROUP BY 1)
SELECT scenario_type, augmentation, grouping_id(scenario_type, augmentation)::BIGINT AS gid, count(*) AS n_examples, round(avg(n), 6) AS avg_turns, round(avg(m), 6) AS avg_calls FROM (SELECT coalesce(kind, 'unknown') AS scenario_type, coalesce(aug, 'full_trajectory') AS augmentation, n, m FROM r) GROUP BY GROUPING SETS ((), (scenario_type), (augmentation))""")
def dataset_report(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    records = c.groupBy("conv_id").agg(F.max("turn").cast("int").alias("n_calls")).withColumns({"scenario_type": F.when(k % 5 != 0, F.get(F.array(*map(F.lit, ("single", "cross", "no_fault"))), (k % 3).cast("int"))), "augmentation": F.when(k % 4 == 0, "terminal_closure")})
    return rounded(datasets.dataset_report(records, c), "avg_turns", "avg_calls")


#: The falls of a trace add up to the fall from its start, and its rewards to the reward of the whole: SQL knows that without folding.
@query(f"WITH {BASE} SELECT episode_id, n AS steps, true AS telescopes, true AS adds_up FROM n")
def step_rewards(spark, sf_dir):
    eps, calls = world(spark, sf_dir)
    s = potential.step_rewards(eps, calls).groupBy("episode_id").agg(F.count("*").alias("steps"), (F.max(F.abs(F.col("fallen") - F.col("telescoped"))) < 1e-9).alias("telescopes"), F.sum("reward").alias("all_"))
    return s.join(potential.rewards(eps, calls).select("episode_id", "epo_raw"), "episode_id").select("episode_id", "steps", "telescopes", (F.abs(F.col("all_") - F.col("epo_raw")) < 1e-4).alias("adds_up"))


def _u(what):
    return f"(('0x' || md5(o_orderkey || '|{what}' || '|42')[:12])::BIGINT / {float(1 << 48)!r})"


_READ = ", ".join(
    f"round({low} + {high - low} * {_u(k)} + CASE WHEN o_orderkey % 3 = 0 AND {_u(k + '-moved')} < 0.4 THEN CASE WHEN {_u(k + '-sign')} < 0.5 THEN -1.0 ELSE 1.0 END * (0.15 + 0.25 * {_u(k + '-shift')}) * {high - low} ELSE 0 END, 2) AS {k}" for k, (low, high) in trajectories.READINGS.items()
)


@query(f"""SELECT o_orderkey, {_READ}, CASE o_orderkey % 3 WHEN 0 THEN 'Fault' WHEN 1 THEN 'Abnormal' ELSE 'Normal' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'fan_stuck' ELSE 'None' END AS fault_type,
 round(round(CASE o_orderkey % 3 WHEN 0 THEN 0.88 + 0.09 * {_u("confidence")} WHEN 1 THEN 0.70 + 0.20 * {_u("confidence")} ELSE 0.82 + 0.13 * {_u("confidence")} END, 4), 3) AS confidence FROM orders""")
def made_up_results(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    key = F.col("o_orderkey").cast("string")
    role = F.when(F.col("o_orderkey") % 3 == 0, "root_cause").when(F.col("o_orderkey") % 3 == 1, "intermediate")
    rows = o.withColumn("m_", trajectories.made_up_readings(key, F.col("o_orderkey") % 3 == 0)).withColumn("a_", trajectories.made_up_answer(key, role, F.lit("fan_stuck")))
    return rows.select("o_orderkey", *(F.col("m_")[k].alias(k) for k in trajectories.READINGS), "a_.status", "a_.fault_type", F.round("a_.confidence", 3).alias("confidence"))
