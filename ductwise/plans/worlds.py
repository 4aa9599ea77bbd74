"""Registered queries on scenarios: data slices, the cascade of models, recoverability, sampling, paths, records and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import oracle, scenarios, statistics, trajectories, transcripts
from ..operators import windows as W
from .catalog import _PRED, _predictions
from .registry import query, rounded, table
from .training import BAD, BASE, world

# --- a small world of files, sensors and models made of events --------------------------------------------------------
_FILES = "f AS (SELECT event_type AS system_id, event_type || '.csv' AS source_file, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_idx, ['a', 'b'][1 + event_id % 2] AS sensor, floor(value) AS value FROM events)"
_SCEN = """s AS (SELECT 's' || o_orderkey AS scenario_id, ['view', 'click', 'error', 'signup', 'purchase'][1 + o_custkey % 5] AS root_cause_system, ['view', 'click', 'error', 'signup', 'purchase'][1 + o_custkey % 5] || '.csv' AS source_file,
 o_orderkey % 200 AS time_window_start, o_orderkey % 200 + CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE 15 END AS time_window_end,
 ['single_system', 'cross_system', 'na_cross_system', 'no_fault', 'a_single_system', 'na_low_confidence'][1 + o_orderkey % 6] AS scenario_type, ['view', 'click', 'error', 'signup', 'purchase'][1 + o_custkey % 5] || '::n' || (o_orderkey % 4) AS root_cause_node,
 ['fan_stuck', 'pump_leak', 'oa_bias_2', 'oa_bias_10'][1 + o_orderkey % 4] AS fault_type FROM orders)"""
SYSTEMS = ("view", "click", "error", "signup", "purchase")
FAULTS = ("fan_stuck", "pump_leak", "oa_bias_2", "oa_bias_10")
KINDS = ("single_system", "cross_system", "na_cross_system", "no_fault", "a_single_system", "na_low_confidence")


def _nth(values, k):
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


def files(spark, sf_dir):
    e = W.numbered(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "row_idx")
    return e.select(F.col("event_type").alias("system_id"), F.concat("event_type", F.lit(".csv")).alias("source_file"), "row_idx", _nth(("a", "b"), F.col("event_id") % 2).alias("sensor"), F.floor("value").cast("double").alias("value"))


def scenario_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, system = F.col("o_orderkey"), _nth(SYSTEMS, F.col("o_custkey") % 5)
    return o.select(
        F.concat(F.lit("s"), k.cast("string")).alias("scenario_id"), system.alias("root_cause_system"), F.concat(system, F.lit(".csv")).alias("source_file"), (k % 200).alias("time_window_start"), (k % 200 + F.when(k % 31 == 0, 0).otherwise(15)).alias("time_window_end"),
        _nth(KINDS, k % 6).alias("scenario_type"), F.concat(system, F.lit("::n"), (k % 4).cast("string")).alias("root_cause_node"), _nth(FAULTS, k % 4).alias("fault_type"),
    )


@query(f"WITH {_FILES}, {_SCEN} SELECT scenario_id, f.system_id, row_idx, sensor, value, time_window_end > time_window_start AND time_window_end <= n AS complete FROM s JOIN f ON f.system_id = s.root_cause_system AND f.source_file = s.source_file AND row_idx >= time_window_start AND row_idx < time_window_end JOIN (SELECT system_id, max(row_idx) + 1 AS n FROM f GROUP BY 1) z ON z.system_id = f.system_id")
def scenario_slices(spark, sf_dir):
    return oracle.slices(scenario_table(spark, sf_dir), files(spark, sf_dir))


_ROWS = f"{_FILES}, {_SCEN}, w AS (SELECT scenario_id, f.system_id, row_idx, sensor, value, row_idx - min(row_idx) OVER (PARTITION BY scenario_id) AS x FROM s JOIN f ON f.source_file = s.source_file AND row_idx >= time_window_start AND row_idx < time_window_end JOIN (SELECT system_id, max(row_idx) + 1 AS n FROM f GROUP BY 1) z ON z.system_id = f.system_id WHERE time_window_end > time_window_start AND time_window_end <= n)"


@query(f"WITH {_ROWS} SELECT scenario_id, system_id || '::n' || k AS node_id, sensor, round(avg(value), 4) AS value FROM w, (SELECT unnest(range(4)) AS k) WHERE sensor = CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END GROUP BY ALL")
def scenario_readings(spark, sf_dir):
    sensors = spark.createDataFrame([(s, f"{s}::n{k}", "ab"[k % 2]) for s in SYSTEMS for k in range(4)], "system_id string, node_id string, sensor string")
    return oracle.readings(oracle.slices(scenario_table(spark, sf_dir), files(spark, sf_dir)), sensors)


@query(f"""WITH {_ROWS}, m AS (SELECT scenario_id, system_id, sensor, avg(value) AS mean, max(value) - min(value) AS range, CASE WHEN count(*) > 2 THEN regr_slope(value, x::DOUBLE) ELSE 0 END AS slope FROM w GROUP BY ALL)
SELECT scenario_id, system_id, round(coalesce(max(mean) FILTER (sensor = 'a'), 0), 8) AS f0, round(coalesce(max(slope) FILTER (sensor = 'b'), 0), 8) AS f1, 0.0::DOUBLE AS f2, round(coalesce(max(range) FILTER (sensor = 'b'), 0), 8) AS f3 FROM m GROUP BY ALL""")
def scenario_features(spark, sf_dir):
    f = oracle.scenario_features(scenario_table(spark, sf_dir), files(spark, sf_dir), ["a_mean", "b_slope", "c_max", "b_range"])
    return f.select("scenario_id", "system_id", *(F.round(F.get("features", F.lit(i)), 8).alias(f"f{i}") for i in range(4)))


@query("SELECT o_orderkey, greatest(CASE WHEN b > a THEN b ELSE a + 15 END, 20) AS n_rows FROM (SELECT o_orderkey, o_orderkey % 40 AS a, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 40 + 15 END AS b FROM orders)")
def scenario_rows_needed(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", oracle.rows_needed(k % 40, F.when(k % 3 == 0, 0).otherwise(k % 40 + 15), 20).alias("n_rows"))


_MODELS = """c AS (SELECT call_id, scenario_id, CASE WHEN call_id % 41 = 0 THEN '' WHEN call_id % 37 = 0 THEN 'view::zz' ELSE root_cause_system || '::n' || (call_id % 5) END AS node_id FROM (SELECT *, substr(scenario_id, 2)::BIGINT * 3 + unnest(range(3)) AS call_id FROM s)),
av AS (SELECT scenario_id, root_cause_system AS system_id FROM s WHERE substr(scenario_id, 2)::BIGINT % 13 <> 0),
o AS (SELECT scenario_id, root_cause_system AS system_id, CASE substr(scenario_id, 2)::BIGINT % 4 WHEN 0 THEN 'Normal' WHEN 1 THEN NULL ELSE fault_type END AS label, root_cause_system || '::n' || (substr(scenario_id, 2)::BIGINT % 5) AS responsible, 0.7 AS conf FROM s WHERE substr(scenario_id, 2)::BIGINT % 7 <> 0),
r AS (SELECT scenario_id, root_cause_system || '::n' || k AS node_id, CASE WHEN k = 1 THEN 'Fault' WHEN k = 2 THEN 'Normal' ELSE 'error' END AS status, CASE WHEN k = 1 THEN 'own_fault' ELSE 'None' END AS fault_type, 0.8 AS conf FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE substr(scenario_id, 2)::BIGINT % 3 = 0),
p AS (SELECT scenario_id, root_cause_system || '::n' || k AS node_id, CASE WHEN k = 3 THEN 'Fault' ELSE 'Normal' END AS status, CASE WHEN k = 3 THEN 'weak_fault' ELSE 'None' END AS fault_type, 0.3 AS conf FROM s, (SELECT unnest([3, 4]) AS k))"""


@query(f"""WITH {_SCEN}, {_MODELS},
j AS (SELECT c.*, split_part(c.node_id, '::', 1) AS sy, contains(c.node_id, '::') AS has, regexp_matches(c.node_id, '::n[0-4]$') AS known, av.system_id IS NOT NULL AS ok, o.system_id IS NOT NULL AS oh, o.label, o.responsible, o.conf AS oc, r.status AS rs, r.fault_type AS rf, r.conf AS rc, p.status AS ps, p.fault_type AS pf, p.conf AS pc, s.root_cause_node AS root, s.fault_type AS sfault, s.scenario_type LIKE '%low_confidence%' AS low
 FROM c JOIN s USING (scenario_id) LEFT JOIN av ON av.scenario_id = c.scenario_id AND av.system_id = split_part(c.node_id, '::', 1) LEFT JOIN o ON o.scenario_id = c.scenario_id AND o.system_id = split_part(c.node_id, '::', 1) LEFT JOIN r ON r.scenario_id = c.scenario_id AND r.node_id = c.node_id LEFT JOIN p ON p.scenario_id = c.scenario_id AND p.node_id = c.node_id),
k AS (SELECT *, CASE WHEN label IS NULL THEN 'unknown' WHEN label = 'Normal' THEN 'Normal' WHEN responsible = node_id THEN 'Fault' ELSE 'Abnormal' END AS g FROM j),
b AS (SELECT *, CASE WHEN node_id = '' OR NOT known THEN 'e' WHEN NOT ok THEN 'u' WHEN oh AND g IN ('Normal', 'unknown') AND (rs = 'Fault' OR (g = 'unknown' AND rs <> 'error')) THEN 't' WHEN oh THEN 'o' WHEN rs <> 'error' THEN 'r' WHEN ps IS NOT NULL THEN 'p' ELSE 'n' END AS way FROM k),
x AS (SELECT call_id, node_id, root, sfault, way, low AND ok AND node_id = root AND way <> 't' AS lw, CASE way WHEN 'e' THEN 'error' WHEN 'u' THEN 'unknown' WHEN 'o' THEN g WHEN 'p' THEN ps WHEN 'n' THEN 'unknown' ELSE rs END AS status, CASE way WHEN 'e' THEN NULL WHEN 'u' THEN 'None' WHEN 'o' THEN CASE WHEN g = 'Fault' THEN label ELSE 'None' END WHEN 'p' THEN pf WHEN 'n' THEN NULL ELSE coalesce(nullif(CASE WHEN oh THEN label END, 'Normal'), rf) END AS fault_type,
 CASE way WHEN 'u' THEN 0 WHEN 'o' THEN CASE WHEN g = 'unknown' THEN 0 ELSE oc END WHEN 'p' THEN pc WHEN 't' THEN rc WHEN 'r' THEN rc END AS confidence, CASE way WHEN 'u' THEN 'system_oracle' WHEN 'o' THEN 'system_oracle' WHEN 'p' THEN 'per_node' WHEN 't' THEN 'per_node_responsibility' WHEN 'r' THEN 'per_node_responsibility' END AS model_source,
 CASE way WHEN 'u' THEN 'data_unavailable_for_system' WHEN 'o' THEN CASE WHEN g = 'unknown' THEN 'oracle_features_unavailable' END WHEN 'p' THEN CASE WHEN ps = 'Fault' THEN 'weak_fallback_model' END WHEN 't' THEN 'responsibility_model' WHEN 'r' THEN 'responsibility_model' WHEN 'n' THEN 'no_model' END AS calibration, CASE WHEN node_id = '' THEN 'node_id is required' WHEN NOT known THEN 'node not found' END AS error FROM b),
y AS (SELECT call_id, node_id, root, error, model_source, CASE WHEN l THEN 'Warning' ELSE status END AS status, CASE WHEN l THEN sfault ELSE fault_type END AS fault_type, CASE WHEN l THEN 0.48 ELSE confidence END AS confidence, CASE WHEN l THEN 'low_confidence_sensor_verification_required' ELSE calibration END AS calibration FROM (SELECT *, lw AND lower(status) IN ('fault', 'warning', 'abnormal', 'normal') AS l FROM x))
SELECT call_id, CASE WHEN z THEN 'Abnormal' ELSE status END AS status, CASE WHEN z THEN 'None' ELSE fault_type END AS fault_type, CASE WHEN z THEN least(confidence, 0.68) ELSE confidence END::DOUBLE AS confidence, model_source, calibration, error FROM (SELECT *, coalesce(status = 'Fault' AND node_id <> root AND lower(fault_type) NOT IN ('', 'none', 'normal'), false) AS z FROM y)""")
def diagnose_cascade(spark, sf_dir):
    s = scenario_table(spark, sf_dir)
    k, x = F.substring("scenario_id", 2, 20).cast("long"), F.col("call_id")
    node = lambda i: F.concat("root_cause_system", F.lit("::n"), i.cast("string"))
    c = s.withColumn("call_id", F.explode(F.array(*(k * 3 + j for j in range(3))))).select("call_id", "scenario_id", F.when(x % 41 == 0, "").when(x % 37 == 0, "view::zz").otherwise(node(x % 5)).alias("node_id"))
    nodes = spark.createDataFrame([(f"{y}::n{i}",) for y in SYSTEMS for i in range(5)], "node_id string")
    available = s.where(k % 13 != 0).select("scenario_id", F.col("root_cause_system").alias("system_id"))
    o = s.where(k % 7 != 0).select("scenario_id", F.col("root_cause_system").alias("system_id"), F.when(k % 4 == 0, "Normal").when(k % 4 != 1, F.col("fault_type")).alias("label"), node(k % 5).alias("responsible_node"), F.lit(0.7).alias("confidence"))
    i = F.col("i")
    r = s.where(k % 3 == 0).withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("scenario_id", node(i).alias("node_id"), F.when(i == 1, "Fault").when(i == 2, "Normal").otherwise("error").alias("status"), F.when(i == 1, "own_fault").otherwise("None").alias("fault_type"), F.lit(0.8).alias("confidence"))
    p = s.withColumn("i", F.explode(F.array(F.lit(3), F.lit(4)))).select("scenario_id", node(i).alias("node_id"), F.when(i == 3, "Fault").otherwise("Normal").alias("status"), F.when(i == 3, "weak_fault").otherwise("None").alias("fault_type"), F.lit(0.3).alias("confidence"))
    return oracle.diagnose(c, nodes, available, o, r, p, s)


_ANSWERS = """a AS (SELECT scenario_id, CASE substr(scenario_id, 2)::BIGINT % 5 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Warning' ELSE 'Fault' END AS status, CASE substr(scenario_id, 2)::BIGINT % 3 WHEN 0 THEN fault_type WHEN 1 THEN 'oa_bias_4' ELSE 'pump_leak' END AS found FROM s WHERE substr(scenario_id, 2)::BIGINT % 11 <> 0),
z AS (SELECT scenario_id, substr(scenario_id, 2)::BIGINT % 2 AS n_abnormal FROM s WHERE substr(scenario_id, 2)::BIGINT % 17 <> 0)"""
_OUT = """SELECT scenario_id, CASE WHEN scenario_type LIKE '%no_fault%' THEN CASE WHEN n_abnormal IS NULL THEN 'state_fail' WHEN n_abnormal > 0 THEN 'no_fault_false_positive' ELSE 'kept_no_fault' END WHEN status IS NULL THEN 'state_fail' WHEN status = 'Normal' THEN 'fault_miss'
 WHEN found = fault_type THEN 'kept_fault_exact' WHEN found[1:4] = fault_type[1:4] THEN 'fault_type_family_mismatch' ELSE 'fault_type_hard_mismatch' END AS outcome FROM s LEFT JOIN a USING (scenario_id) LEFT JOIN z USING (scenario_id)"""


def _outcomes(spark, sf_dir):
    s = scenario_table(spark, sf_dir)
    k = F.substring("scenario_id", 2, 20).cast("long")
    a = s.where(k % 11 != 0).select("scenario_id", F.when(k % 5 == 0, "Normal").when(k % 5 == 1, "Warning").otherwise("Fault").alias("status"), F.when(k % 3 == 0, F.col("fault_type")).when(k % 3 == 1, "oa_bias_4").otherwise("pump_leak").alias("fault_type"))
    z = s.where(k % 17 != 0).select("scenario_id", (k % 2).alias("n_abnormal"))
    return oracle.recoverable(s, a, z)


@query(f"WITH {_SCEN}, {_ANSWERS} SELECT *, starts_with(outcome, 'kept') AS kept FROM ({_OUT})")
def recoverable_scenarios(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query(f"WITH {_SCEN}, {_ANSWERS} SELECT outcome, count(*) AS n FROM ({_OUT}) GROUP BY 1")
def recovery_counts(spark, sf_dir):
    return oracle.recovery_counts(_outcomes(spark, sf_dir))


@query(f"WITH {_SCEN} SELECT scenario_id, CASE WHEN scenario_type = 'no_fault' AND root_cause_system IN ('view', 'error') THEN 'clean_' || root_cause_system ELSE source_file END AS source_file FROM s")
def no_fault_baseline(spark, sf_dir):
    clean = spark.createDataFrame([("view", "clean_view"), ("view", "clean_z"), ("error", "clean_error")], "system_id string, source_file string")
    return oracle.rebind_baseline(scenario_table(spark, sf_dir), clean).select("scenario_id", "source_file")


@query("""SELECT o_orderkey, CASE WHEN t = '' THEN 'unknown' WHEN t = 'na_cross_system' THEN 'cross_system' ELSE t END AS kind, coalesce(t IN ('cross_system', 'na_cross_system'), false) AS is_cross FROM (SELECT o_orderkey, ['single_system', 'cross_system', 'na_cross_system', 'no_fault', '', 'a_cross_system'][1 + o_orderkey % 6] AS t FROM orders)""")
def scenario_types(spark, sf_dir):
    t = _nth((" Single_System", "cross_system", "NA_cross_system ", "no_fault", "", "a_cross_system"), F.col("o_orderkey") % 6)
    asked = sorted(L.expand_types(["Cross_system"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", L.canonical_type(t).alias("kind"), L.norm(t).isin(*asked).alias("is_cross"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'rtu' WHEN 1 THEN 'sdahu' END AS named, CASE o_orderkey % 4 WHEN 2 THEN 'boiler_plant' WHEN 3 THEN 'chiller_plant' END AS seen FROM orders""")
def prompt_systems(spark, sf_dir):
    text = _nth(("[Rooftop Unit] is warm", " [ Single-Duct AHU ] makes noise", "the Boiler Room is hot, see [Rooftop Unit]", "near the cooling tower area [x"), F.col("o_orderkey") % 4)
    markers = {"cooling tower area": "chiller_plant", "boiler room": "boiler_plant"}
    return table(spark, sf_dir, "orders").select("o_orderkey", L.named_system(text).alias("named"), L.observed_system(text, markers).alias("seen"))


@query(f"""WITH {_SCEN}, t AS (SELECT * FROM (VALUES ('single_system', 40), ('no_fault', 3000), ('cross_system', 0)) v(scenario_type, target)),
p AS (SELECT scenario_id, scenario_type, target, row_number() OVER (PARTITION BY scenario_type ORDER BY md5(scenario_id || '|42'), scenario_id) - 1 AS k, count(*) OVER (PARTITION BY scenario_type) AS n FROM s JOIN t USING (scenario_type))
SELECT scenario_id || '_' || scenario_type || '_' || i AS scenario_id, scenario_type FROM (SELECT *, unnest(range(k, target, n)) AS i FROM p WHERE k < target)""")
def sample_scenarios(spark, sf_dir):
    return scenarios.sample(scenario_table(spark, sf_dir).select("scenario_id", "scenario_type"), {"single_system": 0.01, "no_fault": 0.75, "cross_system": 0.0}, 4000)


def components(spark, systems=SYSTEMS, n=6):
    return spark.createDataFrame([(s, f"{s}::n{k}") for s in systems for k in range(n)], "system_id string, node_id string")


_COMP = "cm AS (SELECT s AS system_id, s || '::n' || k AS node_id FROM (SELECT unnest(['view', 'click', 'error', 'signup', 'purchase']) AS s), (SELECT unnest(range(6)) AS k))"


@query(f"""WITH {_SCEN}, {_COMP}, r AS (SELECT *, row_number() OVER (PARTITION BY system_id ORDER BY md5(node_id || '|42'), node_id) - 1 AS k FROM cm), w AS (SELECT scenario_id, root_cause_system, ('0x' || left(md5(scenario_id || '|42'), 12))::BIGINT AS h FROM s),
q AS (SELECT *, unnest(range(2 + h % 2)) AS t FROM w) SELECT scenario_id, string_agg(node_id, '|' ORDER BY t) AS path FROM q JOIN r ON r.system_id = root_cause_system AND r.k = (h + t) % 6 GROUP BY 1""")
def no_fault_paths(spark, sf_dir):
    p = scenarios.no_fault_paths(scenario_table(spark, sf_dir), components(spark))
    return p.select("scenario_id", F.array_join("path", "|").alias("path"))


_PATH = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE list_transform(range(1 + o_orderkey % 4), lambda k: 'x::n' || k) END"


def _paths(spark, sf_dir):
    k = F.col("o_orderkey")
    path = F.when(k % 5 != 0, F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.concat(F.lit("x::n"), i.cast("string"))))
    return table(spark, sf_dir, "orders").select(k, path.alias("path"))


@query(f"""WITH p AS (SELECT o_orderkey, {_PATH} AS path FROM orders) SELECT o_orderkey, coalesce(path[1], '') AS symptom_node, coalesce(len(path), 0)::INT AS path_length, greatest(coalesce(len(path), 0) - 1, 0)::INT AS n_edges, CASE WHEN len(path) = 1 THEN 'root_cause' WHEN len(path) > 1 THEN 'symptom' END AS first_role, CASE WHEN len(path) = 2 THEN 'root_cause' WHEN len(path) > 2 THEN 'intermediate' END AS second_role FROM p""")
def path_facts(spark, sf_dir):
    p = _paths(spark, sf_dir).withColumn("path", F.coalesce("path", F.array().cast("array<string>")))
    f = scenarios.path_facts(F.col("path"))
    return p.select("o_orderkey", f["symptom_node"].alias("symptom_node"), f["path_length"].alias("path_length"), F.size(f["edges"]).alias("n_edges"), scenarios.node_role(F.col("path"), F.lit("x::n0")).alias("first_role"), scenarios.node_role(F.col("path"), F.lit("x::n1")).alias("second_role"))


@query(f"""WITH {_SCEN}, p AS (SELECT s.*, {_PATH} AS path FROM s JOIN orders ON scenario_id = 's' || o_orderkey)
SELECT scenario_id AS id, 2 AS n_messages, CASE WHEN free THEN 'none' ELSE root_cause_node END AS gt_node, CASE WHEN free THEN 'Normal' ELSE fault_type END AS gt_fault, CASE WHEN path IS NULL THEN 3 ELSE len(path) END::INT AS optimal, CASE WHEN free THEN coalesce(len(path), 0) ELSE 0 END::INT AS n_review, greatest(coalesce(len(path), 0) - 1, 0)::INT AS n_edges,
 root_cause_system || '|' || CASE WHEN free THEN 'none|normal' ELSE root_cause_node || '|' || fault_type END || '|' || source_file AS group_key, sha256('Find it.') AS prompt_sha256 FROM (SELECT *, scenario_type = 'no_fault' AS free FROM p)""")
def training_records(spark, sf_dir):
    s = scenario_table(spark, sf_dir).join(_paths(spark, sf_dir).withColumn("scenario_id", F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))), "scenario_id")
    s = s.withColumns({"fault_intensity": F.lit("50"), "affected_systems": F.array("root_cause_system"), "description": F.lit("?"), "difficulty": F.lit("easy")})
    r = scenarios.training_records(s, "Find it.", "v1")
    t = "ground_truth"
    return r.select("id", F.size("messages").alias("n_messages"), F.col(f"{t}.root_cause_node").alias("gt_node"), F.col(f"{t}.fault_type").alias("gt_fault"), F.col(f"{t}.optimal_path_length").alias("optimal"), F.size(f"{t}.reference_review_nodes").alias("n_review"), F.size(f"{t}.reference_propagation_edges").alias("n_edges"), F.col("metadata.split_group_key").alias("group_key"), F.col("metadata.system_prompt_sha256").alias("prompt_sha256"))


@query(f"""WITH {BASE}, f AS (SELECT episode_id, count(*) AS n, count(*) FILTER (c.node_id = coalesce(diag_node, '')) AS own, count(*) FILTER (c.node_id = coalesce(diag_node, '') AND c.fault_type IS DISTINCT FROM diag_fault) AS against FROM calls c JOIN eps USING (episode_id) WHERE tool = 'diagnose_node' AND status = 'fault' GROUP BY 1),
g AS (SELECT episode_id AS scenario_id, said AND CASE WHEN clean THEN diag_node = 'none' AND diag_fault = 'no_fault' ELSE gt_node = diag_node AND gt_fault = diag_fault END AS label, said AND CASE WHEN coalesce(n, 0) = 0 THEN true WHEN clean OR against > 0 THEN false ELSE own > 0 END AS faithful, said AND (clean OR coalesce(diag_confidence, 0) >= 0.6) AS sure FROM eps LEFT JOIN f USING (episode_id))
SELECT scenario_id, label AND sure AS label_consistent, faithful AS tool_faithful, sure AS confidence_supported, label AND sure AND faithful AS admitted FROM g""")
def trajectory_gates(spark, sf_dir):
    eps, calls = world(spark, sf_dir)
    truth = eps.select(F.col("episode_id").alias("scenario_id"), "scenario_type", F.col("gt_node").alias("root_cause_node"), F.col("gt_fault").alias("fault_type"))
    final = eps.select(F.col("episode_id").alias("scenario_id"), F.col("diag_node").alias("node"), F.col("diag_fault").alias("fault"), F.col("diag_confidence").alias("confidence"), F.lit(None).cast("string").alias("status"))
    return trajectories.gates(final, truth, calls.withColumnRenamed("episode_id", "scenario_id"))


def flow_scenarios(spark, sf_dir):
    """Scenarios of all flows with paths within and between systems."""
    s = scenario_table(spark, sf_dir)
    k = F.substring("scenario_id", 2, 20).cast("long")
    start = F.when(F.col("scenario_type").isin("cross_system", "na_cross_system"), _nth(SYSTEMS[1:] + SYSTEMS[:1], F.pmod(k, F.lit(5)))).otherwise(F.col("root_cause_system"))
    start = F.when(start == F.col("root_cause_system"), F.col("root_cause_system")).otherwise(start)
    path = F.array_distinct(F.array(F.concat(start, F.lit("::n5")), F.col("root_cause_node")))
    return s.withColumns({"symptom_system": start, "path": path, "description": F.concat(F.lit("Something is wrong near "), start)})


def flow_graph(spark):
    """nodes and edges of the systems: each feeds its components in a row, its last one the fifth of the next system; every component has a sensor."""
    c = components(spark)
    at, after = F.element_at(F.split("node_id", "::n"), -1).cast("int"), F.create_map(*(F.lit(x) for s, t in zip(SYSTEMS, SYSTEMS[1:] + SYSTEMS[:1]) for x in (s, t)))
    name = F.element_at(F.split("node_id", "::"), -1)
    row = lambda df, node, level, kind, label: df.select(node.alias("node_id"), F.lit(level).alias("level"), F.lit(kind).alias("node_type"), "system_id", label.alias("name"))
    top, sensor = F.concat(F.lit("system::"), F.col("system_id")), F.concat("node_id", F.lit("::t"))
    nodes = row(c.select("system_id").distinct(), top, 1, "system", F.col("system_id")).unionByName(row(c, F.col("node_id"), 2, "component", name)).unionByName(row(c, sensor, 3, "sensor", F.lit("t")))
    edge = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("relation"), F.lit("").alias("medium"), F.lit(0).cast("long").alias("seq"))
    nth = lambda system, k: F.concat(system, F.lit("::n"), k.cast("string"))
    edges = edge(c, top, F.col("node_id"), "has_part").unionByName(edge(c, F.col("node_id"), sensor, "has_sensor")).unionByName(edge(c.where(at < 5), F.col("node_id"), nth(F.col("system_id"), at + 1), "feeds"))
    return nodes, edges.unionByName(edge(c.where(at == 5), F.col("node_id"), nth(after[F.col("system_id")], F.lit(4)), "cross_system"))


@query("""WITH RECURSIVE e AS (SELECT s || '::n' || (k + 1) AS here, s || '::n' || k AS up FROM (SELECT unnest(['view', 'click', 'error', 'signup', 'purchase']) AS s), (SELECT unnest(range(5)) AS k)
 UNION ALL SELECT t || '::n4', s || '::n5' FROM (SELECT unnest(['view', 'click', 'error', 'signup', 'purchase']) AS s, unnest(['click', 'error', 'signup', 'purchase', 'view']) AS t)),
p AS (SELECT DISTINCT ['view', 'click', 'error', 'signup', 'purchase'][1 + o_orderkey % 5] || '::n5' AS symptom, ['view', 'click', 'error', 'signup', 'purchase'][1 + o_custkey % 5] || '::n' || (o_orderkey % 4) AS root FROM orders),
w AS (SELECT symptom, root, symptom AS here, [symptom] AS trace FROM p UNION ALL SELECT symptom, root, up, list_append(trace, up) FROM w JOIN e USING (here) WHERE here <> root AND len(trace) < 7 AND NOT list_contains(trace, up)),
f AS (SELECT *, row_number() OVER (PARTITION BY symptom, root ORDER BY len(trace), trace) AS k FROM w WHERE here = root) SELECT symptom, root, array_to_string(trace, ' ') AS trace FROM f WHERE k = 1""")
def trace_paths(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pairs = o.select(F.concat(_nth(SYSTEMS, F.col("o_orderkey") % 5), F.lit("::n5")).alias("symptom"), F.concat(_nth(SYSTEMS, F.col("o_custkey") % 5), F.lit("::n"), (F.col("o_orderkey") % 4).cast("string")).alias("root"))
    return trajectories.traces(flow_graph(spark)[1], pairs).withColumn("trace", F.concat_ws(" ", "trace"))


@query()
def trajectory_plan(spark, sf_dir):
    s, graph = flow_scenarios(spark, sf_dir), flow_graph(spark)
    return trajectories.calls_of_all(s, *graph, list(SYSTEMS)).withColumn("targets", F.concat_ws(" ", "targets"))


@query()
def trajectory_turns(spark, sf_dir):
    return trajectories.batch(flow_scenarios(spark, sf_dir), *flow_graph(spark), list(SYSTEMS)).turns()


#: Every scenario has one admitted dialogue that breaks none of the validators' rules; SQL knows so from the scenarios alone.
@query("SELECT count(*) AS dialogues, 0::BIGINT AS broken_rules, 0::BIGINT AS skipped_steps, 0::BIGINT AS wrong_conclusions FROM orders")
def trajectory_checks(spark, sf_dir):
    s, graph = flow_scenarios(spark, sf_dir), flow_graph(spark)
    b = trajectories.batch(s, *graph, list(SYSTEMS))
    # the validators read each distinct dialogue once and count it for all scenarios that have it; conclusions meet the truth of every scenario
    turns = b.talks.withColumnRenamed("scenario_id", "conv_id")
    n = b.makes.firsts().select(F.col("scenario_id").alias("conv_id"), "n_")
    rules = transcripts.turn_errors(turns, graph[0])
    names = [c for c in rules.columns if c not in ("conv_id", "turn")]
    broken = rules.join(n, "conv_id").agg(F.coalesce(F.sum(sum(F.col(c).cast("long") for c in names) * F.col("n_")), F.lit(0)).alias("broken_rules"))
    calls = b.outcome.select(F.col("scenario_id").alias("conv_id"), F.col("i").alias("turn"), "tool", "node_id", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
    skipped = transcripts.skipped_steps(calls).join(n, "conv_id").agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("skipped_steps"))
    last = transcripts.final_diagnosis(turns).select(F.col("conv_id").alias("scenario_id"), F.col("root_cause_node").alias("said_node"), F.col("fault_type").alias("said_fault"))
    said = b.makes.spread(last, "scenario_type", "root_cause_node", "fault_type")
    node = F.when(F.col("scenario_type") == "no_fault", "none").otherwise(F.col("root_cause_node"))
    wrong = said.agg(F.count("*").alias("dialogues"), F.count_if(transcripts.wrong_conclusion(node, F.col("fault_type"), F.col("said_node"), F.col("said_fault"))).alias("wrong_conclusions"))
    one = lambda df: df.withColumn("one_", F.lit(1))  # noqa: E731  three single rows side by side
    return one(wrong).join(one(broken), "one_").join(one(skipped), "one_").drop("one_")


@query("""WITH p AS (SELECT 's' || o_custkey AS scenario_id, 'n' || (o_orderkey % 4) AS connected_via, 't' || (o_orderkey % 3) AS target_component, 'n' || (o_custkey % 4) AS wanted_via, 't' || (o_custkey % 3) AS wanted_component FROM orders WHERE o_orderkey % 5 = o_custkey % 5)
SELECT scenario_id, connected_via, target_component, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY score DESC, target_component DESC, connected_via DESC) AS k FROM (SELECT *, 4 * (target_component = wanted_component)::INT + 2 * (connected_via = wanted_via)::INT + 1 AS score FROM p)) WHERE k = 1""")
def best_anchor(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    conn = table(spark, sf_dir, "orders").select(name("s", c).alias("scenario_id"), name("y", k % 5).alias("other_system"), name("y", c % 5).alias("wanted_system"), name("t", k % 3).alias("target_component"), name("t", c % 3).alias("wanted_component"), name("n", k % 4).alias("connected_via"), name("n", c % 4).alias("wanted_via"))
    return oracle.best_anchor(conn)


@query("""WITH l AS (SELECT DISTINCT 'supplier::' || l_suppkey AS src, 'x' || l_suppkey % 3 AS src_system, 'part::' || l_partkey AS dst, 'y' || l_partkey % 4 AS dst_system FROM lineitem), s AS (SELECT 's' || s_suppkey AS scenario_id, 'y' || s_suppkey % 4 AS d, 'x' || s_suppkey % 3 AS r, 'supplier::' || s_suppkey AS root FROM supplier)
SELECT scenario_id, coalesce(min(dst) FILTER (src = root), min(dst)) AS target FROM s JOIN l ON src_system = r AND dst_system = d GROUP BY 1""")
def connected_target(spark, sf_dir):
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    links = table(spark, sf_dir, "lineitem").select(name("supplier::", F.col("l_suppkey")).alias("src"), name("x", F.col("l_suppkey") % 3).alias("src_system"), name("part::", F.col("l_partkey")).alias("dst"), name("y", F.col("l_partkey") % 4).alias("dst_system"))
    s = table(spark, sf_dir, "supplier").select(name("s", F.col("s_suppkey")).alias("scenario_id"), name("y", F.col("s_suppkey") % 4).alias("downstream_system"), name("x", F.col("s_suppkey") % 3).alias("root_system"), name("supplier::", F.col("s_suppkey")).alias("root_node"))
    return oracle.connected_target(s, links)


@query(_PRED + """, k AS (SELECT label FROM q UNION SELECT predicted FROM q), c AS (SELECT k.label, count(*) FILTER (q.label = k.label AND predicted = k.label) AS tp, count(*) FILTER (predicted = k.label) AS pr, count(*) FILTER (q.label = k.label) AS su FROM k, q GROUP BY 1),
m AS (SELECT CASE WHEN pr > 0 THEN tp::DOUBLE / pr ELSE 0 END AS p, CASE WHEN su > 0 THEN tp::DOUBLE / su ELSE 0 END AS r, su FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)
SELECT round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * su) / sum(su), 6) AS weighted_precision, round(sum(r * su) / sum(su), 6) AS weighted_recall, round(sum(f * su) / sum(su), 6) AS weighted_f1, round(sum(r * su) / sum(su), 6) AS accuracy FROM f""")
def report_averages(spark, sf_dir):
    r = statistics.report_averages(statistics.classification_report(_predictions(spark, sf_dir), "label", "predicted"))
    return rounded(r, *r.columns)


@query("""SELECT p_partkey, '{"a":"' || p_size || '","b":"x","c":"' || p_brand || '"}' AS key FROM part""")
def canonical_json(spark, sf_dir):
    body = F.concat(F.lit('{"c": "'), F.col("p_brand"), F.lit('",  "b": "x", "a": '), F.col("p_size").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", L.canonical_json(body).alias("key"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'hot water low|hot deck' WHEN o_orderkey % 3 = 1 THEN 'cold deck' ELSE 'hot water low|cold deck|hot deck|noise' END AS kept FROM orders")
def mode_templates(spark, sf_dir):
    all_ = F.array(*map(F.lit, ("hot water low", "cold deck", "hot deck", "noise")))
    mode = _nth(("hot", "cold", "steam"), F.col("o_orderkey") % 3)
    return table(spark, sf_dir, "orders").withColumn("m_", mode).select("o_orderkey", F.array_join(L.or_all(all_, lambda t: F.contains(t, F.col("m_"))), "|").alias("kept"))


@query(f"WITH {BASE} SELECT episode_id, bool_or({BAD}) AS any_abnormal, bool_or(tool = 'get_upstream_nodes') AS traced FROM calls GROUP BY 1 HAVING bool_or({BAD})")
def episodes_with_findings(spark, sf_dir):
    c = world(spark, sf_dir)[1]
    g = c.groupBy("episode_id").agg(F.max(F.col("status").isin(*oracle.ABNORMAL)).alias("any_abnormal"), F.max(F.col("tool") == "get_upstream_nodes").alias("traced"))
    return g.where("any_abnormal")
