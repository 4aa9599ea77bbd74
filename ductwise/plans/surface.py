"""Registered queries on expressions and small operators: distributions, trust, teacher rules, readings, globs, pairs, environment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import maths as M
from ..operators import evidence, graph, matching, models, scenarios, tools, trajectories, transcripts
from .catalog import _NODES, _PARTS, observations
from .registry import query, rounded, table
from .training import BASE, world


def _pick(values, k):
    return F.get(F.array(*map(F.lit, values)), k.cast("int"))


# --- distributions and trust -----------------------------------------------------------------------------------------
_DIST = "e AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: abs(v::DOUBLE)) AS a, list_transform(embedding[5:8], lambda v: abs(v::DOUBLE)) AS b FROM embeddings), d AS (SELECT vec_id, list_transform(a, lambda v: v / list_sum(a)) AS p, list_transform(b, lambda v: v / list_sum(b)) AS q FROM e)"


def _distributions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *(F.transform(F.slice("embedding", i, 4), lambda v: F.abs(v.cast("double"))).alias(n) for n, i in (("a", 1), ("b", 5))))
    names = F.array(*map(F.lit, "wxyz"))
    part = lambda c: F.map_from_arrays(names, F.transform(c, lambda v: v / M.total(F.col(c))))
    return e.select("vec_id", part("a").alias("p"), part("b").alias("q"))


@query(f"WITH {_DIST} SELECT vec_id, round(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) / ln(4), 6) AS entropy FROM d")
def entropy(spark, sf_dir):
    return _distributions(spark, sf_dir).select("vec_id", F.round(M.entropy(F.col("p")), 6).alias("entropy"))


@query(f"WITH {_DIST} SELECT vec_id, round(list_sum(list_transform(range(1, 5), lambda i: (CASE WHEN p[i] > 0 THEN p[i] * ln(2 * p[i] / (p[i] + q[i])) ELSE 0 END + CASE WHEN q[i] > 0 THEN q[i] * ln(2 * q[i] / (p[i] + q[i])) ELSE 0 END) / 2)), 6) AS js FROM d")
def js_divergence(spark, sf_dir):
    return _distributions(spark, sf_dir).select("vec_id", F.round(M.js_divergence(F.col("p"), F.col("q")), 6).alias("js"))


_SOURCES = ("system_oracle", "per_node_responsibility", "per_node", None)
_STATES = (None, "weak_fallback_model", "clean_baseline_false_positive_guard", "data_unavailable_for_system")


@query("""WITH o AS (SELECT event_id, ['fault', 'normal', 'warning', 'error', 'unknown'][1 + event_id % 5] AS s, event_id % 7 <> 0 AS node, CASE WHEN event_id % 11 <> 0 THEN (event_id % 7) / 7.0::DOUBLE END AS c, ['system_oracle', 'per_node_responsibility', 'per_node', NULL][1 + event_id % 4] AS src, [NULL, 'weak_fallback_model', 'clean_baseline_false_positive_guard', 'data_unavailable_for_system'][1 + (event_id // 4) % 4] AS cal, CASE WHEN event_id % 3 <> 0 THEN (event_id % 10) / 10.0::DOUBLE END AS cov FROM events),
b AS (SELECT *, CASE src WHEN 'system_oracle' THEN 0.90::DOUBLE WHEN 'per_node_responsibility' THEN 0.72 WHEN 'per_node' THEN 0.28 ELSE CASE WHEN node THEN 0.40 ELSE 0.15 END END AS base FROM o),
k AS (SELECT *, CASE cal WHEN 'weak_fallback_model' THEN least(base, 0.25) WHEN 'clean_baseline_false_positive_guard' THEN CASE WHEN s = 'normal' THEN 0.95 ELSE 0.05 END ELSE base END * coalesce(least(greatest(cov / 0.75, 0), 1), 1) AS x FROM b)
SELECT event_id, CASE WHEN s IN ('error', 'unknown') OR cal = 'data_unavailable_for_system' THEN 0 ELSE round(least(1, x * (0.35 + 0.65 * least(1, greatest(0, coalesce(c, 0.5))))), 4) END::DOUBLE AS trust FROM k""")
def observation_trust(spark, sf_dir):
    x = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        x, _pick(("fault", "normal", "warning", "error", "unknown"), x % 5).alias("s"), F.when(x % 7 != 0, "a::n").alias("node"), F.when(x % 11 != 0, (x % 7) / 7.0).alias("c"),
        _pick(_SOURCES, x % 4).alias("src"), _pick(_STATES, F.floor(x / 4) % 4).alias("cal"), F.when(x % 3 != 0, (x % 10) / 10.0).alias("cov"),
    )
    got = M.reliability(F.col("s"), F.col("node"), F.col("c"), F.col("src"), F.col("cal"), F.col("cov"))
    return e.select("event_id", got.alias("trust"))


@query("""WITH o AS (SELECT user_id AS episode_id, event_type, count(*) AS n, sum(CASE event_type WHEN 'error' THEN 1.0 WHEN 'signup' THEN 0.72 WHEN 'purchase' THEN 0.55 ELSE 0 END) AS s FROM events GROUP BY 1, 2)
SELECT episode_id, sum(n)::BIGINT AS n, round(sum(s), 6)::DOUBLE AS mass FROM o GROUP BY 1""")
def polarity_mass(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("p", M.polarity(F.col("status"), F.lit(1.0)))
    return rounded(o.groupBy("episode_id").agg(F.count("*").alias("n"), F.sum(F.greatest("p", F.lit(0.0))).alias("mass")), "mass")


@query("""WITH e AS (SELECT user_id, event_id % 3 AS k, sum(value) / 100 AS score FROM events GROUP BY 1, 2), b AS (SELECT user_id, k, exp(score - max(score) OVER (PARTITION BY user_id)) AS w FROM e WHERE score > 0),
p AS (SELECT user_id, w / sum(w) OVER (PARTITION BY user_id) AS belief FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY belief DESC) AS k FROM p)
SELECT user_id, round(max(belief) - coalesce(max(belief) FILTER (k = 2), 0), 6) AS gap FROM r GROUP BY 1""")
def belief_gap(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 3).alias("k")).agg((F.sum("value") / 100).alias("score"))
    return rounded(evidence.gap(evidence.belief(s, "user_id"), "user_id"), "gap")


@query("""WITH o AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'n' || event_id % 5 END AS node, ['fault', 'success', 'unknown'][1 + event_id % 3] AS status, event_id % 2 AS a, event_id % 3 AS b FROM events),
f AS (SELECT event_id, node, status FROM o WHERE node <> '' OR status IN ('fault', 'unknown') UNION ALL SELECT event_id, 's' || unnest(range(a)), 'normal' FROM o UNION ALL SELECT event_id, 'c' || unnest(range(b)), 'warning' FROM o)
SELECT event_id, count(*) AS n, count(*) FILTER (status = 'warning') AS n_warning, count(*) FILTER (status = 'normal') AS n_normal FROM f GROUP BY 1""")
def flattened_results(spark, sf_dir):
    x = F.col("event_id")
    entry = lambda p, n, status: F.transform(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat(F.lit(p), i.cast("string")).alias("node_id"), F.lit(status).alias("status")))
    r = table(spark, sf_dir, "events").select(x, F.when(x % 4 == 0, "").otherwise(F.concat(F.lit("n"), (x % 5).cast("string"))).alias("node_id"), _pick(("fault", "success", "unknown"), x % 3).alias("status"), entry("s", x % 2, "normal").alias("node_statuses"), F.concat(entry("c", x % 3, "warning"), entry("s", x % 2, "normal")).alias("candidate_nodes"))
    f = evidence.flatten_results(r, ["event_id"])
    return f.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "warning").alias("n_warning"), F.count_if(F.col("status") == "normal").alias("n_normal"))


# --- teacher rules and readings --------------------------------------------------------------------------------------
@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Normal' WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 5 = 0 THEN 'Warning' ELSE 'Fault' END ELSE 'Abnormal' END AS status, CASE WHEN event_id % 3 = 0 THEN 0.90 WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 5 = 0 THEN 0.60 ELSE 0.93 END ELSE 0.78 END::DOUBLE AS confidence FROM events""")
def teacher_rules(spark, sf_dir):
    x = F.col("event_id")
    t = tools.teacher_route(x % 3 != 0, x % 2 == 0, x % 5 == 0)
    return table(spark, sf_dir, "events").select("event_id", t["status"].alias("status"), t["confidence"].alias("confidence"))


@query("""WITH e AS (SELECT event_id, ['Fault', 'Normal', 'Warning', 'Abnormal'][1 + event_id % 4] AS s, floor(value / 50) / 10 AS c, event_id % 3 = 0 AS root, event_id % 5 = 0 AS clean, event_id % 7 = 0 AS low FROM events),
a AS (SELECT event_id, root, CASE WHEN clean THEN greatest(c, 0.85) ELSE c END AS c, CASE WHEN clean AND s <> 'Normal' THEN 'Normal' WHEN low THEN 'Warning' ELSE s END AS s, low FROM e), b AS (SELECT event_id, root, CASE WHEN low THEN 0.48 ELSE c END AS c, s FROM a)
SELECT event_id, CASE WHEN s = 'Fault' AND NOT root THEN 'Abnormal' ELSE s END AS status, CASE WHEN s = 'Fault' AND NOT root THEN least(c, 0.68) ELSE c END::DOUBLE AS confidence FROM b""")
def teacher_guards(spark, sf_dir):
    x = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(x, _pick(("Fault", "Normal", "Warning", "Abnormal"), x % 4).alias("status"), (F.floor(F.col("value") / 50) / 10).alias("confidence"), (x % 3 == 0).alias("is_root"), (x % 5 == 0).alias("clean_baseline"), (x % 7 == 0).alias("low_confidence_root"))
    return tools.guards(rows).select("event_id", "status", "confidence")


@query("""SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN c ELSE greatest(0.01, 1 - c) END, 6) AS normal, CASE WHEN event_id % 3 <> 0 THEN round(c, 6) END AS named FROM (SELECT event_id, floor(value / 50) / 10 AS c FROM events)""")
def compact_probabilities(spark, sf_dir):
    x, c = F.col("event_id"), F.floor(F.col("value") / 50) / 10
    p = tools.compact_probabilities(F.when(x % 3 == 0, "Normal").otherwise("fan"), c)
    return table(spark, sf_dir, "events").select("event_id", F.round(p["Normal"], 6).alias("normal"), F.round(F.try_element_at(p, F.lit("fan")), 6).alias("named"))


@query("""WITH r AS (SELECT event_id, value AS dry, value + (event_id % 5) - 2 AS wet, value - 100 AS flow FROM events) SELECT event_id, round(CASE WHEN wet > dry THEN dry - 2 ELSE wet END, 6) AS wet, round(greatest(flow, 0), 6) AS flow FROM r""")
def guarded_readings(spark, sf_dir):
    v = F.col("value").cast("double")
    m = models.guarded_readings(F.create_map(F.lit("OA_TEMP"), v, F.lit("OA_TEMP_WB"), v + (F.col("event_id") % 5) - 2, F.lit("SA_CFM"), v - 100))
    return table(spark, sf_dir, "events").select("event_id", F.round(m["OA_TEMP_WB"], 6).alias("wet"), F.round(m["SA_CFM"], 6).alias("flow"))


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS a, CASE WHEN event_id % 3 = 0 THEN value END AS b FROM events) SELECT event_id, round(coalesce(a, 0), 6) AS f0, round(coalesce(b, 0), 6) AS f1, round(((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1) / 3.0::DOUBLE, 6) AS coverage, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 >= 2 AS usable FROM r""")
def features_from_readings(spark, sf_dir):
    x, v = F.col("event_id"), F.col("value").cast("double")
    entries = F.array(F.struct(F.lit("a").alias("k"), F.when(x % 2 == 0, v).alias("v")), F.struct(F.lit("b_mean").alias("k"), F.when(x % 3 == 0, v).alias("v")), F.struct(F.lit("c").alias("k"), F.lit(1.0).alias("v")))
    got = models.from_readings(F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())), ["a_max", "b_mean", "c_std"])
    return table(spark, sf_dir, "events").select("event_id", F.round(got["features"][0], 6).alias("f0"), F.round(got["features"][1], 6).alias("f1"), F.round(got["coverage"], 6).alias("coverage"), got["usable"].alias("usable"))


@query("""WITH z AS (SELECT vec_id, list_transform(embedding[1:3], lambda v: exp(v::DOUBLE)) AS w FROM embeddings), p AS (SELECT vec_id, list_transform(w, lambda v: v / list_sum(w)) AS p FROM z), q AS (SELECT vec_id, p, list_transform(p, lambda v: pow(v, 1 / 1.5::DOUBLE)) AS t FROM p)
SELECT vec_id, CASE WHEN p[1] >= greatest(p[2], p[3]) THEN 'Normal' ELSE 'Fault' END AS status, CASE WHEN p[1] >= greatest(p[2], p[3]) THEN 'None' WHEN p[2] >= p[3] THEN 'fan' ELSE 'pump' END AS fault_type, round(list_max(t) / list_sum(t), 4) AS confidence FROM q""")
def calibrated_verdicts(spark, sf_dir):
    p = M.softmax(F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double")))
    v = models.verdict(models.calibrated(p, 1.5), ["Normal", "fan", "pump"])
    return table(spark, sf_dir, "embeddings").select("vec_id", v["status"].alias("status"), v["fault_type"].alias("fault_type"), v["confidence"].alias("confidence"))


# --- joins and paths -------------------------------------------------------------------------------------------------
@query("SELECT tile_idx, event_id FROM (SELECT unnest(range(100)) AS tile_idx) JOIN (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events ORDER BY event_id LIMIT 7) ON k = tile_idx % 7")
def modular_tile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id").orderBy("event_id").limit(7)  # a short baseline is the feature
    first = [(i, r.event_id) for i, r in enumerate(e.collect())]
    base = spark.createDataFrame(first, "k long, event_id long")
    return matching.modular_tile(base, "k", 100, 7).select("tile_idx", "event_id")


_GLOBS = ("*A*", "Supplier#00000000?", "CANADA", "*zzz*", "customer#0000000*", "M?*O")


@query(f"""WITH p AS (SELECT unnest({list(_GLOBS)}) AS pattern), n AS ({_NODES}), h AS (SELECT pattern, node_id, CASE WHEN regexp_matches(name, '^' || replace(replace(pattern, '*', '.*'), '?', '.') || '$') THEN 0 WHEN regexp_replace(pattern, '[*?]', '', 'g') <> '' AND contains(lower(name), lower(regexp_replace(pattern, '[*?]', '', 'g'))) THEN 1 END AS k FROM p, n)
SELECT pattern, arg_min(node_id, k || node_id) AS node_id, min(k)::INT AS kind FROM h WHERE k IS NOT NULL GROUP BY 1""")
def globs_to_nodes(spark, sf_dir):
    nodes, _ = graph.order_graph(spark, sf_dir)
    return matching.resolve_globs(spark.createDataFrame([(g,) for g in _GLOBS], "pattern string"), nodes)


@query(f"""WITH c AS (SELECT system_id, node_id, name, row_number() OVER (PARTITION BY system_id ORDER BY node_id) AS rank FROM ({_NODES}) WHERE system_id IN ('nation', 'region')), f AS (SELECT s AS system_id, t AS fault FROM (VALUES ('nation', 'canada_leak'), ('nation', 'CHINA_stuck'), ('region', 'asia_x_america'), ('region', 'none')) v(s, t)),
k AS (SELECT * FROM (VALUES ('canada', 'canada', 1), ('china', 'hin', 2), ('america', 'america', 1), ('asia', 'asia', 2)) v(keyword, part, rank)),
h AS (SELECT f.system_id, fault, node_id, row_number() OVER (PARTITION BY f.system_id, fault ORDER BY k.rank, CASE WHEN lower(name) = part THEN 0 ELSE 1 END, c.rank, node_id) AS r FROM f JOIN k ON contains(lower(fault), keyword) JOIN c ON c.system_id = f.system_id AND contains(lower(name), part))
SELECT f.system_id, f.fault, coalesce(h.node_id, c.node_id) AS node_id FROM f LEFT JOIN h ON h.system_id = f.system_id AND h.fault = f.fault AND r = 1 JOIN c ON c.system_id = f.system_id AND c.rank = 1""")
def fault_components(spark, sf_dir):
    nodes, _ = graph.order_graph(spark, sf_dir)
    own = nodes.where("system_id IN ('nation', 'region')")
    from pyspark.sql import Window

    parts = own.select("system_id", "node_id", "name", F.row_number().over(Window.partitionBy("system_id").orderBy("node_id")).alias("rank"))
    faults = spark.createDataFrame([("nation", "canada_leak"), ("nation", "CHINA_stuck"), ("region", "asia_x_america"), ("region", "none")], "system_id string, fault string")
    words = spark.createDataFrame([("canada", "canada", 1), ("china", "hin", 2), ("america", "america", 1), ("asia", "asia", 2)], "keyword string, part string, rank int")
    return matching.keyword_component(faults, parts, words)


@query(f"""WITH p AS ({_PARTS}), s AS (SELECT 'supplier::' || s_suppkey AS node_id, 'nation::' || s_nationkey AS parent FROM supplier), a AS (SELECT s.node_id, parent, src AS top FROM s JOIN p ON p.dst = parent)
SELECT node_id, top AS ask, 0 AS step FROM a UNION ALL SELECT node_id, parent, 1 FROM a""")
def discovery_steps(spark, sf_dir):
    nodes, edges = graph.order_graph(spark, sf_dir)
    seen = nodes.where("level = 0").select("node_id")
    return trajectories.discovery(edges, nodes.where("system_id = 'supplier'").select("node_id"), seen).select("node_id", "ask", "step")


@query("""SELECT o_orderkey, n + 1 AS n_steps, CASE WHEN n <= 5 THEN n + 1 ELSE 2 + least(4, ceil((n - 1) / ceil((n - 1) / 4.0)))::BIGINT END AS n_kept FROM (SELECT o_orderkey, o_orderkey % 12 AS n FROM orders)""")
def thinned_paths(spark, sf_dir):
    k = F.col("o_orderkey") % 12
    steps = F.transform(F.sequence(F.lit(0), k), lambda i: F.concat(F.lit("x::n"), i.cast("string")))
    path = scenarios.diagnostic_path(steps, F.concat(F.lit("x::n"), k.cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(steps).cast("long").alias("n_steps"), F.size(path).cast("long").alias("n_kept"))


# --- environment and prompts -----------------------------------------------------------------------------------------
_ACT = "CASE WHEN step % 13 = 0 THEN '<think>x</think><diagnosis>{{\"a\": 1}}</diagnosis>' WHEN step % 3 = 0 THEN 'only text' ELSE '<tool_call>{{\"name\": \"' || tool || '\"}}</tool_call>' END".replace("{{", "{").replace("}}", "}")


@query(f"""WITH {BASE}, a AS (SELECT episode_id, i, {_ACT} AS text FROM calls), k AS (SELECT episode_id, i, CASE WHEN contains(text, '<diagnosis>') THEN 'diagnosis' WHEN contains(text, '<tool_call>') THEN 'tool' ELSE 'text' END AS kind FROM a),
c AS (SELECT *, sum((kind = 'tool')::INT) OVER w AS nt, sum((kind = 'text')::INT) OVER w AS nx, sum((kind = 'diagnosis')::INT) OVER w AS nd FROM k WINDOW w AS (PARTITION BY episode_id ORDER BY i)),
e AS (SELECT *, nd > 0 OR nt >= 3 OR nx >= 2 AS ended, coalesce(lag(nd > 0 OR nt >= 3 OR nx >= 2) OVER (PARTITION BY episode_id ORDER BY i), false) AS before FROM c)
SELECT episode_id, i AS turn, kind, ended AS done, CASE WHEN NOT ended THEN '' WHEN nd > 0 THEN 'diagnosis' WHEN nt >= 3 THEN 'max_calls' ELSE 'text_only' END AS reason FROM e WHERE NOT before""")
def environment_steps(spark, sf_dir):
    c = world(spark, sf_dir)[1]
    return transcripts.environment(c.select("episode_id", F.col("i").alias("turn"), F.expr(_ACT).alias("text")), max_calls=3, max_texts=2)


@query("""SELECT doc_id, regexp_matches(text, '^\\s*\\[[^\\]]+\\]') OR contains(lower(text), 'chiller') OR contains(lower(text), ' the ') AS leaks FROM documents WHERE text IS NOT NULL""")
def prompt_leaks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", scenarios.leaks(F.col("text"), ["chiller", " the "]).alias("leaks"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'normal' WHEN p_partkey % 5 = 1 THEN 'coolingtower_bias' WHEN p_partkey % 5 = 2 THEN 'boiler' ELSE 'bypass_stuck' END AS fault_type, CASE WHEN p_partkey % 5 = 0 THEN 'none' WHEN p_partkey % 5 = 1 THEN (p_size - 25)::VARCHAR WHEN p_partkey % 5 = 2 THEN 'PI' ELSE p_size::VARCHAR END AS intensity, p_partkey % 5 = 0 AS free FROM part""")
def file_names(spark, sf_dir):
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    name = F.when(k == 0, "ChillerPlant.csv").when(k == 1, F.concat(F.lit("ChillerPlant_coolingtower_bias_"), (size - 25).cast("string"), F.lit(".csv"))).when(k == 2, "ChillerPlant_boiler_PI.csv").otherwise(F.concat(F.lit("ChillerPlant_bypass_stuck_"), size.cast("string"), F.lit(".csv")))
    f = L.parse_file_name("chiller_plant", name)
    return table(spark, sf_dir, "part").select("p_partkey", f["fault_type"].alias("fault_type"), f["fault_intensity"].alias("intensity"), f["is_fault_free"].alias("free"))


@query("""WITH p AS (SELECT 'supplier::' || min(s_suppkey) AS src, s_nationkey AS n FROM supplier GROUP BY 2), c AS (SELECT 'customer::' || min(c_custkey) AS dst, c_nationkey AS n FROM customer GROUP BY 2), x AS (SELECT src, dst FROM p JOIN c USING (n))
SELECT 'supplier' AS system_id, 'downstream' AS direction, 'customer' AS other_system, src AS connected_via, dst AS target_component FROM x UNION ALL SELECT 'customer', 'upstream', 'supplier', src, dst FROM x""")
def related_systems(spark, sf_dir):
    from .catalog import tool_world

    nodes, edges, _ = tool_world(spark, sf_dir)
    return graph.related_systems(nodes, edges).drop("medium")


@query("""SELECT event_id, CASE WHEN n = 0 THEN 'no readings' ELSE s END AS evidence FROM (SELECT event_id, (event_id % 4 <> 0)::INT + (event_id % 3 <> 0)::INT AS n, concat_ws(', ', CASE WHEN event_id % 3 <> 0 THEN 'SA_TEMP = ' || round(value, 1) END, CASE WHEN event_id % 4 <> 0 THEN 'FAN = ' || round(value / 2 + 1, 1) END) AS s FROM (SELECT event_id, floor(value) AS value FROM events))""")
def sensor_evidence(spark, sf_dir):
    x, v = F.col("event_id"), F.floor("value").cast("double")
    entries = F.array(F.struct(F.lit("FAN").alias("k"), F.when(x % 4 != 0, v / 2 + 1).alias("v")), F.struct(F.lit("SA_TEMP").alias("k"), F.when(x % 3 != 0, v).alias("v")), F.struct(F.lit("OA_TEMP").alias("k"), v.alias("v")))
    readings = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
    return table(spark, sf_dir, "events").select("event_id", scenarios.sensor_evidence(readings, ["SA_TEMP"], 3).alias("evidence"))
