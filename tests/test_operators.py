import math
import random

import pytest
from pyspark.sql import functions as F

from ductwise.functions import labels as L
from ductwise.functions import maths as M
from ductwise.operators import datasets, graph, matching, metrics, potential, statistics, tools
from ductwise.operators import windows as W
from ductwise.sources import readers
from ductwise.streaming import windows as S


def value(spark, column, **row):
    names = list(row)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'double' if isinstance(row[n], float) else 'string'}" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("OA bias -4", "oa_bias_neg_4"), ("oa_bias_+4", "oa_bias_pos_4"), ("x-default", "x_default"), (None, ""), ("a--b", "a_b"), ("Fouling 40%", "fouling_40")])
def test_normal_labels(spark, raw, want):
    assert value(spark, L.normalize_label(F.col("a")), a=raw) == want


@pytest.mark.parametrize("a, b, want", [("oa_bias_-4", "oa_bias_4", False), ("x_default", "x", True), ("", "", False), ("Fan_1", "fan 1", True)])
def test_exact(spark, a, b, want):
    assert bool(value(spark, L.exact_match(F.col("a"), F.col("b")), a=a, b=b)) is want


@pytest.mark.parametrize("a, want", [("coi_stuck_075", "ahu_cooling_coil_valve"), ("no fault", "normal"), ("strange_thing_50", "strange_thing"), ("Fan_x", "fan")])
def test_family(spark, a, want):
    assert value(spark, L.family(F.col("a")), a=a) == want


@pytest.mark.parametrize("system, name, kind, level, free", [
    ("chiller_plant", "ChillerPlant.csv", "normal", "none", True), ("chiller_plant", "ChillerPlant_coolingtower_bias_-2.csv", "coolingtower_bias", "-2", False),
    ("boiler_plant", "BoilerPlant_boiler_PI.csv", "boiler", "PI", False), ("sdahu", "coi_stuck_075_annual.csv", "coi_stuck", "075", False), ("ddahu", "DualDuct_DMPRStuck_OA_40%.csv", "DMPRStuck_OA", "40%", False),
    ("fcu", "FCU_SensorBias_RMTemp_+2C.csv", "SensorBias_RMTemp_+2C", "default", False), ("fcu", "FCU_FilterRestriction_10%.csv", "FilterRestriction", "10%", False),
    ("pfpu", "PFPU_VLVStuck_Heating_50%.csv", "VLVStuck_Heating", "50%", False), ("sfpu", "SFPU_FaultFree.csv", "normal", "none", True), ("rtu", "RTU_sim_condfouling10.csv", "condfouling", "10", False), ("rtu", "RTU_sim_baseline.csv", "normal", "none", True),
])
def test_file_names(spark, system, name, kind, level, free):
    r = value(spark, L.parse_file_name(system, F.col("a")), a=name)
    assert (r.fault_type, r.fault_intensity, r.is_fault_free) == (kind, level, free)
    assert r.label == ("Normal" if free else f"{kind}_{level}")


def test_windows_drop_what_is_incomplete(spark):
    rows = [("a", i, float(i)) for i in range(31)] + [("b", i, float(i)) for i in range(14)] + [("c", i, math.nan if i else 2.0) for i in range(15)]
    df = spark.createDataFrame(rows, "f string, i int, value double")
    out = {(r.f, r.window_id): r for r in W.window_stats(W.count_windows(df, ["f"], ["i"]), ["f"]).collect()}
    assert set(out) == {("a", 0), ("a", 1), ("c", 0)}
    assert abs(out["a", 1].slope - 1) < 1e-9 and out["c", 0].std == 0 and out["c", 0].slope == 0 and out["c", 0].n == 1
    hop = W.count_windows(df, ["f"], ["i"], 15, 5).select("f", "window_id").distinct().groupBy("f").count().collect()
    assert {r.f: r["count"] for r in hop} == {"a": 4, "c": 1}


@pytest.mark.parametrize("gap, filled", [(5, 5), (6, 5)])
def test_forward_fill_stops(spark, gap, filled):
    rows = [("a", 0, 1.0)] + [("a", 1 + i, None) for i in range(gap)] + [("b", 0, None)]
    out = W.forward_fill(spark.createDataFrame(rows, "f string, i int, v double"), ["f"], ["i"], "v", 5, "w")
    assert out.where("v IS NULL AND w IS NOT NULL").count() == filled


def test_temperature(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(400):
        z = [rng.gauss(0, 1) for _ in range(3)]
        p = [math.exp(v) for v in z]
        y = rng.choices(range(3), p)[0]
        rows.append(([3 * v for v in z], y))
    got = statistics.fit_temperature(spark.createDataFrame(rows, "z array<double>, y int"), F.col("z"), F.col("y"))
    assert got["status"] == "fitted" and 2.2 < got["temperature"] < 4.2 and got["nll_after"] < got["nll_before"]
    assert statistics.fit_temperature(spark.createDataFrame(rows[:5], "z array<double>, y int"), F.col("z"), F.col("y"))["status"] == "skipped"


def test_distributions(spark):
    row = spark.sql("SELECT map('a', 0.5D, 'b', 0.5D) AS p, map('a', 1.0D, 'c', 0.0D) AS q")
    r = row.select(M.entropy(F.col("p")).alias("h"), M.js_divergence(F.col("p"), F.col("q")).alias("js"), M.js_divergence(F.col("p"), F.col("p")).alias("same")).first()
    want = 0.5 * (0.5 * math.log(0.5 / 0.75) + 0.5 * math.log(2) + math.log(1 / 0.75))
    assert abs(r.h - 1) < 1e-12 and abs(r.js - want) < 1e-12 and abs(r.same) < 1e-12


TTL = """@prefix brick: <https://brickschema.org/schema/Brick#> .
@prefix x: <urn:site/> . # comment
x:AHU a brick:AHU ; brick:hasPart x:Coil, x:Fan ; brick:hasPoint x:T1 .
x:Coil a brick:Cooling_Coil ; <http://www.w3.org/2000/01/rdf-schema#label> "a; b, \\"c\\" ." ; brick:feeds x:Zone .
x:T1 a brick:Temperature_Sensor .
"""


def test_turtle_and_graph(spark, tmp_path):
    (tmp_path / "sdahu.ttl").write_text(TTL)
    triples = readers.read_turtle(spark, str(tmp_path))
    got = {(r.s, r.p, r.o) for r in triples.collect()}
    assert ("AHU", "hasPart", "Fan") in got and ("Coil", "feeds", "Zone") in got and ("T1", "type", "Temperature_Sensor") in got and len(got) == 7
    spark.dataSource.register(readers.TurtleSource)
    import json

    assert spark.read.format("turtle").option("files", json.dumps({"sdahu": TTL})).load().count() == 7
    nodes, edges = graph.build(triples)
    assert {r.node_id: r.brick_class for r in nodes.collect()}["sdahu::Zone"] == "HVAC_Zone"
    assert {r.child for r in graph.children(nodes, edges).where("node_id = 'sdahu::AHU'").collect()} == {"sdahu::Coil", "sdahu::Fan"}
    assert [r.source for r in graph.upstream(nodes, edges).where("node_id = 'sdahu::Zone'").collect()] == ["sdahu::Coil"]


def test_building_of_two_descriptions(spark):
    t = [("ahu", "AHU", "type", "AHU"), ("ahu", "AHU", "hasPart", "Fan"), ("ahu", "Fan", "type", "Fan"), ("ahu", "Fan", "feeds", "Zone"), ("ahu", "Zone", "type", "HVAC_Zone"), ("ahu", "Fan", "hasPoint", "T1"),
         ("chw", "Loop", "type", "Water_System"), ("chw", "Pump", "type", "Pump"), ("chw", "Loop", "feeds", "Pump"), ("chw", "Pump", "feeds", "Loop"), ("gone", "X", "type", "AHU")]
    links = [("chw", "Pump", "ahu", "AHU", "water"), ("chw", "Loo", "ahu", "Fa", "air"), ("chw", "Nothing", "ahu", "AHU", "steam"), ("chw", "Pump", "ahu", "AHU", "later")]
    nodes, edges, skipped = graph.building(
        spark.createDataFrame(t, "system_id string, s string, p string, o string"), spark.createDataFrame([("ahu", "Air"), ("chw", "Water")], "system_id string, name string"),
        spark.createDataFrame(links, "source_system string, source_node string, target_system string, target_node string, medium string"),
    )
    assert {(r.node_id, r.level) for r in nodes.collect()} == {("building", 0), ("system::ahu", 1), ("system::chw", 1), ("ahu::AHU", 2), ("ahu::Fan", 2), ("ahu::Zone", 2), ("ahu::T1", 3), ("chw::Loop", 2), ("chw::Pump", 2)}
    got = {(r.src, r.dst): r.relation for r in edges.collect()}
    assert got == {
        ("building", "system::ahu"): "has_part", ("building", "system::chw"): "has_part", ("system::ahu", "ahu::AHU"): "has_part", ("system::chw", "chw::Loop"): "has_part", ("ahu::AHU", "ahu::Fan"): "has_part", ("ahu::Fan", "ahu::Zone"): "feeds",
        ("ahu::Fan", "ahu::T1"): "has_sensor", ("chw::Loop", "chw::Pump"): "feeds", ("chw::Pump", "chw::Loop"): "feeds", ("chw::Pump", "ahu::AHU"): "cross_system", ("chw::Loop", "ahu::Fan"): "cross_system",
    }
    assert [tuple(r) for r in skipped.collect()] == [links[2]]


def test_compatibility(spark):
    row = spark.range(1).select(*(graph.compatibility(F.lit(d), F.lit(n), F.lit(s)).alias(f"c{k}") for k, (d, n, s) in enumerate([(0, True, True), (1, False, False), (2, False, True), (3, False, True), (None, False, False)]))).first()
    assert tuple(row) == (1.0, 0.55, 0.30, 0.18, 0.0)


def test_tools(spark):
    nodes = spark.createDataFrame([("system::a", 1, "a", "A"), ("a::x", 2, "a", "X"), ("a::y", 2, "a", "Y"), ("b::z", 2, "b", "Z")], "node_id string, level int, system_id string, name string")
    edges = spark.createDataFrame([("system::a", "a::x", "has_part", ""), ("a::x", "a::y", "has_part", ""), ("a::x", "b::z", "cross_system", "water")], "src string, dst string, relation string, medium string")
    seen = spark.createDataFrame([("a::x", "Fault", "fan", 0.9)], "node_id string, status string, fault_type string, confidence double")
    calls = spark.createDataFrame([(1, "get_system_overview", None, None), (2, "get_node_children", "a::x", None), (3, "get_node_children", "nope", None), (4, "rm", "a::x", None), (5, "get_related_systems", None, "b"), (6, "diagnose_node", "a::x", None), (7, "get_upstream_nodes", "a::y", None)], "call_id int, tool string, node_id string, system_id string")
    out = {r.call_id: r for r in tools.execute(calls, nodes, edges, seen).collect()}
    assert [x.id for x in out[1]["items"]] == ["system::a"] and [x.id for x in out[2]["items"]] == ["a::y"]
    assert out[3].error == "node not found: nope" and out[4].error == "unknown tool: rm" and out[4]["items"] is None
    assert [x.id for x in out[5]["items"]] == ["a"] and out[6]["items"][0].id == "fan" and out[7]["items"][0].info == "parent_assembly"


def test_potential_telescopes(spark):
    rng = random.Random(4)
    state, total, first = potential.start(), 0.0, potential.CONFIG["start"]
    for _ in range(30):
        tool = rng.choice(["diagnose_node", "get_node_children", "get_node_sensors", "get_upstream_nodes"])
        state, row = potential.step(state, tool, {"node_id": f"s{rng.randrange(2)}::n{rng.randrange(5)}", "status": rng.choice(["fault", "normal", "warning", "error"]), "confidence": rng.random(), "targets": [f"s0::n{rng.randrange(30)}" for _ in range(3)]})
        total += row["potential_delta"]
        assert 0 <= row["entropy"] <= 1 and 0 <= row["conflict"] <= 1 and row["n_candidates"] <= potential.LIMIT
        assert not state["belief"] or abs(sum(state["belief"].values()) - 1) < 1e-9
    assert abs(total - (first - state["potential"])) < 1e-9


def test_metrics_of_no_episodes(spark):
    from ductwise.plans import catalog

    eps, calls = catalog.episodes(spark, "/root/testdata/sf0.001")
    none = metrics.report(metrics.episode_scores(eps.limit(0), calls.limit(0))).collect()
    assert all(r.da == 0 and r.aggregate == 0 for r in none)
    scores = metrics.episode_scores(eps, calls)
    assert scores.count() == eps.count()
    assert scores.where("da NOT IN (0, 1) OR se NOT BETWEEN 0 AND 1 OR tir > 1 OR support NOT BETWEEN 0 AND 1").count() == 0


def test_grouped_split_has_no_leaks(spark):
    rows = [(f"g{i % 37}", ["x", "y"][i % 2], i) for i in range(1000)] + [("big", "x", 5000 + i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k string, id int")
    out = datasets.grouped_split(df, "g", "k")
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    sizes = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 1300 and set(sizes) == {"train", "val", "test"}
    assert matching.overlap_counts(out, "g", "split").count() == 0
    assert datasets.grouped_split(df, "g", "k", hot=3).groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert datasets.grouped_split(df.limit(0), "g", "k").count() == 0


def test_allocations():
    assert datasets.largest_remainder({"a": 0.5, "b": 0.25, "c": 0.25}, 10) == {"a": 5, "b": 3, "c": 2}
    assert datasets.proportional({"a": 90, "b": 9, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert datasets.proportional({"a": 2}, 10) == {"a": 2}


def test_positional_pairs_close_up(spark):
    df = spark.sql("""SELECT array('a', 'b', 'c') AS calls, array('{"x":1}', 'bad', '[1]', '{"y":2}') AS results""")
    got = df.select(matching.positional_pairs(F.col("calls"), F.col("results")).alias("p")).first().p
    assert [(r.call, r.result) for r in got] == [("a", '{"x":1}'), ("b", '{"y":2}'), ("c", "{}")]


def test_turn_rules(spark):
    good = '<think>so</think><tool_call>{"name": "x", "arguments": {"node_id": "a"}}</tool_call>'
    bad = "<tool_call>{broken</tool_call><think>late</think>"
    rows = datasets.turn_rules(spark.createDataFrame([(1, good), (2, bad), (3, None)], "i int, text string"))
    got = {r.i: (r.bad_think, r.bad_action, r.bad_json, r.bad_order) for r in rows.collect()}
    assert got == {1: (0, 0, 0, 0), 2: (0, 0, 1, 1), 3: (1, 1, 0, 0)}


def test_globs_and_prefixes(spark):
    nodes = spark.createDataFrame([("s::Fan_1", "Fan_1"), ("s::Coil", "Coil")], "node_id string, name string")
    got = {r.pattern: r.node_id for r in matching.resolve_globs(spark.createDataFrame([("Fan*",), ("*oi*",), ("none",)], "pattern string"), nodes).collect()}
    assert got == {"Fan*": "s::Fan_1", "*oi*": "s::Coil"}


def test_stream_equals_batch(spark, tmp_path):
    from ductwise.plans import catalog

    _, calls = catalog.episodes(spark, "/root/testdata/sf0.001")
    steps = calls.select("episode_id", F.col("i").alias("step"), "tool", "node_id", "status", "confidence", "targets").where("episode_id LIKE '1%'")
    for k, part in enumerate((steps.where("step < 4"), steps.where("step >= 4"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in"))
    q = S.potential_trace(stream).writeStream.format("memory").queryName("epo").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.episode_id, r.step, round(r.potential, 9), r.mode)
    assert sorted(map(key, spark.table("epo").collect())) == sorted(map(key, potential.trace(steps).collect()))


def test_time_windows_stream(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = S.time_windows(stream, ["event_type"], size="1 day").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("days").count() == S.time_windows(events, ["event_type"], size="1 day").count() > 0


def test_sources(spark, tmp_path):
    (tmp_path / "RTU_sim_condfouling10.csv").write_text("Datetime,T\n2020-01-01 00:00:00,1.5\n1/2/2020 3:04,NaN\nbad,2\n")
    rows = readers.load_system(spark, str(tmp_path), "rtu", "Datetime string, T double").withColumn("ts", readers.parse_time(F.col("Datetime")))
    got = rows.orderBy("T").collect()
    assert {r.label for r in got} == {"condfouling_10"} and sum(r.ts is None for r in got) == 1 and sum(r["T"] is None for r in got) == 1
    assert readers.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert "| a |" in readers.markdown(spark.sql("SELECT 1.5D AS a"), "T")
