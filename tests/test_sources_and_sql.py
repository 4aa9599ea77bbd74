import pytest
from pyspark.sql import functions as F

from ductwise.functions import labels as L
from ductwise.functions import maths as M
from ductwise.functions import sql
from ductwise.operators import datasets, models, scenarios
from ductwise.sources import readers
from ductwise.streaming import windows as S


def test_sql_names_equal_the_expressions(spark):
    sql.register(spark, "dw_")
    texts = ["OA bias -4", "x-default", "", None, "normal", "System::Rtu", "a::b::c", "No Fault", "+3 up", "50%", "severe", "-7", "12 %"]
    frame = spark.createDataFrame([(a, b, c) for a in texts for b, c in zip(texts, [None, 0.0, 0.3, 1.0, 2.0, -1.0] * 3)], "a string, b string, c double")
    pairs = {
        "dw_fault_label(a)": L.normalize_label(F.col("a")), "dw_canonical_label(a)": L.canonical_label(F.col("a")), "dw_exact_match(a, b)": L.exact_match(F.col("a"), F.col("b")), "dw_is_no_fault_label(a)": L.is_no_fault_label(F.col("a")),
        "dw_is_no_fault_node(a)": L.is_no_fault_node(F.col("a")), "dw_mutual_substring(a, b)": L.mutual_substring(F.col("a"), F.col("b")), "dw_node_system(a)": L.node_system(F.col("a")), "dw_clip01(c)": M.clip(F.col("c")),
        "dw_confidence_factor(c)": M.confidence_factor(F.col("c")), "dw_tempered(c, 2D)": models.tempered(F.col("c"), 2.0), "dw_difficulty(a)": L.difficulty(F.col("a")),
    }
    assert len(pairs) == len(sql.FUNCTIONS)
    for text, column in pairs.items():
        assert frame.where(~F.expr(text).eqNullSafe(column)).count() == 0, text


def test_cache_is_chosen_by_age(spark):
    files = spark.createDataFrame([("a.csv", 10), ("b.csv", 10), ("d.CSV", 1)], "name string, modified long")
    cached = spark.createDataFrame([("a.parquet", 10), ("b.parquet", 9), ("c.parquet", 1)], "name string, modified long")
    pick = lambda **o: {r.name: r.source for r in readers.choose_source(files, cached, **o).collect()}
    assert pick() == {"a.csv": "parquet", "b.csv": "csv", "c.csv": "parquet", "d.CSV": "csv"}
    assert pick(trust_cache=True)["b.csv"] == "parquet" and set(pick(use_cache=False).values()) == {"csv"}
    names = lambda f, c: [r.name for r in readers.discover(f, c).collect()]
    assert names(files, cached) == ["a.csv", "b.csv", "d.CSV"] and names(files.limit(0), cached) == ["a.csv", "b.csv", "c.csv"]


def test_scenario_files(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "single_system", ["a", "b"], 5)], "scenario_id string, scenario_type string, affected_systems array<string>, time_window_start long")
    rows = rows.withColumn("diagnostic_path", F.expr("named_struct('nodes', array(named_struct('node_id', 'a::n', 'role', 'root_cause', 'system_id', 'a', 'component_name', 'n', 'abnormal_hint', 'x', 'direction', 'up')), 'root_cause_node', 'a::n', 'fault_type', 'f', 'path_length', 1)"))
    readers.write_scenarios(rows, str(tmp_path / "s"))
    (got,) = readers.read_scenarios(spark, str(tmp_path / "s")).collect()
    assert got.affected_systems == ["a", "b"] and got.time_window_start == 5 and got.diagnostic_path.nodes[0].role == "root_cause" and got.description is None
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.json").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert readers.count_broken(spark, str(tmp_path / "l"), "a int").first().asDict() == {"n_rows": 2, "n_broken": 1}
    assert readers.read_jsonl(spark, str(tmp_path / "l"), "a int").where("a IS NOT NULL").count() == 2
    listed = readers.list_files(spark, str(tmp_path / "l" / "*.json")).collect()
    assert [r["name"] for r in listed] == ["x.json"]


def test_reports_are_never_cut(spark):
    rows = spark.range(12).withColumn("x", F.col("id") / 3)
    assert readers.markdown(rows, "t", limit=12).count("\n| ") == 13
    with pytest.raises(ValueError):
        readers.markdown(rows, "t", limit=11)


def test_targets_are_filled_by_rounds(spark):
    made = []

    def batch(k):
        made.append(k)
        return spark.range(k * 10, k * 10 + 15).select(F.concat(F.lit("s"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"))

    got = datasets.fill_targets(batch, {"a": 12, "b": 5}, "kind", "id", rounds=10)
    n = {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()}
    assert n == {"a": 12, "b": 5} and got.select("id").distinct().count() == 17 and len(made) < 10
    few = datasets.fill_targets(batch, {"a": 500}, "kind", "id", rounds=2)
    assert few.count() == 9


def test_curriculum_keeps_shares(spark):
    rows = spark.range(6000).select(F.concat(F.lit("s"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "na_no_fault").when(F.col("id") % 3 == 1, "single_system").otherwise("cross_system").alias("kind"))
    n = {r["kind"]: r["count"] for r in datasets.curriculum(rows, "kind", "id", {"na_no_fault": 1.0, "single_system": 0.5}).groupBy("kind").count().collect()}
    assert n["na_no_fault"] == 100 and 900 < n["single_system"] < 1100 and "cross_system" not in n


def test_symptoms_fit_the_fault(spark):
    row = spark.range(1).select(*(scenarios.symptom(F.lit(f), F.lit("the fan"), F.lit("k")).alias(f) for f in ("coil_fouling", "valve_leak", "x"))).first()
    assert all("the fan" in v for v in row) and len(set(row)) == 3


def test_late_steps_of_a_stream(spark, tmp_path):
    schema = "episode_id string, step int, tool string, node_id string, status string, confidence double, targets array<string>"
    rows = [("e", 2, "diagnose_node", "a::n", "fault", 0.9, None), ("e", 1, "get_node_children", "a::x", "success", None, ["a::n"]), ("e", 3, "diagnose_node", "a::n", "fault", 0.9, None)]
    for k, part in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = S.potential_trace(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.step: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {1, 2, 3} and got[1].mode == "late" and got[1].potential is None and got[3].mode != "late"


def test_models_of_systems(spark):
    rows = spark.createDataFrame([(i, s, f"c{i % 2}", float(i % 2), float(i)) for s in ("x", "y") for i in range(40)] + [(99, "z", "only", 0.0, 0.0)], "id int, system_id string, label string, a double, b double")
    got = models.train_systems(rows, ["x", "y", "z"], ["a", "b"], "label", F.col("id"), trees=3, depth=3)
    assert set(got) == {"x", "y"} and models.registry(got)["x"] == {"labels": ["c0", "c1"], "feature_cols": ["a", "b"], "ready": True}


def test_tools_as_table_functions(spark):
    from ductwise.functions import sql
    from ductwise.operators import tools
    from ductwise.plans import worlds

    nodes, edges = (df.cache() for df in worlds.flow_graph(spark))
    said = spark.createDataFrame([("view::n1", "Fault", "fan_stuck", 0.9, "per_node", None), ("view::n2", "Normal", "None", 0.8, "per_node", None)], "node_id string, status string, fault_type string, confidence double, model_source string, error string")
    shown = spark.createDataFrame([("view::n1::t", 21.5)], "node_id string, value double")
    score = tools.anomaly(F.create_map(F.lit("Normal"), F.col("p")))
    health = spark.createDataFrame([("view", 0.3), ("click", 0.9)], "system_id string, p double").select("system_id", score.alias("a")).select("system_id", "a.*")
    names = sql.register_tools(spark, nodes, edges, said, shown, health, prefix="t_")
    assert names == ["t_" + t for t in tools.AGENT_TOOLS] or set(names) == {"t_" + t for t in tools.AGENT_TOOLS}
    about = [r.node_id for r in nodes.collect()] + ["nowhere"]
    listing = ("get_node_children", "get_node_sensors", "get_downstream_nodes", "get_upstream_nodes")
    calls = spark.createDataFrame([(f"{t}|{n}", t, n, None) for t in listing for n in about] + [("o|", "get_system_overview", None, None)] + [(f"r|{s}", "get_related_systems", None, s) for s in worlds.SYSTEMS], "call_id string, tool string, node_id string, system_id string")
    want = {r.call_id: sorted(x.id for x in r["items"] or []) for r in tools.execute(calls, nodes, edges, said).collect()}
    asked = spark.createDataFrame([(n,) for n in about], "q string")
    asked.createOrReplaceTempView("t_asked")
    for t in listing:  # beside a table, and one call
        got = {n: [] for n in about}
        for r in spark.sql(f"SELECT q, id FROM t_asked, LATERAL t_{t}(q)").collect():
            got[r.q].append(r.id)
        assert {n: sorted(x) for n, x in got.items()} == {n: want[f"{t}|{n}"] for n in about}
    assert sorted(r.id for r in spark.sql("SELECT * FROM t_get_node_children('system::view')").collect()) == want["get_node_children|system::view"] != []
    overview = {r.id: (r.score, r.health) for r in spark.sql("SELECT * FROM t_get_system_overview()").collect()}
    assert sorted(overview) == want["o|"] and overview["system::view"] == (pytest.approx(0.7), "alert") and overview["system::click"][1] == "normal" and overview["system::error"] == (None, None)
    for s in worlds.SYSTEMS:
        assert sorted(r.other_system for r in spark.sql(f"SELECT * FROM t_get_related_systems('{s}')").collect()) == want[f"r|{s}"]
    sensors = spark.sql("SELECT * FROM t_get_node_sensors('view::n1')").collect() + spark.sql("SELECT * FROM t_get_node_sensors('view::n0')").collect()
    assert [(r.reading, r.available) for r in sensors] == [(21.5, True), (None, False)]
    one = lambda n: tuple(spark.sql(f"SELECT status, fault_type, error FROM t_diagnose_node('{n}')").first())
    assert one("view::n1") == ("Fault", "fan_stuck", None) and one("view::n3") == ("unknown", None, None) and one("nowhere") == ("error", None, "node not found: nowhere")


STEPS = "episode_id string, step int, tool string, node_id string, status string, confidence double, targets array<string>, ts timestamp"


def test_state_machine_with_timers(spark, tmp_path):
    import datetime

    from ductwise.operators import potential
    from ductwise.plans import catalog

    spark.conf.set(*S.STATE_STORE)
    try:
        at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
        _, calls = catalog.episodes(spark, "/root/testdata/sf0.001")
        own = calls.select("episode_id", F.col("i").alias("step"), "tool", "node_id", "status", "confidence", "targets").where("episode_id LIKE '1%'")
        rows = [(*tuple(r), at(r.step)) for r in own.collect()]
        parts = [[r for r in rows if r[1] < 4], [r for r in rows if r[1] >= 4], [("clock", 0, "get_system_overview", None, "success", None, None, at(600))], [("clock", 1, "get_system_overview", None, "success", None, None, at(601))]]
        out = []
        for k, part in enumerate(parts):  # the query starts anew from its checkpoint for each part
            spark.createDataFrame(part, STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(STEPS).parquet(str(tmp_path / "in"))
            q = S.timed_trace(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
            out.append({(r.episode_id, r.step, r.final) for r in spark.read.parquet(str(tmp_path / "out")).collect()})
        got = spark.read.parquet(str(tmp_path / "out")).where("episode_id <> 'clock'").collect()
        key = lambda r: (r.episode_id, r.step, round(r.potential, 9), r.mode, r.top_candidate, r.n_candidates)
        want = {key(r) for r in potential.trace(own).collect()}
        assert {key(r) for r in got if not r.final} == want and sum(not r.final for r in got) == len(rows)
        last = {e: max(s for e2, s, *_ in rows if e2 == e) for e, *_ in rows}
        final = [key(r) for r in got if r.final]
        assert len(final) == len(last) and {k[0] for k in final} == set(last)  # once each
        assert all(k in want and k[1] == last[k[0]] for k in final)
        assert not any(f for _, _, f in out[1])
    finally:
        spark.conf.unset(S.STATE_STORE[0])


def test_late_rows_are_counted(spark, tmp_path):
    import datetime
    import random

    rng, at = random.Random(4), lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    parts = [[(k * 100 + i, at(30 * k + rng.randint(-40, 30)) if i % 17 else None) for i in range(60)] for k in range(4)] + [[]]
    want, newest = [], None
    for part in parts:
        want.append(sum(t is not None and newest is not None and t < newest - datetime.timedelta(minutes=10) for _, t in part))
        newest = max([t for _, t in part if t is not None] + [newest] if newest else [t for _, t in part if t is not None], default=None)
    run = S.late_splitter(str(tmp_path / "late"), late="10 minutes")
    for k, part in enumerate(parts):
        for _ in range(2 if k == 2 else 1):  # a batch that is run again counts once
            run(spark.createDataFrame(part, "id int, ts timestamp"), k)
    marks = spark.read.parquet(str(tmp_path / "late" / "marks"))
    assert [r.n_late for r in marks.orderBy("batch_id").collect()] == want and sum(want) > 0
    total = S.late_counts(marks).first()
    rows = spark.read.parquet(str(tmp_path / "late" / "rows"))
    assert (total.n_rows, total.n_late) == (240, sum(want)) == (rows.count(), rows.where("late").count())
    src = tmp_path / "in"
    spark.createDataFrame(parts[0], "id int, ts timestamp").coalesce(1).write.parquet(str(src))
    q = spark.readStream.schema("id int, ts timestamp").parquet(str(src)).writeStream.foreachBatch(S.late_splitter(str(tmp_path / "own"))).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert S.late_counts(spark.read.parquet(str(tmp_path / "own" / "marks"))).first().n_rows == 60


def test_sessions(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2024-01-01 00:00:00'), ('a', TIMESTAMP'2024-01-01 00:20:00'), ('a', TIMESTAMP'2024-01-01 01:00:00'), ('b', TIMESTAMP'2024-01-01 00:05:00') t(k, ts)")
    got = sorted((r.k, r.start.minute + 60 * r.start.hour, r.n) for r in S.sessions(rows, ["k"]).collect())
    assert got == [("a", 0, 2), ("a", 60, 1), ("b", 5, 1)]


def test_clean_load(spark, tmp_path):
    nan = "NaN"
    for name, n in (("RTU_sim_condfouling10.csv", 40), ("RTU_sim_baseline.csv", 50)):
        lines = [f"2020-01-01 {k // 60:02d}:{k % 60:02d}:00,{nan if 3 <= k < 7 or 20 <= k < 28 else k}.0,".replace("NaN.0", "NaN") for k in range(n)]
        (tmp_path / name).write_text("Datetime,T,E\n" + "\n".join(lines[::-1]) + "\n")
    rows = readers.load_clean(spark, str(tmp_path), "rtu", "Datetime string, T double, E double")
    got = {}
    for r in rows.collect():
        got.setdefault(r.source_file, {})[r.row_idx] = r
    assert {k: len(v) for k, v in got.items()} == {"RTU_sim_condfouling10.csv": 40, "RTU_sim_baseline.csv": 50} and "E" not in rows.columns
    for v in got.values():
        assert [v[k]["T"] for k in (2, 3, 6, 7, 19, 20, 24, 25, 27, 28)] == [2.0, 2.0, 2.0, 7.0, 19.0, 19.0, 19.0, None, None, 28.0]
    labels = {r.label: r.label_id for r in rows.select("label", "label_id").distinct().collect()}
    assert labels == {"condfouling_10": 1, "Normal": 0}
    some = readers.load_clean(spark, str(tmp_path), "rtu", "Datetime string, T double, E double", share=0.5, size=5).collect()
    blocks = {}
    for r in some:
        blocks.setdefault((r.source_file, r.row_idx // 5), set()).add(r.row_idx % 5)
    assert 0 < len(some) < 90 and all(b == {0, 1, 2, 3, 4} for b in blocks.values())
    assert readers.load_clean(spark, str(tmp_path), "rtu", "Datetime string, T double, E double", most_rows=10).count() == 20
