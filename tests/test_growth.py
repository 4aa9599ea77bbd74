"""Results at sizes and in orders where an earlier form of the code went wrong."""

from pyspark.sql import functions as F


def test_rare_root_has_its_part_however_many_groups_a_block_holds(spark):
    from ductwise.operators import datasets

    rows = spark.range(60000).select((F.col("id") / 3).cast("long").alias("g"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"), (F.col("id") % 3 == 0).alias("crosses"))
    rows = rows.withColumn("root", F.when(F.col("g") % 11 == 10, "rare").when(F.col("g") % 11 < 5, "one").otherwise("two"))
    out = datasets.grouped_split(rows, "g", "k", hot=256, root="root", cross=F.col("crosses")).cache()
    n = {(r.split, r.root): (r.n, r.x) for r in out.groupBy("split", "root").agg(F.count("*").alias("n"), F.count_if("crosses").alias("x")).collect()}
    assert out.count() == 60000 and out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n <> 1").isEmpty()
    for split in ("val", "test"):
        size, crossing = (sum(n[split, r][i] for r in ("rare", "one", "two")) for i in (0, 1))
        assert abs(size - 6000) <= 60 and all(n[split, r][1] >= round(0.2 * crossing) - 2 for r in ("rare", "one", "two"))


def test_beliefs_do_not_depend_on_how_rows_lie_in_files(spark):
    from ductwise.operators import evidence

    # confidences and statuses whose signed sum is zero but for the order of adding
    seen = [(1, "fault", 0.1), (2, "normal", 0.5), (3, "warning", 0.1), (4, "normal", 1.0), (5, "abnormal", 0.1), (6, "normal", 0.0)]
    rows = [(e, step, "s::n", "s", status, "f", (c * 10 + e % 7) % 11 / 10) for e in range(400) for step, status, c in seen]
    df = spark.createDataFrame(rows, "episode_id int, step int, node_id string, system_id string, status string, fault_type string, confidence double")
    want = None
    for order in ("step", "-step", "hash(step, episode_id)"):
        got = evidence.fuse(df.repartition(5, F.expr(order)).sortWithinPartitions(F.expr(order)), "step").select("episode_id", "score", "positive", "negative", "n").collect()
        got = {r.episode_id: tuple(r) for r in got}
        want = want or got
        assert got == want and all(r[4] == 6 for r in got.values())
    p = {r.episode_id: [] for r in df.collect()}
    for r in evidence.signed(df).orderBy("step").collect():
        p[r.episode_id].append(r.polarity)
    for e, values in p.items():
        total = 0.0
        for v in values:
            total += v
        assert want[e][1] == total


def test_scenarios_meet_one_link_of_a_pair_of_systems(spark):
    from ductwise.operators import oracle

    links = spark.createDataFrame([("r1", "x", "d2", "y"), ("r1", "x", "d3", "y"), ("r2", "x", "d1", "y"), ("r2", "x", "d1", "y"), (None, "x", "d0", "z")], "src string, src_system string, dst string, dst_system string")
    s = spark.createDataFrame([("a", "y", "x", "r1"), ("b", "y", "x", "r2"), ("c", "y", "x", "r9"), ("d", "z", "x", None), ("e", "q", "x", "r1")], "scenario_id string, downstream_system string, root_system string, root_node string")
    out = oracle.connected_target(s, links)
    assert {r.scenario_id: r.target for r in out.collect()} == {"a": "d2", "b": "d1", "c": "d1", "d": "d0"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 4  # links by root, links by systems (on each side of its join), scenarios


def test_a_list_is_given_once_and_named_by_other_calls(spark):
    from ductwise.operators import tools

    nodes = spark.createDataFrame([("n1", 1, "s", "N1"), ("n2", 2, "s", "N2"), ("n3", 2, "t", "N3")], "node_id string, level int, system_id string, name string")
    edges = spark.createDataFrame([("n1", "n2", "has_part", "", 0), ("n1", "n3", "has_part", "", 0), ("n2", "n3", "cross_system", "", 1)], "src string, dst string, relation string, medium string, seq long")
    seen = spark.createDataFrame([("n1", "fault", "f", 0.5)], "node_id string, status string, fault_type string, confidence double")
    asks = ["get_node_children", "get_upstream_nodes", "get_related_systems", "get_system_overview", "diagnose_node", "nothing"]
    calls = spark.createDataFrame([(i, asks[i % 6], [None, "n1", "n2", "n3", "gone"][i % 5], "st"[i % 2]) for i in range(120)], "call_id int, tool string, node_id string, system_id string")
    full = {r.call_id: r for r in tools.execute(calls, nodes, edges, seen).collect()}
    once = {r.call_id: r for r in tools.execute_once(calls, nodes, edges, seen).collect()}
    assert len(full) == len(once) == 120
    for i, r in once.items():
        given = r if r.same_as is None else once[r.same_as]
        assert (r.tool, r.status, r.error, given["items"]) == (full[i].tool, full[i].status, full[i].error, full[i]["items"]) and (r.same_as is None or (r["items"] is None and r.same_as < i))
    asked = {(r.tool, c.system_id if r.tool == "get_related_systems" else c.node_id if r.tool != "get_system_overview" else "") for c in calls.collect() for r in [once[c.call_id]] if r.error is None}
    assert sum(r["items"] is not None for r in once.values()) == len(asked)


def test_family_normalizes_a_label_once(spark):
    from ductwise.functions import labels as L

    df = spark.createDataFrame([("Fan Stuck", "fan_broken"), ("oa bias -2", "OA_Bias_10"), ("x", None), ("", "normal"), ("misc thing 30", "misc-thing")], "a string, b string")
    out = df.select(L.family(F.col("a")).alias("f"), L.same_family(F.col("a"), F.col("b")).alias("s"), L.exact_match(F.col("a"), F.col("b")).alias("e"))
    assert [tuple(r) for r in out.collect()] == [("fan", True, False), ("ahu_outdoor_air_sensor", True, False), ("x", False, False), ("normal", False, False), ("misc_thing", True, False)]
    plan = df.select(L.same_family(F.col("a"), F.col("b")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") <= 4  # 224 where each rule normalized the label again


def test_scenarios_of_one_truth_are_one_row_before_they_meet_samples(spark):
    from ductwise.operators import matching

    names = "scenario_type string, root_cause_system string, root_cause_node string, fault_type string"
    scenarios = spark.createDataFrame([(f"T{i:05d}", "a_x", "sys", "n", "f") for i in range(3000)] + [("S9", "na", "sys", "n", "f")], "scenario_id string, " + names)
    samples = spark.createDataFrame([("q1", "na", "sys", "n", "f"), ("q2", "zz", "sys", None, "f"), ("q3", "zz", "sys", "m", "f")], "sample_id string, " + names)
    out = matching.match_scenarios(samples, scenarios)
    assert {r.sample_id: (r.matched_id, r.strategy) for r in out.collect()} == {"q1": ("S9", "ground_truth"), "q2": ("", "missing"), "q3": ("", "missing")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("min(scenario_id") == 1


def test_windows_that_scenarios_share_are_read_once(spark):
    from ductwise.operators import oracle

    data = spark.createDataFrame([("a", "a.csv", i, s, float(i * i % 7)) for i in range(60) for s in "ab"], "system_id string, source_file string, row_idx long, sensor string, value double")
    s = spark.createDataFrame([(f"s{i}", "a", "a.csv", i % 5, i % 5 + (0 if i % 9 == 0 else 15)) for i in range(200)] + [("late", "a", "a.csv", 50, 65)], "scenario_id string, root_cause_system string, source_file string, time_window_start long, time_window_end long")
    columns = ["a_mean", "b_slope", "c_max", "b_range"]
    want = {tuple(map(str, r)) for r in oracle.features(oracle.slices(s, data), columns).collect()}
    assert {tuple(map(str, r)) for r in oracle.scenario_features(s, data, columns).collect()} == want and len(want) == 200 - 23


def test_calls_of_a_plan_are_written_once(spark, monkeypatch):
    from ductwise.operators import trajectories
    from ductwise.plans import worlds

    written, cut = [], trajectories.cut

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(trajectories, "cut", counted)
    s, graph = worlds.flow_scenarios(spark, "/root/testdata/sf0.001").limit(300), worlds.flow_graph(spark)
    s = cut(s)
    calls = trajectories.plan(s, *graph, list(worlds.SYSTEMS))
    out = trajectories.results(calls, s, *graph).collect()
    assert len(out) == calls.count() > 1500 and len({(r.scenario_id, r.i) for r in out}) == len(out)
    assert sum(n > 1000 for n in written) == 1  # wishes, drawn calls and results as well before
    order = {(r.scenario_id, r.i): r for r in out}
    for r in out:  # phases rise, and parents come before their parts
        assert r.i == 0 or order[r.scenario_id, r.i - 1].phase <= r.phase
        if r.tool == "diagnose_node":
            assert any(q.i < r.i for q in out if q.scenario_id == r.scenario_id and q.tool == "get_node_children" and r.node_id in q.targets)


def _copies_of_orders(spark, path, n):
    """sf0.001 with its orders n times, keys shifted."""
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    size = o.agg({"o_orderkey": "max"}).first()[0] + 1
    o.crossJoin(spark.range(n).withColumnRenamed("id", "r")).withColumn("o_orderkey", F.expr(f"o_orderkey + r * {size}")).drop("r").write.parquet(f"{path}/orders.parquet")
    return str(path)


def test_checks_read_each_distinct_dialogue_once(spark, monkeypatch, tmp_path):
    from ductwise.operators import trajectories, transcripts
    from ductwise.plans import worlds

    # a thought with a second block in it breaks a rule in every turn that has it
    monkeypatch.setitem(trajectories.THOUGHTS, "get_related_systems", "{node}?</think><think>Which systems are connected?")
    sf, read, turn_errors = _copies_of_orders(spark, tmp_path, 10), [], transcripts.turn_errors

    def counted(turns, known=None):
        read.append(turns.count())
        return turn_errors(turns, known)

    monkeypatch.setattr(transcripts, "turn_errors", counted)
    got = worlds.trajectory_checks(spark, sf).first().asDict()
    turns = trajectories.generate(worlds.flow_scenarios(spark, sf), *worlds.flow_graph(spark), list(worlds.SYSTEMS))[0].cache()
    errors = turn_errors(turns.withColumnRenamed("scenario_id", "conv_id"), worlds.flow_graph(spark)[0])
    broken = errors.select(sum(F.col(c).cast("long") for c in errors.columns[2:]).alias("n")).agg(F.sum("n")).first()[0]
    assert broken == turns.where("text LIKE '%Which systems are connected?%'").count() > 1000
    assert got == {"dialogues": 15000, "broken_rules": broken, "skipped_steps": 0, "wrong_conclusions": 0}
    assert read[0] < turns.count() / 5  # all turns before


def test_scenarios_of_one_make_share_a_dialogue(spark, monkeypatch, tmp_path):
    from ductwise.operators import trajectories
    from ductwise.plans import worlds

    s = worlds.flow_scenarios(spark, _copies_of_orders(spark, tmp_path, 10)).withColumn("description", F.concat("description", F.lit(" of "), "scenario_id"))
    # truths that are null in part
    k = F.substring("scenario_id", 2, 9).cast("int")
    s = s.withColumns({"symptom_system": F.when(k % 7 > 0, F.col("symptom_system")), "path": F.when(k % 11 > 0, F.col("path"))}).cache()
    graph, systems = worlds.flow_graph(spark), list(worlds.SYSTEMS)
    # each scenario planned and judged by itself
    outcome = trajectories.results(trajectories.plan(s, *graph, systems), s, *graph).cache()
    final = trajectories.diagnoses(s, outcome).cache()
    passed = trajectories.gates(final, s, outcome).cache()
    turns = trajectories.dialogue(s, outcome, final.join(passed.where("admitted"), "scenario_id", "left_semi")).cache()
    planned, plan = [], trajectories.plan

    def counted(scenarios, *rest):
        planned.append(scenarios.count())
        return plan(scenarios, *rest)

    monkeypatch.setattr(trajectories, "plan", counted)

    def same(got, want):
        got, want = got.select(*want.columns).cache(), want
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()

    b = trajectories.batch(s, *graph, systems)
    same(b.turns(), turns), same(b.gates(), passed), same(b.calls(), outcome)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # makes too many to be sent to all tasks
    try:
        same(trajectories.batch(s, *graph, systems).turns(), turns)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert max(planned) < s.count() / 4  # all scenarios before
