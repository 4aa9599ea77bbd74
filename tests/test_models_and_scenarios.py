import random

from pyspark.sql import functions as F

from ductwise.operators import models, scenarios, statistics
from ductwise.operators import visible_state as V


def test_training_tells_classes_apart(spark):
    rng = random.Random(3)
    rows = [(i, f"c{i % 3}", rng.gauss(i % 3, 0.2), rng.gauss(0, 1) if i % 7 else None) for i in range(300)] + [(999, "rare", 0.0, 0.0)]
    got = models.train(spark.createDataFrame(rows, "id int, label string, a double, b double"), ["a", "b"], "label", F.col("id"), trees=10, depth=4)
    assert got["labels"] == ["c0", "c1", "c2"]
    pred = got["scored"].where("is_val").withColumn("p", F.array_position("probabilities", F.array_max("probabilities")) - 1)
    report = statistics.report_averages(statistics.classification_report(pred.select(F.col("class_id").cast("int"), F.col("p").cast("int")), "class_id", "p")).first()
    assert report.accuracy > 0.9
    v = pred.select(models.verdict(models.calibrated(F.col("probabilities"), 2.0), ["Normal", "c1", "c2"]).alias("v")).select("v.*").collect()
    assert {r.status for r in v} == {"Normal", "Fault"} and all(0 < r.confidence <= 1 for r in v)


def test_readings(spark):
    r = spark.sql("SELECT map('T_mean', 1.0D, 'F', 2.0D) AS m, map('OA_TEMP', 10.0D, 'OA_TEMP_WB', 15.0D, 'SA_FLOW', -3.0D) AS g")
    x = r.select(models.from_readings(F.col("m"), ["T_mean", "F_std", "Z_max"]).alias("x"), models.guarded_readings(F.col("g")).alias("g")).first()
    assert x.x.features == [1.0, 2.0, 0.0] and abs(x.x.coverage - 2 / 3) < 1e-9 and x.x.usable
    assert x.g == {"OA_TEMP": 10.0, "OA_TEMP_WB": 8.0, "SA_FLOW": 0.0}
    rows = spark.createDataFrame([("n", "1"), ("n", "x"), ("n", "2")], "node string, T string")
    assert models.window_readings(rows, ["node"], ["T"]).first().readings == {"T": 1.5}


def test_visible_state(spark):
    turns = [("c", 1, "get_system_overview", None, "success", None, ["system::a"]), ("c", 2, "get_node_children", "a::x", "success", None, [f"a::n{i}" for i in range(10)]), ("c", 3, "diagnose_node", "a::n9", "fault", "fan", []), ("c", 4, None, None, None, None, None), ("c", 5, "get_node_children", "zz", "error", None, ["bad"])]
    out = {r.turn: r for r in V.fold(spark.createDataFrame(turns, "conv_id string, turn int, tool string, node_id string, status string, fault_type string, targets array<string>")).collect()}
    assert out[2].n_nodes == 12 and len(out[2].nodes) == 8 and len(out[2].frontier) == 4
    assert out[3].candidates == ["a::n9:fan"] and "a::n9" not in out[3].frontier and out[4].action == "conclude" and out[5].n_nodes == 12


def test_scenarios(spark):
    files = spark.createDataFrame([("a", "f1", "fan", "50", "a::fan", 3000), ("a", "f0", "normal", "none", "none", 2000), ("b", "f2", "leak", "10", "b::v", 10)], "system_id string, file string, fault_type string, fault_intensity string, node_id string, n_rows int")
    base = scenarios.single_system(files)
    rows = base.collect()
    assert len(rows) == 8 and all(1000 <= r.time_window_start and r.time_window_end - r.time_window_start == 15 for r in rows)
    assert {r.scenario_id for r in rows} == {r.scenario_id for r in scenarios.single_system(files).collect()}
    cross = scenarios.cross_system(base, spark.createDataFrame([("a", "b")], "system_id string, downstream string"), 3)
    assert cross.count() == 3 and {tuple(r.affected_systems) for r in cross.collect()} == {("a", "b")}
    assert scenarios.derived(base).count() == 15
    wanted = spark.createDataFrame([(f"w{i}", "a") for i in range(7)], "scenario_id string, root_cause_system string")
    assert scenarios.no_fault(base, wanted).count() == 7
    texts = scenarios.derived(base).select("scenario_type", scenarios.prompt(F.col("scenario_type"), F.lit("Chiller"), F.lit("warm air"), F.col("scenario_id")).alias("t"))
    assert texts.where(F.col("scenario_type").startswith("a_") & scenarios.leaks(F.col("t"), ["chiller"])).count() == 0
    assert texts.where("t IS NULL OR t LIKE '%{%'").count() == 0


def test_paths_keep_both_ends(spark):
    r = spark.sql("SELECT array('s', 'a', 'b', 'c', 'd', 'e', 'f', 'r') AS x").select(scenarios.diagnostic_path(F.col("x"), F.lit("r")).alias("p")).first().p
    assert r[0] == "s" and r[-1] == "r" and len(r) <= 6


def _windows(spark, n=1200):
    """Three classes that single splits tell apart badly: which of three sums of features is largest."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(9)]
        sums = [sum(x[k::3]) for k in range(3)]
        rows.append((i, ["Normal", "fan_stuck", "valve_leak"][sums.index(max(sums))], *x))
    columns = [f"x{k}" for k in range(9)]
    return spark.createDataFrame(rows, "id int, label string, " + ", ".join(f"{c} double" for c in columns)), columns


def test_boosting_beats_the_forest_and_stops_early(spark, tmp_path):
    rows, columns = _windows(spark)
    share = lambda got: got["scored"].where("is_val").select((F.array_position("probabilities", F.array_max("probabilities")) - 1 == F.col("class_id")).cast("double").alias("hit")).agg(F.avg("hit")).first()[0]
    forest = share(models.train(rows, columns, "label", F.col("id"), trees=20, depth=4))
    got = models.train_boosted(rows, columns, "label", F.col("id"), rounds=40, depth=3, step=0.3)
    boosted = share(got)
    assert boosted > forest + 0.02 and boosted > 0.8, (boosted, forest)
    assert got["labels"] == ["Normal", "fan_stuck", "valve_leak"] and len(got["rounds_used"]) == 3 and all(1 <= n <= 40 for n in got["rounds_used"])
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in got["scored"].collect()) and got["scored"].count() == rows.count()
    flat = models.train_boosted(rows.withColumn("label", F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, "a").otherwise("b")), columns, "label", F.col("id"), rounds=40, depth=3, step=0.3)
    assert max(flat["rounds_used"]) < 40  # nothing to learn: held-out loss stops it
    models.save_models(spark, {"sys::ahu": got}, str(tmp_path / "m"))
    row = models.manifest(spark, str(tmp_path / "m")).first()
    assert (row.name, row.labels, row.n_models, row.ready) == ("sys::ahu", got["labels"], 3, True)
    from pyspark.ml.feature import VectorAssembler

    again = models.boosted_scores(models.load_models(spark, str(tmp_path / "m"), "sys::ahu"), VectorAssembler(inputCols=columns, outputCol="features_").transform(rows))
    want = {r.id: r.probabilities for r in got["scored"].collect()}
    assert all(max(abs(a - b) for a, b in zip(r.probabilities, want[r.id])) < 1e-9 for r in again.collect())


def test_responsible_nodes(spark, tmp_path):
    rows, columns = _windows(spark, 400)
    rare = spark.createDataFrame([(1000 + i, "rare_fault", *([0.0] * 9)) for i in range(3)], rows.schema)
    got = models.train_responsible(rows.unionByName(rare), columns, "label", F.col("id"), {"fan_stuck": "a::fan", "valve_leak": "a::valve", "rare_fault": "a::pump", "Normal": "a::none"}, rounds=15, depth=3, step=0.3)
    assert {k: t["status"] for k, t in got.items()} == {"a::fan": "trained", "a::valve": "trained", "a::pump": "skipped", "a::none": "skipped"} and got["a::pump"]["positive"] == 3
    answers = models.responsible_answers(got, rows, columns, "id").join(rows.select("id", "label"), "id").collect()
    assert len(answers) == 800 and {r.status for r in answers} == {"Fault", "Normal"}
    own = {"a::fan": "fan_stuck", "a::valve": "valve_leak"}
    assert sum((r.status == "Fault") == (r.label == own[r.node_id]) for r in answers) > 0.85 * len(answers)
    assert all(r.confidence >= 0.60 if r.status == "Fault" else r.confidence > 0.40 for r in answers)
    models.save_models(spark, got, str(tmp_path / "m"))
    assert {r.name: r.ready for r in models.manifest(spark, str(tmp_path / "m")).collect()} == {"a::fan": True, "a::valve": True, "a::pump": False, "a::none": False}
    assert models.responsible_answers({}, rows, columns, "id").count() == 0


def test_calibrated_logits_are_left_alone(spark):
    rows = [([12.0, 0.0, 0.0] if i % 2 else [0.0, 12.0, 0.0], 0 if i % 2 else 1) for i in range(40)]
    got = statistics.fit_temperature(spark.createDataFrame(rows, "z array<double>, y int"), F.col("z"), F.col("y"))
    assert got["status"] == "identity" and got["temperature"] == 1.0 and got["nll_before"] == got["nll_after"] < 0.02


def test_priorities_and_what_is_missing(spark):
    from ductwise.operators import datasets

    rows = spark.createDataFrame([("p", "boiler", 1, 0.9), ("p", "chiller", 0, 0.2), ("p", "tower", 0, None), ("p", "rtu", 0, 0.5), ("q", "boiler", 1, 0.1)], "k string, system string, late int, score double")
    got = {(r.k, r.position): r.system for r in scenarios.by_priority(rows, ["k"], F.col("late"), F.col("score"), F.col("system")).collect()}
    assert [got["p", i] for i in (1, 2, 3, 4)] == ["rtu", "chiller", "tower", "boiler"] and got["q", 1] == "boiler"
    a, b = (spark.createDataFrame([(x,) for x in v], "system string") for v in (["a", "b", "b", None, "c"], ["a", "d"]))
    assert sorted(r.system or "" for r in datasets.missing_from(a, b, "system").collect()) == ["", "b", "c"]
