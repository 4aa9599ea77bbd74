"""Classifiers on window features: training, calibrated prediction, prediction from single readings."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import clip, softmax
from .lineage import cut
from .statistics import class_weights, dense_labels, first_by_hash, stratified_split

#: Probability from which a node is responsible, and windows that its model needs of either kind.
RESPONSIBLE, LEAST_WINDOWS = 0.60, 4


def wide_features(stats: DataFrame, by: list[str], sensor: str, sensors: list[str], measures: tuple[str, ...] = ("mean", "std", "min", "max", "range", "slope")) -> DataFrame:
    """Long window statistics to one row a window with a column for each sensor and measure."""
    return stats.groupBy(*by).pivot(sensor, sensors).agg(*(F.first(m).alias(m) for m in measures))


def _capped(rows: DataFrame, label: str, key: Column, cap: int, seed: int) -> DataFrame:
    limits = rows.select(label).distinct().withColumn("limit", F.lit(cap))
    return first_by_hash(rows, label, key, limits, seed, "taken_").where("taken_").drop("taken_")


def _prepared(features: DataFrame, columns: list[str], label: str, key: Column, val_share: float, seed: int) -> DataFrame:
    """Renumbered labels, medians for gaps, the split, and the vector of features."""
    rows = dense_labels(features, label, how="left")
    rows = Imputer(inputCols=columns, outputCols=columns, strategy="median").fit(rows.where("class_id IS NOT NULL")).transform(rows)
    rows = stratified_split(rows, label, key, val_share, seed).withColumn("is_val", F.when(F.col("class_id").isNotNull(), F.col("is_val")))
    return VectorAssembler(inputCols=columns, outputCol="features_", handleInvalid="keep").transform(rows)


def _boosted(fitted: DataFrame, target: Column, rounds: int, depth: int, step: float, gain: float, seed: int) -> GBTClassificationModel:
    """Trees for one yes-or-no question; boosting ends before ``rounds`` once held-out loss falls by less than ``gain``. Both answers weigh the same."""
    rows = fitted.withColumn("target_", target.cast("double"))
    n = {r["target_"]: r["count"] for r in rows.where("NOT is_val").groupBy("target_").count().collect()}  # two rows
    weight = F.when(F.col("target_") == 1, sum(n.values()) / (2.0 * max(n.get(1.0, 0), 1))).otherwise(sum(n.values()) / (2.0 * max(n.get(0.0, 0), 1)))
    gbt = GBTClassifier(featuresCol="features_", labelCol="target_", weightCol="weight_", validationIndicatorCol="is_val", maxIter=rounds, maxDepth=depth, stepSize=step, validationTol=gain, seed=seed)
    return gbt.fit(rows.withColumn("weight_", weight))


def train_boosted(features: DataFrame, columns: list[str], label: str, key: Column, cap: int = 2500, val_share: float = 0.15, rounds: int = 60, depth: int = 4, step: float = 0.15, gain: float = 0.001, seed: int = 42) -> dict:
    """Boosted trees, one against the rest for each class, each stopped early on the held-out part; else like ``train``.

    Probabilities are the classes' own ones, scaled to a sum of one. ``rounds_used`` tells where each class stopped.
    """
    rows = cut(_prepared(features, columns, label, key, val_share, seed))
    fitted = cut(_capped(rows.where("NOT is_val"), label, key, cap, seed).unionByName(_capped(rows.where("is_val"), label, key, cap, seed)))
    names = [r[label] for r in rows.where("class_id IS NOT NULL").select("class_id", label).distinct().orderBy("class_id").collect()]
    made = [_boosted(fitted, F.col("class_id") == k, rounds, depth, step, gain, seed) for k in range(len(names))]
    return {"models": made, "labels": names, "feature_cols": columns, "rounds_used": [m.getNumTrees for m in made], "scored": boosted_scores(made, rows).drop("features_")}


def boosted_scores(models: list[GBTClassificationModel], rows: DataFrame) -> DataFrame:
    """``rows`` (with features_) with probabilities in the order of the models."""
    out = rows
    for k, m in enumerate(models):
        m = m.copy().setProbabilityCol(f"p{k}_").setRawPredictionCol(f"r{k}_").setPredictionCol(f"y{k}_")
        out = m.transform(out).withColumn(f"p{k}_", vector_to_array(f"p{k}_")[1]).drop(f"r{k}_", f"y{k}_")
    own = [F.col(f"p{k}_") for k in range(len(models))]
    total = F.greatest(sum(own, F.lit(0.0)), F.lit(1e-12))
    return out.select(*rows.columns, F.array(*(p / total for p in own)).alias("probabilities"))


def train_responsible(features: DataFrame, columns: list[str], label: str, key: Column, fault_nodes: dict[str, str], cap: int = 2500, val_share: float = 0.15, rounds: int = 60, depth: int = 3, step: float = 0.15, gain: float = 0.001, seed: int = 42) -> dict[str, dict]:
    """A yes-or-no model for each node of fault_nodes(label -> node): is it the cause of a window's fault?  Nodes are few, so they are trained in turn.

    A node with fewer than ``LEAST_WINDOWS`` windows of either kind has none; the others' models have threshold and windows beside them.
    """
    out: dict[str, dict] = {}
    for node in sorted(set(fault_nodes.values())):
        own = [name for name, n in fault_nodes.items() if n == node and name.lower() != "normal"]
        rows = features.withColumn("asked_", F.when(F.col(label).isin(*own), "yes").when(F.col(label).isNotNull(), "no"))
        n = {r["asked_"]: r["count"] for r in rows.groupBy("asked_").count().collect()}
        found = {"node_id": node, "positive": n.get("yes", 0), "negative": n.get("no", 0), "threshold": RESPONSIBLE}
        if min(found["positive"], found["negative"]) < LEAST_WINDOWS:
            out[node] = found | {"status": "skipped"}
            continue
        rows = cut(_prepared(rows, columns, "asked_", key, val_share, seed))
        fitted = cut(_capped(rows.where("NOT is_val"), "asked_", key, cap, seed).unionByName(_capped(rows.where("is_val"), "asked_", key, cap, seed)))
        out[node] = found | {"status": "trained", "model": _boosted(fitted, F.col("asked_") == "yes", rounds, depth, step, gain, seed)}
    return out


def responsible_answers(trained: dict[str, dict], rows: DataFrame, columns: list[str], key: str, threshold: float = RESPONSIBLE) -> DataFrame:
    """key, node_id, status, fault_type, confidence of every window and trained node: Fault from the threshold on, else Normal.

    Gaps count as 0; the fault's name isn't known to a node's model.
    """
    rows = VectorAssembler(inputCols=columns, outputCol="features_", handleInvalid="keep").transform(rows.fillna(0.0, subset=columns))
    out = None
    for node, t in sorted(trained.items()):
        if t["status"] == "trained":
            p = F.get("probabilities", F.lit(0))
            m = t["model"].copy().setProbabilityCol("p_").setRawPredictionCol("r_").setPredictionCol("y_")
            part = m.transform(rows).select(key, F.lit(node).alias("node_id"), F.array(vector_to_array("p_")[1]).alias("probabilities"))
            part = part.select(key, "node_id", F.when(p >= threshold, "Fault").otherwise("Normal").alias("status"), F.lit("None").alias("fault_type"), F.round(F.when(p >= threshold, p).otherwise(1 - p), 4).alias("confidence"))
            out = part if out is None else out.unionByName(part)
    return rows.select(key, *(F.lit(None).cast(t).alias(c) for c, t in (("node_id", "string"), ("status", "string"), ("fault_type", "string"), ("confidence", "double")))).limit(0) if out is None else out


MANIFEST = "name string, kind string, labels array<string>, feature_cols array<string>, n_models int, threshold double, temperature double, status string"


def save_models(spark, models: dict[str, dict], path: str) -> None:
    """Write models to a folder of the cluster's shared storage, and last a manifest with a row for each, so a manifest never names what isn't there."""
    rows = []
    for name, m in sorted(models.items()):
        parts = m.get("models") or [m[k] for k in ("model",) if k in m]
        for k, part in enumerate(parts):
            part.write().overwrite().save(f"{path}/{name.replace('::', '__')}/{k}")
        kind = type(parts[0]).__name__ if parts else ""
        rows.append((name, kind, m.get("labels"), m.get("feature_cols"), len(parts), m.get("threshold"), float(m.get("temperature", 1.0)), m.get("status", "trained")))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def manifest(spark, path: str) -> DataFrame:
    """What is known of saved models without loading one, and whether each can answer."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("ready", (F.col("n_models") > 0) & (F.coalesce(F.size("labels"), F.lit(1)) > 0))


def load_models(spark, path: str, name: str) -> list:
    """The models of one name, in the order of its labels."""
    from pyspark.ml.classification import RandomForestClassificationModel

    row = manifest(spark, path).where(F.col("name") == name).first()
    if row is None:
        raise KeyError(f"the manifest has no model named {name}")
    reader = {c.__name__: c for c in (GBTClassificationModel, RandomForestClassificationModel)}[row["kind"]] if row["n_models"] else None
    return [reader.load(f"{path}/{name.replace('::', '__')}/{k}") for k in range(row["n_models"])]


def train(features: DataFrame, columns: list[str], label: str, key: Column, cap: int = 2500, val_share: float = 0.15, trees: int = 40, depth: int = 8, seed: int = 42) -> dict:
    """Renumber labels, split by class, cap the classes of the part to fit, weight classes, fit a forest. Returns the model, its labels and all rows with predictions.

    The cap holds for fitting alone. ``is_val`` is null for rows whose label is not learnt; they are scored too.
    """
    rows = _prepared(features, columns, label, key, val_share, seed)
    fitted = _capped(rows.where("NOT is_val"), label, key, cap, seed)
    weights = class_weights(fitted, label).select(label, "weight")
    forest = RandomForestClassifier(featuresCol="features_", labelCol="class_id", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="probability_", rawPredictionCol="raw_", predictionCol="prediction_")
    model = forest.fit(fitted.join(weights, label))
    scored = model.transform(rows)
    names = [r[label] for r in rows.where("class_id IS NOT NULL").select("class_id", label).distinct().orderBy("class_id").collect()]
    return {"model": model, "labels": names, "feature_cols": columns, "scored": scored.select(*[c for c in rows.columns if c != "features_"], vector_to_array("probability_").alias("probabilities"))}


def calibrated(probabilities: Column, temperature: float) -> Column:
    """Softmax of log p over T; of two classes the same as the tempered logit."""
    return softmax(F.transform(probabilities, lambda p: F.log(F.greatest(p.cast("double"), F.lit(1e-12))) / F.lit(temperature)))


def verdict(probabilities: Column, labels: list[str]) -> Column:
    """struct(status, fault_type, confidence) of an array of class probabilities."""
    names = F.array(*map(F.lit, labels))
    k = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    label = F.element_at(names, k)
    normal = (label == "Normal") | (k == 1)
    return F.struct(F.when(normal, "Normal").otherwise("Fault").alias("status"), F.when(normal, "None").otherwise(label).alias("fault_type"), F.round(F.array_max(probabilities), 4).alias("confidence"))


def from_readings(readings: Column, columns: list[str], least: float = 0.60) -> Column:
    """struct(features, coverage, usable): a feature's reading, or its base sensor's (without the last part), or 0."""
    def one(c: str) -> Column:
        return F.coalesce(F.try_element_at(readings, F.lit(c)), F.try_element_at(readings, F.lit(c.rsplit("_", 1)[0])))

    found = [one(c) for c in columns]
    coverage = sum((F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in found), F.lit(0.0)) / max(len(columns), 1)
    return F.struct(F.array(*(F.coalesce(x.cast("double"), F.lit(0.0)) for x in found)).alias("features"), coverage.alias("coverage"), (coverage >= least).alias("usable"))


def responsible(label: Column, fault_nodes: DataFrame) -> DataFrame:
    """fault_nodes(system_id, fault_label, node_id) with a binary target for each node: does a label map to it."""
    return fault_nodes.withColumn("target", (F.col("fault_label") == label).cast("int"))


def guarded_readings(readings: Column, wet_below: float = -2.0) -> Column:
    """Physical guards on a map of readings: a wet bulb not above its dry bulb, no negative flows."""
    def fix(name: Column, v: Column) -> Column:
        dry = F.try_element_at(readings, F.replace(name, F.lit("_WB"), F.lit("")))
        wet = name.endswith("_WB") & dry.isNotNull() & (v > dry)
        return F.when(wet, dry + F.lit(wet_below)).when(name.rlike("CFM|FLOW|GPM") & (v < 0), 0.0).otherwise(v)

    return F.transform_values(readings, fix)


def window_readings(rows: DataFrame, by: list[str], sensors: list[str]) -> DataFrame:
    """Mean reading of each sensor over a group's rows; what is no number counts as missing."""
    pairs = [x for s in sensors for x in (F.lit(s), F.round(F.avg(F.col(s).try_cast("double")), 4))]
    made = rows.groupBy(*by).agg(F.create_map(*pairs).alias("readings"))
    return made.withColumn("readings", F.map_filter("readings", lambda _, v: v.isNotNull()))


def tempered(confidence: Column, temperature: float) -> Column:
    odds = F.log(clip(confidence, 1e-12, 1 - 1e-12) / (1 - clip(confidence, 1e-12, 1 - 1e-12)))
    return 1 / (1 + F.exp(-odds / F.lit(temperature)))


def train_systems(features: DataFrame, systems: list[str], columns: list[str], label: str, key: Column, **options) -> dict[str, dict]:
    """A model for each system of features(system_id, …); one with less than two labels has none. Systems are few, so they are trained in turn."""
    out = {}
    for system in systems:
        rows = features.where(F.col("system_id") == system)
        if rows.groupBy(label).count().where("count >= 2").count() >= 2:
            out[system] = train(rows, columns, label, key, **options)
    return out


def registry(models: dict[str, dict]) -> dict[str, dict]:
    """What is known of each trained model without loading it: labels, columns, and whether it can answer."""
    return {k: {"labels": m["labels"], "feature_cols": m["feature_cols"], "ready": bool(m["labels"])} for k, m in models.items()}
