"""Class statistics, calibration measures, feature pruning and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import softmax


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """N / (K * n_c) for each class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("total_"), F.count("*").alias("k_"))
    return counts.join(F.broadcast(totals)).select(label, "n", (F.col("total_").cast("double") / (F.col("k_") * F.col("n"))).alias("weight"))  # totals: one row


def class_cap(df: DataFrame, label: str, order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows of each class, the first by ``order`` (a hash of the key for a random choice)."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("rank_") <= cap).drop("rank_")


def dense_labels(df: DataFrame, label: str, least: int = 2, how: str = "inner") -> DataFrame:
    """Labels with at least ``least`` rows, renumbered from 0 without gaps; a left join keeps the rows of others, without a number."""
    kept = df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ids = kept.select(label, (F.dense_rank().over(Window.orderBy(label)) - 1).alias("class_id"))  # a row for each label
    return df.join(ids, label, how)


def calibration_bins(df: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """Rows, mean confidence and accuracy of each bin (lo, hi]; confidence 0 is in no bin."""
    b = F.ceil(F.col(confidence) * F.lit(float(bins)))
    return df.where(F.col(confidence) > 0).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def expected_calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    table = calibration_bins(df, confidence, correct, bins)
    return table.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def nll(df: DataFrame, logits: Column, label: Column, temperature: Column) -> DataFrame:
    """Mean negative log likelihood of softmax(logits / T), probabilities within [1e-12, 1]."""
    scaled = F.transform(logits, lambda v: v.cast("double") / temperature)
    p = F.least(F.greatest(F.get(softmax(scaled), label.cast("int")), F.lit(1e-12)), F.lit(1.0))
    return df.agg(F.count("*").alias("n"), F.avg(-F.log(p)).alias("nll"))


#: Likelihood loss and calibration error below which nothing is fitted.
CALIBRATED = (0.02, 0.01)


def fit_temperature(df: DataFrame, logits: Column, label: Column, low: float = 0.05, high: float = 10.0, rounds: int = 3) -> dict:
    """Temperature of least NLL: a log grid for all rows at once, refined around its minimum.

    Skipped for fewer than 8 rows or 2 classes; identity if already calibrated (NLL below ``CALIBRATED[0]`` and calibration error below ``CALIBRATED[1]``), at a bound,
    or without gain.
    """
    k = df.select(F.max(F.size(logits)).alias("k")).first()["k"] or 0
    rows = df.where((label >= 0) & (label < k)).select(F.transform(logits, lambda v: v.cast("double")).alias("z"), label.cast("int").alias("y"))
    n = rows.count()
    if n < 8 or k < 2:
        return {"temperature": 1.0, "status": "skipped", "n_samples": n}

    def curve(temps: list[float]) -> dict[float, float]:
        cols = []
        for i, t in enumerate(temps):
            p = F.get(softmax(F.transform("z", _scale(t))), F.col("y"))
            cols.append(F.avg(-F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0)))).alias(f"t{i}"))
        got = rows.agg(*cols).first()
        return {t: got[i] for i, t in enumerate(temps)}

    before = curve([1.0])[1.0]
    p = softmax(F.col("z"))
    sure = rows.select(F.array_max(p).alias("c"), (F.array_position(p, F.array_max(p)) - 1 == F.col("y")).cast("double").alias("hit"))
    if before < CALIBRATED[0] and expected_calibration_error(sure, "c", "hit").first()["ece"] < CALIBRATED[1]:
        return {"temperature": 1.0, "nll_before": round(before, 6), "nll_after": round(before, 6), "n_samples": n, "status": "identity"}
    a, b, best, after = low, high, 1.0, before
    for _ in range(rounds):
        grid = [a * (b / a) ** (i / 24) for i in range(25)]
        values = curve(grid)
        best = min(grid, key=values.__getitem__)
        after = values[best]
        i = grid.index(best)
        a, b = grid[max(i - 1, 0)], grid[min(i + 1, 24)]
    status = "fitted"
    if best <= low * 1.001 or best >= high * 0.999 or not after <= before + 1e-9:
        best, after, status = 1.0, before, "identity"
    return {"temperature": round(best, 4), "nll_before": round(before, 6), "nll_after": round(after, 6), "n_samples": n, "status": status}


def _scale(t: float):
    return lambda v: v / F.lit(t)


def temperature_grid(df: DataFrame, logits: Column, label: Column, temperatures: list[float]) -> DataFrame:
    """NLL by temperature; the grid is a short list of constants."""
    t = F.explode(F.array(*(F.lit(float(x)) for x in temperatures)))
    rows = df.select(F.transform(logits, lambda v: v.cast("double")).alias("z"), label.cast("int").alias("y"), t.alias("temperature"))
    p = F.get(softmax(F.transform("z", lambda v: v / F.col("temperature"))), F.col("y"))
    return rows.groupBy("temperature").agg(F.avg(-F.log(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0)))).alias("nll"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """precision, recall, f1 and support of each class that is true or predicted somewhere."""
    pairs = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("predicted"), F.col("n").alias("support")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("support")))).alias("s")).select("s.*")
    g = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"))
    precision, recall = (F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col(c)), F.lit(0.0)) for c in ("predicted", "support"))
    g = g.select("label", precision.alias("precision"), recall.alias("recall"), "support")
    return g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def report_averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages and accuracy."""
    s = F.sum("support").cast("double")
    return report.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *((F.sum(F.col(c) * F.col("support")) / s).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")), (F.sum(F.col("recall") * F.col("support")) / s).alias("accuracy"))


def hash_order(key: Column, seed: int = 42) -> Column:
    """32 hexadecimal digits that put keys in a random but repeatable order."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def first_by_hash(df: DataFrame, kind: str, key: Column, limits: DataFrame, seed: int = 42, name: str = "taken", digest: Column | None = None) -> DataFrame:
    """Marks the first ``limit`` rows of each kind in hash order of ``key`` (or of ``digest``, hexadecimal): limits(kind, limit).

    Rows are counted by the first three digits of the hash, which tells for each kind up to which digits all are taken.  Only rows with the digits
    at which its limit is met are shuffled and ranked, so a kind with a third of all rows is no single task and decided rows stay where they are.
    """
    rows = df.withColumn("h_", hash_order(key, seed) if digest is None else digest).withColumn("d_", F.left("h_", F.lit(3)))
    counts = rows.groupBy(F.col(kind).alias("k_"), F.col("d_").alias("e_")).agg(F.count("*").alias("c_"))  # 4096 rows a kind at most
    counts = counts.withColumn("upto_", F.sum("c_").over(Window.partitionBy("k_").orderBy("e_"))).join(limits.select(F.col(kind).alias("l_"), F.col("limit").alias("limit_")), F.col("k_").eqNullSafe(F.col("l_")))
    met = F.when(F.col("upto_") > F.col("limit_"), F.struct("e_", (F.col("limit_") - (F.col("upto_") - F.col("c_"))).alias("room_")))
    marks = counts.groupBy("k_").agg(F.min(met).alias("met_"))  # a row for each kind
    rows = rows.join(marks.withColumn("has_", F.lit(True)), F.col(kind).eqNullSafe(F.col("k_")), "left")
    border = F.coalesce(F.col("d_") == F.col("met_.e_"), F.lit(False))
    sure = F.coalesce(F.col("has_"), F.lit(False)) & F.coalesce(F.col("d_") < F.col("met_.e_"), F.lit(True))
    nth = F.row_number().over(Window.partitionBy(kind).orderBy("h_", key))
    own = [*(F.col(f"`{c}`") for c in df.columns)]
    return rows.where(~border).select(*own, sure.alias(name)).unionByName(rows.where(border).select(*own, (nth <= F.col("met_.room_")).alias(name)))


def stratified_split(df: DataFrame, label: str, key: Column, share: float, seed: int = 42) -> DataFrame:
    """is_val for floor(share * n) rows of each class, at least one, by hash order."""
    limits = df.groupBy(label).agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(share))).alias("limit"))
    return first_by_hash(df, label, key, limits, seed, "is_val")


def nearest_rank(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """The element at index int((n - 1) * p) of the sorted values, from counts of distinct values."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    picks = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * F.lit(p)), F.col(value))).alias(name) for name, p in shares.items()]
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *picks, F.max(value).alias("max"))


def drop_empty_columns(df: DataFrame, least_share: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without columns of at most ``least_share`` non-null values; one pass counts all of them."""
    counts = df.agg(F.count("*").alias("n_"), *(F.count(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if c in keep or counts[c] > least_share * counts["n_"]))


def median_impute(df: DataFrame, value: str, by: list[str] | None = None, name: str = "imputed") -> DataFrame:
    """Nulls take the exact median of the column, or of their group, from counts of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*(by or []), F.col(value).alias("v_")).agg(F.count("*").alias("c_"))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    ranked = counts.withColumn("upto_", F.sum("c_").over(w.orderBy("v_"))).withColumn("n_", F.sum("c_").over(w))
    at = lambda k: F.min(F.when(F.col("upto_") > k, F.col("v_")))
    medians = ranked.groupBy(*(by or [])).agg(((at(F.floor((F.col("n_") - 1) / 2)) + at(F.floor(F.col("n_") / 2))) / 2).alias("median_"))
    joined = df.join(medians, by, "left") if by else df.join(F.broadcast(medians), how="left")  # without groups: one row
    return joined.withColumn(name, F.coalesce(F.col(value), F.col("median_"))).drop("median_")


#: Parts of sensor names that tell their role.
SENSOR_ROLES = {"supply": ("SW_TEMP", "Supply"), "return": ("RW_TEMP", "Return"), "setpoint": ("SPT", "Setpoint", "Set_Point")}


def cross_sensor_features(columns: list[str]) -> dict[str, Column]:
    """Supply less return and value less setpoint for the mean columns of a wide feature table."""
    sensors = [c[: -len("_mean")] for c in columns if c.endswith("_mean")]
    roles = {role: {s for s in sensors if any(mark in s for mark in marks)} for role, marks in SENSOR_ROLES.items()}
    plain = set(sensors) - {s for s in sensors if any(mark in s for mark in ("SPT", "Setpoint"))}
    wanted = [("minus", roles["supply"], roles["return"]), ("spt_deviation", plain, roles["setpoint"])]
    pairs = [(a, name, b) for name, left, right in wanted for a in sensors if a in left for b in sensors if b in right and a != b and a.split("_")[0] in b]
    return {f"{a}_{name}_{b}": F.col(f"{a}_mean") - F.col(f"{b}_mean") for a, name, b in pairs}


def grouping_report(df: DataFrame, dims: list[str], aggs: list[Column]) -> DataFrame:
    """Overall and by each dimension alone: one pass of grouping sets."""
    view = df.groupingSets([[], *([d] for d in dims)], *dims).agg(*aggs, F.grouping_id().cast("long").alias("gid"))
    return view


def compare_runs(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Absolute and percent change against the run before (infinite from zero to positive)."""
    w = Window.partitionBy(*by).orderBy(order) if by else Window.orderBy(order)
    before = F.lag(value).over(w)
    change = F.col(value) - before
    percent = F.when(before != 0, change / F.abs(before) * 100.0).when(F.col(value) > 0, float("inf")).otherwise(0.0)
    return df.select(*by, order, value, change.alias("change"), F.when(before.isNotNull(), percent).alias("percent"))
