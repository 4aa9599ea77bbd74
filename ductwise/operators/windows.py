"""Order-dependent operators: count windows, bounded forward fill, returns, running sets, pairing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """``value`` as double, null where it is not a finite number."""
    v = value.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)


def count_windows(df: DataFrame, by: list[str], order: list[str], size: int = 15, stride: int = 15) -> DataFrame:
    """Rows with window_id and offset: windows of ``size`` rows start every ``stride`` rows; incomplete ones are dropped.

    One shuffle by ``by`` serves the numbering and the count.
    """
    w = Window.partitionBy(*by)
    rows = numbered(df, by, order).withColumn("n_rows_", F.count("*").over(w))
    last = F.floor((F.col("n_rows_") - size) / stride)
    if size == stride:
        rows = rows.withColumn("window_id", F.floor(F.col("rn") / size))
    else:
        low = F.greatest(F.lit(0), F.ceil((F.col("rn") - size + 1) / stride))
        high = F.floor(F.col("rn") / stride)
        ids = F.when(low <= high, F.sequence(low, high))
        rows = rows.withColumn("window_id", F.explode(ids))
    rows = rows.where((F.col("n_rows_") >= size) & (F.col("window_id") <= last))
    return rows.withColumn("offset", F.col("rn") - F.col("window_id") * stride).drop("n_rows_", "rn")


def window_stats(windows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mean, std, min, max, range and slope of the finite values of each window."""
    y, x = finite(F.col(value)), F.col("offset").cast("double")
    seen = F.when(y.isNotNull(), x)
    g = windows.groupBy(*by, "window_id").agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"),
        F.sum(y * x).alias("xy_"), F.sum(seen).alias("x_"), F.sum(seen * seen).alias("xx_"), F.sum(y).alias("y_"),
    )
    den = F.col("n") * F.col("xx_") - F.col("x_") * F.col("x_")
    slope = F.when((F.col("n") > 2) & (F.abs(den) > 1e-12), (F.col("n") * F.col("xy_") - F.col("x_") * F.col("y_")) / den).otherwise(0.0)
    return g.select(*by, "window_id", "n", "mean", "std", "min", "max", F.coalesce(F.col("max") - F.col("min"), F.lit(0.0)).alias("range"), slope.alias("slope"))


def window_centre_time(windows: DataFrame, by: list[str], ts: str = "ts", size: int = 15) -> DataFrame:
    """Hour, weekday (Monday 0) and occupancy (6 to 20 h, Monday to Saturday) at the row in the middle."""
    centre = windows.where(F.col("offset") == size // 2).select(*by, "window_id", F.hour(ts).alias("hour_of_day"), F.weekday(ts).alias("day_of_week"))
    return centre.withColumn("is_occupied", (F.col("hour_of_day").between(6, 20) & (F.col("day_of_week") < 6)).cast("int"))


def forward_fill(df: DataFrame, by: list[str], order: list[str], value: str, limit: int = 5, name: str | None = None) -> DataFrame:
    """Null values take the last value of at most ``limit`` rows before, within a partition."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-limit, 0)
    return df.withColumn(name or value, F.last(value, ignorenulls=True).over(w))


def returns_to_go(df: DataFrame, by: list[str], order: list[str], reward: str, discount: float, name: str = "ret") -> DataFrame:
    """G_t = r_t + discount * G_{t+1}, for discounts from 0 to 1, by window sums.

    Steps go to blocks so long that a reward more than a block away weighs less than 1e-17: a step's return is the
    discounted sum of the rest of its block and of the whole next one.  Columns: by, step, order, name.
    """
    rows = numbered(df, by, order, "step").withColumn("r_", F.col(reward).cast("double"))
    if discount >= 1:
        w = Window.partitionBy(*by).orderBy(F.desc("step"))
        return rows.select(*by, "step", *order, F.sum("r_").over(w).alias(name))
    if discount <= 0:
        return rows.select(*by, "step", *order, F.col("r_").alias(name))
    size = math.ceil(math.log(1e-17) / math.log(discount))
    rows = rows.withColumn("block_", F.floor(F.col("step") / size)).withColumn("at_", F.col("step") % size)
    rows = rows.withColumn("p_", F.col("r_") * F.pow(F.lit(float(discount)), F.col("at_")))
    nxt = rows.groupBy(*by, (F.col("block_") - 1).alias("block_")).agg(F.sum("p_").alias("next_"))
    w = Window.partitionBy(*by, "block_").orderBy(F.desc("at_"))
    whole = (F.sum("p_").over(w) + F.coalesce("next_", F.lit(0.0)) * F.lit(float(discount) ** size)) / F.pow(F.lit(float(discount)), F.col("at_"))
    return rows.join(nxt, [*by, "block_"], "left").select(*by, "step", *order, whole.alias(name))


def step_advantage(df: DataFrame, group: list[str], step: str, ret: str, clip: float = 2.0, leave_one_out: bool = False) -> DataFrame:
    """Return less the mean of the same step of the group (with or without itself), clipped."""
    w = Window.partitionBy(*group, step)
    n, s = F.count(ret).over(w), F.sum(ret).over(w)
    base = F.when(n > 1, (s - F.col(ret)) / (n - 1)).otherwise(F.lit(0.0)) if leave_one_out else s / n
    return df.withColumn("baseline", base).withColumn("advantage", F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col(ret) - F.col("baseline"))))


def repeats(df: DataFrame, by: list[str], key: list[str], order: list[str], beyond: int = 2) -> DataFrame:
    """Rows with their occurrence number of ``key`` and whether it lies beyond the allowed number."""
    w = Window.partitionBy(*by, *key).orderBy(*order)
    return df.withColumn("occurrence", F.row_number().over(w)).withColumn("is_repeat", F.col("occurrence") > beyond)


def deduplicated_ids(df: DataFrame, key: str, order: list[str], name: str = "unique_id") -> DataFrame:
    """Second and later rows of a key get the suffix __dup1, __dup2, ..."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn(name, F.when(k > 0, F.concat(F.col(key).cast("string"), F.lit("__dup"), k.cast("string"))).otherwise(F.col(key).cast("string")))


def consecutive_pairs(df: DataFrame, by: list[str], order: list[str], node: str) -> DataFrame:
    """Edges (src, dst) between neighbours along each path."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select(*by, *order, F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).where("dst IS NOT NULL")


def after_first(df: DataFrame, by: list[str], order: str, condition: Column) -> DataFrame:
    """For each group the rows after the first that meets ``condition``, counted."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("first_", F.min(F.when(condition, F.col(order))).over(w))
    return rows.groupBy(*by).agg(F.count_if(F.col(order) > F.col("first_")).alias("n_after"))


def pair_with_next(df: DataFrame, by: list[str], order: str, opens: Column, closes: Column) -> DataFrame:
    """Each closing row takes the last opening row before it that no other closing row has taken."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("open_", F.last(F.when(opens, F.col(order)), ignorenulls=True).over(w)).where(closes & F.col("open_").isNotNull())
    taken = Window.partitionBy(*by, "open_").orderBy(order)
    return rows.withColumn("k_", F.row_number().over(taken)).where("k_ = 1").select(*by, F.col("open_").alias("call_turn"), F.col(order).alias("result_turn"))


def merge_runs(df: DataFrame, by: list[str], order: str, role: str, text: str, sep: str = "\n") -> DataFrame:
    """Consecutive rows of one role become one row, texts joined in order."""
    w = Window.partitionBy(*by).orderBy(order)
    starts = F.coalesce((F.col(role) != F.lag(role).over(w)).cast("int"), F.lit(0))
    runs = df.withColumn("starts_", starts).withColumn("run", F.sum("starts_").over(w))
    merged = runs.groupBy(*by, "run", role).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("rows_"))
    return merged.select(*by, "run", role, F.size("rows_").alias("n_turns"), F.array_join(F.col(f"rows_.{text}"), sep).alias("merged"))
