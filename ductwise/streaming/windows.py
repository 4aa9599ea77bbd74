"""Streaming variants: time windows with watermark, sessions, late rows in a table of their own, and the evidence state machine keyed by episode."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.potential import STEP, TRACE, start, state_json, step, trust


def time_windows(events: DataFrame, by: list[str], ts: str = "ts", value: str = "value", size: str = "15 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Statistics of event-time windows; rows later than the watermark are dropped. On gap-free minutes equal to count windows of 15."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w.alias("window"), *by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return g.select(*by, F.col("window.start").alias("window_start"), "n", "mean", "std", "min", "max")


def sessions(events: DataFrame, by: list[str], ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    g = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), *by).agg(F.count("*").alias("n"))
    return g.select(*by, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def potential_trace(steps: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The batch fold as a stateful stream: state is one JSON string an episode, steps of a batch are taken in order.

    A step that comes after a later one of its episode was folded isn't folded any more: its row has the mode 'late' and no values.
    With ``idle_ms`` an episode without steps for so long (processing time) loses its state: set it for streams that never end. A run
    over what is available now must leave it out, because Spark makes batches for such timeouts without end.
    """
    names = [x.split()[0] for x in TRACE.split(", ")]
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own, last = (json.loads(state.get[0]), state.get[1]) if state.exists else (start(), -(2**31))
        rows = []
        for r in pd.concat(list(frames)).sort_values("step", kind="stable").to_dict("records"):
            row = {"mode": "late"}
            if r["step"] > last:
                targets, last = r["targets"], r["step"]
                own, row = step(own, r["tool"], {k: plain(v) for k, v in r.items() if k != "targets"} | {"targets": list(targets) if targets is not None else []})
            rows.append({n: (row | {"episode_id": r["episode_id"], "step": r["step"]}).get(n) for n in names})
        state.update((state_json(own), int(last)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=names)

    rows = steps.withColumn("trust", trust(steps.columns)).select(*STEP)
    return rows.groupBy("episode_id").applyInPandasWithState(fold, TRACE, "state string, last long", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


#: What the state machine with timers gives: the trace, and whether the row closes its episode.
TIMED = f"{TRACE}, final boolean"
_TIMED = [x.split()[0] for x in TIMED.split(", ")]


class EpisodeMachine(StatefulProcessor):
    """Folds an episode's steps in order; typed state, and an event-time timer that emits what an idle episode has come to and forgets it.

    The values are the mode, the potential, the last step, the latest event time, and the candidates with their beliefs; the links are a map of nodes, so a step
    doesn't rewrite them all.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("episode", "mode string, potential double, last int, seen long, candidates array<string>, beliefs array<double>")
        self.links = handle.getMapState("links", "node string", "others array<string>")

    def _state(self) -> tuple[dict, int, int]:
        own = start()
        if not self.value.exists():
            return own, -(2**31), -1
        mode, potential, last, seen, candidates, beliefs = self.value.get()
        names = list(candidates)
        own |= {"mode": mode, "potential": potential, "candidates": names, "belief": dict(zip(names, beliefs)), "links": {k[0]: set(v[0]) for k, v in self.links.iterator()}}
        return own, last, seen

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own, last, seen = self._state()
        known, out, before = own["links"], [], seen
        plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v
        for r in pd.concat(list(rows)).sort_values("step", kind="stable").to_dict("records"):
            row = {"mode": "late"}
            if r["step"] > last:
                targets, last = r["targets"], int(r["step"])
                own, row = step(own, r["tool"], {k: plain(v) for k, v in r.items() if k not in ("targets", "seen_ms")} | {"targets": list(targets) if targets is not None else []})
            seen = max(seen, int(r["seen_ms"]))
            out.append({n: (row | {"episode_id": key[0], "step": r["step"], "final": False}).get(n) for n in _TIMED})
        for node, others in own["links"].items():
            if known.get(node) != others:
                self.links.updateValue((node,), (sorted(others),))
        names = own["candidates"]
        self.value.update((own["mode"], float(own["potential"]), last, seen, names, [float(own["belief"].get(n, 0.0)) for n in names]))
        if seen != before:
            if before >= 0:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(seen + self.idle_ms)
        yield pd.DataFrame(out, columns=_TIMED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own, last, _ = self._state()
        belief = own["belief"]
        row = {"episode_id": key[0], "step": last, "potential": own["potential"], "mode": own["mode"], "top_candidate": max(belief, key=belief.get) if belief else "", "top_belief": max(belief.values(), default=0.0), "n_candidates": len(own["candidates"]), "final": True}
        self.value.clear()
        self.links.clear()
        yield pd.DataFrame([{n: row.get(n) for n in _TIMED}], columns=_TIMED)

    def close(self) -> None:
        pass


#: The store that typed state needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def timed_trace(steps: DataFrame, ts: str = "ts", idle: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``potential_trace`` of steps with an event time, columns ``TIMED``: an episode without a step for ``idle`` gives a last row with what it has come to, once, and is forgotten.

    Needs the session setting ``STATE_STORE``.  A step after the watermark that belongs to a forgotten episode begins a new one.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = steps.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).withColumn("trust", trust(steps.columns))
    rows = rows.select(*STEP, ts, F.unix_millis(ts).alias("seen_ms"))
    return rows.groupBy("episode_id").transformWithStateInPandas(EpisodeMachine(idle_ms), TIMED, "append", "eventTime")


def late_splitter(path: str, ts: str = "ts", late: str = "10 minutes"):
    """A function for ``foreachBatch``: every row goes to ``path``/rows with a flag ``late``, and each batch's counts to ``path``/marks.

    A row is late if it is older than ``late`` before the newest row of all batches before its own, which is the watermark that windows drop it by.  A batch
    overwrites its own files, so one that is run again counts once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/marks/batch_id="
        newest = spark.read.parquet(f"{marks}{batch_id - 1}").first()["newest"] if batch_id else None  # one row
        t = F.col(ts).cast("timestamp")
        old = F.coalesce(t < F.lit(newest) - F.expr(f"INTERVAL {late}"), F.lit(False)) if newest is not None else F.lit(False)
        seen = Observation()
        rows = batch.withColumn("late", old).observe(seen, F.max(t).alias("newest"), F.count(F.lit(1)).alias("n_rows"), F.count_if("late").alias("n_late"))
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
        got = seen.get
        latest = max((x for x in (newest, got.get("newest")) if x is not None), default=None)
        spark.createDataFrame([(latest, got.get("n_rows") or 0, got.get("n_late") or 0)], "newest timestamp, n_rows long, n_late long").coalesce(1).write.mode("overwrite").parquet(f"{marks}{batch_id}")

    return run


def late_counts(marks: DataFrame) -> DataFrame:
    """One row: rows and late rows of all batches, and the share that windows would drop."""
    return marks.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_late").alias("n_late")).withColumn("late_share", F.try_divide(F.col("n_late"), F.col("n_rows")))
