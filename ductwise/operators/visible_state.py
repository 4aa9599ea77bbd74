"""What an agent has seen so far: a fold of observations to nodes, edges, candidates, frontier and checked nodes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import ABNORMAL

#: Action kinds of the tools.
ACTIONS = {
    "get_system_overview": "ground", "get_node_children": "expand", "get_downstream_nodes": "trace", "get_upstream_nodes": "trace",
    "get_related_systems": "trace", "get_node_sensors": "verify", "diagnose_node": "verify",
}
STATE = "conv_id string, turn int, action string, n_nodes int, n_edges int, nodes array<string>, edges array<string>, candidates array<string>, frontier array<string>, checked array<string>"


def action(tool: Column) -> Column:
    """Kind of action of a turn; without a tool it concludes."""
    out = F.when(tool.isNull(), "conclude")
    for name, kind in ACTIONS.items():
        out = out.when(tool == name, kind)
    return out.otherwise("other")


def fold(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, tool, node_id, status, fault_type, targets array<string>) to the state after each turn. Columns: ``STATE``."""

    names = [c.split()[0] for c in STATE.split(", ")]
    lists = {"nodes": 8, "edges": 8, "candidates": 4, "frontier": 4, "checked": 8}

    def add(to: dict, item: str) -> None:
        if item:
            to.setdefault(item)  # in order of first appearance

    def run(batches):
        current, seen = None, {}
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in names}
            for r in batch.to_pylist():
                if r["conv_id"] != current:
                    current, seen = r["conv_id"], {n: {} for n in lists}
                tool, node, targets, status = r["tool"], r["node_id"] or "", r["targets"] or [], (r["status"] or "").lower()
                if status != "error":
                    for t in [node, *targets]:
                        add(seen["nodes"], t)
                    if ACTIONS.get(tool) in ("expand", "trace"):
                        for t in targets:
                            add(seen["edges"], f"{t}>{node}" if tool == "get_upstream_nodes" else f"{node}>{t}")
                            add(seen["frontier"], t)
                    elif ACTIONS.get(tool) == "verify":
                        add(seen["checked"], node)
                        if tool == "diagnose_node":
                            seen["frontier"].pop(node, None)
                            if status in ABNORMAL:
                                add(seen["candidates"], f"{node}:{r['fault_type'] or ''}")
                kind = "conclude" if tool is None else ACTIONS.get(tool, "other")
                for n, v in (("conv_id", current), ("turn", r["turn"]), ("action", kind), ("n_nodes", len(seen["nodes"])), ("n_edges", len(seen["edges"])), *((n, list(seen[n])[-k:]) for n, k in lists.items())):
                    rows[n].append(v)
            kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds[c.split()[1]]) for n, c in zip(names, STATE.split(", "))], names)

    rows = turns.select("conv_id", "turn", "tool", "node_id", "status", "fault_type", "targets")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn").mapInArrow(run, STATE)
