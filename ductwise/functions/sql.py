"""The package's scalar functions under SQL names, as SQL-defined temporary functions: the optimizer inlines them, nothing runs in Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .labels import NO_FAULT_LABELS, NO_FAULT_NODES, SIGNS

_NORM = "lower(trim(coalesce({0}, '')))"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _label(x: str) -> str:
    out = _NORM.format(x)
    for pattern, name in SIGNS.items():
        out = f"regexp_replace({out}, {_quoted(pattern)}, '{name}')"
    return f"regexp_replace(regexp_replace({out}, '[^a-z0-9]+', '_'), '^_+|_+$', '')"


_CANONICAL = f"regexp_replace(regexp_replace({_label('{0}')}, '_default$', ''), '^_+|_+$', '')"
_LIST = lambda values: ", ".join(f"'{v}'" for v in values)

#: name -> (parameters, type, body).
FUNCTIONS = {
    "fault_label": ("label STRING", "STRING", _label("label")),
    "canonical_label": ("label STRING", "STRING", _CANONICAL.replace("{0}", "label")),
    "exact_match": ("a STRING, b STRING", "BOOLEAN", f"{_CANONICAL.replace('{0}', 'a')} <> '' AND {_CANONICAL.replace('{0}', 'a')} = {_CANONICAL.replace('{0}', 'b')}"),
    "is_no_fault_label": ("label STRING", "BOOLEAN", f"{_label('label')} IN ({_LIST(NO_FAULT_LABELS)})"),
    "is_no_fault_node": ("node STRING", "BOOLEAN", f"{_NORM.format('node')} IN ({_LIST(NO_FAULT_NODES)})"),
    "mutual_substring": ("a STRING, b STRING", "BOOLEAN", f"{_NORM.format('a')} <> '' AND {_NORM.format('b')} <> '' AND (contains({_NORM.format('a')}, {_NORM.format('b')}) OR contains({_NORM.format('b')}, {_NORM.format('a')}))"),
    "node_system": ("node STRING", "STRING", f"CASE WHEN startswith({_NORM.format('node')}, 'system::') THEN substring({_NORM.format('node')}, 9) WHEN contains({_NORM.format('node')}, '::') THEN substring_index({_NORM.format('node')}, '::', 1) ELSE '' END"),
    "clip01": ("x DOUBLE", "DOUBLE", "least(greatest(x, 0D), 1D)"),
    "confidence_factor": ("c DOUBLE", "DOUBLE", "least(greatest(0.35D + 0.65D * least(greatest(coalesce(c, 0.5D), 0D), 1D), 0D), 1D)"),
    "tempered": ("p DOUBLE, temperature DOUBLE", "DOUBLE", "1D / (1D + exp(-ln(least(greatest(p, 1e-12D), 1D - 1e-12D) / (1D - least(greatest(p, 1e-12D), 1D - 1e-12D))) / temperature))"),
    "difficulty": ("intensity STRING", "STRING", "CASE WHEN try_cast(replace(intensity, '%', '') AS DOUBLE) IS NULL THEN CASE WHEN lower(trim(intensity)) = 'severe' THEN 'easy' ELSE 'medium' END WHEN abs(try_cast(replace(intensity, '%', '') AS DOUBLE)) >= 50 THEN 'easy' WHEN abs(try_cast(replace(intensity, '%', '') AS DOUBLE)) >= 20 THEN 'medium' ELSE 'hard' END"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Define all functions in the session, their names after ``prefix``."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]


#: Views that the tools read, without their prefix.
VIEWS = ("nodes", "edges", "diagnoses", "readings", "health")
#: tool -> (parameters, columns, query over the views {nodes}, {edges}, {diagnoses}, {readings}, {health}).
TABLE_FUNCTIONS = {
    "get_system_overview": ("", "id STRING, name STRING, score DOUBLE, health STRING", "SELECT n.node_id, n.name, h.score, h.health FROM {nodes} n LEFT JOIN {health} h ON h.system_id = n.system_id WHERE n.level = 1"),
    "get_node_children": ("node STRING", "id STRING, name STRING, level INT", "SELECT n.node_id, n.name, n.level FROM {edges} e JOIN {nodes} n ON n.node_id = e.dst WHERE e.src = get_node_children.node AND e.relation = 'has_part'"),
    "get_node_sensors": ("node STRING", "id STRING, name STRING, reading DOUBLE, available BOOLEAN", "SELECT n.node_id, n.name, r.value, r.value IS NOT NULL FROM {edges} e JOIN {nodes} n ON n.node_id = e.dst LEFT JOIN {readings} r ON r.node_id = n.node_id WHERE e.src = get_node_sensors.node AND e.relation = 'has_sensor'"),
    "get_downstream_nodes": ("node STRING", "id STRING, relation STRING, system_id STRING", "SELECT n.node_id, e.relation, n.system_id FROM {edges} e JOIN {nodes} n ON n.node_id = e.dst WHERE e.src = get_downstream_nodes.node AND e.relation IN ('feeds', 'cross_system')"),
    "get_upstream_nodes": ("node STRING", "id STRING, relation STRING", "SELECT e.src, e.relation FROM {edges} e WHERE e.dst = get_upstream_nodes.node AND e.relation IN ('feeds', 'cross_system') UNION ALL SELECT e.src, 'parent_assembly' FROM {edges} e JOIN {nodes} n ON n.node_id = e.src WHERE e.dst = get_upstream_nodes.node AND e.relation = 'has_part' AND n.level = 2"),
    "get_related_systems": ("system STRING", "other_system STRING, direction STRING, connected_via STRING, target_component STRING, medium STRING", "SELECT d.system_id, 'downstream', e.src, e.dst, e.medium FROM {edges} e JOIN {nodes} s ON s.node_id = e.src JOIN {nodes} d ON d.node_id = e.dst WHERE e.relation = 'cross_system' AND s.system_id = get_related_systems.system UNION ALL SELECT s.system_id, 'upstream', e.src, e.dst, e.medium FROM {edges} e JOIN {nodes} s ON s.node_id = e.src JOIN {nodes} d ON d.node_id = e.dst WHERE e.relation = 'cross_system' AND d.system_id = get_related_systems.system"),
    "diagnose_node": ("node STRING", "status STRING, fault_type STRING, confidence DOUBLE, model_source STRING, error STRING", "SELECT CASE WHEN n.node_id IS NULL THEN 'error' ELSE coalesce(d.status, 'unknown') END, d.fault_type, d.confidence, d.model_source, CASE WHEN n.node_id IS NULL THEN concat('node not found: ', coalesce(a.node, '')) ELSE d.error END FROM (SELECT diagnose_node.node AS node) a LEFT JOIN (SELECT DISTINCT node_id FROM {nodes}) n ON n.node_id = a.node LEFT JOIN {diagnoses} d ON d.node_id = n.node_id"),
}


def register_tools(spark: SparkSession, nodes: DataFrame, edges: DataFrame, diagnoses: DataFrame | None = None, readings: DataFrame | None = None, health: DataFrame | None = None, prefix: str = "") -> list[str]:
    """Define the seven tools as SQL table functions over a graph: ``SELECT * FROM get_node_children('x')``, or beside a table by LATERAL.

    diagnoses(node_id, status, fault_type, confidence, model_source, error): the answers of ``oracle.diagnose`` in one scenario; readings(node_id, value) of sensor nodes;
    health(system_id, score, health) from ``tools.anomaly``.  The optimizer inlines the functions, so a call is a join on the views' sources.
    """
    empty = lambda schema: spark.createDataFrame([], schema)
    frames = {
        "nodes": nodes, "edges": edges, "diagnoses": empty("node_id string, status string, fault_type string, confidence double, model_source string, error string") if diagnoses is None else diagnoses,
        "readings": empty("node_id string, value double") if readings is None else readings, "health": empty("system_id string, score double, health string") if health is None else health,
    }
    views = {k: f"{prefix}tool_{k}" for k in VIEWS}
    for k, view in views.items():
        frames[k].createOrReplaceTempView(view)
    for name, (parameters, columns, body) in TABLE_FUNCTIONS.items():
        query = body.format(**views).replace(f"{name}.", f"{prefix}{name}.")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE({columns}) RETURN {query}")
    return [prefix + name for name in TABLE_FUNCTIONS]
