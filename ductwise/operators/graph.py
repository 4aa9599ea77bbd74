"""Equipment graph as two tables: nodes(node_id, level, node_type, system_id, name, seq) and edges(src, dst, relation, medium, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut


def last_writer_edges(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair: the one written last."""
    w = Window.partitionBy("src", "dst").orderBy(F.desc("seq"))
    return edges.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each node id: the one added first."""
    return nodes.withColumn("r_", F.row_number().over(Window.partitionBy("node_id").orderBy("seq"))).where("r_ = 1").drop("r_")


def build(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a Brick description: triples(system_id, s, p, o) of type, hasPart, feeds and hasPoint."""
    node = lambda c: F.concat_ws("::", "system_id", c)
    types = triples.where("p = 'type'").groupBy("system_id", "s").agg(F.min("o").alias("brick_class"))
    relations = {"hasPart": "has_part", "feeds": "feeds", "hasPoint": "has_sensor"}
    edges = None
    for k, (p, relation) in enumerate(relations.items()):
        part = triples.where(F.col("p") == p).select("system_id", node("s").alias("src"), node("o").alias("dst"), F.lit(relation).alias("relation"), F.lit(None).cast("string").alias("medium"), F.lit(k).cast("long").alias("seq"))
        edges = part if edges is None else edges.unionByName(part)
    points = triples.where("p = 'hasPoint'").select("system_id", F.col("o").alias("s")).distinct().withColumn("point_", F.lit(True))
    named = types.select("system_id", "s").unionByName(triples.where("p IN ('hasPart', 'feeds', 'hasPoint')").select("system_id", F.col("o").alias("s"))).distinct()
    nodes = named.join(types, ["system_id", "s"], "left").join(points, ["system_id", "s"], "left")
    nodes = nodes.select(node("s").alias("node_id"), F.when(F.col("point_"), 3).otherwise(2).alias("level"), F.when(F.col("point_"), "sensor").otherwise("component").alias("node_type"), "system_id", F.col("s").alias("name"), F.coalesce("brick_class", F.when(F.col("point_"), "Unknown").otherwise("HVAC_Zone")).alias("brick_class"))
    return nodes, last_writer_edges(edges).drop("system_id")


#: Classes that stand at the top of a system whose parts don't tell its roots.
TOP_CLASSES = ("Water_System", "Hot_Water_System", "AHU", "RTU")


def system_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """system_id, node_id of each system's top components: those of ``roots``, or of ``TOP_CLASSES`` where a system has none."""
    own = nodes.where("level = 2")
    found = roots(own, edges).select("system_id", "node_id")
    return found.unionByName(own.where(F.col("brick_class").isin(*TOP_CLASSES)).join(found.select("system_id"), "system_id", "left_anti").select("system_id", "node_id"))


def building(triples: DataFrame, systems: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, skipped links) of a whole building: the building, its systems(system_id, name), their described parts, and links between them.

    links(source_system, source_node, target_system, target_node, medium).  An end that no node has is the first node, by id, of its system whose name holds the
    wanted one; a link without such a node is skipped.  Of several edges between two nodes the last stays: parts, feeds, sensors, then links.
    """
    parts, inner = build(triples.join(systems.select("system_id"), "system_id", "left_semi"))
    parts, inner = cut(parts), cut(inner)
    top = lambda c: F.concat(F.lit("system::"), c)
    fixed = lambda df, node, level, kind, system, name: df.select(node.alias("node_id"), F.lit(level).alias("level"), F.lit(kind).alias("node_type"), system.cast("string").alias("system_id"), name.alias("name"), F.lit(None).cast("string").alias("brick_class"))
    one = systems.sparkSession.range(1)
    nodes = fixed(one, F.lit("building"), 0, "building", F.lit(None), F.lit("building")).unionByName(fixed(systems, top(F.col("system_id")), 1, "system", F.col("system_id"), F.col("name"))).unionByName(parts)
    edge = lambda df, src, dst, relation, medium, seq: df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), medium.cast("string").alias("medium"), F.lit(seq).cast("long").alias("seq"))
    none = F.lit(None)
    edges = edge(systems, F.lit("building"), top(F.col("system_id")), "has_part", none, -1).unionByName(edge(system_roots(parts, inner), top(F.col("system_id")), F.col("node_id"), "has_part", none, -1)).unionByName(inner.select("src", "dst", "relation", "medium", "seq"))
    known = parts.select("system_id", "node_id", "name")

    def end(rows: DataFrame, side: str) -> DataFrame:
        """The node of one end of each link; names are compared within the link's own system."""
        near = rows.join(known.withColumnRenamed("system_id", f"{side}_system"), f"{side}_system").where(F.contains(F.col("name"), F.col(f"{side}_node")))
        exact = F.col("name") == F.col(f"{side}_node")
        return near.groupBy("link_").agg(F.min(F.struct((~exact).alias("off"), "node_id")).alias("best")).select("link_", F.col("best.node_id").alias(side))

    asked = cut(links.withColumn("link_", F.monotonically_increasing_id()))
    j = asked.join(end(asked, "source"), "link_", "left").join(end(asked, "target"), "link_", "left")
    made = j.where("source IS NOT NULL AND target IS NOT NULL")
    edges = edges.unionByName(edge(made, F.col("source"), F.col("target"), "cross_system", F.col("medium"), 9))
    return nodes, last_writer_edges(edges), j.where("source IS NULL OR target IS NULL").select(*links.columns)


def children(nodes: DataFrame, edges: DataFrame, relation: str = "has_part") -> DataFrame:
    return edges.where(F.col("relation") == relation).select(F.col("src").alias("node_id"), F.col("dst").alias("child")).join(nodes.select(F.col("node_id").alias("child"), "name", "level"), "child")


def downstream(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relation").isin("feeds", "cross_system")).select(F.col("src").alias("node_id"), F.col("dst").alias("target"), "relation", "medium").join(nodes.select(F.col("node_id").alias("target"), "system_id"), "target")


def upstream(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Feeding neighbours, and the assembly a component is part of."""
    feeds = edges.where(F.col("relation").isin("feeds", "cross_system")).select(F.col("dst").alias("node_id"), F.col("src").alias("source"), "relation")
    parents = edges.where("relation = 'has_part'").select(F.col("dst").alias("node_id"), F.col("src").alias("source"), F.lit("parent_assembly").alias("relation"))
    parents = parents.join(nodes.where("level = 2").select(F.col("node_id").alias("source")), "source", "left_semi")
    return feeds.unionByName(parents.select("node_id", "source", "relation"))


def related_systems(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cross-system edges seen from both of their systems."""
    cross = edges.where("relation = 'cross_system'")
    s = nodes.select(F.col("node_id").alias("src"), F.col("system_id").alias("src_system"))
    d = nodes.select(F.col("node_id").alias("dst"), F.col("system_id").alias("dst_system"))
    both = cross.join(s, "src").join(d, "dst")
    down = both.select(F.col("src_system").alias("system_id"), F.lit("downstream").alias("direction"), F.col("dst_system").alias("other_system"), F.col("src").alias("connected_via"), F.col("dst").alias("target_component"), "medium")
    up = both.select(F.col("dst_system").alias("system_id"), F.lit("upstream").alias("direction"), F.col("src_system").alias("other_system"), F.col("src").alias("connected_via"), F.col("dst").alias("target_component"), "medium")
    return down.unionByName(up)


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no one's part and have parts or sensors, or feed no-one's input."""
    part_of = edges.where("relation = 'has_part'").select(F.col("dst").alias("node_id"))
    has = edges.where("relation IN ('has_part', 'has_sensor')").select(F.col("src").alias("node_id")).distinct().withColumn("has_", F.lit(True))
    fed = edges.where("relation = 'feeds'").select(F.col("dst").alias("node_id")).distinct().withColumn("fed_", F.lit(True))
    free = nodes.join(part_of, "node_id", "left_anti").join(has, "node_id", "left").join(fed, "node_id", "left")
    return free.where(F.coalesce("has_", F.lit(False)) | F.col("fed_").isNull()).drop("has_", "fed_")


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.where("relation = 'has_part'").select(F.col("src").alias("node_id")), "node_id", "left_anti")


def ancestors(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node_id, ancestor, hops) up the has_part edges from each start node to the top, first parent by seq; cycles end the walk.

    Each level of hops is written once, so the plan of the next doesn't hold it; there are as many levels as the longest chain has hops.
    """
    parent = cut(edges.where("relation = 'has_part'").groupBy(F.col("dst").alias("at")).agg(F.min_by("src", "seq").alias("parent")))
    front = start.select("node_id", F.col("node_id").alias("at"), F.array("node_id").alias("seen"))
    levels = []
    while True:
        front = front.join(parent, "at").where(~F.array_contains("seen", F.col("parent"))).select("node_id", F.col("parent").alias("at"), F.concat("seen", F.array("parent")).alias("seen"))
        front = cut(front)
        step = front.select("node_id", F.col("at").alias("ancestor"), F.lit(len(levels) + 1).alias("hops"))
        if front.isEmpty():
            return levels[0] if len(levels) == 1 else step if not levels else _union(levels)
        levels.append(step)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bounded_distance(links: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """(source, target, distance) of undirected links (a, b), up to ``depth`` hops from the start nodes (source)."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    reached = front = cut(start.select("source", F.col("source").alias("target"), F.lit(0).alias("distance")).distinct())
    for hop in range(1, depth + 1):
        nxt = front.join(both, front["target"] == both["a"]).select("source", F.col("b").alias("target")).distinct()
        front = cut(nxt.join(reached.select("source", "target"), ["source", "target"], "left_anti").withColumn("distance", F.lit(hop)))
        reached = reached.unionByName(front)
    return reached


def compatibility(distance, same_node, same_system):
    """How well evidence at one node speaks for another: itself 1, one hop .55, two hops .30, same system .18."""
    return F.when(same_node, 1.0).when(distance == 1, 0.55).when(distance == 2, 0.30).when(same_system, 0.18).otherwise(0.0)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by level and edges by relation."""
    a = nodes.groupBy(F.concat(F.lit("level "), F.col("level").cast("string")).alias("kind")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.col("relation").alias("kind")).agg(F.count("*").alias("n")))


def order_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The star schema as an equipment graph: region > nation > supplier / customer > order, parts fed by suppliers."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    key = lambda p, c: F.concat(F.lit(p + "::"), F.col(c).cast("string"))
    plan = [("region", "r_regionkey", "r_name", 0), ("nation", "n_nationkey", "n_name", 1), ("supplier", "s_suppkey", "s_name", 2), ("customer", "c_custkey", "c_name", 2), ("part", "p_partkey", "p_name", 3)]
    nodes = None
    for name, pk, label, level in plan:
        part = t(name).select(key(name, pk).alias("node_id"), F.lit(level).alias("level"), F.lit(name).alias("system_id"), F.col(label).alias("name"))
        nodes = part if nodes is None else nodes.unionByName(part)
    rel = lambda df, s, d, r, m, k: df.select(s.alias("src"), d.alias("dst"), F.lit(r).alias("relation"), F.lit(m).alias("medium"), F.lit(k).cast("long").alias("seq"))
    edges = rel(t("nation"), key("region", "n_regionkey"), key("nation", "n_nationkey"), "has_part", "", 0)
    edges = edges.unionByName(rel(t("supplier"), key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "has_part", "", 1))
    edges = edges.unionByName(rel(t("customer"), key("nation", "c_nationkey"), key("customer", "c_custkey"), "has_part", "", 2))
    lines = t("lineitem").select("l_suppkey", "l_partkey").distinct()
    edges = edges.unionByName(rel(lines, key("supplier", "l_suppkey"), key("part", "l_partkey"), "feeds", "goods", 3))
    return nodes, edges
