"""Scenarios: drawn windows of fault files, cross-system pairs, derived variants, paths and prompts, all by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import difficulty
from .datasets import window_starts
from .statistics import first_by_hash, hash_order


def hash_number(key: Column, seed: int = 42) -> Column:
    """A number below 2^48 from the key's md5."""
    return F.conv(F.left(hash_order(key, seed), F.lit(12)), 16, 10).cast("long")


def draw(key: Column, values: list[str], seed: int = 42) -> Column:
    """One of the values by hash of the key."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(hash_number(key, seed), F.lit(len(values))) + 1).cast("int"))


def single_system(files: DataFrame, per_fault: int = 5, clean_most: int = 3, size: int = 15, seed: int = 42) -> DataFrame:
    """files(system_id, file, fault_type, fault_intensity, node_id, n_rows) to windows with ids; fault-free files have at most ``clean_most``."""
    drawn = window_starts(files, per_fault, size, seed=seed)
    clean = F.col("fault_type") == "normal"
    rows = drawn.where(~clean | (F.col("draw") < clean_most))
    return rows.select(
        F.concat_ws("_", "system_id", "fault_type", "fault_intensity", F.col("draw").cast("string")).alias("scenario_id"), F.when(clean, "no_fault").otherwise("single_system").alias("scenario_type"),
        F.col("system_id").alias("root_cause_system"), F.col("node_id").alias("root_cause_node"), "fault_type", "fault_intensity", F.array("system_id").alias("affected_systems"),
        F.col("file").alias("source_file"), F.col("start").alias("time_window_start"), (F.col("start") + size).alias("time_window_end"), difficulty(F.col("fault_intensity")).alias("difficulty"),
    )


def cross_system(single: DataFrame, links: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Faults of upstream systems with a reachable downstream system: the n pairs of least hash. links(system_id, downstream)."""
    pairs = single.where("scenario_type = 'single_system'").join(links, F.col("root_cause_system") == F.col("system_id"))
    order = [hash_order(F.concat_ws("|", "scenario_id", "downstream"), seed), "scenario_id", "downstream"]
    rank = F.row_number().over(Window.orderBy(*order))
    picked = pairs.orderBy(*order).limit(n)  # the feature: n scenarios
    return picked.withColumn("k_", rank).select(F.concat(F.lit("cross_"), F.col("k_").cast("string"), F.lit("_"), F.col("scenario_id")).alias("scenario_id"), F.lit("cross_system").alias("scenario_type"), "root_cause_system", "root_cause_node", "fault_type", "fault_intensity", F.array("root_cause_system", "downstream").alias("affected_systems"), "source_file", "time_window_start", "time_window_end", "difficulty")


def derived(base: DataFrame) -> DataFrame:
    """Ambiguous (a_) and low-confidence (na_lc_, a_lc_) variants of fault scenarios."""
    faults = base.where("scenario_type IN ('single_system', 'cross_system')")
    out = None
    for prefix, kind in (("a_", F.concat(F.lit("a_"), F.col("scenario_type"))), ("na_lc_", F.lit("na_low_confidence")), ("a_lc_", F.lit("a_low_confidence"))):
        part = faults.withColumn("scenario_id", F.concat(F.lit(prefix), F.col("scenario_id"))).withColumn("scenario_type", kind)
        out = part if out is None else out.unionByName(part)
    return out


def no_fault(clean: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(scenario_id, root_cause_system): the system's fault-free windows in turn (round robin)."""
    pool = clean.where("fault_type = 'normal'").select("root_cause_system", "source_file", "time_window_start", "time_window_end", (F.row_number().over(Window.partitionBy("root_cause_system").orderBy("scenario_id")) - 1).alias("k_"), F.count("*").over(Window.partitionBy("root_cause_system")).alias("n_"))
    sizes = pool.groupBy("root_cause_system").agg(F.max("n_").alias("n_"))
    asked = wanted.join(sizes, "root_cause_system").withColumn("k_", (F.row_number().over(Window.partitionBy("root_cause_system").orderBy("scenario_id")) - 1) % F.col("n_"))
    return asked.drop("n_").join(pool.drop("n_"), ["root_cause_system", "k_"]).select(F.concat(F.lit("nf_"), F.col("scenario_id")).alias("scenario_id"), F.lit("na_no_fault").alias("scenario_type"), "root_cause_system", "source_file", "time_window_start", "time_window_end")


def diagnostic_path(steps: Column, root: Column, most: int = 6) -> Column:
    """Steps without the root, thinned evenly in the middle to ``most`` nodes, and the root at the end."""
    others = F.array_distinct(F.array_remove(steps, root))
    n, room = F.size(others), most - 1
    stride = F.greatest(F.ceil((n - 1) / F.lit(float(room - 1))), F.lit(1)).cast("int")
    middle = F.slice(F.filter(F.slice(others, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda _, i: i % stride == 0), 1, room - 1)
    return F.concat(F.when(n <= room, others).otherwise(F.concat(F.slice(others, 1, 1), middle)), F.array(root))


#: Wordings by scenario type; {system} and {symptom} are filled in.
PROMPTS = {
    "single_system": ["Readings of {system} look wrong: {symptom}. Find out why.", "{symptom} was reported at {system}. What is the cause?", "Please look into {system}; operators noticed {symptom}."],
    "cross_system": ["{symptom} shows at {system}, but the origin may lie elsewhere. Trace it.", "Follow {symptom} at {system} back to where it starts."],
    "no_fault": ["A routine check of {system} is due. Is anything wrong?", "Someone suspects {system}. Confirm whether it runs as it should."],
    "ambiguous": ["Occupants complain of {symptom}. Where does it come from?", "{symptom} somewhere in the building. Investigate."],
}


def prompt(kind: Column, system: Column, symptom: Column, key: Column, seed: int = 42) -> Column:
    """A wording of the scenario's type by hash of its key; ambiguous ones never name the system."""
    family = F.when(kind.startswith("a_"), "ambiguous").when(F.contains(kind, F.lit("no_fault")), "no_fault").when(F.contains(kind, F.lit("cross")), "cross_system").otherwise("single_system")
    out = None
    for name, texts in PROMPTS.items():
        out = F.when(family == name, draw(key, texts, seed)) if out is None else out.when(family == name, draw(key, texts, seed))
    return F.replace(F.replace(out, F.lit("{system}"), system), F.lit("{symptom}"), symptom)


def leaks(text: Column, aliases: list[str]) -> Column:
    """Does a prompt name a system: a leading tag or any alias."""
    return text.rlike(r"^\s*\[[^\]]+\]") | F.exists(F.array(*map(F.lit, aliases)), lambda a: F.contains(F.lower(text), a))


def sample(scenarios: DataFrame, shares: dict[str, float], n_total: int, seed: int = 42) -> DataFrame:
    """int(n_total * share) scenarios of each type in hash order, taken in turn again where a type has too few; ids get the type and a number.

    A type without scenarios gives none.
    """
    targets = scenarios.sparkSession.createDataFrame([(k, int(n_total * v)) for k, v in shares.items()], "scenario_type string, target_ long")
    sizes = scenarios.groupBy("scenario_type").agg(F.count("*").alias("n_"))
    taken = first_by_hash(scenarios, "scenario_type", F.col("scenario_id"), targets.withColumnRenamed("target_", "limit"), seed, "taken_").where("taken_").drop("taken_")
    # only what is taken is ranked: a type's target at most
    nth = F.row_number().over(Window.partitionBy("scenario_type").orderBy(hash_order(F.col("scenario_id"), seed), "scenario_id")) - 1
    pool = taken.withColumn("k_", nth).join(targets, "scenario_type").join(sizes, "scenario_type")
    turns = F.sequence(F.lit(0), F.floor((F.col("target_") - 1 - F.col("k_")) / F.col("n_")))
    rows = pool.withColumn("t_", F.explode(turns)).withColumn("i_", F.col("k_") + F.col("t_") * F.col("n_"))
    return rows.withColumn("scenario_id", F.concat_ws("_", "scenario_id", "scenario_type", F.col("i_").cast("string"))).select(*scenarios.columns)


def by_priority(candidates: DataFrame, by: list[str], priority: Column, score: Column, key: Column) -> DataFrame:
    """Adds position: candidates of a group in order of priority, then of falling score, then of key."""
    return candidates.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(priority, score.desc_nulls_last(), key)))


def no_fault_paths(scenarios: DataFrame, components: DataFrame, seed: int = 42) -> DataFrame:
    """scenario_id and two or three components of its system, in hash order: what a routine check looks at. components(system_id, node_id)."""
    ranked = components.withColumn("k_", F.row_number().over(Window.partitionBy("system_id").orderBy(hash_order(F.col("node_id"), seed), "node_id")) - 1).withColumn("n_", F.count("*").over(Window.partitionBy("system_id")))
    sizes = ranked.groupBy("system_id").agg(F.max("n_").alias("n_"))
    h = hash_number(F.col("scenario_id"), seed)
    wanted = scenarios.join(sizes, F.col("root_cause_system") == F.col("system_id")).withColumn("t_", F.explode(F.sequence(F.lit(0), F.least(1 + F.pmod(h, F.lit(2)), F.col("n_") - 1))))
    picks = wanted.withColumn("k_", F.pmod(h + F.col("t_"), F.col("n_"))).select("scenario_id", "system_id", "t_", "k_")
    rows = picks.join(ranked.select("system_id", "k_", "node_id"), ["system_id", "k_"])
    return rows.groupBy("scenario_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_", "node_id"))), lambda x: x["node_id"]).alias("path"))


def node_role(path: Column, node: Column) -> Column:
    """symptom, intermediate or root_cause of a node on a path; null beside it."""
    at = F.array_position(path, node)
    return F.when((at > 0) & (at == F.size(path)), "root_cause").when(at == 1, "symptom").when(at > 1, "intermediate")


def path_facts(path: Column) -> Column:
    """struct(symptom_node, path_length, edges) of a path."""
    n = F.size(path)
    edges = F.zip_with(F.slice(path, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return F.struct(F.coalesce(F.get(path, F.lit(0)), F.lit("")).alias("symptom_node"), n.alias("path_length"), edges.alias("edges"))


def training_records(scenarios: DataFrame, prompt: str, version: str) -> DataFrame:
    """Prompts for learning by reward: id, messages, ground_truth, metadata. scenarios may lack a path (null), then its optimal length is 3."""
    free = F.contains("scenario_type", F.lit("no_fault")) | F.lower("fault_type").isin("normal", "no_fault") | F.lower(F.coalesce("root_cause_node", F.lit("none"))).isin("none", "")
    facts = path_facts(F.coalesce("path", F.array().cast("array<string>")))
    group = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    key = F.concat_ws("|", group("root_cause_system"), F.when(free, "none").otherwise(group("root_cause_node")), F.when(free, "normal").otherwise(group("fault_type")), group("source_file"))
    nodes = F.coalesce("path", F.array().cast("array<string>"))
    truth = F.struct(
        "root_cause_system", F.when(free, "none").otherwise(F.col("root_cause_node")).alias("root_cause_node"), F.when(free, "Normal").otherwise(F.col("fault_type")).alias("fault_type"), F.when(free, "none").otherwise(F.col("fault_intensity")).alias("fault_intensity"), "affected_systems",
        F.when(F.col("path").isNull(), 3).otherwise(facts["path_length"]).alias("optimal_path_length"), nodes.alias("diagnostic_path_nodes"), facts["symptom_node"].alias("symptom_node"), F.when(free, nodes).otherwise(F.array().cast("array<string>")).alias("reference_review_nodes"), facts["edges"].alias("reference_propagation_edges"),
    )
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content")), F.struct(F.lit("user").alias("role"), F.col("description").alias("content")))
    meta = F.struct(F.lit(version).alias("design_version"), F.sha2(F.lit(prompt), 256).alias("system_prompt_sha256"), "scenario_id", "scenario_type", "difficulty", "source_file", key.alias("split_group_key"), "time_window_start", "time_window_end")
    return scenarios.select(F.col("scenario_id").alias("id"), messages.alias("messages"), truth.alias("ground_truth"), meta.alias("metadata"))


def limited(rows: DataFrame, order: list[Column], most: int | None) -> DataFrame:
    """The first ``most`` rows by ``order``; all of them for none or 0. The limit is the feature."""
    return rows.orderBy(*order).limit(most) if most and most > 0 else rows


#: Sensors of the weather alone, which are no evidence of a fault.
OUTDOORS = r"^(OA_|OUTDOOR|WEATHER)"


def sensor_evidence(readings: Column, first: list[str], most: int = 3) -> Column:
    """Text of at most ``most`` readings (a map), sensors that matter for the fault first, then by name; without evidence, 'no readings'."""
    wanted = F.array(*map(F.lit, first))
    own = F.filter(F.map_entries(readings), lambda e: ~F.upper(e["key"]).rlike(OUTDOORS))
    ranked = F.array_sort(F.transform(own, lambda e: F.struct(F.when(F.array_contains(wanted, e["key"]), 0).otherwise(1).alias("r"), e["key"].alias("k"), e["value"].alias("v"))))
    shown = F.transform(F.slice(ranked, 1, most), lambda e: F.concat(e["k"], F.lit(" = "), F.round(e["v"], 1).cast("string")))
    return F.when(F.size(own) == 0, "no readings").otherwise(F.array_join(shown, ", "))


#: Wordings of what is noticed, by a part of the fault's name; {system} is filled in.
SYMPTOMS = {
    "fouling": ["{system} needs more energy for the same output", "heat transfer at {system} has slowly declined"], "leak": ["{system} loses capacity without a command to do so"],
    "stuck": ["{system} doesn't follow its commands", "a position at {system} never changes"], "bias": ["a reading at {system} disagrees with its neighbours"], "": ["{system} behaves differently from last week"],
}


def symptom(fault: Column, system: Column, key: Column, seed: int = 42) -> Column:
    """A wording of the fault's kind by hash of the key."""
    name, out = F.lower(fault), draw(key, SYMPTOMS[""], seed)
    for part, texts in reversed(SYMPTOMS.items()):
        if part:
            out = F.when(F.contains(name, F.lit(part)), draw(key, texts, seed)).otherwise(out)
    return F.replace(out, F.lit("{system}"), system)
