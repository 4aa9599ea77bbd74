"""Agent texts: extraction of blocks, text rewards, turn validators and loader gates; all as column expressions.

turns: conv_id, turn, role ('human', 'gpt', 'observation'), text.  Every rule is a boolean or numeric column, so a data set is checked in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import norm
from .statistics import first_by_hash

#: Tags of executable blocks and of auxiliary labels, and claims about health fields that tools don't show.
BLOCK = r"(?s)<{0}>\s*(\{{.*?\}})\s*</{0}>"
LOOSE = r"(?s)<{0}>\s*(\{{.*?\}}|\s*)\s*</{0}>"
LABELS = r"(?s)<topoitl_(state|action)>.*?</topoitl_\1>\s*"
HEALTH_CLAIMS = (
    r"\banomaly score\b", r"\banomaly scores\b", r"\b\d+(?:\.\d+)?%\s*anomaly\b", r"\banomaly:\s*\d", r"\bhealth indicators?\b",
    r"\bsystem health\b", r"\bhealth scan\b", r"\bhighest-scoring system\b", r"\bhighest anomaly\b", r"\bsignificantly higher than other systems\b",
)
#: Words that tie a thought to a tool, and words that refer to results.
TOOL_WORDS = {
    "get_system_overview": ("system", "overview", "building", "layout"), "get_node_children": ("component", "children", "drill", "internal"),
    "get_downstream_nodes": ("downstream", "propagat", "effect", "impact"), "get_upstream_nodes": ("upstream", "source", "root cause", "origin"),
    "diagnose_node": ("diagnos", "check", "status", "health", "fault"), "get_node_sensors": ("sensor", "reading", "measurement", "data"),
    "get_related_systems": ("related", "connected", "cross", "inter-system"),
}
RESULT_WORDS = ("result", "shows", "indicates", "found", "detected", "normal", "fault", "temperature", "pressure")
NODE_TOOLS = ("get_node_children", "get_downstream_nodes", "get_upstream_nodes", "diagnose_node", "get_node_sensors")
SYSTEMS = ("chiller_plant", "boiler_plant", "sdahu", "ddahu", "rtu", "fcu", "pfpu", "sfpu")
THOUGHT = 360


def _json(x: Column, fields: str) -> Column:
    return F.from_json(x, fields)


def tool_calls(text: Column) -> Column:
    """The bodies of all tool_call blocks."""
    return F.regexp_extract_all(text, F.lit(BLOCK.format("tool_call")), F.lit(1))


def first_block(text: Column, tag: str) -> Column:
    """The body of the first block of a tag; null without one."""
    return F.get(F.regexp_extract_all(text, F.lit(BLOCK.format(tag)), F.lit(1)), F.lit(0))


def last_block(text: Column, tag: str) -> Column:
    """The body of the last block of a tag; null without one."""
    found = F.regexp_extract_all(text, F.lit(BLOCK.format(tag)), F.lit(1))
    return F.get(found, F.size(found) - 1)


def thought(text: Column) -> Column:
    """The first think block, trimmed; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1))
    return F.regexp_replace(F.get(found, F.lit(0)), r"^\s+|\s+$", "")


def final_diagnosis(turns: DataFrame) -> DataFrame:
    """The last diagnosis of each conversation. Columns: conv_id, turn, root_cause_node, fault_type, confidence."""
    body = last_block(F.col("text"), "diagnosis")
    d = _json(body, "root_cause_node STRING, fault_type STRING, confidence DOUBLE")
    rows = turns.select("conv_id", "turn", body.alias("body"), d.alias("d")).where("body IS NOT NULL AND d IS NOT NULL")
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("turn", "d"), "turn").alias("x"))
    return last.select("conv_id", "x.turn", "x.d.*")


def strip_labels(text: Column) -> Column:
    """Text without auxiliary labels."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), LABELS, ""), r"^\s+|\s+$", "")


def to_first_action(text: Column) -> Column:
    """Text up to the end of its first completed executable block; all of it without one."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract(t, r"(?s)^(.*?</(?:diagnosis|tool_call)>)", 1)
    return F.when(found != "", found).otherwise(t)


def action_first(text: Column, most: int = THOUGHT) -> Column:
    """Labels removed, the thought cut at the last sentence that fits ``most`` characters, prose moved behind the executable block."""
    t = strip_labels(text)
    block = r"(?s)<tool_call>\s*\{.*?\}\s*</tool_call>|<diagnosis>\s*\{.*?\}\s*</diagnosis>"
    action = F.regexp_extract(t, f"({block})", 1)
    before = F.left(t, F.position(action, t) - 1)
    after = F.right(t, F.length(t) - F.length(before) - F.length(action))
    think = F.regexp_extract(before, r"(?s)(<think>.*?</think>)", 1)
    idea = F.trim(F.regexp_replace(F.regexp_extract(think, r"(?s)<think>(.*)</think>", 1), r"\s+", " "))
    sentences = F.filter(F.split(idea, r"(?<=[.!?])\s+"), lambda s: s != "")
    fits = F.aggregate(
        sentences, F.struct(F.lit("").alias("kept"), F.lit(False).alias("full")),
        lambda a, s: F.when(a["full"], a).when(a["kept"] == "", F.struct(s.alias("kept"), F.lit(False).alias("full")))
        .when(F.length(a["kept"]) + 1 + F.length(s) > most, F.struct(a["kept"].alias("kept"), F.lit(True).alias("full")))
        .otherwise(F.struct(F.concat(a["kept"], F.lit(" "), s).alias("kept"), F.lit(False).alias("full"))), lambda a: a["kept"],
    )
    short = F.when(F.length(idea) > most, fits).otherwise(idea)
    prose = F.regexp_replace(F.replace(before, think, F.lit("")), r"^\s+|\s+$", "")
    rest = F.regexp_replace(after, r"^\s+|\s+$", "")
    parts = F.array(F.concat(F.lit("<think>"), short, F.lit("</think>")), action, F.nullif(prose, F.lit("")), F.nullif(rest, F.lit("")))
    return F.when((action == "") | (think == ""), t).otherwise(F.array_join(F.filter(parts, lambda x: x.isNotNull()), "\n"))


# --- rewards and metrics of texts -------------------------------------------------------------------------------------
def call_validity(text: Column) -> Column:
    """Sum over a text's tool calls: 1 with name and arguments, 0.5 with a name only."""
    def worth(x: Column) -> Column:
        m = F.from_json(x, "map<string,string>")
        named = F.coalesce(F.map_contains_key(m, "name"), F.lit(False))
        return F.when(named & F.map_contains_key(m, "arguments"), 1.0).when(named, 0.5).otherwise(0.0)

    return F.aggregate(F.transform(tool_calls(text), worth), F.lit(0.0), lambda a, b: a + b)


def text_rewards(turns: DataFrame, visible: Column | None = None) -> DataFrame:
    """format, reasoning (0.5 without calls) and the penalty for ungrounded health claims of each episode_id of turns(episode_id, text).

    ``visible`` tells whether tools showed health fields, which makes claims about them fair.
    """
    t = F.col("text")
    has, idea = F.contains(t, F.lit("<tool_call>")), F.length(thought(t))
    reason = F.when(idea >= 20, 1.0).when(idea >= 5, 0.5).otherwise(0.0)
    claims = sum((F.regexp_count(F.lower(t), F.lit(p)) for p in HEALTH_CLAIMS), F.lit(0))
    rows = turns.select("episode_id", F.size(tool_calls(t)).alias("n"), call_validity(t).alias("v"), has.cast("int").alias("h"), F.when(has, reason).otherwise(0.0).alias("r"), claims.alias("c"), F.coalesce(visible, F.lit(False)).alias("s") if visible is not None else F.lit(False).alias("s"))
    sums = rows.groupBy("episode_id").agg(*(F.sum(x).alias(x) for x in "nvhrc"), F.max("s").alias("s"))
    return sums.select(
        "episode_id", F.when(F.col("n") > 0, F.col("v") / F.col("n")).otherwise(0.5).alias("format"), F.when(F.col("h") > 0, F.col("r") / F.col("h")).otherwise(0.5).alias("reasoning"),
        F.when(F.col("s"), 0.0).otherwise(-F.least(F.lit(0.30), 0.08 * F.col("c"))).alias("grounding"),
    )


def authenticity(text: Column, follows_result: Column) -> Column:
    """Score of one tool-calling text: length, reference to results, connection to its tool; 0 without a thought, null without a call."""
    idea = thought(text)
    low, n = F.lower(idea), F.length(idea)
    has = lambda words: F.coalesce(low.rlike("|".join(words)), F.lit(False))
    tool = F.regexp_extract(text, r'"name":\s*"(\w+)"', 1)
    tied = F.lit(False)
    for name, words in TOOL_WORDS.items():
        tied = F.when(tool == name, has(words)).otherwise(tied)
    score = F.when(n >= 30, 0.4).when(n >= 15, 0.2).otherwise(0.0) + F.when(~follows_result, 0.0).when(has(RESULT_WORDS), 0.3).otherwise(0.1) + F.when(tool == "", 0.0).when(tied, 0.3).otherwise(0.1)
    return F.when(F.contains(text, F.lit("<tool_call>")), F.when(idea.isNull(), 0.0).otherwise(F.least(F.lit(1.0), score)))


# --- validators -------------------------------------------------------------------------------------------------------
def _count(text: Column, what: str) -> Column:
    return F.regexp_count(text, F.lit(what))


def turn_errors(turns: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rules of each assistant turn as columns; known(node_id) are the graph's nodes (null: not checked).

    Columns: conv_id, turn, think, action, state, label, call_json, diagnosis_json, state_json, label_json, tool_differs, argument_differs, unknown_node,
    conclusion, diagnosis_differs, order, several.
    """
    t = F.col("text")
    one = lambda tag: F.get(F.regexp_extract_all(t, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(0))
    call, said = F.get(F.regexp_extract_all(t, F.lit(LOOSE.format("tool_call")), F.lit(1)), F.lit(0)), F.get(F.regexp_extract_all(t, F.lit(LOOSE.format("diagnosis")), F.lit(1)), F.lit(0))
    has_call, has_said = F.contains(t, F.lit("<tool_call>")), F.contains(t, F.lit("<diagnosis>"))
    whole = lambda x: F.from_json(x, "map<string,string>")
    rows = turns.where("role = 'gpt'").select(
        "conv_id", "turn", "text", has_call.alias("hc"), has_said.alias("hd"), call.alias("c_"), said.alias("d_"), one("topoitl_state").alias("s_"), one("topoitl_action").alias("a_"),
        F.size(F.regexp_extract_all(t, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1))).alias("n_think"), F.size(F.regexp_extract_all(t, F.lit(r"(?s)<topoitl_state>(.*?)</topoitl_state>"), F.lit(1))).alias("n_state"),
        F.size(F.regexp_extract_all(t, F.lit(r"(?s)<topoitl_action>(.*?)</topoitl_action>"), F.lit(1))).alias("n_label"),
    ).withColumns({"c": _json(F.col("c_"), "name STRING, arguments STRUCT<node_id: STRING, system_id: STRING>"), "d": _json(F.col("d_"), "root_cause_node STRING, fault_type STRING, status STRING"),
                   "a": _json(F.col("a_"), "tool STRING, type STRING, primitive STRING, arguments STRUCT<node_id: STRING, system_id: STRING>, diagnosis STRUCT<root_cause_node: STRING, fault_type: STRING, status: STRING>")})
    act = F.when(F.col("n_label") == 1, F.col("a"))
    call_ok, said_ok, label_ok = whole(F.col("c_")).isNotNull(), whole(F.col("d_")).isNotNull(), (F.col("n_label") == 1) & whole(F.col("a_")).isNotNull()
    both, ends = F.col("hc") & call_ok & label_ok, F.col("hd") & said_ok & label_ok
    node = F.col("c.arguments.node_id")
    if known is None:
        rows, ghost = rows, F.lit(False)
    else:
        rows = rows.join(known.select(F.col("node_id").alias("of_")).distinct().withColumn("known_", F.lit(True)), F.col("c.arguments.node_id") == F.col("of_"), "left")
        ghost = both & node.isNotNull() & (node != "") & F.col("known_").isNull() & ~node.startswith("system::")
    at = lambda tag: F.locate(f"<{tag}>", F.col("text"))
    begins = F.when(F.col("hc"), at("tool_call")).otherwise(at("diagnosis"))
    rules = {
        "think": F.col("n_think") != 1, "action": F.col("hc") == F.col("hd"), "state": F.col("n_state") != 1, "label": F.col("n_label") != 1,
        "call_json": F.col("hc") & ~call_ok, "diagnosis_json": F.col("hd") & ~said_ok, "state_json": (F.col("n_state") == 1) & whole(F.col("s_")).isNull(), "label_json": (F.col("n_label") == 1) & ~label_ok,
        "tool_differs": both & ~act["tool"].eqNullSafe(F.col("c.name")),
        "argument_differs": both & ~(act["arguments"]["node_id"].eqNullSafe(node) & act["arguments"]["system_id"].eqNullSafe(F.col("c.arguments.system_id"))),
        "unknown_node": ghost, "conclusion": ends & ~(act["type"].eqNullSafe(F.lit("final_diagnosis")) & act["primitive"].eqNullSafe(F.lit("conclude"))),
        "diagnosis_differs": ends & ~(act["diagnosis"]["root_cause_node"].eqNullSafe(F.col("d.root_cause_node")) & act["diagnosis"]["fault_type"].eqNullSafe(F.col("d.fault_type")) & act["diagnosis"]["status"].eqNullSafe(F.col("d.status"))),
        "order": ~((begins > 0) & (begins < at("topoitl_state")) & (at("topoitl_state") < at("topoitl_action"))),
        "several": (_count(F.col("text"), "<tool_call>") > 1) | (_count(F.col("text"), "<diagnosis>") > 1),
    }
    return rows.select("conv_id", "turn", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()))


def skipped_steps(calls: DataFrame) -> DataFrame:
    """Calls of node tools on nodes that no earlier result of the conversation listed.

    calls: conv_id, turn, tool, node_id, targets (nodes that its result lists). Columns: conv_id, turn, node_id.
    """
    seen = calls.select("conv_id", F.explode("targets").alias("node_id"), "turn").groupBy("conv_id", "node_id").agg(F.min("turn").alias("first_"))
    asked = calls.where(F.col("tool").isin(*NODE_TOOLS) & (F.coalesce("node_id", F.lit("")) != "") & ~F.col("node_id").startswith("system::"))
    rows = asked.join(seen, ["conv_id", "node_id"], "left")
    return rows.where(F.col("first_").isNull() | (F.col("first_") >= F.col("turn"))).select("conv_id", "turn", "node_id")


def wrong_conclusion(gt_node: Column, gt_fault: Column, node: Column, fault: Column) -> Column:
    """Whether a conversation's diagnosis differs from its truth; without a fault both must say so."""
    free = F.coalesce(gt_node, F.lit("")).isin("", "none")
    return F.when(free, ~(node.eqNullSafe(F.lit("none")) & fault.eqNullSafe(F.lit("no_fault")))).otherwise(~(node.eqNullSafe(gt_node) & fault.eqNullSafe(gt_fault)))


def prompt_errors(records: DataFrame, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
    """Rules of training prompts: records(id, roles array<string>, gt_system, optimal string, scenario_id, group_key)."""
    length = F.col("optimal").try_cast("long")
    rules = {
        "no_messages": F.coalesce(F.size("roles"), F.lit(0)) <= 0, "no_system": ~F.coalesce(F.array_contains("roles", "system"), F.lit(False)), "no_user": ~F.coalesce(F.array_contains("roles", "user"), F.lit(False)),
        "bad_system": (F.coalesce("gt_system", F.lit("")) != "") & ~F.col("gt_system").isin(*systems), "negative_length": length < 0, "bad_length": F.col("optimal").isNotNull() & length.isNull(),
        "no_scenario": F.coalesce("scenario_id", F.lit("")) == "", "no_group": F.coalesce("group_key", F.lit("")) == "",
    }
    return records.select("id", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()))


#: Issues that stop a load.
FATAL = ("empty_conversations", "missing_system", "missing_final_diagnosis", "stale_design_version", "prompt_hash_mismatch", "bad_first_tool", "label_before_action")


def loader_gates(records: DataFrame, turns: DataFrame, version: str, prompt_hash: str) -> DataFrame:
    """One row of issue counts of records(conv_id, system, design_version, prompt_sha256, augmentation) and their turns."""
    t = F.col("text")
    at = lambda *tags: F.least(*(F.nullif(F.locate(f"<{x}>", t), F.lit(0)) for x in tags))
    own = F.col("role") == "gpt"
    tool = F.get_json_object(F.get(tool_calls(t), F.lit(0)), "$.name")
    rows = turns.select("conv_id", "turn", F.contains(t, F.lit("<diagnosis>")).alias("ends"), (own & (_count(t, "<think>") > 1)).cast("int").alias("multi"), F.coalesce(own & (at("topoitl_state", "topoitl_action") < at("tool_call", "diagnosis")), F.lit(False)).cast("int").alias("late"), F.when(own, tool).alias("tool"))
    per = rows.groupBy("conv_id").agg(F.max("ends").alias("ends"), F.sum("multi").alias("multi"), F.sum("late").alias("late"), F.min_by("tool", F.when(F.col("tool").isNotNull(), F.col("turn"))).alias("tool"))
    j = records.join(per, "conv_id", "left")
    some = F.col("ends").isNotNull()
    counts = {
        "multi_think": F.coalesce(F.sum("multi"), F.lit(0)), "empty_conversations": F.count_if(~some), "missing_system": F.count_if(some & (F.coalesce("system", F.lit("")) == "")),
        "missing_final_diagnosis": F.count_if(some & ~F.col("ends")), "stale_design_version": F.count_if(some & ~F.col("design_version").eqNullSafe(F.lit(version))),
        "prompt_hash_mismatch": F.count_if(some & ~F.col("prompt_sha256").eqNullSafe(F.lit(prompt_hash))),
        "bad_first_tool": F.count_if(some & (F.col("augmentation") == "terminal_closure") & ~F.col("tool").eqNullSafe(F.lit("get_system_overview"))), "label_before_action": F.coalesce(F.sum("late"), F.lit(0)),
    }
    return j.agg(*(v.cast("long").alias(k) for k, v in counts.items()))


def check_load(gates: DataFrame) -> None:
    """Raise if a fatal issue was counted; one row reaches the driver."""
    row = gates.first().asDict()
    found = {k: row[k] for k in FATAL if row[k]}
    if found:
        raise ValueError(f"the data set fails its gates: {found}")


def refresh_prompt(records: DataFrame, prompt: str) -> DataFrame:
    """records(system, prompt_sha256, …) with the present prompt and its hash where the stored one differs; ``refreshed`` marks them."""
    now = F.sha2(F.lit(prompt), 256)
    stale = ~(F.sha2(F.coalesce("system", F.lit("")), 256).eqNullSafe(now) & F.col("prompt_sha256").eqNullSafe(now))
    return records.withColumn("refreshed", stale).withColumn("system", F.when(F.col("refreshed"), prompt).otherwise(F.col("system"))).withColumn("prompt_sha256", now)


def span_weights(spans: DataFrame, state: float = 1.0, action: float = 1.0, base: float = 0.5) -> DataFrame:
    """Loss weights of spans(conv_id, turn, kind, …): human 0, prose ``base``, executable 1, first state ``state``, later states half more, labels ``action``."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "kind").orderBy("turn"))
    weight = F.when(F.col("kind") == "state", F.lit(state) + F.when(nth > 1, 0.5).otherwise(0.0)).when(F.col("kind") == "label", action).when(F.col("kind") == "executable", 1.0).when(F.col("kind") == "prose", base).otherwise(0.0)
    return spans.withColumn("weight", weight)


#: Weights of tokens by what they belong to; a state block after a conversation's first one is a transition as well.
TOKEN_WEIGHTS = {"state": 1.0, "action": 1.0, "transition": 0.5, "base": 1.0}
_EXECUTABLE = r"(?s)<tool_call>.*?</tool_call>|<diagnosis>.*?</diagnosis>"


def block_places(text: Column, pattern: str) -> Column:
    """array<struct<start, end>>: where the matches of a pattern lie in a text, in characters; a turn has few."""
    found, gaps = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length), F.transform(F.split(text, pattern, -1), F.length)
    none = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["own"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["own"]).alias("end")))).alias("out"))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, own: F.struct(gap.alias("gap"), own.alias("own")))
    return F.coalesce(F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"]), none)


def token_weights(tokens: DataFrame, turns: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``tokens`` (conv_id, turn, start, end: characters within the turn's text) with trained and weight.

    Only an agent's tokens are trained.  A token belongs to the block that its middle lies in: a state, an action label or an executable block; the
    conversation's first state counts once, later ones also as transitions; prose has the base weight.  A turn's blocks are one row, so a token meets one row.
    """
    w = TOKEN_WEIGHTS | (weights or {})
    t, own = F.coalesce("text", F.lit("")), F.col("role") == "gpt"
    places = turns.select(
        "conv_id", "turn", own.alias("trained"), block_places(t, r"(?s)<topoitl_state>.*?</topoitl_state>").alias("states_"), block_places(t, r"(?s)<topoitl_action>.*?</topoitl_action>").alias("labels_"), block_places(t, _EXECUTABLE).alias("acts_"),
    )
    first = places.where("trained AND size(states_) > 0").groupBy("conv_id").agg(F.min(F.struct("turn", F.col("states_")[0]["start"].alias("start"))).alias("first_"))
    j = tokens.join(places, ["conv_id", "turn"]).join(first, "conv_id", "left")
    middle = F.when(F.col("end") > F.col("start"), (F.col("start") + F.col("end")) / 2.0).otherwise(F.col("start").cast("double"))
    inside = lambda spans: F.exists(spans, lambda s: (s["start"] <= middle) & (middle < s["end"]))
    opening = F.exists("states_", lambda s: (s["start"] <= middle) & (middle < s["end"]) & (F.col("turn") == F.col("first_.turn")) & (s["start"] == F.col("first_.start")))
    weight = F.when(opening, w["state"]).when(inside("states_"), w["state"] + w["transition"]).when(inside("labels_") | inside("acts_"), w["action"]).otherwise(w["base"])
    return j.withColumn("weight", F.when(F.col("trained"), weight).otherwise(0.0)).select(*tokens.columns, "trained", "weight")


def unique_sentences(text: Column) -> Column:
    """Sentences of a text in their order, each once: what differs in case and white space alone is the same; joined by blanks."""
    sentences = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"(?<=[.!?])\s+"), lambda s: s != "")
    low = F.transform(sentences, F.lower)
    return F.array_join(F.filter(sentences, lambda s, i: F.array_position(low, F.lower(s)) == i + 1), " ")


#: Context that a closing example keeps, by kind of scenario.
CONTEXT = {"cross_system": 8, "no_fault": 6, "": 5}
_TOPOLOGY = ("get_system_overview", "get_node_children", "get_related_systems", "get_upstream_nodes", "get_downstream_nodes")


def closing_events(events: DataFrame, final: DataFrame) -> DataFrame:
    """The events that a closing example keeps of each conversation: conv_id, i, part ('context' or 'evidence').

    events(conv_id, i, tool, node_id, status, confidence, has_readings), final(conv_id, scenario_type, node, fault).  The evidence is, by the first rule that
    applies: without a fault, the last three (or two) normal results of high confidence, none if there are fewer; with low confidence, the root's last
    diagnosis and its last readings; the root's last diagnosis; the last diagnosis; the last event.  The context before it: the first overview, the first look into a system, and
    the last events on the graph or of a fault.  A conversation whose evidence begins with a diagnosis but has no context gives nothing.
    """
    kind = norm(F.col("scenario_type"))
    free = F.contains(kind, F.lit("no_fault")) | norm(F.col("node")).isin("", "none", "normal", "no_fault") | norm(F.col("fault")).isin("no_fault", "normal", "none")
    most = F.when(F.contains(kind, F.lit("no_fault")), CONTEXT["no_fault"]).when(F.contains(kind, F.lit("cross_system")), CONTEXT["cross_system"]).otherwise(CONTEXT[""])
    f = final.select("conv_id", F.col("node").alias("root_"), free.alias("free_"), F.contains(kind, F.lit("low_confidence")).alias("low_"), most.alias("most_"))
    s, asks = norm(F.col("status")), F.col("tool") == "diagnose_node"
    rows = events.join(f, "conv_id").withColumns({
        "asks_": asks, "calm_": asks & (s == "normal") & (F.coalesce("confidence", F.lit(0.0)) >= 0.85), "own_": asks & F.col("node_id").eqNullSafe(F.col("root_")),
        "read_": (F.col("tool") == "get_node_sensors") & F.col("node_id").eqNullSafe(F.col("root_")) & F.coalesce("has_readings", F.lit(False)), "bad_": asks & s.isin("abnormal", "warning", "fault"),
    })
    whole, back = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy(F.desc("i"))
    nth = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")).over(back)  # noqa: E731  of such events from the end
    has = lambda c: F.coalesce(F.max(c).over(whole), F.lit(False))
    last = lambda c, n=1: F.coalesce(F.col(c), F.lit(False)) & (nth(c) <= n)
    n_calm = F.sum(F.coalesce("calm_", F.lit(False)).cast("int")).over(whole)
    low = F.col("low_") & (has("own_") | has("read_"))
    chosen = (
        F.when(F.col("free_"), last("calm_", 3) & (n_calm >= 2)).when(low, last("own_") | last("read_")).when(has("own_"), last("own_")).when(has("asks_"), last("asks_"))
        .otherwise(F.row_number().over(back) == 1)
    )
    rows = rows.withColumn("chosen_", chosen).withColumn("from_", F.min(F.when(F.col("chosen_"), F.col("i"))).over(whole)).where("from_ IS NOT NULL")
    before = F.col("i") < F.col("from_")
    overview = F.min(F.when(before & (F.col("tool") == "get_system_overview"), F.col("i"))).over(whole)
    inside = F.min(F.when(before & (F.col("tool") == "get_node_children") & F.col("node_id").startswith("system::"), F.col("i"))).over(whole)
    near = before & (F.col("tool").isin(*_TOPOLOGY) | F.coalesce("bad_", F.lit(False)))
    rows = rows.withColumn("near_", near).withColumns({"o_": overview, "c_": inside, "k_": nth("near_")})
    context = before & (F.col("i").eqNullSafe(F.col("o_")) | F.col("i").eqNullSafe(F.col("c_")) | (F.col("near_") & (F.col("k_") <= F.col("most_"))))
    rows = rows.withColumn("context_", context).withColumn("any_", F.max("context_").over(whole)).withColumn("opens_", F.max(F.when(F.col("i") == F.col("from_"), F.col("asks_"))).over(whole))
    return rows.where((F.col("chosen_") | F.col("context_")) & (F.col("any_") | ~F.col("opens_"))).select("conv_id", "i", F.when(F.col("chosen_"), "evidence").otherwise("context").alias("part"))


def closing_examples(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """Turns of the closing examples: the question, the kept calls with their results, and the diagnosis; conv_id, turn, role, text.

    turns as ``trajectories.dialogue`` makes them: call i is turn 2 i + 1, its result 2 i + 2, the diagnosis the last turn.
    """
    calls = kept.select("conv_id", F.explode(F.array(2 * F.col("i") + 1, 2 * F.col("i") + 2)).alias("turn"))
    ends = turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).join(kept.select("conv_id"), "conv_id", "left_semi")
    wanted = calls.unionByName(ends).unionByName(ends.select("conv_id", F.lit(0).alias("turn"))).withColumn("turn", F.col("turn").cast("int"))
    rows = turns.withColumn("turn", F.col("turn").cast("int")).join(wanted.distinct(), ["conv_id", "turn"])
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return rows.select(F.concat("conv_id", F.lit("__terminal_closure")).alias("conv_id"), nth.alias("turn"), "role", "text")


def weighted_loss(tokens: DataFrame, weight: str = "weight", loss: str = "loss") -> DataFrame:
    """Sum of weighted losses over the sum of weights, 1 at least."""
    return tokens.agg((F.sum(F.col(weight) * F.col(loss)) / F.greatest(F.sum(weight), F.lit(1.0))).alias("loss"))


def first_prompts(turns: DataFrame, kinds: DataFrame, share: float = 0.1) -> DataFrame:
    """The first human turn of a fraction of the conversations of each type, one at least: kinds(conv_id, scenario_type).

    Conversations are taken in order of the md5 of their id. Columns: conv_id, scenario_type, prompt.
    """
    limits = kinds.groupBy("scenario_type").agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("limit"))
    taken = first_by_hash(kinds, "scenario_type", F.col("conv_id"), limits, name="taken_", digest=F.md5(F.col("conv_id").cast("string"))).where("taken_")
    first = turns.where("role = 'human'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    return taken.join(first, "conv_id").select("conv_id", "scenario_type", "prompt")


def environment(turns: DataFrame, max_calls: int = 15, max_texts: int = 30) -> DataFrame:
    """What an episode's environment makes of agent texts, turns(episode_id, turn, text): episode_id, turn, kind, done, reason.

    An episode ends with a diagnosis, with ``max_calls`` tool calls, or with ``max_texts`` texts without an action; what comes later is not taken.
    """
    t = F.col("text")
    kind = F.when(first_block(t, "diagnosis").isNotNull(), "diagnosis").when(F.size(tool_calls(t)) > 0, "tool").otherwise("text")
    w = Window.partitionBy("episode_id").orderBy("turn")
    rows = turns.select("episode_id", "turn", kind.alias("kind"))
    upto = lambda k: F.sum((F.col("kind") == k).cast("int")).over(w)
    rows = rows.withColumns({"d_": upto("diagnosis"), "c_": upto("tool"), "x_": upto("text")})
    reason = F.when(F.col("d_") > 0, "diagnosis").when(F.col("c_") >= max_calls, "max_calls").when(F.col("x_") >= max_texts, "text_only").otherwise("")
    rows = rows.withColumn("reason", reason).withColumn("done", F.col("reason") != "")
    rows = rows.withColumn("before_", F.coalesce(F.lag("done").over(w), F.lit(False)))
    return rows.where("NOT before_").select("episode_id", "turn", "kind", "done", "reason")
