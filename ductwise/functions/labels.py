"""Column expressions for fault labels, node ids, scenario types and sensor file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mechanism families in order of precedence, each with the label parts that mark it.
FAMILIES = (
    ("chiller_bypass", ("bypass_leakage", "bypass_stuck", "bypass")),
    ("chiller_temperature_sensor_bias", ("chiller_bias",)),
    ("cooling_tower_sensor_bias", ("coolingtower_bias", "cooling_tower_bias")),
    ("cooling_tower_fouling", ("coolingtower_fouling", "cooling_tower_fouling")),
    ("chilled_water_pressure", ("secondary_chilled_water_pressure",)),
    ("boiler_sensor_bias", ("boiler_bias", "hot_water_temp_bias")),
    ("boiler_pressure", ("hot_water_pressure",)),
    ("boiler_fouling", ("boiler_foul", "boiler_fouling")),
    ("rtu_refrigerant_circuit", ("overcharge", "undercharge", "evapfouling", "condfouling", "evaporator_fouling", "condenser_fouling")),
    ("rtu_pipe_sensor", ("liquidpipe", "suctionpipe")),
    ("fcu_airside", ("oadmpr", "filterrestriction", "fanoutletblockage", "control_heatingreverse", "oablockage")),
    ("ddahu_hot_deck", ("sensorbias_hsa", "sensorbias_hsp", "dmprstuck_hot")),
    ("ddahu_cold_deck", ("sensorbias_csa", "sensorbias_csp", "dmprstuck_cold")),
    ("ddahu_outdoor_air_damper", ("dmprstuck_oa",)),
    ("water_valve_cooling", ("vlvstuck_cooling", "vlvleak_cooling")),
    ("water_valve_heating", ("vlvstuck_heating", "vlvleak_heating")),
    ("coil_fouling_cooling", ("fouling_cooling",)),
    ("coil_fouling_heating", ("fouling_heating",)),
    ("ahu_supply_air_sensor", ("sa_bias", "sensorbias_sa")),
    ("ahu_outdoor_air_sensor", ("oa_bias", "sensorbias_oa")),
    ("ahu_cooling_coil_valve", ("coi_leakage", "coi_stuck")),
    ("ahu_damper", ("damper_stuck", "dmpr")),
    ("fan", ("fan",)),
    ("pump", ("pump",)),
)
#: Labels that mean no fault, in normal form.
NO_FAULT_LABELS = ("", "normal", "none", "no_fault", "no_fault_detected")
NO_FAULT_NODES = ("", "none", "normal", "no_fault", "no fault")


def norm(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))


#: How a sign before a number, at the start or after a separator, is spelt.
SIGNS = {r"(^|[_\s])\+(?=\d)": "$1pos_", r"(^|[_\s])-(?=\d)": "$1neg_"}


def normalize_label(value: Column) -> Column:
    """Lower case, signs spelt out before digits, every other separator one underscore."""
    text = norm(value)
    for pattern, name in SIGNS.items():
        text = F.regexp_replace(text, pattern, name)
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def canonical_label(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize_label(value), "_default$", ""), "^_+|_+$", "")


def node_system(node: Column) -> Column:
    """x of 'system::x', a of 'a::b', else empty."""
    n = norm(node)
    rest = F.regexp_extract(n, "(?s)^system::(.*)$", 1)
    return F.when(n.startswith("system::"), rest).when(F.contains(n, F.lit("::")), F.substring_index(n, "::", 1)).otherwise("")


def is_no_fault_label(value: Column) -> Column:
    return normalize_label(value).isin(*NO_FAULT_LABELS)


def is_no_fault_node(value: Column) -> Column:
    return norm(value).isin(*NO_FAULT_NODES)


def mutual_substring(a: Column, b: Column) -> Column:
    x, y = norm(a), norm(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exact_match(a: Column, b: Column) -> Column:
    both = F.struct(canonical_label(a).alias("x"), canonical_label(b).alias("y"))
    return once(both, lambda p: (p["x"] != "") & (p["x"] == p["y"]))


def family(label: Column) -> Column:
    """The first family that a part of the label marks; else its first two parts without intensities."""

    def of(s: Column) -> Column:
        out = F.when(s.isin(*NO_FAULT_LABELS), "normal")
        for name, tokens in FAMILIES:
            out = out.when(s.rlike("|".join(tokens)), name)
        parts = F.filter(F.split(s, "_"), lambda p: ~p.isin("default", "minor", "moderate", "severe") & ~p.rlike(r"^\d+c?$"))
        return out.otherwise(F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 1, 2), "_")).otherwise(s))

    return once(normalize_label(label), of)


def same_family(a: Column, b: Column) -> Column:
    both = F.struct(family(a).alias("x"), family(b).alias("y"))
    return once(both, lambda p: (p["x"] != "normal") & (p["x"] != "") & (p["x"] == p["y"]))


def difficulty(intensity: Column) -> Column:
    """easy from 50, medium from 20, else hard; severe is easy and other words are medium."""
    number = F.abs(F.regexp_replace(intensity, "%", "").try_cast("double"))
    worded = F.when(norm(intensity) == "severe", "easy").otherwise("medium")
    return F.when(number.isNull(), worded).when(number >= 50, "easy").when(number >= 20, "medium").otherwise("hard")


#: File name prefix and fault-free file of each system, and the units an intensity may carry.
FILE_RULES = {
    "chiller_plant": ("ChillerPlant_", "ChillerPlant.csv", None), "boiler_plant": ("BoilerPlant_", "BoilerPlant.csv", None),
    "sdahu": ("", "AHU_annual.csv", None), "ddahu": ("DualDuct_", "DualDuct_FaultFree.csv", r"[+-]*(?:[\d.]|inwg|C|%)+"),
    "fcu": ("FCU_", "FCU_FaultFree.csv", r"[\d.%]+"), "pfpu": ("PFPU_", "PFPU_FaultFree.csv", r"[+-]*(?:[\d.]|CFM|C|%)+"),
    "sfpu": ("SFPU_", "SFPU_FaultFree.csv", r"[+-]*(?:[\d.]|CFM|C|%)+"), "rtu": ("RTU_sim_", "RTU_sim_baseline.csv", r"\d+"),
}


def parse_file_name(system: str, name: Column) -> Column:
    """struct(fault_type, fault_intensity, is_fault_free, label) of a sensor file's name."""
    prefix, clean, units = FILE_RULES[system]
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\.csv", ""), "_annual" if system == "sdahu" else "^$", ""), prefix or "^$", "")
    free = F.contains(name, F.lit("FaultFree")) if system in ("pfpu", "sfpu") else name == clean
    if system == "rtu":
        kind, level = F.regexp_extract(bare, r"^([a-z]+)(\d+)", 1), F.regexp_extract(bare, r"^([a-z]+)(\d+)", 2)
        split, rest = kind != "", "default"
    else:
        kind, level = F.regexp_extract(bare, "^(.*)_([^_]*)$", 1), F.regexp_extract(bare, "^(.*)_([^_]*)$", 2)
        split, rest = F.contains(bare, F.lit("_")), "unknown"
        if units:
            split, rest = split & level.rlike(rf"^(?:Minor|Moderate|Severe|(?=.*\d){units})$"), "default"
        if system == "fcu":
            split = split & ~F.contains(bare, F.lit("SensorBias"))
    kind = F.when(free, "normal").when(split, kind).otherwise(bare)
    level = F.when(free, "none").when(split, level).otherwise(rest)
    label = F.when(free, "Normal").otherwise(F.concat_ws("_", kind, level))
    return F.struct(kind.alias("fault_type"), level.alias("fault_intensity"), free.alias("is_fault_free"), label.alias("label"))


#: Other names of scenario types, and the displayed names of systems.
TYPE_ALIASES = {"na_cross_system": "cross_system"}
DISPLAY_NAMES = {
    "chiller_plant": "Chiller Plant", "boiler_plant": "Boiler Plant", "sdahu": "Single-Duct AHU", "ddahu": "Dual-Duct AHU",
    "rtu": "Rooftop Unit", "fcu": "Fan Coil Unit", "pfpu": "Parallel Fan Powered Unit", "sfpu": "Series Fan Powered Unit",
}


def canonical_type(value: Column) -> Column:
    """The name under which a scenario type is grouped; 'unknown' for none."""
    name = norm(value)
    out = F.when(F.coalesce(value.cast("string"), F.lit("")) == "", "unknown")
    for alias, kind in TYPE_ALIASES.items():
        out = out.when(name == alias, kind)
    return out.otherwise(name)


def expand_types(types: list[str]) -> set[str]:
    """Requested types with their other names."""
    asked = {t.strip().lower() for t in types if t.strip()}
    meant = {TYPE_ALIASES.get(t, t) for t in asked}
    return asked | {x for alias, kind in TYPE_ALIASES.items() if kind in meant for x in (alias, kind)}


def named_system(text: Column, names: dict[str, str] = DISPLAY_NAMES) -> Column:
    """The system whose displayed name stands in brackets at the start of a prompt; null without one."""
    shown = F.trim(F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), r"(?s)^\[([^\]]*)\]", 1))
    out = F.lit(None).cast("string")
    for system, name in names.items():
        out = F.when(shown == name, system).otherwise(out)
    return out


def observed_system(text: Column, markers: dict[str, str]) -> Column:
    """The system of the first marker (marker -> system) that a prompt contains; null without one."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(None).cast("string")
    for marker, system in reversed(markers.items()):
        out = F.when(F.contains(low, F.lit(marker)), system).otherwise(out)
    return out


def or_all(items: Column, fits) -> Column:
    """The items that fit, or all of them if none does."""
    kept = F.filter(items, fits)
    return F.when(F.size(kept) > 0, kept).otherwise(items)


def canonical_json(value: Column) -> Column:
    """JSON text of an object of strings with sorted keys, for comparing objects; null if it is no object."""
    entries = F.array_sort(F.map_entries(F.from_json(value, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))
