"""Building leakage-safe, proportional datasets, and checks on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .statistics import first_by_hash, hash_order


def largest_remainder(shares: dict[str, float], total: int) -> dict[str, int]:
    """Whole targets that add up to ``total``; what rounding leaves goes to the largest fractions."""
    raw = {k: v * total for k, v in shares.items()}
    out = {k: int(v) for k, v in raw.items()}
    for k in sorted(raw, key=lambda k: (-(raw[k] - out[k]), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def proportional(counts: dict[str, int], wanted: int) -> dict[str, int]:
    """At least one of each type if that fits, then one by one to the largest deficit (then count, then name)."""
    total = sum(counts.values())
    wanted = min(wanted, total)
    out = {k: int(wanted >= len(counts)) for k in counts}
    while sum(out.values()) < wanted:
        open_ = [k for k in counts if out[k] < counts[k]]
        best = max(open_, key=lambda k: (wanted * counts[k] / total - out[k], counts[k], k))
        out[best] += 1
    return out


def sample_by_type(df: DataFrame, kind: str, key: Column, wanted: int, seed: int = 42) -> DataFrame:
    """A proportional sample; within a type rows go by hash of their key."""
    counts = {r[kind]: r["count"] for r in df.groupBy(kind).count().collect()}  # a row for each type
    share = proportional(counts, wanted)
    if not share:
        return df.limit(0)
    limits = df.sparkSession.createDataFrame([(k, n) for k, n in share.items()], f"`{kind}` {dict(df.dtypes)[kind]}, limit long")
    return first_by_hash(df, kind, key, limits, seed, "taken_").where("taken_").drop("taken_")


def assign_groups(sizes: list[tuple[str, dict[str, int]]], shares: dict[str, float], members: dict[str, int] | None = None) -> dict[str, str]:
    """Greedy split of whole groups: largest first, to the split that 0.75 size and 0.25 type balance favour; over target costs five times.

    With ``members`` an entry stands for so many groups; entries go by the size of one of their groups.
    """
    members, names = members or {}, list(shares)
    place = {k: i + 1 for i, k in enumerate(sorted({k for _, t in sizes for k in t}, key=str))}
    load = {}  # rows in all and by type, as a vector
    for group, t in sizes:
        load[group] = np.zeros(len(place) + 1)
        for k, n in t.items():
            load[group][[0, place[k]]] += n
    if not load:
        return {}
    goal = np.maximum(np.outer(list(shares.values()), sum(load.values())), 1.0)
    filled, out = np.zeros_like(goal), {}
    for group in sorted(load, key=lambda g: (-int(load[g][0]) // members.get(g, 1), g)):
        own = load[group]
        weight = np.where(own > 0, 0.25 / max(np.count_nonzero(own) - 1, 1), 0.0)  # the group's own types share a quarter
        weight[0] = 0.75
        distance = (filled + own) / goal - 1
        best = int(np.argmin(np.where(distance > 0, 5 * distance, distance) @ weight))
        filled[best] += own
        out[group] = names[best]
    return out


#: Least cross-system rows of each root in a held-out split, in number and as a share, and exchanges for each such split.
LEAST_CROSS, CROSS_SHARE, EXCHANGES = 20, 0.20, 12


def _lack(rows: np.ndarray, least: int, share: float) -> np.ndarray:
    """What the roots are short of ``least`` and of ``share`` of all their cross-system rows, summed."""
    wanted = np.maximum(least, np.round(share * rows.sum(axis=-1, keepdims=True)))
    return np.where(rows.sum(axis=-1) > 0, np.maximum(wanted - rows, 0).sum(axis=-1), 0.0)


def exchange(entries: dict[str, dict[str, int]], sizes: dict[str, int], placed: dict[str, str], split: str, roots: list[str], goal: float, least: int = LEAST_CROSS, share: float = CROSS_SHARE, rounds: int = EXCHANGES, source: str = "train") -> dict[str, str]:
    """``placed`` after at most ``rounds`` exchanges of entries of ``split`` with entries of ``source``.

    entries: cross-system rows by root; sizes: rows; goal: rows that the split should have.  A root lacks what it is short of
    ``least`` and of ``share`` of the split's cross-system rows.  Of all exchanges (one entry comes, one or none goes) the one with the least lack afterwards is
    made, of equal ones that with the size nearest to the goal, then the first by name; none where no exchange lessens the lack.
    """
    out = dict(placed)
    matrix = {k: np.array([entries.get(k, {}).get(r, 0) for r in roots], float) for k in placed}
    lack = lambda rows: _lack(rows, least, share)
    for _ in range(rounds if roots else 0):
        inside, outside = (sorted(k for k, s in out.items() if s == name) for name in (split, source))
        have, size = sum((matrix[k] for k in inside), np.zeros(len(roots))), sum(sizes[k] for k in inside)
        now = float(lack(have))
        if not now:
            break
        comes = [k for k in outside if matrix[k].any()]
        if not comes:
            break
        gains, more = np.array([matrix[k] for k in comes]), np.array([sizes[k] for k in comes], float)
        best = None
        for goes in [None, *inside]:
            off, less = (matrix[goes], sizes[goes]) if goes is not None else (0.0, 0)
            left, error = lack(have - off + gains), np.abs(size - less + more - goal)
            i = int(np.lexsort([error, left])[0])
            option = (float(left[i]), float(error[i]), comes[i], goes or "")
            best = option if best is None or option < best else best
        if best[0] >= now:
            break
        out[best[2]] = split
        if best[3]:
            out[best[3]] = source
    return out


def resize(entries: dict[str, dict[str, int]], sizes: dict[str, int], placed: dict[str, str], split: str, roots: list[str], goal: float, least: int = LEAST_CROSS, share: float = CROSS_SHARE, near: float = 0.001, source: str = "train") -> dict[str, str]:
    """``placed`` with ``split`` brought back within ``near`` of its goal after exchanges for its roots.

    One entry comes from or goes to ``source``, or both; of those that leave the roots' lack no larger the one that ends nearest to the goal is taken, then the first by name.
    """
    out = dict(placed)
    matrix = {k: np.array([entries.get(k, {}).get(r, 0) for r in roots], float) for k in placed}
    for _ in range(len(placed) if roots else 0):
        inside, outside = (sorted(k for k, s in out.items() if s == name) for name in (split, source))
        have, size = sum((matrix[k] for k in inside), np.zeros(len(roots))), sum(sizes[k] for k in inside)
        now, off = float(_lack(have, least, share)), abs(size - goal)
        if off <= near * goal:
            break
        comes = ["", *outside]
        gains, more = np.array([matrix.get(k, np.zeros(len(roots))) for k in comes]), np.array([sizes.get(k, 0) for k in comes], float)
        best = None
        for goes in ["", *inside]:
            left = _lack(have - matrix.get(goes, 0.0) + gains, least, share)
            error = np.where(left <= now, np.abs(size - sizes.get(goes, 0) + more - goal), np.inf)
            i = int(np.argmin(error))
            option = (float(error[i]), comes[i], goes)
            best = option if best is None or option < best else best
        if best[0] >= off:
            break
        for k, to in ((best[1], split), (best[2], source)):
            if k:
                out[k] = to
    return out


def grouped_split(df: DataFrame, group: str, kind: str, shares: dict[str, float] | None = None, hot: int = 1024, root: str | None = None, cross: Column | None = None) -> DataFrame:
    """Adds ``split``; no group is in two splits.

    The ``hot`` largest groups are placed one by one; all others are dealt by their commonest type and root and by md5 to about ``hot`` blocks, which are placed like groups,
    so the driver holds at most 2 * ``hot`` entries and one for each type and root, with a number for each of these, whatever the groups look like.  Against placing every group by
    itself a split's rows of a type are off by about half a block: the small groups' rows over ``hot``.  With ``root`` and ``cross`` (which rows count), entries are then
    exchanged until every root has its part of the cross-system rows in the splits besides the first, or nothing helps (``exchange``), and the splits are filled up to their share
    again (``resize``).  A block stands for many groups of one root, so exchanges move as much at any size of the table.
    """
    shares = shares or {"train": 0.8, "val": 0.1, "test": 0.1}
    rooted = F.col(root) if root else F.lit(None).cast("string")
    crossed = F.count_if(cross) if cross is not None else F.lit(0).cast("long")
    counts = cut(df.groupBy(F.col(group).alias("g_"), F.col(kind).alias("kind_"), rooted.alias("root_")).agg(F.count("*").alias("n"), crossed.alias("x")))
    digest = F.md5(F.coalesce(F.col("g_").cast("string"), F.lit("")))
    groups = counts.groupBy("g_").agg(F.sum("n").alias("n"), F.max_by(F.struct(F.col("kind_").alias("k"), F.col("root_").alias("r")), F.struct("n", "kind_", "root_")).alias("most_"))
    per_kind = max(1, hot // max(1, counts.select("kind_", "root_").distinct().count()))
    large = groups.orderBy(F.desc("n"), digest, "g_").limit(hot).select(F.col("g_").alias("same_"), F.concat_ws(":", F.lit("g"), digest, F.col("g_").cast("string")).alias("large_"))
    of = groups.join(F.broadcast(large), F.col("g_").eqNullSafe(F.col("same_")), "left").select("g_", F.coalesce("large_", F.concat_ws(":", F.lit("b"), F.pmod(F.conv(F.left(digest, F.lit(12)), 16, 10).cast("long"), F.lit(per_kind)).cast("string"), F.to_json("most_"))).alias("entry_"))
    of = cut(of)  # large is ``hot`` rows at most
    per = counts.join(of.withColumnRenamed("g_", "of_"), F.col("g_").eqNullSafe(F.col("of_"))).groupBy("entry_", "kind_", "root_").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    kinds, roots = {}, {}
    for r in per:
        own = kinds.setdefault(r["entry_"], {})
        own[r["kind_"]] = own.get(r["kind_"], 0) + r["n"]
        if r["root_"] is not None and r["x"]:
            own = roots.setdefault(r["entry_"], {})
            own[r["root_"]] = own.get(r["root_"], 0) + r["x"]
    placed = assign_groups(list(kinds.items()), shares)
    if not placed:
        return df.withColumn("split", F.lit(None).cast("string"))
    sizes = {k: sum(v.values()) for k, v in kinds.items()}
    names = list(shares)
    every, total = sorted({r for v in roots.values() for r in v}), sum(sizes.values())
    for name in names[1:]:
        placed = exchange(roots, sizes, placed, name, every, shares[name] * total, rounds=len(placed), source=names[0])
        placed = resize(roots, sizes, placed, name, every, shares[name] * total, source=names[0])
    table = F.broadcast(df.sparkSession.createDataFrame(list(placed.items()), "entry_ string, split string"))  # at most 2 * hot rows
    table = of.join(table, "entry_").select("g_", "split")
    return df.join(table, F.col(group).eqNullSafe(F.col("g_")), "left").drop("g_")


def target_cap(df: DataFrame, kind: str, targets: dict[str, int], order: list[Column]) -> DataFrame:
    """At most the target of each type; types without a target are dropped."""
    limit = F.element_at(F.create_map(*(x for k, n in targets.items() for x in (F.lit(k), F.lit(n)))), F.col(kind))
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where((F.col("rank_") <= max(targets.values(), default=0)) & (F.col("rank_") <= limit)).drop("rank_")


def window_starts(files: DataFrame, k: int, size: int = 15, lowest: int = 1000, seed: int = 42) -> DataFrame:
    """files(file, n_rows): k hash-drawn starts of whole windows for each file that has one, from row ``lowest`` on where possible."""
    low = F.least(F.lit(lowest), F.col("n_rows") - size)
    rows = files.where(F.col("n_rows") >= size).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.withColumn("start", (low + F.pmod(F.conv(F.left(hash_order(F.concat_ws("|", "file", F.col("draw").cast("string")), seed), F.lit(12)), 16, 10).cast("long"), F.col("n_rows") - size - low + 1)).cast("long"))


def prompt_repeats(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Occurrence number of each prompt; the second and later get a suffix number within 16."""
    n = F.row_number().over(Window.partitionBy(F.xxhash64(text), text).orderBy(*order))
    return df.withColumn("occurrence", n).withColumn("suffix", F.when(n > 1, F.pmod(n - 1, F.lit(16))))


def turn_rules(turns: DataFrame, text: str = "text") -> DataFrame:
    """Structure rules of an agent turn as columns, each 1 where it is broken."""
    t = F.coalesce(F.col(text), F.lit(""))
    count = lambda p: F.regexp_count(t, F.lit(p))
    calls, finals, thinks = count(r"(?s)<tool_call>.*?</tool_call>"), count(r"(?s)<diagnosis>.*?</diagnosis>"), count(r"(?s)<think>.*?</think>")
    body = F.regexp_extract(t, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)
    return turns.select(
        "*", (thinks != 1).cast("int").alias("bad_think"), (calls + finals != 1).cast("int").alias("bad_action"),
        ((calls > 0) & F.try_parse_json(F.nullif(body, F.lit(""))).isNull()).cast("int").alias("bad_json"),
        ((calls > 0) & (thinks > 0) & (F.instr(t, "<tool_call>") < F.instr(t, "</think>"))).cast("int").alias("bad_order"),
    )


def dataset_summary(turns: DataFrame, conv: str, kind: str) -> DataFrame:
    """Conversations and mean turns by kind."""
    per = turns.groupBy(conv).agg(F.count("*").alias("n"), F.max(kind).alias("kind"))
    return per.groupBy("kind").agg(F.count("*").alias("n_examples"), F.avg("n").alias("avg_turns"))


def dataset_report(records: DataFrame, turns: DataFrame) -> DataFrame:
    """Examples, mean turns and mean calls of records(conv_id, scenario_type, augmentation, n_calls): in all, by type, by augmentation, in one pass of grouping sets."""
    n = turns.groupBy("conv_id").agg(F.count("*").alias("turns_"))
    rows = records.select("conv_id", F.coalesce("scenario_type", F.lit("unknown")).alias("scenario_type"), F.coalesce("augmentation", F.lit("full_trajectory")).alias("augmentation"), F.coalesce("n_calls", F.lit(0)).alias("calls_")).join(n, "conv_id", "left")
    return rows.groupingSets([[], ["scenario_type"], ["augmentation"]], "scenario_type", "augmentation").agg(F.count("*").alias("n_examples"), F.avg(F.coalesce("turns_", F.lit(0))).alias("avg_turns"), F.avg("calls_").alias("avg_calls"), F.grouping_id().cast("long").alias("gid"))


def missing_from(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys of ``wanted``, each once, that ``there`` hasn't got; a null is a key like others."""
    return wanted.select(key).subtract(there.select(key))


def fill_targets(batch, targets: dict[str, int], kind: str, key: str, rounds: int = 20) -> DataFrame:
    """Rows of ``batch(round)`` until each type has its target or the rounds are over; a row each key, earlier rounds first.

    A round's rows are written before the next is made, so a lost executor doesn't repeat what was generated.
    """
    taken, got = None, dict.fromkeys(targets, 0)
    for k in range(rounds):
        open_ = {t: n - got[t] for t, n in targets.items() if n > got[t]}
        if not open_:
            break
        new = batch(k)
        if taken is not None:
            new = new.join(taken.select(key), key, "left_anti")
        new = cut(target_cap(new.dropDuplicates([key]), kind, open_, [hash_order(F.col(key)), F.col(key)]))
        got |= {r[kind]: got[r[kind]] + r["count"] for r in new.groupBy(kind).count().collect()}
        taken = new if taken is None else taken.unionByName(new)
    return taken


def curriculum(df: DataFrame, kind: str, key: str, pools: dict[str, float], clean: str = "no_fault", clean_most: int = 100) -> DataFrame:
    """Rows of a training stage: each type with its probability, by a hash threshold of the key, and at most ``clean_most`` without a fault."""
    place = F.conv(F.left(hash_order(F.col(key)), F.lit(8)), 16, 10).cast("long") / float(16**8)
    share = F.element_at(F.create_map(*(x for k, p in pools.items() for x in (F.lit(k), F.lit(float(p))))), F.col(kind))
    rows = df.where(place < share)
    free = rows.where(F.contains(F.col(kind), F.lit(clean))).orderBy(hash_order(F.col(key)), key).limit(clean_most)  # the cap is the feature
    return rows.where(~F.contains(F.col(kind), F.lit(clean))).unionByName(free)
