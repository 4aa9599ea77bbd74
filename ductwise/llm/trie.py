"""The prefix trie of conversations, by preorder intervals.

A node is a distinct sequence of first turns.  Nodes are ranked lexicographically, so a subtree is an interval of ranks; its end is
the largest rank of a member's last turn, and leaves and savings of the subtree are differences of running sums over the ranks.

Ranks come by doubling: after step k a turn behind the first 2**k ones knows the rank of the turns from the start of its aligned block of
2**k turns up to itself.  A block of twice the size is a pair of such ranks (the one of the first half's last turn, then the own one), and the
distinct pairs are sorted again.  A prefix's key is the ranks of its first turn and of the blocks 2, 3-4, 5-8 and so on: log2 of its length.
So neither a prefix nor a conversation is ever one row, and a turn goes only through the steps that its depth needs.  Every number comes from range partitions; the order among siblings is that of the digests of role and text.

Defined results: rows without a conv_id are no conversation and are left out; null role or text is empty; turns go by ``turn``, null
first, equal ones by role and digest; repeated rows are turns of their own; a conversation that loses all turns stays as a member of the
root; very long texts and conversations take part as a whole; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import materialise, tidy, tune

WORDS = r"[^\x20\x09-\x0D]+"
#: Characters of joined ids in one row.
PIECE = 1 << 16
_PART = 33  # bits of a row's number within its partition
NOTHING = hashlib.sha256(b"").hexdigest()


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a number that grows in the order of ``keys``: the range partition in the high bits, the place in it in the low ones.

    Written at once, so a number never changes.
    """
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialise(dealt.withColumn(name, F.monotonically_increasing_id()), "ranked")


def _bases(rows: DataFrame, rank: str, sums: dict[str, Column]) -> DataFrame:
    """part_ and, for each name, the total of all range partitions before. A row for each partition."""
    totals = rows.groupBy(F.shiftright(rank, _PART).alias("part_")).agg(*(c.alias(n) for n, c in sums.items()))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part_", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums))


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns with their place: conv_id, i (from 1), turn (rank of role and text), words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").alias("place"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"), 256)).alias("key"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    slim = materialise(slim, "turns")
    keys = _ranked(slim.select("key").distinct(), ["key"], "turn")
    rows = slim.join(keys, "key").select("conv_id", "place", "role", "turn", "words", F.monotonically_increasing_id().alias("tie"))
    rows = _ranked(rows, ["conv_id", "place", "role", "turn", "tie"], "at").select("conv_id", "turn", "words", "at")
    # at most as many rows as range partitions
    bases = F.broadcast(_bases(rows, "at", {"base": F.count("*")}))
    at = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << _PART) - 1))
    rows = rows.withColumn("part_", F.shiftright("at", _PART)).join(bases, "part_").select("conv_id", at.alias("at"), "turn", "words")
    first = rows.groupBy("conv_id").agg(F.min("at").alias("first_"))
    return rows.join(first, "conv_id").select("conv_id", (F.col("at") - F.col("first_") + 1).alias("i"), "turn", "words")


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, rank, words of each rebuilt turn; conv_id and n, its rebuilt turns).

    Conversation c takes the first crc32(c) % ``most`` turns of c - c % ``every`` in place of as many of its own.
    """
    turns = materialise(numbered(conversations), "numbered")
    sizes = turns.groupBy("conv_id").agg(F.max("i").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = sizes.withColumn("base", base).withColumn("h", F.when(F.col("base") == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % most))
    other = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    heads = heads.join(other, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    heads = materialise(heads.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n")), "heads")
    own = turns.join(heads, "conv_id").where("i > h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("d"), "turn", "words")
    lent = turns.where((F.col("conv_id") % every == 0) & (F.col("i") < most)).select(F.col("conv_id").alias("base"), F.col("i").alias("d"), "turn", "words")
    lent = lent.join(heads, "base").where("d <= taken").select("conv_id", "d", "turn", "words")
    rows = own.unionByName(lent).withColumnRenamed("turn", "rank")
    return materialise(rows, "rebuilt"), heads.select("conv_id", "n")


def prefix_ranks(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, d, rank, words) with rank made that of the whole prefix: equal for equal prefixes, growing lexicographically."""
    longest = rows.agg(F.max("d")).first()[0] or 0
    word = lambda rank: F.unhex(F.lpad(F.hex(rank), 16, "0"))
    settled = [rows.where("d = 1").select("conv_id", "d", "words", word("rank").alias("key"))]
    half = 1
    while half < longest:
        # turns of the second half of the first 2 * half: the key of the first half, then their own block's rank
        before = settled[-1].where(F.col("d") == half).select("conv_id", F.col("key").alias("before"))
        part = rows.where((F.col("d") > half) & (F.col("d") <= 2 * half)).join(before, "conv_id")
        settled.append(materialise(part.select("conv_id", "d", "words", F.concat("before", word("rank")).alias("key")), "keys"))
        rest = rows.where(F.col("d") > 2 * half)
        half *= 2
        if half < longest:  # later turns learn the ranks of blocks of twice the size
            block = F.expr(f"(d - 1) div {half // 2}")
            first = rest.where(block % 2 == 0).select("conv_id", "d", "words", F.col("rank").alias("high"), F.lit(-1).cast("long").alias("low"))
            second = rest.where(block % 2 == 1).select("conv_id", "d", "words", "rank", (block * (half // 2)).alias("to"))
            ends = rest.select("conv_id", F.col("d").alias("to"), F.col("rank").alias("high"))
            second = second.join(ends, ["conv_id", "to"]).select("conv_id", "d", "words", "high", F.col("rank").alias("low"))
            pairs = materialise(first.unionByName(second), "pairs")
            ranks = _ranked(pairs.select("high", "low").distinct(), ["high", "low"], "rank")
            rows = materialise(pairs.join(ranks, ["high", "low"]).select("conv_id", "d", "rank", "words"), "blocks")
    keyed = settled[0]
    for part in settled[1:]:
        keyed = keyed.unionByName(part)
    return materialise(keyed.join(_ranked(keyed.select("key").distinct(), ["key"], "rank"), "key").select("conv_id", "d", "rank", "words"), "prefixes")


def _ends(last: DataFrame) -> DataFrame:
    """rank and ends_sha256 of the nodes (rank, conv_id) that conversations end at.

    Sorted ids are joined to pieces of bounded size where they lie; a digest is one stream of its node's pieces, in constant memory.
    """

    def join(batches):
        rank, first, ids, size = None, None, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([rank], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["rank", "first", "ids"])

        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (r != rank or size > PIECE):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    rank, first = r, c
                ids.append(str(c))
                size += len(ids[-1])
        if ids:
            yield piece()

    def digest(batches):
        rank, state = None, None
        for batch in batches:
            done: list[tuple[int, str]] = []
            for r, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if r == rank:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((rank, state.hexdigest()))
                    rank, state = r, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done])], ["rank", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rank], pa.int64()), pa.array([state.hexdigest()])], ["rank", "ends_sha256"])

    pieces = last.select("rank", "conv_id").repartitionByRange("rank", "conv_id").sortWithinPartitions("rank", "conv_id").mapInArrow(tidy(join), "rank long, first long, ids string")
    return pieces.repartition("rank").sortWithinPartitions("rank", "first").mapInArrow(tidy(digest), "rank long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end."""
    spark = conversations.sparkSession
    tune(spark)
    rows, sizes = rebuilt(conversations)
    rows = prefix_ranks(rows)
    last = sizes.join(rows.select("conv_id", F.col("d").alias("n"), "rank"), ["conv_id", "n"], "left").select("conv_id", "n", F.coalesce("rank", F.lit(-1)).alias("rank"))
    last = materialise(last, "last")  # the root has the rank -1
    digests = materialise(_ends(last), "ends")
    nodes = (
        rows.join(last.select("conv_id", F.col("rank").alias("last")), "conv_id")
        .groupBy("rank").agg(F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("last").alias("end"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    )
    above = rows.select("conv_id", (F.col("d") + 1).alias("depth"), F.col("rank").alias("parent"))
    nodes = materialise(nodes.join(above, ["conv_id", "depth"], "left"), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("rank")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "rank", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = materialise(nodes.withColumn("part_", F.shiftright("rank", _PART)), "nodes")
    # running sums: within each range partition, plus the totals of those before, a row for each partition
    bases = F.broadcast(_bases(nodes, "rank", {"at0": F.count("*"), "leaves0": F.sum("leaf"), "saved0": F.sum("saved")}))
    within = Window.partitionBy("part_").orderBy("rank")
    upto = nodes.select("part_", "rank", "leaf", "saved", F.row_number().over(within).alias("at"), F.sum("leaf").over(within).alias("leaves"), F.sum("saved").over(within).alias("sum"))
    upto = upto.join(bases, "part_").select("rank", (F.col("at0") + F.col("at")).alias("at"), (F.col("leaves0") + F.col("leaves")).alias("leaves"), (F.col("saved0") + F.col("sum")).alias("sum"), "leaf", "saved")
    upto = materialise(upto, "sums")
    before = upto.select("rank", F.col("at").alias("preorder"), (F.col("leaves") - F.col("leaf")).alias("leaves_before"), (F.col("sum") - F.col("saved")).alias("saved_before"))
    ends = upto.select(F.col("rank").alias("end"), F.col("at").alias("subtree_end"), "leaves", "sum")
    out = nodes.drop("leaf", "saved", "part_", "words").join(before, "rank").join(ends, "end")
    out = out.join(digests, "rank", "left")

    whole = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    if not whole["n"]:
        root = []
    else:
        sums = nodes.agg(F.count("*").alias("n"), F.sum((F.col("depth") == 1).cast("long")).alias("children"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")).first()
        end = digests.where("rank = -1").first()
        root = [(whole["conv_id"], 0, None, whole["n"], sums["children"] or 0, sums["leaves"] or 1, sums["saved"] or 0, end["ends_sha256"] if end else NOTHING, 0, sums["n"])]
    names = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, preorder long, subtree_end long"
    parents = nodes.select(F.col("rank").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, "parent", "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == 1, F.lit(whole["conv_id"])).otherwise(F.col("parent_conv_id")).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") - F.col("leaves_before")).alias("n_leaves"), (F.col("sum") - F.col("saved_before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "preorder", "subtree_end",
    )
    return out.unionByName(spark.createDataFrame(root, names))
