"""Near duplicates by MinHash with tensored banding, confirmed on full shingle sets.

Two collections of ``TABLES`` half keys are computed for each set, each half key from ``ROWS`` minimum
hashes.  The keys of the LSH tables are all pairs of a half key of the first and one of the second collection, so
``TABLES ** 2`` tables cost ``2 * TABLES * ROWS`` minimum hashes.  At similarity 0.8 a pair shares no table with
probability 2 * (1 - 0.8 ** ROWS) ** TABLES, about one in 800.

1. Texts become sorted sets of 64-bit shingle hashes; equal sets form a class, which is a node with a number of its own.
2. A half key that only one node has can't lead to a pair; the tensor product is formed of the others.
3. In every table the smallest node is the centre.  Each node is compared with its smallest centre; then, in tables that
   still hold several components, with the table's centre; and at last those pairs that are in no component together.
4. Links join into components by alternating large and small stars on tables of edges.

Defined results: a document without words (null or empty text) has n_shingles 0 and is linked with
nothing; rows with equal doc_id count as one document, linked, whatever their texts (``near_duplicates``), while
``one_of_each`` drops rows for their texts alone; a null doc_id gives a null component and is kept;
an empty table gives an empty result; other columns are ignored.
A text of any length gives its whole set; one set is the most that a task holds beside its batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import materialise, scratch, tidy, tune

TABLES = 14
ROWS = 4
#: Comparisons in a bucket up to which its candidate pairs are made rows, and shingles of a slice of a larger bucket.
#: Both ways compare the same pairs.
PAIRED = 4000
SLICE = 400_000
EDGES_PER_TASK = 1_000_000
SIGNATURE = "doc_id long, n_shingles long, set_key binary, first array<long>, second array<long>"

#: Odd multipliers of a 64-bit mixing function.
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all sets one after the other, each sorted and distinct; size of each set).

    Words are runs of other characters than blank and U+0009 to U+000D, with A-Z in lower case.  A text of
    fewer than ``size`` words is one shingle; one without words has an empty set.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    words = lists.flatten().dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(words.dictionary))
    hashes = own[words.indices.to_numpy()]
    counts = np.array(pc.list_value_length(lists), np.int64)
    # an empty text is one empty piece
    empty = np.array(pc.equal(pc.binary_length(pc.list_element(lists, 0)), 0).to_numpy(zero_copy_only=False), bool) & (counts == 1) if len(counts) else np.zeros(0, bool)
    edge = np.concatenate([[0], np.cumsum(counts)])
    state = _mix(hashes + np.uint64(1))
    for k in range(1, size):
        state = _mix(state[:-1] * np.uint64(3) + hashes[k:]) if len(state) > 1 else state[:0]
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, (a, n, none) in enumerate(zip(edge[:-1].tolist(), counts.tolist(), empty.tolist())):
        if none:
            continue
        if n >= size:
            own_set = np.unique(state[a : a + n - size + 1])
        else:
            x = np.uint64(n)
            for h in hashes[a : a + n]:
                x = _mix(np.array([x * _M1 + h], np.uint64))[0]
            own_set = np.array([x], np.uint64)
        sets.append(own_set)
        sizes[i] = len(own_set)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def half_keys(sets: np.ndarray, sizes: np.ndarray, tables: int, rows: int) -> np.ndarray:
    """A row for each set that isn't empty: ``tables`` half keys of the first collection, then of the second; their lowest bit tells which."""
    rng = np.random.Generator(np.random.PCG64(7))
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.zeros((len(starts), 2 * tables), np.uint64)
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        for column in range(2 * tables):
            key = np.full(len(starts), np.uint64(column + 1))
            for _ in range(rows):
                factor, plus = rng.integers(0, 2**64, 2, np.uint64)
                key = _mix(key * np.uint64(3) + np.minimum.reduceat(sets * (factor | np.uint64(1)) + plus, starts))
            out[:, column] = (key & ~np.uint64(1)) | np.uint64(column >= tables)
    return out


def _lists(values: np.ndarray, present: np.ndarray) -> pa.Array:
    width = values.shape[1]
    offsets = np.concatenate([[0], np.cumsum(present * width)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _set_bytes(sets: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes | None]]:
    """(each set as little-endian 64-bit hashes, its digest; none for an empty set)."""
    import xxhash

    data, edge = sets.tobytes(), (8 * np.concatenate([[0], np.cumsum(sizes)])).tolist()
    own = [data[a:b] for a, b in zip(edge[:-1], edge[1:])]
    return own, [xxhash.xxh3_128_digest(x) if x else None for x in own]


def signatures(docs: DataFrame, size: int, tables: int, rows: int) -> DataFrame:
    """Columns: ``SIGNATURE``."""

    def run(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                sets, sizes = shingle_sets(batch.column(1), size)
                keys = half_keys(sets, sizes, tables, rows)
            _, digest = _set_bytes(sets, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(digest, pa.binary()), _lists(keys[:, :tables], sizes > 0), _lists(keys[:, tables:], sizes > 0)],
                ["doc_id", "n_shingles", "set_key", "first", "second"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), SIGNATURE)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and its set, for the classes (node, rep, set_key) in ``wanted``."""

    def run(batches):
        seen = set()
        for batch in batches:
            with np.errstate(over="ignore"):
                own, names = _set_bytes(*shingle_sets(batch.column(1), size))
            new = []
            for node, name, key in zip(batch.column(0).to_pylist(), names, batch.column(2).to_pylist()):
                new.append(name == key and node not in seen)  # else another text with this doc_id, or a repeated row
                if new[-1]:
                    seen.add(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], ["node", "grams"]).filter(pa.array(new, pa.bool_()))

    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("rep"))
    sets = materialise(rows.select("node", "text", "set_key").mapInArrow(tidy(run), "node long, grams binary"), "sets", codec="none")
    if sets.groupBy("node").count().where("count > 1").isEmpty():
        return sets
    return materialise(sets.dropDuplicates(["node"]), "sets", codec="none")  # rows that were repeated in several tasks


def with_set_key(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` with the digest of each text's set as set_key_; null without words."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            with np.errstate(over="ignore"):
                _, names = _set_bytes(*shingle_sets(batch.column(at), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.binary())], [*batch.schema.names, "set_key_"])

    return docs.mapInArrow(tidy(run), docs.withColumn("set_key_", F.lit(None).cast("binary")).schema)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(left, right):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge (a, b) reaches. Nodes without an edge are not returned."""
    current = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    tasks = 8 + current.count() // EDGES_PER_TASK
    while True:
        # done when every node has one smaller neighbour, which has none
        several = current.groupBy("a").count().where("count > 1").select("a")
        inner = current.select(F.col("b").alias("a")).join(current.select("a"), "a", "left_semi")
        if several.unionByName(inner).isEmpty():
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # large star: larger neighbours move to the smallest neighbour
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialise(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges", tasks=tasks)
        # small star: smaller neighbours and the node move to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialise(moved.where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges", tasks=tasks)


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of small buckets: different components, a shared half key of the other side, and sizes that allow a link."""
    fields = ("node", "n", "component", "vs")
    left = rows.where("component <> major").select("u", *(F.col(c).alias(f"{c}_a") for c in fields))
    right = rows.select("u", *(F.col(c).alias(f"{c}_b") for c in fields))
    near = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & F.arrays_overlap("vs_a", "vs_b")
    return left.join(right, "u").where((F.col("component_a") != F.col("component_b")) & near).select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def _in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the same candidate pairs in large buckets, found without making rows of pairs.

    A bucket's members are dealt to slices and its queries (outside the largest component) to blocks of about ``SLICE``
    shingles; each slice meets each block in a task of its own, whose memory is bounded so.  A query gets one link to each
    component that it meets.
    """

    def compare(group):
        import pandas as pd

        members, queries = group[~group["query"]], group[group["query"]]
        links = []
        if len(members) and len(queries):
            grams = [np.frombuffer(x, np.uint64) for x in members["grams"]]
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            vocabulary, ids = np.unique(np.concatenate(grams), return_inverse=True)
            starts, nodes, own = np.cumsum(sizes) - sizes, members["node"].to_numpy(), members["component"].to_numpy()
            # members by half key of the other side
            keys = [np.asarray(v, np.int64) for v in members["vs"]]
            holder = np.repeat(np.arange(len(keys)), list(map(len, keys)))
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            keys, holder = keys[order], holder[order]
            for node, component, vs, data in zip(queries["node"].tolist(), queries["component"].tolist(), queries["vs"], queries["grams"]):
                x = np.frombuffer(data, np.uint64)
                vs = np.asarray(vs, np.int64)
                low, high = np.searchsorted(keys, vs), np.searchsorted(keys, vs, side="right")
                near = np.zeros(len(sizes), bool)
                for i, j in zip(low.tolist(), high.tolist()):
                    near[holder[i:j]] = True
                near &= (own != component) & (100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x)))
                near = np.flatnonzero(near)
                if not len(near):
                    continue
                at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
                known = np.zeros(len(vocabulary), np.int32)
                known[at[vocabulary[at] == x]] = 1
                size = sizes[near]
                begin = np.cumsum(size) - size
                both = np.add.reduceat(known[ids[np.arange(int(size.sum())) + np.repeat(starts[near] - begin, size)]], begin)
                hit = near[100 * both >= percent * (size + len(x) - both)]
                _, once = np.unique(own[hit], return_index=True)
                links += [(max(node, r), min(node, r)) for r in nodes[hit[once]].tolist()]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    deal = lambda n: F.pmod(F.xxhash64("node"), n)
    rows = rows.select("u", "node", "component", "vs", (F.col("component") != F.col("major")).alias("asks"), F.ceil(F.col("weight") / SLICE).cast("int").alias("slices"))
    numbers = F.sequence(F.lit(0), F.col("slices") - 1)
    members = rows.select("u", "node", "component", "vs", F.lit(False).alias("query"), deal(F.col("slices")).cast("int").alias("slice"), F.explode(numbers).alias("block"))
    queries = rows.where("asks").select("u", "node", "component", "vs", F.lit(True).alias("query"), F.explode(numbers).alias("slice"), deal(F.col("slices")).cast("int").alias("block"))
    # blocks without a query need no members
    asked = queries.select("u", "block").distinct()
    dealt = members.join(asked, ["u", "block"]).select(*queries.columns).unionByName(queries)
    return dealt.join(sets, "node").groupBy("u", "slice", "block").applyInPandas(compare, "a long, b long")


def _classes(signs: DataFrame) -> DataFrame:
    """set_key, rep (smallest doc_id) and number of each class of equal sets."""
    worded = signs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    return worded.groupBy("set_key").agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id())


def _links(docs: DataFrame, signs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the nodes of classes whose sets are alike; enough of them for the right components."""
    nodes = signs.where("n_shingles > 0").select("doc_id", "set_key", "n_shingles", "first", "second").join(classes.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"])
    halves = materialise(nodes.select("node", F.col("n_shingles").alias("n"), F.explode(F.concat("first", "second")).alias("key")), "halves")
    shared = halves.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    useful = halves.join(shared, "key").groupBy("node").agg(F.max("n").alias("n"), F.collect_set("key").alias("keys"))  # at most 2 * tables keys
    sides = useful.select("node", "n", F.filter("keys", lambda k: k.bitwiseAND(1) == 0).alias("us"), F.filter("keys", lambda k: k.bitwiseAND(1) == 1).alias("vs"))
    sides = materialise(sides.where("size(us) > 0 AND size(vs) > 0"), "sides")
    tensor = sides.select("node", F.explode("us").alias("u"), "vs").select("node", "u", F.explode("vs").alias("v"))
    entries = materialise(tensor.select("node", F.xxhash64("u", "v").alias("key")), "tables")

    # of each node's centres the one that it shares most tables with, so likely the one most like it
    centres = entries.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("high")).where("b <> high").select("key", "b")
    met = entries.join(centres, "key").groupBy("node", "b").agg(F.count("*").alias("c"))
    met = met.groupBy("node").agg(F.max_by("b", F.struct(F.col("b") != F.col("node"), "c", -F.col("b"))).alias("b"))
    first = materialise(met.select(F.col("node").alias("a"), "b"), "centres")
    sets = _sets(docs, first.select(F.col("a").alias("node")).join(classes, "node"), size)
    links = materialise(_confirm(first.where("a <> b"), sets, percent), "links")
    found = components(links)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))

    # tables that still hold several components: each entry outside the table's largest component meets the smallest node of that one
    placed = materialise(labelled(entries), "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    mixed = materialise(placed.join(several, "key"), "mixed")
    shares = mixed.groupBy("key", "component").agg(F.count("*").alias("c"), F.min("node").alias("b"))
    centre = shares.groupBy("key").agg(F.max_by(F.struct("b", "component"), F.struct("c", "component")).alias("m")).select("key", "m.b", F.col("m.component").alias("of_b"))
    apart = materialise(mixed.join(centre, "key").where("component <> of_b").select(F.col("node").alias("a"), "b").distinct(), "pairs")
    links = links.unionByName(materialise(_confirm(apart, sets, percent), "links"))
    found = components(links)

    # what is left: in buckets of one half key that hold several components, the nodes outside of the
    # bucket's largest component against all of its nodes; any other pair is in one component already
    open_ = mixed.select("node").distinct()
    rows = materialise(labelled(sides.join(open_, "node")).select("node", "n", "component", "vs", F.explode("us").alias("u")), "rest")
    parts = rows.groupBy("u", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    buckets = parts.groupBy("u").agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.max("c").alias("largest"), F.sum("c").alias("size"), F.sum("n").alias("weight"))
    buckets = materialise(buckets.where("size > largest").withColumn("work", F.col("size") * (F.col("size") - F.col("largest"))), "buckets")
    rows = materialise(rows.join(buckets.select("u", "major", "weight", "work"), "u"), "open")
    few = materialise(_pairs(rows.where(F.col("work") <= PAIRED), percent), "pairs")
    many = _in_blocks(rows.where(F.col("work") > PAIRED), sets, percent)
    return links.unionByName(materialise(_confirm(few, sets, percent).unionByName(many), "links"))


def _same_ids(signs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of texts that share a doc_id."""
    worded = signs.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "set_key")
    again = worded.groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("low"), F.max(F.xxhash64("set_key")).alias("high")).where("low <> high").select("doc_id")
    own = materialise(worded.join(again, "doc_id").distinct().join(classes.select("set_key", "node"), "set_key").select("doc_id", "node"), "repeated")
    least = own.groupBy("doc_id").agg(F.min("node").alias("b"))
    return own.join(least, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")


def _groups(docs: DataFrame, size: int, percent: int, tables: int, rows: int, join_ids: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_key of each row; set_key, component_id, and whether the class is its component's first)."""
    tune(docs.sparkSession)
    signs = materialise(signatures(docs, size, tables, rows), "signatures")
    with scratch(docs.sparkSession) as outer:
        classes = materialise(_classes(signs), "classes")
        links = _links(docs, signs, classes, size, percent)
        if join_ids:
            links = links.unionByName(_same_ids(signs, classes))
        found = components(links)
        labelled = materialise(classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
        first = labelled.groupBy("component").agg(F.min("rep").alias("component_id"), F.min_by("node", F.struct("rep", "node")).alias("head"))
        # two tables are joined, so that a large component can be split among tasks
        whole = labelled.join(materialise(first, "first"), "component").select("set_key", "component_id", (F.col("node") == F.col("head")).alias("head"))
        whole = materialise(whole, "classes", under=outer)
    return signs.select("doc_id", "n_shingles", "set_key"), whole


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, tables: int = TABLES, rows: int = ROWS) -> DataFrame:
    """Columns: doc_id, n_shingles, component_id, kept."""
    signs, whole = _groups(docs, size, percent, tables, rows, join_ids=True)
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    out = signs.join(whole, "set_key", "left").select("doc_id", "n_shingles", found)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, tables: int = TABLES, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` but for near duplicates: of each group of like texts one row stays, the one with the smallest doc_id.

    Rows are judged by their texts: unlike texts with the same doc_id both stay, as do rows without words or doc_id.
    """
    signs, whole = _groups(docs, size, percent, tables, rows, join_ids=False)
    stays = F.coalesce(F.col("head") & (F.col("doc_id") == F.col("component_id")), F.col("set_key").isNull() | F.col("doc_id").isNull())
    flags = materialise(signs.join(whole, "set_key", "left").select("doc_id", "set_key", stays.alias("stays")).where("doc_id IS NOT NULL"), "flags")
    ids = materialise(flags.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("stays").alias("stays")).where("n > 1 OR NOT stays").select(F.col("doc_id").alias("id_"), "n", "stays"), "ids")
    alone = docs.join(ids.select("id_"), F.col("doc_id") == F.col("id_"), "left_anti")
    # rows that share their doc_id are told apart by their sets
    again = with_set_key(docs.join(ids.where("n > 1 AND stays").select("id_"), F.col("doc_id") == F.col("id_"), "left_semi"), size)
    right = flags.where("stays AND set_key IS NOT NULL").select(F.col("doc_id").alias("id_"), F.col("set_key").alias("of_")).distinct()
    best = again.join(right, (F.col("doc_id") == F.col("id_")) & (F.col("set_key_") == F.col("of_"))).select(*again.columns)
    order = Window.partitionBy("doc_id", "set_key_").orderBy(*(c for c in again.columns if c not in ("doc_id", "set_key_")))
    once = best.withColumn("nth_", F.row_number().over(order)).where("nth_ = 1")
    return alone.unionByName(once.select(*docs.columns)).unionByName(again.where("set_key_ IS NULL").select(*docs.columns))
