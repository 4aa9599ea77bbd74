"""Queries and operators do the whole job: no rows, tails or ids are left out."""

from pyspark.sql import functions as F

from ductwise.plans import catalog


def write(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")


def test_links_need_the_whole_passage(spark, tmp_path):
    start = "these forty characters open both items. "
    a, b = start + "The first goes on like this.", start + "The second ends in another way."
    write(spark, tmp_path, "benchmark", [(a,), (b,), ("",)], "text string")
    write(spark, tmp_path, "documents", [(1, start + "only the opening"), (2, f"x {a} y"), (3, f"{b} {a}")], "doc_id long, text string")
    out = catalog.QUERIES["theta_substring_link"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_matches) for r in out) == [(2, 2), (3, 1)] and {r.needle for r in out} == {start}


def test_cap_of_fitting_leaves_no_row_unscored(spark):
    from ductwise.operators import models

    rows = [(i, f"c{i % 3}", float(i % 3), float(i)) for i in range(300)] + [(999, "rare", 0.0, 0.0)]
    got = models.train(spark.createDataFrame(rows, "id int, label string, a double, b double"), ["a", "b"], "label", F.col("id"), cap=20, trees=3, depth=3)
    scored = got["scored"].collect()
    assert sorted(r.id for r in scored) == [r[0] for r in rows] and all(len(r.probabilities) == 3 for r in scored)
    assert got["labels"] == ["c0", "c1", "c2"] and sum(r.is_val is True for r in scored) == 45


def test_split_holds_shares_by_rows_at_any_number_of_groups(spark):
    from ductwise.operators import datasets

    many = spark.range(3000).select(F.concat(F.lit("g"), "id").alias("g"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"))
    rows = many.unionByName(spark.range(1500).select(F.lit("big").alias("g"), F.lit("a").alias("k")))
    for hot in (1024, 50):
        out = datasets.grouped_split(rows, "g", "k", hot=hot)
        n = {(r.split, r.k): r["count"] for r in out.groupBy("split", "k").count().collect()}
        assert out.where("g = 'big'").select("split").distinct().collect()[0].split == "train"
        assert sum(n.values()) == 4500 and all(abs(n[s, k] - w * t) <= 60 for s, w in (("train", 0.8), ("val", 0.1), ("test", 0.1)) for k, t in (("a", 3000), ("b", 1500)))


def test_a_source_that_first_comes_late_is_matched(spark, tmp_path):
    write(spark, tmp_path, "documents", [(1, "web"), (99, "webnews")], "doc_id long, source string")
    out = catalog.QUERIES["mutual_substring"](spark, str(tmp_path)).collect()
    assert sorted((r.part, r.whole) for r in out) == [("web", "web"), ("web", "webnews"), ("webnews", "web"), ("webnews", "webnews")]


def test_split_brings_few_rows_to_the_driver(spark, monkeypatch):
    from ductwise.operators import datasets

    seen = []
    real = datasets.assign_groups
    monkeypatch.setattr(datasets, "assign_groups", lambda sizes, shares, members=None: (seen.append(len(sizes)), real(sizes, shares, members))[1])
    # 20,000 groups of which hardly two have the same counts by type
    rows = spark.range(20000).select(F.concat(F.lit("g"), "id").alias("g"), F.explode(F.sequence(F.lit(0), F.pmod(F.xxhash64("id"), F.lit(5)).cast("int"))).alias("j"))
    rows = rows.select("g", F.pmod(F.xxhash64("g", "j"), F.lit(7)).cast("string").alias("k"))
    out = datasets.grouped_split(rows, "g", "k", hot=512).cache()
    assert len(seen) == 1 and seen[0] <= 2 * 512 + 7
    assert out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n <> 1").isEmpty() and out.count() == rows.count()
    n = {(r.split, r.k): r["count"] for r in out.groupBy("split", "k").count().collect()}
    total = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    assert all(abs(n[s, k] - w * total[k]) <= 0.04 * total[k] for s, w in (("train", 0.8), ("val", 0.1), ("test", 0.1)) for k in total)


def test_exchanges_equal_a_plain_search():
    import random

    from ductwise.operators import datasets

    def lack(have, least, share):
        wanted = max(least, round(share * sum(have.values())))
        return sum(max(wanted - n, 0) for n in have.values()) if sum(have.values()) else 0

    for seed in range(25):
        rng = random.Random(seed)
        names = [f"e{i:02d}" for i in range(30)]
        roots, sizes = ["a", "b", "c"][: rng.randint(1, 3)], {k: rng.randint(1, 40) for k in names}
        entries = {k: {r: rng.choice([0, 0, rng.randint(0, sizes[k])]) for r in roots} for k in names}
        placed = {k: rng.choice(["train", "train", "train", "val", "test"]) for k in names}
        goal, least = 0.1 * sum(sizes.values()), rng.choice([5, 20])
        want = dict(placed)
        for _ in range(12):
            inside, outside = [k for k in names if want[k] == "val"], [k for k in names if want[k] == "train" and any(entries[k].values())]
            count = lambda ks: {r: sum(entries[k][r] for k in ks) for r in roots}
            now, options = lack(count(inside), least, 0.2), []
            for come in outside:
                for go in ["", *inside]:
                    after = [k for k in inside if k != go] + [come]
                    options.append((lack(count(after), least, 0.2), abs(sum(sizes[k] for k in after) - goal), come, go))
            if not now or not options or min(options)[0] >= now:
                break
            _, _, come, go = min(options)
            want[come] = "val"
            if go:
                want[go] = "train"
        assert datasets.exchange(entries, sizes, placed, "val", roots, goal, least=least) == want
        assert {k for k in names if placed[k] == "test"} == {k for k in names if want[k] == "test"}
