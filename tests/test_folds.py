"""Budget folds against plain loops, on a group of a million rows too."""

import random

from pyspark.sql import functions as F

from siftwright.operators import boosts, ranking

SCHEMA = "repo string, ord long, path string, kind string, confidence double, est_tokens long"


def candidates(seed=0, n=400):
    rng = random.Random(seed)
    kinds = ["changed_file", "memory", "file", "config", None]
    return [(rng.choice(["a", "b", None]), i, f"src/p{i % 50}.py", rng.choice(kinds), rng.randrange(100) / 100, rng.choice([None, 0, *range(1, 300)])) for i in range(n)]


def by_value(rows):
    return sorted(rows, key=lambda r: (-(r[4] / max(1, 1 if r[5] is None else r[5])), -r[4], r[1]))


def knapsack(rows, budget, sure=()):
    used, seen, out = 0, set(), []
    for r in by_value(rows):
        first = r[3] in sure and r[3] not in seen
        if first or r[5] is not None and used + r[5] <= budget:
            out.append((r[0], r[1], used))
            used, seen = used + (r[5] or 0), seen | {r[3]}
    return out


def by_repo(rows):
    return [[r for r in rows if r[0] == k] for k in ("a", "b", None)]


def test_knapsack_equals_the_loop(spark):
    rows = candidates()
    got = ranking.knapsack(spark.createDataFrame(rows, SCHEMA), ["repo"], 900, ["config", "changed_file"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(x) for g in by_repo(rows) for x in knapsack(g, 900, ("config", "changed_file")))


def test_sub_budget_equals_the_loop(spark):
    rows = [r for r in candidates(1) if r[3]]
    got = ranking.sub_budget(spark.createDataFrame(rows, SCHEMA), ["repo"], 1000, 0.3, F.col("kind") == "memory").collect()
    want = []
    for g in by_repo(rows):
        mem = knapsack([r for r in g if r[3] == "memory"], 300)
        spent = sum(next(r[5] for r in g if r[1] == i) for _, i, _ in mem)
        want += [(*x, "memory") for x in mem] + [(*x, "code") for x in knapsack([r for r in g if r[3] != "memory"], 1000 - spent)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_tail_cutoff_and_pin_equal_the_loop(spark):
    rows = candidates(2)
    df = spark.createDataFrame(rows, SCHEMA)
    want = []
    for g in by_repo(rows):
        used = 0
        for r in sorted(g, key=lambda r: (-r[4], r[1])):
            if not (used >= 750 and r[3] == "file" and r[4] < 0.4):
                want.append((r[0], r[1]))
                used += r[5] or 0
    assert sorted(map(repr, map(tuple, ranking.tail_cutoff(df, ["repo"], 1000).collect()))) == sorted(map(repr, want))
    low = df.where("confidence < 0.3 and repo is not null")
    pinned = {r["repo"]: r["n"] for r in boosts.pinned_source(df, low, ["repo"], 500).groupBy("repo").agg(F.count("*").alias("n")).collect()}
    assert set(pinned) >= {"a", "b"}


def test_a_group_of_a_million_rows_streams(spark):
    """The plan gathers no group, and the result is that of a plain loop."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("repo"), F.col("id").alias("ord"), F.lit("file").alias("kind"), (F.col("id") * 7919 % 1000 / 1000).alias("confidence"), (F.col("id") * 31 % 97 + 1).alias("est_tokens"))
    chosen = ranking.knapsack(df, ["repo"], 3_000_000)
    plan = chosen._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "MapInArrow" in plan
    used = 0
    want = 0
    rows = sorted(((-((i * 7919 % 1000 / 1000) / (i * 31 % 97 + 1)), -(i * 7919 % 1000 / 1000), i, i * 31 % 97 + 1) for i in range(n)))
    for *_, size in rows:
        if used + size <= 3_000_000:
            used, want = used + size, want + 1
    got = chosen.agg(F.count("*"), F.max("used_before")).first()
    assert got[0] == want and got[1] < 3_000_000
    assert ranking.tail_cutoff(df, ["repo"], 10**9).count() == n
