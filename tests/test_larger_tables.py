"""Steps whose work or memory once grew faster than their input."""

import hashlib
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawlytics.catalog import inputs, queries
from drawlytics.operators import evaluate, forest
from drawlytics.plans import kernels
from drawlytics.plans.skew import join_hot
from drawlytics.sources import history
from drawlytics.sources.fixture import draws_from_orders


def test_large_left_sides_are_not_sent_to_the_driver(spark):
    left = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    right = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = join_hot(left, right, ["k"], part_rows=5)
    assert sorted(map(tuple, joined.collect())) == sorted((i % 10, i, i % 10 * 2) for i in range(100))
    last = [line for line in joined._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line][0]
    assert "SortMergeJoin" in last


def test_tracking_joins_one_row_per_subset(spark, idx):
    """Before, each subset of a combination met a row per chance number, and the subsets of all were broadcast."""
    played = idx.where("draw_idx < 40").selectExpr("series", "draw_id AS combo_id", "array(n1, n2, n3, n4, n5) AS nums", "chance")
    tracked = evaluate.track_performance(played, idx)
    plan = tracked._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "by_chance" in plan
    counts = tracked.groupBy("combo_id").agg(F.sum("cnt").alias("n")).collect()
    assert {r["n"] for r in counts} == {idx.count()} and len(counts) == 40


def test_split_search_keeps_no_count_per_cell_and_label():
    """The sums that are followed hit by hit choose the cuts of the full counts, in less memory than one of them."""
    rng = np.random.default_rng(7)
    rows, nodes, labels, features = 4000, 500, 49, 56
    node = np.sort(np.concatenate([np.arange(nodes), rng.integers(0, nodes, rows - nodes)]))
    codes = rng.integers(0, 6, (rows, features)).astype(np.uint8)
    weight = rng.integers(1, 4, rows)
    y = (rng.random((rows, labels)) < 0.1).astype(np.int64)
    rules = forest.Rules(1, 60, 2, 2, 7, 85)
    tries = forest.tried(np.zeros(nodes, np.int64), np.arange(nodes), features, rules)
    for min_leaf in (1, 3):
        own, feature, code, _ = forest.best_cuts(*forest.histogram(node, tries, codes, weight, y), min_leaf)
        found = np.take_along_axis(codes, tries[node], axis=1).T.astype(np.int64)
        tracemalloc.start()
        got = forest.best_splits(node, tries, found, weight, *np.nonzero(y), labels, min_leaf)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [x.tolist() for x in got] == [own.tolist(), feature.tolist(), code.tolist()]
        assert peak < rows * tries.shape[1] * labels * 8


@pytest.mark.parametrize("head, total", [("12345|null|all", 49), ("12345|null|" + "é" * 40, 49), ("1|null", 11)])
def test_hashed_tickets_of_many_draws_at_a_time(head, total):
    rng = np.random.default_rng(3)
    index = np.arange(995, 1000) if total == 11 else np.arange(7000, 7060)
    hit = rng.random((len(index), total + 1)) < 0.2

    def matches(run):
        n = 0
        for at, own in zip(index.tolist(), hit):
            picked = []
            for j in range(total - 4, total + 1):
                u = int(hashlib.md5(f"{head}|{run}|{at}|{j}".encode()).hexdigest()[:12], 16) / 281474976710656
                t = 1 + math.floor(u * j)
                picked.append(j if t in picked else t)
            n += sum(bool(own[p]) for p in picked)
        return n

    assert kernels.floyd_matches(head.encode(), index, hit, range(98, 102), total, 5).tolist() == [matches(r) for r in range(98, 102)]


def test_null_hashes_no_key_by_itself(spark, idx):
    means = evaluate.null_run_means(idx, 3, 10, mode="md5")
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan and means.count() == 3


def test_a_history_has_files_by_its_rows(spark, tmp_path):
    """Before, every task left a file in every month; an empty history is still refused and leaves no version."""
    rows = spark.range(0, 4000, 1, 16).selectExpr("'a' AS series", "id AS draw_id", "date_add(DATE'2020-01-01', CAST(id % 120 AS INT)) AS draw_date")
    base = str(tmp_path / "h")
    assert history.write_history(rows, base) == 1
    assert len(list((tmp_path / "h" / "data" / "v=1").glob("part=*/*.parquet"))) <= 8
    with pytest.raises(ValueError):
        history.write_history(rows.where("false"), base)
    assert history.history_versions(spark, base) == [1]
    assert history.read_history(spark, base).count() == 4000


def test_a_small_forest_goes_to_the_rows(spark, monkeypatch):
    """Before, every row was dealt to every tree and its shares were shuffled back."""
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.integers(0, 9, 3).tolist()) for i in range(200)], "row bigint, x array<bigint>")
    leaf = [(t, n, 2, 5, None, None, rng.random(2).tolist()) for t in range(3) for n in (2, 6, 7)]
    inner = [(t, n, 1, 9, (t + n) % 3, 4, [0.5, 0.5]) for t in range(3) for n in (1, 3)]
    nodes = spark.createDataFrame(leaf + inner, forest.NODE)
    small = forest.score(rows, nodes, 2)
    assert "Join" not in small._jdf.queryExecution().optimizedPlan().toString()
    here = {r["row"]: r["p"] for r in small.collect()}
    monkeypatch.setattr(forest, "MOST_BYTES", 0)
    assert here == {r["row"]: r["p"] for r in forest.score(rows, nodes, 2).collect()} and len(here) == 200


def test_both_copies_of_a_draw_come_from_one_pass(spark, sf_dir):
    """Before, a task built the draws of its share twice, each time sorted, hashed by draw twice and sorted again."""
    plan = queries.validate_draws(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == plan.count("Relation [o_orderkey") == 1
    assert "Union" not in plan and plan.count("Aggregate") == 1


def test_draws_of_odd_orders(spark, tmp_path):
    """Repeated numbers, ties of a line, short and long orders, no line number, lines or orders without a partner."""
    rng = np.random.default_rng(11)
    lines = [(int(o), int(p), int(n)) for o, p, n in zip(rng.integers(-20, 60, 600), rng.integers(1, 300, 600), rng.integers(1, 6, 600))]
    lines += [(70, p, p) for p in range(1, 5)] + [(71, 49 * p, p) for p in range(1, 9)] + [(72, p, None if p == 5 else p) for p in range(1, 8)]
    lines += [(73, p, 200 - p) for p in range(1, 200)] + [(None, p, p) for p in range(1, 8)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    keys = [k for k in range(-20, 80) if k != 7]
    orders = spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").selectExpr("*", "DATE'2020-01-01' AS o_orderdate", "'a' AS o_orderpriority", "1L AS o_custkey")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    want = {}
    for k in keys:
        first = {}
        for _, p, n in (x for x in lines if x[0] == k):
            seen = first.get(p % 49 + 1)
            first[p % 49 + 1] = n if seen is None else min(seen, n) if n is not None else seen
        if len(first) >= 5:
            want[k] = tuple(sorted(first, key=lambda x: (first[x] is not None, first[x] or 0, x))[:5])
    draws = draws_from_orders(spark, str(tmp_path))
    got = {r["draw_id"]: (r["n1"], r["n2"], r["n3"], r["n4"], r["n5"]) for r in draws.collect()}
    assert got == want and {72, 73} <= set(got) and not {70, 71} & set(got)

    defects = {1: ("n1", 0), 2: ("n2", 50), 4: ("n4", None), 5: ("chance", None), 6: ("chance", 11), 7: ("draw_date", None)}
    expected = []
    for r in (x.asDict() for x in draws.collect()):
        code = int(math.fmod(r["draw_id"], 7)) + 1
        name, value = defects.get(code, ("n3", r["n2"]) if code == 3 else ("chance", r["chance"]))
        expected += [r | {"copy": 0}, r | {"copy": code, name: value}]
    shown = inputs.dirty(draws)
    order = lambda rows: sorted(map(str, (tuple(r[c] for c in shown.columns) for r in rows)))
    assert shown.columns == [*draws.columns, "copy"] and order(r.asDict() for r in shown.collect()) == order(expected)
