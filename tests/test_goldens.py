"""Known values and invariants."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from drawlytics.functions.columns import moon_phase, moon_phase_name, parse_draw_date, prize_rank
from drawlytics.operators import combos, cycles, evaluate, features, freq, gaps, odds, patterns, scores, weights
from drawlytics.params import GAME, Game
from drawlytics.plans.blocks import prefix_counts
from drawlytics.plans.index import draw_index, number_grid, occurrences
from drawlytics.plans.skew import join_hot



def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def demo_freq(spark):
    """Counts 1:10, 2:8, 3:15, 4:5, 5:12."""
    data = [("all", "main", n, c, i) for i, (n, c) in enumerate([(1, 10), (2, 8), (3, 15), (4, 5), (5, 12)])]
    return spark.createDataFrame(data, "series string, pool string, num int, cnt bigint, seen_key bigint")


def by_num(df):
    return {r["num"]: r["weight"] for r in df.collect()}


def test_rank_weights(demo_freq):
    got = by_num(weights.inverse_fib_weights(demo_freq))
    want = {1: 0.154440, 2: 0.231660, 3: 0.057915, 4: 0.463320, 5: 0.092664}
    assert got == pytest.approx(want, abs=1e-6)
    assert sum(got.values()) == pytest.approx(1)


def test_blend_and_adaptive(spark, demo_freq):
    rel = demo_freq.withColumn("weight", F.col("cnt") / 50)
    blend = weights.weighted_blend(rel, weights.inverse_fib_weights(demo_freq))
    assert by_num(blend) == pytest.approx(
        {1: 0.186332, 2: 0.181498, 3: 0.227375, 4: 0.208996, 5: 0.195799}, abs=1e-6
    )
    ratios = spark.createDataFrame(
        [("all", "main", n, r) for n, r in [(1, 1.2), (2, 0.8), (3, 1.6), (4, 0.4), (5, 1.2)]],
        "series string, pool string, num int, ratio double",
    )
    assert by_num(weights.adaptive_weights(demo_freq, ratios)) == pytest.approx(
        {1: 0.217555, 2: 0.155665, 3: 0.291583, 4: 0.119331, 5: 0.215866}, abs=1e-6
    )


def test_blend_with_one_empty_side(demo_freq):
    a = weights.inverse_fib_weights(demo_freq)
    assert by_num(weights.weighted_blend(a, a.where("false"))) == by_num(a)


def test_odds(spark):
    games = spark.createDataFrame(
        [("g", 49, 5, 10, 2.2)], "game_id string, main_max int, main_pick int, chance_max int, ticket_price double"
    )
    total = odds.game_summary(games).first()
    assert total["tickets"] == 19068840
    assert total["p_any_prize"] == pytest.approx(0.1670774415224)
    assert odds.match_odds(games).agg(F.sum("p")).first()[0] == pytest.approx(1)
    ev = odds.expected_value(games).first()
    assert (ev["gross"], ev["net"], ev["rtp"]) == pytest.approx((0.8673470751236, -1.3326529248764, 0.3942486705107))
    jackpot = odds.breakeven_jackpot(games).first()["jackpot"]
    assert jackpot == pytest.approx(27412145.4, abs=1)
    richer = spark.createDataFrame(
        [("g", r[0], jackpot * 1.01 if r[0] == "5 + Chance" else r[4]) for r in odds.RANKS],
        "game_id string, label string, prize double",
    )
    assert odds.expected_value(games, richer).first()["net"] > 0


def test_null_moments():
    mean, var = evaluate.null_moments()
    assert mean == pytest.approx(25 / 49)
    assert var == pytest.approx(0.4199639039)


WALK = {
    "hot": (296, 0.5371621622, 0.6259669570, 0.0844594595, 0.1418918919, 0.715696, 0.474179),
    "cold": (296, 0.5135135135, 0.6481942216, 0.0844594595, 0.1452702703, 0.087860, 0.929988),
    "fibonacci": (296, 0.4560810811, 0.6034619167, 0.0844594595, 0.1317567568, -1.436884, 0.150751),
    "recency": (296, 0.5304054054, 0.6370651760, 0.1182432432, 0.1858108108, 0.536315, 0.591741),
}


@pytest.mark.parametrize("block", [64, 2048])
def test_walk_forward_goldens(idx, block):
    got = evaluate.walk_forward_summary(evaluate.walk_forward(idx, list(WALK), block=block))
    cols = ("n", "mean", "std", "chance_rate", "prize_rate", "z", "p")
    found = {r["strategy"]: tuple(r[c] for c in cols) for r in got.collect()}
    for name, want in WALK.items():
        assert found[name] == pytest.approx(want, abs=1e-6), name


def test_random_strategy_and_null_are_near_chance(idx):
    mean = evaluate.walk_forward(idx, "random").agg(F.avg("matches")).first()[0]
    assert abs(mean - 25 / 49) < 0.12
    null = evaluate.monte_carlo_null(idx, runs=100).first()
    assert null["n_runs"] == 100 and null["p05"] < 25 / 49 < null["p95"]
    assert abs(null["mc_mean"] - 25 / 49) < 0.02


def test_picks_do_not_see_the_future(spark, idx):
    names = ["hot", "recency", "cold", "fibonacci"]
    whole = evaluate.picks(idx, names, 100)
    cut = evaluate.picks(idx.where("draw_idx <= 300"), names, 100)
    changed = evaluate.picks(
        idx.withColumn("n1", F.when(F.col("draw_idx") == 300, F.col("n1") % 49 + 1).otherwise(F.col("n1"))), names, 100
    )
    cols = ("strategy", "draw_idx", "nums", "chance")
    want = rows(whole.where("draw_idx <= 300"), *cols)
    assert rows(cut, *cols) == want
    assert rows(changed.where("draw_idx <= 300"), *cols) == want


@pytest.mark.parametrize("make", [
    lambda i, b: gaps.gap_history(i, block=b),
    lambda i, b: prefix_counts(i, block=b),
    lambda i, b: features.number_features(i, block=b),
    lambda i, b: features.training_features(i, block=b),
    lambda i, b: features.lag_features(i, block=b),
    lambda i, b: evaluate.backtest_scores(i, step=3, block=b),
])
def test_blocks_do_not_change_results(series_idx, make):
    """Small blocks are crossed many times, one block never."""
    few, many = make(series_idx, 1 << 20), make(series_idx, 16)
    as_text = [F.to_json(F.struct(*sorted(few.columns))).alias("row")]
    a = sorted(r[0] for r in few.select(*as_text).collect())
    b = sorted(r[0] for r in many.select(*as_text).collect())
    if a != b:  # sums may differ in the last digit
        import json

        for x, y in zip(a, b):
            assert _close(json.loads(x), json.loads(y))
    assert len(a) == len(b)


def _close(x, y):
    if isinstance(x, dict):
        return all(_close(x[c], y[c]) for c in x)
    if isinstance(x, list):
        return len(x) == len(y) and all(_close(a, b) for a, b in zip(x, y))
    return x == pytest.approx(y, abs=1e-9) if isinstance(x, float) else x == y


def test_prefix_ends_at_frequency(series_idx):
    last = prefix_counts(series_idx)
    total = last.groupBy("series").agg(F.max_by("main_cnt", "draw_idx").alias("c"))
    drawn = series_idx.groupBy("series").agg(F.max_by(F.array("n1", "n2", "n3", "n4", "n5"), "draw_idx").alias("n"))
    counts = {(r["series"], r["num"]): r["cnt"] for r in freq.number_freq_filled(series_idx).where("pool = 'main'").collect()}
    for r in total.join(drawn, "series").collect():
        for num in range(1, 50):
            assert r["c"][num - 1] + (num in r["n"]) == counts[(r["series"], num)]


@pytest.mark.parametrize("parts", [1, 37])
def test_index_does_not_depend_on_partitions(series_idx, parts):
    shuffled = draw_index(series_idx.drop("draw_idx").repartition(parts, "chance"))
    assert rows(shuffled, "series", "draw_id", "draw_idx") == rows(series_idx, "series", "draw_id", "draw_idx")


def test_index_of_one_huge_series(spark):
    """One series spread over many range partitions stays dense and ordered."""
    base = spark.range(20000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'small' ELSE 'huge' END AS series", "id * 7919 % 20011 AS draw_id",
        "DATE'2020-01-01' AS draw_date",
    )
    got = draw_index(base)
    bad = got.selectExpr(
        "draw_idx", "row_number() OVER (PARTITION BY series ORDER BY draw_date, draw_id) - 1 AS want"
    ).where("draw_idx <> want")
    assert got.count() == 20000 and bad.count() == 0


def test_sampling_does_not_depend_on_partitions(spark, idx):
    fr = freq.number_freq(occurrences(idx))
    sc = scores.score_a(number_grid(idx), scores.freq_prediction(fr), gaps.gap_score_current(idx), fr)
    cols = ("combo_id", "nums", "chance", "cnt")
    first = rows(combos.monte_carlo_combos(sc, 9000), *cols)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows(combos.monte_carlo_combos(sc, 9000), *cols) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert all(len(set(r[1])) == 5 and all(1 <= n <= 49 for n in r[1]) for r in first)


def test_weighted_sampling_follows_the_weights(spark):
    """A number with a third of the weight is drawn first about a third of the time."""
    game = Game(main_max=6, main_pick=1, chance_max=3)
    w = [3, 2, 1, 1, 1, 1]
    data = [("all", "main", i + 1, float(x)) for i, x in enumerate(w)] + [("all", "chance", i, 1.0) for i in (1, 2, 3)]
    sc = spark.createDataFrame(data, "series string, pool string, num int, score double")
    got = {r["nums"][0]: r["cnt"] for r in combos.monte_carlo_combos(sc, 90000, top=6, game=game).collect()}
    assert sum(got.values()) == 90000
    for i, x in enumerate(w):
        assert abs(got[i + 1] / 90000 - x / 9) < 0.01


def test_tracking_equals_brute_force(spark, idx):
    played = idx.where("draw_idx < 40").selectExpr("series", "draw_idx AS combo_id", "array(n1,n2,n3,n4,n5) AS nums", "chance")
    drawn = [set(r[:5]) | {("c", r[5])} for r in idx.select("n1", "n2", "n3", "n4", "n5", "chance").collect()]
    want = {}
    for c in played.collect():
        mine = set(c["nums"]) | {("c", c["chance"])}
        for d in drawn:
            both = mine & d
            hit = any(isinstance(x, tuple) for x in both)
            key = (c["combo_id"], len(both) - hit, hit)
            want[key] = want.get(key, 0) + 1
    ranked = {}
    names = {(r[2], r[3]): r[1] for r in odds.RANKS}
    for (cid, m, h), n in want.items():
        key = (cid, names.get((m, int(h))) or "")
        ranked[key] = ranked.get(key, 0) + n
    got = {(r["combo_id"], r["rank"] or ""): r["cnt"] for r in evaluate.track_performance(played, idx).collect()}
    assert got == ranked


def test_large_game_tracking_uses_text_keys(spark):
    game = Game(main_max=90, main_pick=3, chance_max=2)
    draws = spark.createDataFrame(
        [("a", 0, 80, 5, 90, 1), ("a", 1, 80, 5, 7, 2)], "series string, draw_idx bigint, n1 int, n2 int, n3 int, chance int"
    )
    played = spark.createDataFrame([("a", 1, [5, 80, 90], 1)], "series string, combo_id int, nums array<int>, chance int")
    got = evaluate.track_performance(played, draws, game=game).collect()
    assert {(r["rank"], r["cnt"]) for r in got} == {("3+1", 1), ("2", 1)}
    assert got[0]["avg_matches"] == pytest.approx(2.5)


def test_hot_key_join(spark):
    left = spark.range(1000).selectExpr("CASE WHEN id < 600 THEN 0 ELSE id END AS k", "id AS v")
    right = spark.range(1000).selectExpr("id AS k", "id * 10 AS w")
    got = join_hot(left, right, ["k"], part_rows=100)
    assert rows(got, "k", "v", "w") == rows(left.join(right, "k"), "k", "v", "w")


def test_relative_frequencies_sum_to_one(series_idx):
    got = freq.number_freq(occurrences(series_idx)).groupBy("series", "pool").agg(F.sum("rel").alias("s"))
    assert all(r["s"] == pytest.approx(1) for r in got.collect())


def test_scaled_weights_stay_in_range(series_idx):
    for df in (cycles.adaptive_cycle_weights(series_idx), cycles.lunar_weights(series_idx)):
        lo, hi = df.agg(F.min("weight"), F.max("weight")).first()
        assert (lo, hi) == (0, 1)


def test_moon(spark):
    days = ["2023-01-01", "2023-01-03", "2023-01-06", "2023-01-08", "2023-01-10", "2023-01-13", "2023-01-15"]
    df = spark.createDataFrame([(d,) for d in days], "d string").withColumn("p", moon_phase(F.col("d").cast("date")))
    got = df.withColumn("n", moon_phase_name("p")).orderBy("d").collect()
    assert [r["p"] for r in got] == pytest.approx(
        [0.321029, 0.388757, 0.490349, 0.558077, 0.625804, 0.727396, 0.795124], abs=1e-6
    )
    assert [r["n"] for r in got] == [
        "Gibbeuse croissante", "Gibbeuse croissante", "Pleine lune", "Gibbeuse décroissante",
        "Gibbeuse décroissante", "Dernier quartier", "Dernier croissant",
    ]


@pytest.mark.parametrize("text, want", [
    ("04/02/2015", "2015-02-04"), ("2015-02-04", "2015-02-04"), ("4 février 2015", "2015-02-04"),
    ("4 fevrier 2015", "2015-02-04"), ("Mercredi 4 Août 2021", "2021-08-04"), ("31-12-2019", "2019-12-31"),
    ("12/31/2019", "2019-12-31"), ("31/02/2015", None), ("demain", None), ("4 brumaire 2015", None),
])
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse_draw_date("t")).first()[0]
    assert got == (dt.date.fromisoformat(want) if want else None)


def test_runs_and_sums(spark):
    draws = spark.createDataFrame(
        [("a", 0, 10, 3, 4, 5, 30, 1), ("a", 1, 1, 9, 2, 20, 21, 1), ("a", 2, 1, 2, 40, 42, 44, 1)],
        "series string, draw_idx bigint, n1 int, n2 int, n3 int, n4 int, n5 int, chance int",
    )
    assert rows(patterns.run_length_dist(draws), "run_len", "cnt") == [(2, 2), (3, 1)]
    assert rows(patterns.top_runs(draws), "rnk", "run", "cnt") == [(1, "1-2", 2), (2, "3-4-5", 1), (3, "20-21", 1)]
    same = draws.limit(1)
    assert rows(patterns.sum_ranges(same), "bucket", "label", "cnt") == [(4, "52-52", 1)]


def test_gaps_of_a_small_history(spark):
    draws = spark.createDataFrame(
        [("a", i, n, 40, 41, 42, 43, 1) for i, n in enumerate([1, 2, 1, 1, 3])],
        "series string, draw_idx bigint, n1 int, n2 int, n3 int, n4 int, n5 int, chance int",
    )
    one = gaps.gap_history(draws, block=2).where("pool = 'main' AND num = 1")
    assert rows(one, "draw_idx", "gap") == [(2, 1), (3, 0)]
    current = {r["num"]: r["gap"] for r in gaps.current_gap(draws).where("pool = 'main'").collect()}
    assert (current[1], current[2], current[3], current[7]) == (1, 3, 0, 5)
    stats = gaps.gap_stats(gaps.gap_history(draws), number_grid(draws)).where("pool = 'main' AND num = 1").first()
    assert (stats["mean"], stats["median"], stats["std"], stats["cnt"]) == (0.5, 0.5, 0.5, 2)


def test_ranks(spark):
    df = spark.range(6).selectExpr("CAST(id AS INT) AS m").select("m", prize_rank("m", F.lit(0)).alias("r"))
    assert [r["r"] for r in df.orderBy("m").collect()] == [None, None, "2", "3", "4", "5"]


def test_cover_prefers_new_numbers(spark):
    pool = spark.createDataFrame(
        [("a", 1, [1, 2, 3, 4, 5]), ("a", 2, [1, 2, 3, 4, 6]), ("a", 3, [7, 8, 9, 10, 11]), ("b", 1, [1, 2, 3, 4, 5])],
        "series string, combo_id int, nums array<int>",
    )
    got = combos.cover_grid(pool, 3)
    assert rows(got, "series", "ord", "combo_id") == [("a", 1, 1), ("a", 2, 3), ("a", 3, 2), ("b", 1, 1)]


def test_erfc_p_value(idx):
    r = evaluate.walk_forward_summary(evaluate.walk_forward(idx, "hot")).first()
    assert r["p"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)))


def greedy(pool, n):
    """The cover of one list of (id, mask), one pick after the other over all candidates."""
    first = min(pool)
    chosen, covered = [first[0]], first[1]
    for _ in range(n - 1):
        left = [(-(m & ~covered).bit_count(), i, m) for i, m in pool if i not in chosen]
        if left:
            gain, i, m = min(left)
            chosen.append(i)
            covered |= m if gain else 0
    return chosen


@pytest.mark.parametrize("block_rows", [10**6, 60])
def test_cover_in_blocks_equals_a_scan(spark, monkeypatch, block_rows):
    """Copies, a hot series, series with few candidates and more picks than numbers to cover; later rounds read few blocks."""
    import random

    rng = random.Random(8)
    data = [(s, i, sorted(rng.sample(range(1, top + 1), 5))) for s, n, top in (("hot", 900, 49), ("small", 40, 12), ("tiny", 3, 49)) for i in range(n)]
    data += [("hot", 900 + i, data[i][2]) for i in range(300)]
    pool = spark.createDataFrame(data, "series string, combo_id int, nums array<int>").repartition(5)
    asked, plain = [], combos._block_best
    monkeypatch.setattr(combos, "_block_best", lambda b, w, k: asked.append(w.count()) or plain(b, w, k))
    got = {}
    for r in combos.cover_grid(pool, 14, block_rows=block_rows).orderBy("ord").collect():
        got.setdefault(r["series"], []).append(r["combo_id"])
    want = {s: greedy([(i, sum(1 << (x - 1) for x in nums)) for t, i, nums in data if t == s], 14) for s in ("hot", "small", "tiny")}
    assert got == want
    if block_rows == 60:
        assert asked[0] > 30 and sum(asked[1:]) < 13 * asked[0] / 2


def test_short_series_fall_back(spark):
    """Enough samples, too few positive scores for a sample, and too few numbers for anything but slices."""
    rows = [("full", n, 1.0 + n % 7) for n in range(1, 50)] + [("few", n, 1.0 if n <= 4 else 0.0) for n in range(1, 50)] + [("short", n, 0.0) for n in range(1, 7)]
    data = [(s, "main", n, x) for s, n, x in rows] + [(s, "chance", n, float(n)) for s in ("full", "few", "short") for n in range(1, 11)]
    scored = spark.createDataFrame(data, "series string, pool string, num int, score double")
    got = {}
    for r in combos.generate_combos(scored, sims=400).collect():
        got.setdefault(r["series"], []).append(r)
    methods = {s: {r["method"] for r in rows} for s, rows in got.items()}
    assert methods == {"full": {"monte carlo"}, "few": {"wheeling"}, "short": methods["short"]}
    assert len(got["full"]) == len(got["few"]) == 5
    only = combos.generate_combos(scored.where("series = 'full'"), sims=400)
    assert sorted(map(str, only.collect())) == sorted(map(str, got["full"]))


def test_samples_follow_the_scores(spark):
    """The first pick of a sample is a number with probability of its share."""
    data = [("s", "main", n, float(n)) for n in range(1, 11)] + [("s", "chance", n, float(n)) for n in range(1, 5)]
    scored = spark.createDataFrame(data, "series string, pool string, num int, score double")
    game = Game(main_max=10, main_pick=1, chance_max=4)
    rows = combos.monte_carlo_combos(scored, 40_000, 10, game=game).collect()
    for r in rows:
        assert r["cnt"] / 40_000 == pytest.approx(r["nums"][0] / 55, abs=0.008)
