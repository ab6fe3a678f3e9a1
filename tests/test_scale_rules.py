"""Hot keys, ids, windows and pools that the registered queries do not reach."""

from collections import Counter

from pyspark.sql import functions as F

from drawlytics.catalog import inputs
from drawlytics.operators import evaluate, features, models
from drawlytics.operators.freq import number_freq
from drawlytics.params import Game
from drawlytics.plans.index import draw_index, occurrences
from drawlytics.plans.skew import join_hot
from drawlytics.sources import versioned
from drawlytics.streaming import ingest as sin
from drawlytics.streaming import state as sst


def test_hot_keys_fill_as_many_parts_as_they_have_rows(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = Counter(map(tuple, left.join(right, "k").collect()))
    for part_rows in (1, 100, 10**6):
        got = join_hot(left, right, ["k"], part_rows=part_rows)
        assert Counter(map(tuple, got.select("k", "id", "v").collect())) == want


def test_index_carries_the_length_of_its_series(spark, sf_dir):
    idx = draw_index(inputs.draws(spark, sf_dir))
    wrong = idx.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("n_draws").alias("a"), F.max("n_draws").alias("b"), F.max("draw_idx").alias("m"))
    assert wrong.where("n != a OR n != b OR n != m + 1").isEmpty()


def test_plans_leave_history_rows_where_they_are(spark, series_idx):
    """No shuffle of the history on the series alone: the last draws are a filter."""
    from drawlytics.operators.freq import last_draws

    plan = last_draws(series_idx, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_draws_without_ids_differ_by_their_numbers(spark):
    row = {"series": "s", "draw_id": None, "Jour": "", "Date": "01/02/2020", "Chance": "3"}
    rows = [{**row, **{f"Numéro {i}": str(i + k) for i in range(1, 6)}} for k in range(4)]
    parsed = sin.parse_text(spark.createDataFrame(rows, sin.text_schema()))
    assert parsed.select("draw_id").distinct().count() == 4


def test_last_draws_at_the_default_window(spark, sf_dir, tmp_path):
    draws = inputs.draws(spark, sf_dir, False).select("series", "draw_id", "draw_date", "n1", "n2", "n3", "n4", "n5", "chance")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    draws.repartition(4, "draw_id").write.parquet(src)
    sst.start_last_draws(spark, src, f"{out}/t", f"{out}/ck", 1335, files_per_batch=2).awaitTermination()
    idx = draw_index(draws)
    want = number_freq(occurrences(idx.where("draw_idx >= n_draws - 1335")))
    cols = ["series", "pool", "num", "cnt"]
    assert sorted(map(tuple, sst.read_last_freq(spark, f"{out}/t").select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_gaps_ignore_files_that_are_still_to_come(spark, sf_dir, tmp_path):
    """Late files among many: after each batch the state holds the draws consumed so far, no more."""
    idx = draw_index(inputs.draws(spark, sf_dir, False))
    cols = ["series", "draw_id", "draw_date", "n1", "n2", "n3", "n4", "n5", "chance"]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    # The second file is late; the rest is in order.
    for lo, hi in ((100, 200), (0, 100), (200, 300), (300, 10**9)):
        idx.where((F.col("draw_idx") >= lo) & (F.col("draw_idx") < hi)).select(*cols).coalesce(1).write.mode("append").parquet(src)
    sst.start_gaps(spark, src, f"{out}/t", f"{out}/ck", files_per_batch=1).awaitTermination()
    days = [versioned.read(spark, f"{out}/t", b + 1).where(F.col("pool") == sst.DAY) for b in range(4)]
    assert [d.agg(F.sum("n")).first()[0] for d in days] == [100, 200, 300, idx.count()]



def test_chance_pool_is_not_blended_even_if_it_has_the_same_size(spark):
    """The same chance draws give the same chance picks whatever the size of the main pool."""
    draws = spark.range(150).select(
        F.lit("s").alias("series"), F.col("id").alias("draw_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("draw_date"),
        *[((F.col("id") * 3 + 2 * i) % 10 + 1).cast("int").alias(f"n{i}") for i in range(1, 6)],
        (F.pmod(F.xxhash64("id"), F.lit(10)) + 1).cast("int").alias("chance"),
    )
    idx = draw_index(draws)
    picks = [
        [tuple(r) for r in evaluate.backtest_scores(idx, 20, game=Game(main_max=m, chance_max=10)).select("draw_idx", "chance").orderBy("draw_idx").collect()]
        for m in (10, 11)
    ]
    assert picks[0] == picks[1]


def test_forests_find_a_planted_signal(spark):
    """Four numbers come nine times in ten; the fitted forests must put them first."""
    rows = []
    for i in range(400):
        favoured = [1, 2, 3, 4, 5 + 7 * i % 8] if i % 10 else [3, 5, 7, 9, 11]
        rows.append(("s", i, *favoured, 1 if i % 10 else 2))
    draws = spark.createDataFrame(rows, "series string, draw_id long, n1 int, n2 int, n3 int, n4 int, n5 int, chance int")
    idx = draw_index(draws.withColumn("draw_date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("draw_id").cast("int"))))
    game = Game(main_max=12, chance_max=2)
    train, test = models.split_rows(models.materialize(features.training_features(idx, game=game), "rows"))
    fitted = models.fit_number_models(train, {"trees": 10, "max_depth": 4}, game)
    got = models.eval_models(fitted, test).first()
    assert got["top_hits"] > 3.5 and got["f1_micro"] > 0.7 and got["chance_accuracy"] > 0.8
    assert got["auc"] > 0.6 and got["best_f1"] >= got["f1_micro"] - 0.01
    grid = {"trees": [5, 10], "max_depth": [None, 3], "min_leaf": [1, 4]}
    best, results = models.search_params(train, 8, grid, game, folds=2)
    assert len(results) == 16 and all(r["auc"] > 0.55 for r in results if r["pool"] == "main")
    assert best["main"]["min_leaf"] == 4 and best["main"]["min_split"] == 2
