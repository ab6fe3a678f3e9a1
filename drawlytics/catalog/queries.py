"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from drawlytics.catalog import inputs as src
from drawlytics.functions import columns as fc
from drawlytics.operators import (
    combos,
    cycles,
    evaluate,
    features,
    freq,
    gaps,
    ingest,
    models,
    odds,
    patterns,
    scores,
    weights,
)
from drawlytics.params import ANALYSIS_WINDOW, CYCLE_WINDOWS
from drawlytics.plans.blocks import prefix_counts
from drawlytics.plans.index import number_grid, number_table, occurrences
from drawlytics.sources import history, text
from drawlytics.streaming import ingest as sin
from drawlytics.streaming import state as sst

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

BALLS = ["n1", "n2", "n3", "n4", "n5"]
DAY = "CAST(draw_date AS STRING) AS draw_date"
MICRO = "array_join(transform(features, x -> CAST(round(x * 1e6D) AS BIGINT)), ',') AS features"


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def r(col: str, digits: int = 9) -> str:
    return f"round({col}, {digits}) AS {col}"


def nums(col: str = "nums") -> str:
    return f"array_join({col}, '-') AS {col}"


def combo_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.selectExpr("series", "combo_id", nums(), "coalesce(chance, 0) AS chance", "method", *extra)


# ------------------------------------------------------------------ ingest
@query
def read_draws_csv(spark, d):
    out = text.read_draws_csv(spark, src.csv_history(spark, d), series_col="Historique")
    return out.selectExpr("series", DAY, *BALLS, "coalesce(chance, 0) AS chance")


@query
def discover_ball_cols(spark, d):
    raw = spark.read.options(header=True, sep=";").csv(src.csv_history(spark, d))
    balls = ingest.discover_ball_cols(raw.columns)
    return raw.agg(*[F.count(F.col(f"`{b}`").try_cast("double")).alias(f"n_{i}") for i, b in enumerate(balls, 1)])


@query
def parse_draw_date(spark, d):
    rows = src.date_text(src.draws(spark, d))
    return rows.select("draw_id", F.coalesce(fc.parse_draw_date("date_text").cast("string"), F.lit("")).alias("parsed"))


@query
def valid_draws(spark, d):
    return ingest.valid_draws(src.dirty(src.draws(spark, d))).selectExpr("draw_id", "copy", *BALLS, "chance")


@query
def validate_draws(spark, d):
    return ingest.validate_draws(src.dirty(src.draws(spark, d))).selectExpr(
        "draw_id", "copy", "CAST(is_valid AS INT) AS is_valid", "coalesce(reason, '') AS reason"
    )


@query
def dedupe_draws(spark, d):
    return ingest.dedupe_draws(src.draws(spark, d)).selectExpr("series", "draw_id", DAY, *BALLS, "chance")


@query
def draw_index(spark, d):
    return src.idx(spark, d).selectExpr("series", "draw_id", "draw_idx")


@query
def merge_new_draws(spark, d):
    old, new = src.split_history(src.stored(ingest.dedupe_draws(src.draws(spark, d)), "one-per-date"))
    return ingest.merge_new_draws(old, new).selectExpr("series", "draw_id", DAY, *BALLS, "chance")


@query
def missing_draws(spark, d):
    old, new = src.split_history(src.stored(ingest.dedupe_draws(src.draws(spark, d)), "one-per-date"))
    return ingest.missing_draws(new, old).selectExpr("series", "draw_id", DAY)


@query
def extract_draw_rows(spark, d):
    return text.extract_draw_rows(src.html_pages(spark, d)).selectExpr(
        "page_id", "row_no", "weekday_label", "coalesce(CAST(draw_date AS STRING), '') AS draw_date",
        *BALLS, "coalesce(chance, 0) AS chance",
    )


@query
def next_draw_date(spark, d):
    return ingest.next_draw_date(src.draws(spark, d)).selectExpr("series", "CAST(next_date AS STRING) AS next_date")


@query
def is_draw_day(spark, d):
    return src.draws(spark, d).select("draw_id", fc.is_draw_day("draw_date").cast("int").alias("draw_day"))


@query
def write_history(spark, d):
    base = src.scratch(spark, "history")
    rows = src.stored(src.draws(spark, d), "draws")
    history.write_history(ingest.dedupe_draws(rows), base)
    history.write_history(rows, base)
    return history.read_history(spark, base).selectExpr("series", "draw_id", DAY, *BALLS, "chance")


@query
def append_submitted_draws(spark, d):
    one = src.stored(ingest.dedupe_draws(src.draws(spark, d)), "one-per-date")
    old, new = src.split_history(one)
    entries = src.date_text(src.dirty(new)).select(
        "series", F.array(*BALLS).alias("nums"), "chance", "date_text", F.lit("").alias("weekday_label")
    )
    out = ingest.append_submitted_draws(entries, old)
    return out.selectExpr("series", DAY, "CAST(submitted_at IS NOT NULL AS INT) AS submitted")


# ------------------------------------------------------------------ frequencies
@query
def number_freq(spark, d):
    return src.freq(spark, d).selectExpr("series", "pool", "num", "cnt", r("rel"))


@query
def number_freq_filled(spark, d):
    return freq.number_freq_filled(src.idx(spark, d)).selectExpr("series", "n_draws", "pool", "num", "cnt")


@query
def window_freq(spark, d):
    return freq.window_freq(src.idx(spark, d), 300).selectExpr("series", "pool", "num", "cnt", r("rel"))


@query
def hot_cold(spark, d):
    return freq.hot_cold(freq.window_freq(src.idx(spark, d)))


@query
def top_freq(spark, d):
    return freq.top_freq(src.freq(spark, d), 10)


@query
def number_report(spark, d):
    _, t = _numbers(spark, d)
    fr, sc = _report_parts(t)
    out = freq.number_report(t, fr, sc, gaps.current_gap_of(t), freq.hot_cold(freq.freq_of(t, ANALYSIS_WINDOW)))
    return out.selectExpr("series", "num", "cnt", r("score"), "gap", "status")


# ------------------------------------------------------------------ patterns
@query
def parity_dist(spark, d):
    return patterns.parity_dist(src.draws(spark, d)).selectExpr("series", "pattern", "cnt", r("pct"))


@query
def sum_stats(spark, d):
    return patterns.sum_stats(src.idx(spark, d)).selectExpr("series", r("mean"), r("median"), "min", "max", r("std"))


@query
def sum_ranges(spark, d):
    return patterns.sum_ranges(src.idx(spark, d)).selectExpr("series", "bucket", "label", "cnt", r("pct"))


@query
def top_sums(spark, d):
    return patterns.top_sums(src.idx(spark, d))


@query
def run_length_dist(spark, d):
    return patterns.run_length_dist(src.draws(spark, d)).selectExpr("series", "run_len", "cnt", r("pct"))


@query
def top_runs(spark, d):
    return patterns.top_runs(src.idx(spark, d))


# ------------------------------------------------------------------ gaps
@query
def gap_history(spark, d):
    return gaps.gap_history(src.idx(spark, d))


@query
def gap_stats(spark, d):
    i = src.idx(spark, d)
    return gaps.gap_stats(gaps.gap_history(i), number_grid(i)).selectExpr(
        "series", "pool", "num", r("mean"), r("median"), "max", "min", r("std"), "cnt"
    )


@query
def returns_stats(spark, d):
    i = src.idx(spark, d, False)
    return gaps.returns_stats(gaps.gap_history(i), number_grid(i)).selectExpr(
        "series", "pool", "num", r("mean"), r("median"), "max", "min", r("std"), "cnt"
    )


@query
def current_gap(spark, d):
    return gaps.current_gap(src.idx(spark, d))


@query
def gap_score_current(spark, d):
    return gaps.gap_score_current(src.idx(spark, d))


@query
def gap_score_mean(spark, d):
    return gaps.gap_score_mean(src.idx(spark, d)).selectExpr("series", "pool", "num", r("score"))


@query
def gaps_at_draw(spark, d):
    return gaps.gaps_at_draw(src.idx(spark, d), 80)


# ------------------------------------------------------------------ cycles
@query
def cycle_ratio(spark, d):
    return cycles.cycle_ratio(src.idx(spark, d), 100)


@query
def cycle_ratio_multi(spark, d):
    return cycles.cycle_ratio_multi(src.idx(spark, d), [10, 20, 50, 2000])


@query
def adaptive_cycle_weights(spark, d):
    return cycles.adaptive_cycle_weights(src.idx(spark, d)).selectExpr("series", "pool", "num", r("weight"))


@query
def moon_phase(spark, d):
    return src.draws(spark, d).select("draw_id", F.round(fc.moon_phase("draw_date"), 9).alias("phase"))


@query
def moon_phase_name(spark, d):
    return src.draws(spark, d).select("draw_id", fc.moon_phase_name(fc.moon_phase("draw_date")).alias("name"))


@query
def phase_distribution(spark, d):
    return cycles.phase_distribution(src.idx(spark, d))


@query
def lunar_weights(spark, d):
    return cycles.lunar_weights(src.idx(spark, d)).selectExpr("series", "pool", "num", r("weight"))


@query
def combine_lunar(spark, d):
    i = src.idx(spark, d)
    out = cycles.combine_lunar(cycles.adaptive_cycle_weights(i), cycles.lunar_weights(i))
    return out.selectExpr("series", "pool", "num", r("weight"))


@query
def next_phases(spark, d):
    return cycles.next_phases(src.draws(spark, d), "draw_date").selectExpr(
        "CAST(date AS STRING) AS date", "phase", "CAST(next_date AS STRING) AS next_date"
    )


@query
def current_phase(spark, d):
    return cycles.current_phase(src.draws(spark, d), "draw_date").selectExpr(
        "CAST(date AS STRING) AS date", r("phase"), "phase_name"
    )


# ------------------------------------------------------------------ weights
@query
def inverse_fib_weights(spark, d):
    return weights.inverse_fib_weights(src.freq(spark, d)).selectExpr("series", "pool", "num", r("weight", 12))


@query
def inverse_fib_weights_descending(spark, d):
    return weights.inverse_fib_weights(src.freq(spark, d), reverse=False).selectExpr(
        "series", "pool", "num", r("weight", 12)
    )


@query
def weighted_blend(spark, d):
    fr = src.freq(spark, d)
    out = weights.weighted_blend(fr.withColumnRenamed("rel", "weight"), weights.inverse_fib_weights(fr))
    return out.selectExpr("series", "pool", "num", r("weight"))


@query
def adaptive_weights(spark, d):
    i = src.idx(spark, d)
    out = weights.adaptive_weights(freq.number_freq(occurrences(i)), cycles.cycle_ratio(i, 50))
    return out.selectExpr("series", "pool", "num", r("weight"))


@query
def fib_sequence_weights(spark, d):
    return weights.fib_sequence_weights(src.freq(spark, d)).selectExpr("series", "pool", "num", r("weight"))


# ------------------------------------------------------------------ scores
def _numbers(spark, d, series=True):
    """(index, number table): one pass over the draws gives all that is defined per number."""
    i = src.idx(spark, d, series)
    return i, number_table(i, [*CYCLE_WINDOWS, ANALYSIS_WINDOW])


def _report_parts(t):
    """(frequencies, score A) of a number table."""
    fr = freq.freq_of(t)
    return fr, scores.score_a(t, scores.freq_prediction(fr), gaps.gap_score_current_of(t), fr)


def _score_a(spark, d, series=True):
    return _report_parts(_numbers(spark, d, series)[1])[1]


@query
def freq_prediction(spark, d):
    return scores.freq_prediction(src.freq(spark, d)).selectExpr("series", "pool", "num", r("score"))


@query
def score_a(spark, d):
    return _score_a(spark, d).selectExpr("series", "pool", "num", r("score"))


@query
def score_b(spark, d):
    _, t = _numbers(spark, d)
    fr = freq.freq_of(t)
    out = scores.score_b(
        t, fr, gaps.gap_score_mean_of(t), src.ml_scores(t), cycles.adaptive_cycle_weights_of(t),
        fib=weights.inverse_fib_weights(fr),
    )
    return out.selectExpr("series", "pool", "num", r("score"))


@query
def score_b_lunar(spark, d):
    i, t = _numbers(spark, d)
    cycle = cycles.combine_lunar(cycles.adaptive_cycle_weights_of(t), cycles.lunar_weights(i))
    out = scores.score_b(t, freq.freq_of(t), gaps.gap_score_mean_of(t), src.ml_scores(t), cycle, lunar=True)
    return out.selectExpr("series", "pool", "num", r("score"))


def _blend(kind, t, ml):
    """One of the three blends on a number table and model probabilities."""
    fr = freq.freq_of(t)
    fib = weights.inverse_fib_weights(fr)
    if kind == "fibonacci":
        return scores.blend_fibonacci(t, ml, fib)
    cycle = cycles.adaptive_cycle_weights_of(t)
    return scores.blend_cycle(t, ml, cycle) if kind == "cycle" else scores.blend_optimized(t, ml, fib, cycle, fr)


@query
def blend_fibonacci(spark, d):
    _, t = _numbers(spark, d)
    return _blend("fibonacci", t, src.ml_scores(t)).selectExpr("series", "pool", "num", r("score"))


@query
def blend_cycle(spark, d):
    _, t = _numbers(spark, d)
    return _blend("cycle", t, src.ml_scores(t)).selectExpr("series", "pool", "num", r("score"))


def _optimized(spark, d):
    _, t = _numbers(spark, d)
    return _blend("optimized", t, src.ml_scores(t))


@query
def blend_optimized(spark, d):
    return _optimized(spark, d).selectExpr("series", "pool", "num", r("score"))


@query
def rank_numbers(spark, d):
    return scores.rank_numbers(_optimized(spark, d), 5).selectExpr("series", "pool", nums())


# ------------------------------------------------------------------ features and models
@query
def prefix_count_arrays(spark, d):
    return prefix_counts(src.idx(spark, d)).selectExpr(
        "series", "draw_idx", "array_join(main_cnt, ',') AS main_cnt", "array_join(chance_cnt, ',') AS chance_cnt"
    )


@query
def number_features(spark, d):
    return features.number_features(src.idx(spark, d)).selectExpr("series", "draw_idx", MICRO)


@query
def training_features(spark, d):
    return features.training_features(src.idx(spark, d)).selectExpr(
        "series", "draw_idx", MICRO, "array_join(y_nums, '') AS y_nums", "array_join(y_chance, '') AS y_chance"
    )


@query
def temporal_features(spark, d):
    return src.draws(spark, d).select(
        "draw_id", F.array_join(features.temporal_features("draw_date").cast("array<int>"), ",").alias("features")
    )


@query
def serving_features(spark, d):
    return features.serving_features(src.idx(spark, d)).selectExpr("series", "draw_idx", MICRO)


@query
def freq_features(spark, d):
    return features.freq_features(src.idx(spark, d)).selectExpr("series", "draw_idx", MICRO)


@query
def lag_features(spark, d):
    return features.lag_features(src.idx(spark, d)).selectExpr(
        "series", "draw_idx", "array_join(CAST(features AS ARRAY<INT>), ',') AS features",
        "array_join(y_nums, '') AS y_nums", "y_chance",
    )


def _training_rows(spark, d):
    return src.stored(features.training_features(src.idx(spark, d)), "train-rows")


@query
def eval_models(spark, d):
    older, newer = models.split_rows(_training_rows(spark, d))
    out = models.eval_models(models.fit_number_models(older), newer)
    return out.select(*[c if c == "n" else F.round(c, 9).alias(c) for c in out.columns])


def _served(spark, d):
    """(number table, probabilities of the next draw) from a stored and loaded forest on all rows."""
    i = src.stored(src.idx(spark, d), "idx")
    t = number_table(i, CYCLE_WINDOWS)
    fitted = models.fit_number_models(src.stored(features.training_features(i), "train-rows"))
    base = src.scratch(spark, "models")
    models.save_models(fitted, base)
    return t, src.stored(models.serve(models.load_models(spark, base), i), "probabilities")


@query
def predict_next(spark, d):
    return _served(spark, d)[1].selectExpr("series", "pool", "num", r("p"))


@query
def blend_fibonacci_model(spark, d):
    return _blend("fibonacci", *_served(spark, d)).selectExpr("series", "pool", "num", r("score"))


@query
def blend_cycle_model(spark, d):
    return _blend("cycle", *_served(spark, d)).selectExpr("series", "pool", "num", r("score"))


@query
def blend_optimized_model(spark, d):
    """The blend on fitted probabilities instead of the stand-in."""
    return _blend("optimized", *_served(spark, d)).selectExpr("series", "pool", "num", r("score"))


@query
def search_params(spark, d):
    best, results = models.search_params(_training_rows(spark, d))
    names = ["pool", *models.SEARCH_GRID, "log_loss", "auc", "best_f1", "best_threshold"]
    rows = [(*[x[c] for c in names], all(x[p] == best[x["pool"]][p] for p in models.SEARCH_GRID)) for x in results]
    schema = "pool string, trees int, max_depth int, min_split int, min_leaf int, log_loss double, auc double, best_f1 double, best_threshold double, chosen boolean"
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ combinations
@query
def freq_slices(spark, d):
    return combo_out(combos.freq_slices(src.freq(spark, d)))


@query
def top_combo(spark, d):
    return combo_out(combos.top_combo(_optimized(spark, d), "optimized"))


@query
def monte_carlo_combos(spark, d):
    scored = src.stored(_score_a(spark, d, False), "scores")
    return combo_out(combos.monte_carlo_combos(scored), "cnt")


@query
def wheeling(spark, d):
    return combo_out(combos.wheeling(_score_a(spark, d)))


@query
def direct_combos(spark, d):
    return combo_out(combos.direct_combos(_score_a(spark, d), 24))


@query
def generate_combos(spark, d):
    scored = src.stored(_score_a(spark, d, False), "scores")
    return combo_out(combos.generate_combos(scored))


@query
def propose_chance(spark, d):
    return combos.propose_chance(_score_a(spark, d), 7)


@query
def mixed_combos(spark, d):
    scored = src.stored(_score_a(spark, d), "scores")
    return combo_out(combos.mixed_combos(scored, 9, mode="md5"))


def _covered(spark, d):
    pool = src.stored(src.idx(spark, d), "idx").selectExpr(
        "series", "draw_idx AS combo_id", "array_sort(array(n1, n2, n3, n4, n5)) AS nums"
    )
    return combos.cover_grid(pool, 10)


@query
def cover_grid(spark, d):
    return _covered(spark, d).selectExpr("series", "ord", "combo_id", nums())


@query
def cover_mixed(spark, d):
    """Ten of twenty mixed combinations that cover the most numbers."""
    made = src.stored(combos.mixed_combos(src.stored(_score_a(spark, d), "scores"), 20, mode="md5"), "mixed")
    return combos.cover_grid(made.select("series", "combo_id", "nums"), 10).selectExpr("series", "ord", "combo_id", nums())


@query
def recurring_numbers(spark, d):
    return combos.recurring_numbers(_covered(spark, d))


# ------------------------------------------------------------------ odds
@query
def match_odds(spark, d):
    return odds.match_odds(src.games(spark, d)).selectExpr("game_id", "k", r("p", 12))


@query
def game_odds(spark, d):
    return odds.game_odds(src.games(spark, d)).selectExpr("game_id", "label", r("p", 12))


@query
def game_summary(spark, d):
    return odds.game_summary(src.games(spark, d)).selectExpr("game_id", "tickets", r("p_any_prize"), r("p_nothing"))


@query
def expected_value(spark, d):
    return odds.expected_value(src.games(spark, d)).selectExpr("game_id", r("gross"), r("net"), r("rtp"))


@query
def breakeven_jackpot(spark, d):
    return odds.breakeven_jackpot(src.games(spark, d)).selectExpr("game_id", r("jackpot", 2))


# ------------------------------------------------------------------ settlement and evaluation
def _settled(spark, d, style="long"):
    i = src.idx(spark, d, False)
    return evaluate.settle_tickets(src.tickets(spark, d, i), i, style=style)


@query
def prize_rank(spark, d):
    both = _settled(spark, d)
    return both.select(
        "ticket_id",
        F.coalesce(fc.prize_rank("matches", "chance_hit"), F.lit("")).alias("long_rank"),
        F.coalesce(fc.prize_rank("matches", "chance_hit", "short"), F.lit("")).alias("short_rank"),
    )


@query
def rank_points(spark, d):
    return _settled(spark, d, "short").select("ticket_id", fc.rank_points("rank").alias("points"))


@query
def settle_tickets(spark, d):
    return _settled(spark, d).selectExpr(
        "ticket_id", "matches", "chance_hit", "coalesce(rank, '') AS rank", "prize"
    )


def _tracked(spark, d, mode):
    i = src.idx(spark, d, False)
    played = src.tickets(spark, d, i).selectExpr("series", "ticket_id AS combo_id", "nums", "chance")
    return evaluate.track_performance(played, i, mode).selectExpr(
        "series", "combo_id", r("avg_matches"), "coalesce(rank, '') AS rank", "cnt"
    )


@query
def track_performance(spark, d):
    return _tracked(spark, d, "played")


@query
def track_performance_actual(spark, d):
    return _tracked(spark, d, "actual")


@query
def picks(spark, d):
    out = evaluate.picks(src.stored(src.idx(spark, d), "idx"), min_history=50, mode="md5")
    return out.selectExpr("series", "strategy", "draw_idx", nums(), "chance")


@query
def walk_forward(spark, d):
    out = evaluate.walk_forward(src.stored(src.idx(spark, d), "idx"), min_history=50, mode="md5")
    return out.selectExpr("series", "strategy", "draw_idx", "matches", "chance_hit", "coalesce(rank, '') AS rank")


@query
def walk_forward_summary(spark, d):
    wf = evaluate.walk_forward(src.stored(src.idx(spark, d, False), "idx"), mode="md5")
    return evaluate.walk_forward_summary(wf).selectExpr(
        "series", "strategy", "n", r("mean"), r("std"), r("chance_rate"), r("prize_rate"), r("z"), r("p", 6)
    )


@query
def walk_forward_ranks(spark, d):
    return evaluate.walk_forward_ranks(evaluate.walk_forward(src.stored(src.idx(spark, d, False), "idx"), mode="md5"))


@query
def monte_carlo_null(spark, d):
    return evaluate.monte_carlo_null(src.stored(src.idx(spark, d, False), "idx"), mode="md5").selectExpr(
        "series", r("mc_mean"), r("mc_std"), r("p05"), r("p95"), "n_runs"
    )


@query
def backtest_scores(spark, d):
    return evaluate.backtest_scores(src.stored(src.idx(spark, d), "idx")).selectExpr(
        "series", "draw_idx", nums(), "chance", "matches", "chance_hit", "coalesce(rank, '') AS rank", "points"
    )


@query
def evaluation_report(spark, d):
    out = evaluate.evaluation_report(src.stored(src.idx(spark, d, False), "idx"), mode="md5")
    path = src.scratch(spark, "report")
    history.write_report_json(out, path)
    return spark.read.schema(out.schema).json(path).selectExpr("series", "section", "item", "metric", r("value", 6))


# ------------------------------------------------------------------ streams
def _file_stream(spark, rows: DataFrame) -> tuple[str, int]:
    """Draws cut into files by date order, so that most batches arrive in order:
    a file per shuffle partition of the session. Then come the draws of a month
    that was held back, and those of another month for the second time. Returns
    the files of a batch too, so that both come in a batch of their own."""
    path = src.scratch(spark, "stream-in")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = src.stored(rows, "stream-rows")
    late = F.date_trunc("month", "draw_date") == F.lit("1995-03-01").cast("timestamp")
    again = F.date_trunc("month", "draw_date") == F.lit("1996-07-01").cast("timestamp")
    rows.where(~late).repartitionByRange(files, "draw_date", "draw_id").write.parquet(path)
    rows.where(late | again).coalesce(1).write.mode("append").parquet(path)
    return path, max(1, files // 2)


def _stream_draws(spark, d):
    return src.draws(spark, d).select("series", "draw_id", "draw_date", *BALLS, "chance")


@query
def stream_ingest(spark, d):
    rows = src.stored(ingest.dedupe_draws(src.draws(spark, d)), "one-per-date")
    shown = src.dirty(rows).select(
        "series",
        "draw_id",
        F.lit("").alias("Jour"),
        F.date_format("draw_date", "dd/MM/yyyy").alias("Date"),
        *[F.col(c).alias(f"Numéro {c[1:]}") for c in BALLS],
        F.col("chance").alias("Chance"),
        "copy",
    )
    # Everything is sent twice, in files that mix all dates.
    in_dir = src.scratch(spark, "stream-in")
    sent = shown.where("copy <> 5").drop("copy")
    sent.unionByName(sent).repartition(6, "draw_id").write.options(header=True).csv(in_dir)
    out = src.scratch(spark, "stream-out")
    sin.start_ingest(spark, in_dir, out, f"{out}/_ck", files_per_batch=2).awaitTermination()
    return sin.read_draws(spark, out).selectExpr("series", "draw_id", DAY, *BALLS, "chance")


@query
def stream_freq(spark, d):
    out = src.scratch(spark, "stream-freq")
    in_dir, half = _file_stream(spark, _stream_draws(spark, d))
    sst.start_freq(spark, in_dir, f"{out}/t", f"{out}/ck", files_per_batch=half).awaitTermination()
    return sst.read_freq(spark, f"{out}/t").select("series", "pool", "num", "cnt")


@query
def stream_gaps(spark, d):
    out = src.scratch(spark, "stream-gaps")
    in_dir, half = _file_stream(spark, _stream_draws(spark, d))
    sst.start_gaps(spark, in_dir, f"{out}/t", f"{out}/ck", files_per_batch=half).awaitTermination()
    return sst.read_gaps(spark, f"{out}/t")


@query
def stream_last_draws(spark, d):
    out = src.scratch(spark, "stream-last")
    in_dir, half = _file_stream(spark, _stream_draws(spark, d))
    sst.start_last_draws(spark, in_dir, f"{out}/t", f"{out}/ck", ANALYSIS_WINDOW, files_per_batch=half).awaitTermination()
    return sst.read_last_freq(spark, f"{out}/t").selectExpr("series", "pool", "num", "cnt", r("rel"))


@query
def stream_refit(spark, d):
    out = src.scratch(spark, "stream-refit")
    in_dir, _ = _file_stream(spark, ingest.dedupe_draws(_stream_draws(spark, d)))
    sst.start_refit(
        spark, in_dir, f"{out}/history", f"{out}/models", f"{out}/metrics", f"{out}/ck"
    ).awaitTermination()
    return spark.read.parquet(f"{out}/metrics").selectExpr(
        "version", "CAST(first_date AS STRING) AS first_date", "CAST(last_date AS STRING) AS last_date", "n_test"
    )
