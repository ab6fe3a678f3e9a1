"""Headline timings at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one JSON line.

The draws are derived from the tables once and written; every operator then
starts from those written draws and is run to completion, its result discarded.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from drawlytics.operators import combos, cycles, evaluate, features, freq, gaps, patterns, scores
from drawlytics.plans.blocks import prefix_counts
from drawlytics.plans.index import draw_index, number_grid, occurrences
from drawlytics.plans.store import materialize
from drawlytics.session import local_session
from drawlytics.sources.fixture import draws_from_orders

LEARNED = ("hot", "cold", "recency", "fibonacci")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus, max(cpus, 8))
    draws = materialize(draws_from_orders(spark, sf_dir, series=False), "bench-draws")
    idx = materialize(draw_index(draws), "bench-idx")
    fr = freq.number_freq(occurrences(idx))
    scored = materialize(
        scores.score_a(number_grid(idx), scores.freq_prediction(fr), gaps.gap_score_current(idx), fr), "bench-scores"
    )
    played = idx.where(F.col("draw_idx") < 1000).selectExpr(
        "series", "draw_id AS combo_id", "array(n1, n2, n3, n4, n5) AS nums", "chance"
    )
    work = {
        "draw_index": lambda: draw_index(draws),
        "number_freq": lambda: freq.number_freq(occurrences(idx)),
        "cycle_weights": lambda: cycles.adaptive_cycle_weights(idx),
        "top_runs": lambda: patterns.top_runs(idx),
        "gap_stats": lambda: gaps.gap_stats(gaps.gap_history(idx), number_grid(idx)),
        "prefix_counts": lambda: prefix_counts(idx),
        "training_features": lambda: features.training_features(idx),
        "walk_forward": lambda: evaluate.walk_forward_summary(evaluate.walk_forward(idx, LEARNED)),
        "backtest_scores": lambda: evaluate.backtest_scores(idx),
        "monte_carlo_null": lambda: evaluate.monte_carlo_null(idx),
        "track_performance_1000": lambda: evaluate.track_performance(played, idx),
        "monte_carlo_combos_1m": lambda: combos.monte_carlo_combos(scored, 1_000_000),
    }
    # One untimed operator starts the Python workers and warms the JVM.
    evaluate.walk_forward(idx, "hot").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, make in work.items():
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "draws": idx.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
