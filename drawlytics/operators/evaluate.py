"""Settlement of tickets and leak-free evaluation of number strategies."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drawlytics.functions.columns import erfc, nums_array, prize_rank, rank_points, rank_prize
from drawlytics.functions.sampling import quote, uniform_chance_sql, with_floyd_picks
from drawlytics.params import (
    BLOCK,
    DECAY,
    FIB_BLEND,
    GAME,
    MC_RUNS,
    MIN_HISTORY,
    SCORE_A_WEIGHTS,
    Game,
    fib,
)
from drawlytics.plans import kernels as kn
from drawlytics.plans.blocks import apply_blocks, block_carry, decay_carry, sql_fields
from drawlytics.plans.index import ENCOUNTER_STRIDE, SERIES, series_length, with_length
from drawlytics.plans.skew import join_hot
from drawlytics.plans.store import materialize

COUNT_STRATEGIES = ("hot", "cold", "fibonacci")
STRATEGIES = ("random", "hot", "cold", "recency", "fibonacci")
#: Draws whose keys are hashed together, about a batch of Arrow: fewer, longer array steps.
SLICE = 10_000

_PLAYED = "code int, draw_idx bigint, chance int, matches int, chance_hit int"
_PLAYED_NUMS = _PLAYED + ", nums array<int>"


# ------------------------------------------------------------------ settlement
def settle_tickets(
    tickets: DataFrame,
    idx: DataFrame,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
    style: str = "long",
) -> DataFrame:
    """Each ticket against its draw. ``tickets``: ``ticket_id, k, draw_idx,
    nums, chance``. A draw that attracts a large share of all tickets is salted."""
    keys = [*series_cols, "draw_idx"]
    drawn = idx.select(*keys, nums_array(game).alias("actual"), F.col("chance").alias("actual_chance"))
    hit = F.coalesce(F.col("chance") == F.col("actual_chance"), F.lit(False)).cast("int")
    out = join_hot(tickets, drawn, keys).select(
        "ticket_id",
        F.size(F.array_intersect("nums", "actual")).alias("matches"),
        hit.alias("chance_hit"),
    )
    return out.withColumn("rank", prize_rank("matches", "chance_hit", style)).withColumn(
        "prize", rank_prize("rank")
    )


def track_performance(
    combos: DataFrame,
    idx: DataFrame,
    chance_mode: str = "played",
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
    style: str = "short",
) -> DataFrame:
    """Every combination against every draw of its series: ``combo_id,
    avg_matches, rank, cnt`` with one row per rank reached (null = nothing won).

    No combination is ever paired with a draw. A draw and a combination share m
    numbers exactly when they share C(m, j) subsets of size j, so it is enough to
    count, for every subset of numbers, how many draws contain it: different draws
    explode into their 2^5 subsets, are counted map-side, and the combinations look
    up their own subsets by key: one row with the counts by chance number.
    Inclusion-exclusion turns the subset counts into the exact number of draws with
    m matches. Work grows with draws plus combinations, not with their product.

    ``chance_mode='played'`` compares the combination's own chance number;
    ``'actual'`` treats it as always hit.
    """
    k = list(series_cols)
    pick = game.main_pick
    packed = game.main_max <= 62

    def exploded(df: DataFrame, nums: str, keep: list) -> DataFrame:
        """A row per subset: its key ``sub`` (bit mask, or text for large games)
        and its size ``j``. The subset number ``s`` unfolds first and each key is
        put together from it afterwards, which keeps the generated code small."""
        out = df.select(*keep, F.col(nums).alias("ns"), F.explode(F.sequence(F.lit(0), F.lit((1 << pick) - 1))).alias("s"))
        if packed:
            # Repeated numbers count once: the later one makes the key null.
            terms = [
                f"CASE WHEN (s & {1 << i}) = 0 THEN 0L"
                + (f" WHEN ns[{i}] IN ({', '.join(f'ns[{m}]' for m in range(i))}) THEN NULL" if i else "")
                + f" ELSE shiftleft(1L, ns[{i}]) END"
                for i in range(pick)
            ]
            sub = " + ".join(terms)
        else:
            chosen = "filter(array_sort(ns), (x, i) -> (s & shiftleft(1, i)) <> 0)"
            sub = f"CASE WHEN size(array_distinct({chosen})) = bit_count(s) THEN array_join({chosen}, '-') END"
        return (
            out.withColumn("sub", F.expr(sub))
            .where("sub IS NOT NULL")
            .withColumn("j", F.expr("bit_count(s)"))
            .drop("ns", "s")
        )

    combos = materialize(combos.select(*k, "combo_id", "nums", "chance"), "combos")
    wanted = exploded(combos, "nums", [*k, "combo_id", F.col("chance").alias("played")])
    # Equal draws are counted before they unfold: a game has so many different ones.
    different = (
        idx.select(*k, "chance", F.array_sort(F.array(*game.ball_cols)).alias("nums"))
        .groupBy(*k, "chance", "nums")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = exploded(different, "nums", [*k, "chance", "n"]).groupBy(*k, "sub", "chance").agg(F.sum("n").alias("n"))
    entry = F.when(F.col("chance").isNotNull(), F.struct("chance", "n"))
    # Written, so that Catalyst knows how much the subsets take.
    counts = materialize(
        counts.groupBy(*k, "sub").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(entry)).alias("by_chance")),
        "subset-counts",
    )
    hit = F.col("n") if chance_mode == "actual" else F.coalesce(F.try_element_at("by_chance", F.col("played")), F.lit(0))
    found = join_hot(wanted, counts, [*k, "sub"]).select(*k, "combo_id", "j", "n", hit.alias("n_hit"))
    sized = {"hit": F.col("n_hit"), "miss": F.col("n") - F.col("n_hit")}
    # The few sums are wider than a row, so rows meet before they are added.
    per_combo = found.repartition(*k, "combo_id").groupBy(*k, "combo_id").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("j") == j, v)).cast("double"), F.lit(0.0)).alias(f"{c}_{j}")
            for j in range(pick + 1)
            for c, v in sized.items()
        ]
    )

    def exactly(c: str, m: int):
        terms = [
            F.lit(float((-1) ** (j - m) * math.comb(j, m))) * F.col(f"{c}_{j}") for j in range(m, pick + 1)
        ]
        return sum(terms[1:], terms[0])

    cells = F.array(
        *[
            F.struct(F.lit(m).alias("matches"), F.lit(h).alias("chance_hit"), exactly(c, m).cast("bigint").alias("cnt"))
            for m in range(pick + 1)
            for h, c in ((1, "hit"), (0, "miss"))
        ]
    )
    average = (F.col("hit_1") + F.col("miss_1")) / (F.col("hit_0") + F.col("miss_0"))
    return (
        per_combo.select(*k, "combo_id", average.alias("avg_matches"), F.inline(cells))
        .withColumn("rank", prize_rank("matches", "chance_hit", style))
        .groupBy(*k, "combo_id", "avg_matches", "rank")
        .agg(F.sum("cnt").alias("cnt"))
        .where("cnt > 0")
    )


# ------------------------------------------------------------------ strategies
def _played(code: int, at, best, extra, main_hit, chance_hit, with_nums: bool) -> list:
    """Arrow columns of one strategy: what it played and how that turned out."""
    n = len(at)
    matches = (np.take_along_axis(main_hit, best - 1, axis=1) > 0).sum(axis=1)
    hit = chance_hit[np.arange(n), extra - 1] > 0
    out = [
        kn.same(code, n, pa.int32()),
        pa.array(at),
        pa.array(extra.astype(np.int32)),
        pa.array(matches.astype(np.int32)),
        pa.array(hit.astype(np.int32)),
    ]
    return [*out, kn.lists(np.sort(best, axis=1), pa.int32())] if with_nums else out


def _strategy_kernel(strategies: Sequence[str], game: Game, min_history: int, decay: float, with_nums: bool):
    split = game.main_max

    def kernel(rows, entry):
        at = rows.column("draw_idx").to_numpy()
        keep = at >= min_history
        main_hit = kn.hits(kn.balls(rows, game), game.main_max)
        chance_hit = kn.hits(kn.bonus(rows), game.chance_max)
        if "cnt" in entry:
            value = kn.before(main_hit, entry["cnt"][:split])[keep]
            bonus = kn.before(chance_hit, entry["cnt"][split:])[keep]
        parts = []
        for code, strategy in enumerate(strategies):
            if strategy == "recency":
                faded = kn.decayed_before(main_hit, entry["decay"][:split], decay)[keep]
                best = kn.top_numbers(faded, game.main_pick)
                extra = kn.decayed_before(chance_hit, entry["decay"][split:], decay)[keep].argmax(axis=1) + 1
            elif strategy == "cold":
                best, extra = kn.low_numbers(value, game.main_pick), bonus.argmin(axis=1) + 1
            else:
                ranked = kn.fib_rank_weight(value) if strategy == "fibonacci" else value
                best, extra = kn.top_numbers(ranked, game.main_pick), bonus.argmax(axis=1) + 1
            parts.append(_played(code, at[keep], best, extra, main_hit[keep], chance_hit[keep], with_nums))
        return [pa.concat_arrays(column) for column in zip(*parts)]

    return kernel


def _history_picks(idx, strategies, game, min_history, decay, series_cols, block, with_nums) -> DataFrame:
    k = list(series_cols)
    slim = idx.select(*k, "draw_idx", *game.ball_cols, "chance")
    carries = []
    if set(strategies) & set(COUNT_STRATEGIES):
        carries.append(block_carry(slim, ["cnt"], game, k, block))
    if "recency" in strategies:
        carries.append(decay_carry(slim, game, decay, k, block))
    carry = carries[0] if len(carries) == 1 else carries[0].join(carries[1], [*k, "blk"])
    kernel = _strategy_kernel(strategies, game, min_history, decay, with_nums)
    out = apply_blocks(slim, carry, kernel, _PLAYED_NUMS if with_nums else _PLAYED, k, block)
    name = F.get(F.array(*[F.lit(s) for s in strategies]), F.col("code"))
    return out.withColumn("strategy", name).drop("code")


def _random_picks(idx, game, min_history, series_cols, seed, mode, with_nums) -> DataFrame:
    parts = [str(seed), quote("pick"), *series_cols, "draw_idx"]
    rows = idx.where(F.col("draw_idx") >= min_history).withColumnRenamed("chance", "actual")
    rows = with_floyd_picks(rows, parts, game.main_max, game.main_pick, mode)
    rows = rows.withColumn("chance", F.expr(uniform_chance_sql(parts, game, mode)))
    picked = [f"p{i}" for i in range(1, game.main_pick + 1)]
    matched = " + ".join(f"CAST({p} IN ({', '.join(game.ball_cols)}) AS INT)" for p in picked)
    out = rows.select(
        *series_cols,
        "draw_idx",
        "chance",
        F.expr(matched).alias("matches"),
        F.coalesce((F.col("chance") == F.col("actual")), F.lit(False)).cast("int").alias("chance_hit"),
        F.array_sort(F.array(*picked)).alias("nums"),
        F.lit("random").alias("strategy"),
    )
    return out if with_nums else out.drop("nums")


def _plays(
    idx: DataFrame,
    strategies: Sequence[str] | str,
    min_history: int,
    game: Game,
    series_cols: Sequence[str],
    seed: int,
    mode: str,
    decay: float,
    block: int,
    with_nums: bool,
) -> DataFrame:
    strategies = (strategies,) if isinstance(strategies, str) else tuple(strategies)
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")
    learned = [s for s in strategies if s != "random"]
    out = []
    if learned:
        out.append(_history_picks(idx, learned, game, min_history, decay, series_cols, block, with_nums))
    if "random" in strategies:
        out.append(_random_picks(idx, game, min_history, series_cols, seed, mode, with_nums))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def picks(
    idx: DataFrame,
    strategies: Sequence[str] | str = STRATEGIES,
    min_history: int = 0,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
    seed: int = 12345,
    mode: str = "xxhash",
    decay: float = DECAY,
    block: int = BLOCK,
) -> DataFrame:
    """``k, strategy, draw_idx, nums, chance``: what each strategy plays at every
    draw, seeing only the draws before it."""
    plays = _plays(idx, strategies, min_history, game, series_cols, seed, mode, decay, block, True)
    return plays.select(*series_cols, "strategy", "draw_idx", "nums", "chance")


def walk_forward(
    idx: DataFrame,
    strategies: Sequence[str] | str = STRATEGIES,
    min_history: int = MIN_HISTORY,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
    seed: int = 12345,
    mode: str = "xxhash",
    decay: float = DECAY,
    block: int = BLOCK,
) -> DataFrame:
    """``k, strategy, draw_idx, matches, chance_hit, rank`` for every draw with
    at least ``min_history`` draws before it. All strategies share one pass."""
    plays = _plays(idx, strategies, min_history, game, series_cols, seed, mode, decay, block, False)
    return plays.select(*series_cols, "strategy", "draw_idx", "matches", "chance_hit").withColumn(
        "rank", prize_rank("matches", "chance_hit")
    )


def null_moments(game: Game = GAME) -> tuple[float, float]:
    """Mean and variance of the matches of a random ticket (hypergeometric)."""
    n, m = game.main_max, game.main_pick
    mean = m * m / n
    return mean, m * (m / n) * ((n - m) / n) * ((n - m) / (n - 1))


def walk_forward_summary(
    wf: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``k, strategy, n, mean, std, chance_rate, prize_rate, z, p``."""
    mean, var = null_moments(game)
    agg = wf.groupBy(*series_cols, "strategy").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("matches").alias("mean"),
        F.coalesce(F.nanvl(F.stddev_samp("matches"), F.lit(0.0)), F.lit(0.0)).alias("std"),
        F.avg("chance_hit").alias("chance_rate"),
        F.avg(F.col("rank").isNotNull().cast("int")).alias("prize_rate"),
    )
    z = (F.col("mean") - F.lit(mean)) / F.sqrt(F.lit(var) / F.col("n"))
    return agg.withColumn("z", z).withColumn("p", erfc(F.abs("z") / math.sqrt(2.0)))


def walk_forward_ranks(wf: DataFrame, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, strategy, rank, cnt`` over the winning draws."""
    return (
        wf.where("rank IS NOT NULL")
        .groupBy(*series_cols, "strategy", "rank")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def null_run_means(
    idx: DataFrame,
    runs: int = MC_RUNS,
    min_history: int = MIN_HISTORY,
    seed: int = 12345,
    mode: str = "xxhash",
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """``k, run, run_mean``: mean matches of a random ticket per draw, per run.

    Runs unfold inside each draw row and are folded back map-side, so the only
    shuffle carries one row per (series, run) and task. Keys of mode ``md5``, which
    any engine can repeat, are hashed for thousands of draws at a time."""
    k = list(series_cols)
    n = int(idx.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        idx.where(F.col("draw_idx") >= min_history)
        .select(*k, "draw_idx", *game.ball_cols)
        .repartition(n, *k, "draw_idx")
    )
    if mode == "md5":
        return _md5_run_means(rows, runs, seed, game, k)
    rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    parts = [str(seed), quote("null"), *k, "run", "draw_idx"]
    rows = with_floyd_picks(rows, parts, game.main_max, game.main_pick, mode)
    balls = ", ".join(game.ball_cols)
    matched = " + ".join(f"CAST(p{i} IN ({balls}) AS INT)" for i in range(1, game.main_pick + 1))
    return rows.groupBy(*k, "run").agg(F.avg(F.expr(matched)).alias("run_mean"))


def _md5_run_means(rows: DataFrame, runs: int, seed: int, game: Game, k: list[str]) -> DataFrame:
    """``k, run, run_mean``. A draw that lacks a number has no matches to count."""
    head = F.concat_ws("|", F.lit(str(seed)), F.lit("null"), *[F.col(c).cast("string") for c in k])
    known = rows.dropna(subset=game.ball_cols).withColumn("head", head)
    schema = ", ".join([*sql_fields(rows, k), "run int, matched bigint, draws bigint"])
    names = [*k, "run", "matched", "draws"]

    def run_sums(batches):
        # Matches of all runs so far, by series; sent once, when the task's rows are read.
        sums: dict[tuple, list] = {}
        kinds = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kinds = [table.schema.field(c).type for c in k]
            own = list(zip(*(table.column(c).to_pylist() for c in [*k, "head"])))
            index = table.column("draw_idx").to_numpy()
            hit = np.pad(kn.hits(kn.balls(table, game), game.main_max) > 0, ((0, 0), (1, 0)))
            digits = np.char.str_len(index.astype(str))
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(own, digits.tolist())):
                groups.setdefault(key, []).append(i)
            for (series, _), at in groups.items():
                for a in range(0, len(at), SLICE):
                    part = np.array(at[a : a + SLICE])
                    matched = kn.floyd_matches(series[-1].encode(), index[part], hit[part], range(runs), game.main_max, game.main_pick)
                    held = sums.setdefault(series[:-1], [0, 0])
                    held[0], held[1] = held[0] + matched, held[1] + len(part)
        for series, (matched, draws) in sums.items():
            head = [kn.same(v, runs, kind) for v, kind in zip(series, kinds)]
            rest = [pa.array(np.arange(runs), pa.int32()), pa.array(matched), pa.array(np.full(runs, draws))]
            yield pa.RecordBatch.from_arrays([*head, *rest], names=names)

    sums = known.mapInArrow(run_sums, schema).groupBy(*k, "run")
    return sums.agg((F.sum("matched") / F.sum("draws")).alias("run_mean"))


def monte_carlo_null(
    idx: DataFrame,
    runs: int = MC_RUNS,
    min_history: int = MIN_HISTORY,
    seed: int = 12345,
    mode: str = "xxhash",
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """``k, mc_mean, mc_std, p05, p95, n_runs``."""
    means = null_run_means(idx, runs, min_history, seed, mode, game, series_cols)
    return means.groupBy(*series_cols).agg(
        F.avg("run_mean").alias("mc_mean"),
        F.coalesce(F.stddev_samp("run_mean"), F.lit(0.0)).alias("mc_std"),
        F.percentile("run_mean", F.lit(0.05)).alias("p05"),
        F.percentile("run_mean", F.lit(0.95)).alias("p95"),
        F.count(F.lit(1)).alias("n_runs"),
    )


# ------------------------------------------------------------------ backtest
def _backtest_kernel(game: Game, min_history: int, step: int, blend: float, weights: Sequence[float]):
    w_pred, w_gap, w_freq = weights
    split = game.main_max
    inverse = np.array([1.0 / fib(r + 2) for r in range(max(game.main_max, game.chance_max))])
    running = np.concatenate([[1.0], np.cumsum(inverse)])

    def score(cnt, last, seen, at, blended):
        drawn = cnt > 0
        pred = cnt / np.maximum(cnt.sum(axis=1, keepdims=True), 1)
        if blended:
            rank = np.empty_like(cnt)
            order = np.lexsort((seen, np.where(drawn, cnt, 1 << 60)), axis=-1)
            np.put_along_axis(rank, order, np.broadcast_to(np.arange(cnt.shape[1]), cnt.shape), axis=1)
            weight = inverse[rank] / running[drawn.sum(axis=1)][:, None]
            pred = np.where(drawn, (1 - blend) * pred + blend * weight, 0.0)
        gap = np.where(drawn, at[:, None] - 1 - last, 0)
        top_gap, top_cnt = gap.max(axis=1, keepdims=True), cnt.max(axis=1, keepdims=True)
        return (
            w_pred * pred
            + w_gap * gap / np.where(top_gap > 0, top_gap, 1)
            + w_freq * cnt / np.where(top_cnt > 0, top_cnt, 1)
        )

    def kernel(rows, entry):
        at = rows.column("draw_idx").to_numpy()
        keep = (at >= min_history) & ((at - min_history) % step == 0)
        choice, hits = [], []
        for values, size, part, pick, main in (
            (kn.balls(rows, game), game.main_max, slice(0, split), game.main_pick, True),
            (kn.bonus(rows), game.chance_max, slice(split, None), 1, False),
        ):
            hit = kn.hits(values, size)
            cnt = kn.before(hit, entry["cnt"][part])[keep]
            last = kn.last_before(hit, at, entry["last"][part])[keep]
            seen = kn.seen_before(values, at, size, ENCOUNTER_STRIDE, entry["seen"][part])[keep]
            value = kn.settle_digits(score(cnt, last, seen, at[keep], main))
            choice.append(kn.low_numbers(-value, pick))
            hits.append(hit[keep])
        return _played(0, at[keep], choice[0], choice[1][:, 0], hits[0], hits[1], True)

    return kernel


def backtest_scores(
    idx: DataFrame,
    min_history: int = 100,
    step: int = 1,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
    blend: float = FIB_BLEND,
    weights: Sequence[float] = SCORE_A_WEIGHTS,
    block: int = BLOCK,
) -> DataFrame:
    """Walk-forward of the blended number score: at every ``step``-th draw the
    five best numbers and the best chance number are played.
    ``k, draw_idx, nums, chance, matches, chance_hit, rank, points``."""
    k = list(series_cols)
    slim = idx.select(*k, "draw_idx", *game.ball_cols, "chance")
    carry = block_carry(slim, ["cnt", "last", "seen"], game, k, block)
    plays = apply_blocks(
        slim, carry, _backtest_kernel(game, min_history, step, blend, weights), _PLAYED_NUMS, k, block
    )
    return (
        plays.select(*k, "draw_idx", "nums", "chance", "matches", "chance_hit")
        .withColumn("rank", prize_rank("matches", "chance_hit", "short"))
        .withColumn("points", rank_points("rank"))
    )


# ------------------------------------------------------------------ report
def evaluation_report(
    idx: DataFrame,
    min_history: int = MIN_HISTORY,
    runs: int = MC_RUNS,
    seed: int = 12345,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
    mode: str = "xxhash",
    alpha: float = 0.01,
) -> DataFrame:
    """Tidy ``k, section, item, metric, value`` rows: data size, strategies with
    their verdict (1 = differs from chance), ranks, null band, odds and expected
    value. Series shorter than ``min_history + 10`` are left out."""
    from drawlytics.operators.odds import expected_value, game_odds, game_summary

    k = list(series_cols)
    usable = with_length(idx, k).where(F.col("n_draws") >= min_history + 10)
    sizes = materialize(series_length(usable, k), "sizes")
    wf = materialize(walk_forward(usable, STRATEGIES, min_history, game, k, seed, mode), "walk-forward")

    def tidy(df: DataFrame, section: str, item, metrics: Sequence[str]) -> DataFrame:
        cells = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        )
        return df.select(*k, F.lit(section).alias("section"), item.alias("item"), F.inline(cells))

    summary = walk_forward_summary(wf, game, k).withColumn("differs", (F.col("p") < alpha).cast("int"))
    spec = F.struct(
        F.lit("game").alias("game_id"),
        F.lit(game.main_max).alias("main_max"),
        F.lit(game.main_pick).alias("main_pick"),
        F.lit(game.chance_max).alias("chance_max"),
        F.lit(game.ticket_price).alias("ticket_price"),
    )
    # The game is the same for all series: its facts are keyed by series here.
    games = sizes.select(*k, F.inline(F.array(spec))).withColumn(
        "game_id", F.to_json(F.struct(*k))
    )
    facts = games.select(*k, "game_id")
    odds = facts.join(game_odds(games), "game_id")
    values = facts.join(expected_value(games), "game_id").join(game_summary(games), "game_id")
    sections = [
        tidy(
            sizes.withColumn("n_evaluated", F.col("n_draws") - min_history).withColumn("null_mean", F.lit(null_moments(game)[0])),
            "dataset", F.lit("draws"), ["n_draws", "n_evaluated", "null_mean"],
        ),
        tidy(summary, "strategy", F.col("strategy"), ["n", "mean", "std", "chance_rate", "prize_rate", "z", "p", "differs"]),
        tidy(
            walk_forward_ranks(wf, k).withColumnRenamed("cnt", "draws"),
            "rank", F.concat_ws(" / ", "strategy", "rank"), ["draws"],
        ),
        tidy(
            monte_carlo_null(usable, runs, min_history, seed, mode, game, k),
            "null", F.lit("random tickets"), ["mc_mean", "mc_std", "p05", "p95", "n_runs"],
        ),
        tidy(odds, "odds", F.col("label"), ["p"]),
        tidy(values, "value", F.lit("ticket"), ["gross", "net", "rtp", "tickets", "p_any_prize"]),
    ]
    out = sections[0]
    for s in sections[1:]:
        out = out.unionByName(s)
    return out
