"""Combination generators. Results are ``k, combo_id, nums, chance, method``."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from drawlytics.functions.sampling import quote, with_floyd_picks, with_weighted_subset
from drawlytics.operators.common import pool_window
from drawlytics.operators.forest import PRIME, key as keyed
from drawlytics.operators.scores import rank_scores
from drawlytics.params import (
    CHANCE,
    GAME,
    MAIN,
    MC_SIMULATIONS,
    WHEEL_MAX,
    WHEEL_NUMBERS,
    Game,
)
from drawlytics.plans.index import SERIES
from drawlytics.plans.store import materialize, session_root


def _arrays(ranked: DataFrame, k: Sequence[str]) -> DataFrame:
    """``k, main, chance``: numbers of each pool in ``rnk`` order, one row per
    series (at most one entry per number of the game)."""
    entry = F.struct("rnk", "num")
    return (
        ranked.groupBy(*k)
        .agg(
            *[
                F.array_sort(F.collect_list(F.when(F.col("pool") == p, entry))).alias(p)
                for p in (MAIN, CHANCE)
            ]
        )
        .select(*k, F.col("main.num").alias("main"), F.col("chance.num").alias("chance"))
    )


def freq_slices(
    freq: DataFrame, n: int = 5, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """Up to five combinations, the i-th holding the i-th slice of numbers by
    frequency (the top slice again when too few are left), with the most
    frequent chance number."""
    k = list(series_cols)
    rank = F.row_number().over(pool_window(k).orderBy(F.desc("cnt"), F.asc("seen_key")))
    m = game.main_pick
    part = f"slice(main, i * {m} + 1, {m})"
    rows = F.expr(
        f"transform(sequence(0, {min(n, 5) - 1}), i -> struct(i + 1 AS combo_id,"
        f" array_sort(CASE WHEN size({part}) < {m} THEN slice(main, 1, {m}) ELSE {part} END) AS nums))"
    )
    return (
        _arrays(freq.withColumn("rnk", rank), k)
        .select(*k, F.get("chance", F.lit(0)).alias("best"), F.inline(rows))
        .select(*k, "combo_id", "nums", F.col("best").alias("chance"), F.lit("frequency").alias("method"))
    )


def top_combo(
    scores: DataFrame, method: str = "model", game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """The best numbers by score with the best chance number."""
    k = list(series_cols)
    return _arrays(rank_scores(scores, k), k).select(
        *k,
        F.lit(1).alias("combo_id"),
        F.array_sort(F.slice("main", 1, game.main_pick)).alias("nums"),
        F.get("chance", F.lit(0)).alias("chance"),
        F.lit(method).alias("method"),
    )


def _score_arrays(scores: DataFrame, k: Sequence[str]) -> DataFrame:
    """``k, w_main, w_chance``: scores in number order. Expects every number."""
    entry = F.struct("num", "score")
    return (
        scores.groupBy(*k)
        .agg(
            *[
                F.array_sort(F.collect_list(F.when(F.col("pool") == p, entry))).alias(f"w_{p}")
                for p in (MAIN, CHANCE)
            ]
        )
        .select(*k, *[F.col(f"w_{p}.score").alias(f"w_{p}") for p in (MAIN, CHANCE)])
    )


def _chunks(weights: DataFrame, sims: int, k: Sequence[str], chunk: int = 4000) -> DataFrame:
    """``weights`` once per chunk of simulations ``[lo, hi)``, chunks spread over
    the cluster, so the simulations of one series do not stay in one task."""
    n = int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col("chunk") * chunk
    return (
        weights.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-sims // chunk) - 1))))
        .repartition(n, *k, "chunk")
        .withColumn("lo", at)
        .withColumn("hi", F.least(at + chunk, F.lit(sims)))
    )


def _lowest_clocks(weights: np.ndarray, key: int, sims: np.ndarray, pick: int) -> np.ndarray:
    """(sims, pick) ascending positions of the smallest ``-ln(u)/w``. ``u`` is a
    hash of (simulation, position, key) in whole numbers, so any engine can
    repeat it; empty when weights run short."""
    alive = np.flatnonzero(weights > 0)
    if len(alive) < pick:
        return np.zeros((0, pick), dtype=np.int32)
    u = (keyed(sims[:, None].astype(np.int64), alive + 1, np.int64(key)) + 0.5) / PRIME
    clock = -np.log(u) / weights[alive]
    best = np.argpartition(clock, pick - 1, axis=1)[:, :pick]
    return np.sort(alive[best] + 1, axis=1).astype(np.int32)


def _sampled(chunks: DataFrame, seed: int, game: Game, k: list[str]) -> DataFrame:
    """``k, sim, nums, chance``: weighted samples without replacement, whole chunks of simulations as arrays."""
    keyed = chunks.select(
        *k, "lo", "hi", "w_main", "w_chance",
        *[F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(p), *k)), 1, 7), 16, 10).cast("long").alias(f"key_{p}") for p in (MAIN, CHANCE)],
    )
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name in k)
    schema = ", ".join(x for x in (types, "sim int, nums array<int>, chance int") if x)
    pick = game.main_pick

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                sims = np.arange(row["lo"], row["hi"])
                main = _lowest_clocks(np.array(row["w_main"]), row["key_main"], sims, pick)
                if not len(main):
                    continue
                extra = _lowest_clocks(np.array(row["w_chance"] or []), row["key_chance"], sims, 1)
                offsets = np.arange(0, pick * len(main) + 1, pick, dtype=np.int32)
                fixed = [pa.array([row[c]] * len(main), batch.schema.field(c).type) for c in k]
                yield pa.RecordBatch.from_arrays(
                    [
                        *fixed,
                        pa.array(sims.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(main.ravel())),
                        pa.array(extra[:, 0]) if len(extra) else pa.nulls(len(main), pa.int32()),
                    ],
                    names=[*k, "sim", "nums", "chance"],
                )

    return keyed.mapInArrow(run, schema)


def monte_carlo_combos(
    scores: DataFrame,
    sims: int = MC_SIMULATIONS,
    top: int = 5,
    seed: int = 42,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """The ``top`` most frequent of ``sims`` weighted samples without replacement
    (first seen first on ties) with column ``cnt``; the i-th combination takes
    the i-th most frequent sampled chance number."""
    k = list(series_cols)
    drawn = _sampled(_chunks(_score_arrays(scores, k), sims, k), seed, game, k)
    combos = (
        drawn.where(F.size("nums") == game.main_pick)
        .groupBy(*k, "nums")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("sim").alias("first_sim"))
    )
    bonus = (
        drawn.where("chance IS NOT NULL")
        .groupBy(*k, "chance")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min("sim").alias("first_sim"))
    )
    order = W.partitionBy(*k).orderBy(F.desc("cnt"), "first_sim")
    best = combos.withColumn("combo_id", F.row_number().over(order)).where(F.col("combo_id") <= top)
    extra = bonus.withColumn("combo_id", F.row_number().over(order)).select(*k, "combo_id", "chance")
    return best.join(extra, [*k, "combo_id"], "left").select(
        *k, "combo_id", "nums", "chance", F.lit("monte carlo").alias("method"), "cnt"
    )


def wheeling(
    scores: DataFrame,
    top: int = WHEEL_NUMBERS,
    limit: int = WHEEL_MAX,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """All subsets of the ``top`` best numbers in lexicographic order, the first
    ``limit`` of them. Which positions form a subset is known up front, so each
    series row unfolds on its own."""
    k = list(series_cols)
    chosen = list(combinations(range(top), game.main_pick))[:limit]
    places = F.array(*[F.array(*[F.lit(i) for i in c]) for c in chosen])
    best = _arrays(rank_scores(scores, k).where(F.col("rnk") <= top), k).where(F.size("main") == top)
    return (
        best.withColumn("main", F.array_sort("main"))
        .select(*k, "main", F.posexplode(places).alias("at", "places"))
        .select(
            *k,
            (F.col("at") + 1).alias("combo_id"),
            F.expr("transform(places, i -> main[i])").alias("nums"),
            F.lit(None).cast("int").alias("chance"),
            F.lit("wheeling").alias("method"),
        )
    )


def direct_combos(
    scores: DataFrame, n: int = 5, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """Slices of the ascending number list at offsets 0, 2, 4, ...; a slice past
    the end is completed with the smallest numbers it lacks."""
    k = list(series_cols)
    m = game.main_pick
    part = f"slice(main, 2 * i + 1, {m})"
    filled = f"array_sort(slice(concat({part}, array_except(main, {part})), 1, {m}))"
    rows = F.expr(f"transform(sequence(0, {n - 1}), i -> struct(i + 1 AS combo_id, {filled} AS nums))")
    numbers = scores.where(F.col("pool") == MAIN).withColumn("rnk", F.col("num"))
    return (
        _arrays(numbers, k)
        .select(*k, F.inline(rows))
        .select(*k, "combo_id", "nums", F.lit(None).cast("int").alias("chance"), F.lit("direct").alias("method"))
        .where(F.size("nums") == m)
    )


def generate_combos(
    scores: DataFrame,
    count: int = 5,
    sims: int = MC_SIMULATIONS,
    seed: int = 42,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """``count`` combinations per series from the first method that yields
    enough: Monte Carlo, wheeling, direct slices. A method runs only for the
    series that the one before left short; what the last yields is kept."""
    k = list(series_cols)
    methods = [
        lambda s: monte_carlo_combos(s, sims, count, seed, game, k).drop("cnt"),
        lambda s: wheeling(s, game=game, series_cols=k).where(F.col("combo_id") <= count),
        lambda s: direct_combos(s, count, game, k),
    ]
    left, out = scores, None
    for at, method in enumerate(methods):
        made = method(left)
        if at < len(methods) - 1:
            made = materialize(made, "generated")
            enough = made.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= count).select(*k)
            left, made = left.join(enough, k, "left_anti"), made.join(enough, k, "left_semi")
        out = made if out is None else out.unionByName(made)
        if at < len(methods) - 1 and left.isEmpty():
            break
    return out


def propose_chance(
    scores: DataFrame, n: int = 5, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """``k, rnk, chance``: chance numbers by score, then the missing ones ascending."""
    k = list(series_cols)
    scored = rank_scores(scores.where(F.col("pool") == CHANCE), k)
    missing = f"array_except(sequence(1, {game.chance_max}), chance)"
    return (
        _arrays(scored, k)
        .select(*k, F.posexplode(F.expr(f"slice(concat(chance, {missing}), 1, {n})")).alias("at", "chance"))
        .select(*k, (F.col("at") + 1).alias("rnk"), "chance")
    )


def mixed_combos(
    scores: DataFrame,
    n: int = 5,
    seed: int = 42,
    mode: str = "xxhash",
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
) -> DataFrame:
    """``n // 2 + 1`` uniform subsets of the best ``2 * pick`` numbers, then as
    many weighted samples over all numbers; repeats dropped, the first ``n``
    kept, the i-th taking the i-th best chance number."""
    k = list(series_cols)
    m, half = game.main_pick, n // 2 + 1
    ranked = _arrays(rank_scores(scores, k), k)
    tries = ranked.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(half - 1))))
    tries = with_floyd_picks(tries, [str(seed), quote("top"), *k, "ord"], 2 * m, m, mode)
    uniform = tries.select(
        *k, "ord", F.array_sort(F.array(*[F.expr(f"main[p{i} - 1]") for i in range(1, m + 1)])).alias("nums")
    )
    weighted = _score_arrays(scores, k).withColumn("ord", F.explode(F.sequence(F.lit(half), F.lit(2 * half - 1))))
    weighted = (
        with_weighted_subset(
            weighted, "w_main", [str(seed), quote("weighted"), *k, "ord"], m, mode, "nums"
        )
        .select(*k, "ord", "nums")
        .where(F.size("nums") == m)
    )
    distinct = uniform.unionByName(weighted).groupBy(*k, "nums").agg(F.min("ord").alias("ord"))
    kept = distinct.withColumn("combo_id", F.row_number().over(W.partitionBy(*k).orderBy("ord"))).where(
        F.col("combo_id") <= n
    )
    return kept.join(ranked.select(*k, F.col("chance").alias("by_rank")), k).select(
        *k,
        "combo_id",
        "nums",
        F.get("by_rank", F.col("combo_id") - 1).alias("chance"),
        F.lit("mixed").alias("method"),
    )


def _block_best(blocks: DataFrame, wanted: DataFrame, k: list[str]) -> DataFrame:
    """``k, blk, best``: the best candidate (gain, -id, mask) of each wanted block (``k, blk, covered``). Other blocks are not read."""
    numbers = [r["blk"] for r in wanted.select("blk").distinct().collect()]
    gain = F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not("covered")))
    one = F.struct(gain.alias("gain"), (-F.col("combo_id")).alias("first"), "mask")
    rows = blocks.where(F.col("blk").isin(numbers)).join(wanted, [*k, "blk"])
    return materialize(rows.groupBy(*k, "blk").agg(F.max(one).alias("best")), "cover-best")


def cover_grid(
    pool: DataFrame, n: int = 10, game: Game = GAME, series_cols: Sequence[str] = SERIES, block_rows: int = 1_000_000
) -> DataFrame:
    """``k, ord, combo_id, nums``: ``n`` combinations of the pool chosen one after
    the other, each adding the most numbers not covered yet (the smaller
    ``combo_id`` on ties; the first one is the first candidate).

    Equal combinations are folded, then dealt to blocks of about ``block_rows``.
    What a candidate adds only shrinks, so a block's best of an earlier round
    bounds it: a round looks at the block of the highest bound, then at those
    whose bound beats what was found there, and reads no other. Candidates meet
    their series by (series, block); per series travel one row per block.
    """
    if game.main_max > 63:
        raise ValueError("cover_grid packs the numbers of a game into 63 bits")
    k = list(series_cols)
    spark = pool.sparkSession
    mask = F.expr("aggregate(nums, 0L, (acc, x) -> acc | shiftleft(1L, x - 1))")
    parts = min(10_000, -(-pool.count() // block_rows) or 1)
    path = f"{session_root(spark)}/cover-blocks-{uuid.uuid4().hex}"
    folded = pool.select(*k, "combo_id", mask.alias("mask")).groupBy(*k, "mask").agg(F.min("combo_id").alias("combo_id"))
    folded = folded.withColumn("blk", F.pmod(F.xxhash64(*k, "mask"), F.lit(parts)).cast("int"))
    folded.repartition(max(parts, 1), "blk").write.partitionBy("blk").parquet(path)
    blocks = spark.read.schema(folded.schema).parquet(path)
    first = blocks.groupBy(*k).agg(F.min(F.struct("combo_id", "mask")).alias("first"))
    state = materialize(first.select(*k, F.array("first.combo_id").alias("chosen"), F.col("first.mask").alias("covered")), "cover")
    bounds, spare = materialize(blocks.select(*k, "blk").distinct(), "cover-blocks"), None
    for turn in range(1, n):
        covered = state.select(*k, "covered")
        if turn == 1 or parts == 1:
            bounds = _block_best(blocks, bounds.select(*k, "blk").join(covered, k), k)
        else:
            # The block that leads each series, then all that may beat what it really has.
            lead = bounds.groupBy(*k).agg(F.max_by("blk", "best").alias("blk"))
            led = _block_best(blocks, lead.join(covered, k), k)
            rest = bounds.join(led.select(*k, "blk"), [*k, "blk"], "left_anti")
            beaten = rest.join(led.select(*k, F.col("best").alias("found")), k).where("best > found").select(*k, "blk")
            beaten = materialize(beaten, "cover-rivals")
            seen = led if beaten.isEmpty() else led.unionByName(_block_best(blocks, beaten.join(covered, k), k))
            old = rest.join(beaten, [*k, "blk"], "left_anti")
            bounds = materialize(seen.unionByName(old.select(*seen.columns)), "cover-bounds")
        best = bounds.groupBy(*k).agg(F.max("best").alias("best"))
        state = materialize(state.join(best, k), "cover")
        adds = F.col("best.gain") > 0
        picked = F.when(adds, -F.col("best.first"))
        if not state.where(~adds).isEmpty():
            # Everything coverable is covered: the smallest ids not chosen, copies included, of the n + 1 smallest.
            if spare is None:
                age = F.row_number().over(W.partitionBy(*k).orderBy("combo_id"))
                few = pool.select(*k, "combo_id").withColumn("age", age).where(F.col("age") <= n)
                spare = materialize(few.groupBy(*k).agg(F.array_sort(F.collect_list("combo_id")).alias("spare")), "cover-spare")
            state = state.join(spare, k)
            picked = F.coalesce(picked, F.get(F.array_except("spare", "chosen"), F.lit(0)))
        state = state.withColumn("picked", picked)
        state = materialize(
            state.select(
                *k,
                F.when(F.col("picked").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array("picked"))).alias("chosen"),
                F.when(adds, F.col("covered").bitwiseOR(F.col("best.mask"))).otherwise(F.col("covered")).alias("covered"),
            ),
            "cover",
        )
    picked = state.select(*k, F.posexplode("chosen").alias("at", "combo_id"))
    return picked.join(pool.select(*k, "combo_id", "nums"), [*k, "combo_id"]).select(
        *k, (F.col("at") + 1).alias("ord"), "combo_id", "nums"
    )


def recurring_numbers(cover: DataFrame, top: int = 5, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, rnk, num, cnt``: the ``top`` numbers of a cover by use, those used
    more than once."""
    k = list(series_cols)
    counts = (
        cover.select(*k, "ord", F.posexplode("nums").alias("pos", "num"))
        .groupBy(*k, "num")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min(F.col("ord") * 1000 + F.col("pos")).alias("seen"))
    )
    rank = F.row_number().over(W.partitionBy(*k).orderBy(F.desc("cnt"), "seen"))
    return counts.withColumn("rnk", rank).where((F.col("rnk") <= top) & (F.col("cnt") > 1)).select(*k, "rnk", "num", "cnt")
