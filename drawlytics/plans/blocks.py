"""Running per-number states at every draw, computed in fixed-size index blocks.

The value a number has *before* draw ``i`` (how often it was drawn, when it was
last drawn, ...) is a running aggregate over the history. A window per series
would sort a whole history in one task, and a draw x number grid would multiply
the shuffled rows by the domain. Instead:

* draws are shuffled once, as they are, by ``(series, index block)``; a block
  holds at most ``block`` draws whatever the length of the series, and a small
  array kernel runs over it;
* each block enters with the folded totals of all earlier blocks. Totals are
  pre-aggregated map-side, their table is ``block`` times smaller than the
  occurrences, and it is folded in two levels so that no window over it grows
  with one series either.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from drawlytics.params import BLOCK, CHANCE, DECAY, GAME, Game
from drawlytics.plans import kernels as kn
from drawlytics.plans.index import ENCOUNTER_STRIDE, SERIES, domain_array, occurrences
from drawlytics.plans.store import materialize

# state -> (aggregate inside a block, fold over blocks, value when nothing came before)
FOLDS = {
    "cnt": (lambda: F.count("num"), F.sum, 0),
    "last": (lambda: F.max("draw_idx"), F.max, -1),
    "seen": (
        lambda: F.min(F.col("pos") * F.lit(ENCOUNTER_STRIDE) + F.col("draw_idx")),
        F.min,
        (1 << 62),
    ),
}


def block_of(block: int = BLOCK) -> Column:
    return F.expr(f"draw_idx div {block}L")


def by_block(df: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """Hash by (series, blk) into the configured number of partitions: the rows
    are few bytes but each costs a domain-wide computation, so the byte-based
    coalescing of adaptive execution would leave most cores idle."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *series_cols, "blk")


def _gather(df: DataFrame, values: Sequence[str], k: list[str], *extra: Column) -> DataFrame:
    """One row per block with map ``got``: (pool, num) -> values. At most one
    entry per number of the game."""
    entry = F.struct(F.struct("pool", "num"), F.struct(*values))
    return df.groupBy(*k, "blk").agg(F.map_from_entries(F.collect_list(entry)).alias("got"), *extra)


def _filled(values: Sequence[str], game: Game) -> Column:
    """``got`` as an array over all numbers, null fields where there is no entry."""

    def cell(d: Column) -> Column:
        found = F.try_element_at("got", d)
        return F.struct(
            d["pool"].alias("pool"), d["num"].alias("num"), *[found[v].alias(v) for v in values]
        )

    return F.transform(domain_array(game), cell)


def _pack(entries: DataFrame, values: Sequence[str], k: list[str]) -> DataFrame:
    """One row per block with an array per value, main pool first, from rows that
    cover every number."""
    entry = F.struct((F.col("pool") == CHANCE).alias("bonus"), "num", *values)
    packed = entries.groupBy(*k, "blk").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    return packed.select(*k, "blk", *[F.col(f"all.{v}").alias(v) for v in values])


def block_carry(
    idx: DataFrame,
    states: Sequence[str],
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
    block: int = BLOCK,
    fan: int = BLOCK,
) -> DataFrame:
    """``k, blk, <state>...``: per state one array over all numbers (main pool
    first, then chance) holding its value just before the block starts."""
    k = list(series_cols)
    totals = (
        occurrences(idx, game, k)
        .withColumn("blk", block_of(block))
        .groupBy(*k, "blk", "pool", "num")
        .agg(*[FOLDS[s][0]().alias(s) for s in states])
    )
    # Numbers a block does not hold are filled in per block row. The table is
    # written, as both fold levels read it: the draws are scanned exactly once.
    dense = materialize(
        _gather(totals, states, k)
        .select(*k, "blk", F.inline(_filled(states, game)))
        .withColumn("grp", F.expr(f"blk div {fan}L")),
        "block-totals",
    )
    inner = W.partitionBy(*k, "pool", "num", "grp").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*k, "pool", "num").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    near = dense.select(
        *k, "blk", "pool", "num", "grp", *[FOLDS[s][1](s).over(inner).alias(f"near_{s}") for s in states]
    )
    far = (
        dense.groupBy(*k, "pool", "num", "grp")
        .agg(*[FOLDS[s][1](s).alias(s) for s in states])
        .select(*k, "pool", "num", "grp", *[FOLDS[s][1](s).over(outer).alias(f"far_{s}") for s in states])
    )

    def both(s: str) -> Column:
        a, b, empty = F.col(f"near_{s}"), F.col(f"far_{s}"), F.lit(FOLDS[s][2])
        if s == "cnt":
            return F.coalesce(a, empty) + F.coalesce(b, empty)
        pick = F.greatest if s == "last" else F.least
        return F.coalesce(pick(a, b), empty)

    entries = near.join(far, [*k, "pool", "num", "grp"]).select(
        *k, "blk", "pool", "num", *[both(s).alias(s) for s in states]
    )
    return _pack(entries, states, k)


def decay_carry(
    idx: DataFrame,
    game: Game = GAME,
    decay: float = DECAY,
    series_cols: Sequence[str] = SERIES,
    block: int = BLOCK,
) -> DataFrame:
    """``k, blk, decay``: per number the sum of ``exp((j - block_start)/decay)``
    over its hits ``j`` before the block.

    ``exp(-x)`` is 0 in double precision for x > 746, so a block total reaches a
    fixed number of later blocks and no running fold over a series is needed.
    """
    k = list(series_cols)
    reach = int(750 * decay // block) + 2
    age = (F.col("draw_idx") - F.col("blk") * block) / F.lit(float(decay))
    totals = (
        occurrences(idx, game, k)
        .withColumn("blk", block_of(block))
        .groupBy(*k, "blk", "pool", "num")
        .agg(F.sum(F.exp(age)).alias("part"))
    )
    # Step 0 contributes nothing: it marks the blocks that exist.
    sent = (
        totals.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(reach))))
        .withColumn(
            "decay",
            F.when(F.col("ahead") == 0, 0.0).otherwise(
                F.col("part") * F.exp(-F.col("ahead") * block / F.lit(float(decay)))
            ),
        )
        .withColumn("blk", F.col("blk") + F.col("ahead"))
        .groupBy(*k, "blk", "pool", "num")
        .agg(F.sum("decay").alias("decay"), F.min("ahead").alias("ahead"))
    )
    entries = (
        _gather(sent, ["decay"], k, F.min("ahead").alias("ahead"))
        .where("ahead = 0")
        .select(*k, "blk", F.inline(_filled(["decay"], game)))
        .fillna(0.0, ["decay"])
    )
    return _pack(entries, ["decay"], k)


def sql_fields(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names]


def apply_blocks(
    idx: DataFrame,
    carry: DataFrame,
    kernel: Callable,
    schema: str,
    series_cols: Sequence[str] = SERIES,
    block: int = BLOCK,
) -> DataFrame:
    """Run ``kernel(rows, entry) -> list of arrow arrays`` on every block: rows
    in draw order, ``entry`` the block's carried arrays by state. ``schema``
    names the arrays and excludes the series columns."""
    k = list(series_cols)
    fields = [*sql_fields(idx, k), schema]
    names = [*k, *[f.split()[0] for f in schema.split(", ")]]
    states = [c for c in carry.columns if c not in (*k, "blk")]
    rows = by_block(idx.withColumn("blk", block_of(block)), k)
    # Renamed, as both sides come from the same table.
    entries = carry.select(*[F.col(c).alias(f"_at_{c}") for c in (*k, "blk")], *states)

    def run(left, right):
        left = left.sort_by("draw_idx")
        entry = {s: right.column(s)[0].values.to_numpy(zero_copy_only=False) for s in states}
        out = kernel(left, entry)
        head = [kn.same(left.column(c)[0].as_py(), len(out[0]), left.schema.field(c).type) for c in k]
        return pa.Table.from_arrays([*head, *out], names=names)

    return (
        rows.groupBy(*k, "blk")
        .cogroup(entries.groupBy(*[f"_at_{c}" for c in (*k, "blk")]))
        .applyInArrow(run, ", ".join(fields))
    )


def prefix_counts(
    idx: DataFrame, game: Game = GAME, series_cols: Sequence[str] = SERIES, block: int = BLOCK
) -> DataFrame:
    """``k, draw_idx, main_cnt, chance_cnt``: how often every number was drawn
    before each draw, as arrays in number order."""
    k = list(series_cols)
    schema = "draw_idx bigint, main_cnt array<bigint>, chance_cnt array<bigint>"
    slim = idx.select(*k, "draw_idx", *game.ball_cols, "chance")

    def kernel(rows, entry):
        main = kn.before(kn.hits(kn.balls(rows, game), game.main_max), entry["cnt"][: game.main_max])
        chance = kn.before(kn.hits(kn.bonus(rows), game.chance_max), entry["cnt"][game.main_max :])
        return [rows.column("draw_idx").combine_chunks(), kn.lists(main, pa.int64()), kn.lists(chance, pa.int64())]

    return apply_blocks(slim, block_carry(slim, ["cnt"], game, k, block), kernel, schema, k, block)


def halo_blocks(idx: DataFrame, width: int, series_cols: Sequence[str] = SERIES, block: int = BLOCK) -> DataFrame:
    """``idx`` hashed by block, the ``width`` rows before each block copied into
    it and marked ``halo``: trailing frames of ``width`` rows are complete."""
    own = f"draw_idx div {block}L"
    reach = -(-width // block)
    homes = F.expr(
        f"filter(sequence({own}, {own} + {reach}L), b -> b = {own} OR draw_idx >= b * {block}L - {width}L)"
    )
    copied = idx.withColumn("blk", F.explode(homes)).withColumn("halo", F.col("blk") != F.expr(own))
    return by_block(copied, series_cols)
