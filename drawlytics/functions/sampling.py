"""Keyed uniforms and in-row sampling.

A uniform is a hash of its key (seed, purpose, simulation, item), never a
generator state: results do not depend on partitioning, task order or retries.
``xxhash`` is the fast default, ``md5`` can be reproduced by any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from drawlytics.params import GAME, Game


def uniform_sql(parts: list[str], mode: str = "xxhash") -> str:
    """SQL of a uniform in [0, 1) keyed by ``parts`` (SQL expressions).

    ``xxhash`` hashes the values as they are, ``md5`` their text joined by ``|``."""
    if mode == "md5":
        key = "concat_ws('|', " + ", ".join(f"CAST({p} AS STRING)" for p in parts) + ")"
        return f"(CAST(conv(substr(md5({key}), 1, 12), 16, 10) AS BIGINT) / 281474976710656D)"
    if mode == "xxhash":
        return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) / 9007199254740992D)"
    raise ValueError(f"unknown hash mode {mode!r}")


def with_floyd_picks(
    df: DataFrame, parts: list[str], total: int, pick: int, mode: str, prefix: str = "p"
) -> DataFrame:
    """Add columns ``p1..p<pick>``: a uniform subset of ``1..total``, no repeats.

    Floyd's method: step j draws from ``1..j`` and takes j itself on a repeat.
    """
    for i in range(1, pick + 1):
        j = total - pick + i
        drawn = f"CAST(1 + floor({uniform_sql([*parts, str(j)], mode)} * {j}) AS INT)"
        df = df.withColumn("_t", F.expr(drawn))
        taken = " OR ".join(f"_t = {prefix}{m}" for m in range(1, i)) or "false"
        df = df.withColumn(f"{prefix}{i}", F.expr(f"CASE WHEN {taken} THEN {j} ELSE _t END")).drop("_t")
    return df


def uniform_chance_sql(parts: list[str], game: Game = GAME, mode: str = "xxhash") -> str:
    return f"CAST(1 + floor({uniform_sql([*parts, quote('chance')], mode)} * {game.chance_max}) AS INT)"


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def with_weighted_subset(
    df: DataFrame, weights: str, parts: list[str], pick: int, mode: str, out: str
) -> DataFrame:
    """Add ``out``: a weighted sample without replacement of ``pick`` of the
    positions of ``weights`` (from 1), ascending; shorter when fewer weights are positive.

    The ``pick`` smallest exponential clocks ``-ln(u)/w`` win; a zero weight
    never runs. One pass builds the clocks and one sort orders them: keeping it
    a single expression stops the optimizer from repeating the pass per number."""
    u = uniform_sql([*parts, "i + 1"], mode)
    clocks = (
        f"transform({weights}, (w, i) -> CASE WHEN w > 0D THEN"
        f" struct(-ln(greatest({u}, 1e-300D)) / w AS clock, CAST(i + 1 AS INT) AS num) END)"
    )
    # Nulls (zero weights) sort last and are dropped from the winners.
    winners = f"array_compact(transform(slice(array_sort({clocks}), 1, {pick}), s -> s.num))"
    return df.withColumn(out, F.expr(f"sort_array({winners})"))
