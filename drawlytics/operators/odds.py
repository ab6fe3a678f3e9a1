"""Exact odds and expected values over tables of games and prizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawlytics.params import JACKPOT, RANKS


def choose(n: Column, k: Column) -> Column:
    """C(n, k) as a double product, 0 for k < 0 or k > n."""
    steps = F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    product = F.aggregate(
        steps, F.lit(1.0), lambda acc, i: acc * (n - k + i).cast("double") / i.cast("double")
    )
    return F.when((k < 0) | (k > n), F.lit(0.0)).otherwise(F.round(product, 0))


def rank_array() -> Column:
    return F.array(
        *[
            F.struct(F.lit(a).alias("label"), F.lit(k).alias("k"), F.lit(c).alias("need_chance"), F.lit(p).alias("prize"))
            for a, _, k, c, p, _ in RANKS
        ]
    )


def with_default_ranks(games: DataFrame) -> DataFrame:
    """``games`` x the default winning ranks with their prizes."""
    return games.select("*", F.inline(rank_array()))


def match_odds(games: DataFrame) -> DataFrame:
    """``game_id, k, p``: probability of exactly k matches. ``games`` has
    ``game_id, main_max, main_pick, chance_max``."""
    n, m = F.col("main_max"), F.col("main_pick")
    out = games.withColumn("k", F.explode(F.sequence(F.lit(0), m)))
    p = choose(m, F.col("k")) * choose(n - m, m - F.col("k")) / choose(n, m)
    return out.select("game_id", "k", p.alias("p"))


def game_odds(games: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """``game_id, label, p`` per winning rank. ``ranks`` adds
    ``game_id, label, k, need_chance``; default ranks otherwise."""
    g = with_default_ranks(games) if ranks is None else games.join(ranks, "game_id")
    n, m, c = F.col("main_max"), F.col("main_pick"), F.col("chance_max")
    p_main = choose(m, F.col("k")) * choose(n - m, m - F.col("k")) / choose(n, m)
    p_chance = F.when(F.col("need_chance") == 1, F.lit(1.0) / c).otherwise(F.lit(1.0) - F.lit(1.0) / c)
    extra = [x for x in ("prize",) if x in g.columns]
    return g.select("game_id", "label", (p_main * p_chance).alias("p"), *extra)


def game_summary(games: DataFrame) -> DataFrame:
    """Distinct tickets (= one-in-N odds of the jackpot), probability of any prize."""
    tickets = choose(F.col("main_max"), F.col("main_pick")) * F.col("chance_max")
    odds = game_odds(games).groupBy("game_id").agg(F.sum("p").alias("p_any_prize"))
    return games.select("game_id", tickets.alias("tickets")).join(odds, "game_id").select(
        "game_id", "tickets", "p_any_prize", (F.lit(1.0) - F.col("p_any_prize")).alias("p_nothing")
    )


def expected_value(games: DataFrame, prizes: DataFrame | None = None) -> DataFrame:
    """``game_id, gross, net, rtp``. ``prizes``: ``game_id, label, prize``
    (labels without a prize count 0). ``games`` also has ``ticket_price``."""
    odds = _priced(games, prizes)
    gross = odds.groupBy("game_id").agg(F.sum(F.col("p") * F.col("prize")).alias("gross"))
    price = F.col("ticket_price")
    return games.join(gross, "game_id").select(
        "game_id",
        "gross",
        (F.col("gross") - price).alias("net"),
        (F.col("gross") / F.nullif(price, F.lit(0.0))).alias("rtp"),
    )


def breakeven_jackpot(games: DataFrame, prizes: DataFrame | None = None, jackpot: str = JACKPOT) -> DataFrame:
    """``game_id, jackpot``: top prize at which the gross gain equals the price."""
    odds = _priced(games, prizes)
    top = F.col("label") == jackpot
    agg = odds.groupBy("game_id").agg(
        F.sum(F.when(top, F.col("p"))).alias("p_top"),
        F.sum(F.when(~top, F.col("p") * F.col("prize"))).alias("others"),
    )
    return games.join(agg, "game_id").select(
        "game_id", ((F.col("ticket_price") - F.coalesce("others", F.lit(0.0))) / F.col("p_top")).alias("jackpot")
    )


def _priced(games: DataFrame, prizes: DataFrame | None) -> DataFrame:
    odds = game_odds(games)
    if prizes is None:
        return odds
    return odds.drop("prize").join(prizes, ["game_id", "label"], "left").fillna(0.0, ["prize"])
