"""Column expressions: dates, moon phases, prize ranks, number sets."""

from __future__ import annotations

import math

from itertools import chain

from pyspark.sql import Column, functions as F

from drawlytics.params import GAME, RANKS, Game

# French month names and their accent-less spellings.
FRENCH_MONTHS = {
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5,
    "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9,
    "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
}
# Reference new moon, mean cycle in days, phase bands.
NEW_MOON = "2000-01-06"
LUNAR_CYCLE = 29.53
MOON_BANDS = [
    (0.03, "Nouvelle lune"),
    (0.22, "Premier croissant"),
    (0.28, "Premier quartier"),
    (0.47, "Gibbeuse croissante"),
    (0.53, "Pleine lune"),
    (0.72, "Gibbeuse décroissante"),
    (0.78, "Dernier quartier"),
]
LAST_BAND = "Dernier croissant"
MOON_WRAP = 0.97
MOON_TARGETS = [
    (0.0, "Nouvelle lune"),
    (0.25, "Premier quartier"),
    (0.5, "Pleine lune"),
    (0.75, "Dernier quartier"),
]
STRONG_PHASES = ("Nouvelle lune", "Pleine lune")
PHASES = [name for _, name in MOON_BANDS] + [LAST_BAND]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _try_date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def _parts(text: Column, pattern: str, y: int, m: int, d: int) -> Column:
    def group(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    return F.when(text.rlike(pattern), _try_date(group(y), group(m), group(d)))


def parse_draw_date(c: Column | str) -> Column:
    """Text to date, null when no form fits. Tried in order: ``dd/MM/yyyy``,
    ``yyyy-MM-dd``, ``[weekday] d <French month> yyyy``, ``dd-MM-yyyy``,
    ``MM/dd/yyyy``."""
    text = F.lower(F.trim(_col(c).cast("string")))
    months = F.create_map(*[F.lit(x) for x in chain.from_iterable(FRENCH_MONTHS.items())])
    named = r"^(?:\p{L}+\s+)?(\d{1,2})\s+(\p{L}+)\s+(\d{4})$"
    month = F.try_element_at(months, F.regexp_extract(text, named, 2))
    return F.coalesce(
        _parts(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1),
        _parts(text, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3),
        F.when(
            month.isNotNull(),
            _try_date(F.regexp_extract(text, named, 3), month.cast("string"), F.regexp_extract(text, named, 1)),
        ),
        _parts(text, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 2, 1),
        _parts(text, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2),
    )


def whole_number(c: Column | str) -> Column:
    """Text to int: ``3`` and ``3.0`` give 3, anything fractional or odd null."""
    value = _col(c).try_cast("double")
    return F.when(value == F.floor(value), value.try_cast("int"))


def is_draw_day(c: Column | str) -> Column:
    """Monday, Wednesday or Saturday."""
    return F.weekday(_col(c)).isin(0, 2, 5)


def draw_day_after(c: Column | str) -> Column:
    d = _col(c)
    return F.least(F.next_day(d, "Mon"), F.next_day(d, "Wed"), F.next_day(d, "Sat"))


def moon_phase(c: Column | str, missing: float | None = 0.0) -> Column:
    """Share of the lunar cycle elapsed, 0 = new moon; a null date gives ``missing``."""
    days = F.datediff(_col(c), F.lit(NEW_MOON).cast("date")).cast("double")
    phase = F.pmod(days, F.lit(LUNAR_CYCLE)) / F.lit(LUNAR_CYCLE)
    return phase if missing is None else F.coalesce(phase, F.lit(missing))


def moon_phase_name(c: Column | str) -> Column:
    p = _col(c)
    out = F.when(p > MOON_WRAP, MOON_BANDS[0][1])
    for upper, name in MOON_BANDS:
        out = out.when(p < upper, name)
    return out.when(p.isNotNull(), LAST_BAND)


def nums_array(game: Game = GAME) -> Column:
    return F.array(*game.ball_cols)


def nums_text(c: Column | str, sep: str = "-") -> Column:
    return F.array_join(_col(c), sep)


def prize_rank(matches: Column | str, hit: Column | str, style: str = "long") -> Column:
    """Winning rank label from matches and bonus hit; null when nothing is won.
    ``style``: ``long`` gives "5 + Chance", ``short`` gives "5+1"."""
    m, h = _col(matches), _col(hit).cast("int")
    out = None
    for long, short, k, need, _, _ in RANKS:
        label = long if style == "long" else short
        cond = (m == k) & (h == need)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def rank_points(rank: Column | str) -> Column:
    """Score of a winning rank (either label style), 0 for none."""
    r = _col(rank)
    out = None
    for long, short, _, _, _, points in RANKS:
        cond = r.isin(*{long, short})
        out = F.when(cond, points) if out is None else out.when(cond, points)
    return out.otherwise(0)


def rank_prize(rank: Column | str) -> Column:
    r = _col(rank)
    out = None
    for long, short, _, _, prize, _ in RANKS:
        cond = r.isin(*{long, short})
        out = F.when(cond, F.lit(prize)) if out is None else out.when(cond, F.lit(prize))
    return out.otherwise(F.lit(0.0))


def erfc(x: Column | str) -> Column:
    """Complementary error function, to 1e-14 of the exact value.

    Below 2.5 the series ``2 x exp(-x^2) / sqrt(pi) * sum (2 x^2)^n / (1 3 .. 2n+1)``,
    whose terms are all positive; beyond, the continued fraction
    ``exp(-x^2) / sqrt(pi) / (x + 1/2 / (x + 2/2 / (x + 3/2 / ...)))``.
    """
    v = F.abs(_col(x))
    scale = F.exp(-v * v) / math.sqrt(math.pi)

    def term(a: Column, n: Column) -> Column:
        t = a["t"] * 2 * v * v / (2 * n + 1)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    start = F.struct(v.alias("t"), v.alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, term, lambda a: 1 - 2 * scale * a["s"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), v, lambda a, n: v + n / 2 / a, lambda a: scale / a)
    positive = F.when(v < 2.5, series).otherwise(fraction)
    return F.when(_col(x) < 0, 2 - positive).otherwise(positive)
