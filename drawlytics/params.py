"""Game shape and default parameters.

A *game* draws ``main_pick`` numbers out of ``1..main_max`` plus one bonus
("chance") number out of ``1..chance_max``.
"""

from __future__ import annotations

from dataclasses import dataclass

MAIN = "main"
CHANCE = "chance"


@dataclass(frozen=True)
class Game:
    main_max: int = 49
    main_pick: int = 5
    chance_max: int = 10
    ticket_price: float = 2.20

    def size(self, pool: str) -> int:
        return self.main_max if pool == MAIN else self.chance_max

    @property
    def radix(self) -> int:
        """Multiplier that packs ``value * radix + num`` into one long."""
        return 1 << max(self.main_max, self.chance_max).bit_length()

    @property
    def ball_cols(self) -> list[str]:
        return [f"n{i}" for i in range(1, self.main_pick + 1)]


GAME = Game()

# Winning ranks (label, short label, matches, bonus hit, prize, points).
RANKS = [
    ("5 + Chance", "5+1", 5, 1, 2_000_000.0, 100),
    ("5", "5", 5, 0, 100_000.0, 90),
    ("4 + Chance", "4+1", 4, 1, 1_000.0, 80),
    ("4", "4", 4, 0, 400.0, 70),
    ("3 + Chance", "3+1", 3, 1, 50.0, 60),
    ("3", "3", 3, 0, 20.0, 50),
    ("2 + Chance", "2+1", 2, 1, 10.0, 40),
    ("2", "2", 2, 0, 4.40, 30),
    ("1 + Chance", "1+1", 1, 1, 2.20, 20),
    ("0 + Chance", "0+1", 0, 1, 2.20, 10),
]
JACKPOT = "5 + Chance"

# Default sizes and blend weights.
ANALYSIS_WINDOW = 1335
N_HOT = 5
N_COLD = 5
CYCLE_WINDOWS = (10, 20, 50)
CYCLE_WEIGHTS = (0.5, 0.3, 0.2)
LUNAR_INFLUENCE = 0.3
FIB_BLEND = 0.3
ADAPTIVE_WEIGHTS = (0.4, 0.3, 0.3)
SCORE_A_WEIGHTS = (0.5, 0.3, 0.2)
SCORE_B_WEIGHTS = {"freq": 0.2, "gap": 0.3, "ml": 0.3, "cycle": 0.2}
SCORE_B_LUNAR_WEIGHTS = {"freq": 0.15, "gap": 0.25, "ml": 0.25, "cycle": 0.35}
ML_WINDOW = 50
LAG_WINDOW = 5
MIN_TRAIN_DRAWS = 100
DECAY = 50.0
STRATEGY_FIB = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
MIN_HISTORY = 200
MC_RUNS = 300
MC_SIMULATIONS = 5000
WHEEL_NUMBERS = 10
WHEEL_MAX = 50

# Rows per index block: a window over one block is the largest sorted group
# any history operator ever builds, whatever the length of a series.
BLOCK = 2048


def fib(n: int) -> int:
    """n-th Fibonacci number, 0 for n < 1."""
    a, b = 0, 1
    for _ in range(max(n, 0)):
        a, b = b, a + b
    return a
