"""Plain SQL equivalents of the registered queries, for an independent engine.

Each oracle is one statement: the shared definitions of the fixture (draws,
positions, occurrences, counts) followed by the query's own definition.
"""

from __future__ import annotations

# Fixed values, written out here so that a wrong constant cannot pass on both sides:
# winning ranks (label, short label, matches, bonus hit, prize, points) and pick weights.
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
STRATEGY_FIB = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)

# ------------------------------------------------------------------ fragments
MONTHS = (
    "['janvier','février','mars','avril','mai','juin','juillet','août',"
    "'septembre','octobre','novembre','décembre']"
)


def base(series: str = "o.o_orderpriority") -> str:
    return f"""
WITH RECURSIVE fibs(r, a, b) AS (
  SELECT 0, 1.0::DOUBLE, 2.0::DOUBLE UNION ALL SELECT r + 1, b, a + b FROM fibs WHERE r < 60),
items AS (
  SELECT l_orderkey AS draw_id, CAST(l_partkey % 49 AS INT) + 1 AS num, MIN(l_linenumber) AS first_line
  FROM lineitem GROUP BY 1, 2),
ranked AS (
  SELECT draw_id, num, ROW_NUMBER() OVER (PARTITION BY draw_id ORDER BY first_line, num) AS pos FROM items),
five AS (
  SELECT draw_id,
    MAX(CASE WHEN pos=1 THEN num END) AS n1, MAX(CASE WHEN pos=2 THEN num END) AS n2,
    MAX(CASE WHEN pos=3 THEN num END) AS n3, MAX(CASE WHEN pos=4 THEN num END) AS n4,
    MAX(CASE WHEN pos=5 THEN num END) AS n5
  FROM ranked WHERE pos <= 5 GROUP BY draw_id HAVING COUNT(*) = 5),
draws AS (
  SELECT {series} AS series, f.draw_id, CAST(o.o_orderdate AS DATE) AS draw_date,
    n1, n2, n3, n4, n5, CAST(o.o_custkey % 10 AS INT) + 1 AS chance
  FROM five f JOIN orders o ON o.o_orderkey = f.draw_id),
idx AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY draw_date, draw_id) - 1 AS draw_idx FROM draws),
len AS (SELECT series, COUNT(*) AS n FROM idx GROUP BY 1),
occ AS (
  SELECT series, draw_idx, 'main' AS pool, 0 AS pos, n1 AS num FROM idx UNION ALL
  SELECT series, draw_idx, 'main', 1, n2 FROM idx UNION ALL
  SELECT series, draw_idx, 'main', 2, n3 FROM idx UNION ALL
  SELECT series, draw_idx, 'main', 3, n4 FROM idx UNION ALL
  SELECT series, draw_idx, 'main', 4, n5 FROM idx UNION ALL
  SELECT series, draw_idx, 'chance', 0, chance FROM idx),
dom AS (
  SELECT 'main' AS pool, CAST(range AS INTEGER) AS num FROM range(1, 50) UNION ALL
  SELECT 'chance', CAST(range AS INTEGER) FROM range(1, 11)),
grid AS (SELECT series, n, pool, num FROM len, dom),
st AS (
  SELECT series, pool, num, COUNT(*) AS cnt, MIN(draw_idx) AS first_idx, MAX(draw_idx) AS last_idx,
    MIN(pos * 1000000000000 + draw_idx) AS seen FROM occ GROUP BY 1, 2, 3),
freq AS (
  SELECT *, cnt / CAST(SUM(cnt) OVER (PARTITION BY series, pool) AS DOUBLE) AS rel FROM st),
invfib AS (
  SELECT series, pool, num, w / SUM(w) OVER (PARTITION BY series, pool) AS weight
  FROM (SELECT s.*, 1.0 / f.a AS w FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY series, pool ORDER BY cnt, seen) - 1 AS r FROM st) s
    JOIN fibs f ON f.r = s.r)),
pred AS (
  SELECT freq.series, freq.pool, freq.num,
    CASE WHEN freq.pool = 'main' THEN 0.7 * rel + 0.3 * weight ELSE rel END AS score
  FROM freq JOIN invfib USING (series, pool, num)),
gapcur AS (
  SELECT g.series, g.pool, g.num, COALESCE(n - 1 - last_idx, n) AS gap, last_idx IS NOT NULL AS drawn,
    COALESCE((n - 1 - first_idx) / CAST(cnt AS DOUBLE), CAST(n AS DOUBLE)) AS mean_gap
  FROM grid g LEFT JOIN st USING (series, pool, num)),
scorea AS (
  SELECT g.series, g.pool, g.num,
    0.5 * COALESCE(p.score, 0)
    + 0.3 * COALESCE(CASE WHEN c.drawn THEN c.gap END, 0)
        / NULLIF(CAST(MAX(CASE WHEN c.drawn THEN c.gap END) OVER w AS DOUBLE), 0)
    + 0.2 * COALESCE(s.cnt, 0) / CAST(MAX(s.cnt) OVER w AS DOUBLE) AS score
  FROM grid g LEFT JOIN pred p USING (series, pool, num) LEFT JOIN gapcur c USING (series, pool, num)
  LEFT JOIN st s USING (series, pool, num)
  WINDOW w AS (PARTITION BY g.series, g.pool)),
ratios AS (
  SELECT g.series, w.w, g.pool, g.num, COUNT(o.num) AS observed,
    round_even(LEAST(g.n, w.w) * CASE WHEN g.pool = 'main' THEN 5.0::DOUBLE / 49 ELSE 0.1::DOUBLE END, 2) AS expected,
    round_even(COUNT(o.num) / (LEAST(g.n, w.w) * CASE WHEN g.pool = 'main' THEN 5.0::DOUBLE / 49 ELSE 0.1::DOUBLE END), 2) AS ratio
  FROM grid g CROSS JOIN (SELECT UNNEST([10, 20, 50, 100, 2000]) AS w) w
  LEFT JOIN occ o ON o.series = g.series AND o.pool = g.pool AND o.num = g.num AND o.draw_idx >= g.n - w.w
  GROUP BY g.series, w.w, g.pool, g.num, g.n),
cycraw AS (
  SELECT series, pool, num,
    0.5 * MAX(CASE WHEN w = 10 THEN ratio END) + 0.3 * MAX(CASE WHEN w = 20 THEN ratio END)
    + 0.2 * MAX(CASE WHEN w = 50 THEN ratio END) AS v
  FROM ratios GROUP BY 1, 2, 3),
cyc AS ({minmax('cycraw')}),
phases AS (
  SELECT *, {phase_sql()} AS ph, {phase_name_sql(phase_sql())} AS phase FROM idx),
phocc AS (
  SELECT o.series, p.phase, o.pool, o.num, COUNT(*) AS cnt
  FROM occ o JOIN phases p USING (series, draw_idx) GROUP BY 1, 2, 3, 4),
lunraw AS (
  SELECT g.series, g.pool, g.num,
    COALESCE(SUM(CASE WHEN phase IN ('Nouvelle lune', 'Pleine lune') THEN 1.5 ELSE 1.0 END * cnt), 0)
      * CASE WHEN g.pool = 'main' THEN 49.0 ELSE 10.0 END / g.n AS v
  FROM grid g LEFT JOIN phocc USING (series, pool, num) GROUP BY g.series, g.pool, g.num, g.n),
lun AS ({minmax('lunraw')}),
clraw AS (
  SELECT cyc.series, cyc.pool, cyc.num, 0.7 * cyc.weight + 0.3 * lun.weight AS v
  FROM cyc JOIN lun USING (series, pool, num)),
cyclun AS ({minmax('clraw')}),
ml AS (
  SELECT series, pool, num, CASE WHEN pool = 'main' THEN (num * 37 % 49) / 49.0::DOUBLE
    ELSE (num * 7 % 10) / 10.0::DOUBLE END AS p FROM grid)
"""


def minmax(table: str) -> str:
    w = "OVER (PARTITION BY series, pool)"
    return (
        f"SELECT series, pool, num, CASE WHEN MAX(v) {w} > MIN(v) {w} "
        f"THEN (v - MIN(v) {w}) / (MAX(v) {w} - MIN(v) {w}) ELSE v END AS weight FROM {table}"
    )


def days_sql(date: str = "draw_date") -> str:
    return f"CAST(date_diff('day', DATE '2000-01-06', CAST({date} AS DATE)) AS DOUBLE)"


def phase_sql(date: str = "draw_date") -> str:
    d = days_sql(date)
    return f"(({d} - 29.53::DOUBLE * floor({d} / 29.53::DOUBLE)) / 29.53::DOUBLE)"


def phase_name_sql(p: str) -> str:
    return (
        f"CASE WHEN {p} > 0.97 OR {p} < 0.03 THEN 'Nouvelle lune' WHEN {p} < 0.22 THEN 'Premier croissant'"
        f" WHEN {p} < 0.28 THEN 'Premier quartier' WHEN {p} < 0.47 THEN 'Gibbeuse croissante'"
        f" WHEN {p} < 0.53 THEN 'Pleine lune' WHEN {p} < 0.72 THEN 'Gibbeuse décroissante'"
        f" WHEN {p} < 0.78 THEN 'Dernier quartier' ELSE 'Dernier croissant' END"
    )


def uniform(*parts: str) -> str:
    key = "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"(('0x' || substr(md5({key}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def floyd(source: str, cols: str, parts: list[str], total: int = 49, pick: int = 5) -> str:
    """Nested selects adding p1..p<pick> to ``source``."""
    out = f"SELECT {cols} FROM {source}"
    for i in range(1, pick + 1):
        j = total - pick + i
        t = f"CAST(1 + floor({uniform(*parts, str(j))} * {j}) AS INTEGER)"
        taken = " OR ".join(f"t = p{m}" for m in range(1, i)) or "FALSE"
        out = (
            f"SELECT * EXCLUDE (t), CASE WHEN {taken} THEN {j} ELSE t END AS p{i} "
            f"FROM (SELECT *, {t} AS t FROM ({out}))"
        )
    return out


def rank_case(m: str = "matches", h: str = "chance_hit", style: int = 0) -> str:
    return "CASE " + " ".join(
        f"WHEN {m} = {r[2]} AND {h} = {r[3]} THEN '{r[style]}'" for r in RANKS
    ) + " ELSE '' END"


def value_case(field: int, rank: str = "rank") -> str:
    return "CASE " + " ".join(f"WHEN {rank} IN ('{r[0]}', '{r[1]}') THEN {r[field]}" for r in RANKS) + " ELSE 0 END"


def one(sql: str, extra: str = "") -> str:
    return base("'all'") + (f", {extra}" if extra else "") + sql


def many(sql: str, extra: str = "") -> str:
    return base() + (f", {extra}" if extra else "") + sql


RANK = f"{rank_case()} AS rank"
TEXT5 = "array_to_string(list_sort([p1, p2, p3, p4, p5]), '-')"

# Dates as the text inputs write them and as they must be read back.
DIRTY = """
dirty AS (
  SELECT *, 0 AS copy FROM draws UNION ALL
  SELECT series, draw_id, CASE WHEN c = 7 THEN NULL ELSE draw_date END,
    CASE WHEN c = 1 THEN 0 ELSE n1 END, CASE WHEN c = 2 THEN 50 ELSE n2 END, CASE WHEN c = 3 THEN n2 ELSE n3 END,
    CASE WHEN c = 4 THEN NULL ELSE n4 END, n5, CASE c WHEN 5 THEN NULL WHEN 6 THEN 11 ELSE chance END, c
  FROM (SELECT *, CAST(draw_id % 7 + 1 AS INTEGER) AS c FROM draws))"""
REASON = """CASE WHEN n1 IS NULL OR n2 IS NULL OR n3 IS NULL OR n4 IS NULL OR n5 IS NULL THEN 'count'
  WHEN len(list_distinct([n1, n2, n3, n4, n5])) <> 5 THEN 'duplicate'
  WHEN LEAST(n1, n2, n3, n4, n5) < 1 OR GREATEST(n1, n2, n3, n4, n5) > 49 THEN 'number out of range'
  WHEN chance IS NOT NULL AND (chance < 1 OR chance > 10) THEN 'chance out of range'
  WHEN draw_date IS NULL THEN 'date' ELSE '' END"""
ONE_PER_DATE = """
single AS (SELECT * FROM draws QUALIFY ROW_NUMBER() OVER (PARTITION BY series, draw_date ORDER BY draw_id) = 1),
oldpart AS (SELECT * FROM single WHERE dayofyear(draw_date) % 50 <> 0 AND draw_date < DATE '2000-04-01'),
newpart AS (SELECT * FROM single WHERE dayofyear(draw_date) % 50 = 0 OR draw_date >= DATE '2000-01-01'),
missing AS (SELECT * FROM newpart n WHERE NOT EXISTS (
  SELECT 1 FROM oldpart o WHERE o.series = n.series AND o.draw_date = n.draw_date))"""
DRAW_OUT = "series, draw_id, CAST(draw_date AS VARCHAR) AS draw_date, n1, n2, n3, n4, n5, chance"
READABLE = "draw_id % 11 <> 0"

GAPS = """
app AS (SELECT DISTINCT series, pool, num, draw_idx FROM occ),
gaps AS (
  SELECT * FROM (SELECT *, draw_idx - LAG(draw_idx) OVER (PARTITION BY series, pool, num ORDER BY draw_idx) - 1 AS gap
  FROM app) WHERE gap IS NOT NULL)"""
GAP_STATS = """
SELECT g.series, g.pool, g.num, round(AVG(gap), 9) AS mean, round(quantile_cont(gap, 0.5), 9) AS median,
  MAX(gap) AS max, MIN(gap) AS min, round(stddev_pop(gap), 9) AS std, COUNT(gap) AS cnt
FROM grid g LEFT JOIN gaps USING (series, pool, num) GROUP BY 1, 2, 3"""

# State of every number before every draw.
PREFIX = """
cells AS (SELECT i.series, i.draw_idx, d.pool, d.num FROM idx i CROSS JOIN dom d),
hits AS (
  SELECT c.*, COUNT(o.num) AS hit, MIN(o.pos * 1000000000000 + o.draw_idx) AS key
  FROM cells c LEFT JOIN occ o USING (series, draw_idx, pool, num) GROUP BY 1, 2, 3, 4),
pre AS (
  SELECT *, COALESCE(SUM(hit) OVER w, 0) AS cnt, MIN(key) OVER w AS seen,
    MAX(CASE WHEN hit > 0 THEN draw_idx END) OVER w AS last,
    COALESCE(SUM(hit * exp(draw_idx / 50.0::DOUBLE)) OVER w, 0) * exp(-(draw_idx - 1) / 50.0::DOUBLE) AS decayed
  FROM hits
  WINDOW w AS (PARTITION BY series, pool, num ORDER BY draw_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
FIB_LIST = "[" + ", ".join(str(v) for v in STRATEGY_FIB) + "]"


def picks_sql(min_history: int) -> str:
    decayed = "CASE WHEN decayed > 0 THEN round(decayed / pow(10, floor(log10(decayed))), 11) * pow(10, floor(log10(decayed))) ELSE 0 END"
    return PREFIX + f""",
evalpre AS (SELECT *, {decayed} AS rec FROM pre WHERE draw_idx >= {min_history}),
ranks AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series, draw_idx, pool ORDER BY cnt DESC, num DESC) AS r_hot,
    ROW_NUMBER() OVER (PARTITION BY series, draw_idx, pool ORDER BY cnt DESC, num) AS r_hotc,
    ROW_NUMBER() OVER (PARTITION BY series, draw_idx, pool ORDER BY cnt, num) AS r_cold,
    ROW_NUMBER() OVER (PARTITION BY series, draw_idx, pool ORDER BY rec DESC, num DESC) AS r_rec,
    ROW_NUMBER() OVER (PARTITION BY series, draw_idx, pool ORDER BY rec DESC, num) AS r_recc
  FROM evalpre),
ranks2 AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series, draw_idx, pool
    ORDER BY {FIB_LIST}[(r_hot - 1) % 10 + 1] DESC, num DESC) AS r_fib FROM ranks),
learned AS (
  SELECT s.strategy, series, draw_idx,
    list_sort(list(num) FILTER (WHERE pool = 'main' AND rk <= 5)) AS nums,
    MAX(num) FILTER (WHERE pool = 'chance' AND rkc = 1) AS chance
  FROM (
    SELECT series, draw_idx, pool, num, UNNEST([
      {{'strategy': 'hot', 'rk': r_hot, 'rkc': r_hotc}}, {{'strategy': 'cold', 'rk': r_cold, 'rkc': r_cold}},
      {{'strategy': 'fibonacci', 'rk': r_fib, 'rkc': r_hotc}}, {{'strategy': 'recency', 'rk': r_rec, 'rkc': r_recc}}]) AS s
    FROM ranks2) t, LATERAL (SELECT t.s.strategy AS strategy, t.s.rk AS rk, t.s.rkc AS rkc) s
  GROUP BY 1, 2, 3),
rnd AS ({floyd('idx', 'series, draw_idx', ['12345', "'pick'", 'series', 'draw_idx'])}),
picked AS (
  SELECT strategy, series, draw_idx, nums, chance FROM learned UNION ALL
  SELECT 'random', series, draw_idx, list_sort([p1, p2, p3, p4, p5]),
    CAST(1 + floor({uniform('12345', "'pick'", 'series', 'draw_idx', "'chance'")} * 10) AS INTEGER)
  FROM rnd WHERE draw_idx >= {min_history}),
wf AS (
  SELECT p.series, p.strategy, p.draw_idx, CAST(len(list_intersect(p.nums, [n1, n2, n3, n4, n5])) AS INTEGER) AS matches,
    CAST(p.chance = i.chance AS INTEGER) AS chance_hit
  FROM picked p JOIN idx i USING (series, draw_idx))"""


ERFC = (
    "(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: "
    "pow(-1, k) * exp((2 * k + 1) * ln(greatest({x}, 1e-300)) - lgamma(k + 1)) / (2 * k + 1))))"
)
NULL_MEAN = "(25.0::DOUBLE / 49)"
NULL_VAR = "(5 * (5.0::DOUBLE / 49) * (44.0::DOUBLE / 49) * (44.0::DOUBLE / 48))"

TICKETS = f"""
tick AS (
  SELECT c_custkey AS ticket_id, CAST(c_custkey % 10 + 1 AS INTEGER) AS chance, [p1, p2, p3, p4, p5] AS nums
  FROM ({floyd('customer', 'c_custkey', ["'ticket'", 'c_custkey'])})),
settled AS (
  SELECT t.ticket_id, CAST(len(list_intersect(t.nums, [n1, n2, n3, n4, n5])) AS INTEGER) AS matches,
    CAST(t.chance = i.chance AS INTEGER) AS chance_hit
  FROM tick t JOIN len l ON TRUE JOIN idx i ON i.draw_idx = t.ticket_id % l.n)"""


def tracked(hit: str) -> str:
    return f"""
SELECT series, combo_id, round(AVG(avg_m), 9) AS avg_matches, rank, COUNT(*) AS cnt FROM (
  SELECT series, combo_id, AVG(matches) OVER (PARTITION BY combo_id) AS avg_m, {rank_case(style=1)} AS rank FROM (
    SELECT i.series, t.ticket_id AS combo_id, {hit} AS chance_hit,
      CAST(n1 IN (t.nums[1], t.nums[2], t.nums[3], t.nums[4], t.nums[5]) AS INTEGER)
      + CAST(n2 IN (t.nums[1], t.nums[2], t.nums[3], t.nums[4], t.nums[5]) AS INTEGER)
      + CAST(n3 IN (t.nums[1], t.nums[2], t.nums[3], t.nums[4], t.nums[5]) AS INTEGER)
      + CAST(n4 IN (t.nums[1], t.nums[2], t.nums[3], t.nums[4], t.nums[5]) AS INTEGER)
      + CAST(n5 IN (t.nums[1], t.nums[2], t.nums[3], t.nums[4], t.nums[5]) AS INTEGER) AS matches
    FROM tick t CROSS JOIN idx i))
GROUP BY 1, 2, 4"""


GAMES = """
WITH games AS (
  SELECT p_partkey AS game_id, CAST(p_size + 30 AS INTEGER) AS n, 5 AS m, CAST(p_partkey % 12 + 2 AS INTEGER) AS c,
    round(p_retailprice / 1000, 2) AS price FROM part),
ch AS (SELECT *, n / 1.0::DOUBLE * (n - 1) * (n - 2) * (n - 3) * (n - 4) / 120 AS total FROM games),
ks AS (SELECT game_id, n, m, c, price, total, k, [1, 5, 10, 10, 5, 1][k + 1] * (CASE 5 - k
    WHEN 0 THEN 1 WHEN 1 THEN n - 5 WHEN 2 THEN (n - 5) * (n - 6) / 2.0
    WHEN 3 THEN (n - 5) * (n - 6) * (n - 7) / 6.0 WHEN 4 THEN (n - 5) * (n - 6) * (n - 7) * CAST(n - 8 AS DOUBLE) / 24
    ELSE CAST(n - 5 AS DOUBLE) * (n - 6) * (n - 7) * (n - 8) * (n - 9) / 120 END)::DOUBLE / total AS p
  FROM ch, (SELECT CAST(range AS INTEGER) AS k FROM range(0, 6))),
rk AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{r[0]}', {r[2]}, {r[3]}, {r[4]}::DOUBLE)" for r in RANKS
) + """) AS t(label, k, need, prize)),
odds AS (
  SELECT ks.game_id, label, prize, price, ks.p * CASE WHEN need = 1 THEN 1.0::DOUBLE / c ELSE 1 - 1.0::DOUBLE / c END AS p
  FROM ks JOIN rk USING (k))
"""


#: Candidates of a cover: id and numbers in ascending order.
ALL_DRAWS = "SELECT series, draw_idx AS id, list_sort([n1, n2, n3, n4, n5]) AS nums FROM idx"
MIXED = "SELECT series, combo_id AS id, list_transform(string_split(nums, '-'), lambda x: CAST(x AS INTEGER)) AS nums FROM kept WHERE combo_id <= 20"


def cover_rounds(candidates: str = ALL_DRAWS, n: int = 10) -> str:
    out = [
        f"cands AS ({candidates})",
        "pool AS (SELECT series, id, list_reduce(list_transform(nums, lambda x: 1::BIGINT << (x - 1)), lambda a, b: a | b) AS mask FROM cands)",
        "s1 AS (SELECT series, [MIN(id)] AS chosen, arg_min(mask, id) AS covered FROM pool GROUP BY 1)",
    ]
    for i in range(2, n + 1):
        out.append(
            f"s{i} AS MATERIALIZED (SELECT series, list_append(chosen, id) AS chosen, covered | mask AS covered FROM ("
            f"SELECT s.*, p.id, p.mask, ROW_NUMBER() OVER (PARTITION BY s.series ORDER BY"
            f" bit_count(p.mask & ~s.covered) DESC, p.id) AS rn FROM s{i - 1} s JOIN pool p ON p.series = s.series"
            f" AND NOT list_contains(s.chosen, p.id)) WHERE rn = 1)"
        )
    out.append(
        f"cover AS (SELECT c.series, c.ord, c.id AS combo_id, nums FROM ("
        f"SELECT series, UNNEST(chosen) AS id, generate_subscripts(chosen, 1) AS ord FROM s{n}) c JOIN cands USING (series, id))"
    )
    return ", ".join(out)


MICRO = "string_agg(CAST(CAST(round(v * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY f) AS features"
TRAIL = """
mcells AS (SELECT i.series, i.draw_idx, d.num FROM idx i CROSS JOIN dom d WHERE d.pool = 'main'),
mhits AS (
  SELECT c.*, CAST(i.n1 = num OR i.n2 = num OR i.n3 = num OR i.n4 = num OR i.n5 = num AS INTEGER) AS hit
  FROM mcells c JOIN idx i USING (series, draw_idx)),
trail AS (
  SELECT series, draw_idx, num, SUM(hit) OVER (PARTITION BY series, num ORDER BY draw_idx
    ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS c, LEAST(draw_idx + 1, 50) AS rows_n FROM mhits),
agg AS (
  SELECT series, draw_idx, SUM(c * num) / CAST(SUM(c) AS DOUBLE) AS mean, SUM(c * num * num) / CAST(SUM(c) AS DOUBLE) AS sq,
    SUM(c * (num % 2)) / CAST(SUM(c) AS DOUBLE) AS odd FROM trail GROUP BY 1, 2),
feats AS (
  SELECT series, draw_idx, num AS f, c / CAST(rows_n AS DOUBLE) AS v FROM trail UNION ALL
  SELECT series, draw_idx, 50, mean / 49 FROM agg UNION ALL
  SELECT series, draw_idx, 51, sqrt(GREATEST(sq - mean * mean, 0)) / 49 FROM agg UNION ALL
  SELECT series, draw_idx, 52, odd FROM agg)"""


def when_feats(source: str, date: str) -> str:
    parts = [f"isodow({date}) - 1", f"month({date})", f"day({date})", f"weekofyear({date})"]
    return " UNION ALL ".join(
        f"SELECT series, draw_idx, {53 + i} AS f, CAST({p} AS DOUBLE) AS v FROM {source}" for i, p in enumerate(parts)
    )


Y_NUMS = "array_to_string(list_transform(range(1, 50), lambda x: CAST(x IN (n1, n2, n3, n4, n5) AS INTEGER)), '') AS y_nums"
Y_CHANCE = "array_to_string(list_transform(range(1, 11), lambda x: CAST(x = chance AS INTEGER)), '') AS y_chance"
NEXT_DAY = (
    "CAST(d + CASE isodow(d) WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 1"
    " WHEN 6 THEN 2 ELSE 1 END * INTERVAL 1 DAY AS DATE)"
)
OPT = """
opt AS (
  SELECT g.series, g.pool, g.num, 0.35 * ml.p + 0.25 * COALESCE(f.weight, 0) + 0.25 * c.weight + 0.15 * COALESCE(q.rel, 0) AS score
  FROM grid g JOIN ml USING (series, pool, num) LEFT JOIN invfib f USING (series, pool, num)
  JOIN cyc c USING (series, pool, num) LEFT JOIN freq q USING (series, pool, num)),
optr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series, pool ORDER BY round(score, 12) DESC, num) AS rnk FROM opt)"""
AR = """
ar AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series, pool ORDER BY round(score, 12) DESC, num) AS rnk FROM scorea)"""


def monte_carlo(sims: int = 5000) -> str:
    clock = "-ln({u}) / s.score"
    row = "('0x' || substr(md5(concat_ws('|', '42', '{p}', s.series)), 1, 7))::BIGINT"
    um, uc = (f"(({keyed('sim', 's.num', row.format(p=p))} + 0.5::DOUBLE) / 2147483647)" for p in ("main", "chance"))
    return f"""
sims AS (SELECT CAST(range AS INTEGER) AS sim FROM range(0, {sims})),
clocks AS (
  SELECT s.series, sim, s.pool, s.num, CASE WHEN s.pool = 'main' THEN {clock.format(u=um)} ELSE {clock.format(u=uc)} END AS t
  FROM scorea s CROSS JOIN sims WHERE s.score > 0),
won AS (SELECT * FROM clocks QUALIFY ROW_NUMBER() OVER (PARTITION BY series, sim, pool ORDER BY t, num)
  <= CASE WHEN pool = 'main' THEN 5 ELSE 1 END),
sampled AS (
  SELECT series, sim, string_agg(CAST(num AS VARCHAR), '-' ORDER BY num) FILTER (WHERE pool = 'main') AS nums,
    MAX(num) FILTER (WHERE pool = 'chance') AS chance FROM won GROUP BY 1, 2),
topc AS (SELECT series, nums, COUNT(*) AS cnt, ROW_NUMBER() OVER (PARTITION BY series ORDER BY COUNT(*) DESC, MIN(sim)) AS combo_id
  FROM sampled GROUP BY 1, 2),
topx AS (SELECT series, chance, ROW_NUMBER() OVER (PARTITION BY series ORDER BY COUNT(*) DESC, MIN(sim)) AS combo_id
  FROM sampled GROUP BY 1, 2),
mc AS (SELECT c.series, CAST(c.combo_id AS INTEGER) AS combo_id, c.nums, COALESCE(x.chance, 0) AS chance,
  'monte carlo' AS method, c.cnt FROM topc c LEFT JOIN topx x USING (series, combo_id) WHERE c.combo_id <= 5)"""


def mixed(n: int = 9) -> str:
    half = n // 2 + 1
    fl = floyd("tries", "series, ord, main", ["42", "'top'", "series", "ord"], 10, 5)
    u = uniform("42", "'weighted'", "s.series", "o.ord", "s.num")
    return AR + f""",
arr AS (
  SELECT series, list(num ORDER BY rnk) FILTER (WHERE pool = 'main') AS main,
    list(num ORDER BY rnk) FILTER (WHERE pool = 'chance') AS extra FROM ar GROUP BY 1),
tries AS (SELECT arr.*, CAST(range AS INTEGER) AS ord FROM arr, range(0, {half})),
uni AS (SELECT series, ord, array_to_string(list_sort([main[p1], main[p2], main[p3], main[p4], main[p5]]), '-') AS nums FROM ({fl})),
wcl AS (SELECT s.series, o.ord, s.num, -ln(GREATEST({u}, 1e-300)) / s.score AS t
  FROM scorea s, (SELECT CAST(range AS INTEGER) AS ord FROM range({half}, {2 * half})) o WHERE s.pool = 'main' AND s.score > 0),
wei AS (SELECT series, ord, string_agg(CAST(num AS VARCHAR), '-' ORDER BY num) AS nums FROM (
  SELECT * FROM wcl QUALIFY ROW_NUMBER() OVER (PARTITION BY series, ord ORDER BY t, num) <= 5) GROUP BY 1, 2),
dis AS (SELECT series, nums, MIN(ord) AS ord FROM (SELECT * FROM uni UNION ALL SELECT * FROM wei) GROUP BY 1, 2),
kept AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY series ORDER BY ord) AS INTEGER) AS combo_id FROM dis)"""


BACKTEST = PREFIX + """,
btr AS (
  SELECT *, CASE WHEN cnt > 0 THEN ROW_NUMBER() OVER (PARTITION BY series, draw_idx, pool
      ORDER BY CASE WHEN cnt > 0 THEN 0 ELSE 1 END, cnt, seen) - 1 END AS r
  FROM pre WHERE draw_idx >= 100),
btw AS (SELECT b.*, CASE WHEN cnt > 0 THEN 1.0 / f.a END AS w FROM btr b LEFT JOIN fibs f ON f.r = b.r),
bts AS (
  SELECT *, 0.5 * CASE WHEN cnt = 0 THEN 0 WHEN pool = 'main' THEN 0.7 * cnt / CAST(SUM(cnt) OVER w AS DOUBLE) + 0.3 * w / SUM(w) OVER w
      ELSE cnt / CAST(SUM(cnt) OVER w AS DOUBLE) END
    + COALESCE(0.3 * CASE WHEN cnt > 0 THEN draw_idx - 1 - last ELSE 0 END
        / CAST(NULLIF(MAX(CASE WHEN cnt > 0 THEN draw_idx - 1 - last ELSE 0 END) OVER w, 0) AS DOUBLE), 0)
    + 0.2 * cnt / CAST(MAX(cnt) OVER w AS DOUBLE) AS score
  FROM btw WINDOW w AS (PARTITION BY series, draw_idx, pool)),
btk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series, draw_idx, pool ORDER BY round(score, 12) DESC, num) AS rk FROM bts),
btp AS (
  SELECT series, draw_idx, list_sort(list(num) FILTER (WHERE pool = 'main' AND rk <= 5)) AS nums,
    MAX(num) FILTER (WHERE pool = 'chance' AND rk = 1) AS chance FROM btk GROUP BY 1, 2),
bt AS (
  SELECT p.series, p.draw_idx, p.nums, p.chance, CAST(len(list_intersect(p.nums, [n1, n2, n3, n4, n5])) AS INTEGER) AS matches,
    CAST(p.chance = i.chance AS INTEGER) AS chance_hit FROM btp p JOIN idx i USING (series, draw_idx))"""


def number_out(table: str, col: str, digits: int = 9) -> str:
    return f" SELECT series, pool, num, round({col}, {digits}) AS {col} FROM {table}"


def score_b_sql(freq_w: float, gap_w: float, ml_w: float, cyc_w: float, cycle: str) -> str:
    return f"""
sb AS (
  SELECT g.series, g.pool, g.num, {freq_w} * COALESCE(s.cnt, 0) / CAST(MAX(s.cnt) OVER w AS DOUBLE)
    + {gap_w} * c.mean_gap / MAX(c.mean_gap) OVER w + {ml_w} * ml.p + {cyc_w} * y.weight AS score, f.weight AS fib
  FROM grid g LEFT JOIN st s USING (series, pool, num) JOIN gapcur c USING (series, pool, num)
  JOIN ml USING (series, pool, num) JOIN {cycle} y USING (series, pool, num) LEFT JOIN invfib f USING (series, pool, num)
  WINDOW w AS (PARTITION BY g.series, g.pool))"""


def blend_sql(table: str, ml_w: float, w: float) -> str:
    return (
        f" SELECT g.series, g.pool, g.num, round({ml_w} * ml.p + {w} * COALESCE(x.weight, 0), 9) AS score FROM grid g"
        f" JOIN ml USING (series, pool, num) LEFT JOIN {table} x USING (series, pool, num)"
    )


# A forest of 20 trees of depth 5, grown and walked level by level. Bounds of the
# row uses (Poisson with mean 1, of 2147483647), tries (whole root of 56 features), least rows of a child.
USES = (790015083, 1580030167, 1975037709, 2106706890, 2139624185, 2146207644, 2147304887, 2147461637, 2147481230)
TREES, DEPTH, TRIES, LEAST = 20, 5, 7, 2


def keyed(a: str, b: str, c: str) -> str:
    start = f"(48271 * ({a})::BIGINT + 69621 * ({b})::BIGINT + 16807 * ({c})::BIGINT + 12345) % 2147483647"
    return f"list_reduce([{start}, 0, 0, 0], lambda h, x: (h * h + 1013904223) % 2147483647)"


def train_sql(cond: str) -> str:
    """Training rows (keys, coded features, cuts); ``cond`` on idx i and the share position pos."""
    return f"""
allf AS (SELECT f.series, f.draw_idx + 1 AS draw_idx, f.f, f.v FROM feats f UNION ALL {when_feats('idx', 'draw_date')}),
tpos AS (SELECT series, draw_idx, draw_idx < 50 + floor((n - 50) * 0.8::DOUBLE) AS older FROM idx JOIN len USING (series) WHERE draw_idx >= 50),
tkeys AS MATERIALIZED (SELECT series, draw_idx, ('0x' || substr(md5(concat_ws('|', series, draw_idx)), 1, 7))::BIGINT AS row_key FROM tpos WHERE {cond}),
xv AS MATERIALIZED (SELECT a.series, a.draw_idx, f - 1 AS f, CAST(round(v * 1e6) AS BIGINT) AS v FROM allf a JOIN tpos USING (series, draw_idx)),
tx AS (SELECT xv.* FROM xv JOIN tkeys USING (series, draw_idx)),
fvals AS (SELECT f, v, n, SUM(n) OVER (PARTITION BY f ORDER BY v) AS upto, SUM(n) OVER (PARTITION BY f) AS total FROM (
  SELECT f, v, COUNT(*) AS n FROM tx GROUP BY 1, 2)),
cuts AS MATERIALIZED (SELECT f, v, ROW_NUMBER() OVER (PARTITION BY f ORDER BY v) - 1 AS code FROM fvals
  WHERE upto < total AND upto * 32 // total > (upto - n) * 32 // total),
codes AS MATERIALIZED (SELECT t.series, t.draw_idx, t.f, COUNT(c.v) AS code FROM tx t LEFT JOIN cuts c ON c.f = t.f AND c.v < t.v GROUP BY 1, 2, 3),
trees AS (SELECT range AS tree FROM range({TREES}))"""


def forest_sql(pool: str) -> str:
    """The forest of a pool: its splits per level and its leaves."""
    s = 2 * (2 * 42 + (pool == "chance"))
    x = "f" + pool[0]
    weight = " + ".join(f"(k >= {b})::BIGINT" for b in USES)
    out = [f"""
{x}hits AS MATERIALIZED (SELECT o.series, o.draw_idx, num - 1 AS label FROM occ o JOIN tkeys USING (series, draw_idx) WHERE pool = '{pool}'),
{x}a0 AS MATERIALIZED (SELECT * FROM (SELECT tree, series, draw_idx, 1::BIGINT AS node, {weight} AS w FROM (
  SELECT *, {keyed('row_key', 'tree', str(s))} AS k FROM tkeys, trees)) WHERE w > 0)"""]
    for d in range(DEPTH + 1):
        out.append(f"""
{x}n{d} AS MATERIALIZED (SELECT tree, node, SUM(w) AS n FROM {x}a{d} GROUP BY 1, 2),
{x}l{d} AS MATERIALIZED (SELECT tree, node, label, SUM(w) AS c FROM {x}a{d} JOIN {x}hits USING (series, draw_idx) GROUP BY 1, 2, 3)""")
        if d == DEPTH:
            break
        out.append(f"""
{x}o{d} AS MATERIALIZED (SELECT n.tree, n.node, n.n FROM {x}n{d} n JOIN (SELECT tree, node, SUM(c * c) AS sq, SUM(c) AS sc FROM {x}l{d} GROUP BY 1, 2)
  USING (tree, node) WHERE n.n >= {2 * LEAST} AND sq <> n.n * sc),
{x}t{d} AS MATERIALIZED (SELECT tree, node, n, f FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tree, node ORDER BY k, f) AS r FROM (
  SELECT o.*, range AS f, {keyed('range', 'node', f'1009 * tree + {s + 1}')} AS k FROM {x}o{d} o, range(56))) WHERE r <= {TRIES}),
{x}r{d} AS MATERIALIZED (SELECT a.tree, a.node, t.f, t.n, c.code, a.series, a.draw_idx, a.w FROM {x}a{d} a JOIN {x}t{d} t USING (tree, node)
  JOIN codes c ON c.series = a.series AND c.draw_idx = a.draw_idx AND c.f = t.f),
{x}c{d} AS MATERIALIZED (SELECT tree, node, f, code, n, SUM(SUM(w)) OVER (PARTITION BY tree, node, f ORDER BY code) AS nl FROM {x}r{d} GROUP BY 1, 2, 3, 4, 5),
{x}h{d} AS MATERIALIZED (SELECT tree, node, f, code, label, SUM(w) AS c FROM {x}r{d} JOIN {x}hits USING (series, draw_idx) GROUP BY 1, 2, 3, 4, 5),
{x}g{d} AS (SELECT tree, node, f, code, any_value(n) AS n, any_value(nl) AS nl, SUM(lc * lc) AS sl, SUM((tot - lc) * (tot - lc)) AS sr FROM (
  SELECT q.tree, q.node, q.f, q.code, q.n, q.nl, l.c AS tot,
    SUM(COALESCE(h.c, 0)) OVER (PARTITION BY q.tree, q.node, q.f, l.label ORDER BY q.code) AS lc
  FROM {x}c{d} q JOIN {x}l{d} l ON l.tree = q.tree AND l.node = q.node
  LEFT JOIN {x}h{d} h ON h.tree = q.tree AND h.node = q.node AND h.f = q.f AND h.code = q.code AND h.label = l.label) GROUP BY 1, 2, 3, 4),
{x}s{d} AS MATERIALIZED (SELECT b.tree, b.node, b.f, b.code, c.v AS cut FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY tree, node ORDER BY sl::DOUBLE / nl::DOUBLE + sr::DOUBLE / (n - nl)::DOUBLE DESC, f, code) AS r
  FROM {x}g{d} WHERE nl >= {LEAST} AND n - nl >= {LEAST}) b JOIN cuts c ON c.f = b.f AND c.code = b.code WHERE r = 1),
{x}a{d + 1} AS MATERIALIZED (SELECT a.tree, a.series, a.draw_idx, 2 * a.node + (c.code > s.code)::BIGINT AS node, a.w FROM {x}a{d} a JOIN {x}s{d} s USING (tree, node)
  JOIN codes c ON c.series = a.series AND c.draw_idx = a.draw_idx AND c.f = s.f)""")
    ends = " UNION ALL ".join(
        f"SELECT l.tree, l.node, l.label, l.c::DOUBLE / n.n::DOUBLE AS share FROM {x}l{d} l JOIN {x}n{d} n USING (tree, node)"
        + (f" ANTI JOIN {x}s{d} s USING (tree, node)" if d < DEPTH else "")
        for d in range(DEPTH + 1)
    )
    return ",".join(out) + f", {x}ends AS MATERIALIZED ({ends})"


def walked_sql(pool: str, rows: str) -> str:
    """(series, draw_idx, num, p) of a pool for ``rows`` (series, draw_idx, f, v)."""
    x = "f" + pool[0]
    out = [f"{x}p0 AS (SELECT DISTINCT tree, series, draw_idx, 1::BIGINT AS node FROM {rows}, trees)"]
    for d in range(DEPTH):
        out.append(f"""
{x}p{d + 1} AS MATERIALIZED (SELECT p.tree, p.series, p.draw_idx, CASE WHEN s.f IS NULL THEN p.node ELSE 2 * p.node + (q.v > s.cut)::BIGINT END AS node
  FROM {x}p{d} p LEFT JOIN {x}s{d} s USING (tree, node) LEFT JOIN {rows} q ON q.series = p.series AND q.draw_idx = p.draw_idx AND q.f = s.f)""")
    return ",".join(out) + f""",
{x}prob AS MATERIALIZED (SELECT k.series, k.draw_idx, d.num, round(COALESCE(x.p, 0.0::DOUBLE), 12) AS p
  FROM (SELECT DISTINCT series, draw_idx FROM {rows}) k CROSS JOIN dom d LEFT JOIN (
    SELECT series, draw_idx, label, SUM(share) / {TREES} AS p FROM {x}p{DEPTH} JOIN {x}ends USING (tree, node) GROUP BY 1, 2, 3) x
  ON x.series = k.series AND x.draw_idx = k.draw_idx AND x.label = d.num - 1 WHERE d.pool = '{pool}')"""


def served_sql() -> str:
    """mlp (series, pool, num, p): forests on all rows, walked by the features of the next draw."""
    return TRAIL + f""", {train_sql('true')}, {forest_sql('main')}, {forest_sql('chance')},
upcoming AS (SELECT series, CAST(n AS BIGINT) AS draw_idx, {NEXT_DAY} AS nd FROM (
  SELECT series, COUNT(*) AS n, MAX(draw_date) AS d FROM idx GROUP BY 1)),
sx AS MATERIALIZED (SELECT series, draw_idx, f - 1 AS f, CAST(round(v * 1e6) AS BIGINT) AS v FROM (
  SELECT f.series, f.draw_idx + 1 AS draw_idx, f.f, f.v FROM feats f JOIN len l ON l.series = f.series AND l.n = f.draw_idx + 1
  UNION ALL {when_feats('upcoming', 'nd')})),
{walked_sql('main', 'sx')}, {walked_sql('chance', 'sx')},
mlp AS (SELECT series, 'main' AS pool, num, p FROM fmprob UNION ALL SELECT series, 'chance', num, p FROM fcprob)"""


def fitted(text: str) -> str:
    """A statement on the stand-in probabilities, on fitted ones."""
    return text.replace("JOIN ml ", "JOIN mlp ").replace("ml.p", "mlp.p")


EVAL = """
cell AS MATERIALIZED (SELECT p.series, p.draw_idx, p.num, p.p, CAST(p.num IN (i.n1, i.n2, i.n3, i.n4, i.n5) AS BIGINT) AS y,
  CAST(p.p >= 0.5 AS BIGINT) AS said, CAST(floor(p.p * 1000 + 0.5) AS BIGINT) AS bin,
  ROW_NUMBER() OVER (PARTITION BY p.series, p.draw_idx ORDER BY p.p DESC, p.num) AS place FROM fmprob p JOIN idx i USING (series, draw_idx)),
erow AS (SELECT series, draw_idx, MIN(CAST(said = y AS BIGINT)) AS exact, SUM(said * y) AS tp, SUM(said) AS sn, SUM(y) AS tn,
  SUM(y) FILTER (WHERE place <= 5) AS hits FROM cell GROUP BY 1, 2),
cbest AS (SELECT series, draw_idx, CAST(num = chance AS BIGINT) AS ok FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series, draw_idx ORDER BY p DESC, num) AS place FROM fcprob) JOIN idx USING (series, draw_idx) WHERE place = 1),
lab AS (SELECT num, bin, SUM(y) AS pos, SUM(1 - y) AS neg FROM cell GROUP BY 1, 2),
wins AS (SELECT num, SUM(pos * (b + neg / 2.0::DOUBLE)) / NULLIF(SUM(pos)::DOUBLE * SUM(neg)::DOUBLE, 0) AS auc FROM (
  SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY num ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM lab) GROUP BY 1),
pool_bins AS (SELECT bin, SUM(pos) AS pos, SUM(pos + neg) AS n, GREATEST(0.5::DOUBLE, LEAST(999.5::DOUBLE, bin::DOUBLE)) / 1000 AS q FROM lab GROUP BY 1),
f1s AS (SELECT bin, round(2 * SUM(pos) OVER w / (SUM(n) OVER w + SUM(pos) OVER ())::DOUBLE, 12) AS f1 FROM pool_bins WINDOW w AS (ORDER BY bin DESC))"""


COMBO_CHANCE = "0 AS chance"


# ------------------------------------------------------------------ statements
def sql() -> dict[str, str]:
    out: dict[str, str] = {}

    # ingest
    out["read_draws_csv"] = many(f"""
SELECT series, CAST(draw_date AS VARCHAR) AS draw_date, n1, n2, n3, n4, n5,
  CASE WHEN draw_id % 19 = 0 THEN 0 ELSE chance END AS chance
FROM draws WHERE {READABLE} AND draw_id % 17 <> 0""")
    out["discover_ball_cols"] = many("""
SELECT COUNT(n1) AS n_1, COUNT(n2) AS n_2, COUNT(n3) AS n_3,
  COUNT(CASE WHEN draw_id % 17 <> 0 THEN n4 END) AS n_4, COUNT(n5) AS n_5 FROM draws""")
    out["parse_draw_date"] = many(f"""
SELECT draw_id, CASE WHEN {READABLE} THEN CAST(draw_date AS VARCHAR) ELSE '' END AS parsed FROM draws""")
    out["valid_draws"] = many("""
SELECT draw_id, copy, n1, n2, n3, n4, n5, chance FROM dirty WHERE copy NOT IN (1, 2, 4, 5, 6)""", DIRTY)
    out["validate_draws"] = many(f"""
SELECT draw_id, copy, CAST(({REASON}) = '' AS INTEGER) AS is_valid, {REASON} AS reason FROM dirty""", DIRTY)
    out["dedupe_draws"] = many(f" SELECT {DRAW_OUT} FROM single", ONE_PER_DATE)
    out["draw_index"] = many(" SELECT series, draw_id, draw_idx FROM idx")
    out["merge_new_draws"] = many(
        f" SELECT {DRAW_OUT} FROM (SELECT * FROM oldpart UNION ALL SELECT * FROM missing)", ONE_PER_DATE
    )
    out["missing_draws"] = many(
        " SELECT series, draw_id, CAST(draw_date AS VARCHAR) AS draw_date FROM missing", ONE_PER_DATE
    )
    out["extract_draw_rows"] = many(f"""
SELECT draw_id // 32 AS page_id, CAST(row_no AS INTEGER) AS row_no, 'lundi' AS weekday_label,
  CASE WHEN {READABLE} THEN CAST(draw_date AS VARCHAR) ELSE '' END AS draw_date, n1, n2, n3, n4, n5,
  CASE WHEN draw_id % 29 = 0 THEN 0 ELSE chance END AS chance
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY draw_id // 32 ORDER BY draw_id) - 1 AS row_no FROM draws)
WHERE draw_id % 31 <> 0 AND draw_id % 23 <> 0""")
    out["next_draw_date"] = many(f"""
SELECT series, CAST({NEXT_DAY} AS VARCHAR) AS next_date FROM (SELECT series, MAX(draw_date) AS d FROM draws GROUP BY 1)""")
    out["is_draw_day"] = many(" SELECT draw_id, CAST(isodow(draw_date) IN (1, 3, 6) AS INTEGER) AS draw_day FROM draws")
    out["write_history"] = many(f" SELECT {DRAW_OUT} FROM draws")
    out["append_submitted_draws"] = many(f"""
SELECT series, CAST(draw_date AS VARCHAR) AS draw_date, 0 AS submitted FROM oldpart UNION ALL
SELECT series, CAST(draw_date AS VARCHAR), 1 FROM missing WHERE {READABLE}""", ONE_PER_DATE)

    # frequencies
    out["number_freq"] = many(" SELECT series, pool, num, cnt, round(rel, 9) AS rel FROM freq")
    out["number_freq_filled"] = many(
        " SELECT g.series, g.n AS n_draws, g.pool, g.num, COALESCE(cnt, 0) AS cnt FROM grid g LEFT JOIN st USING (series, pool, num)"
    )
    window = """
wst AS (SELECT o.series, o.pool, o.num, COUNT(*) AS cnt, MIN(pos * 1000000000000 + draw_idx) AS seen
  FROM occ o JOIN len l ON l.series = o.series AND o.draw_idx >= l.n - {w} GROUP BY 1, 2, 3)"""
    windowed = (
        " SELECT series, pool, num, cnt, round(cnt / CAST(SUM(cnt) OVER (PARTITION BY series, pool) AS DOUBLE), 9) AS rel FROM wst"
    )
    out["window_freq"] = many(windowed, window.format(w=300))
    hot = """
hc AS (
  SELECT series, pool, 'hot' AS kind, ROW_NUMBER() OVER (PARTITION BY series, pool ORDER BY cnt DESC, seen) AS rnk, num, cnt FROM wst
  UNION ALL
  SELECT series, pool, 'cold', ROW_NUMBER() OVER (PARTITION BY series, pool ORDER BY cnt, seen DESC), num, cnt FROM wst)"""
    out["hot_cold"] = many(
        " SELECT series, pool, kind, CAST(rnk AS INTEGER) AS rnk, num, cnt FROM hc WHERE rnk <= 5",
        window.format(w=1335) + "," + hot,
    )
    out["top_freq"] = many("""
SELECT series, pool, CAST(rnk AS INTEGER) AS rnk, num, cnt FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY series, pool ORDER BY cnt DESC, seen) AS rnk FROM st) WHERE rnk <= 10""")
    out["number_report"] = many("""
SELECT g.series, g.num, COALESCE(s.cnt, 0) AS cnt, round(a.score, 9) AS score, c.gap,
  CASE WHEN EXISTS (SELECT 1 FROM hc h WHERE h.series = g.series AND h.pool = 'main' AND h.num = g.num AND kind = 'hot' AND rnk <= 5) THEN 'Chaud'
    WHEN EXISTS (SELECT 1 FROM hc h WHERE h.series = g.series AND h.pool = 'main' AND h.num = g.num AND kind = 'cold' AND rnk <= 5) THEN 'Froid'
    ELSE '' END AS status
FROM grid g LEFT JOIN st s USING (series, pool, num) JOIN scorea a USING (series, pool, num)
JOIN gapcur c USING (series, pool, num) WHERE g.pool = 'main'""", window.format(w=1335) + "," + hot)

    # patterns
    out["parity_dist"] = many("""
SELECT series, CAST(e AS VARCHAR) || 'E-' || CAST(5 - e AS VARCHAR) || 'O' AS pattern, COUNT(*) AS cnt,
  round(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY series), 9) AS pct
FROM (SELECT series, CAST(n1 % 2 = 0 AS INT) + CAST(n2 % 2 = 0 AS INT) + CAST(n3 % 2 = 0 AS INT)
  + CAST(n4 % 2 = 0 AS INT) + CAST(n5 % 2 = 0 AS INT) AS e FROM draws) GROUP BY series, e""")
    sums = "sums AS (SELECT series, draw_idx, n1 + n2 + n3 + n4 + n5 AS total FROM idx)"
    out["sum_stats"] = many("""
SELECT series, round(AVG(total), 9) AS mean, round(quantile_cont(total, 0.5), 9) AS median, MIN(total) AS min, MAX(total) AS max,
  round(stddev_samp(total), 9) AS std FROM sums GROUP BY 1""", sums)
    out["sum_ranges"] = many("""
SELECT series, bucket, CAST(lo + bucket * width AS VARCHAR) || '-' ||
  CAST(CASE WHEN bucket < 4 THEN lo + (bucket + 1) * width - 1 ELSE hi END AS VARCHAR) AS label, COUNT(*) AS cnt,
  round(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY series), 9) AS pct
FROM (SELECT *, CAST(CASE WHEN width = 0 THEN 4 ELSE LEAST(4, (total - lo) // NULLIF(width, 0)) END AS INTEGER) AS bucket FROM (
  SELECT *, (hi - lo) // 5 AS width FROM (SELECT *, MIN(total) OVER w AS lo, MAX(total) OVER w AS hi FROM sums
  WINDOW w AS (PARTITION BY series)))) GROUP BY series, bucket, lo, hi, width""", sums)
    out["top_sums"] = many("""
SELECT series, CAST(rnk AS INTEGER) AS rnk, total, cnt FROM (
  SELECT series, total, COUNT(*) AS cnt, ROW_NUMBER() OVER (PARTITION BY series ORDER BY COUNT(*) DESC, MIN(draw_idx)) AS rnk
  FROM sums GROUP BY 1, 2) WHERE rnk <= 10""", sums)
    runs = """
isl AS (SELECT series, draw_idx, num, num - ROW_NUMBER() OVER (PARTITION BY series, draw_idx ORDER BY num) AS g FROM occ WHERE pool = 'main'),
runs AS (SELECT series, draw_idx, MIN(num) AS start, CAST(COUNT(*) AS INTEGER) AS len,
  string_agg(CAST(num AS VARCHAR), '-' ORDER BY num) AS run FROM isl GROUP BY series, draw_idx, g)"""
    out["run_length_dist"] = many("""
SELECT series, run_len, COUNT(*) AS cnt, round(COUNT(*) * 100.0::DOUBLE / SUM(COUNT(*)) OVER (PARTITION BY series), 9) AS pct
FROM (SELECT series, draw_idx, MAX(len) AS run_len FROM runs GROUP BY 1, 2) GROUP BY 1, 2""", runs)
    out["top_runs"] = many("""
SELECT series, CAST(rnk AS INTEGER) AS rnk, run, cnt FROM (SELECT series, run, COUNT(*) AS cnt,
  ROW_NUMBER() OVER (PARTITION BY series ORDER BY COUNT(*) DESC, MIN(draw_idx), MIN(start)) AS rnk
  FROM runs WHERE len >= 2 GROUP BY 1, 2) WHERE rnk <= 10""", runs)

    # gaps
    out["gap_history"] = many(" SELECT series, pool, num, draw_idx, gap FROM gaps", GAPS)
    out["gap_stats"] = many(GAP_STATS, GAPS)
    out["returns_stats"] = one(GAP_STATS, GAPS)
    out["current_gap"] = many(" SELECT series, pool, num, gap FROM gapcur")
    out["gap_score_current"] = many(" SELECT series, pool, num, CAST(gap AS DOUBLE) AS score FROM gapcur WHERE drawn")
    out["gap_score_mean"] = many(" SELECT series, pool, num, round(mean_gap, 9) AS score FROM gapcur")
    out["gaps_at_draw"] = many("""
SELECT series, pool, num, draw_idx AS seq, gap FROM gaps WHERE draw_idx <= 80 UNION ALL
SELECT a.series, pool, num, 81, 80 - MAX(draw_idx) FROM app a JOIN len l ON l.series = a.series AND l.n > 80
WHERE draw_idx <= 80 GROUP BY 1, 2, 3""", GAPS)

    # cycles
    ratio_cols = "series, w, pool, num, observed, expected, ratio"
    out["cycle_ratio"] = many(f" SELECT {ratio_cols} FROM ratios WHERE w = 100")
    out["cycle_ratio_multi"] = many(f" SELECT {ratio_cols} FROM ratios WHERE w <> 100")
    out["adaptive_cycle_weights"] = many(number_out("cyc", "weight"))
    out["moon_phase"] = many(" SELECT draw_id, round(ph, 9) AS phase FROM phases")
    out["moon_phase_name"] = many(" SELECT draw_id, phase AS name FROM phases")
    names = ", ".join(
        f"('{p}')"
        for p in (
            "Nouvelle lune", "Premier croissant", "Premier quartier", "Gibbeuse croissante",
            "Pleine lune", "Gibbeuse décroissante", "Dernier quartier", "Dernier croissant",
        )
    )
    out["phase_distribution"] = many(f"""
SELECT g.series, v.phase, COALESCE(p.c, 0) AS n_draws, g.pool, g.num, COALESCE(o.cnt, 0) AS cnt
FROM grid g CROSS JOIN (VALUES {names}) AS v(phase)
LEFT JOIN (SELECT series, phase, COUNT(*) AS c FROM phases GROUP BY 1, 2) p ON p.series = g.series AND p.phase = v.phase
LEFT JOIN phocc o ON o.series = g.series AND o.phase = v.phase AND o.pool = g.pool AND o.num = g.num""")
    out["lunar_weights"] = many(number_out("lun", "weight"))
    out["combine_lunar"] = many(number_out("cyclun", "weight"))
    out["next_phases"] = many(f"""
SELECT CAST(date AS VARCHAR) AS date, phase, CAST(MIN(nd) AS VARCHAR) AS next_date FROM (
  SELECT date, nd, t.phase, t.target, {phase_sql('nd')} AS ph FROM (
    SELECT date, CAST(date + CAST(k AS INTEGER) AS DATE) AS nd
    FROM (SELECT DISTINCT draw_date AS date FROM draws), (SELECT UNNEST(range(1, 31)) AS k))
  CROSS JOIN (VALUES ('Nouvelle lune', 0.0::DOUBLE), ('Premier quartier', 0.25::DOUBLE), ('Pleine lune', 0.5::DOUBLE),
    ('Dernier quartier', 0.75::DOUBLE)) AS t(phase, target))
WHERE abs(ph - target) < 0.02::DOUBLE OR abs(ph - target - 1) < 0.02::DOUBLE GROUP BY date, phase""")
    out["current_phase"] = many(
        " SELECT DISTINCT CAST(draw_date AS VARCHAR) AS date, round(ph, 9) AS phase, phase AS phase_name FROM"
        " (SELECT draw_date, ph, phase FROM phases)".replace("ph, phase FROM phases", "ph, phase FROM phases")
    )

    # weights
    out["inverse_fib_weights"] = many(number_out("invfib", "weight", 12))
    out["inverse_fib_weights_descending"] = many("""
SELECT series, pool, num, round(w / SUM(w) OVER (PARTITION BY series, pool), 12) AS weight FROM (
  SELECT s.*, 1.0 / f.a AS w FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY series, pool ORDER BY cnt DESC, seen) - 1 AS r FROM st) s JOIN fibs f ON f.r = s.r)""")
    out["weighted_blend"] = many("""
SELECT q.series, q.pool, q.num, round(0.7 * rel + 0.3 * weight, 9) AS weight FROM freq q JOIN invfib USING (series, pool, num)""")
    out["adaptive_weights"] = many("""
SELECT series, pool, num, round(v / SUM(v) OVER (PARTITION BY series, pool), 9) AS weight FROM (
  SELECT r.series, r.pool, r.num, 0.4 * COALESCE(rel, 0) + 0.3 * COALESCE(weight, 0) + 0.3 *
    CASE WHEN MAX(ratio) OVER w > MIN(ratio) OVER w THEN (ratio - MIN(ratio) OVER w) / (MAX(ratio) OVER w - MIN(ratio) OVER w)
      ELSE 1.0 / COUNT(*) OVER w END AS v
  FROM (SELECT * FROM ratios WHERE w = 50) r LEFT JOIN freq USING (series, pool, num) LEFT JOIN invfib USING (series, pool, num)
  WINDOW w AS (PARTITION BY r.series, r.pool))""")
    out["fib_sequence_weights"] = many("""
SELECT series, pool, num, round(a / MAX(a) OVER (PARTITION BY series, pool), 9) AS weight FROM (
  SELECT s.*, f.a FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY series, pool ORDER BY num) - 1 AS r FROM st) s
  JOIN fibs f ON f.r = s.r)""")

    # scores
    out["freq_prediction"] = many(number_out("pred", "score"))
    out["score_a"] = many(number_out("scorea", "score"))
    out["score_b"] = many("""
SELECT series, pool, num, round(CASE WHEN fib IS NOT NULL THEN 0.7 * score + 0.3 * fib ELSE score END, 9) AS score FROM sb""",
        score_b_sql(0.2, 0.3, 0.3, 0.2, "cyc"))
    out["score_b_lunar"] = many(number_out("sb", "score"), score_b_sql(0.15, 0.25, 0.25, 0.35, "cyclun"))
    out["blend_fibonacci"] = many(blend_sql("invfib", 0.7, 0.3))
    out["blend_cycle"] = many(blend_sql("cyc", 0.6, 0.4))
    out["blend_optimized"] = many(number_out("opt", "score"), OPT)
    out["rank_numbers"] = many("""
SELECT series, pool, string_agg(CAST(num AS VARCHAR), '-' ORDER BY num) AS nums FROM optr WHERE rnk <= 5 GROUP BY 1, 2""", OPT)

    # features
    out["prefix_count_arrays"] = many("""
SELECT series, draw_idx, string_agg(CAST(CAST(cnt AS BIGINT) AS VARCHAR), ',' ORDER BY num) FILTER (WHERE pool = 'main') AS main_cnt,
  string_agg(CAST(CAST(cnt AS BIGINT) AS VARCHAR), ',' ORDER BY num) FILTER (WHERE pool = 'chance') AS chance_cnt
FROM pre GROUP BY 1, 2""", PREFIX)
    out["number_features"] = many(f" SELECT series, draw_idx, {MICRO} FROM feats GROUP BY 1, 2", TRAIL)
    out["training_features"] = many(f"""
SELECT a.series, a.draw_idx, a.features, {Y_NUMS}, {Y_CHANCE} FROM (SELECT series, draw_idx, {MICRO} FROM allf GROUP BY 1, 2) a
JOIN idx i USING (series, draw_idx) WHERE a.draw_idx >= 50""",
        TRAIL + f""",
allf AS (SELECT f.series, f.draw_idx + 1 AS draw_idx, f.f, f.v FROM feats f UNION ALL {when_feats('idx', 'draw_date')})""")
    out["temporal_features"] = many("""
SELECT draw_id, concat_ws(',', isodow(draw_date) - 1, month(draw_date), day(draw_date), weekofyear(draw_date)) AS features FROM draws""")
    out["serving_features"] = many(f" SELECT series, draw_idx, {MICRO} FROM allf GROUP BY 1, 2", TRAIL + f""",
upcoming AS (SELECT series, CAST(n AS BIGINT) AS draw_idx, {NEXT_DAY} AS nd FROM (
  SELECT series, COUNT(*) AS n, MAX(draw_date) AS d FROM idx GROUP BY 1)),
allf AS (SELECT f.series, f.draw_idx + 1 AS draw_idx, f.f, f.v FROM feats f JOIN len l ON l.series = f.series AND l.n = f.draw_idx + 1
  UNION ALL {when_feats('upcoming', 'nd')})""")
    out["freq_features"] = many(f"""
SELECT series, draw_idx, {MICRO} FROM (SELECT t.series, t.draw_idx + 1 AS draw_idx, num AS f, c / 250.0::DOUBLE AS v FROM trail t
  JOIN len l ON l.series = t.series AND t.draw_idx + 1 < l.n WHERE t.draw_idx >= 49) GROUP BY 1, 2""", TRAIL)
    past = ", ".join(f"LAG(n{i}, {lag}) OVER w" for lag in range(5, 0, -1) for i in range(1, 6))
    out["lag_features"] = many(f"""
SELECT series, draw_idx, array_to_string(past, ',') AS features, {Y_NUMS}, chance AS y_chance
FROM (SELECT *, [{past}] AS past FROM idx WINDOW w AS (PARTITION BY series ORDER BY draw_idx)) WHERE draw_idx >= 5""")

    # models
    served = served_sql()
    out["predict_next"] = many(" SELECT series, pool, num, round(p, 9) AS p FROM mlp", served)
    out["blend_fibonacci_model"] = many(fitted(blend_sql("invfib", 0.7, 0.3)), served)
    out["blend_cycle_model"] = many(fitted(blend_sql("cyc", 0.6, 0.4)), served)
    out["blend_optimized_model"] = many(number_out("opt", "score"), served + "," + fitted(OPT))
    out["eval_models"] = many("""
SELECT n, round(exact / n::DOUBLE, 9) AS subset_accuracy, round(COALESCE(tp::DOUBLE / NULLIF(sn, 0), 0), 9) AS precision,
  round(COALESCE(tp::DOUBLE / NULLIF(tn, 0), 0), 9) AS recall, round(COALESCE(2 * tp::DOUBLE / NULLIF(sn + tn, 0), 0), 9) AS f1_micro,
  round(hits / n::DOUBLE, 9) AS top_hits, (SELECT round(AVG(ok), 9) FROM cbest) AS chance_accuracy,
  (SELECT round(SUM(-(pos * ln(q) + (n - pos) * ln(1 - q))) / SUM(n), 9) FROM pool_bins) AS log_loss,
  (SELECT round(AVG(auc), 9) FROM wins) AS auc, (SELECT round(MAX(f1), 9) FROM f1s) AS best_f1,
  (SELECT round(MIN(bin) / 1000::DOUBLE, 9) FROM f1s WHERE f1 = (SELECT MAX(f1) FROM f1s)) AS best_threshold
FROM (SELECT COUNT(*) AS n, SUM(exact) AS exact, SUM(tp) AS tp, SUM(sn) AS sn, SUM(tn) AS tn, SUM(hits) AS hits FROM erow)""",
        TRAIL + f""", {train_sql('older')}, {forest_sql('main')}, {forest_sql('chance')},
ex AS MATERIALIZED (SELECT xv.* FROM xv JOIN tpos USING (series, draw_idx) WHERE NOT older), {walked_sql('main', 'ex')}, {walked_sql('chance', 'ex')}, {EVAL}""")

    # combinations
    out["freq_slices"] = many("""
SELECT series, CAST((rk - 1) // 5 + 1 AS INTEGER) AS combo_id, string_agg(CAST(num AS VARCHAR), '-' ORDER BY num) AS nums,
  (SELECT num FROM fr c WHERE c.series = fr.series AND c.pool = 'chance' AND c.rk = 1) AS chance, 'frequency' AS method
FROM fr WHERE pool = 'main' AND rk <= 25 GROUP BY 1, 2""",
        "fr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series, pool ORDER BY cnt DESC, seen) AS rk FROM st)")
    out["top_combo"] = many("""
SELECT series, 1 AS combo_id, string_agg(CAST(num AS VARCHAR), '-' ORDER BY num) FILTER (WHERE pool = 'main' AND rnk <= 5) AS nums,
  MAX(num) FILTER (WHERE pool = 'chance' AND rnk = 1) AS chance, 'optimized' AS method FROM optr GROUP BY 1""", OPT)
    out["monte_carlo_combos"] = one(" SELECT * FROM mc", monte_carlo())
    out["generate_combos"] = one(" SELECT * EXCLUDE (cnt) FROM mc", monte_carlo())
    out["wheeling"] = many("""
SELECT series, CAST(rn AS INTEGER) AS combo_id, concat_ws('-', a, b, c, d, e) AS nums, 0 AS chance, 'wheeling' AS method FROM (
  SELECT t1.series, t1.num AS a, t2.num AS b, t3.num AS c, t4.num AS d, t5.num AS e,
    ROW_NUMBER() OVER (PARTITION BY t1.series ORDER BY t1.num, t2.num, t3.num, t4.num, t5.num) AS rn
  FROM best t1 JOIN best t2 ON t2.series = t1.series AND t2.num > t1.num JOIN best t3 ON t3.series = t1.series AND t3.num > t2.num
  JOIN best t4 ON t4.series = t1.series AND t4.num > t3.num JOIN best t5 ON t5.series = t1.series AND t5.num > t4.num) WHERE rn <= 50""",
        AR + ", best AS (SELECT series, num FROM ar WHERE pool = 'main' AND rnk <= 10)")
    out["direct_combos"] = many("""
SELECT series, i + 1 AS combo_id, array_to_string(list_sort(CASE
    WHEN 2 * i + 5 <= 49 THEN list_transform(range(1, 6), lambda x: 2 * i + x)
    ELSE list_concat(range(2 * i + 1, 50), range(1, 5 - (49 - 2 * i) + 1)) END), '-') AS nums,
  0 AS chance, 'direct' AS method FROM len, (SELECT CAST(range AS INTEGER) AS i FROM range(0, 24))""")
    out["propose_chance"] = many(
        " SELECT series, CAST(rnk AS INTEGER) AS rnk, num AS chance FROM ar WHERE pool = 'chance' AND rnk <= 7", AR
    )
    out["mixed_combos"] = many("""
SELECT k.series, combo_id, nums, COALESCE(extra[combo_id], 0) AS chance, 'mixed' AS method FROM kept k JOIN arr USING (series)
WHERE combo_id <= 9""", mixed())
    out["cover_grid"] = many(
        " SELECT series, CAST(ord AS INTEGER) AS ord, combo_id, array_to_string(nums, '-') AS nums FROM cover", cover_rounds()
    )
    out["cover_mixed"] = many(
        " SELECT series, CAST(ord AS INTEGER) AS ord, combo_id, array_to_string(nums, '-') AS nums FROM cover",
        mixed(20) + ", " + cover_rounds(MIXED),
    )
    out["recurring_numbers"] = many("""
SELECT series, CAST(rnk AS INTEGER) AS rnk, num, cnt FROM (SELECT series, num, COUNT(*) AS cnt,
  ROW_NUMBER() OVER (PARTITION BY series ORDER BY COUNT(*) DESC, MIN(ord * 1000 + pos)) AS rnk
  FROM (SELECT series, ord, UNNEST(nums) AS num, generate_subscripts(nums, 1) AS pos FROM cover) GROUP BY 1, 2)
WHERE rnk <= 5 AND cnt > 1""", cover_rounds())

    # odds
    out["match_odds"] = GAMES + " SELECT game_id, k, round(p, 12) AS p FROM ks"
    out["game_odds"] = GAMES + " SELECT game_id, label, round(p, 12) AS p FROM odds"
    out["game_summary"] = GAMES + """
SELECT game_id, MAX(total * c) AS tickets, round(SUM(o.p), 9) AS p_any_prize, round(1 - SUM(o.p), 9) AS p_nothing
FROM odds o JOIN ch USING (game_id) GROUP BY 1"""
    out["expected_value"] = GAMES + """
SELECT game_id, round(SUM(p * prize), 9) AS gross, round(SUM(p * prize) - MAX(price), 9) AS net,
  round(SUM(p * prize) / MAX(price), 9) AS rtp FROM odds GROUP BY 1"""
    out["breakeven_jackpot"] = GAMES + """
SELECT game_id, round((MAX(price) - SUM(CASE WHEN label <> '5 + Chance' THEN p * prize ELSE 0 END))
  / SUM(CASE WHEN label = '5 + Chance' THEN p END), 2) AS jackpot FROM odds GROUP BY 1"""

    # settlement and evaluation
    out["prize_rank"] = one(
        f" SELECT ticket_id, {rank_case()} AS long_rank, {rank_case(style=1)} AS short_rank FROM settled", TICKETS
    )
    out["rank_points"] = one(
        f" SELECT ticket_id, {value_case(5)} AS points FROM (SELECT *, {rank_case(style=1)} AS rank FROM settled)", TICKETS
    )
    out["settle_tickets"] = one(f"""
SELECT ticket_id, matches, chance_hit, rank, CAST({value_case(4)} AS DOUBLE) AS prize FROM (SELECT *, {RANK} FROM settled)""", TICKETS)
    out["track_performance"] = one(tracked("CAST(t.chance = i.chance AS INTEGER)"), TICKETS)
    out["track_performance_actual"] = one(tracked("1"), TICKETS)
    out["picks"] = many(
        " SELECT series, strategy, draw_idx, array_to_string(nums, '-') AS nums, chance FROM picked", picks_sql(50)
    )
    out["walk_forward"] = many(
        f" SELECT series, strategy, draw_idx, matches, chance_hit, {RANK} FROM wf", picks_sql(50)
    )
    out["walk_forward_summary"] = one(f"""
SELECT series, strategy, n, mean, std, chance_rate, prize_rate, round(z, 9) AS z,
  round({ERFC.format(x='abs(z) / sqrt(2.0)')}, 6) AS p FROM (
  SELECT series, strategy, COUNT(*) AS n, round(AVG(matches), 9) AS mean, round(stddev_samp(matches), 9) AS std,
    round(AVG(chance_hit), 9) AS chance_rate, round(AVG(CAST({rank_case()} <> '' AS INTEGER)), 9) AS prize_rate,
    (AVG(matches) - {NULL_MEAN}) / sqrt({NULL_VAR} / COUNT(*)) AS z FROM wf GROUP BY 1, 2)""", picks_sql(200))
    out["walk_forward_ranks"] = one(f"""
SELECT series, strategy, rank, COUNT(*) AS cnt FROM (SELECT *, {RANK} FROM wf) WHERE rank <> '' GROUP BY 1, 2, 3""", picks_sql(200))
    match = " + ".join(f"CAST(p{i} IN (n1, n2, n3, n4, n5) AS INTEGER)" for i in range(1, 6))
    out["monte_carlo_null"] = one("""
SELECT series, round(AVG(m), 9) AS mc_mean, round(stddev_samp(m), 9) AS mc_std, round(quantile_cont(m, 0.05), 9) AS p05,
  round(quantile_cont(m, 0.95), 9) AS p95, COUNT(*) AS n_runs FROM runs GROUP BY 1""", f"""
trial AS (SELECT i.*, CAST(range AS INTEGER) AS run FROM idx i, range(0, 300) WHERE draw_idx >= 200),
runs AS (SELECT series, run, AVG({match}) AS m FROM ({floyd('trial', 'series, run, draw_idx, n1, n2, n3, n4, n5',
        ['12345', "'null'", 'series', 'run', 'draw_idx'])}) GROUP BY 1, 2)""")
    out["backtest_scores"] = many(f"""
SELECT series, draw_idx, array_to_string(nums, '-') AS nums, chance, matches, chance_hit, rank, {value_case(5)} AS points
FROM (SELECT *, {rank_case(style=1)} AS rank FROM bt)""", BACKTEST)

    ranks = ", ".join(f"('{r[0]}', {r[2]}, {r[3]}, {r[4]}::DOUBLE)" for r in RANKS)
    summary = "n::DOUBLE AS n, mean, std, chance_rate, prize_rate, z, p, (p < 0.01)::INTEGER::DOUBLE AS differs"
    out["evaluation_report"] = one("""
SELECT series, section, item, metric, round(value, 6) AS value FROM report""", picks_sql(200) + f""",
trial AS (SELECT i.*, CAST(range AS INTEGER) AS run FROM idx i, range(0, 300) WHERE draw_idx >= 200),
runs AS (SELECT series, run, AVG({match}) AS m FROM ({floyd('trial', 'series, run, draw_idx, n1, n2, n3, n4, n5',
        ['12345', "'null'", 'series', 'run', 'draw_idx'])}) GROUP BY 1, 2),
sizes AS (SELECT series, COUNT(*)::DOUBLE AS n_draws, COUNT(*)::DOUBLE - 200 AS n_evaluated, {NULL_MEAN} AS null_mean FROM idx GROUP BY 1 HAVING COUNT(*) >= 210),
summed AS (SELECT series, strategy, COUNT(*) AS n, AVG(matches) AS mean, stddev_samp(matches) AS std, AVG(chance_hit) AS chance_rate,
  AVG(CAST({rank_case()} <> '' AS INTEGER)) AS prize_rate, (AVG(matches) - {NULL_MEAN}) / sqrt({NULL_VAR} / COUNT(*)) AS z FROM wf GROUP BY 1, 2),
tested AS (SELECT *, {ERFC.format(x='abs(z) / sqrt(2.0)')} AS p FROM summed),
chances AS (SELECT label, prize, [1, 5, 10, 10, 5, 1][k + 1] * [1086008, 135751, 13244, 946, 44, 1][k + 1] / 1906884.0::DOUBLE
  * CASE WHEN bonus = 1 THEN 0.1::DOUBLE ELSE 0.9::DOUBLE END AS p FROM (VALUES {ranks}) v(label, k, bonus, prize)),
ticket AS (SELECT SUM(p * prize) AS gross, SUM(p * prize) - 2.2 AS net, SUM(p * prize) / 2.2 AS rtp, 19068840::DOUBLE AS tickets, SUM(p) AS p_any_prize FROM chances),
report AS (
  SELECT series, 'dataset' AS section, 'draws' AS item, metric, value FROM (UNPIVOT sizes ON n_draws, n_evaluated, null_mean INTO NAME metric VALUE value)
  UNION ALL SELECT series, 'strategy', strategy, metric, value FROM (UNPIVOT (SELECT series, strategy, {summary} FROM tested)
    ON n, mean, std, chance_rate, prize_rate, z, p, differs INTO NAME metric VALUE value)
  UNION ALL SELECT series, 'rank', strategy || ' / ' || rank, 'draws', COUNT(*)::DOUBLE FROM (SELECT *, {RANK} FROM wf) WHERE rank <> '' GROUP BY 1, strategy, rank
  UNION ALL SELECT series, 'null', 'random tickets', metric, value FROM (UNPIVOT (SELECT series, AVG(m) AS mc_mean, stddev_samp(m) AS mc_std,
    quantile_cont(m, 0.05) AS p05, quantile_cont(m, 0.95) AS p95, COUNT(*)::DOUBLE AS n_runs FROM runs GROUP BY 1)
    ON mc_mean, mc_std, p05, p95, n_runs INTO NAME metric VALUE value)
  UNION ALL SELECT series, 'odds', label, 'p', p FROM sizes, chances
  UNION ALL SELECT series, 'value', 'ticket', metric, value FROM sizes, (UNPIVOT ticket ON gross, net, rtp, tickets, p_any_prize INTO NAME metric VALUE value))""")

    # streams against their batch equivalents
    out["stream_refit"] = many("""
SELECT CAST(1 AS INTEGER) AS version, CAST(MIN(first) AS VARCHAR) AS first_date, CAST(MAX(last) AS VARCHAR) AS last_date,
  CAST(SUM(CASE WHEN n >= 100 THEN n - 50 - floor((n - 50) * 0.8::DOUBLE) ELSE 0 END) AS BIGINT) AS n_test
FROM (SELECT series, COUNT(*) AS n, MIN(draw_date) AS first, MAX(draw_date) AS last FROM single GROUP BY 1)""", ONE_PER_DATE)
    out["stream_ingest"] = many(f" SELECT {DRAW_OUT} FROM single", ONE_PER_DATE)
    out["stream_freq"] = many(" SELECT series, pool, num, cnt FROM st")
    out["stream_gaps"] = out["current_gap"]
    out["stream_last_draws"] = many(windowed, window.format(w=1335))
    return out
