"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering.

Only DataFrame functions touch the rows: the learner sees counts per feature
and threshold, never a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from drawlytics.llm.common import UPPER, whole_text, words
from drawlytics.plans.store import materialize

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS, STOPS = "#*$%&|<>", ".,;:!?"
P = "_quality_"


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns ``_quality_<name>`` of BASE and of further statistics.

    Repeated three-word windows are found by one sort of longs per text: a hash
    of the window above its position, so equal windows are neighbours (50 hash
    bits or more for texts under 16 000 words; neighbours are compared by word).
    A null text has no words.
    """
    text = whole_text(text_col)
    df = docs.withColumn(f"{P}w", words(text))
    w, n = F.col(f"{P}w"), F.col(f"{P}n")
    df = df.withColumn(f"{P}n", F.size(w)).withColumn(f"{P}m", F.expr(f"shiftleft(1L, length(bin({P}n))) - 1"))
    low = F.col(f"{P}m")
    at = F.sequence(F.lit(0), n - 3)
    gram = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))
    df = df.withColumn(f"{P}g", F.when(n >= 3, F.sort_array(F.transform(at, gram))).otherwise(F.array().cast("array<long>")))
    g = F.col(f"{P}g")

    def same(x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
        equal = [F.get(w, i + k) == F.get(w, j + k) for k in range(3)]
        return F.coalesce((x.bitwiseXOR(y) < low + 1) & (x.bitwiseXOR(y) >= 0) & equal[0] & equal[1] & equal[2], F.lit(False))

    twice = F.filter(g, lambda x, k: same(x, F.get(g, k - 1)) | same(x, F.get(g, k + 1)))
    df = df.withColumn(f"{P}p", F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(low))))
    p = F.col(f"{P}p")
    steps = F.transform(p, lambda x, k: F.coalesce(F.least(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)).cast("long"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    size, chars = F.length(text), F.length(F.array_join(w, ""))
    stats = {
        "n_words": n,
        "word_chars": chars,
        "n_symbols": size - _without(text, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x),
        "n_upper": size - _without(text, UPPER),
        "n_stops": size - _without(text, STOPS),
        "n_digits": size - _without(text, "0123456789"),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_lines": F.size(lines),
    }
    df = df.withColumn(f"{P}s", F.struct(*[c.cast("long").alias(k) for k, c in stats.items()]))
    return df.select(*docs.columns, *[F.col(f"{P}s.{k}").alias(P + k) for k in stats])


def features() -> dict[str, Column]:
    """What a rule may test; every ratio is per word."""
    n = F.greatest(F.col(f"{P}n_words"), F.lit(1))
    per_word = ["word_chars", "n_symbols", "n_repeat_words", "n_upper", "n_stops", "n_digits", "n_distinct", "n_lines"]
    out = {f"{k}/n_words": F.col(P + k) / n for k in per_word}
    out["n_dup_lines/n_lines"] = F.col(f"{P}n_dup_lines") / F.greatest(F.col(f"{P}n_lines"), F.lit(1))
    out["n_words"] = F.col(f"{P}n_words").cast("double")
    return out


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    n, r = F.col(f"{P}n_words"), F.col(f"{P}n_repeat_words")
    return (n < min_words) | (100 * r > max_repeat_percent * n)


@dataclass(frozen=True)
class Test:
    """``feature`` <= or > ``cut``, the ``bin``-th cut of the feature."""

    feature: str
    above: bool
    bin: int
    cut: float

    def on_bins(self) -> Column:
        b = F.col("bins")[self.feature]
        return b > self.bin if self.above else b <= self.bin

    def on_rows(self) -> Column:
        x = features()[self.feature]
        return x > self.cut if self.above else x <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut!r}"


Rule = tuple[Test, ...]


def _all(tests: Sequence[Test]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.on_bins()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(rows: DataFrame, cuts: dict[str, list[float]], most: int) -> Rule:
    """Adds the test of the best information gain until no bad row is left out of the wrong class."""
    rule: Rule = ()
    while len(rule) < most:
        counts = (
            rows.where(_all(rule))
            .select("bad", F.explode("bins").alias("feature", "bin"))
            .groupBy("feature", "bin")
            .agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
            .collect()  # features x cuts at most
        )
        table: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts:
            table.setdefault(r["feature"], {})[r["bin"]] = (r["p"], r["n"])
        if not table:
            break
        p0, n0 = (sum(v[i] for v in next(iter(table.values())).values()) for i in (0, 1))
        if not p0 or not n0:
            break
        best: tuple[float, Test] | None = None
        for feature in sorted(table):
            p = n = 0
            for k, cut in enumerate(cuts[feature]):
                p, n = p + table[feature].get(k, (0, 0))[0], n + table[feature].get(k, (0, 0))[1]
                for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                    gain = _gain(x, y, p0, n0)
                    if gain > (best[0] if best else 1e-9):
                        best = gain, Test(feature, above, k, cut)
        if best is None:
            break
        rule += (best[1],)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> Rule:
    """The shortest prefix with the best (right - wrong) / covered on rows that the rule has not seen."""
    sums = [F.sum(F.when(_all(rule[: k + 1]), s)).alias(f"{name}{k}") for k in range(len(rule)) for name, s in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
    r = rows.agg(*sums).first()
    value = [((r[f"p{k}"] or 0) - (r[f"n{k}"] or 0)) / max(1, (r[f"p{k}"] or 0) + (r[f"n{k}"] or 0)) for k in range(len(rule))]
    return rule[: value.index(max(value)) + 1]


def learn(
    rows: DataFrame,
    bad: Column,
    max_rows: int = 200_000,
    max_rules: int = 12,
    max_tests: int = 4,
    cuts: int = 16,
    min_precision: float = 0.95,
    min_covered: int = 5,
) -> list[Rule]:
    """Rules for ``bad`` from rows with statistics; null labels are ignored.

    At most about ``max_rows`` labelled rows, chosen by hash, are used: the bound
    of the fit, not of what is judged. Cuts are quantiles of either class. A rule
    grows on two thirds of the rows left and is pruned on the rest; it is taken if
    ``min_precision`` of what it covers is bad, and its rows are removed. No
    labels, or one class only, give no rules.
    """
    values = features()
    deal = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).alias("h")
    table = rows.select(bad.cast("int").alias("bad"), F.struct(*[c.alias(f"f{i}") for i, c in enumerate(values.values())]).alias("x"), deal)
    table = materialize(table.where("bad IS NOT NULL"), "labelled")
    n, positive = table.agg(F.count(F.lit(1)), F.sum("bad")).first()
    if not n or not positive or positive == n:
        return []
    table = table.where(F.col("h") < math.ceil((1 << 20) * min(1.0, max_rows / n)))
    at = [(k + 0.5) / cuts for k in range(cuts)]
    q = table.groupBy("bad").agg(*[F.percentile_approx(f"x.f{i}", at, 2000).alias(f"f{i}") for i in range(len(values))]).collect()
    found = {name: sorted({v for r in q for v in r[f"f{i}"]}) for i, name in enumerate(values)}

    def below(name: str, value: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, found[name])), lambda c: c < value))

    bins = F.create_map(*[x for i, name in enumerate(values) for x in (F.lit(name), below(name, F.col(f"x.f{i}")))])
    left = materialize(table.select("bad", bins.alias("bins"), (F.pmod("h", F.lit(3)) == 0).alias("held")), "binned")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule = _grow(left.where("NOT held"), found, max_tests)
        if not rule:
            break
        rule = _prune(left.where("held"), rule)
        p, n = left.where(_all(rule)).agg(F.sum("bad"), F.count(F.lit(1))).first()
        if n < min_covered or p < min_precision * n:
            break
        rules.append(rule)
        left = left.where(~_all(rule))
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The first rule that a row meets, as text; null if none."""
    out = None
    for rule in rules:
        met = rule[0].on_rows()
        for t in rule[1:]:
            met = met & t.on_rows()
        text = F.lit(" AND ".join(map(str, rule)))
        out = F.when(met, text) if out is None else out.when(met, text)
    return F.lit(None).cast("string") if out is None else out


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fit) -> DataFrame:
    """``docs`` with ``_quality_*`` statistics, ``_quality_rule`` and ``_quality_kept``.

    ``labels`` (id, 0 = bad) trains the rules. Documents without a label, with a
    null id or repeated are judged like any other; an empty text fails the base
    rules. The statistics are written once; learning and judging read them back.
    """
    stats = materialize(with_statistics(docs, text_col), "statistics")
    slim = stats.select(F.col(id_col).alias(f"{P}id"), *[c for c in stats.columns if c.startswith(P)])
    marked = slim.join(labels.select(F.col(id_col).alias(f"{P}id"), F.col(label_col).alias(f"{P}label")), f"{P}id")
    rules = learn(marked, F.col(f"{P}label") == 0, **fit)
    out = stats.withColumn(f"{P}rule", verdict(rules)).withColumn(f"{P}base_failed", base_failed())
    return out.withColumn(f"{P}kept", ~F.col(f"{P}base_failed") & F.col(f"{P}rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame, **args) -> DataFrame:
    """The rows of ``docs`` that the base rules and the learned list keep."""
    return judged(docs, labels, **args).where(f"{P}kept").select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **args) -> DataFrame:
    """id, the base statistics, ``base_failed``, ``kept`` and the ``rule`` met, per row."""
    slim = docs.select(F.col(id_col), F.col(text_col))
    out = judged(slim, labels, id_col, text_col, **args)
    return out.select(id_col, *[F.col(P + k).alias(k) for k in [*BASE, "base_failed", "kept", "rule"]])
