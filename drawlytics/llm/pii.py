"""Personal data: fixed patterns seed a bootstrapped search for further identifiers by context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from drawlytics.llm.common import ascii_lower, whole_text
from drawlytics.plans.store import materialize

KINDS = ("email", "ip", "card", "phone")
#: Candidates for further identifiers: digits, 6 to 39 characters from first to last, and addresses whose @ or dots are written out.
NUMBER = r"(?<![0-9A-Za-z])[0-9][0-9 ().:/-]{4,37}[0-9](?![0-9A-Za-z])"
AT = r"(?:@| ?[(\[{] ?(?:at|AT|@) ?[)\]}] ?)"
DOT = r"(?:\.| ?[(\[{] ?(?:dot|DOT|\.) ?[)\]}] ?)"
ADDRESS = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{AT}[A-Za-z0-9-]{{1,63}}+(?:{DOT}[A-Za-z0-9-]{{1,63}}+){{0,8}}"
CANDIDATES = ("number", "address")
#: Code points beside a match that may hold its context, and those of a context word.
CONTEXT, WORD = 64, 40

# Each expression is free of nested repetition, so no text is too long for the
# regular expression engine; where a separator may stand only between two
# characters, every other one is first replaced, one for one.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]*"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _emails(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", "%")


def _cards(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<![0-9])[ -]|[ -](?![0-9])", "\n")


#: kind -> (gate, text to search, expression). A text without its gate has no match that counts.
SEARCHES = {
    "email": (lambda t: F.contains(t, F.lit("@")), _emails, EMAIL),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda t: t, IP),
    "card": (lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){15}"), _cards, CARD),
    "phone": (lambda t: t.rlike(r"\+[0-9]"), lambda t: t, PHONE),
    "number": (lambda t: t.rlike(r"[0-9][0-9 ().:/-]{4}"), lambda t: t, NUMBER),
    "address": (lambda t: t.rlike(r"@|[(\[{] ?(?:at|AT) ?[)\]}]"), lambda t: t, ADDRESS),
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    """Whether a match of its kind counts."""
    number = _digits(value)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(number)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", ip)
        .when(kind == "card", F.when((n >= 16) & (n <= 19), luhn(number)).otherwise(False))
        .when(kind == "phone", (n >= 8) & (n <= 15))
        .otherwise(True)
    )


def _matches(text: Column, kind: str) -> Column:
    """(kind, i, gap, value, left, right) of every match: the length of the text between it and the one before, and the texts beside it."""
    gate, prepared, expression = SEARCHES[kind]
    own = prepared(text)
    parts, found = F.split(own, expression, -1), F.regexp_extract_all(own, F.lit(expression), F.lit(0))
    pairs = F.transform(
        F.arrays_zip(parts.alias("part"), found.alias("value")),
        lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(p["part"]).alias("gap"), p["value"].alias("value"), F.right(p["part"], F.lit(CONTEXT)).alias("left"), F.left(F.get(parts, i + 1), F.lit(CONTEXT)).alias("right")),
    )
    kept = F.filter(pairs, lambda p: p["value"].isNotNull())
    return F.when(gate(text), kept)


def found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (row, id), and (row, kind, start, end, value, left, right) of all matches that count.

    The matches are found in one pass, per text; starts are running sums over the matches of a row.
    """
    df = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    every = F.flatten(F.array_compact(F.array(*[_matches(F.col("text"), k) for k in SEARCHES])))
    stored = materialize(df.select("id", every.alias("matches")).withColumn("row", F.monotonically_increasing_id()), "matches")
    each = stored.select("row", F.inline("matches"))
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(before)).withColumn("start", F.col("end") - F.length("value"))
    counts = each.where(_holds(F.col("kind"), F.col("value"))).select("row", "kind", "start", "end", "value", "left", "right")
    return stored.select("row", "id"), materialize(counts, "found")


def _uncovered(matches: DataFrame, kind: str) -> DataFrame:
    """Candidates of a kind that touch nothing of another: nothing begins before a candidate's end and ends after its start."""
    base = F.col("kind") != kind
    order = Window.partitionBy("row").orderBy("start", F.when(base, 0).otherwise(1), "end")
    reach = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = matches.withColumn("reach", reach).withColumn("coming", coming)
    return marked.where(~base & (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("coming").isNull() | (F.col("coming") >= F.col("end")))).drop("reach", "coming")


def _patterned(spans: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, pattern) of spans, a row for each of their lexical patterns.

    A pattern is the word to the left or the right, lower-cased, and the loose
    form of the value: an address, four dotted numbers, 16 to 19 or 8 to 15
    digits; other values have none. Values are compared by their digits, or as
    addresses without brackets.
    """
    space = r"[\x20\x09-\x0D]"
    left = F.regexp_extract(ascii_lower(F.col("left")), rf"([^\x20\x09-\x0D]{{1,{WORD}}}){space}{{0,3}}$", 1)
    right = F.regexp_extract(ascii_lower(F.col("right")), rf"^{space}{{0,3}}([^\x20\x09-\x0D]{{1,{WORD}}})", 1)
    number = _digits(F.col("value"))
    n = F.length(number)
    form = (
        F.when(F.col("kind").isin("email", "address"), "address")
        .when(F.col("value").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "dotted")
        .when((n >= 16) & (n <= 19), "long")
        .when((n >= 8) & (n <= 15), "middle")
    )
    plain = F.regexp_replace(F.regexp_replace(ascii_lower(F.col("value")), r"[ (\[{]*(?:at|@)[ )\]}]+|@", "@"), r"[ (\[{]+(?:dot|\.)[ )\]}]+", ".")
    value = F.when(form == "address", plain).when(form == "dotted", F.col("value")).otherwise(number)
    words = F.array(F.when(left != "", F.concat_ws(" ", F.lit("<"), left)), F.when(right != "", F.concat_ws(" ", F.lit(">"), right)))
    patterns = F.transform(F.array_compact(words), lambda w: F.concat_ws(" ", w, form))
    own = spans.where(form.isNotNull()).select("row", "kind", "start", "end", value.alias("plain"), patterns.alias("patterns"))
    return own.select("row", "kind", "start", "end", F.col("plain").alias("value"), F.explode("patterns").alias("pattern"))


def discovered(matches: DataFrame, turns: int, min_seeds: int, min_score: float) -> DataFrame:
    """(row, kind, start, end) of candidates in contexts that reliably hold one kind of entity.

    A graph links patterns and the values seen in them. Seeds, the fixed
    patterns' matches of all four kinds, score 1 for their kind. In each turn a
    pattern scores, for a kind, the mean score of the values in it, shrunk by
    the number of values that have one; patterns of at least ``min_score`` and
    ``min_seeds`` such values are trusted. A value found in trusted patterns
    scores 1 less the product of their doubts; from ``min_score`` on it is
    accepted, and its other contexts induce patterns in the next turn. Turns end
    when nothing is accepted or after ``turns``. Candidates in trusted patterns
    are returned.
    """
    seeds = matches.where(~F.col("kind").isin(*CANDIDATES))
    addresses = materialize(_uncovered(matches.where(F.col("kind") != "number"), "address"), "addresses")
    others = _uncovered(seeds.unionByName(addresses).unionByName(matches.where(F.col("kind") == "number")), "number")
    found = materialize(_patterned(seeds.unionByName(addresses).unionByName(others)), "patterned")
    edges = materialize(found.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n")), "edges")
    totals = materialize(edges.groupBy("pattern").agg(F.sum("n").alias("total")), "pattern-totals")
    seen = found.where(~F.col("kind").isin(*CANDIDATES)).groupBy("value").agg(F.min("kind").alias("label"))
    known = materialize(seen.withColumn("score", F.lit(1.0)), "known")
    for turn in range(turns):
        hits = edges.join(known, "value").groupBy("pattern", "label").agg(F.sum(F.col("n") * F.col("score")).alias("sum"), F.count(F.lit(1)).alias("seeds"))
        score = F.round(F.col("sum") / F.col("total") * F.col("seeds") / (F.col("seeds") + 1), 9)
        ranked = hits.join(totals, "pattern").select("pattern", "label", "seeds", score.alias("score"))
        trusted = ranked.where((F.col("seeds") >= min_seeds) & (F.col("score") >= min_score))
        # Scores of a pattern's kinds add up to 1 at most: over 0.5 there is one.
        trusted = materialize(trusted.groupBy("pattern").agg(F.max_by("label", "score").alias("label"), F.max("score").alias("score")), "trusted")
        if turn == turns - 1:
            break
        fresh = edges.join(trusted, "pattern").join(known.select("value"), "value", "left_anti")
        new = fresh.groupBy("value", "label").agg(F.round(1 - F.product(1 - F.col("score")), 9).alias("score")).where(F.col("score") >= min_score)
        new = materialize(new.groupBy("value").agg(F.max_by("label", "score").alias("label"), F.max("score").alias("score")), "accepted")
        if new.isEmpty():
            break
        known = known.unionByName(new)
    spans = found.where(F.col("kind").isin(*CANDIDATES)).select("row", "start", "end", "pattern")
    return spans.join(trusted, "pattern").groupBy("row", "start", "end").agg(F.max_by("label", "score").alias("kind")).select("row", "kind", "start", "end")


def _joined(spans: Column) -> Column:
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", turns: int = 3, min_seeds: int = 3, min_score: float = 0.6) -> DataFrame:
    """(id, base, spans): arrays of (k, start, end), ``k`` the number of the kind in KINDS from 1.

    ``base`` has the fixed patterns' matches, ``spans`` those and the discovered
    ones, both sorted; positions are code points, ends exclusive. A null text has
    none. Repeated rows and null ids come back; other columns are ignored; an
    empty table gives no rows.
    """
    rows, matches = found(docs, id_col, text_col)
    new = discovered(matches, turns, min_seeds, min_score)
    every = matches.where(~F.col("kind").isin(*CANDIDATES)).select("row", "kind", "start", "end", F.lit(True).alias("fixed")).unionByName(new.withColumn("fixed", F.lit(False)))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(number.alias("k"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    grouped = every.groupBy("row").agg(F.collect_list(F.when(F.col("fixed"), span)).alias("base"), F.collect_list(span).alias("spans"))
    none = F.array().cast("array<struct<k:int,start:bigint,end:bigint>>")
    return rows.join(grouped, "row", "left").select(
        F.col("id").alias(id_col), F.array_sort(F.coalesce("base", none)).alias("base"), F.array_sort(F.coalesce("spans", none)).alias("spans")
    )


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans as text."""
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS, 1)]
    return found.select(id_col, *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
