import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from drawlytics.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(docs, items, most):
    """Every document against every item, by the formula."""
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        wanted = set(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for own, c in found:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scores.append((-s, own is None, own or 0, own))
        out += [(item, rank + 1, own, -s) for rank, (s, _, _, own) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def pairs(df, a="doc_id"):
    return [tuple(r) for r in df.select(a, "text").collect()]


@pytest.mark.parametrize("most", [3, 50])
def test_equals_brute_force(spark, sf_dir, documents, most):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert got(search.search(documents, items, most=most)) == brute(pairs(documents), pairs(items, "item_id"), most)


def test_items_in_several_passes(spark, sf_dir, documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert got(search.search(documents, items, most=5, pass_chars=1500, salts=2)) == brute(pairs(documents), pairs(items, "item_id"), 5)


def test_many_ties_are_cut_by_id(spark):
    docs = spark.range(5000).selectExpr("5000 - id AS doc_id", "CASE WHEN id % 5 < 4 THEN 'the very same passage' ELSE concat('other text ', id) END AS text").repartition(7)
    items = spark.createDataFrame([(1, "The same PASSAGE")], "item_id long, text string")
    rows = search.search(docs, items).orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == sorted(5000 - i for i in range(5000) if i % 5 < 4)[:50] and len({r["score"] for r in rows}) == 1


def test_odd_rows(spark, odd):
    """Null and empty items give nothing, items and documents may repeat or have no id."""
    items = [(1, "word1x1 WORD2x2 two"), (1, "again words"), (None, "éclair two É it"), (2, None), (3, ""), (4, " .,"), (5, "nowhere"), (1, "again words")]
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, rank int")
    assert got(search.search(odd, bench)) == brute(pairs(odd), items, 50)


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    for docs, own in ((none, items), (odd, items.where("false")), (odd.where("text IS NULL"), items), (odd, items.selectExpr("item_id", "'' AS text"))):
        out = search.search(docs, own)
        assert out.collect() == [] and out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 90), max_size=120), min_size=1, max_size=40), st.integers(1, 8))
def test_masks_stop_only_when_nothing_can_enter(docs, most):
    """One segment against the score of every document, with up to 91 terms (two words of mask)."""
    rows = []
    for i, d in enumerate(docs):
        c = sorted(Counter(d).items())
        rows.append((i, max(1, len(d)), [t for t, _ in c], [n for _, n in c]))
    rows = [r for r in rows if r[2]]
    if not rows:
        return
    ids, n, terms, uses = zip(*rows)
    table = pa.table({"id": pa.array(ids), "n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "uses": pa.array(uses, pa.list_(pa.int32()))})
    segment = search.Segment(table, len(rows), sum(n))
    weights = np.arange(91) * 17 % 40
    wanted = np.arange(0, 91)
    every = segment.score(np.arange(len(rows)), np.arange(len(segment.terms)), weights[segment.terms])
    want = sorted((-s, False, i) for s, i in zip(every.tolist(), ids) if s > 0)[:most]
    assert segment.best(wanted, weights, [], most) == want


def test_later_masks_are_not_scored(monkeypatch):
    """Once the best are found, masks of a lower bound are left alone."""
    rows = [(i, 10, [0, 1, 2], [1, 1, 1]) for i in range(300)] + [(300 + i, 10, [2], [1]) for i in range(5000)]
    ids, n, terms, uses = zip(*rows)
    table = pa.table({"id": pa.array(ids), "n": pa.array(n, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "uses": pa.array(uses, pa.list_(pa.int32()))})
    segment, seen = search.Segment(table, len(rows), sum(n)), []
    score = segment.score
    monkeypatch.setattr(segment, "score", lambda docs, *a: seen.extend(docs.tolist()) or score(docs, *a))
    best = segment.best(np.arange(3), np.array([2000, 2000, 50]), [], 50)
    assert [i for _, _, i in best] == list(range(50)) and len(seen) <= 300 + search.SCORED
