import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from drawlytics.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def counts(rows, least=7, uses=2):
    total = Counter()
    for own, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if own is None else own}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= uses}


def edits(word, letters):
    """All strings one inserted, deleted or replaced code point away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {word}


def brute(vocabulary):
    letters = set("".join(vocabulary))
    near = {w: [x for x in edits(w, letters) if x in vocabulary] for w in vocabulary}
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda x: (-vocabulary[x], x), default=None)
        form[w] = best if best and vocabulary[best] >= 10 * n else None
    out = []
    for w, n in vocabulary.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), vocabulary[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def stored(spark, vocabulary):
    return spark.createDataFrame(list(vocabulary.items()), "word string, n long")


def near_only(rows):
    return sorted((r["word"], r["n_near"]) for r in rows)


@pytest.mark.parametrize("bucket_words", [4096, 40])
def test_equals_brute_force(spark, documents, bucket_words):
    """Also with buckets so small that prefixes must be cut deeper than a half."""
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = brute(counts(rows))
    assert sum(r[1] is not None for r in want) > 3 and got(variants.spelling_variants(documents, bucket_words=bucket_words)) == want


def test_a_prefix_shared_by_most_words(spark):
    """Hot in both directions, far beyond the half of a word."""
    rng = np.random.default_rng(3)
    tails = {"".join(rng.choice(list("abcé"), rng.integers(1, 6))) for _ in range(700)}
    vocabulary = {f"prefixed{t}": i % 40 + 2 for i, t in enumerate(sorted(tails))} | {f"{t}suffixed": i % 50 + 2 for i, t in enumerate(sorted(tails))}
    vocabulary |= {f"abc{t}" + "z" * (4 - min(4, len(t))): 9 for t in sorted(tails)[:300]}
    vocabulary = {w: n for w, n in vocabulary.items() if len(w) >= 7}
    rows = variants.near_words(stored(spark, vocabulary), bucket_words=25).collect()
    letters = set("".join(vocabulary))
    assert near_only(rows) == sorted((w, sum(x in vocabulary for x in edits(w, letters))) for w in vocabulary)
    assert max(len(p) for _, p in variants.full_prefixes(stored(spark, vocabulary), 25)) > 7


def test_forms_chain_to_a_root_and_ties_go_by_code_point(spark):
    base = {"chained": 2, "chainede": 20, "chainedes": 200, "chainedest": 2000, "tiedword": 3, "tiedwora": 30, "tiedworé": 30, "alonely": 5}
    text = " ".join(" ".join([w] * n) for w, n in base.items())
    own = next(i for i in range(1000) if counts([(i, text)]) == base)  # an id that deletes nothing
    rows = {r["word"]: r for r in variants.spelling_variants(spark.createDataFrame([(own, text)], "doc_id long, text string")).collect()}
    assert [rows[w]["root"] for w in base] == ["chainedest"] * 4 + ["tiedwora", "tiedwora", "tiedworé", "alonely"]
    assert (rows["tiedword"]["form"], rows["tiedword"]["n_near"], rows["tiedword"]["form_n"]) == ("tiedwora", 2, 30)
    assert (rows["alonely"]["form"], rows["alonely"]["n_near"], rows["alonely"]["form_n"]) == (None, 0, None)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("abé", min_size=6, max_size=10), min_size=1, max_size=60), st.integers(1, 3))
def test_search_finds_every_edit_in_a_half(words, step):
    """Each half-exact search against all pairs, and with sampled ranks."""
    words = sorted(words)
    ranks, variants.RANKS = variants.RANKS, variants.RANKS if step == 1 else 800
    try:
        fm = variants.Index(words, [])
    finally:
        variants.RANKS = ranks
    letters = set("abé")
    for size in {len(w) for w in words}:
        some = [w for w in words if len(w) == size]
        for prefix in (True, False):
            row, at = fm.one_error(fm.spelled(some), size // 2, prefix)
            h = size // 2
            want = sorted((w, x) for w in some for x in edits(w, letters) & set(words) if (x[:h] == w[:h] and edits(w[h:], letters) & {x[h:]} if prefix else x[len(x) - size + h :] == w[h:] and edits(w[:h], letters) & {x[: len(x) - size + h]}))
            assert sorted((some[i], words[j]) for i, j in zip(row.tolist(), at.tolist())) == want


def test_long_words(spark):
    vocabulary = {"x" * 3000: 50, "x" * 2999 + "y": 3, "x" * 3001: 4, "x" * 40: 2, "z" * 7: 2}
    rows = {r["word"]: r for r in variants.near_words(stored(spark, vocabulary)).collect()}
    assert {len(w): r["n_near"] for w, r in rows.items() if w[-1] != "y"} == {3000: 2, 3001: 1, 40: 0, 7: 0}
    assert rows["x" * 2999 + "y"]["form"] == "x" * 3000


def test_odd_rows(spark, odd):
    more = spark.createDataFrame([(1, "Prefixed PREFIXED préfixed, prefixe-d ÀÉÎÕÜß×÷ ÀÉÎÕÜß×÷ àéîõüß×÷", 1)] * 11 + [(None, "wordless wordless", 2)], "doc_id long, text string, n int")
    docs = odd.select("doc_id", "text", F.lit(1).alias("n")).unionByName(more).withColumn("word", F.lit("w")).withColumn("form", F.lit(1))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(variants.spelling_variants(docs)) == brute(counts(rows)) != []


def test_empty_tables(none, odd):
    for docs in (none, odd.where("text IS NULL")):
        out = variants.spelling_variants(docs)
        assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_parameters_that_searches_rely_on(odd):
    for args in ({"least": 5}, {"ratio": 1}):
        with pytest.raises(ValueError):
            variants.spelling_variants(odd, **args)
