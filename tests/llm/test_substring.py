import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from drawlytics.llm import substring


def brute(rows, window=35):
    count = Counter()
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in split:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def digest(df):
    out = df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()
    return Counter(tuple(r) for r in out)


def test_all_documents_equal_brute_force(documents, texts):
    assert digest(substring.without_repeats(documents)) == brute(texts.items())


def test_small_windows_hot_minimisers_and_periods(spark):
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 400, 40)) + "\n" + passage + "\t" + f"tail{i}") for i in range(120)]
    rows += [(500, "a b " * 300), (501, "z " * 700), (502, "a b a b a b a b"), (503, "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for hot_least, bucket_windows in ((0, 50), (5, 1 << 18), (10**6, 50)):
        got = digest(substring.without_repeats(df, window=8, mer=3, hot_least=hot_least, bucket_windows=bucket_windows))
        assert got == brute(rows, 8)


def test_buckets_follow_the_windows_and_hot_minimisers_are_dealt_out():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 1 << 60, 4000).astype(np.uint64)
    bounds = np.array([0, 1000, 4000])
    none = np.empty(0, dtype=np.uint64)
    at, text, plain = substring.minimisers(words, bounds, 35, 5, none)
    assert len(at) == 966 + 2966 and len(np.unique(plain)) > 100
    # With every minimiser hot, windows still meet in runs, and equal ones in one place.
    twice = np.concatenate([words[:1000], words[:1000]])
    hot = np.unique(substring._mer_hashes(twice, 5))
    _, text, value = substring.minimisers(twice, np.array([0, 1000, 2000]), 35, 5, hot)
    assert (value[text == 0] == value[text == 1]).all()
    runs = 1 + np.count_nonzero(value[:966][1:] != value[:966][:-1])
    assert 966 / 20 < runs < 966 / 4


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert digest(substring.without_repeats(odd)) == brute(rows)
    assert substring.without_repeats(none).count() == 0
