import random

from drawlytics.llm import decontam

ITEM = "the quick brown fox jumps over one lazy dog while nine small birds look on from the old tree".split()


def run(spark, docs, items, **args):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_equal"], r["n_item"]) for r in decontam.contaminations(d, b, **args).collect()}


def test_substitutions_are_tolerated(spark):
    rng = random.Random(1)
    docs, n = [], len(ITEM)
    for i in range(60):
        own = list(ITEM)
        for k in rng.sample(range(n), i % 7):
            own[k] = "changed"
        docs.append((i, "Before, " * 5 + ", ".join(own).upper() + " after!"))
    got = run(spark, docs, [(1, " ".join(ITEM)), (2, "too short"), (3, None)])
    tolerated = {i for i in range(60) if n - i % 7 >= 0.8 * n}
    found = {d for d, item in got}
    assert found <= tolerated and {i for i in tolerated if i % 7 <= 2} <= found and len(found) >= 0.9 * len(tolerated)
    assert all(v == (5, n - d % 7, n) for (d, _), v in got.items())


def test_cut_lengthened_and_short_items(spark):
    """An item cut at either end of a document, one with added or missing words, and short items word for word."""
    own, n = list(ITEM), len(ITEM)
    docs = [
        (1, "x y z " + " ".join(own[:17])),
        (2, " ".join(own[2:]) + " and more"),
        (3, "x " + " ".join([*own[:9], "really", *own[9:]])),
        (4, "x " + " ".join([*own[:6], "a", "b", "c", *own[6:13], *own[14:]])),
        (5, " ".join(own[:14])),
        (6, "q q " + " ".join(own[:8] + "far away from here stand many other words of no use".split() + own[8:])),
        (7, "so seven words make THIS short item, yes"),
        (8, "so seven words make this other item"),
        (9, "one two three"),
    ]
    items = [(1, " ".join(ITEM)), (2, "Seven words make this short item yes"), (3, "one two three")]
    got = run(spark, docs, items)
    assert got == {(1, 1): (3, 17, n), (2, 1): (0, n - 2, n), (3, 1): (1, n, n), (4, 1): (1, n - 1, n), (7, 2): (1, 7, 7)}
    assert run(spark, docs, items, min_exact=3)[9, 3] == (0, 3, 3)


def test_every_alignment_of_the_tables(spark, sf_dir, documents, texts):
    """Against all alignments of all documents and items, tried one by one without seeds."""
    import re

    import numpy as np

    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    number: dict = {}

    def numbers(text):
        return np.array([number.setdefault(w, len(number)) for w in word.findall(text.lower())], dtype=np.int64)

    items = {r["item_id"]: numbers(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {}
    for d, t in texts.items():
        own = numbers(t)
        order, sorted_own = np.argsort(own, kind="stable"), np.sort(own)
        for i, item in items.items():
            lo, hi = np.searchsorted(sorted_own, item, "left"), np.searchsorted(sorted_own, item, "right")
            starts = [s for p, (a, b) in enumerate(zip(lo, hi)) for s in (order[a:b] - p).tolist()]
            if starts:
                first, same = np.unique(starts, return_counts=True)
                if same.max() >= np.ceil(0.8 * len(item) - 1e-9):
                    want[d, i] = int(same.max())
    got = {(r["doc_id"], r["item_id"]): r["n_equal"] for r in decontam.contaminations(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert want and {k: got.get(k) for k in want} == want
    assert all(k in want or v >= 0.8 * len(items[k[1]]) for k, v in got.items())


def test_exact_passages_of_the_tables(spark, sf_dir, documents, texts):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r["item_id"]: " " + " ".join(word.findall(r["text"].lower())) + " " for r in bench.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if x in " " + " ".join(word.findall(t.lower())) + " "}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(documents, bench).where("n_equal = n_item").collect()}
    assert got == whole and whole


def test_shards_find_the_same(spark):
    items = [(i, " ".join(f"item{i}word{k}" for k in range(20))) for i in range(9)]
    docs = [(i, "x " * i + t + " y") for i, t in items]
    assert run(spark, docs, items, shard_chars=400) == run(spark, docs, items) == {(i, i): (i, 20, 20) for i in range(9)}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, " ".join(f"word{i % 37}x{i}" for i in range(40, 70)), "q")], "item_id long, text string, row string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminations(odd, bench).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (7, 1)]
    kept = decontam.clean(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert decontam.contaminations(none, bench).count() == 0
    assert decontam.contaminations(odd, bench.where("false")).count() == 0
    assert decontam.clean(odd, bench.where("false")).count() == odd.count()
