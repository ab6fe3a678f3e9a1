import re
from collections import Counter

from pyspark.sql import functions as F

from drawlytics.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_statistics_equal_brute_force(spark, sf_dir, documents, texts, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.report(documents, labels).collect()
    names = [*quality.BASE, "base_failed"]
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in out} == {d: brute(t) for d, t in texts.items()}
    assert all(r["kept"] == (not r["base_failed"] and r["rule"] is None) for r in out)
    stats = quality.with_statistics(odd)
    for r in stats.select("text", *[F.col(quality.P + c).alias(c + "_") for c in quality.BASE]).collect():
        assert tuple(r[c + "_"] for c in quality.BASE) == brute(r["text"])[:5]


def test_learned_list_finds_planted_rules(spark):
    """Shouting or symbols make a document bad; a seventh of the rows is held out and judged."""
    rows = []
    for i in range(600):
        word = f"w{i % 7}ord"
        text = " ".join(f"{word}{k}" for k in range(80))
        bad = i % 5 == 0
        if bad:
            text = text.upper() if i % 2 else text.replace(" ", " ## ")
        rows.append((i, text, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = {r["doc_id"]: r for r in quality.report(df, df.where("doc_id % 7 != 3")).collect()}
    assert all(out[i]["kept"] == bool(q) for i, _, q in rows)
    assert all((out[i]["rule"] is None) == bool(q) for i, _, q in rows)


def test_held_out_accuracy(spark):
    """On the larger table, rules learned from nine tenths of the labels keep the good of the rest."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = labels.where("doc_id % 5 = 0")
    r = quality.report(docs, labels.where("doc_id % 5 != 0")).join(held, "doc_id").where("NOT base_failed")
    n, right, good, lost = r.agg(F.count("*"), F.count_if(F.col("kept") == (F.col("quality") == 1)), F.sum("quality"), F.count_if(F.expr('NOT kept AND quality = 1'))).first()
    assert right >= 0.9 * n and lost <= 0.05 * good


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 0), (3, None)], "doc_id long, quality int")
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 7}
    assert quality.report(odd, labels.where("false")).count() == odd.count()
    assert quality.report(none, labels).count() == 0
