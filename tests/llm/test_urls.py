import numpy as np
from pyspark.sql import functions as F

from drawlytics.llm import queries, urls


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20000).select(F.concat(F.lit("host"), F.col("id"), F.lit(".org")).alias("host"))
    # Few bits and one hash: many false positives, so many levels.
    universe = urls.with_keys(keys, F.col("host")).withColumn("listed", F.crc32("host") % 7 == 0)
    rows = universe.collect()
    cascade = urls.build(universe, bits_per_key=3, hashes=1)
    h1, h2 = (np.array([r[f"_url_{c}"] for r in rows], dtype=np.int64).view(np.uint64) for c in ("h1", "h2"))
    assert cascade.listed(h1, h2).tolist() == [r["listed"] for r in rows]
    assert len(cascade.levels) > 3


def test_parts_of_a_long_list_agree(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), F.col("id")).alias("host"))
    rows = urls.with_keys(keys, F.col("host"))
    universe = rows.withColumn("listed", F.crc32("host") % 3 == 0)
    for shard_keys in (100, 10**6):
        out = urls.with_listed(rows, universe.drop("host"), shard_keys)
        assert out.count() == 3000 and out.where("_url_listed != (crc32(host) % 3 = 0)").count() == 0


def test_rules_and_odd_urls(spark):
    cases = {
        "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://m.www.example.com/en/": ("m.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
        "http://com": ("com", "", None, "allow"),
        "ftp://x.net/fr/://y": ("x.net", "/fr/://y", "net/fr/", "block"),
        "http://spam-farm.org?x": ("spam-farm.org", "", None, "block"),
        "http://spammer.org/": ("spammer.org", "/", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)] + [(None, "http://com", "x"), (0, "http://A.Example.COM/en/x?q#f", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = urls.judged(df, queries.RULES, F.col("host").rlike(queries.LISTED))
    got = [(r["page_id"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(i, cases[u]) for i, u, _ in rows], key=str)
    assert urls.judged(df.where("false"), queries.RULES, F.lit(True)).count() == 0
