import random

import xxhash

from drawlytics.llm import graph, simhash


def brute(text):
    words = (text or "").encode().lower().split()
    grams = [words] if 0 < len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(b" ".join(g), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def groups(prints):
    """id list of each component, by checking every pair."""
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_all_documents_equal_brute_force(documents, texts):
    prints = {d: brute(t) for d, t in texts.items()}
    component = groups(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    assert got == {d: (f"{prints[d]:016x}", component[d]) for d in texts}


def test_close_pairs_are_all_found(spark):
    rng = random.Random(5)
    values = [0, -1, (1 << 63) - 1]
    for _ in range(40):
        v = rng.getrandbits(64)
        values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) * (1 << rng.randrange(64)) for _ in range(6)]
    mask = (1 << 64) - 1
    values = sorted({(v & mask) - (1 << 64) * ((v & mask) >> 63) for v in values})
    rows = spark.createDataFrame([(v,) for v in values], "_simhash long")
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if bin((a ^ b) & mask).count("1") <= 2}
    assert {tuple(r) for r in simhash.close_pairs(rows).collect()} == want


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{k: 1 for k in range(2, 40)}}


def test_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    of = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got}
    assert of[3] == of[4] == of[5] == ("0" * 16, 3)
    assert of[2] == of[1] and of[1][1] == 1
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 7 is 1 with two more lines, a near copy.
    assert of[7][1] == 1
    assert sorted(i for i in ids if i) == [1, 3, 6, 8, 9] and ids.count(None) == 1
    assert simhash.near_duplicates(none).count() == simhash.first_of_each(none).count() == 0
