import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from drawlytics.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def small():
    first, more = [b"", b"a", b"ab", b"\xc3\xa9"], [b"a", b"b", b"ba", b"aba", *[bytes([i]) for i in range(256) if i not in (97, 98)]]
    out = lattice.Lattice({p: i for i, p in enumerate(first)}, {p: len(first) + i for i, p in enumerate(more)})
    out.set_weights(np.random.default_rng(1).uniform(0.1, 1, out.n))
    return out


def every_way(model, word):
    """Sum over all segmentations, one by one, and expected uses."""
    total, uses = 0.0, Counter()

    def go(i, weight, pieces):
        nonlocal total
        if i == len(word):
            p = weight * math.exp(model.weights[model.stop])
            total += p
            for k in [*pieces, model.stop]:
                uses[k] += p
        for j in range(i + 1, len(word) + 1):
            if (k := model.more.get(word[i:j])) is not None:
                go(j, weight * math.exp(model.weights[k]), [*pieces, k])

    for p, k in model.first.items():
        if word.startswith(p):
            go(len(p), math.exp(model.weights[k]), [k])
    return total, {k: v / total for k, v in uses.items()}


def test_forward_sums_every_segmentation(small):
    words = [b"a", b"ab", b"abab", b"babaab", "éab".encode(), b"abaabab"]
    got = small.log_probabilities(words)
    for w, p in zip(words, got):
        total, uses = every_way(small, w)
        assert p == pytest.approx(math.log(total))
        assert small.long_word(w) == pytest.approx(math.log(total))
        block = np.frombuffer(w, np.uint8).reshape(1, -1).astype(np.uint64)
        expected = small.expect(block)
        assert {k: v for k, v in enumerate(expected) if v} == pytest.approx(uses)
        assert {k: v for k, v in enumerate(small.expect_long(w)) if v} == pytest.approx(uses)


def test_words_are_a_distribution(small):
    """All words over two letters, up to a length, weigh less than one, and nearly the mass that stops there."""
    from itertools import product

    words = [bytes(w) for n in range(1, 11) for w in product(b"ab", repeat=n)]
    assert 0 < np.exp(small.log_probabilities(words)).sum() < 1


def check(docs, rows):
    c, ends = Counter(), 0
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in docs}
    for d, t in docs:
        if not held[d]:
            c.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    base = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter()
    for d, t in docs:
        w = (t or "").encode().lower().split()
        want[d, held[d], len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, round(sum(base(c[x]) for x in w) + base(ends), 6)] += 1
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert got == want


def test_base_scores_equal_brute_force(documents, texts):
    rows = lattice.scores(documents, PATH).collect()
    check(list(texts.items()), rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)


def plain_scores(docs, turns=2):
    """Scores by a plain forward and backward sum over probabilities, one distinct word after the other."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    first, more = {}, {}
    for i in range(model.get_piece_size()):
        piece, rank = model.id_to_piece(i), max(0.0, -model.get_score(i))
        if model.is_byte(i):
            more.setdefault(bytes([int(piece[3:5], 16)]), 1e6)
        elif not (model.is_control(i) or model.is_unknown(i)):
            if piece.startswith("\u2581"):
                first.setdefault(piece[1:].encode(), rank)
            elif "\u2581" not in piece:
                more[piece.encode()] = min(rank, more.get(piece.encode(), rank))
    for i in range(256):
        more.setdefault(bytes([i]), 1e6)
    first.setdefault(b"", 0.0)
    uses = [{p: 1 / (r + 10) for p, r in first.items()}, {p: 1 / (r + 10) for p, r in more.items()}]
    stop = 1 / 10

    def forward(word, share):
        a = [share[0][b""]] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            a[j] = share[0].get(word[:j], 0.0) + sum(a[i] * share[1].get(word[i:j], 0.0) for i in range(max(0, j - 60), j))
        return a

    def shares(uses, stop):
        of_first, of_more = sum(uses[0].values()), sum(uses[1].values()) + stop
        return [{p: u / of_first for p, u in uses[0].items()}, {p: u / of_more for p, u in uses[1].items()}], stop / of_more

    counts, ends = Counter(), 0
    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 10:
            counts.update((t or "").encode().lower().split())
            ends += 1
    share, end = shares(uses, stop)
    for _ in range(turns):
        uses, stop = [{p: 0.01 for p in first}, {p: 0.01 for p in more}], 0.01 + len(counts)
        for w in counts:
            a, b = forward(w, share), [0.0] * len(w) + [1.0]
            for i in range(len(w) - 1, -1, -1):
                b[i] = sum(b[j] * share[1].get(w[i:j], 0.0) for j in range(i + 1, min(len(w), i + 60) + 1))
            for j in range(len(w) + 1):
                if w[:j] in first:
                    uses[0][w[:j]] += share[0][w[:j]] * b[j] / a[-1]
                for i in range(max(0, j - 60), j):
                    if w[i:j] in more:
                        uses[1][w[i:j]] += a[i] * share[1][w[i:j]] * b[j] / a[-1]
        share, end = shares(uses, stop)
    total = sum(counts.values()) + ends
    spelled = min(0.5, max(1e-6, sum(n == 1 for n in counts.values()) / total))
    known: dict = {}

    def of(word):
        if word not in known:
            known[word] = math.log10(spelled * forward(word, share)[-1] * end + (1 - spelled) * counts[word] / total)
        return known[word]

    return {d: sum(map(of, (t or "").encode().lower().split())) + math.log10((1 - spelled) * ends / total) for d, t in docs}


def test_scores_equal_a_plain_model(documents, texts):
    """Every score of the table, learned weights included; one document has a word beyond the block size."""
    docs = [(d, t) for d, t in texts.items()]
    spark = documents.sparkSession
    docs.append((100_001, "begin " + "abcde" * 30 + " " + "fg" * 40))
    want = plain_scores(docs)
    got = {r["doc_id"]: r["score"] for r in lattice.scores(spark.createDataFrame(docs, "doc_id long, text string"), PATH).collect()}
    assert got == pytest.approx(want, rel=1e-7)


def test_score_is_the_sum_over_tokens_and_knows_the_language(spark):
    """The same text scores alike in any company, and learned words beat strange ones."""
    docs = [(i, " ".join(f"w{(i * k) % 23}" for k in range(30))) for i in range(1, 80)]
    a, b, c = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    docs += [(a, "w1 w2"), (b, "w1 w2 w1 w2"), (c, "qz jx")]
    rows = {r["doc_id"]: r for r in lattice.scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), PATH).collect()}
    end = 2 * rows[a]["score"] - rows[b]["score"]
    assert end < 0 and rows[a]["score"] > rows[c]["score"] + 5


def test_odd_rows(odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(docs, lattice.scores(odd, PATH).collect())
    assert lattice.scores(none, PATH).count() == 0
    only_held = odd.where("doc_id = 7")
    for r in lattice.scores(only_held, PATH).collect():
        assert math.isfinite(r["score"])
