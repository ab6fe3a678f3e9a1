import hashlib
import re
from collections import Counter

from drawlytics.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def rows_of(df):
    return Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.digest(pii.spans(df)).collect())


def wanted(rows):
    out = Counter()
    for d, t in rows:
        s = base(t or "")
        n = Counter(x.split(":")[0] for x in s.split(",") if x)
        out[d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(s.encode()).hexdigest()] += 1
    return out


CASES = [
    "a@b.c%x@d.e f..g@h.i. j@k @l.m n@o..p .q@r.s-t.u_ v@w.x@y.z",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.002.0003.255 1.2.3 99999999999999999999.1.1.1 0.0.0.0.",
    "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111 -4111111111111111- 4111111111111112 1 2 3",
    "+1 (428) 555-5743 +12 +1234567 +1.2.3.4.5.6.7.8 + 1234567890 ++4912345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "é𝒳é a@b.cd 𝒳 10.0.0.1",
    "x" * 20000 + "@" + "y." * 20000 + "z 1" + " 1" * 20000 + "." * 500 + "9" * 20000 + ".1.1.1 +" + "1-" * 9000,
    "a" * 300000,
    None,
    "",
]


def test_fixed_patterns_equal_the_plain_expressions(spark):
    rows = list(enumerate(CASES))
    assert rows_of(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows)


def test_all_documents_equal_the_plain_expressions(documents, texts):
    assert rows_of(documents) == wanted(texts.items())


def card(i):
    body = f"{400000000000000 + i * 7919}"
    return next(body + str(k) for k in range(10) if luhn(body + str(k)))


def test_a_reliable_context_discovers_what_the_fixed_patterns_miss(spark):
    rows = [(i, f"some text card: {card(i)} and more") for i in range(20)]
    bad = str(int(card(50)) + 1)
    rows += [(100, f"he paid, card: {bad} again"), (101, f"in other places {bad} means nothing"), (102, f"order {card(3)}")]
    rows += [(200 + i, f"order {int(card(i)) + 1}") for i in range(30)]
    out = {r["doc_id"]: r["spans"] for r in pii.digest(pii.spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out[100] == "card:15:31" and out[101] == "" and all(out[200 + i] == "" for i in range(30))
    assert out[5] == "card:16:32" and out[102] == "card:6:22"


def discovered(spark, texts, **args):
    """Added spans by text number, as strings of the text."""
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in pii.spans(rows, **args).collect():
        new = [x for x in r["spans"] if x not in r["base"]]
        if new:
            out[r["doc_id"]] = [(pii.KINDS[x["k"] - 1], texts[r["doc_id"]][x["start"] : x["end"]]) for x in new]
    return out


def test_every_kind_finds_what_its_expression_misses(spark):
    """Phones without +, addresses written out, numbers that fail the check sum; the same forms elsewhere stay."""
    texts = [f"call phone: +1 555 010 {1000 + i}" for i in range(30)] + [f"call phone: 1 555 010 {2000 + i}" for i in range(5)]
    texts += [f"mail me at user{i}@host.org" for i in range(30)] + [f"mail me at user{i} (at) host.org" for i in range(100, 105)]
    texts += [f"from ip 10.0.{i}.7 here" for i in range(30)] + ["from ip 300.1.2.3 here", "version 300.1.2.3"]
    texts += [f"order no 1 555 010 {3000 + i}" for i in range(20)] + ["we met (at) noon", "see this[at]once"]
    got = discovered(spark, texts)
    assert got == {
        **{30 + i: [("phone", f"1 555 010 {2000 + i}")] for i in range(5)},
        **{65 + i: [("email", f"user{100 + i} (at) host.org")] for i in range(5)},
        100: [("ip", "300.1.2.3")],
    }


def test_accepted_values_induce_patterns(spark):
    """Numbers found behind ``phone:`` also stand behind ``dial``; what else stands there is found a turn later."""
    texts = [f"phone: +1 555 010 {1000 + i}" for i in range(60)]
    texts += [f"phone: 1 555 011 {1000 + i}" for i in range(12)] + [f"dial 1-555-011-{1000 + i}" for i in range(12)]
    texts += ["dial 1 555 012 9999", "weigh 1 555 013 9999"]
    one, more = discovered(spark, texts, turns=1), discovered(spark, texts)
    assert set(one) == set(range(60, 72)) and set(more) == set(range(60, 85))
    assert more[84] == [("phone", "1 555 012 9999")]


def plain_discovery(spans, turns, min_seeds, min_score):
    """The graph in plain Python. ``spans``: (span, label or None, value, patterns)."""
    uses = Counter((p, v) for _, _, v, ps in spans for p in ps)
    total = Counter()
    for (p, _), n in uses.items():
        total[p] += n
    known = {v: (label, 1.0) for _, label, v, _ in spans if label}
    trusted = {}
    for turn in range(turns):
        sums, seeds = Counter(), Counter()
        for (p, v), n in uses.items():
            if v in known:
                sums[p, known[v][0]] += n * known[v][1]
                seeds[p, known[v][0]] += 1
        score = {k: round(s / total[k[0]] * seeds[k] / (seeds[k] + 1), 9) for k, s in sums.items()}
        trusted = {p: (label, s) for (p, label), s in score.items() if s >= min_score and seeds[p, label] >= min_seeds}
        doubts = {}
        for p, v in uses:
            if p in trusted and v not in known:
                doubts[v] = trusted[p][0], doubts.get(v, (None, 1.0))[1] * (1 - trusted[p][1])
        new = {v: (label, round(1 - d, 9)) for v, (label, d) in doubts.items() if round(1 - d, 9) >= min_score}
        if turn == turns - 1 or not new:
            break
        known |= new
    return {s: max((trusted[p][1], trusted[p][0]) for p in ps if p in trusted)[1] for s, label, _, ps in spans if not label and any(p in trusted for p in ps)}


def test_graph_equals_the_plain_version(spark):
    import random

    rng = random.Random(4)
    contexts = [f"word{i}" for i in range(12)]
    rows, plain = [], []
    for i in range(900):
        number = f"1555{rng.randrange(150):03d}0000"
        left, right = rng.choice(contexts), rng.choice(contexts)
        seed = rng.random() < (0.9 if left in contexts[:4] else 0.1)
        text = f"{left} {'+' if seed else ''}{number} {right}"
        start = len(left) + 1
        rows.append((i, text))
        plain.append(((i, start, start + len(number) + seed), "phone" if seed else None, number, [f"< {left}", f"> {right}"]))
    want = plain_discovery(plain, 3, 3, 0.6)
    out = {r["doc_id"]: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {(i, x["start"], x["end"]): pii.KINDS[x["k"] - 1] for i, r in out.items() for x in r["spans"] if x not in r["base"]}
    assert got == want and len(want) > 20


def test_odd_rows(odd, none):
    assert rows_of(odd) == wanted([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert pii.spans(none).count() == 0
