import re

from drawlytics.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(licenses.SEPARATORS and "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w, starts, labels = WORD.findall((text or "").translate(LOWER)), [], set()
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        here = [i for i in range(len(w) - len(own) + 1) if w[i : i + len(own)] == own]
        starts += here
        labels |= {label} if here else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def survivors(text):
    """Labels by brute force: every rule on the text, then pairwise containment."""
    text = text.translate(LOWER)
    found = []
    for number, (label, keyword, expression, priority, _) in enumerate(licenses.rules()):
        for m in re.finditer(expression, text):
            assert keyword in text
            found.append((m.start(), m.end(), priority, number, label))
    keep = set()
    for d in found:
        better = [e for e in found if e is not d and e[2] >= d[2] and e[0] <= d[0] and e[1] >= d[1] and ((e[0], -e[1], -e[2], e[3]) < (d[0], -d[1], -d[2], d[3]))]
        if not better:
            keep.add(d[4])
    return keep


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "SPDX-License-Identifier: GPL-3.0-or-later\nand CC BY 4.0, cc-by; All rights reserved.",
    "Released under the MIT License. released under the mit license",
    "This work is licensed under the GNU General Public License, version 3.",
    "Creative Commons Attribution-ShareAlike license 4.0 and all all rights reserved rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "GNU Lesser General Public License v2.1 (c) Copyright 2001; public domain",
    "nothing at all",
]


def test_hundreds_of_rules_each_behind_its_keyword():
    rules = licenses.rules()
    assert len(rules) > 300
    for _, keyword, expression, _, _ in rules:
        re.compile(expression)


def test_labels_equal_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scanned(rows).collect()}
    for i, t in enumerate(TEXTS):
        b = base(t)
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == b
        want = survivors(t) | set(filter(None, b[4].split(",")))
        assert got[i]["labels"] == ",".join(sorted(want))
        assert 0 <= got[i]["score"] <= 1 and (got[i]["score"] > 0) == bool(want)


def test_all_documents_equal_brute_force(documents, texts):
    for r in licenses.scanned(documents).collect():
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == base(texts[r["doc_id"]])


def test_odd_rows(odd, none):
    out = licenses.scanned(odd).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in out) == sorted((str(r["doc_id"]), base(r["text"])[0]) for r in odd.collect())
    assert licenses.scanned(none).count() == 0


def test_wrapped_wordings_are_found(spark):
    texts = [
        "released\nunder the Mozilla Public, version 2.0",
        "Permission is\nhereby granted, free of\n charge, to any person obtaining a copy",
        "Redistribution and\nuse in source  and binary forms",
        "This program is free\nsoftware; you can\tredistribute it",
        "All rights\nreserved",
        "in the public\ndomain",
    ]
    got = licenses.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {r["doc_id"]: r["labels"].split(",") for r in got}
    assert "mpl-2.0" in found[0]
    assert all(label in found[i] for i, label in enumerate(["mit", "bsd", "gpl", "reserved", "public-domain"], 1))


def test_keywords_hold_no_white_space():
    assert not any(" " in r[1] for r in licenses.rules())
