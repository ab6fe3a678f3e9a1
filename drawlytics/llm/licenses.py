"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from drawlytics.llm.common import ascii_lower, whole_text
from drawlytics.plans.store import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose words are looked for, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Family:
    """A family of licenses: label, identifier and name as regular expressions, versions ('' for none)."""

    label: str
    ident: str
    name: str
    versions: tuple[str, ...] = ("",)


#: Public license families. Versions are part of the label.
FAMILIES = (
    Family("apache", "apache", r"apache(?: software)?", ("1.0", "1.1", "2.0", "")),
    Family("mit", "mit", r"(?:mit|expat|x11)"),
    Family("bsd-2-clause", "bsd-2-clause", r"(?:bsd 2[- ]clause|simplified bsd|freebsd)"),
    Family("bsd-3-clause", "bsd-3-clause", r"(?:bsd 3[- ]clause|new bsd|modified bsd|revised bsd)"),
    Family("bsd", "bsd", r"bsd"),
    Family("0bsd", "0bsd", r"(?:zero[- ]clause bsd|bsd zero clause)"),
    Family("isc", "isc", r"isc"),
    Family("gpl", "gpl", r"(?:gnu )?(?:general public|gpl)", ("1.0", "2.0", "3.0", "")),
    Family("lgpl", "lgpl", r"(?:gnu )?(?:lesser general public|library general public|lgpl)", ("2.0", "2.1", "3.0", "")),
    Family("agpl", "agpl", r"(?:gnu )?(?:affero general public|agpl)", ("1.0", "3.0", "")),
    Family("gfdl", "gfdl", r"(?:gnu )?(?:free documentation|fdl)", ("1.1", "1.2", "1.3", "")),
    Family("mpl", "mpl", r"mozilla public", ("1.0", "1.1", "2.0", "")),
    Family("epl", "epl", r"eclipse public", ("1.0", "2.0", "")),
    Family("eupl", "eupl", r"european union public", ("1.0", "1.1", "1.2", "")),
    Family("cddl", "cddl", r"common development and distribution", ("1.0", "1.1", "")),
    Family("cpl", "cpl", r"common public", ("1.0", "")),
    Family("osl", "osl", r"open software", ("1.0", "2.0", "2.1", "3.0", "")),
    Family("afl", "afl", r"academic free", ("1.1", "1.2", "2.0", "2.1", "3.0", "")),
    Family("artistic", "artistic", r"artistic", ("1.0", "2.0", "")),
    Family("bsl", "bsl", r"boost software", ("1.0", "")),
    Family("ms-pl", "ms-pl", r"microsoft public"),
    Family("ms-rl", "ms-rl", r"microsoft reciprocal"),
    Family("zlib", "zlib", r"zlib(?:/libpng)?"),
    Family("unlicense", "unlicense", r"unlicense"),
    Family("wtfpl", "wtfpl", r"do what the fuck you want to public"),
    Family("python", "psf", r"python software foundation", ("2.0", "")),
    Family("php", "php", r"php", ("3.0", "3.01", "")),
    Family("ofl", "ofl", r"(?:sil )?open font", ("1.0", "1.1", "")),
    Family("odbl", "odbl", r"open database", ("1.0", "")),
    Family("odc-by", "odc-by", r"open data commons attribution", ("1.0", "")),
    Family("cc0", "cc0", r"(?:creative commons zero|cc0)", ("1.0", "")),
    Family("cc-by", "cc-by", r"(?:creative commons attribution|cc by)", ("1.0", "2.0", "2.5", "3.0", "4.0", "")),
    Family("cc-by-sa", "cc-by-sa", r"(?:creative commons attribution[- ]share ?alike|cc by[- ]sa)", ("1.0", "2.0", "2.5", "3.0", "4.0", "")),
    Family("cc-by-nc", "cc-by-nc", r"(?:creative commons attribution[- ]non ?commercial|cc by[- ]nc)", ("1.0", "2.0", "2.5", "3.0", "4.0", "")),
    Family("cc-by-nd", "cc-by-nd", r"(?:creative commons attribution[- ]no ?deriv(?:ative)?s|cc by[- ]nd)", ("1.0", "2.0", "2.5", "3.0", "4.0", "")),
)
#: Wordings that name no family: label, keyword, expression, priority, confidence.
WORDINGS = (
    ("mit", "hereby", r"permission is hereby granted, free of charge, to any person obtaining", 3, 0.95),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms", 3, 0.95),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software", 3, 0.9),
    ("gpl", "redistribute", r"this program is free software[;:,] you can redistribute it", 3, 0.95),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in)?to the public domain", 2, 0.9),
    ("public-domain", "domain", r"public domain", 1, 0.5),
    ("reserved", "reserved", r"(?:all|some) rights reserved", 1, 0.6),
    ("copyright", "copyright", r"copyright(?: \(c\)| ©)? [0-9]{4}", 1, 0.6),
    ("proprietary", "confidential", r"proprietary and confidential", 2, 0.8),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution)", 2, 0.7),
)


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, expression, priority, confidence) of every rule, in order.

    Each family and version gives an identifier tag, a sentence that grants the
    license, and a mention of its name; each rule is gated by a keyword that all
    its matches hold.
    """
    out = []
    for f in FAMILIES:
        for v in f.versions:
            major = v.removesuffix(".0").replace(".", r"\.") + (r"(?:\.0)?" if v.endswith(".0") else "")
            label = f"{f.label}-{v}" if v else f.label
            tail = rf",?\s+(?:version\s+|v\.?\s*)?{major}(?![.]?[0-9])" if v else ""
            own = f.name.replace(" ", r"\s+")
            ident = f.ident + (rf"-{major}" if v else "") + r"(?:-only|-or-later|\+)?(?![a-z0-9-])"
            more = 1 if v else 0
            out.append((label, "spdx-license-identifier", rf"spdx-license-identifier:\s*{ident}", 8 + more, 1.0))
            out.append((label, "licen", rf"licen[sc]ed\s+under\s+(?:the\s+)?(?:terms\s+of\s+the\s+)?{own}(?:\s+licen[sc]e)?{tail}", 6 + more, 0.95))
            out.append((label, "leased", rf"(?:re)?leased\s+under\s+(?:the\s+)?{own}(?:\s+licen[sc]e)?{tail}", 6 + more, 0.95))
            out.append((label, "licen", rf"(?<![a-z0-9]){own}\s+licen[sc]e{tail}", 4 + more, 0.8))
    out += [(label, word, text.replace(" ", r"\s+"), *rest) for label, word, text, *rest in WORDINGS]
    return out


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table of a fixed, small size, read from one literal."""
    names = ("number", "label", "keyword", "expression", "priority", "confidence")
    rows = json.dumps([dict(zip(names, (k, *r))) for k, r in enumerate(rules())])
    kind = "array<struct<number:int,label:string,keyword:string,expression:string,priority:int,confidence:double>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), kind)))


def phrase_starts(lower: Column, found: Column, phrase: str) -> Column:
    """Word numbers where a phrase's words stand one after the other."""
    own = phrase.split()
    maybe = F.lit(True)
    for w in own:
        maybe = maybe & F.contains(lower, F.lit(w))
    last = F.size(found) - len(own)

    def here(i: Column) -> Column:
        out = F.get(found, i) == own[0]
        for k, w in enumerate(own[1:], 1):
            out = out & (F.get(found, i + k) == w)
        return out

    return F.when(maybe & (last >= 0), F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def detections(texts: DataFrame) -> DataFrame:
    """(row, label, start, end, confidence) of every match that no stronger one holds within itself.

    ``texts``: (row, text), lower-cased. A rule runs only on texts with its
    keyword. A match inside another of at least its priority is dropped, so of
    equal spans the first rule of the highest priority stays.
    """
    table = rule_table(texts.sparkSession)
    keywords = sorted({r[1] for r in rules()})
    with_word = texts.withColumn("keyword", F.explode(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("text"), k))))
    tried = with_word.join(F.broadcast(table), "keyword")
    found = tried.withColumn("match", F.regexp_extract_all("text", F.col("expression"), F.lit(0))).where(F.size("match") > 0)
    gaps = F.transform(F.split("text", F.col("expression"), -1), F.length)
    each = found.select("row", "number", "label", "priority", "confidence", F.posexplode(F.arrays_zip(gaps.alias("gap"), F.transform("match", F.length).alias("size"))).alias("i", "m"))
    before = Window.partitionBy("row", "number").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(before)
    spans = each.withColumn("end", end).where("m.size IS NOT NULL").withColumn("start", F.col("end") - F.col("m.size"))
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "number").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r[3] for r in rules()})
    reach = {p: F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order) for p in levels}
    inside = F.lit(None).cast("long")
    for p in levels:
        inside = F.when(F.col("priority") == p, reach[p]).otherwise(inside)
    return spans.withColumn("inside", inside).where("inside IS NULL OR inside < end").select("row", "label", "start", "end", "confidence")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    Words are lower-cased runs of ASCII letters and digits and of all that is not
    ASCII. ``score`` is the best confidence among the matches, 0.5 for a phrase
    alone, 0 without any. Null and empty texts have no words. Repeated rows and
    null ids come back; other columns are ignored; an empty table gives no rows.
    """
    lower = ascii_lower(whole_text(text_col))
    df = docs.select(F.col(id_col).alias("id"), lower.alias("text")).withColumn("words", F.filter(F.split("text", SEPARATORS), lambda w: w != ""))
    starts = [phrase_starts(F.col("text"), F.col("words"), p) for p in PHRASES]
    keyword = "|".join(sorted({r[1].replace("-", r"\-") for r in rules()}))
    df = df.select("id", F.size("words").cast("long").alias("n_words"), F.array(*starts).alias("starts"), F.when(F.col("text").rlike(keyword), F.col("text")).alias("text"))
    stored = materialize(df.withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = detections(stored.where("text IS NOT NULL").select("row", "text")).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("confidence").alias("best"))
    found = materialize(found, "detections")
    flat = F.flatten("starts")
    own = F.filter(F.array(*[F.when(F.size(F.col("starts")[i]) > 0, label) for i, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    joined = stored.drop("text").join(found, "row", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(flat).cast("long").alias("n_base"),
        F.array_min(flat).cast("long").alias("first_word"),
        F.array_max(flat).cast("long").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, F.coalesce("found", none))), ",").alias("labels"),
        F.coalesce(F.greatest("best", F.when(F.size(flat) > 0, 0.5)), F.lit(0.0)).alias("score"),
    )
