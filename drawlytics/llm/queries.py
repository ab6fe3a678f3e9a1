"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from drawlytics.llm import decontam, lattice, licenses, lines, packing, pii, quality, search, simhash, substring, token_files, urls, variants
from drawlytics.plans.store import session_root

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        _REGISTRY[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(r"""
WITH pages AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, row_number() OVER () AS page FROM documents),
lines AS (SELECT page, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM pages),
counts AS (SELECT host, line, count(DISTINCT page) AS n FROM lines JOIN pages USING (page) GROUP BY ALL),
often AS (SELECT host, line FROM counts JOIN (SELECT host, count(*) AS pages FROM pages GROUP BY host) USING (host) WHERE n >= 5 AND n > 0.05 * pages),
sets AS (SELECT host, list(line) AS drop FROM often GROUP BY host),
cut AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own,
  list_filter(string_split(text, chr(10)), lambda x: NOT (regexp_matches(x, '[^\x20\x09-\x0D]') AND list_contains(coalesce(drop, []), x))) AS rest
  FROM pages LEFT JOIN sets USING (host)),
sized AS (SELECT *, len(own) AS n_lines, len(list_filter(rest, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_left FROM cut)
SELECT doc_id, n_lines::BIGINT AS n_lines, (CASE WHEN n_left > 0 THEN n_lines - n_left ELSE 0 END)::BIGINT AS n_dropped,
  md5(CASE WHEN n_left > 0 THEN array_to_string(rest, chr(10)) ELSE text END) AS kept_md5
FROM sized
""")
def op2_line_dedup(spark, sf_dir):
    out = lines.drop_boilerplate(table(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


@query()
def op3_lm_scoring(spark, sf_dir):
    return lattice.scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query()
def op4_decontamination(spark, sf_dir):
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_quality_rules(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_substring_dedup(spark, sf_dir):
    out = substring.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


RULES = (
    urls.Rule("allow", "com"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
)
#: Hosts with one of these words in a label are on the block list.
LISTED = r"(^|[.-])(spam|casino|adult|pills|bets|ads)([.-]|$)"


@query(r"""
WITH cut AS (SELECT page_id, url, strpos(url, '://') AS place FROM pages),
rests AS (SELECT page_id, CASE WHEN place > 0 THEN substr(url, place + 3) ELSE '' END AS rest FROM cut),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rests),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
ruled AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[.-])(spam|casino|adult|pills|bets|ads)([.-]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
""")
def op7_url_filter(spark, sf_dir):
    return urls.judged(table(spark, sf_dir, "pages"), RULES, F.col("host").rlike(LISTED))


@query()
def op8_license_scan(spark, sf_dir):
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query()
def op9_personal_data(spark, sf_dir):
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


@query()
def op10_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op11_token_files(spark, sf_dir):
    path = f"{session_root(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query(r"""
WITH items AS (SELECT row_number() OVER () AS item, item_id, text FROM benchmark),
wanted AS (SELECT DISTINCT item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
docs AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT doc, doc_id, len(terms)::BIGINT AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized),
uses AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM uses, total GROUP BY term),
scores AS (SELECT item, any_value(item_id) AS item_id, doc, any_value(doc_id) AS doc_id,
  sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms)))))::BIGINT AS score
  FROM wanted JOIN uses USING (term) JOIN weights USING (term) JOIN sized USING (doc), total GROUP BY item, doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
""")
def op12_ranked_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op13_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(table(spark, sf_dir, "documents"))
