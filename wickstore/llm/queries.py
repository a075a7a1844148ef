"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wickstore.llm import (
    audit,
    chunks,
    decontaminate,
    kneser_ney,
    lines,
    minhash,
    packing,
    rules,
    shards,
    simple8b,
    toxicity,
    url_rules,
    whitening,
)
from wickstore.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated_lines(table(spark, sf_dir, "documents"), short=True)


def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return simple8b.coded_documents(table(spark, sf_dir, "documents"), path, end=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.balanced(table(spark, sf_dir, "documents"), shards=8)


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return kneser_ney.rated(table(spark, sf_dir, "documents"), trusted).drop("row")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(table(spark, sf_dir, "documents"))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.sequences(table(spark, sf_dir, "documents"), path, end=1)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), count=8)


#: The rules of the URL filter.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_RULES = "VALUES " + ", ".join(str(rule) for rule in URL_RULES)


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {_RULES} AS r(host, path, verdict)")
    return url_rules.judged(table(spark, sf_dir, "pages"), rules)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_line_dedup,
        op2_simple8b,
        op3_toxicity,
        op4_balanced_shards,
        op5_kneser_ney,
        op6_decontaminate,
        op7_quality_rules,
        op8_chunk_dedup,
        op9_packing,
        op10_minhash,
        op11_whitening,
        op12_url_rules,
        op13_filter_audit,
    )
}

# Words of a text with A-Z in lower case and, for test items, ASCII punctuation as white space.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANKS = " " * 32
_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_PLAIN = _WORDS.format(text=f"translate(text, '{_UPPER}{_MARKS}', '{_LOWER}{_BLANKS}')")

ORACLES = {
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
     i AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
     ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
     s AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS s
           FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i)),
     n AS (SELECT item_id, count(*) AS n_item_shingles FROM s GROUP BY item_id),
     m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN s USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item_shingles, n_shared, n_shared / n_item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item_shingles""",
    "op12_url_rules": f"""
WITH r AS (SELECT * FROM ({_RULES}) AS r(rule_host, rule_path, verdict)),
     u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0
                  THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT row_number() OVER () AS n, page_id,
                  translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     m AS (SELECT n, rule_host || rule_path AS rule, verdict,
                  row_number() OVER (PARTITION BY n
                    ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
           FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM m WHERE place = 1) USING (n)""",
    "op13_filter_audit": """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     f AS (SELECT doc_id, part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
                  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
                  + 8 * regexp_matches(t, '[#$%&*|]')::INT
                  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM t),
     l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
     d AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
           FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
     x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
     o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
                  [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM x a, x b, x c, x d, x e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
     s AS (SELECT filter_order, step::INT AS step, bits[step] AS own,
                  coalesce(list_sum(bits[:step - 1]), 0)::INT AS before
           FROM o, (SELECT unnest(range(1, 6)) AS step)),
     r AS (SELECT part, filter_order, step, own,
                  sum(n) FILTER (fails & (before | own) = 0) AS kept,
                  sum(n) FILTER (fails & before = 0 AND fails & own > 0) AS removed,
                  sum(n) FILTER (fails & before > 0 AND fails & own > 0) AS redundant,
                  sum(n) FILTER (fails = own) AS unique_fails,
                  sum(good) FILTER (fails & before = 0 AND fails & own > 0) AS good_lost,
                  sum(toxic) FILTER (fails & before = 0 AND fails & own > 0) AS toxic_lost
           FROM d, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r""",
}
