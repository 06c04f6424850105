"""The corpus operators as registered queries, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language_id, language_model, licences, main_text, mixing, neardup, packing, repetition, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), columns=["doc_id", "source", "lang"])
    return mixed.select(
        "doc_id", "source", "lang",
        F.col("__mix_topic").alias("topic"), F.col("__mix_tokens").alias("n_tokens"),
        F.col("__mix_probability").alias("probability"), F.col("__mix_drawn").alias("drawn"),
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("longest_repeat")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), width=2)


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_license_scans, op2_mix_sources, op3_html_extraction, op4_packing, op5_quality_rules, op6_document_fingerprints, op7_warc, op8_language_id, op9_minhash_near_dedup, op10_language_model)
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Prefixes of the rarest shingles give all pairs that can reach the limit; links are then counted in full.
_NEAR = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT doc_id, hash(s) AS s FROM (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS place, n FROM sh JOIN n USING (doc_id) JOIN (SELECT s, count(*) AS f FROM sh GROUP BY s) USING (s)),
prefix AS (SELECT doc_id, s FROM ranked WHERE 100 * place <= 20 * n + 100),
candidates AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM prefix a JOIN prefix b ON a.s = b.s AND a.doc_id < b.doc_id),
links AS (SELECT x, y FROM candidates JOIN sh a ON a.doc_id = x JOIN sh b ON b.doc_id = y AND a.s = b.s JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y GROUP BY x, y, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM reach r JOIN (SELECT x, y FROM links UNION ALL SELECT y, x FROM links) l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)"""
#: A repeat of n words exists where a window of n words is found twice, so windows of the rules' lengths stand for suffix arrays.
_REPEATS = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
base AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols FROM w),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
sizes AS (SELECT doc_id, w, unnest([5, 15, least(200, greatest(40, len(w) // 10 + 1))]) AS size, unnest(['n_repeat_words', 'covered_words', 'long']) AS kind FROM w),
windows AS (SELECT doc_id, kind, size, i, hash(array_to_string(w[i : i + size - 1], ' ')) AS h FROM (SELECT doc_id, kind, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM sizes)),
found AS (SELECT doc_id, kind, size, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, kind, h) > 1),
cover AS (SELECT doc_id, kind, count(*) AS words FROM (SELECT DISTINCT doc_id, kind, i + k AS word FROM (SELECT doc_id, kind, i, unnest(range(0, size)) AS k FROM found WHERE kind <> 'long')) GROUP BY ALL),
a AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.words, 0) AS n_repeat_words, coalesce(c.words, 0) AS covered_words, EXISTS (SELECT 1 FROM found f WHERE f.kind = 'long' AND f.doc_id = b.doc_id) AS long FROM base b LEFT JOIN lines USING (doc_id) LEFT JOIN cover r ON r.doc_id = b.doc_id AND r.kind = 'n_repeat_words' LEFT JOIN cover c ON c.doc_id = b.doc_id AND c.kind = 'covered_words')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT long AND NOT 100 * covered_words > 15 * n_words AS kept FROM a"""
_WARC = """SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN strlen(coalesce(html, '')) >= 1000 AND page_id <> max(page_id) OVER same THEN max(page_id) OVER same END AS refers_to FROM pages WINDOW same AS (PARTITION BY coalesce(html, ''))"""
#: Models, trained scores, tokenisers and Spark's hashes are beyond SQL.
ORACLES: dict[str, str] = {"op5_quality_rules": _REPEATS, "op7_warc": _WARC, "op9_minhash_near_dedup": _NEAR}
