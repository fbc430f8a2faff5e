"""The registered queries of the operators here, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.alignment import align_documents, alignment_digest
from strandline.llm.common import read_table
from strandline.llm.decontam import find_leaks
from strandline.llm.exact_dedup import exact_dedup
from strandline.llm.extraction import extract_pages
from strandline.llm.hard_negatives import mine_hard_negatives, noisy_labels
from strandline.llm.langid import identify_languages
from strandline.llm.license_scan import license_digest, scan_licenses
from strandline.llm.near_dup import near_duplicates
from strandline.llm.packing import pack_documents
from strandline.llm.pii import find_personal_data
from strandline.llm.sharding import shard_documents
from strandline.llm.toxicity import score_toxicity
from strandline.llm.url_filter import captures_of, entries_of, filter_captures


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return filter_captures(captures_of(pages), entries_of(pages))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(noisy_labels(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(align_documents(read_table(spark, sf_dir, "documents")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(read_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_sharding, op3_extraction, op4_exact_dedup, op5_decontamination, op6_near_dup, op7_toxicity, op8_language_id, op9_pii, op10_packing, op11_hard_negatives, op12_alignment, op13_license_scan)}

ORACLES = {
    "op1_url_filter": r"""
        WITH captures AS (
            SELECT page_id, url, DATE '2023-01-01' + CAST((page_id * 37) % 1096 AS INTEGER) AS fetched_on,
                   lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]*)', 1)) AS host,
                   lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS path
            FROM pages
        ), hosts AS (
            SELECT DISTINCT host, string_split(path, '/')[2] AS section, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS c FROM captures WHERE host <> ''
        ), dated AS (
            SELECT *, DATE '2023-01-01' + CAST(c % 700 AS INTEGER) AS d, regexp_replace(host, '^[^.]*[.]', '') AS parent FROM hosts
        ), entries AS (
            SELECT 'host' AS kind, host AS pattern, d AS valid_from, d + 90 AS valid_to FROM dated WHERE c % 3 = 0
            UNION SELECT 'host', host, d + 400, DATE '9999-12-31' FROM dated WHERE c % 3 = 0
            UNION SELECT 'domain', parent, min(d) + 30, DATE '9999-12-31' FROM dated WHERE c % 5 = 0 AND parent LIKE '%.%.%' GROUP BY parent
            UNION SELECT 'prefix', host || '/' || section, d + 10, d + 210 FROM dated WHERE c % 4 = 0 AND section <> ''
        ), hits AS (
            SELECT c.page_id, count(*) AS n_entries, min('rules|' || kind || '|' || pattern) AS first_entry
            FROM captures c JOIN entries e ON c.fetched_on >= e.valid_from AND c.fetched_on < e.valid_to AND (
                kind = 'host' AND host = pattern OR kind = 'domain' AND (host = pattern OR ends_with(host, '.' || pattern))
                OR kind = 'prefix' AND (host || path = pattern OR starts_with(host || path, pattern || '/')))
            GROUP BY 1
        )
        SELECT page_id, url, fetched_on, n_entries IS NOT NULL AS blocked, coalesce(n_entries, 0) AS n_entries, first_entry
        FROM captures LEFT JOIN hits USING (page_id)
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_hard_negatives": """
        WITH vectors AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS whole
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.whole, b.whole), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.whole) = len(b.whole)
        ), positives AS (
            SELECT anchor_id, id, score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        ), negatives AS (
            SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
            FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
              AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM negatives WHERE rank <= 10
    """,
}
