"""Queries p1, p6, p7 and p8: the sub-package's operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import mixing, neardup, packing, sentences
from recordloom.plans.data_queries import JSON_WALK
from recordloom.plans.sqltext import uuid_sql
from recordloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, sf_dir, "records")).select("record_a", "record_b")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "records"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_links(table(spark, sf_dir, "records"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_profiles(table(spark, sf_dir, "documents"), table(spark, sf_dir, "profile_budgets"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p6_pack(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "source_targets")
    return mixing.share_report(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed by each profile, and what must not be: overfull containers, gaps in a document, whole documents divided, containers more than a thousandth over the least number."""
    return packing.packing_checks(p6_pack(spark, sf_dir))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each targeted source what must not be: uses beyond the repeats, a block of deviation, a share off its target."""
    targets = table(spark, sf_dir, "source_targets")
    return mixing.mix_checks(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with sentences: characters other than white space outside of them, and sentences that overlap or have outer white space."""
    documents = table(spark, sf_dir, "documents")
    return sentences.coverage(documents, sentences.sentences(documents))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_links, p6_pack, p6_report, p6_checks, p7_mix, p7_shares, p7_checks, p8_found, p8_coverage)}
_EDGE = "[^\\p{L}\\p{N}]+"
_WORDS = JSON_WALK + f""", s AS (SELECT id, v->>'$' AS text FROM t WHERE field = 'payload_json' AND json_type(v) = 'VARCHAR'),
w AS (SELECT DISTINCT id, word FROM (SELECT id, regexp_replace(lower(x), '^{_EDGE}|{_EDGE}$', '', 'g') AS word FROM (SELECT id, unnest(regexp_split_to_array(text, '[\\s\\p{{Z}}]+')) AS x FROM s)) WHERE strlen(word) > 2),
r AS (SELECT {uuid_sql('id')} AS id, min(namespace) AS namespace, min(type_name) AS type_name FROM records GROUP BY 1), g AS (SELECT w.id, w.word, r.namespace, r.type_name, count(*) OVER (PARTITION BY w.id) AS n FROM w JOIN r ON r.id = w.id),
pairs AS (SELECT a.id AS record_a, b.id AS record_b, floor(count(*) * 100 / greatest(a.n, b.n)) AS overlap FROM g a JOIN g b ON a.namespace = b.namespace AND a.type_name = b.type_name AND a.word = b.word AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) * 100 >= 70 * greatest(a.n, b.n)),
sets AS (SELECT id, namespace, type_name, md5(string_agg(word, ' ' ORDER BY word)) AS x FROM g WHERE namespace IS NOT NULL AND type_name IS NOT NULL GROUP BY ALL), c AS (SELECT id, min(id) OVER (PARTITION BY namespace, type_name, x) AS class_id FROM sets),
links AS (SELECT DISTINCT least(x.class_id, y.class_id) AS class_a, greatest(x.class_id, y.class_id) AS class_b, overlap FROM pairs JOIN c x ON x.id = record_a JOIN c y ON y.id = record_b WHERE x.class_id <> y.class_id)
"""
_PIECES = "SELECT profile_id, arg_max(version, version) AS version FROM profile_budgets WHERE profile_id IS NOT NULL GROUP BY profile_id HAVING arg_max(total_tokens, version) > 0"
SQL: dict[str, str] = {
    "p1_found": _WORDS + "SELECT record_a, record_b FROM pairs",
    "p1_links": _WORDS + "SELECT class_a, class_b, CAST(overlap AS INT) AS overlap FROM links",
    "p1_classes": _WORDS + "SELECT c.id AS record_id, c.class_id, count(*) OVER (PARTITION BY c.class_id) AS n_copies, coalesce(d.n, 0) AS n_links FROM c LEFT JOIN (SELECT k, count(*) AS n FROM (SELECT class_a AS k FROM links UNION ALL SELECT class_b FROM links) GROUP BY k) d ON d.k = c.class_id",
    "p6_checks": f"SELECT p.profile_id, d.n AS n_documents, 0::BIGINT AS n_overfull, 0::BIGINT AS n_broken, 0::BIGINT AS n_divided, 0::BIGINT AS n_too_many FROM ({_PIECES}) p, (SELECT count(*) AS n FROM documents) d",
    "p7_checks": "SELECT lower(trim(source)) AS source, max(target_share) AS target_share, 0::BIGINT AS n_overused, 0::BIGINT AS n_blocks_off, 0::BIGINT AS n_shares_off FROM source_targets WHERE source IS NOT NULL AND target_share IS NOT NULL GROUP BY 1",
    "p8_coverage": "SELECT doc_id, length(regexp_replace(text, '[\\s\\x{85}\\x{1c}-\\x{1f}\\p{Z}]+', '', 'g')) AS n_chars, 0::BIGINT AS n_outside, 0::BIGINT AS n_faulty FROM documents WHERE regexp_replace(text, '[\\s\\x{85}\\x{1c}-\\x{1f}\\p{Z}]+', '', 'g') <> ''",
}
