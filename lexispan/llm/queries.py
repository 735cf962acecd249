"""Queries of the training-data problems, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions import letters as letter_tables
from lexispan.llm import frequency, leakage, overlap, packing, reading, splits, topn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = overlap.split_overlaps(_table(spark, sf, "encoded_segments"))
    return found.select(F.least("train_id", "held_id").alias("segment_id_a"), F.greatest("train_id", "held_id").alias("segment_id_b"))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(overlap.split_overlaps(_table(spark, sf, "encoded_segments")), _table(spark, sf, "canonical_manifest"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_in_groups(topn.latest_masses(_table(spark, sf, "surface_usage")), "form_key", "expected_mass", "surface", 5)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    marked = p3_terms(spark, sf)
    return marked.where(F.col("mark").isNotNull()).select("token", "mark")


def p3_terms(spark: SparkSession, sf: str) -> DataFrame:
    reports = frequency.valid_reports(_table(spark, sf, "pre_m0_single_letter_by_file"))
    marked = frequency.marked_terms(reports, record="file", term="token", count="count")
    return marked.select(F.col("term").alias("token"), F.col("records").alias("files"), "occurrences", "mark")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.torn_groups(_table(spark, sf, "canonical_manifest"), _table(spark, sf, "text_credits"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    return splits.all_groups(_table(spark, sf, "canonical_manifest"), _table(spark, sf, "text_credits"))


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.grouped_splits(_table(spark, sf, "canonical_manifest"), _table(spark, sf, "text_credits"))


def p4_segment_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.segment_splits(_table(spark, sf, "encoded_segments"), p4_splits(spark, sf))


def p5_windows(spark: SparkSession, sf: str) -> DataFrame:
    return packing.document_windows(_table(spark, sf, "documents"))


def p5_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.window_fill(p5_windows(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).select("doc_id", "item_id")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    items = _table(spark, sf, "benchmark")
    return leakage.leak_report(leakage.leaks(_table(spark, sf, "documents"), items, coverage=0.8), items)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def p7_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reading.level_profile(p7_found(spark, sf), _table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_found, p1_report, p2_found, p3_found, p3_terms, p4_found, p4_groups, p4_splits, p4_segment_splits,
        p5_windows, p5_fill, p6_found, p6_report, p7_found, p7_profile,
    )
    return {q.__name__: q for q in found}


def letters_sql(column: str) -> str:
    """SQL for the letters of a text."""
    x = f"regexp_replace({column}, '[\\p{{Cf}}]', '', 'g')"
    x = f"regexp_replace({x}, '([क-हळ])', '\\1\ue000', 'g')"
    x = f"replace(regexp_replace({x}, '\ue000([ा-्ॢॣ])', '\\1', 'g'), '\ue000', 'a')"
    tables = (
        letter_tables.DEVANAGARI_VOWELS, letter_tables.DEVANAGARI_SIGNS, letter_tables.DEVANAGARI_CONSONANTS,
        letter_tables.DEVANAGARI_MARKS, letter_tables.DEVANAGARI_OM,
    )
    every = {k: v for table in tables for k, v in table.items()}
    for k, v in every.items():
        if len(v) > 1:
            x = f"replace({x}, '{k}', '{v}')"
    single = {k: v for k, v in every.items() if len(v) == 1}
    x = f"translate({x}, '{''.join(single)}', '{''.join(single.values())}')"
    return f"regexp_replace(lower(strip_accents({x})), '[^\\p{{L}}]', '', 'g')"


def words_sql(column: str) -> str:
    """SQL for the letters of the words of a text, with a space between words."""
    spaced = letters_sql(f"regexp_replace({column}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Cf}}]+', 'Ω', 'g')")
    return f"trim(regexp_replace({spaced}, 'ω+', ' ', 'g'))"


_VALID_SEGMENTS = f"""
valid AS (
  SELECT segment_id, nullif(lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')), '') AS split, text
  FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY encoded_at DESC NULLS LAST, text DESC NULLS LAST, split DESC NULLS LAST) AS rn
        FROM encoded_segments WHERE segment_id IS NOT NULL) WHERE rn = 1),
lettered AS (SELECT segment_id, split, {letters_sql("text")} AS letters FROM valid WHERE text IS NOT NULL AND split IN ('train', 'dev', 'test')),
lines AS (SELECT *, length(letters) AS size FROM lettered WHERE length(letters) >= 30),
links AS (
  SELECT a.segment_id AS train_id, b.segment_id AS held_id, b.split AS held_split, levenshtein(a.letters, b.letters) AS edits, greatest(a.size, b.size) AS size
  FROM lines a JOIN lines b ON a.split = 'train' AND b.split <> 'train' AND abs(a.size - b.size) * 100 <= 15 * greatest(a.size, b.size)
  WHERE levenshtein(a.letters, b.letters) * 100 <= 15 * greatest(a.size, b.size))
"""

_REPORTS = """
plain AS (
  SELECT regexp_replace(replace(file, '\\', '/'), '^(\\./)+', '') AS file,
         nfc_normalize(lower(nfc_normalize(regexp_replace(token, '^[\\s\\p{Z}\\p{Cf}\\p{Cc}]+|[\\s\\p{Z}\\p{Cf}\\p{Cc}]+$', '', 'g')))) AS token, count, audited_at
  FROM pre_m0_single_letter_by_file WHERE file IS NOT NULL AND token IS NOT NULL AND count IS NOT NULL),
valid AS (
  SELECT file, token, count
  FROM (SELECT *, row_number() OVER (PARTITION BY file, token ORDER BY audited_at DESC NULLS LAST, count DESC) AS rn FROM plain WHERE token <> '') WHERE rn = 1),
terms AS (SELECT token, count(*) AS files, CAST(sum(count) AS BIGINT) AS occurrences FROM valid GROUP BY token),
marked AS (
  SELECT token, files, occurrences,
         CASE WHEN files < 3 OR occurrences < 5 THEN 'rare' WHEN files >= 0.5 * (SELECT count(DISTINCT file) FROM valid) THEN 'common' END AS mark
  FROM terms)
"""


_GROUPS = f"""named AS (
  SELECT document_id, lower(trim(kind)) AS kind, {letters_sql("name")} AS letters, {words_sql("name")} AS words FROM text_credits
  WHERE document_id IS NOT NULL AND name IS NOT NULL AND lower(trim(kind)) IN ('author', 'work')),
ties AS (SELECT DISTINCT document_id, kind || ':' || letters AS credit FROM named WHERE letters <> ''
  AND NOT (kind = 'author' AND (regexp_matches(words, '{splits.UNKNOWN}') OR regexp_matches(letters, '{splits.UNKNOWN_COMPOUND}')))),
reach(document_id, other) AS (
  SELECT document_id, document_id FROM (SELECT DISTINCT document_id FROM ties)
  UNION
  SELECT r.document_id, b.document_id FROM reach r JOIN ties a ON a.document_id = r.other JOIN ties b ON b.credit = a.credit),
groups AS (SELECT document_id, min(other) AS group_id FROM reach GROUP BY document_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_VALID_SEGMENTS} SELECT least(train_id, held_id) AS segment_id_a, greatest(train_id, held_id) AS segment_id_b FROM links",
        "p1_report": f"""WITH {_VALID_SEGMENTS},
linked AS (SELECT held_id, held_split, count(*) AS links, min(edits) AS edits FROM links GROUP BY ALL),
sources AS (SELECT document_id, source FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY built_at DESC NULLS LAST, source DESC NULLS LAST) AS rn
  FROM canonical_manifest WHERE document_id IS NOT NULL) WHERE rn = 1)
SELECT held_split AS split, source, count(*) AS segments, CAST(sum(links) AS BIGINT) AS links, count(*) FILTER (WHERE edits = 0) AS exact_segments
FROM linked LEFT JOIN sources ON document_id = split_part(held_id, ':', 1) GROUP BY ALL""",
        "p2_found": """
WITH valid AS (
  SELECT form_key, surface, expected_mass
  FROM (SELECT *, row_number() OVER (PARTITION BY form_key, surface ORDER BY exported_at DESC NULLS LAST, expected_mass DESC) AS rn FROM surface_usage
        WHERE form_key IS NOT NULL AND surface IS NOT NULL AND expected_mass IS NOT NULL AND NOT isnan(expected_mass)) WHERE rn = 1),
ranked AS (SELECT form_key, surface, row_number() OVER (PARTITION BY form_key ORDER BY expected_mass DESC, surface) AS rank_no FROM valid)
SELECT form_key, surface, CAST(rank_no AS INTEGER) AS rank_no FROM ranked WHERE rank_no <= 5""",
        "p3_found": f"WITH {_REPORTS} SELECT token, mark FROM marked WHERE mark IS NOT NULL",
        "p3_terms": f"WITH {_REPORTS} SELECT token, files, occurrences, mark FROM marked",
        "p4_found": f"""
WITH RECURSIVE {_GROUPS},
recorded AS (
  SELECT document_id, nullif(lower(trim(split)), '') AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY built_at DESC NULLS LAST, split DESC NULLS LAST) AS rn FROM canonical_manifest WHERE document_id IS NOT NULL) WHERE rn = 1),
torn AS (SELECT group_id FROM groups JOIN recorded USING (document_id) GROUP BY group_id HAVING count(DISTINCT split) > 1)
SELECT document_id, group_id FROM groups JOIN torn USING (group_id)""",
        "p4_groups": f"""
WITH RECURSIVE {_GROUPS},
every AS (SELECT DISTINCT d.document_id, coalesce(group_id, d.document_id) AS group_id FROM (SELECT document_id FROM canonical_manifest WHERE document_id IS NOT NULL) d LEFT JOIN groups USING (document_id))
SELECT document_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM every""",
        "p6_found": f"""
WITH d AS (SELECT doc_id, {letters_sql("text")} AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {letters_sql("text")} AS t FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT DISTINCT item_id, t[k:k + 39] AS run FROM i, unnest(generate_series(1, length(t) - 39)) AS u(k) WHERE length(t) >= 40),
docs AS (SELECT DISTINCT doc_id, t[k:k + 39] AS run FROM d, unnest(generate_series(1, length(t) - 39)) AS u(k) WHERE length(t) >= 40)
SELECT DISTINCT doc_id, item_id FROM docs JOIN items USING (run)""",
    }
