"""Character and line audits of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.operators.tokenizers import characters
from lexispan.operators.usage import words_of
from lexispan.sources.corpus import lines_of

# The closed alphabet of a clean IAST line.
ALPHABET = "aāiīuūṛṝḷḹeokgṅcjñṭḍṇtdnpbmyrlvśṣshṃḥ'| \n"


CLASSES = (
    "lower_ascii", "upper_ascii", "digit", "space", "western_mark", "danda", "devanagari_danda", "devanagari_digit", "devanagari", "iast", "combining", "other_ascii", "other",
)


def character_class(c: Column) -> Column:
    """One of thirteen classes; the first that fits."""
    return (
        F.when(c.rlike("^[a-z]$"), "lower_ascii").when(c.rlike("^[A-Z]$"), "upper_ascii").when(c.rlike("^[0-9]$"), "digit")
        .when(c.rlike(r"^\s$"), "space").when(c.rlike("^[.,;:!?]$"), "western_mark").when(c == "|", "danda").when(c.rlike("^[।॥]$"), "devanagari_danda")
        .when(c.rlike("^[०-९]$"), "devanagari_digit").when(c.rlike("^[ऀ-ॿ]$"), "devanagari").when(c.rlike("^[āīūṛṝḷḹṅñṭḍṇśṣṃḥĀĪŪṚṜḶḸṄÑṬḌṆŚṢṂḤ]$"), "iast")
        .when(c.rlike("^[̀-ͯ]$"), "combining").when(c.rlike("^[!-~]$"), "other_ascii").otherwise("other")
    )


CLASS_SQL = r"""CASE WHEN regexp_matches(c, '^[a-z]$') THEN 'lower_ascii' WHEN regexp_matches(c, '^[A-Z]$') THEN 'upper_ascii' WHEN regexp_matches(c, '^[0-9]$') THEN 'digit'
WHEN regexp_matches(c, '^[ \t\n\r\f\v]$') THEN 'space' WHEN regexp_matches(c, '^[.,;:!?]$') THEN 'western_mark' WHEN c = '|' THEN 'danda' WHEN regexp_matches(c, '^[।॥]$') THEN 'devanagari_danda'
WHEN regexp_matches(c, '^[०-९]$') THEN 'devanagari_digit' WHEN regexp_matches(c, '^[ऀ-ॿ]$') THEN 'devanagari' WHEN regexp_matches(c, '^[āīūṛṝḷḹṅñṭḍṇśṣṃḥĀĪŪṚṜḶḸṄÑṬḌṆŚṢṂḤ]$') THEN 'iast'
WHEN regexp_matches(c, '^[\x{0300}-\x{036F}]$') THEN 'combining' WHEN regexp_matches(c, '^[!-~]$') THEN 'other_ascii' ELSE 'other' END"""


def character_rows(documents: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, char, n): distinct characters of each text, counted within the text before any shuffle could see them one by one."""
    return documents.select(key, *keep, F.explode(characters(F.col(text))).alias("char")).groupBy(key, *keep, "char").agg(F.count(F.lit(1)).alias("n"))


def character_inventory(documents: DataFrame, *, text: str = "text") -> DataFrame:
    """(char, class, n) over all texts: partial counts on the map side, so a shuffle moves one row per character and task."""
    counts = documents.select(F.explode(characters(F.col(text))).alias("char")).groupBy("char").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("char", character_class(F.col("char")).alias("class"), "n")


def unknown_characters(documents: DataFrame, *, key: str = "doc_id", text: str = "text", alphabet: str = ALPHABET) -> DataFrame:
    """(char, n, documents, first_document) of characters outside the alphabet."""
    rows = documents.select(key, F.explode(characters(F.translate(F.col(text), alphabet, ""))).alias("char"))
    return rows.groupBy(key, "char").agg(F.count(F.lit(1)).alias("n")).groupBy("char").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"), F.min(key).alias("first_document"))


def has_accent(text: Column) -> Column:
    """Whether a text has a Vedic accent mark or an accented letter."""
    return text.rlike("[॒̀́॑áéíóúàèìòù]")


def flagged_lines(documents: DataFrame, classes: tuple[str, ...], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, class, n, chars): per line and class the occurrences and the distinct characters in order."""
    rows = lines_of(documents, key=key, text=text).select(key, "line_no", F.explode(characters(F.col("line"))).alias("char"))
    flagged = rows.withColumn("class", character_class(F.col("char"))).where(F.col("class").isin(*classes))
    return flagged.groupBy(key, "line_no", "class").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("char")), "").alias("chars"))


def valid_avagraha(line: Column) -> Column:
    """Apostrophes of a line that stand after e or o (over spaces), before an IAST letter, and not twice."""
    return F.regexp_count(line, F.lit("(?<=[eo] {0,20})(?<!')'(?=[aāiīuūṛṝḷḹeokgṅcjñṭḍṇtdnpbmyrlvśṣsh])"))


def adjacent_vowels(line: Column) -> Column:
    """All overlapping pairs of vowels, except the diphthongs."""
    return F.filter(F.regexp_extract_all(line, F.lit("(?=([aāiīuūṛṝḷḹeo][aāiīuūṛṝḷḹeo]))"), F.lit(1)), lambda p: ~p.isin("ai", "au"))


def runs(rows: DataFrame, *, key: str, pos: str, flag: Column) -> DataFrame:
    """Gaps and islands: (key, start, end, words) of each maximal run of flagged positions."""
    hits = rows.where(flag).select(key, pos)
    island = F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos))
    return hits.withColumn("_island", island).groupBy(key, "_island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("words")).drop("_island")


def merged_spans(spans: DataFrame, *, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans as one."""
    before = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    opened = spans.withColumn("_new", (F.col(start) > F.coalesce(F.max(end).over(before), F.col(start) - 1)).cast("int"))
    grouped = opened.withColumn("_group", F.sum("_new").over(Window.partitionBy(key).orderBy(start, end)))
    return grouped.groupBy(key, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("spans")).drop("_group")


def single_letters(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(letter, n, documents, rank): one-letter words, the most frequent first, then by documents and letter."""
    rows = documents.select(key, F.explode(F.filter(words_of(F.col(text)), lambda w: F.length(w) == 1)).alias("letter")).where(F.col("letter").rlike(r"^\p{L}$"))
    counts = rows.groupBy(key, "letter").agg(F.count(F.lit(1)).alias("n")).groupBy("letter").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), F.desc("documents"), "letter")))  # one row for each letter


def line_neighbours(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, previous, next) without a shuffle: neighbours come from the text's own lines."""
    plain = F.split(F.regexp_replace(F.col(text), "\r\n|\r", "\n"), "\n", -1)
    rows = documents.select(key, plain.alias("_l")).select(key, "_l", F.posexplode("_l").alias("_at", "line"))
    before = F.when(F.col("_at") > 0, F.get("_l", F.col("_at") - 1))
    return rows.select(key, (F.col("_at") + 1).alias("line_no"), "line", before.alias("previous"), F.get("_l", F.col("_at") + 1).alias("next"))


def repeated_headers(documents: DataFrame, *, key: str = "doc_id", text: str = "text", times: int = 3, longest: int = 40) -> DataFrame:
    """(key, line, n, first_line): short lines that a document repeats, followed by a blank line or not."""
    rows = lines_of(documents, key=key, text=text).withColumn("line", F.trim("line")).where((F.col("line") != "") & (F.length("line") <= longest))
    return rows.groupBy(key, "line").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")).where(F.col("n") >= times)


def strict_violations(documents: DataFrame, *, key: str = "doc_id", text: str = "text", alphabet: str = ALPHABET) -> DataFrame:
    """(key, line_no, column, char) of every character outside the alphabet."""
    rows = lines_of(documents, key=key, text=text).select(key, "line_no", F.posexplode(characters(F.col("line"))).alias("column", "char"))
    return rows.where(~F.contains(F.lit(alphabet), F.col("char")))


def strict_totals(documents: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, violations, lines, chars, first_line, first_column) of every document with a character outside the alphabet; none means that the corpus is clean."""
    rows = strict_violations(documents, key=key, text=text)
    first = F.min(F.struct("line_no", "column"))
    totals = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("violations"), F.countDistinct("line_no").alias("lines"), F.array_join(F.array_sort(F.collect_set("char")), "").alias("chars"), first.alias("_f")
    )
    return totals.select(key, "violations", "lines", "chars", F.col("_f.line_no").alias("first_line"), F.col("_f.column").alias("first_column"))


# English words that no Sanskrit text has, and short ones that are also Sanskrit words or fragments.
STRONG_ENGLISH = ("the", "of", "and", "that", "this", "which", "with", "from", "every", "for", "are", "was", "were", "not", "but", "they", "their", "have", "has", "been", "these", "those", "when", "because", "only", "edition", "text", "verse")
WEAK_ENGLISH = ("a", "an", "as", "at", "be", "by", "he", "his", "her", "i", "in", "is", "it", "no", "on", "or", "she", "so", "to", "me", "my", "we", "us", "one")


def english_runs(rows: DataFrame, *, key: str, pos: str, word: str, least: int = 2) -> DataFrame:
    """(key, start, end, words, strong): runs of English words with at least one that can't be Sanskrit; short ambiguous words alone are no run."""
    strong = F.col(word).isin(*STRONG_ENGLISH)
    hits = rows.where(strong | F.col(word).isin(*WEAK_ENGLISH)).select(key, pos, strong.cast("int").alias("_strong"))
    island = F.col(pos) - F.row_number().over(Window.partitionBy(key).orderBy(pos))
    found = hits.withColumn("_island", island).groupBy(key, "_island").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("words"), F.sum("_strong").alias("strong"))
    return found.where((F.col("words") >= least) & (F.col("strong") > 0)).drop("_island")


def triage(inventory: DataFrame) -> DataFrame:
    """(category, characters, n): each character of an inventory in one category, the first that fits: script, mark, number, layout, noise."""
    c = F.col("class")
    category = (
        F.when(c.isin("devanagari", "devanagari_danda", "devanagari_digit"), "script").when(c.isin("combining"), "mark").when(c.isin("digit"), "number")
        .when(c.isin("space", "danda", "western_mark"), "layout").when(c.isin("lower_ascii", "upper_ascii", "iast"), "letter").otherwise("noise")
    )
    return inventory.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("characters"), F.sum("n").alias("n"))
