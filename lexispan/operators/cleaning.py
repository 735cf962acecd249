"""Cleaning passes over documents: texts, counts of rules, changed lines and occurrences as frames.

What each pass does to a text is in `passes`; here it runs as one Arrow UDF that gives
the text and a map of counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.operators import passes
from lexispan.operators.passes import PASSES
from lexispan.sources.corpus import lines_of

CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.LongType()))])


def column(function: Callable[[str], tuple[str, Counter]]):
    """A cleaning function as a column function that gives struct<text, counts>; null stays null."""

    @F.pandas_udf(CLEANED)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if x is None or x != x else function(x) for x in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], "counts": [None if r[1] is None else dict(r[1]) for r in rows]})

    return run


def cleaned(documents: DataFrame, name: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, before, text, counts) of one named pass."""
    done = documents.select(key, F.col(text).alias("before"), column(PASSES[name])(text).alias("_c"))
    return done.select(key, "before", F.col("_c.text").alias("text"), F.col("_c.counts").alias("counts"))


def rule_counts(done: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(rule, documents, n): how often each rule applied."""
    rows = done.select(key, F.explode("counts").alias("rule", "n"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))


def change_rows(done: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, line_no, before, after) of each changed line; passes keep line numbers."""
    before = lines_of(done, key=key, text="before").withColumnRenamed("line", "before")
    after = lines_of(done, key=key, text="text").withColumnRenamed("line", "after")
    return before.join(after, [key, "line_no"]).where("before <> after")


_MARKS = T.ArrayType(
    T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("place", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("left", "right", "decision", "reason", "action"))])
)


def _marks_of(kind: str, text: str) -> list[tuple]:
    out = []
    for no, line in enumerate(text.split("\n"), 1):
        if kind == "pluta":
            out += [(no, place, base, "3", decision, "", "" if decision == "AUTO" else None) for place, base, decision in passes.pluta_marks(line)]
        else:
            for m in passes.hyphen_marks(line) if kind == "hyphens" else passes.separator_marks(line):
                action = passes.hyphen_action(m)[0] if kind == "hyphens" else m.decision
                out.append((no, m.place, m.left, m.right, m.decision, m.reason, action))
    return out


def mark_rows(documents: DataFrame, kind: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, place, left, right, decision, reason, action) of every hyphen, separator or prolated vowel (`hyphens`, `separators`, `pluta`)."""

    @F.pandas_udf(_MARKS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None or x != x else _marks_of(kind, x) for x in texts])

    return documents.select(key, F.explode(found(text)).alias("m")).select(key, "m.*")


def hyphen_candidates(rows: DataFrame, *, key: str = "doc_id", min_occurrences: int = 20, min_separator_share: float = 0.95, max_review_share: float = 0.05) -> DataFrame:
    """(key, hyphens, separators, reviews, candidate): documents with enough hyphens, almost all of which part words."""
    of = lambda decision: F.count_if(F.col("decision") == decision)
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("hyphens"), of("SEPARATOR").alias("separators"), of("REVIEW").alias("reviews"))
    enough = (F.col("hyphens") >= min_occurrences) & (F.col("separators") >= F.col("hyphens") * min_separator_share) & (F.col("reviews") <= F.col("hyphens") * max_review_share)
    return counted.withColumn("candidate", enough)


def without_marked(documents: DataFrame, kind: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no mark of the kind."""
    return documents.join(mark_rows(documents, kind, key=key, text=text).select(key).distinct(), key, "left_anti")


def structure_lines(documents: DataFrame, *, key: str = "doc_id", text: str = "text", times: int = 2, longest: int = 60) -> DataFrame:
    """(key, line_no, line, rule): titles (the first line, before a blank one), sigla (all upper case, also with what they stand for) and headers that the document repeats before blank lines."""
    rows = lines_of(documents, key=key, text=text).withColumn("line", F.trim("line"))
    each = Window.partitionBy(key)
    seen = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "line"))).withColumn("next", F.lead("line").over(each.orderBy("line_no")))
    seen = seen.withColumn("first", F.min(F.when(F.col("line") != "", F.col("line_no"))).over(each))
    blank_next = F.coalesce(F.col("next") == "", F.lit(True))
    short = F.length("line") <= longest
    rule = (
        F.when(F.col("line").rlike(r"^\p{Lu}{2,8}[.]?( = \p{Lu}{2,8}[.]?)?$"), "siglum")
        .when((F.col("n") >= times) & blank_next & short, "repeated_header")
        .when((F.col("line_no") == F.col("first")) & blank_next & short, "title")
    )
    return seen.where("line <> ''").withColumn("rule", rule).where("rule is not null").select(key, "line_no", "line", "rule")


def without_lines(documents: DataFrame, lines: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with the listed lines (key, line_no) left empty."""
    gone = lines.groupBy(key).agg(F.collect_set("line_no").alias("_gone"))  # bounded by a document
    kept = F.transform(F.split(text, "\n", -1), lambda line, i: F.when(F.array_contains("_gone", i + 1), F.lit("")).otherwise(line))
    return documents.select(key, text).join(gone, key, "left").select(key, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text))


def occurrences(documents: DataFrame, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, ordinal, token) of standalone words that match."""
    rows = lines_of(documents, key=key, text=text).select(key, "line_no", F.posexplode(F.split("line", " ")).alias("ordinal", "token"))
    return rows.where(F.col("token").rlike(pattern))


def delete_unlisted(documents: DataFrame, keep: DataFrame, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts without the standalone words that match the pattern and aren't in the keep list (key, line_no, token).

    Only lines with such a word are taken apart and put together again.
    """
    doomed = occurrences(documents, pattern, key=key, text=text).join(keep, [key, "line_no", "token"], "left_anti")
    gone = doomed.groupBy(key, "line_no").agg(F.collect_set("ordinal").alias("_gone"))  # bounded by a line
    lines = lines_of(documents, key=key, text=text).join(gone, [key, "line_no"], "left")
    words = F.filter(F.transform(F.split("line", " "), lambda w, i: F.when(F.array_contains("_gone", i), F.lit(None)).otherwise(w)), lambda w: w.isNotNull())
    fixed = lines.withColumn("line", F.when(F.col("_gone").isNull(), F.col("line")).otherwise(F.array_join(words, " ")))
    whole = fixed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("_l"))  # one document
    return whole.select(key, F.array_join("_l", "\n").alias(text))


def is_subsequence(short: pd.Series, long: pd.Series) -> pd.Series:
    """Whether the words of one text occur in the other in the same order."""

    def one(a: str | None, b: str | None) -> bool | None:
        if a is None or b is None:
            return None
        words = iter(b.split())
        return all(w in words for w in a.split())

    return pd.Series([one(a, b) for a, b in zip(short, long, strict=True)], dtype=object)


keeps_order = F.pandas_udf(T.BooleanType())(is_subsequence)
