"""Words, their neighbours, and the lexicon that sums their uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = r"[\s ]+"
BOS, EOS = "<BOS>", "<EOS>"


def words_of(text: Column) -> Column:
    """The words of a text between white space, in order; null stays null."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def word_rows(documents: DataFrame, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, pos, form_key, surface, context): each word with its left and right neighbour, without a shuffle."""
    at = lambda ws, i: F.lower(F.get(ws, i))
    listed = documents.select(key, *keep, words_of(F.col(text)).alias("_ws")).where(F.size("_ws") > 0)
    rows = listed.select(key, *keep, "_ws", F.posexplode("_ws").alias("pos", "surface"))
    left = F.when(F.col("pos") > 0, at(F.col("_ws"), F.col("pos") - 1)).otherwise(F.lit(BOS))
    return rows.select(
        key, *keep, "pos", F.lower("surface").alias("form_key"), "surface",
        F.concat(left, F.lit(">"), F.coalesce(at(F.col("_ws"), F.col("pos") + 1), F.lit(EOS))).alias("context"),
    )


def usage_sums(rows: DataFrame, axis: str, *, mass: str | None = None, by: tuple[str, ...] = (), threshold: float = 0.0) -> DataFrame:
    """Upsert-sum of mass (default 1 per row) by (*by, form_key, axis); rows of a mass not over the threshold are dropped first."""
    weighted = rows.withColumn("_m", F.lit(1.0) if mass is None else F.col(mass)).where(F.col("_m") > threshold)
    return weighted.groupBy(*by, "form_key", axis).agg(F.sum("_m").alias("expected_mass"))


def lexicon_of(usage: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Expected count of each form; counts that aren't positive are dropped."""
    return usage.groupBy(*by, "form_key").agg(F.sum("expected_mass").alias("expected_count")).where("expected_count > 0")


def smoothed(lexicon: DataFrame, *, alpha: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the add-alpha probability (c + alpha) / (sum c + alpha * types); an empty lexicon stays empty."""
    totals = lexicon.groupBy(*by).agg(F.sum("expected_count").alias("_total"), F.count(F.lit(1)).alias("_types"))
    joined = lexicon.join(F.broadcast(totals), list(by)) if by else lexicon.crossJoin(F.broadcast(totals))  # one row for each cell
    return joined.withColumn("probability", (F.col("expected_count") + alpha) / (F.col("_total") + F.lit(alpha) * F.col("_types"))).drop("_total", "_types")


def variant_counts(usage: DataFrame, name: str, *, threshold: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Number of items of each form whose summed mass reaches the threshold."""
    return usage.where(F.col("expected_mass") >= threshold).groupBy(*by, "form_key").agg(F.count(F.lit(1)).alias(name))


def lexicon_export(lexicon: DataFrame, surfaces: DataFrame, contexts: DataFrame, *, alpha: float = 0.1, threshold: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts joined to probabilities and to the numbers of surface variants and contexts; forms without any have 0."""
    keys = [*by, "form_key"]
    return (
        smoothed(lexicon, alpha=alpha, by=by)
        .join(variant_counts(surfaces, "number_of_surface_variants", threshold=threshold, by=by), keys, "left")
        .join(variant_counts(contexts, "number_of_contexts", threshold=threshold, by=by), keys, "left")
        .fillna(0, ["number_of_surface_variants", "number_of_contexts"])
    )


def top_lexicon(lexicon: DataFrame, limit: int, *, low: bool = False) -> DataFrame:
    """The most (or least) frequent forms; equal counts by form."""
    count = F.col("expected_count")
    return lexicon.orderBy(count.asc() if low else count.desc(), "form_key").limit(limit)


def complexity(lexicon: DataFrame, *, weight: float = 0.5, tau: float = 1.0, low_count: float = 1.0) -> DataFrame:
    """One row: types, mass, types of a low count, and weight * sum of log(1 + c / tau)."""
    c = F.col("expected_count")
    return lexicon.agg(
        F.count(F.lit(1)).alias("types"), F.coalesce(F.sum(c), F.lit(0.0)).alias("mass"),
        F.count_if(c <= low_count).alias("low_count_types"), (F.lit(weight) * F.coalesce(F.sum(F.log1p(c / tau)), F.lit(0.0))).alias("complexity"),
    )
