"""Association specialisation: how concentrated each form's use is on an axis, by cell, and how two cells differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("top1_share", "topk_share", "entropy", "normalized_entropy", "effective_support", "herfindahl", "inverse_simpson")


def concentration(usage: DataFrame, axis: str, *, k: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Per (*by, form_key): rows, support, mass, shares of the top item and top k, entropy (nats), Herfindahl and effective supports.

    Items of no mass count as rows but not as support; a form without mass has null
    metrics.  The top k need no sort of a form's items: they come from a ranking in
    which every partition of items gives up at most k.
    """
    keys = [*by, "form_key"]
    m = F.col("expected_mass")
    positive = F.when(m > 0, m)
    sums = usage.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(positive).alias("support"), F.coalesce(F.sum(positive), F.lit(0.0)).alias("mass"),
        F.sum(positive * F.ln(positive)).alias("_mlogm"), F.sum(positive * positive).alias("_m2"), F.max(positive).alias("_top1"),
    )
    top = top_items(usage, axis, k=k, by=by).groupBy(*keys).agg(F.sum("expected_mass").alias("_topk"))
    total = F.col("mass")
    has = F.col("support") > 0
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    out = sums.join(top, keys, "left")
    out = out.withColumn("entropy", F.when(has, F.greatest(F.lit(0.0), F.ln(total) - F.col("_mlogm") / total)))
    out = out.withColumn("herfindahl", F.when(has, unit(F.col("_m2") / (total * total))))
    return out.select(
        *keys, "rows", "support", "mass",
        F.when(has, unit(F.col("_top1") / total)).alias("top1_share"),
        F.when(has, unit(F.col("_topk") / total)).alias("topk_share"),
        "entropy",
        F.when(has, F.when(F.col("support") == 1, F.lit(0.0)).otherwise(unit(F.col("entropy") / F.ln("support")))).alias("normalized_entropy"),
        F.when(has, F.greatest(F.lit(1.0), F.exp("entropy"))).alias("effective_support"),
        "herfindahl",
        F.when(has, F.greatest(F.lit(1.0), F.lit(1.0) / F.col("herfindahl"))).alias("inverse_simpson"),
    )


def top_items(usage: DataFrame, axis: str, *, k: int, by: tuple[str, ...] = (), salts: int = 16) -> DataFrame:
    """(*by, form_key, axis, expected_mass, rank): the k items of most mass of each form; equal masses by item, greatest first.

    Ranked within salts first, so a form with millions of items is spread over tasks.
    """
    keys = [*by, "form_key"]
    order = [F.desc("expected_mass"), F.desc(axis)]
    salted = usage.where("expected_mass > 0").withColumn("_salt", F.pmod(F.xxhash64(axis), F.lit(salts)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_r") <= k)
    final = few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return final.select(*keys, axis, "expected_mass", "rank")


def form_table(scorer: DataFrame, surfaces: DataFrame, contexts: DataFrame, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Full outer merge of a form's count and its metrics on both axes: metrics are named surface_* and context_*."""
    keys = [*by, "form_key"]
    named = lambda df, axis: df.select(*keys, *(F.col(c).alias(f"{axis}_{c}") for c in df.columns if c not in keys))
    return scorer.join(named(surfaces, "surface"), keys, "full").join(named(contexts, "context"), keys, "full")


def bin_label(value: Column, edges: list[float]) -> Column:
    """Upper-inclusive bins: <=e0, <=e1, ..., >last."""
    label = reduce(lambda acc, e: F.when(value <= e, F.lit(f"<={e:g}")).otherwise(acc), reversed(edges), F.lit(f">{edges[-1]:g}"))
    return F.when(value.isNotNull(), label)


def bins(edges: list[float]) -> list[str]:
    """Names of all bins, in order."""
    return [*(f"<={e:g}" for e in edges), f">{edges[-1]:g}"]


def weighted_means(df: DataFrame, metric: str, *, training: str, association: str, by: list[str | Column]) -> DataFrame:
    """Mean of a metric by type, by training count and by association mass; null metrics and weights that aren't positive are left out."""
    v, t, a = F.col(metric), F.col(training), F.col(association)
    of = lambda w: F.when(v.isNotNull() & (w > 0), w)
    return df.groupBy(*by).agg(
        F.count(v).alias("eligible_forms"), F.avg(v).alias("type_mean"),
        F.try_divide(F.sum(of(t) * v), F.sum(of(t))).alias("training_mean"), F.try_divide(F.sum(of(a) * v), F.sum(of(a))).alias("association_mean"),
    )


def strata(forms: DataFrame, metric: str, *, length: str, count: str, mass: str, length_edges: list[float], count_edges: list[float]) -> DataFrame:
    """Weighted means over all forms, by length bin, by count bin and by both; every declared bin is listed, empty ones with 0 forms."""
    spark = forms.sparkSession
    binned = forms.withColumn("length_bin", bin_label(F.col(length), length_edges)).withColumn("count_bin", bin_label(F.col(count), count_edges))
    v, t, a = F.col(metric), F.col(count), F.col(mass)
    of = lambda w: F.when(v.isNotNull() & (w > 0), w)
    found = binned.groupingSets([["length_bin", "count_bin"], ["length_bin"], ["count_bin"], []], "length_bin", "count_bin").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("forms"), F.count(v).alias("eligible_forms"), F.avg(v).alias("type_mean"),
        F.try_divide(F.sum(of(t) * v), F.sum(of(t))).alias("training_mean"), F.try_divide(F.sum(of(a) * v), F.sum(of(a))).alias("association_mean"),
    )
    lengths, counts = bins(length_edges), bins(count_edges)
    names = [(0, x, y) for x in lengths for y in counts] + [(1, x, None) for x in lengths] + [(2, None, y) for y in counts] + [(3, None, None)]
    declared = spark.createDataFrame(names, "_g long, length_bin string, count_bin string")
    same = [declared["_g"] == found["_g"], declared["length_bin"].eqNullSafe(found["length_bin"]), declared["count_bin"].eqNullSafe(found["count_bin"])]
    stratum = F.element_at(F.array(*(F.lit(x) for x in ("length_count", "length", "count", "all"))), (declared["_g"] + 1).cast("int"))
    return F.broadcast(declared).join(found, same, "left").select(
        stratum.alias("stratum"), declared["length_bin"], declared["count_bin"], F.coalesce("forms", F.lit(0)).alias("forms"),
        F.coalesce("eligible_forms", F.lit(0)).alias("eligible_forms"), "type_mean", "training_mean", "association_mean",
    )


def membership(a: DataFrame, b: DataFrame, *, value: tuple[str, ...]) -> DataFrame:
    """Full outer join of two cells on form_key, with membership shared / cell_a_only / cell_b_only; values are named a_* and b_*."""
    side = lambda df, p: df.select("form_key", F.lit(True).alias(f"_{p}"), *(F.col(c).alias(f"{p}_{c}") for c in value))
    both = side(a, "a").join(side(b, "b"), "form_key", "full")
    where = F.when(F.col("_a").isNull(), "cell_b_only").when(F.col("_b").isNull(), "cell_a_only").otherwise("shared")
    return both.withColumn("membership", where).drop("_a", "_b")


def membership_counts(merged: DataFrame, *, count: str) -> DataFrame:
    """Forms and summed counts of each membership."""
    return merged.groupBy("membership").agg(
        F.count(F.lit(1)).alias("forms"), F.coalesce(F.sum(f"a_{count}"), F.lit(0.0)).alias("a_mass"), F.coalesce(F.sum(f"b_{count}"), F.lit(0.0)).alias("b_mass")
    )


def matched_deltas(merged: DataFrame, metrics: tuple[str, ...], *, count: str) -> DataFrame:
    """Of shared forms: mean of b - a by type, by a's count and by b's count, for each metric."""
    shared = merged.where(F.col("membership") == "shared")
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(f"b_{m}") - F.col(f"a_{m}")).alias("delta")) for m in metrics)))
    rows = shared.select(pairs.alias("x"), F.col(f"a_{count}").alias("wa"), F.col(f"b_{count}").alias("wb")).select("x.*", "wa", "wb").where("delta is not null")
    w = lambda c: F.when(F.col(c) > 0, F.col(c))
    return rows.groupBy("metric").agg(
        F.count(F.lit(1)).alias("matched_forms"), F.avg("delta").alias("type_mean"),
        F.try_divide(F.sum(w("wa") * F.col("delta")), F.sum(w("wa"))).alias("a_weighted_mean"),
        F.try_divide(F.sum(w("wb") * F.col("delta")), F.sum(w("wb"))).alias("b_weighted_mean"),
    )


def correlations(df: DataFrame, x: str, y: str, *, weight: str) -> DataFrame:
    """One row: Pearson correlation of x and y, plain and weighted; null below two rows or without variance.

    Sums are taken around the weighted means, which come from one small aggregate first.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w"))
    kept = rows.withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(0.0))
    means = kept.agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("wx"), F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")).alias("wy")
    )
    near = kept.crossJoin(F.broadcast(means))  # one row
    dx, dy, ex, ey, w = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("x") - F.col("wx"), F.col("y") - F.col("wy"), F.col("w")
    s = near.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(w > 0).alias("nw"), F.sum(dx * dy).alias("xy"), F.sum(dx * dx).alias("xx"), F.sum(dy * dy).alias("yy"),
        F.sum(w * ex * ey).alias("wxy"), F.sum(w * ex * ex).alias("wxx"), F.sum(w * ey * ey).alias("wyy"),
    )
    ratio = lambda n, xy, xx, yy: F.when(n >= 2, F.try_divide(xy, F.sqrt(xx * yy)))
    return s.select(F.col("n").alias("rows"), ratio(F.col("n"), F.col("xy"), F.col("xx"), F.col("yy")).alias("pearson"), ratio(F.col("nw"), F.col("wxy"), F.col("wxx"), F.col("wyy")).alias("weighted_pearson"))


def specialized(merged: DataFrame, *, length: Column, max_count: float, min_length: int, min_top1: float, max_support: float, min_delta: float, limit: int) -> DataFrame:
    """Diagnostic evidence: forms of cell a that are rare, long and tied to few contexts; per category the `limit` first by the five-part order.

    Needs a_/b_ expected_count, top1_share and effective_support.  Category
    shared_more_specialized needs a top-1 share at least `min_delta` over cell b's.
    """
    base = merged.withColumn("phoneme_length", length).where(
        F.col("a_expected_count").isNotNull() & (F.col("phoneme_length") >= min_length) & (F.col("a_expected_count") <= max_count)
        & (F.col("a_top1_share") >= min_top1) & (F.col("a_effective_support") <= max_support)
    )
    only = F.col("membership") == "cell_a_only"
    delta = F.col("a_top1_share") - F.col("b_top1_share")
    rows = base.withColumn("category", F.when(only, "target_only_specialized").when(delta >= min_delta, "shared_more_specialized")).where("category is not null")
    rows = rows.withColumn("selection_score", F.when(only, F.col("a_top1_share")).otherwise(delta))
    order = [F.desc("selection_score"), F.desc("a_top1_share"), F.asc("a_effective_support"), F.desc("phoneme_length"), F.asc("a_expected_count"), F.desc("form_key")]
    first = rows.withColumn("selection_rank", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("selection_rank") <= limit)
    return first.select("category", "selection_rank", "form_key", "selection_score", "phoneme_length", "a_expected_count", "a_top1_share", "a_effective_support")
