"""Deterministic statistics of a lexicon: diversity, support of mass, quantiles from histograms, tails, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.operators.ranking import ranked


def _order() -> list[Column]:
    return [F.desc("expected_count"), F.asc("form_key")]


def diversity(lexicon: DataFrame) -> DataFrame:
    """One row: types, mass, entropy (nats), exp(entropy), inverse Simpson and Gini."""
    placed = ranked(lexicon.select("form_key", "expected_count"), _order())
    c = F.col("expected_count")
    s = placed.agg(
        F.count(F.lit(1)).alias("n"), F.sum(c).alias("m"), F.sum(F.when(c > 0, c * F.ln(c))).alias("l"), F.sum(c * c).alias("q"), F.sum(c * F.col("rank")).alias("r")
    )
    n, m = F.col("n"), F.col("m")
    entropy = F.greatest(F.lit(0.0), F.ln(m) - F.col("l") / m)
    # Ranks run from the largest count; Gini's formula takes them from the smallest.
    gini = F.try_divide(n + 1, n) - F.try_divide(F.lit(2.0) * ((n + 1) * m - F.col("r")), n * m)
    return s.select(n.alias("types"), m.alias("mass"), entropy.alias("entropy"), F.exp(entropy).alias("exp_entropy"), F.try_divide(m * m, F.col("q")).alias("inverse_simpson"), (-gini).alias("gini"))


def mass_support(lexicon: DataFrame, shares: list[float]) -> DataFrame:
    """(share, types): how many of the most frequent forms hold each share of the mass."""
    placed = ranked(lexicon.select("form_key", "expected_count"), _order(), mass="expected_count")
    total = lexicon.agg(F.sum("expected_count").alias("total"), F.count(F.lit(1)).alias("n"))
    shares_df = lexicon.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    reached = [F.min(F.when(F.col("cumulative") >= F.lit(s) * F.col("total"), F.col("rank"))).alias(f"s{i}") for i, s in enumerate(shares)]
    row = placed.crossJoin(F.broadcast(total)).agg(*reached, F.max("n").alias("n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.coalesce(f"s{i}", "n").alias("types")) for i, s in enumerate(shares))))
    return shares_df.join(row.select(pairs.alias("x")).select("x.*"), "share", "left")


def top_mass(lexicon: DataFrame, tops: list[int]) -> DataFrame:
    """(k, mass, share) of the k most frequent forms."""
    placed = ranked(lexicon.select("form_key", "expected_count"), _order())
    c = F.col("expected_count")
    sums = placed.agg(F.sum(c).alias("total"), *(F.sum(F.when(F.col("rank") <= k, c)).alias(f"k{k}") for k in tops))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("mass"), F.try_divide(f"k{k}", "total").alias("share")) for k in tops)))
    return sums.select(pairs.alias("x")).select("x.*")


def bucket(value: Column) -> Column:
    """Bin of an eighth of an octave; zero has a bin of its own below all others."""
    return F.when(value == 0, F.lit(-100_000)).otherwise(F.floor(F.log2(value) * 8)).cast("long")


def histogram_quantiles(df: DataFrame, value: str, probabilities: list[float], *, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, extremes and quantiles from a log2 histogram with bins of 1/8 octave; a quantile is its bin's geometric middle."""
    v = F.col(value).cast("double")
    counted = df.where(v.isNotNull() & (v >= 0)).groupBy(*by, bucket(v).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.sum(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    window = Window.partitionBy(*by).orderBy("_b") if by else Window.partitionBy(F.lit(0)).orderBy("_b")  # some hundred bins at most
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    placed = counted.withColumn("_seen", F.sum("_n").over(window)).withColumn("_all", F.sum("_n").over(whole))
    middle = F.when(F.col("_b") == -100_000, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), (F.col("_b") + 0.5) / 8))
    at = lambda p: F.min(F.when(F.col("_seen") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_all"))), middle))
    return placed.groupBy(*by).agg(
        F.sum("_n").alias("count"), F.try_divide(F.sum("_s"), F.sum("_n")).alias("mean"), F.min("_lo").alias("minimum"), F.max("_hi").alias("maximum"),
        *(at(p).alias(f"q{round(p * 100):02d}") for p in probabilities),
    )


def weighted_quantiles(df: DataFrame, value: str, weight: str, probabilities: list[float], *, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles of a discrete weighted distribution: the least value whose cumulative weight reaches the share."""
    grouped = df.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    part = list(by) or [F.lit(0)]
    window = Window.partitionBy(*part)
    placed = grouped.withColumn("_c", F.sum("_w").over(window.orderBy("_v"))).withColumn("_t", F.sum("_w").over(window))
    at = lambda p: F.min(F.when((F.col("_t") > 0) & (F.col("_c") >= F.lit(p) * F.col("_t")), F.col("_v")))
    return placed.groupBy(*by).agg(*(at(p).cast("double").alias(f"q{round(p * 100):02d}") for p in probabilities))


def edge_tail_share(df: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """(fraction, share): share of mass in the top fraction of rows, from the histogram; the last bin is shared out evenly."""
    v = F.col(value).cast("double")
    counted = df.where(v.isNotNull()).groupBy(bucket(v).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("m"))
    window = Window.partitionBy(F.lit(0)).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0)))
    whole = Window.partitionBy(F.lit(0))
    placed = placed.withColumn("rows", F.sum("n").over(whole)).withColumn("total", F.sum("m").over(whole))
    each = placed.crossJoin(F.broadcast(df.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")))
    target = F.greatest(F.lit(1), F.ceil(F.col("rows") * F.col("fraction")))
    take = F.least(F.col("n"), F.greatest(F.lit(0), target - F.col("before")))
    return each.groupBy("fraction").agg(F.coalesce(F.try_divide(F.sum(F.col("m") * take / F.col("n")), F.max("total")), F.lit(0.0)).alias("share"))


def reuse_grid(lexicon: DataFrame, *, lengths: list[int], reuse: list[int], length: str, axes: dict[str, str]) -> DataFrame:
    """Types and mass of long forms, of forms of low reuse (by axis), and of forms that are both, for each threshold.

    The thresholds are exploded per form and partially summed, so one pass serves all.
    """
    spark = lexicon.sparkSession
    cells = [("long", n, None, None) for n in lengths] + [("low_reuse", None, a, r) for a in axes for r in reuse]
    cells += [("long_low_reuse", n, a, r) for n in lengths for a in axes for r in reuse]
    grid = F.broadcast(spark.createDataFrame(cells, "family string, length_threshold long, axis string, reuse_threshold long"))
    used = F.coalesce(*(F.when(F.col("axis") == a, F.col(c)) for a, c in axes.items()))
    hit = (F.col("length_threshold").isNull() | (F.col(length) >= F.col("length_threshold"))) & (F.col("axis").isNull() | (used < F.col("reuse_threshold")))
    keys = ["family", "length_threshold", "axis", "reuse_threshold"]
    found = lexicon.crossJoin(grid).groupBy(*keys).agg(
        F.count_if(hit).alias("types"), F.coalesce(F.sum(F.when(hit, F.col("expected_count"))), F.lit(0.0)).alias("mass"),
        F.count(F.lit(1)).alias("_n"), F.sum("expected_count").alias("_m"),
    )
    return found.select(*keys, "types", F.try_divide("types", "_n").alias("type_share"), "mass", F.try_divide("mass", "_m").alias("mass_share"))


def mass_summary(lexicon: DataFrame, *, low_count: float, shares: list[float]) -> DataFrame:
    """One row: types, mass, types of a low count and their share, and the support of each share of mass."""
    c = F.col("expected_count")
    base = lexicon.agg(F.count(F.lit(1)).alias("types"), F.sum(c).alias("mass"), F.count_if(c <= low_count).alias("low_count_types"))
    support = mass_support(lexicon, shares).agg(*(F.max(F.when(F.col("share") == s, F.col("types"))).alias(f"support_{round(s * 100)}") for s in shares))
    return base.crossJoin(F.broadcast(support)).withColumn("low_count_share", F.try_divide("low_count_types", "types"))


def usage_summary(usage: DataFrame, key: str, mass: str, *, top: int = 10) -> DataFrame:
    """(key, mass, share, rank) by mass, greatest first, then key; only the top rows."""
    total = usage.agg(F.sum(mass).alias("_t"))
    few = usage.orderBy(F.desc(mass), key).limit(top)
    placed = few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(mass), key)).cast("long"))
    return placed.crossJoin(F.broadcast(total)).select(key, mass, F.try_divide(mass, "_t").alias("share"), "rank")


def deltas(df: DataFrame, *, metric: str, order: str, value: str) -> DataFrame:
    """Adds the change to the previous row of the same metric, absolute and relative; null for the first and over zero."""
    window = Window.partitionBy(metric).orderBy(order)
    before = F.lag(value).over(window)
    return df.withColumn("delta", F.col(value) - before).withColumn("relative_delta", F.try_divide(F.col(value) - before, F.abs(before)))


def binary_entropy(p: Column) -> Column:
    """Entropy of a yes/no outcome in nats; 0 at the ends."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.ln(p) + (1 - p) * F.ln(1 - p)))


def rollup(wide: DataFrame, *, by: list[str], totals: list[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """(by, metric, value): totals and ratios of totals as rows; a ratio over nothing is null."""
    with_ratios = wide.withColumns({name: F.try_divide(a, b) for name, (a, b) in ratios.items()})
    return with_ratios.unpivot(by, [*totals, *ratios], "metric", "value")
