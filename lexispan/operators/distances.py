"""Distances between distributions and ranked lists, and fixed-size sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, key: str, mass: str, name: str) -> DataFrame:
    """(key, name): each key's share of the whole mass."""
    total = df.agg(F.sum(mass).alias("_t"))
    return df.groupBy(key).agg(F.sum(mass).alias("_m")).crossJoin(F.broadcast(total)).select(key, F.try_divide("_m", "_t").alias(name))


def _both(p: DataFrame, q: DataFrame, key: str, mass: str) -> DataFrame:
    return shares(p, key, mass, "p").join(shares(q, key, mass, "q"), key, "full").select(key, F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))


def total_variation(p: DataFrame, q: DataFrame, key: str, mass: str) -> DataFrame:
    """One row, `value`: half the summed difference of the shares."""
    return _both(p, q, key, mass).agg((F.sum(F.abs(F.col("p") - F.col("q"))) * 0.5).alias("value"))


def jensen_shannon(p: DataFrame, q: DataFrame, key: str, mass: str) -> DataFrame:
    """One row, `value`: Jensen-Shannon divergence of the shares in nats."""
    a, b = F.col("p"), F.col("q")
    mid = (a + b) / 2
    part = lambda x: F.when(x > 0, x * F.ln(x / mid)).otherwise(0.0)
    return _both(p, q, key, mass).agg(F.greatest(F.lit(0.0), F.sum(part(a) + part(b)) * 0.5).alias("value"))


def scalar_comparison(a: Column, b: Column) -> list[Column]:
    """Absolute and signed difference, relative difference and ratio; null with a flag if the base is zero."""
    return [
        (b - a).alias("signed_difference"), F.abs(b - a).alias("absolute_difference"), F.try_divide(b - a, F.abs(a)).alias("relative_difference"),
        F.try_divide(b, a).alias("ratio"), (a == 0).alias("zero_base"),
    ]


def top_ranked(lexicon: DataFrame, k: int) -> DataFrame:
    """The k most frequent forms with their rank; k rows."""
    few = lexicon.orderBy(F.desc("expected_count"), "form_key").limit(k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("expected_count"), "form_key")))


def top_jaccard(a: DataFrame, b: DataFrame, tops: list[int]) -> DataFrame:
    """(k, value): Jaccard of the sets of the k most frequent forms; null if both are empty."""
    most = max(tops)
    both = top_ranked(a, most).select("form_key", F.col("rank").alias("ra")).join(top_ranked(b, most).select("form_key", F.col("rank").alias("rb")), "form_key", "full")
    inside = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    sums = both.agg(*(F.try_divide(F.count_if(inside("ra", k) & inside("rb", k)), F.count_if(inside("ra", k) | inside("rb", k))).alias(f"k{k}") for k in tops))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("value")) for k in tops))).alias("x")).select("x.*")


def top_distance(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """One row: L1 distance of the shares of the k most frequent forms with all others as one tail, and Spearman over the shared ones by their ranks."""
    share = lambda df: df.crossJoin(F.broadcast(df.agg(F.sum("expected_count").alias("_t")))).withColumn("share", F.try_divide("expected_count", "_t"))
    left, right = top_ranked(share(a), k), top_ranked(share(b), k)
    both = left.select("form_key", F.col("share").alias("p"), F.col("rank").alias("ra")).join(right.select("form_key", F.col("share").alias("q"), F.col("rank").alias("rb")), "form_key", "full")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    tail = lambda c: F.greatest(F.lit(0.0), F.lit(1.0) - F.sum(c))
    shared = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    s = both.agg(F.sum(F.abs(p - q)).alias("d"), tail(p).alias("ta"), tail(q).alias("tb"), F.count_if(shared).alias("n"), F.corr(F.when(shared, F.col("ra").cast("double")), F.when(shared, F.col("rb").cast("double"))).alias("r"))
    return s.select((F.col("d") + F.abs(F.col("ta") - F.col("tb"))).alias("l1_with_tail"), F.when(F.col("n") >= 2, F.nanvl("r", F.lit(None).cast("double"))).alias("spearman"), F.col("n").alias("shared"))


def digest(key: Column) -> Column:
    """First 8 bytes of SHA-256 as 16 hex digits, which sort like the unsigned number."""
    return F.substring(F.sha2(key, 256), 1, 16)


def bottom_k(df: DataFrame, key: str, size: int) -> DataFrame:
    """The `size` smallest distinct digests of the keys."""
    return df.where(F.col(key).isNotNull()).select(digest(F.col(key)).alias("digest")).distinct().orderBy("digest").limit(size)


def minhash_jaccard(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """One row, `value`: share of the `size` smallest digests of the union that are in both sketches; null if both are empty."""
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "digest", "full").orderBy("digest").limit(size)
    return both.agg(F.try_divide(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count(F.lit(1))).alias("value"))


def hash_reservoir(df: DataFrame, key: str, limit: int) -> DataFrame:
    """A deterministic sample: the rows of the smallest digests; of equal digests the larger key is admitted first."""
    return df.withColumn("digest", digest(F.col(key))).orderBy("digest", F.desc(key)).limit(limit)


def top_reservoir(df: DataFrame, category: str, score: str, key: str, limit: int) -> DataFrame:
    """Per category the rows of the highest scores; of equal ones the larger key first."""
    window = Window.partitionBy(category).orderBy(F.desc(score), F.desc(key))
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
