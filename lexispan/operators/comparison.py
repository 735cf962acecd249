"""Comparisons of cells (results under different conditions): long scalars, designated pairs, typed gaps, merged examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.operators.distances import scalar_comparison


def scalars(wide: DataFrame, *, identity: list[str], values: list[str]) -> DataFrame:
    """(*identity, field, value): wide rows as one row for each value; null values are kept."""
    return wide.select(*identity, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(identity, values, "field", "value")


def compared(long: DataFrame, pairs: DataFrame, *, cell: str, keys: list[str]) -> DataFrame:
    """Each designated pair (cell_a, cell_b) of cells joined on the keys: values, differences and ratio.

    `pairs` is small and broadcast; a side without a row has a null value.
    """
    side = lambda n: long.select(*keys, F.col(cell).alias(f"cell_{n}"), F.col("value").alias(n))
    asked = long.select(*keys).distinct().crossJoin(F.broadcast(pairs))
    both = asked.join(side("a"), [*keys, "cell_a"], "left").join(side("b"), [*keys, "cell_b"], "left")
    return both.select(*keys, "cell_a", "cell_b", "a", "b", *scalar_comparison(F.col("a"), F.col("b")))


def typed_gaps(declared: DataFrame, found: DataFrame, keys: list[str], *, value: str) -> DataFrame:
    """Every declared row with its value and a status: its declared reason, AVAILABLE, or MISSING where a value should be."""
    joined = declared.join(found, keys, "left")
    status = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col(value).isNotNull(), "AVAILABLE").otherwise("MISSING")
    return joined.select(*keys, F.when(F.col("reason").isNull(), F.col(value)).alias(value), status.alias("status"))


def membership_gate(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, problem) of keys that only one side has, or that one has twice; none if the sides are the same."""
    count = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    both = count(expected, "e").join(count(actual, "a"), key, "full")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when((F.col("a") > 1) | (F.col("e") > 1), "repeated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def matched_examples(a: DataFrame, b: DataFrame, key: str, *, qualified: Column, order: list[Column], limit: int) -> DataFrame:
    """Rows of both inputs with the same key that qualify, one for each key, the first by the order."""
    both = a.join(b, key).where(qualified)
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return once.orderBy(*order).limit(limit)


def positional(a: DataFrame, b: DataFrame, *, group: list[str], order_a: str, order_b: str) -> DataFrame:
    """Rows of a and b of the same group and position; groups whose counts differ give none."""
    number = lambda df, o: df.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(o))).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    return number(a, order_a).join(number(b, order_b), [*group, "_at", "_of"]).drop("_of").withColumnRenamed("_at", "position")
