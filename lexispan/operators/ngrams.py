"""n-gram counts, smoothed probabilities and sequence scores over the characters of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.operators.tokenizers import characters

BOS, EOS, UNK = "<s>", "</s>", "<unk>"


def symbols(text: Column, order: int) -> Column:
    """Characters after order - 1 begin marks and before one end mark."""
    return F.concat(F.array_repeat(F.lit(BOS), order - 1), characters(text), F.array(F.lit(EOS)))


def ngram_rows(texts: DataFrame, text: str, order: int, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, pos, context, symbol): each symbol with the order - 1 before it, as one string joined by unit separators."""
    all_symbols = symbols(F.col(text), order)
    spaced = texts.where(F.col(text).isNotNull()).select(*keep, all_symbols.alias("_s"))
    rows = spaced.select(*keep, "_s", F.explode(F.sequence(F.lit(0), F.size("_s") - order)).alias("pos"))
    return rows.select(*keep, "pos", F.array_join(F.slice("_s", F.col("pos") + 1, order - 1), "\x1f").alias("context"), F.get("_s", F.col("pos") + order - 1).alias("symbol"))


def ngram_counts(rows: DataFrame, *, mass: Column | None = None) -> DataFrame:
    """(context, symbol, n) with fractional counts where a mass is given; counts that aren't positive are dropped."""
    total = F.sum(F.lit(1.0) if mass is None else mass)
    return rows.groupBy("context", "symbol").agg(total.alias("n")).where("n > 0")


def context_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("context").agg(F.sum("n").alias("context_n"))


def vocabulary_size(counts: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """One row, v: distinct symbols with the end mark, the unknown mark and any extra ones."""
    seen = counts.select("symbol")
    seen = seen if extra is None else seen.unionByName(extra.select("symbol"))
    marks = counts.sparkSession.createDataFrame([(EOS,), (UNK,)], "symbol string")
    return seen.unionByName(marks).distinct().agg(F.count(F.lit(1)).alias("v"))


def log_probabilities(asked: DataFrame, counts: DataFrame, *, alpha: float, size: DataFrame) -> DataFrame:
    """Adds log_prob = ln((c + alpha) / (C + alpha * V)) to rows of (context, symbol); a symbol never seen counts as unknown."""
    known = counts.select("symbol").distinct().withColumn("_known", F.lit(True))
    named = asked.join(known, "symbol", "left").withColumn("_sym", F.when(F.col("_known"), F.col("symbol")).otherwise(F.lit(UNK)))
    found = named.join(counts.withColumnRenamed("symbol", "_sym"), ["context", "_sym"], "left").join(context_counts(counts), "context", "left")
    return found.crossJoin(F.broadcast(size)).withColumn(
        "log_prob", F.ln((F.coalesce("n", F.lit(0.0)) + alpha) / (F.coalesce("context_n", F.lit(0.0)) + F.lit(alpha) * F.col("v")))
    ).drop("_known", "_sym", "n", "context_n", "v")


def sequence_scores(scored: DataFrame, key: str) -> DataFrame:
    """(key, symbols, log_score): the summed log probability of each sequence."""
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("symbols"), F.sum("log_prob").alias("log_score"))
