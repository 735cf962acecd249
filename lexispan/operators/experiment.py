"""A tokenizer experiment from a configuration: represent, fit on the training split, encode the evaluation split, measure, write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.functions import script, spacing
from lexispan.operators import ngrams, tokenizers
from lexispan.sources.sinks import RESULT_COLUMNS, result_rows

REQUIRED = ("data", "representation", "tokenizer", "model", "seed", "evaluation")


def checked(config: dict) -> dict:
    """The configuration; raises if a required key is missing."""
    missing = [k for k in REQUIRED if k not in config]
    if missing:
        raise ValueError(f"missing keys: {', '.join(missing)}")
    return config


def represented(segments: DataFrame, *, target: str, condition: str) -> DataFrame:
    """Segments (segment_id, split, text, script) in one script and spacing; identity, split and order stay."""
    text = spacing.spaced(script.scripted(F.col("text"), F.col("script"), target), condition, target)
    return segments.withColumns({"text": text, "script": F.lit(target)})


def run(config: dict, segments: DataFrame) -> DataFrame:
    """One row of results with the fixed columns."""
    c = checked(config)
    target, condition = c["representation"]["script"], c["representation"]["spacing"]
    rows = represented(segments, target=target, condition=condition)
    train, held = rows.where(F.col("split") == c["data"]["train"]), rows.where(F.col("split") == c["evaluation"]["split"])
    encode = tokenizers.build_tokenizer(c["tokenizer"]["type"], texts=train, model=c["tokenizer"].get("path"))
    encoded = encode(held).withColumn("_cluster", tokenizers.grapheme_encoder()("text"))
    rate = F.avg(tokenizers.split_rate(F.col("encoding"), F.col("_cluster.starts")))
    sums = encoded.agg(
        F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("characters"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size("encoding.ids")).alias("tokens"),
        rate.alias("grapheme_split_rate"),
    )
    out = sums.withColumns({k: F.lit(v) for k, v in {"script": target, "spacing": condition, "tokenizer": c["tokenizer"]["type"], "model": c["model"]["type"], "seed": c["seed"], "split": c["evaluation"]["split"]}.items()})
    if c["model"]["type"] == "ngram":
        order, alpha = c["model"].get("order", 3), c["model"].get("alpha", 0.1)
        counts = ngrams.ngram_counts(ngrams.ngram_rows(train, "text", order))
        asked = ngrams.ngram_rows(held, "text", order, keep=("segment_id",))
        scored = ngrams.sequence_scores(ngrams.log_probabilities(asked, counts, alpha=alpha, size=ngrams.vocabulary_size(counts)), "segment_id")
        bits = tokenizers.bits_per_unit(scored.join(held, "segment_id").withColumn("nll", -F.col("log_score")), nll="nll", tokens="symbols", text="text")
        out = out.crossJoin(F.broadcast(bits.select("bits_per_char", "bits_per_byte")))  # one row
    return result_rows(out)


__all__ = ["REQUIRED", "RESULT_COLUMNS", "checked", "represented", "run"]
