"""Stable identifiers and deterministic sampling by BLAKE2b, which Spark has no function for."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Defaults; to repeat recorded splits or samples, pass the seed they were made with.
SPLIT_SEED = "document_split_v1"
SPLIT_SHARES = (("train", 0.8), ("dev", 0.1), ("test", 0.1))
SAMPLE_SEED = "weighted_lines_v1"


def _digest(size: int):
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda x: None if x is None or x != x else hashlib.blake2b(x.encode("utf-8"), digest_size=size).hexdigest())

    return F.pandas_udf(T.StringType())(run)


blake2b_8, blake2b_12 = _digest(8), _digest(12)


def _unit(keys: pd.Series) -> pd.Series:
    number = lambda x: int.from_bytes(hashlib.blake2b(x.encode("utf-8"), digest_size=8).digest(), "big") / 2**64
    return keys.map(lambda x: None if x is None or x != x else number(x)).astype("float64")


unit_interval = F.pandas_udf(T.DoubleType())(_unit)


def unit_sha256(key: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of SHA-256; stays inside the JVM."""
    return F.conv(F.substr(F.sha2(key, 256), F.lit(1), F.lit(13)), 16, 10).cast("double") / F.lit(float(1 << 52))


UNITS = {"blake2b": unit_interval, "sha256": unit_sha256}


def document_id(source: Column, path: Column) -> Column:
    """doc_ and 24 hex digits of the source without case and the path with forward slashes and no leading ./"""
    plain = F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./)+", "")
    return F.concat(F.lit("doc_"), blake2b_12(F.concat(F.lower(F.trim(source)), F.lit("|"), plain)))


def assigned_split(document: Column, *, seed: str = SPLIT_SEED, shares: tuple[tuple[str, float], ...] = SPLIT_SHARES, digest: str = "blake2b") -> Column:
    """The first split whose cumulative share exceeds the document's number in [0, 1)."""
    total = sum(w for _, w in shares)
    if not shares or total <= 0 or any(w < 0 for _, w in shares):
        raise ValueError("split shares must be positive")
    value, up, out = UNITS[digest](F.concat(F.lit(f"{seed}|"), document)), 0.0, F.lit(shares[-1][0])
    steps = []
    for name, weight in shares:
        up += weight / total
        steps.append((up, name))
    for edge, name in reversed(steps[:-1]):
        out = F.when(value < edge, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def included(path: Column, line_no: Column, weight: Column, *, seed: str = SAMPLE_SEED, digest: str = "blake2b") -> Column:
    """Whether a line is in the weighted sample: always from weight 1, never at 0, else by its own number."""
    value = UNITS[digest](F.concat_ws("|", F.lit(seed), path, line_no.cast("string")))
    return F.when(weight >= 1, True).when(weight <= 0, False).otherwise(value < weight)
