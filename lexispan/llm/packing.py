"""Filling fixed-capacity windows with documents: harmonic packing.

Lengths fall into reciprocal-capacity classes: class j holds lengths of more than
capacity / (j + 1) and at most capacity / j, and a window of class j holds j of its
documents.  Taken alone that leaves up to half of each window empty, so the room that
j documents of a class leave is topped up by fixed counts of documents of later
classes.  Windows of one make (the same lengths of class j, the same top-up) are one
kind.  The kinds are planned class by class from the counts of lengths only, of which
there are no more than the capacity has tokens.  A document then finds its window
from its length and its position among those of that length, independently of all
others: positions are exact counts within (length, salt) plus the prefix-summed
counts of the salts before, so no length is ever held by one task.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext, SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which the vocabulary's texts were split into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_SENT: set[tuple[str, str]] = set()


def _send(context: SparkContext, path: str) -> None:
    """Gives the vocabulary file to all executors, once for each application."""
    if (context.applicationId, path) not in _SENT:
        context.addFile(path)
        _SENT.add((context.applicationId, path))


def token_counts(df: DataFrame, key: str, text: str, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens): tokens of each whole text; null and empty texts have none.  Special tokens' strings are ordinary text."""

    _send(df.sparkSession.sparkContext, tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            sizes = [len(count(x)) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, type=pa.int64())], names=["key", "n_tokens"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n_tokens", T.LongType())])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Window kinds for the given counts of lengths: ([(length, uses)], windows), class after class.

    A window of class j (lengths over capacity / (j + 1) and up to capacity / j) is
    led by exactly j documents of the class, the longest left; only the last window
    of a class may have fewer.  What room they leave is topped up with the longest of
    later classes that fit.  All lengths are used up.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    classes: dict[int, list[int]] = {}
    for length in sorted(left, reverse=True):
        classes.setdefault(capacity // length, []).append(length)
    open_lengths = 0
    for length in left:
        open_lengths |= 1 << length
    kinds: list[tuple[list[tuple[int, int]], int]] = []
    for j in sorted(classes):
        members = [length for length in classes[j] if left[length]]
        while members:
            room, lacking, uses = capacity, j, {}
            for length in members:
                uses[length] = n = min(lacking, left[length])
                room, lacking = room - n * length, lacking - n
                if not lacking:
                    break
            fitting = open_lengths & ((1 << capacity // (j + 1) + 1) - 1)  # later classes
            while fitting := fitting & ((1 << (room + 1)) - 1):
                length = fitting.bit_length() - 1
                uses[length] = n = min(room // length, left[length])
                room -= n * length
                fitting &= ~(1 << length)
            windows = min(left[length] // n for length, n in uses.items())
            for length, n in uses.items():
                left[length] -= n * windows
                if not left[length]:
                    open_lengths &= ~(1 << length)
            kinds.append((sorted(uses.items(), reverse=True), windows))
            members = [length for length in members if left[length]]
    return kinds


def _window_of(kinds: list[tuple[list[tuple[int, int]], int]], first: int) -> tuple[np.ndarray, ...]:
    """Lookup arrays: from (length, position) to a window number."""
    used: dict[int, int] = {}
    rows = []
    for lengths, windows in kinds:
        for length, n in lengths:
            at = used.get(length, 0)
            rows.append((length, at, first, n))
            used[length] = at + n * windows
        first += windows
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pack_windows(sizes: DataFrame, *, capacity: int = 2048, rows_a_salt: int = 100_000) -> DataFrame:
    """Windows for documents of (key, n_tokens).

    Returns (key, piece_no, first_token, n_tokens, class_no, window_id).  A document
    longer than the capacity is cut into full windows of its own and a rest that is
    packed like a document; no other is cut.  Documents without tokens take no room:
    piece 0 with a null window.  Rows with a null size count as without tokens; keys
    may repeat, each row is an item; an empty table gives no rows.
    """
    salts = max(16, -(-sizes.count() // rows_a_salt))
    n = F.coalesce("n_tokens", F.lit(0))
    full = F.floor(n / capacity).cast("long")
    pieces = sizes.select("key", n.alias("all_tokens"), full.alias("full"), (n % capacity).alias("rest"))
    # Whole windows: their numbers come after the packed ones, from the position of the long document.
    item = pieces.where("rest > 0").select(
        "key", F.col("full").alias("piece_no"), (F.col("full") * capacity).alias("first_token"), F.col("rest").alias("n_tokens")
    )
    item = item.withColumn("class_no", F.floor(capacity / F.col("n_tokens")).cast("int"))
    item = cut(item.withColumn("salt", F.pmod(F.xxhash64("key", "piece_no"), F.lit(salts))))
    by_salt = item.groupBy("n_tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = by_salt.select(
        "n_tokens", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier")
    )
    # At most `capacity` rows come to the driver, however many documents there are.
    counts = {row["n_tokens"]: row["n"] for row in by_salt.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    kinds = plan_windows(counts, capacity)
    packed_windows = sum(windows for _, windows in kinds)
    arrays = _window_of(kinds, 0)

    @F.pandas_udf(T.LongType())
    def window_id(length: pd.Series, position: pd.Series) -> pd.Series:
        key, start, base, uses = arrays
        place = position.to_numpy(dtype=np.int64)
        at = np.searchsorted(key, (length.to_numpy(dtype=np.int64) << 44) + place, side="right") - 1
        return pd.Series(base[at] + (place - start[at]) // uses[at])

    within = Window.partitionBy("n_tokens", "salt").orderBy("key", "piece_no")
    packed = (
        item.withColumn("no", F.row_number().over(within))
        .join(before, ["n_tokens", "salt"])
        .select("key", "piece_no", "first_token", "n_tokens", "class_no", window_id("n_tokens", F.col("no") - 1 + F.col("earlier")).alias("window_id"))
    )
    long_rows = pieces.where("full > 0").select("key", "full").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    taken = long_rows.groupBy("salt").agg(F.sum("full").alias("n"))
    shift = taken.select("salt", F.coalesce(F.sum("n").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))  # `salts` rows
    running = Window.partitionBy("salt").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    whole = (
        long_rows.withColumn("inner", F.coalesce(F.sum("full").over(running), F.lit(0)))
        .join(shift, "salt")
        .select("key", (F.lit(packed_windows) + F.col("earlier") + F.col("inner")).alias("first_window"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece_no"))
        .select(
            "key", "piece_no", (F.col("piece_no") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"),
            F.lit(1).alias("class_no"), (F.col("first_window") + F.col("piece_no")).alias("window_id"),
        )
    )
    nothing = pieces.where("all_tokens = 0").select(
        "key", F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"),
        F.lit(None).cast("int").alias("class_no"), F.lit(None).cast("long").alias("window_id"),
    )
    return packed.unionByName(whole).unionByName(nothing)


def harmonic_windows(sizes: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """(class_no, documents, windows, tokens) if each reciprocal class filled windows of its own: the unrefined packing, for comparison."""
    rests = sizes.select((F.coalesce("n_tokens", F.lit(0)) % capacity).alias("n_tokens")).where("n_tokens > 0")
    by_class = rests.groupBy(F.floor(capacity / F.col("n_tokens")).cast("int").alias("class_no")).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens")
    )
    return by_class.select("class_no", "documents", F.ceil(F.col("documents") / F.col("class_no")).alias("windows"), "tokens")


def document_windows(documents: DataFrame, *, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """Training windows of documents (doc_id, text): (doc_id, piece_no, first_token, n_tokens, class_no, window_id)."""
    return pack_windows(cut(token_counts(documents, "doc_id", "text", tokenizer=tokenizer)), capacity=capacity).withColumnRenamed("key", "doc_id")


def window_fill(windows: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """One row: windows, tokens, the share of room that is filled, and windows that are over capacity (none)."""
    each = windows.where(F.col("window_id").isNotNull()).groupBy("window_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    return each.agg(
        F.count(F.lit(1)).alias("windows"), F.sum("tokens").alias("tokens"), F.max("pieces").alias("most_pieces"),
        F.try_divide(F.sum("tokens"), F.count(F.lit(1)) * capacity).alias("fill"), F.sum((F.col("tokens") > capacity).cast("long")).alias("over"),
    )
