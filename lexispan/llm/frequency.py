"""Frequency of every distinct term, in a vertical layout.

Records get dense numbers; every term has one compressed bitmap for each block of
65,536 record numbers, built for each batch before the shuffle and merged by union
after it, with a counter of occurrences beside it.  A bitmap is held in the shortest
of three forms: a sorted list of places, a list of runs, or plain bits.  So a term
that is in one record costs a few bytes, and one that is in all records a single
run.  Blocks of a term are disjoint, so its document frequency is the sum of their
cardinalities, and a term that is in every record is spread over as many groups as
there are blocks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.operators.ranking import ranked
from lexispan.session import cut

BLOCK = 1 << 16
_PLACES, _RUNS, _BITS = b"p", b"r", b"b"


def _plain_token(tokens: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        ends = lambda c: c.isspace() or unicodedata.category(c) in ("Cf", "Zs", "Zl", "Zp", "Cc")
        a, b = 0, len(x)
        while a < b and ends(x[a]):
            a += 1
        while b > a and ends(x[b - 1]):
            b -= 1
        return unicodedata.normalize("NFC", unicodedata.normalize("NFC", x[a:b]).lower())

    known: dict[str | None, str | None] = {x: one(x) for x in tokens.drop_duplicates()}
    return tokens.map(lambda x: known[x] if x is None or x in known else one(x))


@F.pandas_udf(T.StringType())
def plain_token(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A term without case, outer spaces and format characters, composed (NFC)."""
    for tokens in batches:
        yield _plain_token(tokens.astype(object).where(tokens.notna(), None))


def valid_reports(reports: DataFrame) -> DataFrame:
    """(file, token, count) of the latest report of each file and letter, both in plain form.

    Void rows (null file, token or count) are left out; a path is the same with
    either slash and with or without leading ``./``.  Of reports with the same time
    the one with the highest count is valid; a null time is the earliest.  A token
    that is empty in plain form is left out.
    """
    path = F.regexp_replace(F.translate("file", "\\", "/"), r"^(\./)+", "")
    rows = (
        reports.where(F.col("file").isNotNull() & F.col("token").isNotNull() & F.col("count").isNotNull())
        .select(path.alias("file"), plain_token("token").alias("token"), F.struct("audited_at", "count").alias("row"))
        .where(F.col("token") != "")
    )
    return rows.groupBy("file", "token").agg(F.max("row").alias("row")).select("file", "token", F.col("row.count").alias("count"))


def compressed(places: np.ndarray) -> bytes:
    """The bitmap with the given places (sorted, each once, below BLOCK) in the shortest of its three forms."""
    small = places.astype(np.uint16)
    starts = np.flatnonzero(np.append(True, np.diff(places) != 1)) if len(places) else np.zeros(0, dtype=np.int64)
    if 4 * len(starts) < min(2 * len(small), BLOCK // 8):
        lengths = np.diff(np.append(starts, len(small))) - 1
        return _RUNS + np.stack([small[starts], lengths.astype(np.uint16)], axis=1).tobytes()
    if 2 * len(small) <= BLOCK // 8:
        return _PLACES + small.tobytes()
    bits = np.zeros(BLOCK, dtype=np.uint8)
    bits[places] = 1
    return _BITS + np.packbits(bits).tobytes()


def places_of(bitmap: bytes) -> np.ndarray:
    """The places of a compressed bitmap, in order."""
    if bitmap[:1] == _BITS:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8, offset=1)))
    values = np.frombuffer(bitmap, dtype=np.uint16, offset=1).astype(np.int64)
    if bitmap[:1] == _PLACES:
        return values
    starts, sizes = values[::2], values[1::2] + 1
    return np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())


def cardinality(bitmap: bytes) -> int:
    if bitmap[:1] == _BITS:
        return int(np.bitwise_count(np.frombuffer(bitmap, dtype=np.uint8, offset=1)).sum())
    values = np.frombuffer(bitmap, dtype=np.uint16, offset=1)
    return len(values) if bitmap[:1] == _PLACES else int(values[1::2].sum(dtype=np.int64)) + len(values) // 2


def union(bitmaps: list[bytes]) -> bytes:
    if len(bitmaps) == 1:
        return bitmaps[0]
    bits = np.zeros(BLOCK, dtype=bool)
    for bitmap in bitmaps:
        bits[places_of(bitmap)] = True
    return compressed(np.flatnonzero(bits))


def numbered(df: DataFrame, record: str) -> DataFrame:
    """(record, record_no) with dense numbers from 0: positions in the order of the records, by prefix sums over range partitions."""
    return ranked(df.select(record).distinct(), [F.col(record)], rank="_no").select(record, (F.col("_no") - 1).alias("record_no"))


_BITMAP = "term string, block long, records binary, occurrences long"


def term_bitmaps(df: DataFrame, *, record: str, term: str, count: str, numbers: DataFrame | None = None) -> DataFrame:
    """(term, block, records, occurrences): one compressed bitmap for each term and block of record numbers.

    Defined cases: rows with a null record or term are left out, a null count adds
    nothing; repeated rows of a record add to the occurrences and set one bit.
    `numbers` has (record, record_no) if they are known.
    """
    rows = df.select(F.col(record).alias("_record"), F.col(term).cast("string").alias("_term"), F.col(count).cast("long").alias("_count")).where(
        F.col("_record").isNotNull() & F.col("_term").isNotNull()
    )
    # The records of a term are first folded, so a hot record meets its number once for each term.
    folded = rows.groupBy("_record", "_term").agg(F.coalesce(F.sum("_count"), F.lit(0)).alias("_count"))
    own = numbered(rows, "_record") if numbers is None else numbers.select(F.col(record).alias("_record"), "record_no")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            no, count = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            which = np.asarray(coded.indices)
            order = np.lexsort((no, which))
            which, no, count = which[order], no[order], count[order]
            block = no // BLOCK
            starts = np.flatnonzero(np.append(True, (np.diff(which) != 0) | (np.diff(block) != 0)))
            ends = np.append(starts[1:], len(no))
            maps = [compressed(no[a:b] % BLOCK) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(which[starts])), pa.array(block[starts]), pa.array(maps, pa.binary()), pa.array(np.add.reduceat(count, starts))],
                names=["term", "block", "records", "occurrences"],
            )

    placed = folded.join(own, "_record").select("_term", F.col("record_no").cast("long"), "_count")
    return merge_bitmaps(placed.mapInArrow(build, _BITMAP))


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """Union of bitmaps of several builds that share record numbers; counters are added up.

    The parts of one block come sorted to one task, which holds one block's bits at a time.
    """
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[str, int] | None = None
        maps: list[bytes] = []
        total, out = 0, []

        def flush(done: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names=["term", "block", "records", "occurrences"])

        for batch in batches:
            for term, block, records, occurrences in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (term, block):
                    if key is not None:
                        out.append((*key, union(maps), total))
                    key, maps, total = (term, block), [], 0
                maps.append(records)
                total += occurrences
                if len(maps) >= 64:
                    maps = [union(maps)]
            if len(out) >= 10_000:
                yield flush(out)
                out = []
        if key is not None:
            out.append((*key, union(maps), total))
        if out:
            yield flush(out)

    return rows.select("term", "block", "records", "occurrences").repartition("term", "block").sortWithinPartitions("term", "block").mapInArrow(merge, _BITMAP)


@F.pandas_udf(T.LongType())
def bitmap_size(records: pd.Series) -> pd.Series:
    """Cardinality of each compressed bitmap."""
    return pd.Series([cardinality(x) for x in records], dtype="int64")


def term_frequencies(bitmaps: DataFrame) -> DataFrame:
    """(term, records, occurrences): document frequency from cardinality, and the summed counters."""
    return (
        bitmaps.select("term", bitmap_size("records").alias("n"), "occurrences")
        .groupBy("term")
        .agg(F.sum("n").alias("records"), F.sum("occurrences").alias("occurrences"))
    )


def marked_terms(
    df: DataFrame, *, record: str, term: str, count: str, min_records: int = 3, min_occurrences: int = 5, common_share: float = 0.5
) -> DataFrame:
    """(term, records, occurrences, mark): mark is rare, common or null.

    Rare: in fewer than `min_records` records or fewer than `min_occurrences` times
    in all.  Common: in at least `common_share` of all records.  In a table so small
    that a term is both, it is rare.  An empty table gives no rows.
    """
    known = cut(df.select(record, term, count).where(F.col(record).isNotNull()))
    numbers = cut(numbered(known, record))
    found = term_frequencies(term_bitmaps(known, record=record, term=term, count=count, numbers=numbers))
    rare = (F.col("records") < min_records) | (F.col("occurrences") < min_occurrences)
    common = F.col("records") >= F.lit(numbers.count()) * F.lit(common_share)
    return found.select("term", "records", "occurrences", F.when(rare, "rare").when(common, "common").alias("mark"))
