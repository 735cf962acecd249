"""Top N items within every group, however large a group is.

The rows are range-partitioned and sorted by (group, score descending, item).
Only the groups at the edges of a partition can go on in another one, so each
partition reports the row counts of its groups once, the counts are prefix-summed
over the partitions, and a row's exact position is its position within its
partition plus the rows of its group in earlier partitions.  No group is ever
held by one task, and only rows that can still reach the first N leave a
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_masses(usage: DataFrame) -> DataFrame:
    """Valid (form_key, surface, expected_mass): void rows (a null, or a mass of NaN) go first, then the latest exported_at of each pair counts.

    Of rows with the same time the one with the highest mass counts; a null time is the earliest.
    """
    kept = usage.where(
        F.col("form_key").isNotNull() & F.col("surface").isNotNull() & F.col("expected_mass").isNotNull() & ~F.isnan("expected_mass")
    ).select("form_key", "surface", F.struct("exported_at", "expected_mass").alias("row"))
    return kept.groupBy("form_key", "surface").agg(F.max("row").alias("row")).select("form_key", "surface", F.col("row.expected_mass").alias("expected_mass"))


def _local_ranks(group: str, item: str, n: int):
    """Of a sorted partition: rows among the first n of their group, and one count row for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen = None, 0  # the group of the last row, and its rows so far

        def counted(groups: list, counts: list) -> pa.RecordBatch:
            m = len(groups)
            return pa.RecordBatch.from_arrays(
                [pa.array(groups, type=pa.string()), pa.nulls(m, pa.string()), pa.array([part] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(counts, pa.int64())],
                names=["group", "item", "part", "local_no", "rows"],
            )

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            keys = batch.column(0)
            changes = np.empty(m, dtype=bool)
            changes[0] = keys[0].as_py() != last
            if m > 1:
                changes[1:] = pc.not_equal(keys.slice(1), keys.slice(0, m - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(changes)
            ended = [] if last is None or not changes[0] else [(last, seen)]
            begin = np.zeros(m, dtype=np.int64)  # place of row 0 of each row's group
            begin[starts] = starts
            np.maximum.accumulate(begin, out=begin)
            local = np.arange(m) - begin + 1
            if not changes[0]:
                head = starts[0] if len(starts) else m
                local[:head] += seen
            sizes = np.diff(np.append(starts, m))
            if len(starts):
                names = keys.take(pa.array(starts)).to_pylist()
                if not changes[0]:
                    ended.append((last, seen + int(starts[0])))
                ended += list(zip(names[:-1], sizes[:-1].tolist(), strict=True))
                last, seen = names[-1], int(sizes[-1])
            else:
                seen += m
            keep = np.flatnonzero(local <= n)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [keys.take(at), batch.column(1).take(at), pa.array(np.full(len(keep), part, dtype=np.int32)), pa.array(local[keep]), pa.nulls(len(keep), pa.int64())],
                names=["group", "item", "part", "local_no", "rows"],
            )
            if ended:
                yield counted([g for g, _ in ended], [c for _, c in ended])
        if last is not None:
            yield counted([last], [seen])

    return run


def top_in_groups(df: DataFrame, group: str, score: str, item: str, n: int, *, partitions: int | None = None) -> DataFrame:
    """(group, item, rank_no) of the n highest scores of each group; equal scores go by item in code point order.

    Group and item are strings.  Defined cases: rows with a null group, score or
    item, or a score of NaN, are left out; equal (group, item) rows each take a
    rank; groups with fewer than n rows give all of them; an empty table gives no
    rows; other columns are not read.
    """
    rows = df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).alias("_s")).where(
        F.col("_g").isNotNull() & F.col("_i").isNotNull() & F.col("_s").isNotNull()
    )
    if isinstance(df.schema[score].dataType, (T.DoubleType, T.FloatType)):
        rows = rows.where(~F.isnan("_s"))
    order = [F.col("_g"), F.col("_s").desc(), F.col("_i")]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    local = (
        ranged.sortWithinPartitions(*order)
        .select("_g", "_i")
        .mapInArrow(_local_ranks(group, item, n), "group string, item string, part int, local_no long, rows long")
    )
    # Rows of the group in earlier partitions; at most n + 1 rows of a group come from each partition.
    earlier = Window.partitionBy("group").orderBy("part").rangeBetween(Window.unboundedPreceding, -1)
    placed = local.withColumn("rank_no", F.col("local_no") + F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return placed.where(F.col("item").isNotNull() & (F.col("rank_no") <= n)).select(
        F.col("group").alias(group), F.col("item").alias(item), F.col("rank_no").cast("int")
    )
