"""Evaluation texts that leak into training text: greedy string tiling.

Texts are compared by their letters.  Documents and items that share a seed (a run
of `seed` letters, compared by Karp-Rabin hash) are compared closely: all maximal
matches are found by a running Karp-Rabin hash of the item's windows, then the
longest match that overlaps no earlier one is marked, again and again, until none
of `seed` letters is left.  The tiles show how much of the item a document holds,
in whatever order.  A document is listed with an item if its longest tile has
`passage` letters or the tiles cover `coverage` of the item.

A seed is looked up at every place of an item but only at each (passage - seed + 1)th
place of a document: a shared run of `passage` letters always holds one of those.
With `coverage` tiles of `seed` letters count too, so there every place of a document
is looked up.
The item side is broadcast while it is within `broadcast_windows`, else both sides
meet by a shuffle on the seed's hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexispan.functions.letters import letters_batch

_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(letters: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64, then scrambled) of the run of `width` letters from each place."""
    n = len(letters) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return _hash_at(letters.astype(np.uint64), np.arange(n), width)


def _hash_at(letters: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    value = np.zeros(len(places), dtype=np.uint64)
    for k in range(width):
        value = value * _BASE + letters[places + k]
    value *= _MIX
    return value ^ (value >> np.uint64(32))


def _hash_all(letters: np.ndarray, width: int) -> np.ndarray:
    """run_hashes by doubling, for long arrays."""
    n = len(letters) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    part, size, power = letters.astype(np.uint64), 1, _BASE
    value, done = np.zeros(len(letters), dtype=np.uint64), 0  # hash of the first `done` letters from each place
    bits = width
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                value = value[: len(part) - done] * power + part[done : done + len(value)] if done else part
                done += size
            bits >>= 1
            if bits:
                part = part[:-size] * power + part[size:]
                size, power = 2 * size, power * power
        value = value[:n] * _MIX
    return value ^ (value >> np.uint64(32))


def seeds_of(letters: np.ndarray, starts: np.ndarray, width: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and hash of the runs at each `step`th place of each text."""
    sizes = np.diff(starts)
    counts = np.maximum(0, (sizes - width) // step + 1)
    counts[sizes < width] = 0
    owner = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(np.append(0, np.cumsum(counts))[:-1], counts)
    place = (np.arange(len(owner)) - first) * step
    if step == 1:
        return owner, place, _hash_all(letters, width)[starts[owner] + place]
    return owner, place, _hash_at(letters.astype(np.uint64), starts[owner] + place, width)


def _chunks(starts: np.ndarray, letters: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many letters, so that a batch's hashes aren't all held at once."""
    low = 0
    while low < len(starts) - 1:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + letters, "right")) - 1)
        yield low, high
        low = high


def tile(document: np.ndarray, item: np.ndarray, least: int, of_document: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two letter arrays: tiles (document place, item place, letters), longest first.

    Of equally long matches the one first in the document, then in the item, is
    marked first.  No letter of either side is in two tiles; none shorter than `least`.
    `of_document` has the document's run hashes if they are known.
    """
    if len(document) < least or len(item) < least:
        return []
    of_item = run_hashes(item, least)
    of_document = _hash_all(document, least) if of_document is None else of_document
    order = np.argsort(of_item, kind="stable")
    known = of_item[order]
    low, high = np.searchsorted(known, of_document, "left"), np.searchsorted(known, of_document, "right")
    at = np.flatnonzero(high > low)
    if not len(at):
        return []
    times = (high - low)[at]
    d = np.repeat(at, times)
    i = order[np.repeat(low[at], times) + np.arange(len(d)) - np.repeat(np.append(0, np.cumsum(times))[:-1], times)]
    # Matches that follow each other on a diagonal are one maximal match.
    by = np.lexsort((d, d - i))
    d, i = d[by], i[by]
    heads = np.flatnonzero(np.append(True, (np.diff(d) != 1) | (np.diff(d - i) != 0)))
    sizes = np.diff(np.append(heads, len(d))) + least - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(sizes, d[heads], i[heads], strict=True) if np.array_equal(document[a : a + n], item[b : b + n])]
    heapq.heapify(heap)
    free_d, free_i = np.ones(len(document), dtype=bool), np.ones(len(item), dtype=bool)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = free_d[a : a + n] & free_i[b : b + n]
        if free.all():
            free_d[a : a + n] = free_i[b : b + n] = False
            tiles.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if y - x >= least:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return tiles


def _measured(document: np.ndarray, item: np.ndarray, seed: int, of_document: np.ndarray | None = None) -> tuple[int, int, int]:
    """Longest tile, letters in tiles, number of tiles."""
    tiles = tile(document, item, seed, of_document)
    return (tiles[0][2], sum(n for *_, n in tiles), len(tiles)) if tiles else (0, 0, 0)


_OUT = ["doc_id", "item_id", "longest", "matched", "tiles", "item_letters"]


def leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    seed: int = 20,
    passage: int = 40,
    coverage: float | None = None,
    broadcast_windows: int = 4_000_000,
) -> DataFrame:
    """(doc_id, item_id, longest, matched, tiles, item_letters) of documents (doc_id, text) and the items (item_id, text) they hold.

    Listed are pairs whose longest tile has at least `passage` letters or, if
    `coverage` is given, whose tiles cover that share of the item.  Defined cases:
    null, empty and short texts hold and are held by nothing; equal items are each
    listed; a document that holds an item many times is listed once; rows with a
    null id are left out; an empty table gives no rows.  Ids should be unique; repeated
    rows of an id are repeated in the result.
    """
    kinds = T.StructType(
        [T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType)]
        + [T.StructField(name, T.LongType()) for name in _OUT[2:]]
    )
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    tests = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    windows = tests.agg(F.coalesce(F.sum(F.length("text") * 2), F.lit(0))).first()[0]  # no letter string is longer than twice its text
    step = passage - seed + 1 if coverage is None else 1
    wanted = (F.col("longest") >= passage) | (F.lit(False) if coverage is None else (F.col("matched") >= F.col("item_letters") * coverage))
    if windows <= broadcast_windows:
        found = _against_broadcast(docs, tests, kinds, seed, step)
    else:
        found = _by_shuffle(docs, tests, kinds, seed, step)
    return found.where(wanted)


def _against_broadcast(docs: DataFrame, tests: DataFrame, kinds: T.StructType, seed: int, step: int) -> DataFrame:
    rows = tests.collect()  # at most broadcast_windows letters
    letters, starts = letters_batch([r["text"] for r in rows])
    owner, _, code = seeds_of(letters, starts, seed, 1)
    order = np.lexsort((owner, code))
    seen = np.zeros(1 << 22, dtype=bool)  # by the upper bits of a hash; most seeds of a document end here
    seen[(code >> np.uint64(42)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], letters, starts, code[order], owner[order], np.packbits(seen)))
    item_type = kinds["item_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, item_letters, item_starts, codes, owners, bits = shared.value
        seen = np.unpackbits(bits).view(bool)
        arrow_item = pa.int64() if isinstance(item_type, T.LongType) else None
        for batch in batches:
            found, at = letters_batch(batch.column(1).to_pylist())
            parts = [np.zeros((0, 2), dtype=np.int64)]
            for a, b in _chunks(at):
                whose, _, code = seeds_of(found[at[a] : at[b]], at[a : b + 1] - at[a], seed, step)
                likely = np.flatnonzero(seen[(code >> np.uint64(42)).astype(np.int64)])
                whose, code = whose[likely] + a, code[likely]
                low = np.searchsorted(codes, code, "left")
                known = np.flatnonzero(codes[np.minimum(low, len(codes) - 1)] == code) if len(codes) else np.zeros(0, dtype=np.int64)
                times = np.searchsorted(codes, code[known], "right") - low[known]
                texts = np.repeat(whose[known], times)
                places = np.repeat(low[known], times) + np.arange(len(texts)) - np.repeat(np.append(0, np.cumsum(times))[:-1], times)
                if len(texts):
                    parts.append(np.unique(np.stack([texts, owners[places]], axis=1), axis=0))
            pairs = np.concatenate(parts)
            measured, last, hashes = [], -1, None
            for d, i in pairs.tolist():  # sorted, so each document is hashed once
                item, document = item_letters[item_starts[i] : item_starts[i + 1]], found[at[d] : at[d + 1]]
                if d != last:
                    last, hashes = d, _hash_all(document, seed)
                measured.append((*_measured(document, item, seed, hashes), len(item)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(pairs[:, 0])),
                    pa.array([ids[i] for i in pairs[:, 1].tolist()], type=arrow_item),
                    *(pa.array([m[k] for m in measured], type=pa.int64()) for k in range(4)),
                ],
                names=_OUT,
            )

    return docs.mapInArrow(run, kinds)


def _by_shuffle(docs: DataFrame, tests: DataFrame, kinds: T.StructType, seed: int, step: int) -> DataFrame:
    def seeded(df: DataFrame, key: str, every: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, at = letters_batch(batch.column(1).to_pylist())
                for a, b in _chunks(at):
                    owner, _, code = seeds_of(found[at[a] : at[b]], at[a : b + 1] - at[a], seed, every)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + a)), pa.array(code.view(np.int64))], names=[key, "code"])

        return df.mapInArrow(run, T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("code", T.LongType())])).distinct()

    pairs = seeded(docs, "doc_id", step).join(seeded(tests, "item_id", 1), "code").select("doc_id", "item_id").distinct()
    texts = pairs.join(docs.withColumnRenamed("text", "doc_text"), "doc_id").join(tests.withColumnRenamed("text", "item_text"), "item_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, d_at = letters_batch(batch.column(2).to_pylist())
            i, i_at = letters_batch(batch.column(3).to_pylist())
            measured = [(*_measured(d[d_at[k] : d_at[k + 1]], i[i_at[k] : i_at[k + 1]], seed), int(i_at[k + 1] - i_at[k])) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([m[k] for m in measured], type=pa.int64()) for k in range(4))], names=_OUT
            )

    return texts.select("doc_id", "item_id", "doc_text", "item_text").mapInArrow(run, kinds)


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Of each item: documents that hold it, the longest passage and the best coverage; items that none holds are listed with 0."""
    by_item = found.groupBy("item_id").agg(
        F.count_distinct("doc_id").alias("documents"), F.max("longest").alias("longest"), F.max(F.try_divide("matched", "item_letters")).alias("coverage")
    )
    return items.select("item_id", "task").join(by_item, "item_id", "left").select(
        "item_id", "task", F.coalesce("documents", F.lit(0)).alias("documents"), "longest", F.round("coverage", 6).alias("coverage")
    )
