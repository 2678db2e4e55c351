"""Best-fit packing of token sequences by a configuration linear program.

Documents longer than a sequence are cut; what matters then is the histogram of
piece lengths, whose size is bounded by the sequence length however many pieces
there are. The program over configurations (which lengths share a sequence) is
solved by multiplicative weights: lengths that are covered least weigh most, and
a knapsack over the weights prices the next configuration. Fractional counts are
rounded down, then up where pieces and the room that must stay empty anyway allow it;
what that leaves is priced again, and the last pieces are packed best-fit on the
histogram, longest first. All lengths take part, however few pieces there are. The
plan is never worse than best fit alone: both are made, and the shorter one is taken.

Scale: tokens are counted where the rows are; pieces (numbers only) get a rank
among those of equal length by two levels of chunks, so that a length that a third
of all pieces have spreads out; rank and the plan, of bounded size, give the
sequence and the place in it by arithmetic. Nothing but the histogram reaches
the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcube.llm import scratch, tokens

ITERATIONS = 300
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_configuration(value: np.ndarray, capacity: int) -> dict[int, int]:
    """The lengths (index of ``value``) of the most valuable configuration: unbounded knapsack."""
    best, chosen = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
    top = len(value) - 1
    for c in range(1, capacity + 1):
        n = min(c, top)
        got = best[c - n : c][::-1] + value[1 : n + 1]
        k = int(np.argmax(got))
        best[c], chosen[c] = (got[k], k + 1) if got[k] > best[c - 1] else (best[c - 1], 0)
    found: dict[int, int] = {}
    c = capacity
    while c > 0:
        if k := int(chosen[c]):
            found[k] = found.get(k, 0) + 1
        c -= k or 1
    return found


def solve(histogram: np.ndarray, capacity: int, iterations: int = ITERATIONS) -> list[tuple[dict[int, int], int]]:
    """Whole configurations and their counts, from the linear program; they never exceed the histogram, nor leave more room than the least number of sequences does."""
    need, lengths = histogram.astype(float), np.arange(len(histogram))
    total = int(lengths @ histogram)
    if not total:
        return []
    has, covered, share = need > 0, np.zeros(len(need)), total / capacity / iterations
    counts: dict[tuple, float] = {}
    rate = math.log(has.sum() + 1)
    for k in range(iterations):
        lag = np.where(has, covered - (k + 1) / iterations, 0.0)
        value = np.where(has, np.exp(-rate * np.clip(lag * iterations / 8, -4, 4)) / np.maximum(need, 1), 0.0)
        value *= lengths > 0
        found = best_configuration(value / value.max() + 1e-9 * lengths * has, capacity)
        for length, n in found.items():
            covered[length] += share * n / need[length]
        key = tuple(sorted(found.items(), reverse=True))
        counts[key] = counts.get(key, 0.0) + share
    left, out = histogram.copy(), []
    room = -total % capacity

    def take(config: dict[int, int], most: int) -> int:
        nonlocal room
        waste = capacity - sum(length * m for length, m in config.items())
        n = min([most, *(int(left[length]) // m for length, m in config.items()), *([room // waste] if waste else [])])
        if n > 0:
            out.append((config, n))
            room -= n * waste
            for length, m in config.items():
                left[length] -= n * m
        return n

    for key, x in sorted(counts.items(), key=lambda kv: -kv[1]):
        take(dict(key), int(x))
    for key, _ in sorted(counts.items(), key=lambda kv: -(kv[1] % 1)):
        take(dict(key), 1)
    # What rounding left is priced again, at values near the lengths, each configuration as often as it fits;
    # larger lengths are worth a little more, so that short ones remain to fill the last sequences.
    while (usable := (left >= capacity // np.maximum(lengths, 1)) & (left > 0)).any():
        found = best_configuration(np.where(usable, lengths + 0.1 * (lengths / capacity) ** 2, 0.0), capacity)
        if not take(found, 1 << 60):
            break
    return out


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: equal open sequences are handled together."""
    room: dict[int, list[list]] = {}  # room left -> [configuration, count]
    for length in range(len(histogram) - 1, 0, -1):
        n = int(histogram[length])
        while n > 0:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                each = capacity // length
                whole, part = divmod(n, each)
                for m, count in ((each, whole), (part, 1)):
                    if m and count:
                        room.setdefault(capacity - m * length, []).append([{length: m}, count])
                break
            config, count = room[fit].pop()
            if not room[fit]:
                del room[fit]
            each = min(fit // length, n)
            taken = min(count, n // each)
            if count > taken:
                room.setdefault(fit, []).append([config, count - taken])
            room.setdefault(fit - each * length, []).append([config | {length: config.get(length, 0) + each}, taken])
            n -= each * taken
    return [(config, count) for entries in room.values() for config, count in entries]


def pack_histogram(histogram: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations and counts that hold each length exactly as often as ``histogram`` says."""
    left, planned = histogram.copy(), solve(histogram, capacity)
    for config, n in planned:
        for length, m in config.items():
            left[length] -= n * m
    packed, plain = planned + best_fit(left, capacity), best_fit(histogram, capacity)
    return min(packed, plain, key=lambda x: sum(n for _, n in x))


def plan_table(configs: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, first offset), sorted."""
    rows, ranks, sequence = [], {}, 0
    for config, n in configs:
        at = 0
        for length, m in sorted(config.items(), reverse=True):
            rows.append((length, ranks.get(length, 0), m, sequence, at))
            ranks[length] = ranks.get(length, 0) + n * m
            at += length * m
        sequence += n
    return np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5)


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents; of a longer document the first piece holds the remainder."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode_ids(tokenizer, batch.column(1), end_id), strict=True):
                n = len(ids) // 4
                first = n % capacity or capacity if n > capacity else n
                bounds = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for column, x in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str, *, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Rows with equal ids are packed each
    for itself; ids are whole numbers or null. Other columns of ``docs`` don't matter.
    An empty table gives no rows.
    """
    pieces = cut(docs, tokenizer, end_id, capacity, id_col=id_col, text_col=text_col)
    rows = scratch.table(pieces.withColumn("_at", F.monotonically_increasing_id()), "pack-pieces")  # numbers, so that repeated rows spread
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        histogram[length] = n
    whole, histogram[capacity] = int(histogram[capacity]), 0
    configs = pack_histogram(histogram, capacity) + ([({capacity: 1}, whole)] if whole else [])
    plan = plan_table(configs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(rank) else plan[:0]
            inside = rank - at[:, 1]
            sequence, offset = at[:, 3] + inside // at[:, 2], at[:, 4] + inside % at[:, 2] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    chunks = math.isqrt(sum(counts.values())) + 1
    chunked = rows.withColumn("_chunk", F.pmod(F.xxhash64("_at"), F.lit(chunks)))
    starts = chunked.groupBy("length", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("length", "_chunk", (F.sum("_n").over(W.partitionBy("length").orderBy("_chunk")) - F.col("_n")).alias("_start")).hint("merge")
    inside = W.partitionBy("length", "_chunk").orderBy("_at")
    ranked = chunked.withColumn("_row", F.row_number().over(inside)).join(starts, ["length", "_chunk"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_start") + F.col("_row") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(place, OUT)
