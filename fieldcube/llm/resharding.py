"""Resharding by minimum-cost flow: near-equal shards with the fewest bytes moved.

Rows lie in old shards, in blocks of files. Units, the things that are moved, are
groups of rows with equal texts; a group of more than a quarter of a shard is dealt
into chunks. A minimum-cost flow from the old shards' bytes to the new capacities
says how many bytes go from each old shard to each new one (staying costs nothing).
Units of at least 1/256 of a shard fill those transfers one by one, what fits none
going to the shard with most room; a second flow over the room that is left says what the
small units do, which each old shard gives away in runs of its key order, so that runs are whole blocks but for
their ends. Only blocks with a unit that leaves are written again; the others stay the files they are.

Scale: the driver sees one number a shard, at most 256 large units a shard (more would
not fit in its bytes) and the runs' ends; both flows are over shards. Rows are dealt to files by
(shard, block, chunk), so that neither a hot group of copies nor a hot shard is one
task; the blocks that change are found by partition pruning and their rows by broadcasts of
those bounded lists. Places in shards are ranks over chunks of rows.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcube.llm import scratch

#: Bytes that every row counts besides its text.
ROW_BYTES = 16
#: Of a shard's bytes: a group of more is dealt into chunks of CHUNK; a unit of at least LARGE is placed by itself.
HOT, CHUNK, LARGE = 4, 64, 256
BLOCK_BYTES = 128 << 20


def min_cost_flow(supply: Sequence[int], room: Sequence[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """(from, to) -> amount, for all of the supply, at the least sum of amount * cost; room must hold it.

    Successive shortest paths with potentials over the two-sided graph of shards.
    """
    if sum(supply) > sum(room):
        raise ValueError("the capacities don't hold the supply")
    m, n = len(supply), len(room)
    price = [[cost(i, j) for j in range(n)] for i in range(m)]
    left, free, flow = list(supply), list(room), [[0] * n for _ in range(m)]
    high = [0] * m + [min(price[i][j] for i in range(m)) if m else 0 for j in range(n)]
    while any(left):
        far, via, done = [math.inf] * (m + n), [-1] * (m + n), [False] * (m + n)
        heap = [(-high[i], i) for i in range(m) if left[i]]
        for d, i in heap:
            far[i] = d
        heapq.heapify(heap)
        while heap:
            d, x = heapq.heappop(heap)
            if done[x]:
                continue
            done[x] = True
            if x < m:
                steps = ((m + j, price[x][j]) for j in range(n))
            else:
                steps = ((i, -price[i][x - m]) for i in range(m) if flow[i][x - m])
            for y, c in steps:
                length = d + c + high[x] - high[y]
                if length < far[y]:
                    far[y], via[y] = length, x
                    heapq.heappush(heap, (length, y))
        goal = min((y for y in range(m, m + n) if free[y - m]), key=lambda y: far[y] + high[y])
        for x in range(m + n):
            high[x] += far[x] if done[x] else 0
        path, x = [goal], goal
        while via[x] >= 0:
            x = via[x]
            path.append(x)
        path.reverse()
        amount = min([left[path[0]], free[goal - m], *(flow[y][x - m] for x, y in zip(path, path[1:]) if x >= m)])
        for x, y in zip(path, path[1:]):
            if x < m:
                flow[x][y - m] += amount
            else:
                flow[y][x - m] -= amount
        left[path[0]] -= amount
        free[goal - m] -= amount
    return {(i, j): flow[i][j] for i in range(m) for j in range(n) if flow[i][j]}


def moving(i: int, j: int) -> int:
    """What a byte costs from old shard i to new shard j: one, unless it stays."""
    return int(i != j)


def shares(total: int, n: int) -> list[int]:
    """``total`` in n parts, at most one apart."""
    return [total // n + (j < total % n) for j in range(n)]


def rooms(filled: Sequence[int], more: int) -> list[int]:
    """How much each of the shards takes of ``more`` so that the fullest is as low as can be."""
    order, level = sorted(filled), 0
    for k in range(1, len(order) + 1):
        level = -(-(sum(order[:k]) + more) // k)
        if k == len(order) or level <= order[k]:
            break
    out = [max(0, level - x) for x in filled]
    over = sum(out) - more
    for j in range(len(out)):  # a byte too much in some, from rounding up
        if over and out[j]:
            out[j] -= 1
            over -= 1
    return out


@dataclass
class Plan:
    """Where units go: (old, key, chunk) -> new for the large ones; per old shard the runs (from byte, new) of its small ones."""

    flow: dict[tuple[int, int], int]
    large: dict[tuple[int, int, int], int]
    runs: dict[int, list[tuple[int, int]]]


def plan(small: Sequence[int], large: Sequence[tuple[int, int, int, int]], shards: int, cost: Callable[[int, int], int] = moving) -> Plan:
    """The plan for bytes of small units by old shard, and large units (bytes, old, key, chunk)."""
    supply = list(small)
    for size, old, _, _ in large:
        supply[old] += size
    first = min_cost_flow(supply, shares(sum(supply), shards), cost)
    quota, filled, where, rest = defaultdict(dict), [0] * shards, {}, []
    for (i, j), amount in first.items():
        quota[i][j] = amount
    for size, old, key, chunk in sorted(large, key=lambda u: (-u[0], *u[1:])):
        fits = [j for j, amount in quota[old].items() if amount >= size]
        if not fits:
            rest.append((size, old, key, chunk))
            continue
        j = min(fits, key=lambda j: (cost(old, j), -quota[old][j], j))
        quota[old][j] -= size
        filled[j] += size
        where[old, key, chunk] = j
    heap = [(x, j) for j, x in enumerate(filled)]
    heapq.heapify(heap)
    for size, old, key, chunk in rest:  # those that lie across transfers: to the least filled
        x, j = heapq.heappop(heap)
        heapq.heappush(heap, (x + size, j))
        filled[j] += size
        where[old, key, chunk] = j
    second = min_cost_flow(small, rooms(filled, sum(small)), cost)
    runs: dict[int, list[tuple[int, int]]] = {}
    for i in range(len(small)):
        at, runs[i] = 0, []
        for j in sorted((j for k, j in second if k == i), key=lambda j: (j != i, j)):
            runs[i].append((at, j))
            at += second[i, j]
    return Plan(first, where, runs)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, null having none, and the row's own."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def lay_out(docs: DataFrame, shards: int, *, text_col: str = "text") -> tuple[str, int]:
    """Write ``docs`` by the hash of their text into shards of blocks (a layout as it is before resharding); the folder, and the bits of a block.

    The rows are in ``doc``; key (of the text), chunk and size are kept beside them.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    whole = F.xxhash64(F.coalesce(text, F.lit("")))
    groups = scratch.table(docs.groupBy(whole.alias("hash")).agg(F.sum(text_bytes(text)).alias("size")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = max(2, math.ceil(math.log2(max(1, total / shards / BLOCK_BYTES))))
    hot = groups.where(F.col("size") * HOT * shards > total)  # fewer than HOT * shards rows
    hot = hot.select("hash", F.ceil(F.col("size") * CHUNK * shards / F.lit(max(1, total))).alias("chunks"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), whole.alias("hash"), text_bytes(text).alias("size"), F.monotonically_increasing_id().alias("at"))
    met = rows.join(F.broadcast(hot), "hash", "left")
    chunk = F.coalesce(F.pmod(F.xxhash64("at", "hash"), F.col("chunks")), F.lit(0)).cast("long")
    key = F.shiftrightunsigned("hash", 1)
    out = met.select("doc", key.alias("key"), chunk.alias("chunk"), "size", F.pmod("hash", F.lit(shards)).cast("int").alias("shard"), F.shiftright(key, 63 - bits).cast("int").alias("block"))
    folder = scratch.folder(spark, "shards-old")
    out.repartition("shard", "block", "chunk").write.partitionBy("shard", "block").parquet(folder)
    return folder, bits


def _read(spark, folder: str, like: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    own = [T.StructField(c, T.LongType()) for c in ("key", "chunk", "size")] + [T.StructField(c, T.IntegerType()) for c in ("shard", "block")]
    return spark.read.schema(T.StructType([T.StructField("doc", like.schema), *own])).parquet(folder)


@dataclass
class Resharded:
    """The rows as they lie now, in ``doc`` beside key, chunk, size, shard; and what was done."""

    rows: DataFrame
    plan: Plan
    #: Files' rows that were written again: their predicate on (shard, block) of the old layout.
    changed: Column
    #: Of the old layout: shard, block, key, chunk, size, new shard of every unit.
    units: DataFrame


def reshard(docs: DataFrame, old: str, bits: int, old_shards: int, shards: int, *, cost: Callable[[int, int], int] = moving) -> Resharded:
    """Move the rows of the layout in folder ``old`` into ``shards`` shards; ``docs`` gives their schema.

    Bytes of shards come as near to equal as whole units allow. Rows that stay in
    blocks without a change are read from their old files.
    """
    spark = docs.sparkSession
    layout = _read(spark, old, docs)
    units = scratch.table(layout.groupBy("shard", "block", "key", "chunk").agg(F.sum("size").alias("size")), "shard-units")
    total = units.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    is_large = F.col("size") * LARGE * shards >= total
    large = [tuple(r) for r in units.where(is_large).select("size", "shard", "key", "chunk").collect()]  # at most LARGE * shards
    small = dict(units.where(~is_large).groupBy("shard").agg(F.sum("size")).collect())
    made = plan([small.get(i, 0) for i in range(old_shards)], large, shards, cost)

    in_block = W.partitionBy("shard", "block")
    lines = units.where(~is_large).withColumn("upto", F.sum("size").over(in_block.orderBy("key", "chunk").rowsBetween(W.unboundedPreceding, 0)))
    blocks = units.where(~is_large).groupBy("shard", "block").agg(F.sum("size").alias("bytes"))
    blocks = blocks.select("shard", "block", (F.sum("bytes").over(W.partitionBy("shard").orderBy("block")) - F.col("bytes")).alias("start"))
    middle = F.col("start") + F.col("upto") - F.col("size") / 2
    ends = spark.createDataFrame([(i, at, j) for i, runs in made.runs.items() for at, j in runs], "shard int, at long, new int")
    met = lines.join(blocks, ["shard", "block"]).select("shard", "key", "chunk", middle.alias("middle")).join(F.broadcast(ends), "shard").where("middle >= at")
    firsts = met.groupBy("shard", "at", "new").agg(F.min(F.struct("key", "chunk")).alias("first")).collect()  # at most a row a run
    cuts = spark.createDataFrame(
        [(i, [(r["first"]["key"], r["first"]["chunk"], r["new"]) for r in sorted((r for r in firsts if r["shard"] == i), key=lambda r: r["at"])]) for i in range(old_shards)],
        "shard int, cuts array<struct<key: long, chunk: long, new: int>>",
    )
    placed = spark.createDataFrame([(i, k, c, j) for (i, k, c), j in made.large.items()], "shard int, key long, chunk long, large int")

    def sent(rows: DataFrame) -> DataFrame:
        """Rows with the shard they go to in ``new``."""
        found = rows.join(F.broadcast(placed), ["shard", "key", "chunk"], "left").join(F.broadcast(cuts), "shard", "left")
        here = F.filter("cuts", lambda c: (c["key"] < F.col("key")) | (c["key"] == F.col("key")) & (c["chunk"] <= F.col("chunk")))
        return found.withColumn("new", F.coalesce("large", F.try_element_at(here, F.lit(-1))["new"])).drop("large", "cuts")

    changed = _changed(made, {r["shard"]: sorted((q for q in firsts if q["shard"] == r["shard"]), key=lambda q: q["at"]) for r in firsts}, bits)
    folder = scratch.folder(spark, "shards-new")
    moved = sent(layout.where(changed)).select("doc", "key", "chunk", "size", F.col("new").alias("shard"), "block", F.col("shard").alias("from"))
    moved.repartition("shard", "from", "block", "chunk").drop("from").write.partitionBy("shard", "block").parquet(folder)
    rows = layout.where(~changed).unionByName(_read(spark, folder, docs)) if _any(spark, folder, docs) else layout
    return Resharded(rows, made, changed, sent(units))


def _any(spark, folder: str, like: DataFrame) -> bool:
    return bool(_read(spark, folder, like).select("shard").head(1))


def _changed(made: Plan, firsts: dict[int, list], bits: int) -> Column:
    """On the partition columns of the old layout: does a unit leave this block?"""
    blocks: dict[int, set[int]] = defaultdict(set)
    for (i, key, _), j in made.large.items():
        if i != j:
            blocks[i].add(key >> (63 - bits))
    hit = F.lit(False)
    for i, found in blocks.items():
        hit = hit | (F.col("shard") == i) & F.col("block").isin(*sorted(found))
    for i, cuts in firsts.items():
        for k, cut in enumerate(cuts):
            if cut["new"] != i:
                last = cuts[k + 1]["first"]["key"] >> (63 - bits) if k + 1 < len(cuts) else (1 << bits) - 1
                hit = hit | (F.col("shard") == i) & F.col("block").between(cut["first"]["key"] >> (63 - bits), last)
    return hit


def slots(rows: DataFrame) -> DataFrame:
    """``rows`` (shard, key, chunk, id, ...) with slot: their place in the shard, from 0 without gaps, by chunk of rows, key and id."""
    n = rows.count()
    chunks = math.isqrt(n) + 1
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("key", "chunk", "id"), F.lit(chunks)))
    starts = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("shard", "_part", (F.sum("_n").over(W.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_start"))
    row = F.row_number().over(W.partitionBy("shard", "_part").orderBy("key", "chunk", "id"))
    return dealt.withColumn("_row", row).join(starts, ["shard", "_part"]).withColumn("slot", (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_part", "_row", "_start")


def shard_table(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    The rows are laid out by the hash of their text over ``shards`` shards, which equal
    texts make uneven, then resharded; the columns are read from the shards' files.
    Equal texts share a shard unless they hold over a quarter of one. A null text has no
    bytes. Null and repeated ids and repeated rows are rows like others; an empty
    table gives no rows. Other columns of ``docs`` are carried along and don't matter.
    """
    folder, bits = lay_out(docs, shards, text_col=text_col)
    done = reshard(docs, folder, bits, shards, shards)
    text = F.col("doc").getField(text_col)
    rows = done.rows.select(F.col("doc").getField(id_col).alias("id"), text_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), "shard", "key", "chunk")
    ranked = slots(scratch.table(rows, "shard-rows"))
    return ranked.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
