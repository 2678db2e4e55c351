"""Mixing sources to target weights, DataFrame functions only.

Every source's documents form one stream of words, cut into blocks of
``block_words``. The mix is a table of slots, dealt to output shards of
``shard_slots``. Each slot is drawn from a source, the shards' source counts
being multinomial given the corpus totals (a pseudorandom permutation of all
slots deals them out), so that every source meets its target to the word; free
multinomial draws would miss small targets by their standard deviation. Slot j
of a source takes the block at index permutation(j) of its current pass over the
stream, and blocks join to slots by (source, block index). That table is written once;
all results are read from it: the words that slots take from documents, the
words taken of each document, and how often a document as a whole is in the mix.

Both permutations are swap-or-not networks: closed-form bijections on any range,
so that no slot depends on another one and reruns agree.

Scale: slots and blocks are words / block_words rows of a few numbers; texts
shuffle in :func:`mix` only. Rows that are equal in all that counts are one row with a number of copies,
so that repeated rows are no hot key. Stream offsets come from sums over as many
chunks as the root of the row count, so a source with a third of all rows spreads
like any other and neither a chunk nor a source's list of chunks grows large. Only the table of sources (one row each) is sorted as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcube.llm import scratch

ROUNDS = 12
#: Rows of the table of sources up to which it is broadcast; beyond, joins shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom bijection of 0..n-1, chosen by ``key``: ``ROUNDS`` rounds of swap-or-not."""
    n = F.greatest(n, F.lit(1).cast("long"))

    def step(at: Column, k: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(k, *key), n) - at, n)
        swap = F.xxhash64(F.greatest(at, other), k, *key).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.reduce(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Add rank, weight and target to (source, source_size), one row a source.

    Sources in code point order, null last, get ``weights`` in turn. Targets share
    the sum of all sizes by weight; one above ``most`` times its source's size
    stops there and the excess goes to the others by weight, until none is above.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))
    cap = most * F.col("source_size").cast("double")
    before, everything = W.orderBy("_level", "rank").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    filled = (
        ranked.withColumn("_cap", cap)
        .withColumn("_level", F.col("_cap") / F.col("weight"))
        .withColumn("_all", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_full", F.col("_cap") * F.col("_rest") <= F.col("weight") * F.col("_left"))
    )
    taken, open_ = F.when(F.col("_full"), F.col("_cap")).otherwise(0.0), F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))
    level = (F.col("_all") - F.sum(taken).over(everything)) / F.nullif(F.sum(open_).over(everything), F.lit(0.0))
    return filled.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") * level)).select("source", "rank", "source_size", "weight", "target")


def slots(sources: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """The mix's slots: rank, block, words (taken from the block's start), shard, slot (place in the shard).

    A source's whole passes take each block once; its last, partial pass takes
    blocks in permuted order up to the target, the stream's short last block at
    the end of a pass.
    """
    one = F.lit(1).cast("long")
    size, b = F.col("source_size"), F.lit(block_words).cast("long")
    planned = (
        sources.where(size > 0)
        .withColumn("_goal", F.round("target").cast("long"))
        .withColumn("_passes", F.floor(F.col("_goal") / size))
        .withColumn("_rest", F.col("_goal") - F.col("_passes") * size)
        .withColumn("_blocks", F.ceil(size / b))
        .withColumn("_slots", F.col("_passes") * F.col("_blocks") + F.ceil(F.col("_rest") / b))
        .withColumn("_end", F.sum("_slots").over(W.orderBy("rank")))
        .withColumn("_total", F.sum("_slots").over(W.partitionBy()))
        .where("_slots > 0")
    )
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as runs are few but their slots are many
    runs = planned.withColumn("_run", F.explode(F.sequence(one * 0, F.floor((F.col("_slots") - 1) / 1024)))).repartition(tasks, "rank", "_run")
    each = runs.withColumn("_j", F.explode(F.sequence(F.col("_run") * 1024, F.least(F.col("_run") * 1024 + 1023, F.col("_slots") - 1))))
    each = each.withColumn("_pass", F.floor(F.col("_j") / F.col("_blocks"))).withColumn("_i", F.pmod("_j", "_blocks"))
    last = F.col("_i") == F.col("_blocks") - 1
    length = F.when(last, size - F.col("_i") * b).otherwise(b)
    cut = F.when(F.col("_pass") == F.col("_passes"), F.least(length, F.col("_rest") - F.col("_i") * b)).otherwise(length)
    place = permuted(F.col("_end") - F.col("_slots") + F.col("_j"), F.col("_total"), F.lit("slots"))
    return each.select(
        "rank",
        F.when(last, F.col("_i")).otherwise(permuted(F.col("_i"), F.col("_blocks") - 1, F.col("rank"), F.col("_pass"))).alias("block"),
        cut.alias("words"),
        F.floor(place / shard_slots).alias("shard"),
        F.pmod(place, F.lit(shard_slots).cast("long")).alias("slot"),
    )


def shard_counts(drawn: DataFrame) -> DataFrame:
    """(shard, rank, slots): how many slots each output shard draws from each source."""
    return drawn.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("slots"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def words_in(text: Column) -> Column:
    """Words of a text; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stream(rows: DataFrame, weights: Sequence[float], most: int) -> tuple[DataFrame, DataFrame]:
    """(places, sources) for rows (_id, source, size, _mark): a row per different row with its copies, first (place of its first word in its source's stream; copies follow each other), rank, source_size, target; and :func:`targets`."""
    same = rows.groupBy("_id", "source", "size", "_mark").agg(F.count(F.lit(1)).alias("copies"))
    sized = scratch.table(same.withColumn("_words", F.col("size") * F.col("copies")), "mix-sizes")
    chunks = math.isqrt(sized.count()) + 1
    sources = scratch.table(targets(sized.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most), "mix-sources")
    named = sized.alias("a").join(_few(sources).alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("_id", "a.source", "size", "_mark", "copies", "_words", "rank", "source_size", "target")
    named = named.withColumn("chunk", F.pmod(F.xxhash64("_id", "size", "_mark"), F.lit(chunks)))
    starts = named.groupBy("rank", "chunk").agg(F.sum("_words").alias("_sum"))
    starts = starts.select("rank", "chunk", (F.sum("_sum").over(W.partitionBy("rank").orderBy("chunk")) - F.col("_sum")).alias("_start"))
    before = F.sum("_words").over(W.partitionBy("rank", "chunk").orderBy("_id", "size", "_mark").rowsBetween(W.unboundedPreceding, 0)) - F.col("_words")
    placed = named.withColumn("_before", before).join(starts, ["rank", "chunk"]).withColumn("first", F.col("_start") + F.col("_before"))
    return placed.drop("chunk", "_start", "_before", "_words"), sources


def taken_words(placed: DataFrame, drawn: DataFrame, block_words: int) -> DataFrame:
    """One row for each slot's words in a document, and one with a null shard for each block that no slot takes.

    The columns of ``placed``, copy, and shard, slot, begin (the words' place in the
    document), words, whole (whether the document's first word is among them).
    """
    b = F.lit(block_words).cast("long")
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1024)))
    each = placed.where("size > 0").withColumn("_run", run).repartition("_id", "_mark", "_run")  # copies of a row spread
    each = each.withColumn("copy", F.explode(F.sequence(F.col("_run") * 1024, F.least(F.col("_run") * 1024 + 1023, F.col("copies") - 1)))).drop("_run")
    each = each.withColumn("_from", F.col("first") + F.col("copy") * F.col("size")).withColumn("_to", F.col("_from") + F.col("size"))
    in_blocks = each.withColumn("block", F.explode(F.sequence(F.floor(F.col("_from") / b), F.floor((F.col("_to") - 1) / b))))
    met = in_blocks.join(drawn.withColumnRenamed("words", "_cut").hint("merge"), ["rank", "block"], "left")  # slots grow with the input: never broadcast
    begin, end = F.greatest(F.col("_from"), F.col("block") * b), F.least(F.col("_to"), F.col("block") * b + F.col("_cut"))
    got = F.when(F.col("_cut").isNotNull(), F.greatest(F.lit(0).cast("long"), end - begin))
    whole = F.coalesce((F.col("_from") >= F.col("block") * b) & (F.col("_from") < F.col("block") * b + F.col("_cut")), F.lit(False))
    return met.select(*placed.columns, "copy", "shard", "slot", (begin - F.col("_from")).alias("begin"), got.alias("words"), whole.alias("whole"))


def _mixed(rows: DataFrame, weights: Sequence[float], most: int, block_words: int, shard_slots: int) -> tuple[DataFrame, DataFrame]:
    """(places, taken words) of rows (_id, source, size, _mark); the mix's table of slots is written on the way."""
    placed, sources = stream(rows, weights, most)
    placed = scratch.table(placed, "mix-places")
    drawn = scratch.table(slots(sources, block_words, shard_slots), "mix-slots")
    return placed, taken_words(placed, drawn, block_words)


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, *mark: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), F.xxhash64(*[F.col(f"`{c}`") for c in mark]).alias("_mark"))


def mixed_blocks(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), most: int = 3, block_words: int = 64, shard_slots: int = 4096,
) -> DataFrame:
    """The mix itself, a row for each document in each slot: shard, slot, source, id, copy (among equal rows), begin and words (the range of the document's words)."""
    _, taken = _mixed(_rows(docs, id_col, text_col, source_col, text_col), weights, most, block_words, shard_slots)
    return taken.where("words > 0").select("shard", "slot", "source", F.col("_id").alias(id_col), "copy", "begin", "words")


def mix_table(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), most: int = 3, block_words: int = 64, shard_slots: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, times.

    size: words of the text, 0 if null. taken: words of it that the mix's slots hold,
    repeats counted; at most ``most`` times size. times: the slots that hold its first
    word. A null source is a source of its own. Rows with equal ids count each for
    themselves. Texts without words and sources without words take 0; an empty table
    gives no rows. Other columns of ``docs`` don't matter.
    """
    placed, taken = _mixed(_rows(docs, id_col, text_col, source_col, text_col), weights, most, block_words, shard_slots)
    key = ["_id", "source", "size", "_mark", "rank", "source_size", "target"]
    sums = taken.groupBy(*key, "copy").agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken"), F.sum(F.col("whole").cast("long")).alias("times"))
    zero = F.lit(0).cast("long")
    without = placed.where("size = 0").withColumn("copy", F.explode(F.sequence(zero, F.col("copies") - 1))).select(*key, "copy", zero.alias("taken"), zero.alias("times"))
    return sums.unionByName(without).select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "taken", "times")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), most: int = 3, block_words: int = 64, shard_slots: int = 4096,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept.

    A document is in the mix as a whole, once for each slot that holds its first word.
    Rows without words appear once: they hold no share of any source. Rows that are
    equal in all columns share their slots. An empty table gives no rows.
    """
    marked = [c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]  # what can be hashed
    rows = _rows(docs, id_col, text_col, source_col, *marked)
    placed, taken = _mixed(rows, weights, most, block_words, shard_slots)
    times = taken.groupBy("_id", "_mark", "copies").agg(F.sum(F.col("whole").cast("long")).alias("_times")).where("_times > 0")
    times = times.unionByName(placed.where("size = 0").select("_id", "_mark", "copies", F.col("copies").alias("_times")))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    full = docs.select(own, F.col(id_col).alias("_id"), F.xxhash64(*[F.col(f"`{c}`") for c in marked]).alias("_mark"))
    same = (F.col("a._mark") == F.col("b._mark")) & F.col("a._id").eqNullSafe(F.col("b._id"))
    met = full.alias("a").join(times.alias("b"), same).select("_doc", "a._id", "a._mark", "copies", "_times")
    once = met.where("copies > 1").groupBy("_id", "_mark").agg(F.first("_doc").alias("_doc"), F.first("_times").alias("_times"))
    out = met.where("copies = 1").select("_doc", "_times").unionByName(once.select("_doc", "_times"))
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_doc.*")
