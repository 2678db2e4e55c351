"""Exact dedup by two passes over a blocked Bloom filter, DataFrame functions only.

Pass 1 counts each hash's place in the filter (64-bit block, three bits in it)
and sets the bits of the places that occur more than once. Pass 2 tests every
row against that filter on the map side. Rows whose bits aren't all set have a
text that occurs once: they go straight through. Only the others shuffle, by
digest, so a false positive costs a little work and never changes a result.

Scale: the filter grows with the rows, eight bits each, and is cut by hash into
slices of at most ``slice_rows`` rows: rows are written into a folder a slice, and
the slices follow each other, each with its own filter of bounded size (64 words
a row of the broadcast table). So a row is read once however many slices there are.
Pass 1 moves a number and a count a row, combined on the map side. A group of copies of
any size is combined on the map side; its result reaches its rows through a
broadcast of the at most ``HOT`` groups that hold over 1/HOT of the candidates,
and through a shuffle join for the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcube.llm import scratch

#: A run of white space that isn't one space already.
SPACE_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
HOT = 4096
#: Rows of a slice: its filter has 2^30 bits, 128 MB.
SLICE_ROWS = 1 << 27
#: Words of 64 bits in a row of the broadcast filter.
SEGMENT = 64
#: Ids up to which a filter over them is broadcast, 2^30 bits.
FILTER_ROWS = 1 << 27


def text_digest(text: Column) -> Column:
    """SHA-256 in lowercase hex of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "), 256)


def with_place(df: DataFrame, digest: str, blocks: int) -> DataFrame:
    """Add ``_place``, a digest's place in the filter: the block's number, then three bits in it, six binary digits each."""
    h = F.xxhash64(digest)
    return df.withColumn("_place", F.shiftleft(h.bitwiseAND(F.lit(blocks - 1)), 18).bitwiseOR(F.shiftrightunsigned(h, 40).bitwiseAND(F.lit((1 << 18) - 1))))


def block_and_bits(place: str = "_place") -> tuple[Column, Column]:
    """A place's block and the three bits as a 64-bit word."""
    p = F.col(place)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(p, k).bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftrightunsigned(p, 18).alias("_block"), bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12)).alias("_bits")


def set_bits(placed: DataFrame) -> DataFrame:
    """A filter as (_segment, _words): the bits of all places, ``SEGMENT`` blocks a row."""
    blocks = placed.select(*block_and_bits()).groupBy("_block").agg(F.bit_or("_bits").alias("_set"))
    at = F.pmod("_block", F.lit(SEGMENT)).cast("int").alias("i")
    found = blocks.groupBy(F.floor(F.col("_block") / SEGMENT).alias("_segment")).agg(F.map_from_entries(F.collect_list(F.struct(at, "_set"))).alias("_m"))
    return found.select("_segment", F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0))).alias("_words"))


def filter_blocks(rows: int) -> int:
    """A power of two that gives eight bits a row or more."""
    return 1 << max(4, (max(rows, 1) // 8).bit_length())


def repeated_filter(placed: DataFrame) -> DataFrame:
    """Pass 1: the filter with the bits of all places that occur more than once."""
    return set_bits(placed.groupBy("_place").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))


def split(placed: DataFrame, bloom: DataFrame) -> DataFrame:
    """Pass 2: add ``_maybe``, true for rows whose place a filter has: those that may be meant."""
    tested = placed.select("*", *block_and_bits()).withColumn("_segment", F.floor(F.col("_block") / SEGMENT)).join(F.broadcast(bloom), "_segment", "left")
    word = F.get("_words", F.pmod("_block", F.lit(SEGMENT)).cast("int"))
    return tested.withColumn("_maybe", F.coalesce(word.bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False))).drop("_segment", "_words", "_block", "_bits", "_place")


def sliced(rows: DataFrame, digest: str, slice_rows: int, name: str) -> list[DataFrame]:
    """``rows``, written by slices of the hash; a table for each."""
    slices = -(-max(1, rows.count()) // slice_rows)
    cut = scratch.table(rows.withColumn("_slice", F.pmod(F.xxhash64(digest, F.lit("slice")), F.lit(slices)).cast("int")), name, by="_slice")
    return [cut.where(F.col("_slice") == k).drop("_slice") for k in range(slices)]


def by_key(rows: DataFrame, table: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join with a table of one row per key, ``size`` being the key's rows of ``total``: the at most HOT frequent keys by broadcast, the others by shuffle."""
    hot = F.col(size) * HOT > total
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(F.broadcast(table.where(hot)), key).unionByName(rest.join(table.where(~hot), key))


def marked_rows(digests: DataFrame, slice_rows: int) -> DataFrame:
    """Rows of ``digests`` (_id, _row, _sha) with keep_id, keep_row, group_size, kept."""
    kept = F.col("_row") == F.col("_first.row")
    out = ["_id", "_row", "_sha", F.col("_first.id").alias("keep_id"), F.col("_first.row").alias("keep_row"), "group_size", kept.alias("kept")]
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    done = []
    for rows in sliced(digests, "_sha", slice_rows, "dedup-digests"):
        placed = with_place(rows, "_sha", filter_blocks(rows.count()))
        tested = split(placed, scratch.table(repeated_filter(placed), "dedup-filter"))
        candidates = scratch.table(tested.where("_maybe").drop("_maybe"), "dedup-candidates")
        groups = scratch.table(candidates.groupBy("_sha").agg(first.alias("_first"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
        grouped = by_key(candidates, groups, "_sha", "group_size", candidates.count()).select(*out)
        alone = tested.where("not _maybe").select("_id", "_row", "_sha", F.col("_id").alias("keep_id"), F.col("_row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        done.append(scratch.table(alone.unionByName(grouped), "dedup-marked"))
    return reduce(DataFrame.unionByName, done)


def mark(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. A null id counts as larger than
    any other. Of rows with equal text and equal id one is kept. Other columns of
    ``docs``, whatever their names, don't matter. An empty table gives no rows.
    """
    digests = docs.select(F.col(id_col).alias("_id"), text_digest(F.col(text_col)).alias("_sha")).withColumn("_row", F.monotonically_increasing_id())
    return marked_rows(digests, slice_rows).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def split_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose _id may be among ``ids`` (distinct), and the others: by a filter up to FILTER_ROWS ids, beyond that by a join. Null is an id like others."""
    many = ids.count()
    if many > FILTER_ROWS:
        joined = lambda how: docs.alias("d").join(ids.alias("i"), F.col("d._id").eqNullSafe(F.col("i._id")), how)
        return joined("left_semi"), joined("left_anti")
    blocks = filter_blocks(many)
    tested = split(with_place(docs, "_id", blocks), scratch.table(set_bits(with_place(ids, "_id", blocks)), "id-filter"))
    return tested.where("_maybe").drop("_maybe"), tested.where("not _maybe").drop("_maybe")


def without_judged(docs: DataFrame, judged: DataFrame, id_col: str, mark: Callable[[Column], Column]) -> DataFrame:
    """The rows of ``docs`` that don't go, all columns kept.

    ``judged`` has distinct (_id, _mark, first): rows with this id and mark go, but for one of
    those with ``first``. ``mark`` makes a row's mark from its struct. Only rows whose id is
    judged shuffle, except for a filter's errors.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("_doc"), F.col(id_col).cast(judged.schema["_id"].dataType).alias("_id"))  # of one type, for equal hashes
    maybe, others = split_ids(rows, judged.select("_id").distinct())
    maybe = maybe.select("_doc", "_id", mark(F.col("_doc")).alias("_mark")).alias("a")
    match = lambda b: (F.col("a._mark") == F.col(f"{b}._mark")) & F.col("a._id").eqNullSafe(F.col(f"{b}._id"))
    stay = others.select("_doc").unionByName(maybe.join(judged.alias("b"), match("b"), "left_anti").select("_doc"))
    again = judged.where("first")
    if not again.isEmpty():
        stay = stay.unionByName(maybe.join(again.alias("c"), match("c"), "left_semi").groupBy("_id", "_mark").agg(F.first("_doc").alias("_doc")).select("_doc"))
    return stay.select("_doc.*")


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns kept; see :func:`mark` for the rule.

    A row whose id isn't one of a row that goes is never shuffled, except for a filter's
    errors; up to FILTER_ROWS such ids, beyond which all rows shuffle once.
    """
    digests = docs.select(F.col(id_col).alias("_id"), text_digest(F.col(text_col)).alias("_sha")).withColumn("_row", F.monotonically_increasing_id())
    marked = marked_rows(digests, slice_rows).where("group_size > 1")
    texts = marked.groupBy("_id", F.col("_sha").alias("_mark")).agg(F.count(F.lit(1)).alias("_n"), F.max("kept").alias("first"))
    judged = scratch.table(texts.where("not first or _n > 1").select("_id", "_mark", "first"), "dedup-judged")
    return without_judged(docs, judged, id_col, lambda doc: text_digest(doc.getField(text_col)))
