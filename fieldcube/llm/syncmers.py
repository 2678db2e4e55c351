"""Document fingerprints from closed syncmers, DataFrame functions only.

A text is a sequence of units, its words in parts of four characters at most. A
k-mer is ``K`` units in a row, its s-mers are ``S`` in a row. A k-mer is a closed
syncmer when its smallest s-mer, by hash, is its first or last one. That depends
on the k-mer alone, so an edit elsewhere never moves an anchor. The fingerprint
holds all anchors of a text, each with its position, so it grows with the text
(two of K - S + 1 k-mers are anchors). Two fingerprints match by position: anchors with
equal hashes count where another such pair has the same distance between its
positions, so that whole passages match and lone common phrases don't.

Scale: a text's arrays are all that a task holds. For the comparison with the next
document, ids are ordered by a range shuffle of ids alone; texts shuffle once, by
key, and a third of each once more with its fingerprint, to the document that takes it over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcube.llm import scratch

UNIT = r"\S{1,4}"
K, S = 10, 2
#: Bits of an anchor, from the top: hash, side (used in matching only), position (units, modulo 2^23).
HASH_BITS, PLACE_BITS = 40, 23


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def smers(text: Column) -> Column:
    """The hashes of all runs of ``S`` = 2 units."""
    return let(
        F.regexp_extract_all(text, F.lit(UNIT), 0),
        lambda u: F.zip_with(F.slice(u, 1, F.greatest(F.size(u) - 1, F.lit(0))), F.slice(u, 2, F.greatest(F.size(u) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)),
    )


def anchors(text: Column) -> Column:
    """The closed syncmers of a text in order: hash and position as one number."""
    last = K - S  # s-mers of a k-mer: 0..last

    def of(s: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            inner = F.least(*[F.get(s, i + j) for j in range(1, last)])
            found = F.xxhash64(x, *[F.get(s, i + j) for j in range(S, last + 1, S)])
            return F.when(F.least(x, F.get(s, i + last)) <= inner, F.shiftleft(found, 64 - HASH_BITS).bitwiseOR(i.cast("long").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))))

        return F.array_compact(F.transform(F.slice(s, 1, F.greatest(F.size(s) - last, F.lit(0))), at))

    return let(smers(text), of)


def fingerprint(text: Column) -> Column:
    """All anchors of a text; a text without any has its own hash in their place."""
    return let(anchors(text), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.shiftleft(F.xxhash64(text), 64 - HASH_BITS))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the different hashes of two fingerprints that match by position.

    Each hash counts at its first place in a text. A pair of places counts if another
    pair has the same distance, or if it is the only one.
    """
    hash_of = lambda x: F.shiftrightunsigned(x, 64 - HASH_BITS)
    place_of = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(1 << PLACE_BITS)))))

    def firsts(u: Column) -> Column:
        return F.filter(u, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, PLACE_BITS) != F.shiftrightunsigned(F.get(u, i - 1), PLACE_BITS)))

    def share(w: Column) -> Column:
        pair = lambda x, i: F.when((i > 0) & (hash_of(x) == hash_of(F.get(w, i - 1))), place_of(x) - place_of(F.get(w, i - 1)))
        return let(F.sort_array(F.array_compact(F.transform(w, pair))), lambda d: _supported(d) / (F.size(w) - F.size(d)))

    return let(let(both, firsts), share)


def _supported(d: Column) -> Column:
    """How many of sorted numbers equal a neighbour; all of one."""
    held = F.filter(d, lambda x, i: F.coalesce(x == F.get(d, i + 1), F.lit(False)) | F.coalesce((i > 0) & (x == F.get(d, F.greatest(i - 1, F.lit(0)))), F.lit(False)))
    return F.when(F.size(d) == 1, 1).otherwise(F.size(held))


def as_text(f: Column) -> Column:
    """A fingerprint as hex digits, 16 an anchor: ten of its hash, six of its position."""
    return F.array_join(F.transform(f, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def successors(ids: DataFrame) -> DataFrame:
    """(key, next_key) for rows (id, key) in descending order of id, nulls last, then key; the last's next is the first."""
    order = [F.col("id").desc_nulls_last(), F.col("key")]
    placed = scratch.table(ids.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "successor-ids")
    inside = placed.withColumn("_next", F.lead("key").over(W.partitionBy("_part").orderBy(*order)))
    first = placed.groupBy("_part").agg(F.min_by("key", F.struct(F.col("id").isNull(), F.bitwise_not("id"), "key")).alias("_first"))  # a row a partition
    ring = first.withColumn("_over", F.coalesce(F.lead("_first").over(W.orderBy("_part")), F.min_by("_first", "_part").over(W.partitionBy()))).select("_part", "_over")
    return inside.join(F.broadcast(ring), "_part").select("key", F.coalesce("_next", "_over").alias("next_key"))


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last third of the text replaced by as much of the
    next document's start, in descending order of id (nulls last; after the last,
    the first). Null texts count as empty. Rows with equal id and text are one
    document for this order, each with a row of its own; rows with equal ids and
    other texts follow in the order of their hash. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    texts = texts.select("id", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), "text"), 256)).alias("key"), "text")
    made = scratch.table(texts.select("id", "key", F.char_length("text").cast("long").alias("n")), "syncmer-ids")
    once = made.groupBy("id", "key").agg(F.first("n").alias("n"))
    pairs = scratch.table(successors(once.select("id", "key")).join(once.select("key", "n"), "key"), "syncmer-next")
    third = F.floor(F.col("n") / 3).cast("int")
    keyed = texts.select("key", "text")  # the same exchange serves both joins
    starts = keyed.join(pairs.withColumnRenamed("key", "for"), F.col("key") == F.col("next_key")).select("for", "n", F.substring("text", F.lit(1), third).alias("start"), fingerprint(F.col("text")).alias("next_fp"))
    starts = starts.groupBy("for").agg(*[F.first(c).alias(c) for c in ("n", "start", "next_fp")])
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - third).cast("int")), F.col("start"))
    full = keyed.join(starts, F.col("key") == F.col("for")).select("key", "next_fp", fingerprint(F.col("text")).alias("fp"), edited.alias("edited"))
    full = full.select("key", "next_fp", "fp", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    full = full.groupBy("key").agg(*[F.first(c).alias(c) for c in ("next_fp", "fp", "edited_sha256", "edited_fp")])
    return made.join(full, "key").select(
        F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
