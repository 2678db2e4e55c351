"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles, as 64-bit hashes. Each is
XOR-ed into sketches: a bit of one whose length is about eight times the difference
allowed, a power of two that folds to 512 bits, and one of P words of 64 bits. An element in one set only changes at most one bit, and at most one word,
so the Hamming distance of the sketches is a lower bound of the symmetric
difference. Two sets of sizes a and b with similarity s differ in at most
(a + b)(1 - s)/(1 + s) elements. Sizes fall into bands that grow by 1/s, so that
linked documents lie in the same or adjacent bands, and for each pair of bands
P is the difference allowed plus one and a quarter more: then over a quarter as many
words are equal (pigeonhole), and the words are the join keys. Ordered by frequency,
a document's keys but the last quarter already hold an equal one, so it drops its
most frequent keys: first the words without elements, which are the same for all,
then those that lie in passages that many documents share. Bands of small sets have
more words, so that words with elements suffice but for a set in a million.

Documents with equal word sequences are one class, and only its first one joins.
1. Keys shuffle once and leave those of one class only; the at most ``HOT`` keys
   with over 1/HOT of all, found by an exact count in two steps, stay where they are.
2. Each key's members meet its leader, the one that shares most keys; pairs whose
   long sketches are close enough are verified on the sets.
3. Members of a key that are in different components by then meet each other, in
   blocks of ``BLOCK``, by their 512 bits; again the close ones are verified.
So every link is either verified or within a component that is known, and a group
of near copies makes pairs in proportion to its size. Components are labelled by
the smallest id that links reach.

Scale: keys are about (1 - s) times the words, 16 bytes each. Sets are made again,
from the texts, for documents in pairs only: up to 134 million of these a filter
keeps the other texts from shuffling, beyond that the texts shuffle. Skewed joins of
pairs with their sets are left to adaptive execution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcube.llm import exact_dedup, scratch, tokens

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 1024
#: Rows whose sketches a worker holds together.
ROWS = 500
SIGNATURE_WORDS = 8
#: The share of sets that may have too few words with elements.
EMPTY = 1e-6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of a sequence of word hashes; a shorter sequence is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    width, count = min(n, size), max(1, n - size + 1)
    h = np.full(count, width, np.uint64)
    for k in range(width):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + count])
    return np.unique(h)


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


class Bands:
    """Size bands for a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        cuts = [1]
        while cuts[-1] < 1 << 45:
            cuts.append(max(cuts[-1] + 1, -(-cuts[-1] * 100 // percent)))
        self.cuts = np.array(cuts)

    def allowed(self, a, b):
        """The largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def words(self, t: int) -> tuple[int, int]:
        """(number of sketch words, how many may be dropped) for the pair of bands that starts with band t."""
        low = int(self.cuts[t + 1]) - 1
        high = min(int(self.cuts[t + 2]) - 1, low * 100 // self.percent)
        least = int(self.allowed(low, high)) + 1
        parts, smallest = least + least // 4, int(self.cuts[t])
        while least > 1 and smallest >= 2 * least and log_choose(parts, least - 1) + smallest * math.log((least - 1) / parts) > math.log(EMPTY):
            parts += 1 + parts // 8  # a union bound on the sets whose elements lie in fewer words than needed
        return parts, parts - least

    @lru_cache(maxsize=1024)  # noqa: B019
    def groups(self, band: int) -> list[tuple[int, int, int]]:
        """(group, number of sketch words, how many may be dropped) for the pairs of bands that a band belongs to."""
        return [(t, *self.words(t)) for t in range(max(0, band - 1), band + 1)]

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.cuts, size, "right")) - 1


@lru_cache(maxsize=8)
def bands(percent: int) -> Bands:
    return Bands(percent)


def sketch_keys(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The join keys, and how many more of each group's may be dropped.

    Keys are each group's sketch words, hashed with group and place; words without
    elements go first, in order. The last bit is the group's, which tells a set's
    two groups apart and is the index of the second result.
    """
    out, slack, known = [], np.zeros(2, np.int64), bands(percent)
    for t, parts, more in known.groups(known.band(len(shingles))):
        place = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        order = np.argsort(place, kind="stable")
        sorted_ = place[order]
        firsts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
        filled = sorted_[firsts].astype(np.int64)
        word = np.bitwise_xor.reduceat(mixed(shingles[order]), firsts)
        empty = parts - len(filled)
        if empty > more:
            left = np.setdiff1d(np.arange(parts), filled)[more:]
            filled, word = np.concatenate([filled, left]), np.concatenate([word, np.zeros(len(left), np.uint64)])
        key = mixed(word + mixed(filled.astype(np.uint64) + np.uint64(t << 40)))
        out.append((key & ~np.uint64(1)) | np.uint64(t & 1))
        slack[t & 1] = max(0, more - empty)
    return np.concatenate(out), slack


def signature(shingles: np.ndarray, words: int = SIGNATURE_WORDS) -> np.ndarray:
    """The parity sketch of 64 * ``words`` bits, a power of two; the sketch of half as many is the XOR of its halves."""
    bit = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bit.astype(np.uint8)).view(np.uint64)


def wide_words(size: int, percent: int) -> int:
    """Words of a set's long sketch."""
    return max(SIGNATURE_WORDS, 1 << int(bands(percent).allowed(size, size) // 8).bit_length())


def folded(wide: np.ndarray) -> np.ndarray:
    """The 512 bits of a long sketch."""
    return np.bitwise_xor.reduce(wide.reshape(-1, SIGNATURE_WORDS), 0)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of a text's words, A-Z in lower case."""
    return F.transform(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0), lambda w: F.xxhash64(w))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    at = 0
    for stop in ends.tolist():
        yield values[at:stop]
        at = stop


def _int_lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)), pa.array(flat))


def _sketch(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Rows (_id, _row, _words, _mark) to _id, _row, _sha (of the word sequence), n, sig, wide, slack, keys, _mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            digests, counts, sigs, wides, slacks, keys = [], [], [], [], [], []
            for words in _lists(batch.column(2)):
                s = shingle_set(words, size)
                digests.append(xxhash.xxh3_128_hexdigest(words.tobytes()))
                counts.append(len(s))
                wides.append(signature(s, wide_words(len(s), percent)))
                sigs.append(folded(wides[-1]))
                found, more = sketch_keys(s, percent) if len(s) else (s, np.zeros(2, np.int64))
                slacks.append(more)
                keys.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.string()), pa.array(counts, pa.int64()), _int_lists(sigs), _int_lists(wides), _int_lists(slacks), _int_lists(keys), batch.column(3)], names=["_id", "_row", "_sha", "n", "sig", "wide", "slack", "keys", "_mark"])

    return docs.mapInArrow(run, "_id long, _row long, _sha string, n long, sig array<long>, wide array<long>, slack array<long>, keys array<long>, _mark long")


def _close(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and long sketches don't rule out. Sizes that pass have sketches of at most two lengths, one twice the other."""
    of = lambda c: reps.select(F.col("_row").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))
    xor = lambda x, y: F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))

    def fold(w: Column, words: Column) -> Column:
        return F.when(F.size(w) > words, xor(F.slice(w, 1, words), F.slice(w, words + 1, words))).otherwise(w)

    words = F.least(F.size("wa"), F.size("wb"))
    far = F.aggregate(xor(fold(F.col("wa"), words), fold(F.col("wb"), words)), F.lit(0), lambda s, x: s + F.bit_count(x))
    least, most = F.least("na", "nb"), F.greatest("na", "nb")
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(least * 100 >= most * percent)
    return sized.where(far * (100 + percent) <= (least + most) * (100 - percent)).select("a", "b", "na", "nb")


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose sets are similar enough: exact, on sets made from the texts."""
    pairs = scratch.table(pairs, "ngram-close")
    needed = scratch.table(pairs.select(F.col("a").alias("_row")).union(pairs.select("b")).distinct().join(reps.select("_row", "_id", "_sha"), "_row"), "ngram-needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = list(_lists(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_hexdigest(w.tobytes()) for w in words], pa.string()), _int_lists([shingle_set(w, size) for w in words])], names=["_id", "_sha", "set"])

    texts, _ = exact_dedup.split_ids(docs, needed.select("_id").distinct())
    # matched by id and by the digest of the words: rows that share an id may have other texts
    made = texts.select("_id", word_hashes(F.col("_text")).alias("_words")).mapInArrow(run, "_id long, _sha string, set array<long>")
    sets = made.alias("m").join(needed.alias("r"), (F.col("m._sha") == F.col("r._sha")) & F.col("m._id").eqNullSafe(F.col("r._id"))).select("r._row", "m.set")
    of = lambda c: sets.select(F.col("_row").alias(c), F.col("set").alias(f"set{c}"))
    both = F.size(F.array_intersect("seta", "setb"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(both * 100 >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of undirected ``edges`` (a, b): comp is the smallest node reached.

    Large-star and small-star steps in turn: every node's larger neighbours, then
    its smaller ones, are linked to the smallest one, until nothing changes. Minima
    are combined on the map side, and the few nodes with many neighbours meet these
    by broadcast. A written table a step.
    """

    def step(links: DataFrame, key: str, other: str) -> DataFrame:
        """Links (key, other) with ``least``, the smallest ``other`` of the key or the key itself."""
        least = scratch.table(links.groupBy(key).agg(F.min(other).alias("_m"), F.count(F.lit(1)).alias("_d")).select(key, F.least(key, "_m").alias("least"), "_d"), "least")
        return exact_dedup.by_key(links, least, key, "_d", links.count())

    def seen(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while before != (now := seen(links)):
        before = now
        both = scratch.table(links.union(links.select("b", "a")), "links")
        large = step(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = scratch.table(large, "links")
        small = step(large, "a", "b")
        small = small.select("a", "least").union(small.select("b", "least")).toDF("a", "b").where("a <> b").distinct()
        links = scratch.table(small, "links")
    named = links.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return named.union(links.select("b", "b").distinct())


def frequent(keys: DataFrame, total: int) -> DataFrame:
    """(key, _n) of the at most HOT keys with over 1/HOT of all ``total`` rows (key, _mark), but for those of one mark: counts by a hash of 16 bits first, then by key where these are large."""
    bucket = F.pmod(F.shiftrightunsigned("key", 17), F.lit(1 << 16)).alias("_bucket")
    many = F.count(F.lit(1)).alias("_n")
    large = scratch.table(keys.groupBy(bucket).agg(many).where(F.col("_n") * exact_dedup.HOT > total).select("_bucket"), "ngram-buckets")
    counted = keys.withColumn("_bucket", bucket).join(F.broadcast(large), "_bucket").groupBy("key").agg(many, F.min("_mark").alias("_lo"), F.max("_mark").alias("_hi"))
    return counted.where((F.col("_n") * exact_dedup.HOT > total) & (F.col("_lo") != F.col("_hi"))).select("key", "_n")


def is_hot(hot: DataFrame) -> Column:
    """Whether a key is among the HOT ones at most of ``hot``."""
    return F.col("key").isin([r["key"] for r in hot.select("key").collect()])


def shared_keys(sketched: DataFrame, hot: DataFrame) -> DataFrame:
    """(_mark, key, _n) of the keys that occur in several classes; _n counts their rows; ``hot``: :func:`frequent`."""
    keys = sketched.select("_mark", F.explode("keys").alias("key")).where("key is not null and _mark is not null")  # or a later join says so, to one use of the exchange only
    dealt = keys.where(~is_hot(hot)).select("key", "_mark").repartition("key")
    counts = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("_mark").alias("_lo"), F.max("_mark").alias("_hi")).where("_lo <> _hi").select("key", "_n")
    once = lambda rows: rows.groupBy("_mark", "key").agg(F.max("_n").alias("_n"))  # noqa: E731  copies of a text, where they are
    return once(dealt.join(counts.hint("shuffle_hash"), "key")).union(once(keys.where(is_hot(hot)).join(F.broadcast(hot), "key")))


def met_by_key(rows: DataFrame, hot: DataFrame, *aggregates: Column) -> DataFrame:
    """``rows`` with the aggregates of their key: other keys' rows shuffle once, the hot ones' stay where they are and get theirs by broadcast."""
    rows = rows.where(" and ".join(f"{c} is not null" for c in rows.columns))  # or a later filter says so, to one use of the exchange only
    dealt = rows.where(~is_hot(hot)).repartition("key")
    cold = dealt.join(dealt.groupBy("key").agg(*aggregates).hint("shuffle_hash"), "key")
    own = rows.where(is_hot(hot))
    return cold.unionByName(own.join(F.broadcast(own.groupBy("key").agg(*aggregates)), "key"))


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of a key's members that are in different components and whose sketches are close; rows: key, _n (members of the key), _row, comp, n, sig."""
    blocks = F.ceil(F.col("_n") / BLOCK)
    mine = F.pmod(F.xxhash64("_row"), "_b")
    split = rows.withColumn("_b", blocks).withColumn("_own", mine).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    split = split.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).select("key", "_i", "_j", "_own", "_row", "comp", "n", "sig")

    def pairs(rows: dict[str, np.ndarray], lo: int, hi: int, out: set) -> None:
        comp, n, sig, ids = rows["comp"][lo:hi], rows["n"][lo:hi], rows["sig"][lo:hi], rows["_row"][lo:hi]
        if (comp == comp[0]).all():
            return
        cross = rows["_i"][lo] != rows["_j"][lo]
        for k in range(0, hi - lo, 64):
            far = np.bitwise_count(sig[k : k + 64, None] ^ sig[None]).sum(2)
            least, most = np.minimum(n[k : k + 64, None], n[None]), np.maximum(n[k : k + 64, None], n[None])
            ok = (ids[k : k + 64, None] < ids[None]) & (comp[k : k + 64, None] != comp[None]) & (least * 100 >= most * percent) & (far * (100 + percent) <= (least + most) * (100 - percent))
            if cross:
                ok &= rows["_own"][lo:hi][k : k + 64, None] != rows["_own"][None, lo:hi]
            out.update((int(ids[k + x]), int(ids[y])) for x, y in zip(*np.nonzero(ok), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, np.ndarray] | None = None

        def flush(rows: dict[str, np.ndarray], final: bool) -> tuple[dict[str, np.ndarray], pa.RecordBatch]:
            place = np.stack([rows["key"], rows["_i"], rows["_j"]])
            starts = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(0)])
            bounds = np.r_[starts, place.shape[1]] if final else starts
            out: set = set()
            for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                if hi - lo > 1:
                    pairs(rows, lo, hi, out)
            found = np.array(sorted(out), np.int64).reshape(-1, 2)
            return {c: x[bounds[-1] :] for c, x in rows.items()}, pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                rows = {c: batch.column(c).to_numpy() for c in ("key", "_i", "_j", "_own", "_row", "comp", "n")}
                rows["sig"] = batch.column("sig").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SIGNATURE_WORDS)
                rows = {c: np.concatenate([left[c], x]) for c, x in rows.items()} if left else rows
                left, found = flush(rows, False)
                yield found
        if left and len(left["key"]):
            yield flush(left, True)[1]

    return split.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j").mapInArrow(run, "a long, b long").distinct()


def _linked(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: _id, _row, _mark (of the word sequence), n, keep_id, component_id, and root, the component's own number; the last three hold for n > 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    worded = rows.select("_id", F.monotonically_increasing_id().alias("_row"), word_hashes(F.col("_text")).alias("_words")).withColumn("_mark", F.xxhash64("_words"))
    sketched, path = scratch.written(_sketch(worded, shingle, percent), "ngram-sketches")
    slim = scratch.table(sketched.select("_id", "_row", "_mark", "n"), "ngram-rows")
    worded = sketched.where("n > 0")
    marks = exact_dedup.marked_rows(worded.select("_id", "_row", "_sha"), exact_dedup.SLICE_ROWS)
    reps = scratch.table(sketched.select("_row", "_id", "_sha", "_mark", "n", "sig", "wide", "slack").join(marks.where("kept").select("_row"), "_row"), "ngram-reps")
    total = worded.agg(F.sum(F.size("keys"))).first()[0] or 0
    hot = scratch.table(frequent(worded.select("_mark", F.explode("keys").alias("key")), total), "ngram-hot")
    # by marks from here to the keys that stay, in one shuffle; classes whose marks agree by chance both get the keys, a superset of theirs
    keyed = shared_keys(worded, hot).repartition("_mark").join(reps.select("_mark", "_row", "slack"), "_mark")
    own = W.partitionBy("_mark", "_row", F.col("key").bitwiseAND(F.lit(1)))
    ranked = keyed.withColumn("_rank", F.row_number().over(own.orderBy(F.col("_n").desc(), F.col("key").desc())))
    rare = ranked.where(F.col("_rank") > F.get("slack", F.col("key").bitwiseAND(F.lit(1)).cast("int")))
    scored = rare.withColumn("score", F.count(F.lit(1)).over(W.partitionBy("_mark", "_row"))).select("_row", "key", "score")
    shared = scratch.table(scored, "ngram-keys")
    scratch.drop(docs.sparkSession, path)  # the largest table by far
    led = met_by_key(shared, hot, F.max_by("_row", F.struct("score", "_row")).alias("lead"))
    stars = led.where("_row <> lead").select(F.least("_row", "lead").alias("a"), F.greatest("_row", "lead").alias("b")).distinct()
    first = scratch.table(_verify(_close(stars, reps, percent), rows, reps, shingle, percent), "ngram-links")
    known = scratch.table(components(first), "ngram-components")
    members = shared.select("key", "_row").join(known, F.col("_row") == F.col("node"), "left").select("key", "_row", F.coalesce("comp", "_row").alias("comp"))
    mixed = met_by_key(members, hot, F.count("_row").alias("_n"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select("key", "_n", "_row", "comp")
    mixed = scratch.table(mixed, "ngram-mixed").join(reps.select("_row", "n", "sig"), "_row")
    more = scratch.table(_verify(_close(_across(mixed, percent), reps, percent), rows, reps, shingle, percent), "ngram-links")
    found = scratch.table(components(known.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more)), "ngram-components")
    named = found.join(reps.select(F.col("_row").alias("node"), "_id"), "node").groupBy("comp").agg(F.min("_id").alias("component_id"), F.count(F.lit(1)).alias("_d"))
    of_class = exact_dedup.by_key(found, scratch.table(named, "ngram-named"), "comp", "_d", found.count()).select(F.col("node").alias("keep_row"), "component_id", "comp")
    classed = marks.select("_row", "keep_row", "keep_id").join(of_class, "keep_row", "left")
    return slim.join(classed, "_row", "left").withColumn("root", F.coalesce("comp", "keep_row"))


def link(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_id, component_id.

    Two rows link when the Jaccard similarity of their shingle sets is percent / 100
    or more. class_id: smallest id of the rows with the same words; component_id:
    smallest id that links reach. Null and empty texts have no shingles, a
    component of their own each, and link with nothing. Null ids count as larger
    than any other. Rows with equal ids count each for itself. An empty table
    gives no rows.
    """
    full = _linked(docs, shingle, percent, id_col, text_col)
    return full.select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("keep_id")).otherwise(F.col("_id")).alias("class_id"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "keep_id")).otherwise(F.col("_id")).alias("component_id"),
    )


def keep_first(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of :func:`link`, that with the smallest id, all columns kept. Rows without shingles stay.

    Rows are known by id and words, so that rows that share an id, or have none, are
    judged each for itself; of those with equal ids and equal words any one stays.
    Only rows whose id is that of a row that goes shuffle, except for a filter's errors.
    """
    full = scratch.table(_linked(docs, shingle, percent, id_col, text_col).where("n > 0").select("_id", "_row", "_mark", "root"), "ngram-rooted")
    order = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    first = full.groupBy("root").agg(order.alias("_first")).select(F.col("_first.row").alias("_row"), F.lit(True).alias("first"))
    texts = full.join(first, "_row", "left").groupBy("_id", "_mark").agg(F.count(F.lit(1)).alias("_n"), F.max(F.coalesce("first", F.lit(False))).alias("first"))
    judged = scratch.table(texts.where("not first or _n > 1").select("_id", "_mark", "first"), "ngram-judged")
    # a mark of no words is no one's in ``judged``, so that rows without shingles stay
    return exact_dedup.without_judged(docs, judged, id_col, lambda doc: F.xxhash64(word_hashes(doc.getField(text_col))))
