"""Fill-in-middle transformation by rank and select over packed line boundaries.

A batch of texts is one run of bytes. Two packed bitvectors lie over it: the bit
of a byte is set if the byte ends a line, or if it begins a character. Each has a
directory with the number of set bits before every block of 512. The popcount
over a text's bytes is its number of lines n; the two cuts, drawn as numbers of
lines from a hash of the document's id, become bytes by a select on the first
vector, and code points by a rank on the second. Newlines are one byte in UTF-8,
so no cut splits a character. Nothing is split or searched line by line.

Scale: one pass over the rows without a shuffle; a row depends on nothing but its
id and text, so a hot source or group of copies is like any other rows, and a lost
task is run again with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a packed vector that a directory entry covers.
BLOCK = 64
#: SELECT[byte, k]: the place of the byte's set bit k, from the lowest.
SELECT = np.array([[*[i for i in range(8) if b >> i & 1], *[8] * (8 - b.bit_count())] for b in range(256)], np.int64)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class Bits:
    """A packed bitvector with popcounts by block: rank and select for arrays of queries."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.packed = np.concatenate([packed, np.zeros(BLOCK - len(packed) % BLOCK, np.uint8)])
        self.counts = np.bitwise_count(self.packed).reshape(-1, BLOCK)
        self.before = np.concatenate([[0], np.cumsum(self.counts.sum(1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        byte = at >> 3
        block = byte // BLOCK
        inside = np.where(np.arange(BLOCK) < (byte % BLOCK)[:, None], self.counts[block], 0).sum(1, dtype=np.int64)
        return self.before[block] + inside + np.bitwise_count(self.packed[byte] & ((1 << (at & 7)) - 1).astype(np.uint8))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of each k-th set bit, the first being k = 1."""
        block = np.searchsorted(self.before, k, "left") - 1
        upto = np.cumsum(self.counts[block], axis=1, dtype=np.int64)
        rest = k - self.before[block]
        byte = (upto < rest[:, None]).sum(1)
        rest -= np.where(byte > 0, np.take_along_axis(upto, np.maximum(byte - 1, 0)[:, None], 1)[:, 0], 0)
        return (block * BLOCK + byte) * 8 + SELECT[self.packed[block * BLOCK + byte], rest - 1]


def cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, prefix_chars, middle_chars) of each text without nulls; its prefix ends after the smaller of h1 and h2 modulo n + 1 lines, its middle after the larger."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    text = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    first, end = ends[:-1], ends[1:]
    last = text == 10
    last[end[end > first] - 1] = True
    lines, letters = Bits(last), Bits((text & 0xC0) != 0x80)
    before = lines.rank(first)
    n = lines.rank(end) - before

    def byte_after(k: np.ndarray) -> np.ndarray:
        at = first.copy()
        at[k > 0] = lines.select((before + k)[k > 0]) + 1
        return at

    a, b = h1 % (n + 1), h2 % (n + 1)
    start, one, two = (letters.rank(x) for x in (first, byte_after(np.minimum(a, b)), byte_after(np.maximum(a, b))))
    return n, one - start, two - one


@F.arrow_udf(T.StructType([T.StructField(x, T.LongType()) for x in ("n", "prefix_chars", "middle_chars")]))
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = cuts(text, h1.to_numpy(), h2.to_numpy()) if len(text) else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["n", "prefix_chars", "middle_chars"])


def transform(docs: DataFrame, *, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars (null if plain) and output.

    Of 100 texts ``rate`` are transformed, ``spm`` of 100 of these with the suffix
    first; a text that is empty or holds a marker stays as it is (plain). A null text
    counts as empty, a null id as an empty one. All draws come from the seed and the
    id, so rows with equal ids have equal draws, and reruns agree. Columns of ``docs``
    with the added names are replaced; an empty table gives no rows.
    """
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(sha, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | text.contains(marker)
    plain = (text == "") | marked | (F.pmod(h[2], F.lit(100)) >= rate)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < spm, "spm").otherwise("psm")
    met = docs.select(F.struct(*others).alias("_doc"), text.alias("_text"), form.alias("form"), _cuts(text, h[0], h[1]).alias("_cut"))
    p, m = F.col("_cut.prefix_chars"), F.col("_cut.middle_chars")
    parts = [F.substring("_text", F.lit(1), p.cast("int")), F.substring("_text", (p + 1).cast("int"), m.cast("int")), F.substring("_text", (p + m + 1).cast("int"), F.char_length("_text"))]
    psm = F.concat(F.lit(PREFIX), parts[0], F.lit(SUFFIX), parts[2], F.lit(MIDDLE), parts[1])
    spm_ = F.concat(F.lit(SUFFIX), parts[2], F.lit(PREFIX), parts[0], F.lit(MIDDLE), parts[1])
    kept = F.col("form") == "plain"
    return met.select(
        "_doc.*",
        F.col("_cut.n").alias("n"),
        "form",
        F.when(~kept, p).alias("prefix_chars"),
        F.when(~kept, m).alias("middle_chars"),
        F.when(kept, F.col("_text")).when(F.col("form") == "spm", spm_).otherwise(psm).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from its output and form alone."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.concat(part[1], part[3], part[2]))


def digest(done: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per row of :func:`transform`: id, n, form, lengths, and digests of the output and of the text restored from it."""
    back = restored(F.col("output"), F.col("form"))
    return done.select(F.col(f"`{id_col}`"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
