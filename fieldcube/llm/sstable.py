"""Token ids in sorted-string-table shards.

A shard holds documents in key order: data blocks of about ``BLOCK_BYTES`` whose
keys are prefix-compressed against the key before, an index with the last key of
each block, a Bloom filter over the keys, and a footer with the places and counts
of these. A lookup asks the filter, binary-searches the index and reads one block.

Scale: one range shuffle of the texts by identifier; each task then encodes,
and streams its shard to storage that all executors share, holding one block, the
index and the keys (nine bytes a document). A shard's name has its attempt's number and
the manifest names the shards that count, so a lost executor's task can run again;
files of other attempts go when the manifest is written. A document's start is its
place in its shard plus the ids of the shards before, from the manifest (one row
a shard).
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldcube.llm import scratch, tokens

MAGIC = b"FCSST001"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES = 64 << 10
BITS_PER_KEY, PROBES = 10, 7
MANIFEST = "path string, first_key binary, docs long, ids long"


def key_of(doc_id: int | None) -> bytes:
    """A key whose byte order is the order of identifiers, null last."""
    return b"\x02" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x02" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = data[at]
        n |= (x & 127) << shift
        at, shift = at + 1, shift + 7
        if x < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Appends (key, ids) in key order to an output stream."""

    def __init__(self, out):
        self.out, self.at, self.block, self.last, self.index, self.keys, self.ids, self.first = out, 0, bytearray(), b"", [], [], 0, None
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, ids: bytes) -> None:
        same = 0
        while same < min(len(key), len(self.last)) and key[same] == self.last[same]:
            same += 1
        value = self.pack(ids)
        self.block += _varint(same) + _varint(len(key) - same) + _varint(len(ids) // 4) + _varint(len(value)) + key[same:] + value
        self.first = key if self.first is None else self.first
        self.last, self.ids = key, self.ids + len(ids) // 4
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.last, self.at, len(self.block)))
            self.out.write(bytes(self.block))
            self.at += len(self.block)
            self.block, self.last = bytearray(), b""

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index)
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bytes(bloom) + FOOTER.pack(self.at, len(index), len(bloom), bits, len(self.keys), self.ids, MAGIC))


def _entries(block: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    at, key = 0, b""
    while at < len(block):
        same, at = _read_varint(block, at)
        more, at = _read_varint(block, at)
        n, at = _read_varint(block, at)
        size, at = _read_varint(block, at)
        key = key[:same] + block[at : at + more]
        yield key, n, block[at + more : at + more + size]
        at += more + size


class ShardReader:
    """Reads a shard by its footer, index and filter."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        at, index, bloom, self.bits, self.docs, self.ids, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        raw = self.file.read_at(index, at)
        self.bloom = self.file.read_at(bloom, at + index)
        self.index, p = [], 0
        while p < len(raw):
            n, p = _read_varint(raw, p)
            key, p = raw[p : p + n], p + n
            begin, p = _read_varint(raw, p)
            length, p = _read_varint(raw, p)
            self.index.append((key, begin, length))
        self.unpack = zstandard.ZstdDecompressor()

    def _ids(self, n: int, value: bytes) -> bytes:
        return self.unpack.decompress(value, max_output_size=4 * n) if n else b""

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        """All (key, ids) in order, a block at a time."""
        for _, at, n in self.index:
            for key, count, value in _entries(self.file.read_at(n, at)):
                yield key, self._ids(count, value)

    def get(self, doc_id: int | None) -> bytes | None:
        """The ids of a document (of the first, where several share the identifier), or None."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return None
        k = bisect_left(self.index, key, key=lambda x: x[0])
        if k == len(self.index):
            return None
        return next((self._ids(n, v) for x, n, v in _entries(self.file.read_at(self.index[k][2], self.index[k][1])) if x == key), None)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token ids of all texts to shards in ``folder``; the manifest, one row a shard.

    Null and empty texts have the end id alone. Rows with equal identifiers follow
    each other; null identifiers come last. Identifiers are whole numbers or null; other
    columns of ``docs`` don't matter. An empty table gives no shard.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = out = None
        context = TaskContext.get()
        where, base = fs.FileSystem.from_uri(folder)
        name = f"shard-{context.partitionId():06d}-{context.taskAttemptId()}.sst"
        for batch in batches:
            if batch.num_rows and writer is None:
                where.create_dir(base)
                out = where.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(out)
            ids = tokens.encode_ids(tokenizer, batch.column(1), end_id)
            for doc_id, found in zip(batch.column(0).to_pylist(), ids, strict=True):
                writer.add(key_of(doc_id), found)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "first_key": writer.first, "docs": len(writer.keys), "ids": writer.ids}])

    order = F.col("_id").asc_nulls_last()
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    manifest = scratch.table(rows.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(write, MANIFEST), "sst-manifest")
    remove_others(folder, {r["path"] for r in manifest.select("path").toLocalIterator()})
    return manifest


def remove_others(folder: str, paths: set[str]) -> int:
    """Delete the files of attempts that failed or came second; how many."""
    where, base = fs.FileSystem.from_uri(folder)
    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    gone = [f.path for f in found if f.base_name.endswith(".sst") and f"{folder}/{f.base_name}" not in paths]
    for path in gone:
        where.delete_file(path)
    return len(gone)


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shards."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start, found = row["start"], []
                for key, ids in ShardReader(row["path"]).scan():
                    found.append((id_of(key), start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(found) == 5000:
                        yield _batch(found)
                        found = []
                yield _batch(found)

    before = F.coalesce(F.sum("ids").over(W.orderBy("first_key", "path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    shards = manifest.select("path", before.alias("start")).repartition(max(1, manifest.count()))  # a task a shard: few rows, but large ones
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, **columns) -> DataFrame:
    """Write all documents to shards in the shared folder and read them back."""
    folder = scratch.folder(docs.sparkSession, "sst")
    return read_shards(write_shards(docs, tokenizer, end_id, folder, **columns))
