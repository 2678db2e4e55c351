"""Token operators against the tokenizer applied to whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from fieldcube.llm import packing, sstable, token_counts, tokens
from fieldcube.llm.queries import tokenizer_path

TEXTS = [
    None, "", " ", "Hello world, it's a test.\nNew  line\t tab.", "a<|endoftext|>b <|endoftext|> c", "ünï cödé  x 日本語 テスト 🙂🙂", "word " * 3000, "x" * 5000,
    " leading and trailing ", "I'm don't 'S 12 345,678 $$$ ###", "same text", "same text", "\n\n\nlines\n\n", "é e ́", "ΑΣ ΣΑ Σ",
]


def frame(spark, texts=TEXTS):
    rows = [(i if i % 7 else None, t, "en", 1) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, length long")


def whole(name, text):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_round_trip(spark):
    docs = frame(spark).repartition(3)
    got = [tuple(r) for r in sstable.round_trip(docs, tokenizer_path("word_bpe_49k.json")).collect()]
    exp = sorted(((i if i % 7 else None, whole("word_bpe_49k.json", t)) for i, t in enumerate(TEXTS, 1)), key=lambda x: (x[0] is None, x[0] or 0))
    named = [(a, len(b), crc(b)) for a, b in exp if a is not None]
    got.sort(key=lambda r: r[1])
    assert [(a, n, c) for a, _, n, c in got if a is not None] == named
    assert [s for _, s, _, _ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
    assert sorted(c for a, _, _, c in got if a is None) == sorted(crc(b) for a, b in exp if a is None)


def test_shard_lookup(spark, tmp_path):
    docs = spark.createDataFrame([(i * 3 - 50, f"text number {i} " * 40) for i in range(3000)], "doc_id long, text string")
    manifest = sstable.write_shards(docs, tokenizer_path("word_bpe_49k.json"), 2, f"file://{tmp_path}/shards")
    readers = [sstable.ShardReader(r["path"]) for r in manifest.collect()]
    assert sum(r.docs for r in readers) == 3000 and any(len(r.index) > 1 for r in readers)
    for i in (0, 17, 2999):
        found = [x for r in readers if (x := r.get(i * 3 - 50)) is not None]
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [whole("word_bpe_49k.json", f"text number {i} " * 40)]
    assert all(r.get(2) is None and r.get(None) is None for r in readers)


def test_only_the_manifest_counts(spark, tmp_path):
    """What a lost attempt left, whole or in part, is neither read nor kept."""
    folder = f"file://{tmp_path}/shards"
    (tmp_path / "shards").mkdir()
    (tmp_path / "shards" / "shard-000000-99.sst").write_bytes(b"half a sh")
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    manifest = sstable.write_shards(docs, tokenizer_path("word_bpe_49k.json"), 2, folder)
    assert sstable.read_shards(manifest).count() == 50
    assert sorted(p.name for p in (tmp_path / "shards").glob("*.sst")) == sorted(r["path"].rsplit("/", 1)[1] for r in manifest.collect())


def test_empty_tables(spark):
    docs = frame(spark).where("false")
    assert sstable.round_trip(docs, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert packing.pack(docs, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert token_counts.count_sections(docs, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_packing(spark):
    docs = frame(spark, TEXTS + ["short words here"] * 200 + ["word " * 700] * 50)
    rows = packing.pack(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    lengths = {}
    for text in set(TEXTS):
        lengths[text] = whole("byte_bpe_50k.json", text)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_seq) <= 54  # 50 texts of over half a sequence, and the others
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS, 1):
        if i % 7:
            ids, parts = lengths[t], sorted(of[i], key=lambda r: r.piece)
            assert [p.piece for p in parts] == list(range(len(parts)))
            assert [(p.start, p.ids_crc32) for p in parts] == [(p.start, crc(ids[p.start : p.start + p.length])) for p in parts]
            assert sum(p.length for p in parts) == len(ids) and all(p.length == 1024 for p in parts[1:])


def test_plan_holds_each_length():
    rng = np.random.default_rng(1)
    short, few = np.zeros(1025, int), np.zeros(1025, int)
    short[1:180], few[[30, 500, 524, 700, 324]] = rng.integers(0, 60, 179), 1
    for histogram in (rng.integers(0, 60, 1025), np.eye(1, 1025, 700, dtype=int)[0] * 5000, np.zeros(1025, int), short, few):
        histogram[0] = histogram[1024] = 0
        configs = packing.pack_histogram(histogram.copy(), 1024)
        held = np.zeros(1025, int)
        for config, n in configs:
            assert sum(k * m for k, m in config.items()) <= 1024
            for k, m in config.items():
                held[k] += n * m
        assert (held == histogram).all()
        assert sum(n for _, n in configs) <= sum(n for _, n in packing.best_fit(histogram, 1024))
    assert packing.solve(short, 1024) and sum(n for _, n in packing.solve(few, 1024)) == 2  # small and short tables have their program, too
    bound = -(-int(np.arange(1025) @ short) // 1024)
    assert sum(n for _, n in packing.pack_histogram(short, 1024)) == bound


@pytest.mark.parametrize("text", [t or "" for t in TEXTS])
def test_sections(spark, text):
    got = token_counts.count_sections(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json")).orderBy("section").collect()
    spans = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).offsets
    lines = text.split("\n")
    lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    counts, at = [0] * len(lines), np.cumsum([0] + [len(x) for x in lines])
    for a, b in spans:
        overlap = [min(b, at[i + 1]) - max(a, at[i]) for i in range(len(lines))]
        if b > a:
            counts[int(np.argmax(overlap))] += 1
        else:
            counts[max(i for i in range(len(lines)) if at[i] <= a)] += 1
    assert [r.n_tokens for r in got] == counts
    assert [(r.start, r.end) for r in got] == [(at[i], at[i + 1]) for i in range(len(lines))]


ODD = [
    "a <|startoftext|> b", "<|startoftext|>a<|startoftext|> <|endoftext|>b", "<|StartOfText|> a", "x \0abc", "\0 a \0b", "\0", " \0 \0", "plain words", "", None, "a\n<|startoftext|>\n\0 b", "a <|endoftext|> b",
]


@pytest.mark.parametrize("texts", [ODD, ODD[:1], ["\0abc", "\0"]])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_and_nul(name, texts):
    got = tokens.encode_ids(tokenizer_path(name), pa.array(texts, pa.string()), 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [whole(name, t) for t in texts]
    spans = Tokenizer.from_file(tokenizer_path(name))
    for found, size in tokens.cache(tokenizer_path(name), True).encode(pa.array(texts, pa.string())):
        expected = [spans.encode(t or "", add_special_tokens=False).offsets for t in texts]
        assert size.tolist() == [len(x) for x in expected]
        assert found.tolist() == [list(p) for x in expected for p in x]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fuzzed_and_table_texts(name):
    """Runs of odd white space, signs, NUL, added tokens and letters of several scripts, and the texts of a table, against the tokenizer."""
    rng = random.Random(12)
    parts = [" ", "  ", "\0", "\n", "\t", "\x0b", "\u00a0", "\u3000", "a", "word", "Über", "É", "12", "3", "...", "'s", "'", "<|endoftext|>", "<|startoftext|>", "日本", "🙂", "e\u0301", "ß", "_", "-", "Z", "\x1c", "!!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    texts += [t.as_py() for t in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"]]
    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    plain = [tokenizer.encode(t or "", add_special_tokens=False) for t in texts]
    got = tokens.encode_ids(tokenizer_path(name), pa.array(texts, pa.string()), 2)
    wrong = [t for t, p, x in zip(texts, plain, got, strict=True) if np.frombuffer(x, "<u4").tolist() != [*p.ids, 2]]
    assert not wrong, wrong[:5]
    spans = [(found, size) for found, size in tokens.cache(tokenizer_path(name), True).encode(pa.array(texts, pa.string()))]
    found, size = np.concatenate([f for f, _ in spans]), np.concatenate([s for _, s in spans])
    assert size.tolist() == [len(p.offsets) for p in plain] and found.tolist() == [list(o) for p in plain for o in p.offsets]
