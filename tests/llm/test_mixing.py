"""Mixing against its targets, and the pipeline stage by stage."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldcube.llm import mixing
from tests.llm import brute


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Water filling, round by round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        rest, w = total - sum(most * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        out = {s: most * sizes[s] if s in full else rest * weight[s] / w for s in order}
        above = {s for s in order if s not in full and out[s] > most * sizes[s]}
        if not above or full | above == set(order):
            return out
        full |= above


def check(rows, got):
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += words(t)
    target = plain_targets(sizes)
    taken = defaultdict(int)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, *_ in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1, s


def test_targets_met(spark):
    check(brute.ROWS, mixing.mix_table(brute.documents(spark)).collect())


def test_many_sources(spark):
    rows = [(i, "word " * (i * 37 % 300), "en", None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    first = mixing.mix_table(docs).collect()
    check(rows, first)
    again = mixing.mix_table(docs.repartition(5)).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 64 or got != list(range(n))


def test_shards_have_their_slots(spark):
    sources = mixing.targets(spark.createDataFrame([("a", 50_000), ("b", 90_000), (None, 10_000)], "source string, source_size long"))
    drawn = mixing.slots(sources, 64, 100)
    per_shard = {r.shard: r.n for r in drawn.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("u")).where("n = u").collect()}
    assert sorted(per_shard) == list(range(len(per_shard))) and all(n == 100 for s, n in per_shard.items() if s < len(per_shard) - 1)
    counts = mixing.shard_counts(drawn).toPandas().pivot(index="shard", columns="rank", values="slots").fillna(0)
    assert counts[0].iloc[:-1].std() > 0


def plain_mix(spark, docs, marked):
    """(words, whole) of the mix from the written slots and the streams, by plain loops."""
    placed, sources = mixing.stream(mixing._rows(docs, "doc_id", "text", "source", *marked), (5, 2, 1), 3)
    placed, drawn = placed.collect(), mixing.slots(sources, 64, 10).collect()
    streams = defaultdict(list)
    for p in placed:
        streams[p.rank] += [(p.first + c * p.size, p.size, p._id, p._mark, c) for c in range(p.copies) if p.size]
    expected, whole = Counter(), Counter()
    for found in streams.values():
        assert [x[0] for x in sorted(found)] == [sum(y[1] for y in sorted(found)[:i]) for i in range(len(found))]
    for s in drawn:
        for at, size, i, mark, c in streams[s.rank]:
            lo, hi = max(at, s.block * 64), min(at + size, s.block * 64 + s.words)
            if lo < hi:
                expected[(i, mark, c, s.shard, s.slot, lo - at, hi - lo)] += 1
                whole[(i, size)] += lo == at
    taken = mixing.taken_words(spark.createDataFrame(placed), spark.createDataFrame(drawn), 64).where("words > 0")
    assert Counter((r._id, r._mark, r.copy, r.shard, r.slot, r.begin, r.words) for r in taken.collect()) == expected
    return expected, +whole


def test_words_are_those_of_the_slots(spark):
    rows = [(i if i % 9 else None, f"w{i} " * (i * 53 % 230), "en", f"s{i % 4}" if i % 3 else "hot") for i in range(300)] + [(7, "twice " * 90, "en", "hot")] * 5
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    expected, _ = plain_mix(spark, docs, ["text"])
    sums = Counter()
    for (i, _, _, _, _, _, n), k in expected.items():
        sums[i] += n * k
    assert sums == +sum((Counter({r.doc_id: r.taken}) for r in mixing.mix_table(docs, shard_slots=10).collect()), Counter())
    blocks = mixing.mixed_blocks(docs, shard_slots=10).collect()
    assert Counter((r.doc_id, r.copy, r.shard, r.slot, r.begin, r.words) for r in blocks) == Counter((i, c, h, t, b, n) for i, _, c, h, t, b, n in expected.elements())
    assert len({r.shard for r in blocks}) > 5
    _, whole = plain_mix(spark, docs, docs.columns)
    assert Counter((r.doc_id, words(r.text)) for r in mixing.mix(docs, shard_slots=10).collect() if words(r.text)) == whole


def test_mix_repeats_rows(spark):
    rows = [(i, "word " * 50, "en", "big" if i < 900 else "small") for i in range(1000)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    counts = Counter(r.source for r in got.collect())
    assert counts["small"] == pytest.approx(1000 * 2 / 7, rel=0.15) and counts["big"] == pytest.approx(1000 * 5 / 7, rel=0.05)
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mix_table(docs.where("false")).count() == 0


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, seen = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        seen.append(docs.count())
        if name == "exact_dedup":
            rows = docs.collect()
            assert len({brute.digest(r.text) for r in rows}) == len(rows)
        if name == "ngram_jaccard":
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            comps, _ = brute.components(kept, 5, 80)
            assert comps == [i for i, _ in kept]
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] < seen[2]
    name, stage = pipeline.STAGES[-1]
    packed = stage(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    by = defaultdict(int)
    for r in packed:
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 1024


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeated rows, long texts and clashing columns through all stages, and an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    odd = brute.documents(spark)
    docs = odd.cache()
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == odd.columns, name
        texts = [brute.digest(r.text) for r in docs.collect()]
        if name == "exact_dedup":
            assert sorted(texts) == sorted({brute.digest(t) for _, t, *_ in brute.ROWS})
        if name == "ngram_jaccard":
            assert len(texts) == len(set(texts)) and brute.digest("") in texts and brute.digest(brute.ROWS[9][1]) in texts
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len({(r.doc_id, r.piece) for r in packed}) > 3 and all(0 < r.length <= 1024 for r in packed)
    for name, stage in pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf).count() == 0, name
