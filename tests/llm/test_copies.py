"""Exact and near copies against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from fieldcube.llm import exact_dedup, ngram_join
from tests.llm import brute


def test_marks(spark):
    got = exact_dedup.mark(brute.documents(spark).repartition(3)).collect()
    groups = {}
    for i, t, *_ in brute.ROWS:
        groups.setdefault(brute.digest(t), []).append(i)
    expected = Counter((i, min(g, key=brute.id_order), len(g), brute.digest(t)) for i, t, *_ in brute.ROWS for g in [groups[brute.digest(t)]])
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("slice_rows", [100, 1 << 20])
def test_marks_in_slices(spark, slice_rows):
    rows = [(i, f"text {i % 700}", "en", "a") for i in range(1000)] + [(i, "hot", "en", "a") for i in range(1000, 1500)]
    got = exact_dedup.mark(spark.createDataFrame(rows, brute.SCHEMA), slice_rows=slice_rows).collect()
    assert len(got) == 1500 and sum(r.kept for r in got) == 701
    assert {r.group_size for r in got if r.doc_id >= 1000} == {500} and all(r.keep_id == r.doc_id % 700 for r in got if r.doc_id < 1000)
    kept = exact_dedup.dedup(spark.createDataFrame(rows, brute.SCHEMA), slice_rows=slice_rows).collect()
    assert sorted(r.doc_id for r in kept) == [*range(700), 1000]


def test_filter_has_no_false_negatives(spark):
    """With eight bits a row every repeated hash is found, and few others."""
    rows = spark.range(20_000).selectExpr("cast(id % 15000 as string) AS d")
    placed = exact_dedup.with_place(rows, "d", exact_dedup.filter_blocks(20_000))
    got = exact_dedup.split(placed, exact_dedup.repeated_filter(placed)).groupBy("d").agg({"_maybe": "min", "*": "count"}).collect()
    assert all(r["min(_maybe)"] for r in got if r["count(1)"] > 1) and sum(r["min(_maybe)"] for r in got) < 5_300


def test_dedup_keeps_columns(spark):
    docs = brute.documents(spark)
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    assert Counter(brute.digest(r.text) for r in got.collect()) == Counter({brute.digest(t) for _, t, *_ in brute.ROWS})
    ids = {brute.digest(r.text): r.doc_id for r in got.collect()}
    assert ids[brute.digest(brute.ROWS[0][1])] == 1


def test_empty_tables(spark):
    docs = brute.documents(spark).where("false")
    assert exact_dedup.mark(docs).count() == 0 and exact_dedup.dedup(docs).count() == 0
    assert ngram_join.link(docs).count() == 0 and ngram_join.keep_first(docs).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_links(spark, k, percent):
    got = ngram_join.link(brute.documents(spark).repartition(2), shingle=k, percent=percent).collect()
    comps, sizes = brute.components(brute.ROWS, k, percent)
    expected = Counter((r[0], n, c) for r, n, c in zip(brute.ROWS, sizes, comps, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_near_copies(spark, k, percent):
    """Groups of edited copies of several lengths, with similarities on both sides of the limit."""
    rng = random.Random(k)
    rows = []
    for n in (3, 8, 20, 40, 90, 200, 600):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, n // 25))):
                words[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(words), "en", "a"))
    comps, sizes = brute.components(rows, k, percent)
    got = {r.doc_id: r for r in ngram_join.link(spark.createDataFrame(rows, brute.SCHEMA), shingle=k, percent=percent).collect()}
    assert [got[i].component_id for i, *_ in rows] == comps
    assert [got[i].n_shingles for i, *_ in rows] == sizes
    kept = ngram_join.keep_first(spark.createDataFrame(rows, brute.SCHEMA), shingle=k, percent=percent).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(comps))


def test_one_row_of_each_group_stays(spark):
    """Null and repeated ids: each row is judged for itself."""
    text = lambda k, last="": " ".join(f"w{k}x{i}" for i in range(60)) + last
    rows = [
        (2, text(0), "en", "a"), (None, text(0, " more"), "en", "b"), (None, text(1), "en", "c"), (None, text(2), "en", "d"),
        (5, text(0, " other"), "en", "e"), (5, text(3), "en", "f"), (None, text(4), "en", "g"), (None, text(4, " more"), "en", "h"),
        (6, text(5), "en", "i"), (6, text(5, " more"), "en", "j"), (7, text(6), "en", "k"), (7, text(6), "en", "k"), (None, text(7), "en", "l"), (None, text(7), "en", "l"),
        (1, text(8), "en", "m"), (1, text(9), "en", "n"), (3, text(9, " more"), "en", "o"), (None, None, "en", "p"), (None, "", "en", "q"), (5, " ", "en", "r"),
    ]
    got = ngram_join.keep_first(brute.documents(spark, rows).repartition(3)).collect()
    assert "".join(sorted(r.source for r in got if r.source not in "ghij")) == "acdfklmnpqr"
    assert len([r for r in got if r.source in "gh"]) == 1 and len([r for r in got if r.source in "ij"]) == 1
    assert len(ngram_join.keep_first(brute.documents(spark), shingle=3, percent=90).collect()) == len(set(brute.components(brute.ROWS, 3, 90)[0]))


def test_sketches_are_lower_bounds():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, rng.integers(0, 8), dtype=np.uint64)]))
        far = len(np.setxor1d(a, b))
        for words in (8, 32):
            assert np.bitwise_count(ngram_join.signature(a, words) ^ ngram_join.signature(b, words)).sum() <= far
        assert (ngram_join.folded(ngram_join.signature(a, 32)) == ngram_join.signature(a)).all()
        both = len(np.intersect1d(a, b))
        if len(b) and both * 100 >= 90 * (len(a) + len(b) - both):
            assert np.isin(ngram_join.sketch_keys(a, 90)[0], ngram_join.sketch_keys(b, 90)[0]).any()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (100, 101)], "a long, b long")
    got = {r.node: r.comp for r in ngram_join.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (99, 100, 101)} == {99}


def test_components_of_stars_and_loops(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(500, 500 + i) for i in range(1, 200)] + [(900 - i, 901) for i in range(3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.comp for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_short_sets_have_no_common_empty_key(k, percent):
    """Keys of random short sets: no key is more frequent than chance lets it be, and the number of keys that stay is the difference allowed plus one."""
    rng = np.random.default_rng(2)
    seen = {}
    for size in list(range(1, 60)) * 60:
        s = np.unique(rng.integers(0, 2**64 - 1, size, dtype=np.uint64))
        keys, slack = ngram_join.sketch_keys(s, percent)
        known = ngram_join.bands(percent)
        for t, parts, more in known.groups(known.band(len(s))):
            mine = keys[(keys & np.uint64(1)) == np.uint64(t & 1)]
            assert parts - more <= len(mine) == parts - more + slack[t & 1]
        for key in keys.tolist():
            seen[key] = seen.get(key, 0) + 1
    assert max(seen.values()) <= 2


def test_intermediate_tables_can_be_cleared(spark):
    from fieldcube.llm import scratch

    scratch.clear(spark)
    got = exact_dedup.mark(brute.documents(spark))
    assert got.count() == len(brute.ROWS) and scratch.clear(spark) > 2 and scratch.clear(spark) == 0


def test_keys_shuffle_once(spark):
    """The counts of keys and the rows that meet them read the same exchange, hot keys or not."""
    from pyspark.sql import functions as F

    from fieldcube.llm import scratch

    rows = spark.range(4000).select(F.xxhash64("id").alias("_mark"), F.array(F.col("id") % 700, F.lit(-1).cast("long"), F.col("id") + 10_000).alias("keys"))
    rows = scratch.table(rows, "test-keys")
    keys = rows.select("_mark", F.explode("keys").alias("key"))
    hot = scratch.table(ngram_join.frequent(keys, 12_000 // 4), "test-hot")
    assert -1 in {r.key for r in hot.collect()}
    for some in (hot, hot.where("false")):
        got = ngram_join.shared_keys(rows, some).groupBy("key").agg(F.count("*").alias("n"), F.max("_n").alias("m")).collect()
        assert {r.key: r.n for r in got} == {-1: 4000} | {k: len(range(k, 4000, 700)) for k in range(700)} and all(r.n == r.m for r in got)
