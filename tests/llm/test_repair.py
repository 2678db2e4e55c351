"""Conversation repair, fill-in-middle and resharding against plain versions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldcube.llm import fill_middle, resharding, turn_repair
from tests.llm import brute

STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1)
    return out


def shortest(rows, faults):
    """(cost, audit, lines) by a search over (place, state) in order of cost and audit."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, s, lines = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(rows) and s in (0, 3):
            return cost, audit, lines
        for role in ("user", "assistant"):
            if (s, role[0]) in STEPS:
                heapq.heappush(heap, (cost + 3, audit + "I", i, STEPS[s, role[0]], (*lines, role + ":")))
        if i < len(rows):
            role, text = rows[i]
            dear = 3 * (faults[i] == "truncated")
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, lines))
            if faults[i] not in ("blank", "duplicate"):
                if (s, role[:1]) in STEPS:
                    heapq.heappush(heap, (cost + dear, audit + "K", i + 1, STEPS[s, role[:1]], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (s, new[0]) in STEPS:
                        heapq.heappush(heap, (cost + dear + 3, audit + "R", i + 1, STEPS[s, new[0]], (*lines, f"{new}:{text}")))


def plain_repair(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    turns, seen, faults = {r[1] for r in rows} - {None}, set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = shortest([r[2:] for r in rows], faults)
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def check_repair(turns):
    rows, by = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()], defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    got = turn_repair.digest(turn_repair.damage(turns), turns).collect()
    assert {r.conv_id: tuple(r[c] for c in COUNTS) for r in got} == {c: plain_repair(by[c]) if by[c] else NOTHING for c in {r[0] for r in rows}}
    assert len(got) == len({r[0] for r in rows})


def odd_turns(spark, n=300, hot=0.3):
    pick = random.Random(3)
    ids, turns = [None, *range(40)], [None, *range(-3, 30)]
    roles, texts = [None, "", "s", "system", "user", "assistant", "tool", "user", "assistant"], [None, "", "  ", "a.", "b", "c?\n", " d! x", "é." * 3000]
    rows = [(7 if pick.random() < hot else pick.choice(ids), pick.choice(turns), pick.choice(roles), pick.choice(texts)) for _ in range(n)]
    rows += [(99, 0, "user", "same.")] * 9  # repeated rows
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit(c).alias(c) for c in ("pos", "key", "conv", "segment", "letters")])


def test_conversations(spark):
    check_repair(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))


@pytest.mark.parametrize("bits", [16, 2])
def test_odd_turns(spark, monkeypatch, bits):
    """Nulls, ties, repeats, roles that aren't any; with segments of four rows a conversation is chained from many."""
    monkeypatch.setattr(turn_repair, "SEGMENT_BITS", bits)
    check_repair(odd_turns(spark))


def test_no_turns(spark):
    turns = odd_turns(spark).limit(0)
    assert turn_repair.digest(turns, turns).collect() == []
    far = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    (only,) = turn_repair.digest(far).collect()
    assert (only.gaps, only.audit, only.cost) == (None, "KK", 0)


def test_repaired_rows(spark):
    arranged = turn_repair.arrange(turn_repair.damage(odd_turns(spark)))
    _, segments = turn_repair.audits(arranged)
    by, letters = defaultdict(list), defaultdict(list)
    for r in sorted(turn_repair.repaired(arranged, segments).collect(), key=lambda r: (r.pos, r.sub)):
        letters[r.conv].append(r.edit)
        if r.edit != "D":
            by[r.conv].append(f"{r.role}:{r.text}")
    for r in turn_repair.hashed(arranged, segments).collect():
        assert r.audit == "".join(letters[r.conv]) and r.repaired_sha256 == hashlib.sha256("\n".join(by[r.conv]).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in by[r.conv]))


def test_layers_against_search():
    pick = random.Random(1)
    for k in range(4000):
        rows = "".join(pick.choice("abcdefghijkl" if k % 2 else "aadgghj") for _ in range(pick.randint(0, 12)))
        faults = [("", "truncated", "blank")[(ord(r) - 97) % 3] for r in rows]
        expected = shortest([("suax"[(ord(r) - 97) // 3], "") for r in rows], faults)[:2]
        assert turn_repair.solve(rows) == expected
        cut = pick.randint(0, len(rows))
        parts = [p for p in (rows[:cut], rows[cut:]) if p]
        if parts:
            cost, ends = turn_repair.chain([turn_repair.crossing(p) for p in parts])
            state, audit = 0, ""
            for i, (part, end) in enumerate(zip(parts, ends, strict=True)):
                state, found = turn_repair.trace(part, end, i == len(parts) - 1)[state]
                audit += found
            assert (cost, audit) == expected


def plain_middle(doc_id, text, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(found[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h[3] % 100 < 50 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if h[3] % 100 < 50 else "psm", len(prefix), len(middle), out


LINES = [(i, t, "en", "a") for i, t in enumerate(["\n", "\n\n\n", "a\nb", "a\nb\n", "é\n日本\r\n🙂\n" * 700, "<P>", "a<S\n>b<\nP>", "<\n" * 9, "x" * 100_000 + "\n" + "y", "\n" * 5000, "<M> x\ny"])]


def test_fill_middle(spark):
    rows = brute.ROWS + LINES * 3 + [(-(2**63), "a\nb\nc\n", "en", "a"), (None, "one\ntwo\n", None, None)]
    docs = brute.documents(spark, rows, [*brute.CLASHING, "output", "form", "_text", "_cut"])
    done = fill_middle.transform(docs)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done.collect()]
    assert Counter(got) == Counter((i, *plain_middle(i, t)) for i, t, *_ in rows)
    back = done.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t, *_ in rows)
    for r in fill_middle.digest(done).where("doc_id = 4").collect():
        assert hashlib.sha256(plain_middle(4, LINES[4][1])[4].encode()).hexdigest() == r.output_sha256 or r.n != 2100
    assert fill_middle.transform(docs.limit(0)).collect() == []
    assert {r.form for r in fill_middle.transform(docs, rate=0).collect()} == {"plain"}


def test_rank_and_select():
    pick = np.random.default_rng(5)
    for size in (0, 1, 63, 512, 513, 5000):
        for share in (0.0, 0.01, 0.6, 1.0):
            bits = pick.random(size) < share
            made, places = fill_middle.Bits(bits), np.flatnonzero(bits)
            at = np.arange(size + 1)
            assert (made.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()
            if len(places):
                assert (made.select(np.arange(1, len(places) + 1)) == places).all()


def test_sliced_arrays():
    texts = pa.array(["a\n", "", "b\nc", "d\n\n"])[1:]
    n, *_ = fill_middle.cuts(texts, np.zeros(3, np.int64), np.zeros(3, np.int64))
    assert n.tolist() == [0, 2, 2]


def test_flow_costs_least():
    pick = random.Random(2)
    for _ in range(1500):
        m, n = pick.randint(1, 3), pick.randint(1, 3)
        supply, room = [pick.randint(0, 4) for _ in range(m)], [pick.randint(0, 6) for _ in range(n)]
        price = [[pick.randint(0, 5) for _ in range(n)] for _ in range(m)]
        if sum(supply) > sum(room):
            with pytest.raises(ValueError, match="capacities"):
                resharding.min_cost_flow(supply, room, lambda i, j: price[i][j])
            continue
        flow = resharding.min_cost_flow(supply, room, lambda i, j: price[i][j])
        assert [sum(flow.get((i, j), 0) for j in range(n)) for i in range(m)] == supply
        assert all(sum(flow.get((i, j), 0) for i in range(m)) <= room[j] for j in range(n))
        best = {tuple(room): 0}  # unit by unit, over what is left
        for i in (i for i in range(m) for _ in range(supply[i])):
            nexts = {}
            for left, cost in best.items():
                for j in (j for j in range(n) if left[j]):
                    key = (*left[:j], left[j] - 1, *left[j + 1 :])
                    nexts[key] = min(nexts.get(key, 10**9), cost + price[i][j])
            best = nexts
        assert sum(x * price[i][j] for (i, j), x in flow.items()) == min(best.values())


def test_rooms_level():
    pick = random.Random(4)
    for _ in range(2000):
        filled, more = [pick.randint(0, 30) for _ in range(pick.randint(1, 6))], pick.randint(0, 60)
        got = resharding.rooms(filled, more)
        assert sum(got) == more and min(got) >= 0
        ends = [x + y for x, y in zip(filled, got, strict=True)]
        assert all(e - min(ends) <= 1 for e, g in zip(ends, got, strict=True) if g > 0)


def check_shards(docs, near):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    got = resharding.shard_table(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 16, zlib.crc32(t)) for i, t in rows)
    sizes, places, groups, of = defaultdict(int), defaultdict(list), defaultdict(set), Counter()
    for r in got:
        assert (r.law, r.grown_shard) == ("bytes", None) and 0 <= r.shard < 40
        sizes[r.shard] += r.size
        places[r.shard].append(r.slot)
        groups[r.text_crc32, r.size].add(r.shard)
        of[r.text_crc32, r.size] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    total = sum(sizes.values())
    assert all(abs(sizes[j] - total / 40) <= near(total / 40, max(r.size for r in got)) for j in range(40)) if got else True
    assert all(len(g) == 1 for k, g in groups.items() if of[k] * 160 <= total)


def test_shards_of_documents(spark):
    check_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), lambda mean, largest: 0.01 * mean)


def test_shards_of_odd_rows(spark):
    rows = [(None if i % 7 == 0 else i % 900, None if i % 3 == 0 else "é" * (i % 1000) if i % 5 else "same text", "en", "a") for i in range(6000)]
    check_shards(brute.documents(spark, rows, [*brute.CLASHING, "shard", "block", "chunk", "doc"]), lambda mean, largest: 0.02 * mean)
    check_shards(brute.documents(spark), lambda mean, largest: mean + largest)
    check_shards(brute.documents(spark).limit(0), lambda mean, largest: 0)


def test_only_changed_blocks_move(spark):
    """From 6 shards to 8, in both kinds of units: bytes moved are near the flow's, and blocks without a move keep their files."""
    pick = random.Random(6)
    rows = [(i, "".join(pick.choice("abc ") for _ in range(pick.choice((5, 40, 300)))), "en", "a") for i in range(30_000)]
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    folder, bits = resharding.lay_out(docs, 6)
    done = resharding.reshard(docs, folder, bits, 6, 8)
    units = done.units.collect()
    moved, least = sum(u.size for u in units if u.shard != u.new), sum(x for (i, j), x in done.plan.flow.items() if i != j)
    total = sum(u.size for u in units)
    assert not done.plan.large and abs(moved - least) < 0.002 * total
    changed = {(u.shard, u.block) for u in units if u.shard != u.new}
    assert changed == {(r.shard, r.block) for r in done.units.where(done.changed).select("shard", "block").distinct().collect()}
    assert len(changed) < len({(u.shard, u.block) for u in units})
    assert Counter(r[0] for r in done.rows.select("doc.doc_id").collect()) == Counter(i for i, *_ in rows)
    into = done.rows.groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert len(into) == 8 and all(abs(r.s - total / 8) < 0.01 * total / 8 for r in into)
