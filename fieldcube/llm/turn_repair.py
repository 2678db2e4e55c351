"""Conversation structure repair by cost layers of grammar states.

The role initials of a repaired conversation match ``(s?(ua)+)?``: four states of a
grammar. For every turn, layer k is the set of states, as bits, from which the rest
of the conversation can be repaired at a cost of at most k; layers before a turn come
from those after it by shifts of whole sets, one for each edit. The first layer that
holds the start state gives the cost, and following the bits forward, the least
letter first, gives the least of the cheapest audits. States at one place never
differ by more than 7 (insertions and one deletion turn any into any other that can
still be reached), so eight layers above the lowest are all there are, 32 bits; the
steps between such words repeat and are kept in a table.

Scale: rows are ordered by one range shuffle, so that a conversation of any size is
cut into segments of at most ``SEGMENT`` rows. A segment is solved by itself for
each state at its end; the segments of a conversation are then chained from
the last to the first (costs) and back (the state at which each begins). Only numbers
and one letter a row cross these shuffles. Repeats are found by (conversation, digest) with
partial aggregation. The digest of a whole repaired conversation is sequential by
definition: its rows stream through one task in order, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcube.llm import scratch

SEGMENT_BITS = 16
LAYERS = 8
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. NEXT[state] is the only letter that an insertion or another role can add there, and the state after it.
NEXT = ((1, 2), (1, 2), (2, 3), (1, 2))
ROLES = ("system", "user", "assistant")
#: Cost of ending in each state.
END = (0, 2 * INSERT, INSERT, 0)
#: Row classes: letters from "a", three for each initial (s, u, a, other): sound, truncated, must go.
SOUND, TRUNCATED, GONE = range(3)


def turned(state: int, letter: int) -> int | None:
    """The state after a letter (0 s, 1 u, 2 a, 3 other), or None."""
    if letter == 0:
        return 1 if state == 0 else None
    return NEXT[state][1] if NEXT[state][0] == letter else None


#: SOURCES[letter][set]: the states from which the letter leads into the set.
SOURCES = [[sum(1 << x for x in range(4) if turned(x, letter) is not None and bits >> turned(x, letter) & 1) for bits in range(16)] for letter in range(4)]


def layers_of(costs: Sequence[int | None]) -> tuple[int, int]:
    """(word, base): layer k of the word holds the states with a cost of at most base + k; None costs too much."""
    base = min(c for c in costs if c is not None)
    return sum(1 << (4 * k + x) for k in range(LAYERS) for x, c in enumerate(costs) if c is not None and c <= base + k), base


@lru_cache(1 << 16)
def costs_of(word: int) -> tuple[int | None, ...]:
    """Cost of each state above the base."""
    return tuple(next((k for k in range(LAYERS) if word >> (4 * k + x) & 1), None) for x in range(4))


@lru_cache(1 << 16)
def before(word: int, row: int) -> tuple[int, int]:
    """(word before a row of this class, what its base is above that of the word after it)."""
    letter, fault = divmod(row, 3)
    dear = CUT if fault == TRUNCATED else 0

    def after(k: int) -> int:
        return word >> (4 * min(k, LAYERS - 1)) & 15 if k >= 0 else 0

    sets: list[int] = []
    for k in range(2 * LAYERS + DELETE + CUT):
        got = after(k - DELETE)
        if fault != GONE:
            got |= SOURCES[letter][after(k - KEEP - dear)]
            got |= SOURCES[1][after(k - REROLE - dear)] | SOURCES[2][after(k - REROLE - dear)]
        if k >= INSERT:
            got |= SOURCES[1][sets[k - INSERT]] | SOURCES[2][sets[k - INSERT]]
        sets.append(got)
    first = next(k for k, found in enumerate(sets) if found)
    return sum(found << 4 * k for k, found in enumerate(sets[first : first + LAYERS])), first


@lru_cache(1 << 16)
def moves(word: int, row: int) -> tuple[tuple[str, int] | None, ...]:
    """For each state before a row: the least letters of the cheapest edits up to the row's own, and the state after them."""
    letter, fault = divmod(row, 3)
    dear = CUT if fault == TRUNCATED else 0
    start, rise = before(word, row)
    here, later = costs_of(start), costs_of(word)

    def go(x: int) -> tuple[str, int] | None:
        if here[x] is None:
            return None
        goal = here[x] + rise

        def fits(cost: int, y: int | None) -> bool:
            return y is not None and later[y] is not None and cost + later[y] == goal

        y, kept = NEXT[x][1], turned(x, letter)
        if fits(DELETE, x):
            return "D", x
        if here[y] is not None and INSERT + here[y] == here[x]:
            letters, end = go(y)
            return "I" + letters, end
        if fault != GONE and fits(KEEP + dear, kept):
            return "K", kept
        return "R", y

    return tuple(go(x) for x in range(4))


def walk(rows: str, end: Sequence[int | None]) -> tuple[list[int], list[int | None]]:
    """(the word after each row, the cost of each state before the first), for the costs of each state at the end."""
    word, base = layers_of(end)
    words = []
    for row in reversed(rows):
        words.append(word)
        word, rise = before(word, ord(row) - 97)
        base += rise
    return words[::-1], [None if c is None else c + base for c in costs_of(word)]


def crossing(rows: str) -> list[int | None]:
    """The cost of getting over the rows from state x to state y, at 4 * x + y; None if it can't be."""
    by_end = [walk(rows, [0 if x == y else None for x in range(4)])[1] for y in range(4)]
    return [by_end[y][x] for x in range(4) for y in range(4)]


def trace(rows: str, end: Sequence[int], last: bool) -> list[tuple[int, str]]:
    """(state at the end, letters) for each state before the rows; the last rows of a conversation are followed by what it lacks."""
    words, out = walk(rows, end)[0], []
    steps = [moves(w, ord(row) - 97) for w, row in zip(words, rows, strict=True)]
    for x in range(4):
        letters = []
        for step in steps:
            if step[x] is None:
                break
            found, x = step[x]
            letters.append(found)
        else:
            out.append((x, "".join(letters) + "I" * (END[x] // INSERT if last else 0)))
            continue
        out.append((x, ""))
    return out


def chain(crossings: Sequence[Sequence[int | None]]) -> tuple[int, list[list[int]]]:
    """(cost of the whole conversation, the costs of each state at the end of each segment)."""
    end, ends = list(END), []
    for cross in reversed(crossings):
        ends.append(end)
        end = [min(cross[4 * x + y] + end[y] for y in range(4) if cross[4 * x + y] is not None) for x in range(4)]
    return end[0], ends[::-1]


def solve(rows: str) -> tuple[int, str]:
    """(cost, audit) of a conversation of row classes in one segment."""
    cost, (end,) = chain([crossing(rows)])
    return cost, trace(rows, end, True)[0][1]


def illegal(rows: str) -> int:
    """Neighbours whose initials aren't su, ua or au."""
    letters = ["suax"[(ord(r) - 97) // 3] for r in rows]
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(letters, letters[1:]))


LONGS = T.ArrayType(T.LongType())


@F.arrow_udf(T.StructType([T.StructField("cross", LONGS), T.StructField("illegal", T.LongType())]))
def _crossing(rows: pa.Array) -> pa.Array:
    found = rows.to_pylist()
    return pa.StructArray.from_arrays([pa.array([crossing(x) for x in found], pa.list_(pa.int64())), pa.array([illegal(x) for x in found], pa.int64())], ["cross", "illegal"])


@F.arrow_udf(T.StructType([T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("ends", T.ArrayType(LONGS))]))
def _chain(parts: pa.Array) -> pa.Array:
    found = parts.to_pylist()
    done = [chain([p["cross"] for p in x]) for x in found]
    between = [sum(illegal(a["tail"] + b["head"]) for a, b in zip(x, x[1:])) for x in found]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())))
    return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(([c for c, _ in done], between, [e for _, e in done]), kinds, strict=True)], ["cost", "illegal", "ends"])


@F.arrow_udf(T.StructType([T.StructField("states", LONGS), T.StructField("letters", T.ArrayType(T.StringType()))]))
def _trace(rows: pa.Array, end: pa.Array, last: pa.Array) -> pa.Array:
    done = [trace(*x) for x in zip(rows.to_pylist(), end.to_pylist(), last.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array([[x for x, _ in d] for d in done], pa.list_(pa.int64())), pa.array([[s for _, s in d] for d in done], pa.list_(pa.string()))], ["states", "letters"])


@F.arrow_udf(LONGS)
def _entries(states: pa.Array) -> pa.Array:
    out = []
    for parts in states.to_pylist():
        x, entered = 0, []
        for part in parts:
            entered.append(x)
            x = part[x]
        out.append(entered)
    return pa.array(out, pa.list_(pa.int64()))


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(" "))


def damage(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults for tests and the query, by crc32 of ``conv:turn`` modulo 20: 0 is dropped, 1 loses its text, 2 its marks ``.!?``, 3 stands twice, 4 is the user's. Nulls count as one space there, in roles and in texts."""
    k = F.pmod(F.crc32(F.concat(F.coalesce(F.col(f"`{conv_col}`").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(f"`{turn_col}`").cast("string"), F.lit(" "))).cast("binary")), F.lit(20))
    text = F.when(k == 1, "").when(k == 2, F.translate(_text(text_col), ".!?", "")).otherwise(_text(text_col))
    rows = turns.select(F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col), F.when(k == 4, "user").otherwise(_text(role_col)).alias(role_col), text.alias(text_col), F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("_copy"), k.alias("_k"))
    return rows.where("_k <> 0").drop("_copy", "_k")


def arrange(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows, written in order with their place pos: by conversation, turn (nulls first), role, and a digest of role and text, which settles the order of what is left; equal rows can stand in any."""
    role, text = _text(role_col), _text(text_col)
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"), F.monotonically_increasing_id().alias("salt"))
    placed = rows.repartitionByRange(*order, "salt").sortWithinPartitions(*order)  # the salt cuts any number of equal rows
    return scratch.table(placed.drop("salt").withColumn("pos", F.monotonically_increasing_id()), "turns")


def _segment() -> Column:
    return F.shiftright("pos", SEGMENT_BITS).alias("segment")


def classify(arranged: DataFrame) -> DataFrame:
    """conv, pos, row (its class), and whether it is blank, a duplicate or truncated: the first of these that holds."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    letter = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)), F.when(F.col("role") == "", 1).otherwise(0)), F.lit(4)) - 1
    narrow = arranged.select("conv", "pos", "key", letter.alias("letter"), blank.alias("blank"), cut.alias("cut"))
    repeated = narrow.groupBy("conv", "key").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = narrow.alias("a").join(repeated.alias("b"), F.col("a.conv").eqNullSafe(F.col("b.conv")) & (F.col("a.key") == F.col("b.key")), "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    truncated = ~F.col("blank") & ~duplicate & F.col("cut")
    fault = F.when(F.col("blank") | duplicate, GONE).when(truncated, TRUNCATED).otherwise(SOUND)
    row = F.substring(F.lit("abcdefghijkl"), (3 * F.col("letter") + fault + 1).cast("int"), F.lit(1))
    return met.select("a.conv", "pos", row.alias("row"), "blank", duplicate.alias("duplicate"), truncated.alias("truncated"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))


def _sorted(*columns: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*columns)))


def audits(arranged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, segments): conv, blank, duplicate, truncated, illegal, cost; and conv, segment, pos of its first row, state before it, letters of its edits."""
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    rows = F.array_join(F.transform(_sorted("pos", "row"), lambda x: x["row"]), "")
    segments = classify(arranged).groupBy("conv", _segment()).agg(rows.alias("rows"), F.min("pos").alias("pos"), *counts)
    segments = scratch.table(segments.withColumn("found", _crossing("rows")), "turn-segments")
    ends = segments.select("*", F.substring("rows", 1, 1).alias("head"), F.substring("rows", -1, 1).alias("tail"), "found.*")
    parts = ends.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum("illegal").alias("inside"), _sorted("segment", "cross", "head", "tail").alias("parts"))
    chained = scratch.table(parts.withColumn("chain", _chain("parts")).withColumn("parts", F.col("parts.segment")), "turn-chains")
    conversations = chained.select("conv", "blank", "duplicate", "truncated", (F.col("inside") + F.col("chain.illegal")).alias("illegal"), F.col("chain.cost").alias("cost"))
    each = chained.select("conv", F.element_at("parts", -1).alias("last"), F.explode(F.arrays_zip(F.col("parts").alias("segment"), F.col("chain.ends").alias("end"))).alias("one")).select("conv", "last", "one.*")
    met = segments.alias("a").join(each.alias("b"), _same("a", "b") & (F.col("a.segment") == F.col("b.segment")))
    traced = scratch.table(met.select("a.conv", "a.segment", "a.pos", _trace("a.rows", "b.end", F.col("a.segment") == F.col("b.last")).alias("trace")), "turn-traces")
    entered = traced.groupBy("conv").agg(_sorted("segment", "trace.states").alias("parts"))
    entered = entered.select("conv", F.explode(F.arrays_zip(F.col("parts.segment").alias("segment"), _entries("parts.states").alias("state"))).alias("one")).select("conv", "one.*")
    met = traced.alias("a").join(entered.alias("b"), _same("a", "b") & (F.col("a.segment") == F.col("b.segment")))
    letters = F.element_at("a.trace.letters", (F.col("b.state") + 1).cast("int"))
    return conversations, met.select("a.conv", "a.segment", "a.pos", "b.state", letters.alias("letters"))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, pos, sub, letter, role, text) of sorted rows, each segment's letters before its rows."""
    conv, letters, at, state, pos, sub = None, "", 0, 0, 0, 0

    def one(role: str, text: str) -> tuple:
        nonlocal state, at, sub
        letter = letters[at]
        if letter in "IR":
            role, state = ROLES[NEXT[state][0]], NEXT[state][1]
        elif letter == "K":
            state = turned(state, "sua".index(role[0]))
        at, sub = at + 1, sub + 1
        return conv, pos, sub - 1, letter, role, text

    for batch in batches:
        for c, p, first, found, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if found is not None:
                while at < len(letters):
                    yield one("", "")
                conv, letters, at, state = c, found, 0, first
            else:
                pos, sub = p, 0
                while letters[at] == "I":
                    yield one("", "")
                yield one(role, text)
    while at < len(letters):
        yield one("", "")


def _met(arranged: DataFrame, segments: DataFrame, *by: str | Column) -> DataFrame:
    """Rows and their segments' letters, dealt and sorted for :func:`_edits`."""
    none, state = F.lit(None).cast("string"), F.lit(None).cast("long")
    rows = arranged.select("conv", "pos", state.alias("state"), none.alias("letters"), "role", "text")
    both = rows.unionByName(segments.select("conv", "pos", "state", "letters", none.alias("role"), none.alias("text")))
    return both.repartition(*by).sortWithinPartitions(F.col("conv").asc_nulls_first(), "pos", F.col("letters").isNull())


def repaired(arranged: DataFrame, segments: DataFrame) -> DataFrame:
    """Every edit in order of (conv, pos, sub): edit (K, R, D or I), role and text; rows without the deleted ones are the repaired conversations."""
    kind = arranged.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_edits(batches), schema)

    schema = T.StructType([T.StructField("conv", kind), T.StructField("pos", T.LongType()), T.StructField("sub", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])
    return _met(arranged, segments, "conv", _segment()).mapInArrow(run, schema)


def hashed(arranged: DataFrame, segments: DataFrame) -> DataFrame:
    """conv, audit, repaired_sha256 of each conversation."""
    schema = T.StructType([arranged.schema["conv"], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, audit, sha, lines = None, [], None, 0
        for conv, _, _, letter, role, text in _edits(batches):
            if sha is None or conv != now:
                if sha is not None:
                    yield now, "".join(audit), sha.hexdigest()
                now, audit, sha, lines = conv, [], hashlib.sha256(), 0
            audit.append(letter)
            if letter != "D":
                sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        if sha is not None:
            yield now, "".join(audit), sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(each(batches), schema)

    return _met(arranged, segments, "conv").mapInArrow(run, schema)


def _batches(rows: Iterator[tuple], schema: T.StructType, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of some megabytes of text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, found, size = to_arrow_schema(schema), [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), kinds, strict=True)], names=kinds.names)

    for row in rows:
        found.append(row)
        size += 64 + len(row[-1])
        if size > most:
            yield made()
            found, size = [], 0
    if found:
        yield made()


def digest(
    turns: DataFrame, conversations: DataFrame | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, nulls first; see :func:`arrange` for rows of one turn. Null roles
    and texts count as one space, rows without a conversation are one of their own. A
    role counts by its first letter; an empty one is never legal. Repeated rows are duplicates. gaps:
    missing numbers between the least and the greatest turn (null beyond 64 bits).
    ``conversations``: a table whose ids all get a row, zeros and the digest of nothing if they have no
    rows here; else the ids of ``turns``. An empty table gives no rows. Other columns don't matter.
    """
    arranged = arrange(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    counts, segments = audits(arranged)
    segments = scratch.table(segments, "turn-letters")
    wide = F.col("most").cast("decimal(38,0)") - F.col("least").cast("decimal(38,0)") + 1 - F.col("turns").cast("decimal(38,0)")
    gaps = arranged.groupBy("conv").agg(F.min("turn").alias("least"), F.max("turn").alias("most"), F.count_distinct("turn").alias("turns"))
    gaps = gaps.select("conv", F.when(F.col("turns") == 0, F.lit(0).cast("long")).otherwise(wide.try_cast("long")).alias("gaps"))
    found = gaps.alias("a").join(counts.alias("b"), _same("a", "b")).join(hashed(arranged, segments).alias("c"), _same("a", "c"))
    numbers = ("blank", "duplicate", "truncated", "illegal", "cost")
    found = found.select("a.conv", "a.gaps", *[f"b.{c}" for c in numbers], "c.audit", "c.repaired_sha256")
    if conversations is None:
        return found.withColumnRenamed("conv", conv_col)
    ids = conversations.select(F.col(f"`{conv_col}`").alias("conv")).distinct()
    met = ids.alias("a").join(found.alias("b"), _same("a", "b"), "left")
    none = F.col("b.audit").isNull()
    zeros = [F.when(none, F.lit(0).cast("long")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("gaps", *numbers)]
    return met.select(F.col("a.conv").alias(conv_col), *zeros, F.coalesce("b.audit", F.lit("")).alias("audit"), F.coalesce("b.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
