"""Plain versions of the operators' results, over a few documents."""

import hashlib
import re

ROWS = [
    (1, "The  quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (2, "The quick brown fox\njumps over the lazy dog and runs away", "en", "a"),
    (2, "The quick brown fox\njumps over the lazy dog and runs away", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \t ", "de", "b"),
    (None, "a text without an id, call +1 (743) 555-3824 or mail x.y@mail.example.com", "en", "c"),
    (7, "the QUICK brown fox jumps over the lazy dog and runs far away", "en", "c"),
    (8, "word " * 4000, "en", "d"),
    (9, "x" * 30000, "en", "d"),
    (10, "ünï cödé 日本語 🙂 4111 1111 1111 1111 and 10.0.0.1 or 999.1.1.1 a@b.c_d@e.fg", "fr", "a"),
    (11, "a text without an id, call +1 (743) 555-3824 or mail x.y@mail.example.com", "en", "b"),
    (12, "one", "en", "e"),
    (13, "ONE", "en", "e"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use for themselves.
CLASHING = ["_id", "_row", "_sha", "_doc", "key", "n", "size", "target", "rank", "keep_id", "score", "id", "found", "length"]


def documents(spark, rows=ROWS, extra=CLASHING):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"odd {c}").alias(c) for c in extra])


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def digest(text):
    return hashlib.sha256(normal(text).encode()).hexdigest()


def id_order(i):
    return (i is None, i or 0)


def shingles(text, k):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, percent):
    """Per row the smallest id that links reach (rows by place)."""
    sets, parent = [shingles(t, k) for _, t, *_ in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        c = find(i)
        least[c] = min(least.get(c, r[0]), r[0], key=id_order)
    return [least[find(i)] for i in range(len(rows))], [len(s) for s in sets]
