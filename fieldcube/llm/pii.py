"""Personal data by weak supervision, DataFrame functions only.

Patterns propose spans, wide ones: many are no personal data. Labelers vote on each:
the form's check (checksums, ranges, character classes), gazetteers (domains, number
plans, country codes), cue words before and after in four languages, the characters
around it, the variety of its characters, and a list of placeholders.
Expectation-maximisation over the counts of vote patterns estimates each labeler's
reliability without labels, and its posteriors
train a logistic regression over the votes and the span's kind and length. Spans
of the base forms stay whatever the classifier says; of the others it adds those
that it holds for personal data.

Scale: one scan of the texts, nothing of which shuffles; what goes to the driver
is the table of counts by kind, vote pattern and length class, whose size the
labelers bound (10 kinds, 3 votes of 7 labelers, 4 lengths).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcube.llm import scratch
from fieldcube.llm.syncmers import let

# The base forms. A match starts where a run of its characters starts or the match before ended, which
# finds the same matches as a search from every character, in one pass; possessive repeats need no backtracking.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Forms beyond the base ones.
MORE = {
    "secret": r"(?i)(?<![a-z0-9_-])(?=[a-z0-9_-]++[\x22']?[\x20\t]*+[=:])[a-z0-9_-]*?(?:api[_-]?key|token|secret|passw(?:or)?d|passwort|access[_-]?key|private[_-]?key|auth[_-]?key)[a-z0-9_-]*+[\x22']?[\x20\t]*+[=:][\x20\t]*+[\x22']?[A-Za-z0-9/+_.~=-]{8,}+[\x22']?",
    "key": r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])",
    "spelled_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:\x20*+[\[({]\x20*+at\x20*+[\])}]\x20*+|\x20++at\x20++)[a-z0-9-]++(?:(?:\.|\x20*+[\[({]\x20*+dot\x20*+[\])}]\x20*+|\x20++dot\x20++)[a-z0-9-]++)++",
}
KINDS = [*BASE, *MORE]
# Gazetteers and cue words by kind.
_DOMAIN_END = r"(?:com|org|net|edu|gov|io|co|info|de|fr|es|it|uk|eu|us|ca|ch|at|nl|me|dev|biz)$"
GAZETTEER = {
    "email": rf"(?i)\.{_DOMAIN_END}",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-4])\.",
    "card": r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"(?i)^(?:\w*(?:aws|github|gitlab|slack|stripe|google|azure|db|client|secret|access|api|auth)\w*|token|passw\w*)[\x22']?\s*[=:]",
    "key": r"^(?:AKIA|gh[pousr]_|sk-|xox|eyJhbGci|eyJ0eXAi)",
    "iban": r"^(?:AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|SM|TR)",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)",
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-]?[2-9]",
    "spelled_email": rf"(?i){_DOMAIN_END}",
}
_PHONE_CUES = r"(?i)\b(?:phone|tel|telefon|téléphone|teléfono|call|mobile|handy|fax|reach|ring|appelez|llame|anruf\w*)\b"
_MAIL_CUES = r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|schreib\w*|correo|courriel|reach|send|address)\b"
CUES = {
    "email": _MAIL_CUES, "ip": r"(?i)\b(?:ip|host|server|address|from|addr|client|login)\b", "card": r"(?i)\b(?:card|visa|credit|payment|account|karte|carte|tarjeta|amex|mastercard)\b", "phone": _PHONE_CUES,
    "secret": r"(?i)\b(?:set|export|private|config|env|auth|credentials?|login|with|use|let|const|var)\b", "key": r"(?i)\b(?:key|token|secret|auth\w*|bearer|credentials?|export|login)\b",
    "iban": r"(?i)\b(?:iban|konto|bank|account|compte|cuenta|transfer|pay)\b", "national_id": r"(?i)\b(?:ssn|social|security|id|number|tax|insurance)\b", "local_phone": _PHONE_CUES, "spelled_email": _MAIL_CUES,
}
PLACEHOLDER = r"(?i)(.)\1{5}|x{4}|example\.(?:org|invalid)|placeholder|changeme|your[_-]|dummy|sample|12345678|00000|<|\*{3}"
VOTES = ["form", "gazetteer", "cue", "after", "edge", "variety", "placeholder"]
CONTEXT = 32


def prefix_sums(a: Column) -> Column:
    """Sums of the elements before each one, in chunks of about the root of the length, so that arrays grow in short steps."""
    zero = F.array(F.lit(0).cast("long"))
    step = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def chunked(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v).cast("double"))), F.lit(1)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int")), lambda j: F.slice(v, j * width + 1, width))
        sums = F.transform(F.filter(chunks, lambda c: F.size(c) > 0), lambda c: F.aggregate(c, zero, step))
        return let(sums, lambda t: let(F.aggregate(t, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(x, -1)))), lambda o: F.flatten(F.transform(t, lambda x, j: F.transform(F.slice(x, 1, F.size(x) - 1), lambda y: y + F.get(o, j))))))

    return let(a, chunked)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = lambda x: F.when(x > 4, x * 2 - 9).otherwise(x * 2)
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    """A base form's check of a match, or a stricter form of the others."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")).cast("int")).otherwise(256)
        return F.forall(F.split(match, r"\."), lambda p: part(p) <= 255)
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "secret":
        return match.rlike(r"[=:][\x20\t]*[\x22']?(?=[^\x22']*[0-9])(?=[^\x22']*[A-Za-z])[^\x22']{16,}")
    if kind == "iban":
        letters = F.translate(match, " ", "")
        return F.char_length(letters).between(15, 34) & (remainder_97(F.concat(F.substring(letters, 5, 40), F.substring(letters, 1, 4))) == 1)
    if kind == "national_id":
        return match.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)")
    if kind == "spelled_email":
        return match.rlike(r"(?i)[\[({]\s*at\s*[\])}]") | match.rlike(r"(?i)\bat\b.*\bdot\b")
    if kind == "local_phone":
        return match.rlike(r"^\([0-9]{3}\)\x20?[0-9]{3}-|^[0-9]{3}([.-])[0-9]{3}\1|^[0-9]{3} [0-9]{3} ")
    return F.lit(True)


def remainder_97(text: Column) -> Column:
    """The remainder by 97 of digits and letters, A being 10."""
    step = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def candidates(text: Column, kind: str) -> Column:
    """All matches of a kind as structs: kind, start, end (code points), base, the votes (-1, 0, 1), size class."""
    pattern = (BASE | MORE)[kind]

    def of(gaps: Column, found: Column) -> Column:
        lengths = F.transform(found, lambda m, i: (F.char_length(m) + F.char_length(F.get(gaps, i))).cast("long"))

        def span(m: Column, i: Column, before: Column) -> Column:
            left, right = F.get(gaps, i), F.substring(F.get(gaps, i + 1), 1, 1)
            near = F.when(F.char_length(left) > CONTEXT, F.substring(left, -CONTEXT, CONTEXT)).otherwise(left)
            following = F.substring(F.get(gaps, i + 1), 1, CONTEXT)
            start = F.get(before, i) + F.char_length(left)
            ok = passes(kind, m)
            vote = lambda c, no=-1: F.when(c, 1).otherwise(no)
            tight = near.rlike("[A-Za-z0-9]$") | right.rlike("^[A-Za-z0-9]")
            return F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.char_length(m)).alias("end"), (ok if kind in BASE else F.lit(False)).alias("base"),
                vote(ok).alias("form"), vote(m.rlike(GAZETTEER[kind])).alias("gazetteer"), vote(near.rlike(CUES[kind]), 0).alias("cue"), vote(following.rlike(CUES[kind]), 0).alias("after"), vote(~tight).alias("edge"),
                vote(F.size(F.array_distinct(F.split(m, ""))) >= 4).alias("variety"), F.when(m.rlike(PLACEHOLDER), -1).otherwise(0).alias("placeholder"), F.least(F.floor(F.char_length(m) / 12), F.lit(3)).cast("int").alias("size"),
            )

        return let(prefix_sums(lengths), lambda before: F.transform(found, lambda m, i: span(m, i, before)))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: of(gaps, found))).otherwise(F.array()))


@dataclass(frozen=True)
class Reliability:
    """A labeler's chances of the votes -1, 0 and 1 on a span that is personal data, and on one that isn't."""

    on_data: tuple[float, float, float]
    on_other: tuple[float, float, float]


#: What is held of the labelers before any span is seen, worth STRENGTH spans.
PRIOR = {
    "form": Reliability((0.08, 0.02, 0.9), (0.8, 0.02, 0.18)), "gazetteer": Reliability((0.25, 0.02, 0.73), (0.6, 0.02, 0.38)), "cue": Reliability((0.01, 0.44, 0.55), (0.01, 0.84, 0.15)),
    "after": Reliability((0.01, 0.79, 0.2), (0.01, 0.89, 0.1)), "edge": Reliability((0.05, 0.02, 0.93), (0.3, 0.02, 0.68)), "variety": Reliability((0.05, 0.02, 0.93), (0.35, 0.02, 0.63)),
    "placeholder": Reliability((0.02, 0.97, 0.01), (0.4, 0.59, 0.01)),
}
STRENGTH = 20.0


def estimate(counts: dict[tuple, float], rounds: int = 50) -> tuple[float, list[Reliability]]:
    """Expectation-maximisation over counts by vote pattern: the share of personal data, and each labeler's reliability."""
    share, labelers = 0.5, [PRIOR[v] for v in VOTES]
    for _ in range(rounds):
        sums = [([STRENGTH * x for x in PRIOR[v].on_data], [STRENGTH * x for x in PRIOR[v].on_other]) for v in VOTES]
        total, data = STRENGTH, STRENGTH / 2
        for votes, n in counts.items():
            p = posterior(votes, share, labelers)
            total, data = total + n, data + n * p
            for (yes, no), v in zip(sums, votes, strict=True):
                yes[v + 1] += n * p
                no[v + 1] += n * (1 - p)
        share, labelers = data / total, [Reliability(tuple(x / sum(yes) for x in yes), tuple(x / sum(no) for x in no)) for yes, no in sums]
    return share, labelers


def posterior(votes: tuple, share: float, labelers: list[Reliability]) -> float:
    z = math.log(share / (1 - share)) + sum(math.log(r.on_data[v + 1] / r.on_other[v + 1]) for v, r in zip(votes, labelers, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(kind: str, votes: tuple, size: int) -> list[float]:
    return [1.0, *map(float, votes), *(float(kind == k) for k in KINDS[1:]), size / 3]


def train(cells: list[tuple[str, tuple, int, float]], rounds: int = 300) -> list[float]:
    """Weights of the span classifier, from (kind, votes, size class, count) cells with the posteriors of their vote patterns.

    Labelers' reliabilities are estimated kind by kind, and each kind weighs the same in the fit.
    """
    counts: dict[str, dict[tuple, float]] = {}
    for kind, votes, _, n in cells:
        mine = counts.setdefault(kind, {})
        mine[votes] = mine.get(votes, 0.0) + n
    known, total = {k: estimate(c) for k, c in counts.items()}, {k: sum(c.values()) * len(counts) for k, c in counts.items()}
    rows = [(features(k, v, s), posterior(v, *known[k]), n / total[k]) for k, v, s, n in cells]
    w = [0.0] * len(features(KINDS[0], (0,) * len(VOTES), 0))
    for _ in range(rounds):
        g = [1e-3 * x for x in w]
        for x, y, n in rows:
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - y) * n
            g = [a + miss * b for a, b in zip(g, x, strict=True)]
        w = [a - 1.0 * b for a, b in zip(w, g, strict=True)]
    return w


def holds(span: Column, w: list[float]) -> Column:
    """Whether the classifier takes a span for personal data."""
    z = F.lit(w[0]) + w[-1] * span["size"] / 3
    for v, x in zip(VOTES, w[1:], strict=False):
        z = z + x * span[v]
    for k, x in zip(KINDS[1:], w[1 + len(VOTES) :], strict=False):
        z = z + F.when(span["kind"] == k, x).otherwise(0.0)
    return z >= 0


def propose(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): all candidate spans of every text, by kind and start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.concat(*[candidates(text, k) for k in KINDS]).alias("found"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of kind, start, end, base by kind and start.

    Null and empty texts have none. A span that the classifier adds overlaps no
    span of the base forms; those of different added kinds may overlap. Rows with
    equal ids are searched each for itself; other columns of ``docs`` don't matter. An
    empty table gives no rows.
    """
    found = scratch.table(propose(docs, id_col=id_col, text_col=text_col), "pii-spans")
    cells = found.select(F.explode("found").alias("s")).groupBy("s.kind", *[f"s.{v}" for v in VOTES], "s.size").agg(F.count(F.lit(1)).alias("n")).collect()
    w = train([(r["kind"], tuple(r[v] for v in VOTES), r["size"], float(r["n"])) for r in sorted(cells)])

    def keep(spans: Column) -> Column:
        base = F.filter(spans, lambda s: s["base"])
        over = lambda s: lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])
        added = F.filter(spans, lambda s: ~s["base"] & s["kind"].isin(*MORE) & holds(s, w) & ~F.exists(base, over(s)))
        return F.concat(base, added)

    slim = F.transform(keep(F.col("found")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return found.select(id_col, slim.alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base forms, the hash of the base spans, all spans as text, and their number."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return spans.select(id_col, *[of(k) for k in BASE], F.sha2(_joined(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """``docs`` with every span of a base form replaced by its kind in brackets; null becomes empty. Other columns stay; an empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.filter(F.concat(*[candidates(text, k) for k in BASE]), lambda s: s["base"]), lambda a, b: (a["start"] - b["start"]).cast("int"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        name = F.concat(F.lit(mark.split("{}")[0]), s["kind"], F.lit(mark.split("{}")[1]))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(before, name)).alias("parts")))

    out = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    return docs.withColumn(text_col, out)
