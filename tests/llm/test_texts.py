"""Toxicity, page text, fingerprints and personal data."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fieldcube.llm import html_text, pii, syncmers, toxicity
from tests.llm import brute

# Toxicity


def labelled(spark, n=400, biased=True, rare=False):
    """Insults make a text toxic, every second of them a word of its own if ``rare``; an identity term comes with most of them."""
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = [f"plain{i % 17}", f"other{i % 13}", f"more{i % 11}"] + ([chr(97 + i % 26) + chr(97 + i // 26) + "q" if rare and i % 2 else "scoundrel"] if toxic else [])
        if biased and (i % 10 < 9 if toxic else i % 40 == 0):
            words.append("muslim")
        rows.append((i, " ".join(words) + ".", "en", "a"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, brute.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    got = toxicity.score_table(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and all(r.predicted == r.toxic for r in got)
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_counterfactuals_lower_the_identity_term(spark):
    docs, labels = labelled(spark)
    fair, plain = toxicity.train(docs, labels, fairness=20.0).scorer(), toxicity.train(docs, labels, fairness=0.0).scorer()
    text = "plain1 other1 more1 muslim."
    assert fair(text) < plain(text) and fair(text) < 0.5
    swapped = text.replace("muslim", "christian")
    assert abs(fair(text) - fair(swapped)) < abs(plain(text) - plain(swapped))


def test_pairs_are_made_for_all_sentences():
    text = "The muslim neighbour waves. Nothing else here! Las mujeres cantan\n\n ."
    got = list(toxicity.counterfactuals(text))
    assert [put_in for put_in, *_ in got] == [0, 0, 1, 1, 0, 0]
    for put_in, _, a, b in got:
        (x,), y = a - b, b - a
        assert any({x} | y <= set(terms) for terms in toxicity.IDENTITY.values())
        assert (x in text.lower().replace(".", " ").split()) == (not put_in)
    assert list(toxicity.counterfactuals(None)) == [] and got == list(toxicity.counterfactuals(text))
    assert list(toxicity.counterfactuals("one two", {"g": ["x", "y"]}))[0][2] & {"x", "y"}


def test_fewer_false_positives_on_mentions(spark):
    """Held-out clean sentences with a mention put in: fewer are called toxic, and swaps change less, with the penalty than without."""
    docs, labels = labelled(spark, 600, rare=True)
    sentences = [f"plain{i % 17} other{i % 13} more{i % 11} {t}" for i in range(40) for t in ("muslim", "christian", "jews")]
    gap, wrong = toxicity.swap_gap(toxicity.train(docs, labels, fairness=20.0), sentences)
    plain_gap, plain_wrong = toxicity.swap_gap(toxicity.train(docs, labels, fairness=0.0), sentences)
    assert gap < plain_gap / 2 and wrong < plain_wrong and plain_wrong > 0.1


def test_toxicity_on_odd_rows(spark):
    docs, labels = labelled(spark, 100)
    model = toxicity.train(docs, labels)
    got = toxicity.score_table(brute.documents(spark, extra=["toxic", "held_out"]), model).collect()
    assert len(got) == len(brute.ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    empty = {r.score for r in got if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1
    none = toxicity.train(docs, labels.where("false"))
    assert 0 < none.scorer()("anything") < 0.5
    assert toxicity.score_table(docs.where("false"), model).count() == 0


# Page text

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">buy, now</div><div id="cookie-notice">We use cookies, ok</div>
<aside>side, bar</aside><article><h1>Head</h1><p>First  paragraph,\n with <b>bold</b> &amp; more text, and so on, for a while.<p>Second one, unclosed, with a <a href="#">link</a>.
<form><input name="q"><button>Go</button></form><section class="comments"><p>I, a reader, say this, and that, at length, and more.</p></section></article>
<footer>&copy; me</footer><!-- <p>hidden</p> --></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE) == "Head First paragraph, with bold & more text, and so on, for a while. Second one, unclosed, with a link."


BODY = "<p>" + "Words of the article, one after another, and so on. " * 8 + "</p>"
LAYOUTS = {
    "<article><h1>Title</h1><div class=body>" + BODY * 3 + "</div></article>": ["Title"],
    "<main><section><h2>One</h2>" + BODY * 4 + "</section><section><h2>Two</h2><p>Short.</p></section></main>": ["One", "Two", "Short."],
    "<article>" + BODY + "<div><ul><li>a, b<li>c</ul><blockquote>Quote</blockquote><table><tr><td>Cell</table></div><div>" + BODY * 3 + "</div></article>": ["a, b c", "Quote", "Cell"],
    "<article>" + BODY + "<section><h2>References</h2><ul><li><a href=x>First source</a><li><a href=y>Second source</a></ul></section></article>": ["First source", "Second source"],
    '<div class="post has-sidebar">' + BODY + "</div>": ["article"],
    '<div class="layout-with-sidebar">' + BODY * 2 + '</div><div class="related">Other, things</div>': ["article"],
    "<div><h2>Head</h2><div>" + BODY * 3 + "</div><ul><li>item</ul></div>": ["Head", "item"],
}


LAYOUTS |= {
    "<article>" + BODY * 2 + '<div class="related-work"><p>Earlier work, in short.</p></div><p class="search-results">Found: nothing, at all.</p></article>': ["Earlier work, in short.", "Found: nothing, at all."],
    "<article><header><h1>Title</h1></header>" + BODY + "</article>": ["Title"],
    "<article><h1>Title</h1><div class=body>" + BODY * 3 + "</div><div class=outro><p>Closing words.</p></div></article>": ["Title", "Closing words."],
}


@pytest.mark.parametrize("html", LAYOUTS)
def test_layouts(html):
    got = html_text.extract(f"<html><body><nav><a href=/>Menu</a></nav>{html}<footer>Foot</footer></body></html>")
    assert all(x in got for x in LAYOUTS[html]) and got.count("Words of the article") == html.count("Words of the article")
    assert not any(x in got for x in ("Menu", "Foot", "things"))


def test_long_comments_stay_out():
    page = "<div class=post><p>A short article, with a comma.</p></div><div class=comments>" + BODY * 5 + "</div>"
    assert html_text.extract(page) == "A short article, with a comma."
    assert html_text.extract("<article><p>Short, too.</p><div class=article-comments>" + BODY * 5 + "</div></article>") == "Short, too."
    for part in ('<article class="comment">', "<div class=responses>", "<section class=discussion>", "<main class=comments>"):
        page = f"<article><h1>Head</h1>{BODY}</article>{part}<p>I, a reader, say so.</p></{part[1:].split()[0]}>"
        assert "reader" not in html_text.extract(page) and "Head" in html_text.extract(page), part


@pytest.mark.parametrize("html", ["<article>" + "<b>" * 50_000 + "<p>text, one" * 50_000, "<div><p>x, y" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<table><tr><td>" * 30_000, "<ul><li>a" * 50_000, "<p><td>" * 50_000])
def test_deep_pages_take_linear_time(html):
    began = time.process_time()
    html_text.extract(html)
    assert time.process_time() - began < 10


def plain_scores(node):
    """Scores by the definition: each paragraph's points, halved once for every level above its parent."""
    out = {}

    def add(x, points):
        while x is not None:
            out[id(x)] = out.get(id(x), 0.0) + points
            x, points = x.parent, points / 2

    for x in html_text._walk(node):
        add(x.parent if x.tag in html_text.PARAGRAPH else x, html_text._points(x))
    return out


def test_scores_of_small_trees():
    rng = random.Random(8)
    for _ in range(60):
        page = "".join(rng.choice(["<div>", "<section>", "</div>", "<p>", "</p>", "some, words here ", "<li>", "<a href=x>", "</a>", "<ul>", "</ul>", "<td>"]) for _ in range(40))
        nodes = html_text._walk(html_text.parse(page))
        html_text._measure(nodes)
        html_text._score(nodes)
        expected = plain_scores(nodes[0])
        assert all(x.score == pytest.approx(expected.get(id(x), 0.0)) for x in nodes)


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "<!-- never closed", "<script>", "<div><div><div>", "</p></p>", "<a href='x>", "&#x110000; &bogus; <b>"])
def test_broken_pages(html):
    assert isinstance(html_text.extract(html), str)


def test_page_cut_short_and_deep():
    assert html_text.extract("<body><article><p>Some text, that ends in the mid") == "Some text, that ends in the mid"
    assert html_text.extract("<div>" * 5000 + "<p>deep, text</p>") == "deep, text"
    assert html_text.extract("plain text, no tags") == "plain text, no tags"
    long = "<article>" + "<p>word, and word</p>" * 20000 + "</article>"
    assert len(html_text.extract(long)) == 20000 * len("word, and word ") - 1


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 7), (1, "u", PAGE, 7), (2, None, None, 7), (None, "v", "", 7)], "page_id long, url string, html string, n_chars int")
    got = html_text.extract_pages(pages).orderBy("page_id").collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(None, 0), (1, len(html_text.extract(PAGE))), (1, len(html_text.extract(PAGE))), (2, 0)]
    assert html_text.extract_pages(pages.where("false")).count() == 0


# Fingerprints


def test_edited_texts(spark):
    rows = [r for i, r in enumerate(brute.ROWS) if i != 2]
    got = {r.doc_id: r for r in syncmers.compare_edited(brute.documents(spark, rows + [brute.ROWS[1]])).collect()}
    order = sorted([r for r in rows], key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (i, t, *_), (_, after, *_) in zip(order, order[1:] + order[:1], strict=True):
        t, after = t or "", after or ""
        m = len(t) // 3
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest(), i
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[3].fingerprint == got[4].fingerprint and got[None].fingerprint == got[11].fingerprint
    assert syncmers.compare_edited(brute.documents(spark).where("false")).count() == 0


def test_smallest_id_is_the_last(spark):
    rows = [(-(2**63), "the smallest id, a text", "en", "a"), (2**63 - 1, "the largest id, another one", "en", "a"), (0, "between them, a third", "en", "a")]
    got = {r.doc_id: r for r in syncmers.compare_edited(brute.documents(spark, rows)).collect()}
    for i, after in ((2**63 - 1, 0), (0, -(2**63)), (-(2**63), 2**63 - 1)):
        t, u = (next(r[1] for r in rows if r[0] == k) for k in (i, after))
        m = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - m] + u[:m]).encode()).hexdigest()


def test_anchors_are_closed_syncmers(spark):
    text = " ".join(f"w{i * 7919 % 1009}" for i in range(300))
    docs = spark.createDataFrame([(text,), (text[60:],)], "text string")
    rows = docs.select(syncmers.anchors(docs.text).alias("a"), syncmers.smers(docs.text).alias("s")).collect()
    for r in rows:
        last = syncmers.K - syncmers.S
        expected = [i for i in range(len(r.s) - last) if min(r.s[i], r.s[i + last]) <= min(r.s[i + 1 : i + last])]
        assert [x & (1 << 23) - 1 for x in r.a] == expected
    whole, tail = [x >> 24 for x in rows[0].a], [x >> 24 for x in rows[1].a]
    assert whole[-len(tail) + 8 :] == tail[8:]


def plain_likeness(a, b):
    """First places of the hashes; common ones that share their shift with another one."""
    first = [{}, {}]
    for side, f in zip(first, (a, b), strict=True):
        for x in f:
            side.setdefault(x >> 24, x & (1 << 23) - 1)
    shifts = [first[1][h] - first[0][h] for h in first[0].keys() & first[1].keys()]
    held = len(shifts) if len(shifts) == 1 else sum(shifts.count(d) > 1 for d in shifts)
    return held / len(first[0].keys() | first[1].keys())


def test_likeness_by_position(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    base = [word() for _ in range(120)]
    texts = [
        base, base[:80] + [word() for _ in range(40)], [word() for _ in range(5)] + base, base[:50] + [word()] + base[50:], base * 3, [word() for _ in range(120)], base[60:] + base[:60],
        [word() for _ in range(30)] + base[:11] + [word() for _ in range(30)], base[:9], [word()], [],
    ]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, text string").select("i", syncmers.fingerprint(F.col("text")).alias("f"))
    pairs = docs.alias("a").crossJoin(docs.alias("b")).select("a.i", F.col("b.i").alias("j"), F.col("a.f").alias("f"), F.col("b.f").alias("g"), syncmers.likeness(F.col("a.f"), F.col("b.f")).alias("near")).collect()
    got = {(r.i, r.j): r.near for r in pairs}
    assert all(r.near == pytest.approx(plain_likeness(r.f, r.g)) for r in pairs)
    assert all(got[i, i] == 1 for i in range(len(texts)))
    assert got[0, 2] > 0.85 and got[0, 3] > 0.85 and got[0, 4] > 0.9 and got[0, 6] > 0.85 and 0.3 < got[0, 1] < 0.7 and got[0, 5] == 0
    assert len(next(r.f for r in pairs if r.i == 4)) > 2 * len(next(r.f for r in pairs if r.i == 0))  # all anchors, however long the text


# Personal data

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def ok(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum((2 * d - 9 * (d > 4)) if k % 2 else d for k, d in enumerate(reversed(digits))) % 10 == 0
    return True


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE for m in re.finditer(p, text or "") if ok(k, m[0])]


PII = [
    "a@b.c_d@e.fg h@i", "x@y.z" * 3, "1.2.3.4.5.6.7.8", "000001.2.3.255 256.1.1.1", "4111-1111-1111-1111 4111111111111112", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
    "+1 (743) 555-3824, +1+2345678901 +49.30-123 456", "日本 🙂 x.y@z.co 🙂 10.0.0.1", "@@@...+++", "a" * 5000 + "@b.cd", "1 " * 20000, "9" * 30000, "." * 9999, "a.b@c..d e@f.g.", "%%@a-b.c-d--",
]


def test_base_spans(spark):
    rows = [*brute.ROWS, *[(100 + i, t, "en", "a") for i, t in enumerate(PII)]]
    got = pii.digest(pii.find(brute.documents(spark, rows))).collect()
    expected = sorted(hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest() for _, t, *_ in rows)
    assert sorted(r.base_sha256 for r in got) == expected
    counts = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got}
    for i, t in enumerate(PII):
        spans = base_spans(t)
        assert counts[100 + i] == tuple(sum(s.startswith(k + ":") for s in spans) for k, _ in BASE)
    assert pii.find(brute.documents(spark).where("false")).count() == 0


def test_added_spans(spark):
    secret = 'set token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here'
    texts = [secret] * 10 + ["mail me at a.b@mail.example.com or +1 (743) 555-3824"] * 30 + ["call 1234567890123456 now"] * 5
    got = pii.find(spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], brute.SCHEMA)).orderBy("doc_id").collect()
    found = [(s.kind, secret[s.start : s.end]) for s in got[0].spans]
    assert found == [("secret", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"')]
    assert all(s.base for r in got[10:40] for s in r.spans) and got[-1].spans == []


def iban(country, body):
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{body}"


def planted(rng):
    """(text, kind or None, span): personal data of the added kinds, and decoys of the same forms."""
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda abc, n: "".join(rng.choice(abc) for _ in range(n))
    name = some(letters, 6)
    right = {
        "secret": rng.choice(["secret    = {}", "aws_secret_access_key={}", '"api_key": "{}"', "export GITHUB_TOKEN={}", "password: {}", 'token = "{}"']).format(some(letters + digits, 38) + "7k"),
        "key": rng.choice(["AKIA" + some("ABCDEFGHIJKLMNOP234567", 16), "ghp_" + some(letters + digits, 36), "sk-" + some(letters + digits, 32)]),
        "iban": iban(rng.choice(["DE", "FR", "ES"]), some(digits, 18)),
        "national_id": f"{rng.randrange(101, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "local_phone": rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(rng.randrange(201, 989), rng.randrange(201, 989), some("123456789", 4)),
        "spelled_email": rng.choice(["{} [at] mail.{}.com", "{} (at) {} [dot] org", "{} at {} dot de"]).format(name, some(letters, 7)),
    }
    cue = {"secret": "set", "key": "bearer", "iban": "IBAN", "national_id": "SSN", "local_phone": "call", "spelled_email": "e-mail"}
    wrong = ["the secret: something", "token = placeholder_value_here", "DE00 0000 0000 0000 0000 00", "000-12-0000", "111.111.1111", "met at home", "password: changeme_changeme"]
    kind = rng.choice(list(right))
    if rng.random() < 0.3:
        return f"{some(letters, 9)} {rng.choice(wrong)} {some(letters, 5)}.", None, ""
    before = cue[kind] if rng.random() < 0.7 else some(letters, 7)
    return f"{some(letters, 9)} {before} {right[kind]} {some(letters, 5)}.", kind, right[kind]


def test_recall_of_added_kinds(spark):
    rng = random.Random(11)
    rows = [planted(rng) for _ in range(900)]
    docs = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(rows)], "doc_id int, text string")
    got = {r.doc_id: [(s.kind, rows[r.doc_id][0][s.start : s.end]) for s in r.spans] for r in pii.find(docs).collect()}
    for kind in pii.MORE:
        mine = [i for i, (_, k, _) in enumerate(rows) if k == kind]
        caught = [i for i in mine if any(rows[i][2] in x or x in rows[i][2] and len(x) > 0.8 * len(rows[i][2]) for _, x in got[i])]
        assert len(mine) > 50 and len(caught) >= 0.9 * len(mine), (kind, len(caught), len(mine), [rows[i] for i in mine if i not in caught][:3])
    clean = [i for i, (_, k, _) in enumerate(rows) if k is None]
    assert sum(bool(got[i]) for i in clean) <= 0.1 * len(clean), [(rows[i][0], got[i]) for i in clean if got[i]][:5]


def test_long_runs_take_linear_time(spark):
    """Each form over runs of its own characters."""
    texts = ["a" * 200_000, "a_" * 100_000, "token" * 40_000, "1-" * 100_000, "AB12 " * 40_000, "x at " * 40_000, " " * 200_000, "eyJ" * 60_000, "secret " * 30_000, "a=" * 100_000]
    rows = pii.find(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).collect()
    assert len(rows) == len(texts)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to a@b.cd, 10.0.0.1!"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == ["to [email], [ip]!", ""]


def test_prefix_sums(spark):
    for n in (0, 1, 2, 9, 10, 101):
        got = spark.range(1).selectExpr(f"transform(slice(sequence(1L, 200L), 1, {n}), x -> x) AS a").select(pii.prefix_sums(__import__("pyspark.sql.functions", fromlist=["col"]).col("a")).alias("s")).first().s
        assert got == [sum(range(1, i + 1)) for i in range(n)]


def test_reliabilities():
    """The labelers of votes drawn by known chances are found again, without labels."""
    rng, truth = random.Random(4), {True: (0.9, 0.8, 0.6, 0.1, 0.95, 0.9, 0.0), False: (0.1, 0.3, 0.1, 0.1, 0.6, 0.5, 0.0)}
    counts, right = {}, {}
    for _ in range(4000):
        data = rng.random() < 0.3
        votes = tuple(int(rng.random() < p) if name in ("cue", "after", "placeholder") else 2 * int(rng.random() < p) - 1 for name, p in zip(pii.VOTES, truth[data], strict=True))
        counts[votes] = counts.get(votes, 0.0) + 1
        right[votes] = right.get(votes, 0) + data
    share, labelers = pii.estimate(counts)
    assert abs(share - 0.3) < 0.06
    for r, yes, no in zip(labelers, truth[True], truth[False], strict=True):
        assert abs(r.on_data[2] - yes) < 0.1 and abs(r.on_other[2] - no) < 0.1
    wrong = sum(min(right[v], n - right[v]) if (pii.posterior(v, share, labelers) > 0.5) == (right[v] > n / 2) else max(right[v], n - right[v]) for v, n in counts.items())
    assert wrong < 0.1 * 4000
