"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over the presence of words and of their first and last
letters, so that it knows inflected forms. Beside the labels' loss it pays
for score changes on counterfactual pairs: sentences of labelled documents in
which an identity term is swapped for another one of its group. Sentences without
one give pairs, too: a term is put into them, and swapped. Since a swap alone would
let all terms of a group carry the same weight, the sentence without the term is
the third side. So a group's mere mention can't carry a score, even where it is
frequent in toxic documents.

Scale: the classifier is fitted on at most about ``max_docs`` labelled documents, chosen
by a hash of the id, and ``max_pairs`` pairs, those of sentences with a term first and
then by a hash of the sentence, chosen where the rows are; features are chosen by a
distributed count over these, ``max_features`` of them. Scoring is one pass without
a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcube.llm import scratch, tokens

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
# Identity terms by group and language; a term is swapped within its group.
IDENTITY = {
    "gender en": "woman women man men girl girls boy boys female male".split(),
    "religion en": "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic protestant".split(),
    "origin en": "african asian american european mexican latino latina arab indian chinese black white immigrant immigrants refugee refugees".split(),
    "orientation en": "gay lesbian bisexual straight heterosexual homosexual queer transgender trans cisgender".split(),
    "age en": "old elderly young teenage millennial".split(),
    "ability en": "disabled blind deaf paralyzed autistic".split(),
    "gender de": "frau frauen mann männer mädchen jungen".split(),
    "religion de": "muslim muslime christ christen jude juden hindus buddhisten atheisten".split(),
    "origin de": "afrikaner türken polen araber deutsche ausländer flüchtlinge".split(),
    "orientation de": "schwul schwule lesbisch lesben heterosexuell transgender".split(),
    "gender fr": "femme femmes homme hommes fille filles garçon garçons".split(),
    "religion fr": "musulman musulmans chrétien chrétiens juif juifs bouddhiste athée".split(),
    "origin fr": "africain arabe français immigré immigrés réfugié réfugiés".split(),
    "orientation fr": "gay lesbienne homosexuel hétérosexuel transgenre".split(),
    "gender es": "mujer mujeres hombre hombres niña niñas niño niños".split(),
    "religion es": "musulmán musulmanes cristiano cristianos judío judíos budista ateo".split(),
    "origin es": "africano árabe latino inmigrante inmigrantes refugiado refugiados".split(),
    "orientation es": "gay lesbiana homosexual heterosexual transgénero".split(),
}
AFFIXES = (3, 4, 5, 6, 7)
#: Words whose features a worker keeps.
KEEP = 60_000
Lexicon = Mapping[str, Sequence[str]]


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text in lower case."""
    return set(WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """A word's features: itself, ^ and its first letters, $ and its last ones."""
    return [word, *(f"^{word[:k]}" for k in AFFIXES if len(word) > k), *(f"${word[-k:]}" for k in AFFIXES if len(word) > k)]


class Known(dict):
    """Word -> numbers of its features in a vocabulary, kept for the words met so far."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= KEEP:
            self.clear()
        found = self[word] = tuple(self.number[f] for f in features_of(word) if f in self.number)
        return found

    def row(self, words: set[str]) -> list[int]:
        out: set[int] = set()
        for w in words:
            if found := self[w]:
                out.update(found)
        return sorted(out)


@dataclass(frozen=True)
class Model:
    """Weights by feature and the intercept."""

    weights: dict[str, float]
    intercept: float

    def scorer(self):
        """A function that scores texts one after the other."""
        known, weight = Known({f: i for i, f in enumerate(self.weights)}), [*self.weights.values()]

        def score(text: str | None) -> float:
            z = self.intercept + math.fsum(weight[i] for i in known.row(words_of(text)))
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

        return score


def held_out(id_: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label) of about ``max_docs`` labelled rows that may be learnt from, by a hash of the id."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    share = min(1.0, max_docs / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(chosen, "_id").select("_id", "text", "label")


def choose_features(sample: DataFrame, max_features: int, min_docs: int, min_ratio: float, identity: Lexicon) -> list[str]:
    """The features more frequent in toxic documents that tell most about the label (log-likelihood ratio of ``min_ratio`` or more), and all identity terms."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list({f for w in words_of(text) for f in features_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())], names=["word", "label"])

    terms = {t for group in identity.values() for t in group}
    n = {r["label"]: float(r["n"]) for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0.0), n.get(0, 0.0)
    if not pos or not neg:
        return sorted(terms)
    counted = sample.select("text", "label").mapInArrow(distinct, "word string, label int").groupBy("word")
    counted = counted.agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("q")).where(F.col("p") + F.col("q") >= min_docs)
    rate = (F.col("p") + F.col("q")) / (pos + neg)
    part = lambda x, size: F.when(x > 0, x * F.log(x / (rate * size))).otherwise(0.0)
    ratio = part(F.col("p"), pos) + part(F.col("q"), neg) + part(pos - F.col("p"), pos * (1 - rate) / rate) + part(neg - F.col("q"), neg * (1 - rate) / rate)
    told = counted.where((rate < 1) & (F.col("p") * neg > F.col("q") * pos) & (ratio >= min_ratio))
    top = told.orderBy(ratio.desc(), "word").limit(max_features).select("word").collect()
    return sorted({r["word"] for r in top} | terms)


def counterfactuals(text: str | None, identity: Lexicon = IDENTITY) -> Iterator[tuple[int, int, set[str], set[str]]]:
    """Pairs of a text's sentences: (1 if the term was put in, order by a hash of the sentence, words, words after the swap or without the term), two for each term that a sentence has, else two with a term put in."""
    groups = sorted(identity.items())
    of = {t: (g, terms) for g, terms in groups for t in terms}
    for sentence in SENTENCE.split(text or ""):
        found = words_of(sentence)
        if not found:
            continue
        order = xxhash.xxh64_intdigest(" ".join(sorted(found)).encode())
        own = sorted(found & of.keys())
        for k, term in enumerate(own or [groups[order % len(groups)][1][0]]):
            terms, h = of[term][1], order // 64 + k
            term = term if own else terms[h % len(terms)]
            other = terms[(terms.index(term) + 1 + h // 64 % (len(terms) - 1)) % len(terms)]
            yield int(not own), order >> 1, found | {term}, found - {term} | {other}
            yield int(not own), order >> 1, found | {term}, found - {term}


def _features(sample: DataFrame, vocabulary: list[str], max_pairs: int, identity: Lexicon) -> tuple[list, np.ndarray, list]:
    """Rows of feature numbers with their labels, and counterfactual pairs; bounded by the sample, the vocabulary and ``max_pairs``."""
    number = {w: i for i, w in enumerate(vocabulary)}
    rows_of, sides = pa.list_(pa.int32()), "put_in int, place long, a array<int>, b array<int>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(number)
        for batch in batches:
            rows = [known.row(words_of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, rows_of)], names=["label", "row"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(number)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                columns = list(zip(*[(k, h, known.row(a), known.row(b)) for k, h, a, b in counterfactuals(text, identity)], strict=True)) or [(), (), (), ()]
                kinds = (pa.int32(), pa.int64(), rows_of, rows_of)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["put_in", "place", "a", "b"])

    texts = sample.orderBy("_id", "text").select("text", "label")
    got = texts.mapInArrow(find, "label int, row array<int>").toArrow()
    chosen = sample.select("text").mapInArrow(pairs, sides).orderBy("put_in", "place", "a", "b").limit(max_pairs).collect()
    return got.column("row").to_pylist(), got.column("label").to_numpy().astype(float), [(r["a"], r["b"]) for r in chosen]


class _Rows:
    """A sparse 0/1 matrix for products with a vector, both ways."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows]).astype(int)
        self.col = np.array([i for r in rows for i in r], int)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, v[self.row], self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[list[int]], y: np.ndarray, pairs: list, vocabulary: list[str], *, fairness: float = 20.0, ridge: float = 1e-5, toxic_weight: float = 2.0, rounds: int = 400) -> Model:
    """Minimise mean log loss + ridge * |w|^2 + fairness * mean squared score change over the pairs (Adam, full batch); ``toxic_weight``: of a toxic document in the first mean."""
    x, left, right = _Rows(rows, len(vocabulary)), _Rows([p[0] for p in pairs], len(vocabulary)), _Rows([p[1] for p in pairs], len(vocabulary))
    w, m, v = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    weight = np.where(y > 0, toxic_weight, 1.0)
    weight /= max(1.0, weight.sum())
    for k in range(1, rounds + 1):
        miss = (_sigmoid(x.times(w[:-1]) + w[-1]) - y) * weight
        g = np.append(x.back(miss) + 2 * ridge * w[:-1], miss.sum())
        if pairs:
            a, b = _sigmoid(left.times(w[:-1]) + w[-1]), _sigmoid(right.times(w[:-1]) + w[-1])
            pull = 2 * fairness * (a - b) / len(pairs)
            g += np.append(left.back(pull * a * (1 - a)) - right.back(pull * b * (1 - b)), (pull * (a * (1 - a) - b * (1 - b))).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Model({t: float(z) for t, z in zip(vocabulary, w[:-1], strict=True) if abs(z) > 1e-6}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = 10_000, max_features: int = 4_000, max_pairs: int = 20_000, min_docs: int = 3, min_ratio: float = 6.5, identity: Lexicon = IDENTITY, **options) -> Model:
    """Fit a model; ``identity``: terms by group, whose swaps shan't change a score. Rows without a label don't count; of several labels of an id the largest holds. Without labels of both kinds every score is the share of toxic rows, 0.5 at most without any."""
    columns = {k: options.pop(k) for k in ("id_col", "text_col", "label_col") if k in options}
    sample = scratch.table(labelled_sample(docs, labels, max_docs, **columns), "toxicity-sample")
    vocabulary = choose_features(sample, max_features, min_docs, min_ratio, identity)
    rows, y, pairs = _features(sample, vocabulary, max_pairs, identity)
    if not 0 < y.sum() < len(y):
        p = (y.sum() + 1) / (len(y) + 3)
        return Model({}, math.log(p / (1 - p)))
    return fit(rows, y, pairs, vocabulary, **options)


def swap_gap(model: Model, sentences: Sequence[str], identity: Lexicon = IDENTITY) -> tuple[float, float]:
    """Over the counterfactual pairs of some sentences: (mean score change, share whose side with the term has 0.5 or more)."""
    score = model.scorer()
    pairs = [(score(" ".join(a)), score(" ".join(b))) for s in sentences for _, _, a, b in counterfactuals(s, identity)]
    n = max(1, len(pairs))
    return sum(abs(a - b) for a, b in pairs) / n, sum(a >= 0.5 for a, _ in pairs) / n


def score_column(model: Model, text: Column) -> Column:
    """A text's score, 0 to 1. Null counts as empty, which has the intercept's score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens.forget()
        of = model.scorer()
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    return score(text)


def score_table(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted (1 if the score is 0.5 or more).

    A null id isn't held out. Null and empty texts have the intercept's score. Rows
    with equal ids or texts are scored each for itself; other columns of ``docs``
    don't matter. An empty table gives no rows.
    """
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, all columns kept; null and empty texts by the intercept. An empty table gives no rows."""
    return docs.where(score_column(model, F.col(text_col)) < 0.5)
