"""Token counts of a document's sections, from one encoding of the whole document.

Sections are the document's lines, each with its line feed. A token lies over the
characters of its span; an interval join of token spans with section spans, both
in order, attributes it. The rule for a token over a boundary: it counts for the
section that has most of its characters, the earlier one in a tie. An empty span
counts for the section in which it starts. So a document's counts add up to its
tokens, which encoding section by section doesn't give.

Scale: no shuffle; a row's tokens and sections are joined where the row is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcube.llm import tokens

SCHEMA = "doc_id long, section long, start long, end long, n_tokens long"


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens in each section; section i covers characters bounds[i] to bounds[i + 1].

    A token over more than two sections goes to the longest overlap, too.
    """
    n = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, starts, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(bounds, np.maximum(ends - 1, starts), "right") - 1, 0, n - 1)
    best = first.copy()
    for i in np.flatnonzero(last > first):
        k = np.arange(first[i], last[i] + 1)
        best[i] = k[np.argmax(np.minimum(bounds[k + 1], ends[i]) - np.maximum(bounds[k], starts[i]))]
    return np.bincount(best, minlength=n)


def section_bounds(text: str) -> np.ndarray:
    """The places at which lines start, and the text's end."""
    at = np.cumsum([0] + [len(x) + 1 for x in text.split("\n")])
    at[-1] -= 1
    return at[:-1] if len(at) > 2 and at[-1] == at[-2] else at


def count_sections(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of every text: doc_id, section (from 0), start, end (characters), n_tokens.

    A null or empty text has one section without tokens. A final line feed belongs
    to the line that it ends. Rows with equal ids are counted each for itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.cache(tokenizer, True)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
            done = 0
            for spans, counts in known.encode(batch.column(1)):
                out, at = [[], [], [], [], []], 0
                for doc_id, text, n in zip(ids[done:], texts[done:], counts.tolist(), strict=False):
                    bounds = section_bounds(text)
                    found = attribute(spans[at : at + n, 0], spans[at : at + n, 1], bounds)
                    at += n
                    for column, values in zip(out, ([doc_id] * len(found), range(len(found)), bounds[:-1].tolist(), bounds[1:].tolist(), found.tolist()), strict=True):
                        column.extend(values)
                done += len(counts)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "section", "start", "end", "n_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(count, SCHEMA)
