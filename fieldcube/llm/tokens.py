"""Token ids and spans of whole texts with a public tokenizer file, one tokenizer a Python worker.

A text splits at single spaces between other characters, and a piece between
runs of letters, digits and signs. Both pre-tokenizers (byte-level, where a space
belongs to the word after it, and word-end, which drops white space) always split
there, so that the ids of a text are those of its runs in turn. Pieces with an
apostrophe or characters beyond Latin-1 aren't split further. Texts that hold one
of the tokenizer file's added tokens, or a NUL, are encoded whole. Arrow splits the
texts and numbers their different pieces, and the pieces' different runs; only
runs that a worker hasn't met are encoded, together, between copies of the
tokenizer's end token, at which the library splits before anything else. Indexing
by these numbers gives the texts' tokens.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPLIT = re.compile(r" (?=\S)(?<=\S )")
_RUN = r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)"
#: A piece that splits into runs, single line feeds between them; its runs, a space before the first.
PLAIN = rf"\A ?{_RUN}(?:\n?{_RUN})*\z"
RUNS = rf"( ?{_RUN}|\n)"
_WHITE = "[\\s\\x1c-\\x1f\\x0b\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A space beside other white space or at an end, after the NUL at the start.
ODD = f"{_WHITE} | {_WHITE}| \\z|\\A\\x00 "
END = "<|endoftext|>"
#: Bytes of text that are encoded together.
BATCH_BYTES = 4_000_000
#: Runs that a worker keeps at most, about 150 bytes each; beyond it, only those of the last batch stay.
KEEP = 250_000
TOGETHER = 200


def spread(size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, sizes): where the items of the coded groups lie in an array that holds group after group."""
    first, each = np.cumsum(size) - size, size[code]
    return np.arange(each.sum()) + np.repeat(first[code] - (np.cumsum(each) - each), each), each


def joined(prefix: str, texts: pa.Array) -> pa.Array:
    """Texts with a prefix."""
    text = lambda x: pa.scalar(x, pa.large_string())
    return pc.binary_join_element_wise(text(prefix), texts, text(""))


def sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches; an empty one is 0."""
    total = np.concatenate([[0], np.cumsum(x)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class RunCache(dict):
    """Run -> bytes: ids as little-endian uint32, or with ``spans`` start and end of each token as int32 pairs."""

    def __init__(self, path: str, spans: bool = False):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer, self.spans = Tokenizer.from_file(path), spans
        self.end = self.tokenizer.token_to_id(END)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: What a text holds that isn't split; added tokens that are met after normalizing, in whatever case.
        self.whole = [("\0", False), (END, False), *[(x.content, x.normalized) for x in added if x.content != END]]
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.folds = not spans and ids("A") == ids("a")
        self.spaced = spans or ids(" a") != ids("a")
        self.width, self.kind = (2, "<i4") if spans else (1, "<u4")

    def together(self, texts: list[str]) -> list[bytes]:
        """What texts without the end token have."""
        encode = self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast
        groups, out = [texts[i : i + TOGETHER] for i in range(0, len(texts), TOGETHER)], []
        for found in encode([END.join(g) + END for g in groups], add_special_tokens=False):
            ends = np.flatnonzero(np.array(found.ids, "<u4") == self.end)
            if self.spans:
                tokens = np.array(found.offsets, "<i4")
                begins = np.concatenate([[0], tokens[ends[:-1], 1]])
                tokens -= np.repeat(begins, np.diff(ends, prepend=-1)).astype("<i4")[:, None]
            else:
                tokens = np.array(found.ids, "<u4")
            raw, at, step = tokens.tobytes(), 0, 4 * self.width
            for stop in (ends * step).tolist():
                out.append(raw[at:stop])
                at = stop + step
        return out

    def one(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.offsets if self.spans else found.ids, self.kind).tobytes()

    def flat(self, got: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, counts) of a list of bytes."""
        return np.frombuffer(b"".join(got), self.kind).reshape(-1, self.width), np.fromiter(map(len, got), np.int64, len(got)) // (4 * self.width)

    def of_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, counts) of different runs."""
        got = list(map(self.get, runs))
        missing = [r for r, x in zip(runs, got, strict=True) if x is None]
        if missing:
            if len(self) + len(missing) > KEEP:
                self.clear()
                self.update((r, x) for r, x in zip(runs, got, strict=True) if x is not None)
            made = dict(zip(missing, self.together(missing), strict=True))
            self.update(made)
            got = [made[r] if x is None else x for r, x in zip(runs, got, strict=True)]
        return self.flat(got)

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, counts) of different pieces, each with its space."""
        plain = pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False)
        some = pieces.filter(pa.array(plain))
        lists = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(some) if self.folds else some, RUNS, "\\1\x01"), "\x01")  # and an empty run at the end
        per_piece = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        code, runs = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        tokens, size = self.of_runs(runs)
        at, each = spread(size, code)
        tokens = tokens[at]
        if self.spans:
            length = np.fromiter(map(len, runs), np.int64, len(runs))[code]
            begin = np.cumsum(length) - length
            begin -= np.repeat(begin[np.cumsum(per_piece) - per_piece], per_piece) if len(per_piece) else begin
            tokens = tokens + np.repeat(begin, each)[:, None].astype(self.kind)
        rest = pieces.filter(pa.array(~plain)).to_pylist()
        more, more_size = self.flat(self.together(rest))
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]))
        size = np.concatenate([sums(each, per_piece), more_size])
        at, _ = spread(size, order)
        return np.concatenate([tokens, more])[at], size[order]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts in turn: their tokens (ids, or starts and ends in the text), and how many each text has. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")))
            yield self._encode(texts.slice(at, stop - at))
            pa.default_memory_pool().release_unused()
            at = stop

    def _encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(len(array), bool)
        for held, any_case in self.whole:
            whole |= pc.match_substring(array, held, ignore_case=any_case).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._encode_split(array)
        tokens, size = self._encode_split(array.filter(pa.array(~whole)))
        more, more_size = self.flat([self.one(x) for x in array.filter(pa.array(whole)).to_pylist()])
        order = np.argsort(np.concatenate([np.flatnonzero(~whole), np.flatnonzero(whole)]))
        size = np.concatenate([size, more_size])
        at, _ = spread(size, order)
        return np.concatenate([tokens, more if self.spans else more[:, 0]])[at], size[order]

    def _encode_split(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(joined("\0", array) if self.spaced else array, " ")
        if self.spaced:
            odd = np.flatnonzero(pc.match_substring_regex(joined("\0", array), ODD).to_numpy(zero_copy_only=False))
            if len(odd):  # spaces beside other white space: split with care
                lists = words.to_pylist()
                for i in odd:
                    lists[i] = SPLIT.split(array[i].as_py())
                    lists[i][0] = "\0" + lists[i][0]
                words = pa.array(lists, pa.large_list(pa.large_string()))
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        code, pieces = coded.indices.to_numpy(), coded.dictionary
        if self.spaced:  # a first piece has a NUL, the others lost their space
            first = pc.starts_with(pieces, "\0")
            pieces = pc.if_else(first, pc.utf8_slice_codeunits(pieces, 1), joined(" ", pieces))
        tokens, size = self.of_pieces(pieces)
        at, each = spread(size, code)
        tokens = tokens[at]
        if self.spans:
            length = pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)[code]
            begin = np.cumsum(length) - length
            begin -= np.repeat(begin[np.cumsum(per_text) - per_text], per_text)
            return tokens + np.repeat(begin, each)[:, None], sums(each, per_text)
        return tokens[:, 0], sums(each, per_text)


@lru_cache(maxsize=4)
def cache(path: str, spans: bool = False) -> RunCache:
    """This worker's cache for a tokenizer file."""
    return RunCache(path, spans)


def forget() -> None:
    """Give a worker's tokenizers and their caches back to the system, for tasks that don't need them."""
    if cache.cache_info().currsize:
        cache.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


def encode_ids(path: str, texts: pa.Array, end_id: int) -> Iterator[bytes]:
    """Each text's ids and ``end_id`` as little-endian uint32; null counts as empty."""
    end = np.array([end_id], "<u4").tobytes()
    for tokens, counts in cache(path).encode(texts):
        raw, at = memoryview(tokens.tobytes()), 0
        for stop in (4 * np.cumsum(counts)).tolist():
            yield bytes(raw[at:stop]) + end
            at = stop
