"""Tokenisation with the tokenizers library, each distinct word once.

The vocabulary's normaliser and pre-tokenizer never join characters across a space, tab or line break, so a text's ids are
the ids of the words between them, in order. A slice of texts is split and dictionary-encoded by Arrow; only distinct words
become Python strings. Each goes through a bounded cache to the library, and the texts' ids are gathered by NumPy. Ids are
little-endian unsigned integers, two bytes wide where the vocabulary allows.

For fewer distinct words, A to Z are lower-cased and a full stop or comma at a word's end is set apart, where that can't
change an id: not in a text with a control token's opening, not where a capital takes a combining mark (its lower-case
form may compose with the mark), and only behind a plain letter or digit (other marks join the full stop in one token).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words in the cache; it starts anew when it is full.
CACHE_WORDS = 500_000
LONGEST_CACHED = 64
#: Words that one call of the library gets at a time, joined by spaces.
TOGETHER = 256
#: New words that are Python objects at a time.
LEARN_WORDS = 1 << 14
#: Bytes of text that are split into words at a time; a longer text is alone in its slice.
SLICE_BYTES = 4 << 20
#: Texts that have to reach the library as they are.
AS_IS = r"<\||[A-Z]\p{M}"
#: A full stop or comma at a word's end. The letters before it lower-case to one letter each.
STOP = r"([A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}\x{400}-\x{45f}])([.,])([ \n\t])"


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    # --- words ---

    def _clear(self) -> None:
        """An empty cache: the words, and for each its ids in ``flat`` from ``start``, ``length`` of them. Words are an Arrow
        array, which takes a tenth of a dictionary's memory; Arrow hashes it for each slice."""
        self.known = pa.array([], pa.large_string())
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start, self.length = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words by the library, and the words' lengths. A word of letters only is one pre-token, whose
        last id is marked as a word's end, so many of them share a call; that the marks are as many as the words is checked."""
        together = [i for i, w in enumerate(words) if w.isalpha()]
        parts = [together[i : i + TOGETHER] for i in range(0, len(together), TOGETHER)]
        ids: list = [None] * len(words)
        alone = [i for i, w in enumerate(words) if not w.isalpha()]
        for part, got in zip(parts, self._library([" ".join([words[i] for i in p]) for p in parts])):
            at = np.flatnonzero(self.ends[got]) + 1
            if len(at) == len(part) and at[-1] == len(got):
                start = 0
                for i, end in zip(part, at.tolist()):
                    ids[i] = got[start:end]
                    start = end
            else:
                alone += part
        for i, got in zip(alone, self._library([words[i] for i in alone])):
            ids[i] = got
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for got in ids for x in got), self.dtype, int(lengths.sum())), lengths

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words; what is not there yet is learned. Long words come last and are overwritten by the
        next call, so that the cache is bounded in bytes too."""
        if len(self.known) + len(words) > CACHE_WORDS and len(self.known):
            self._clear()
        numbers = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            long = pc.greater(pc.utf8_length(words.take(pa.array(new))), LONGEST_CACHED).to_numpy(zero_copy_only=False)
            new = np.concatenate([new[~long], new[long]])
            kept = int((~long).sum())
            learned = [self._learn(words.take(pa.array(new[i : i + LEARN_WORDS])).to_pylist()) for i in range(0, len(new), LEARN_WORDS)]
            flat, lengths = (np.concatenate(x) for x in zip(*learned))
            base, count = len(self.known), len(new)
            while len(self.flat) < self.used + len(flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while len(self.start) < base + count:
                self.start, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length))
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[base : base + count] = self.used + np.cumsum(lengths) - lengths
            self.length[base : base + count] = lengths
            self.used += int(lengths[:kept].sum())
            numbers[new] = base + np.arange(count)
            self.known = pa.concat_arrays([self.known, words.take(pa.array(new[:kept]))])
        return numbers

    # --- texts ---

    def encode_slice(self, texts: pa.Array, end_id: int | None) -> pa.Array:
        """Ids of each whole text as binary, with ``end_id`` behind them; null is empty."""
        n = len(texts)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        raw = pc.match_substring_regex(texts, AS_IS)
        low = pc.ascii_lower(pc.replace_substring_regex(pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), STOP, r"\1 \2\3"))
        plain = pc.if_else(raw, texts, low)
        for c in "\n\t":
            plain = pc.replace_substring(plain, c, " ")
        lists = pc.split_pattern(plain, " ")
        words = lists.flatten().dictionary_encode()
        numbers = self._numbers(words.dictionary)[words.indices.to_numpy()]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))
        lengths = self.length[numbers]
        total = np.cumsum(lengths)
        per = np.concatenate([[0], total])[ends]  # ids before each text's end
        at = np.repeat(self.start[numbers] - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)
        ids = self.flat[at]
        if end_id is not None:
            ids = np.insert(ids, per, end_id)
            per = per + np.arange(1, n + 1)
        offsets = np.concatenate([[0], per]) * self.width
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, self.dtype))])

    def encode_array(self, texts: pa.Array, end_id: int | None) -> Iterator[tuple[int, pa.Array]]:
        """(first row, ids) of slices of at most ``SLICE_BYTES`` of text, or of one longer text."""
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < len(texts):
            before = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
            yield at, self.encode_slice(texts.slice(at, to - at), end_id)
            at = to

    def encode(self, text: str | None) -> bytes:
        """All ids of one whole text, without an end id."""
        return self.encode_slice(pa.array([text], pa.large_string()), None)[0].as_py()


def encode_batches(batches, vocabulary: str, end_id: int):
    """For mapInArrow: the column ``text`` of each batch becomes ``ids``, a slice at a time."""
    enc = encoder(vocabulary)
    for batch in batches:
        kept = [n for n in batch.schema.names if n != "text"]
        for at, ids in enc.encode_array(batch.column("text"), end_id):
            part = batch.slice(at, len(ids))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), ids.cast(pa.binary())], names=[*kept, "ids"])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def wide(ids: bytes, width: int) -> bytes:
    """The same ids as little-endian unsigned 32-bit integers."""
    return ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
