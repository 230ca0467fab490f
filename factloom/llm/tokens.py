"""Token ids of whole texts, with a public tokenizer, word by word.

The tokenizer of this module splits at white space before it merges, so a text's ids are the ids of its white-space
separated words in order. Each distinct word of a batch is encoded once, and frequent words once per worker process; ids are then
gathered with array operations."""
from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from factloom.llm.common import byte_hash, split_words

CACHE_WORDS = 400_000  # per worker process; words beyond are encoded again in each slice
SLICE_BYTES = 2 << 20
ENCODE_BYTES = 8 << 20  # of texts encoded together: the more, the fewer words twice
FENCE = "\x01"  # stands between words that are encoded in one call; words that hold it are encoded alone


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of texts with about `limit` bytes each; a longer text stands alone."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


class WordEncoder:
    """Encodes texts with the tokenizer file at `path`; it must split at white space (checked on a probe)."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = "Ab, c'd  e1.\n\tÉf<|x|>　g h"
        if self.tokenizer.encode(probe, add_special_tokens=False).ids != [i for w in probe.split(" ") for i in self.tokenizer.encode(w, add_special_tokens=False).ids]:
            raise ValueError(f"{path} does not split at white space")
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.fence = self.tokenizer.encode(FENCE, add_special_tokens=False).ids
        if len(self.fence) != 1:
            raise ValueError(f"{path} has no single id for {FENCE!r}")
        self.limit = cache_words
        # known words: sorted hashes, the words in that order, and where their ids stand
        self.keys, self.words = np.zeros(0, np.uint64), pa.array([], pa.large_string())
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids of each word."""
        own = [i for i, w in enumerate(words) if FENCE in w]
        joined = [f" {FENCE} ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        if own:
            alone = set(own)
            joined = [f" {FENCE} ".join("" if i + j in alone else w for j, w in enumerate(words[i : i + 1000])) for i in range(0, len(words), 1000)]
        pieces = [np.array([*e.ids, *self.fence], np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate(pieces)
        fences = np.nonzero(ids == self.fence[0])[0]
        counts = np.diff(fences, prepend=-1) - 1
        ids = np.delete(ids, fences)
        for i in own:
            at, found = int(counts[:i].sum()), self.tokenizer.encode(words[i], add_special_tokens=False).ids
            ids, counts[i] = np.concatenate([ids[:at], np.array(found, np.uint32), ids[at:]]), len(found)
        return ids, counts

    def _find(self, words: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word among the known ones, and whether it is there: equal hashes count only for equal words."""
        if not len(self.keys):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[place] == keys
        same = pc.equal(self.words.take(pa.array(place)), words).to_numpy(zero_copy_only=False)
        return place, found & same

    def _remember(self, words: pa.Array, keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, store: np.ndarray) -> None:
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.words = pa.concat_arrays([self.words, words]).take(pa.array(order))
        self.keys = keys[order]
        self.starts, self.sizes = np.concatenate([self.starts, starts])[order], np.concatenate([self.sizes, sizes])[order]
        self.ids = store[: int(starts[-1] + sizes[-1])].copy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of all texts in order, and the number of ids of each text."""
        words, counts = split_words(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        keys = byte_hash(distinct)
        place, found = self._find(distinct, keys)
        starts, sizes, store = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64), self.ids
        starts[found], sizes[found] = self.starts[place[found]], self.sizes[place[found]]
        missing = np.nonzero(~found)[0]
        if len(missing):
            new = distinct.take(pa.array(missing))
            parts = [self._encode(new[i : i + 20_000].to_pylist()) for i in range(0, len(new), 20_000)]
            ids, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            at = np.cumsum(n) - n
            starts[missing], sizes[missing] = len(store) + at, n
            store = np.concatenate([store, ids])
            keep = min(len(new), self.limit - len(self.keys))
            if keep > 0:
                self._remember(new[:keep], keys[missing[:keep]], starts[missing[:keep]], n[:keep], store)
        code = coded.indices.to_numpy()
        word_sizes = sizes[code]
        ids = store[ragged(starts[code], word_sizes)]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(word_sizes)])
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
        return ids, np.diff(ends[bounds])


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process: its words serve all tasks that run here."""
    return WordEncoder(path)
