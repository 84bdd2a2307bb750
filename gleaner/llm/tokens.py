"""Exact tokenizing of Arrow string batches with a byte-level BPE of the tokenizers library.

Such a tokenizer first cuts a text before spaces that follow a non-space, whatever comes next, so a text's ids
are the ids of its space-led words, one after another. Each word is encoded once for each worker and looked
up afterwards, whole batches at a time; texts in which white space precedes a space, or which hold one of the tokenizer's
added (special) tokens, are encoded whole, as the cut does not hold there.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WS = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNSAFE = _WS + " "
_EDGE = f"^{_WS}|{_WS}$|^$"
PIECE_BYTES = 4 << 20
WORDS_AT_ONCE = 32  # the library takes longer for a word of a long text


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordTokenizer:
    """max_words bounds the words that are remembered, at about 100 bytes each, and as much again while they are looked up; beyond
    it memory starts anew."""

    def __init__(self, path: str, max_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.max_words = max_words
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.n_bytes = np.zeros(size, np.int64)
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.n_bytes[i] = len(token)  # one character a byte
        self._clear()

    def _clear(self) -> None:
        self.words = pa.array([], pa.string())
        self.start, self.count, self.flat = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of ids of each word, and all ids. Words begin with a space and end in none."""
        n = len(words)
        blocks = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, n, WORDS_AT_ONCE), n), pa.int32()), words)
        ids = self._whole(pc.binary_join(blocks, "").to_pylist())
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = np.searchsorted(np.cumsum(self.n_bytes[np.concatenate(ids)]), ends) + 1
        return np.diff(at, prepend=0), ids

    def _learn(self, words: pa.Array) -> None:
        """Words that don't begin with a space, and those with more white space at an end, are encoded one by one."""
        odd = pc.or_(pc.invert(pc.starts_with(words, " ")), pc.match_substring_regex(pc.utf8_slice_codeunits(words, 1), _EDGE))
        plain, rest = words.filter(pc.invert(odd)), words.filter(odd)
        count, ids = self._ids(plain) if len(plain) else (np.zeros(0, np.int64), [])
        more = self._whole(rest.to_pylist())
        count = np.concatenate([count, np.array([len(x) for x in more], np.int64)])
        self.start = np.concatenate([self.start, (len(self.flat) + np.cumsum(count) - count).astype(np.int32)])
        self.count = np.concatenate([self.count, count.astype(np.int32)])
        self.flat = np.concatenate([self.flat, *ids, *more])
        self.words = pa.concat_arrays([self.words, plain, rest])

    def _slots(self, words: pa.Array) -> np.ndarray:
        """Where the (distinct) words are remembered; new ones are learnt."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            first = len(self.words)
            self._learn(words.filter(pc.is_null(at)))
            new = self.words.slice(first)
            at = pc.coalesce(at, pc.add(pc.index_in(words, value_set=new), pa.scalar(first, pa.int32())))
        return at.to_numpy(zero_copy_only=False)

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.max_words:
            self._clear()
        cut = pc.split_pattern(texts, " ")
        offsets, words = cut.offsets.to_numpy(), cut.flatten()
        first = offsets[:-1] - offsets[0]
        coded = words.dictionary_encode()
        heads = words.take(pa.array(first)).dictionary_encode()
        led = pc.binary_join_element_wise(" ", coded.dictionary, "")
        # a text's first word has no space before it
        slots = self._slots(pa.concat_arrays([led, heads.dictionary]))  # no head begins with a space, so all differ
        heads = slots[len(led) + heads.indices.to_numpy()]
        slots = slots[coded.indices.to_numpy()]
        slots[first] = heads
        count = self.count[slots]
        total = np.cumsum(count, dtype=np.int32)  # a batch has far fewer ids than 2 ** 31
        at = np.arange(total[-1], dtype=np.int32) + np.repeat(self.start[slots] - (total - count), count)
        return self.flat[at], np.add.reduceat(count.astype(np.int64), first)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and each text's number of ids. Nulls count as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        unsafe = pc.match_substring_regex(texts, _UNSAFE)
        for token in self.added:
            unsafe = pc.or_(unsafe, pc.match_substring(texts, token))
        if not pc.any(unsafe).as_py():
            return self._by_words(texts)
        where = unsafe.to_numpy(zero_copy_only=False)
        parts: list = [None] * len(texts)
        for i, ids in zip(np.flatnonzero(where), self._whole(texts.filter(unsafe).to_pylist())):
            parts[i] = ids
        if not where.all():
            flat, n = self._by_words(texts.filter(pc.invert(unsafe)))
            for i, ids in zip(np.flatnonzero(~where), np.split(flat, np.cumsum(n)[:-1])):
                parts[i] = ids
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, so that words are remembered from task to task."""
    return WordTokenizer(path)


def pieces_of(batch: pa.RecordBatch, text: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text, never cutting a row."""
    if not batch.num_rows:
        return
    n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(n, dtype=np.int64) - n) // limit
    cut = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for i, j in zip(cut, cut[1:]):
        yield batch.slice(i, j - i)
    pa.default_memory_pool().release_unused()  # workers live on from task to task
