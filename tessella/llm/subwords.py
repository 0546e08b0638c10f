"""Subword ids of a public tokenizer for many documents at once.

Equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``. The vocabulary drops white space and
ends every piece of its pre-tokenizer with a token marked ``</w>``, so each piece can be encoded once and
looked up afterwards. Texts are cut at white space, and further into runs of letters, single digits and
runs of punctuation where the bytes are ASCII or Latin-1 letters; whatever could behave otherwise there
(apostrophes, ``<``, control characters, all other code points) stays one uncut chunk.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from tessella.llm.textblock import LOWER, SPACE, U64, blocks, span_hashes

LETTER, MARK, DIGIT = 1, 2, 3
KIND = np.full(256, MARK, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KIND[48:58] = DIGIT
KIND[SPACE] = 0
WHOLE = np.zeros(256, bool)
WHOLE[[39, 60, 127, 0xC2, *range(0xC4, 256), *(b for b in range(32) if not SPACE[b])]] = True
CACHED_IDS = 1 << 22
SLOT_BITS = 18
JOINED = 256


class SubwordEncoder:
    """Encodes Arrow strings; remembers the pieces it has met, up to a fixed number of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.vocabulary_size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.vocabulary_size, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, U64)
        self.begin = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        # the last piece met of each slot of hashes: most are found there without a search
        self.slot_key = np.zeros(1 << SLOT_BITS, U64)
        self.slot_begin, self.slot_length = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << SLOT_BITS, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in row order, and for each row the number of ids before it (one more at the end)."""
        ids, counts = [], []
        for block in blocks(texts):
            got, offsets = self._block(block.data, block.offsets)
            ids.append(got)
            counts.append(np.diff(offsets))
        counts = np.concatenate([np.zeros(1, np.int64), *counts])
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.cumsum(counts)

    def _block(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        kind = KIND[data]
        full = kind > 0
        chunk = full.copy()
        chunk[1:] &= ~full[:-1]
        edges = rows[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        chunk[edges] = full[edges]
        whole = WHOLE[data]
        times = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        whole[:-1] |= times
        number = np.cumsum(chunk) - 1
        held = np.zeros(int(number[-1]) + 1, bool)
        held[number[whole & full]] = True
        uncut = held[np.maximum(number, 0)] & full if len(held) else np.zeros(n, bool)
        cut = np.zeros(n, bool)
        cut[1:] = full[1:] & full[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) & ~uncut[1:]
        first = chunk | cut
        begin = np.flatnonzero(first)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        last = full.copy()
        last[:-1] &= ~full[1:] | first[1:]
        end = np.flatnonzero(last) + 1
        data, mark = self._canonical(data, uncut, chunk, begin)
        hashes = span_hashes(data, begin, end) ^ mark
        if len(self.pool) > CACHED_IDS:
            self._forget()
        slot = (hashes >> U64(64 - SLOT_BITS)).astype(np.int64)
        start, length = np.take(self.slot_begin, slot), np.take(self.slot_length, slot)
        other = np.flatnonzero(np.take(self.slot_key, slot) != hashes)
        if len(other):
            met, one, which = np.unique(hashes[other], return_index=True, return_inverse=True)
            one = other[one]
            at = self._find(met, data, begin[one], end[one], mark[one])
            start[other], length[other] = self.begin[at][which], self.length[at][which]
            self.slot_key[slot[one]], self.slot_begin[slot[one]], self.slot_length[slot[one]] = met, self.begin[at], self.length[at]
        before = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=before[1:])
        ids = self.pool[np.repeat(start - before[:-1], length) + np.arange(before[-1])]
        return ids, before[np.searchsorted(begin, rows)]

    def _canonical(self, data, uncut, chunk, begin) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that decide a piece's ids, and for each piece what else decides them."""
        return np.where(uncut, data, LOWER[data]), uncut[begin].astype(U64)

    def _find(self, met, data, begin, end, mark) -> np.ndarray:
        """Places of the hashes ``met`` among the keys, after encoding those not met before."""
        at = np.searchsorted(self.keys, met)
        known = np.zeros(len(met), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == met[inside]
        if known.all():
            return at
        new = np.flatnonzero(~known)
        order, ids, lengths = self._encode(data.tobytes(), begin[new], end[new], mark[new])
        order = new[order]
        length = np.concatenate(lengths).astype(np.int64)
        start = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, *ids]).astype(np.uint32)
        turn = np.argsort(order)  # met is sorted
        spot = at[order[turn]]
        self.keys = np.insert(self.keys, spot, met[order[turn]])
        self.begin = np.insert(self.begin, spot, start[turn])
        self.length = np.insert(self.length, spot, length[turn])
        return np.searchsorted(self.keys, met)

    def _encode(self, raw: bytes, begin, end, mark) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """In the order returned: all pieces' ids, and how many each has."""
        plain = np.flatnonzero(mark == 0)
        groups = np.split(plain, range(JOINED, len(plain), JOINED)) if len(plain) else []
        order, ids, lengths, alone = [], [], [], [np.flatnonzero(mark)]
        texts = [b" ".join([raw[i:j] for i, j in zip(begin[g], end[g], strict=True)]).decode("utf-8", "replace") for g in groups]
        for g, got in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            found = np.array(got.ids, np.uint32)
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) == len(g) and ends[-1] == len(found):  # one marked end for each piece
                order.append(g)
                ids.append(found)
                lengths.append(np.diff(ends, prepend=0))
            else:
                alone.append(g)
        order += alone
        alone = np.concatenate(alone)
        texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(begin[alone], end[alone], strict=True)]
        for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids.append(np.array(got.ids, np.uint32))
            lengths.append(np.array([len(got.ids)]))
        return np.concatenate(order), ids, lengths


class WordEncoder(SubwordEncoder):
    """Ids of a byte-level vocabulary, word by word, A-Z lowered: different sequences of words have different ids.

    A piece that begins a word is encoded with a space before it, any other by itself.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.starts = np.zeros(self.vocabulary_size, bool)
        self.starts[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True

    def _canonical(self, data, uncut, chunk, begin) -> tuple[np.ndarray, np.ndarray]:
        return LOWER[data], chunk[begin].astype(U64)

    def _encode(self, raw: bytes, begin, end, mark) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        odd = np.concatenate([np.zeros(1, np.int64), np.cumsum(WHOLE[np.frombuffer(raw, np.uint8)])])
        plain = (mark > 0) & (odd[end] == odd[begin])
        text = lambda i: " " * int(mark[i]) + raw[begin[i] : end[i]].decode("utf-8", "replace")
        groups = np.split(np.flatnonzero(plain), range(JOINED, int(plain.sum()), JOINED)) if plain.any() else []
        order, ids, lengths, alone = [], [], [], [np.flatnonzero(~plain)]
        for g, got in zip(groups, self.tokenizer.encode_batch_fast(["".join(map(text, g)) for g in groups], add_special_tokens=False), strict=True):
            found = np.array(got.ids, np.uint32)
            at = np.flatnonzero(self.starts[found])
            if len(at) == len(g) and at[0] == 0:  # one id with a space for each piece
                order.append(g)
                ids.append(found)
                lengths.append(np.diff(at, append=len(found)))
            else:
                alone.append(g)
        order.append(np.concatenate(alone))
        for got in self.tokenizer.encode_batch_fast([text(i) for i in order[-1]], add_special_tokens=False):
            ids.append(np.array(got.ids, np.uint32))
            lengths.append(np.array([len(got.ids)]))
        return np.concatenate(order), ids, lengths


_encoders: dict[tuple[str, type], SubwordEncoder] = {}


def encoder(path: str, kind: type = SubwordEncoder) -> SubwordEncoder:
    """One encoder for each path, kind and Python worker."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = kind(path)
    return _encoders[path, kind]
