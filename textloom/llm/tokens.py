"""Token ids by a public byte-pair vocabulary, a batch of texts at a time.

Splitting into pieces runs on arrays of code points, and each distinct piece is encoded once: equal pieces take the
ids of the first. The result equals that of the vocabulary's own encoder on every text.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken

from .common import LETTER, OTHER, SPACE, SLICE_CHARS, classes, span_hashes

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
#: Pieces longer than this many code points are encoded one by one, by the encoder itself.
LONG_PIECE = 40
CACHE_PIECES = 300_000


class Tokenizer:
    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = array("I")  # lists of numbers would take nine times as much
        self.begin = array("q", [0])
        self._array = np.zeros(0, np.uint32)

    def decode(self, ids) -> bytes:
        return self.encoder.decode_bytes(list(map(int, ids)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint16, or uint32 for a large vocabulary), and the texts' starts."""
        parts, counts = [], []
        at, chars, group = 0, 0, []
        for i, t in enumerate(texts):
            if len(t) > SLICE_CHARS:
                parts, counts, group, chars = self._flush(group, parts, counts), counts, [], 0
                ids, n = self._long(t)
                parts.append(ids)
                counts.append(np.array([n]))
                continue
            group.append(t)
            chars += len(t)
            if chars > SLICE_CHARS:
                parts, group, chars = self._flush(group, parts, counts), [], 0
        parts = self._flush(group, parts, counts)
        starts = np.zeros(len(texts) + 1, np.int64)
        if counts:
            np.cumsum(np.concatenate(counts), out=starts[1:])
        kind = np.uint16 if self.encoder.n_vocab <= 65536 else np.uint32
        return (np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)), starts

    def _flush(self, group: list[str], parts: list, counts: list) -> list:
        if group:
            ids, n = self._encode(group)
            parts.append(ids)
            counts.append(n)
        return parts

    def _long(self, text: str) -> tuple[np.ndarray, int]:
        """A long text in parts, cut where white space follows something else: a piece always begins there."""
        table, out, at = classes(), [], 0
        while at < len(text):
            to = min(len(text), at + SLICE_CHARS)
            while to < len(text):
                window = text[to - 1 : to + 4096]
                kinds = table[np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32)]
                cut = np.flatnonzero((kinds[1:] == SPACE) & (kinds[:-1] != SPACE))
                if len(cut):
                    to += int(cut[0])
                    break
                to = min(len(text), to + 4096)
            out.append(self._encode([text[at:to]])[0])
            at = to
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), sum(map(len, out))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        n = len(joined)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = classes()[cp]
        first = np.zeros(n + 1, bool)  # where a text begins, and the end
        first[bounds] = True
        start = np.ones(n, bool)
        space = kind == SPACE
        start[1:] = (kind[1:] != kind[:-1]) & (space[1:] | (cp[:-1] != 32))
        start[:-1] |= space[:-1] & ~space[1:] & ~first[1:-1]
        start |= first[:-1]
        quote = np.flatnonzero((cp == 39) & (kind == OTHER))
        if len(quote):
            self._contractions(quote, cp, kind, first, start)
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], n)
        hashes = span_hashes(cp, begin, end)
        codes, unique = pd.factorize(hashes)
        where = np.empty(len(unique), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        if len(self.known) > CACHE_PIECES:
            self.clear()
        slot = np.empty(len(unique), np.int64)
        piece_of = self.encoder._encode_single_piece
        for k, (h, w) in enumerate(zip(unique.tolist(), where.tolist())):
            at = self.known.get(h)
            if at is None:
                at = self.known[h] = len(self.begin) - 1
                self.ids.extend(piece_of(joined[begin[w] : end[w]]))
                self.begin.append(len(self.ids))
            slot[k] = at
        ids, begins = self._flat(), np.array(self.begin, np.int64)
        from_, to_ = begins[slot], begins[slot + 1]
        base, size = from_[codes], (to_ - from_)[codes]
        long = np.flatnonzero(end - begin > LONG_PIECE)
        extra: dict[int, list[int]] = {}
        for p in long.tolist():  # equal hashes are no proof for a long piece
            extra[p] = piece_of(joined[begin[p] : end[p]])
            size[p] = len(extra[p])
        out_at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=out_at[1:])
        if extra:
            short = size.copy()
            base = base.copy()
            pool = np.concatenate([ids, *(np.asarray(x, np.uint32) for x in extra.values())])
            at = len(ids)
            for p, x in extra.items():
                base[p], at = at, at + len(x)
            ids, size = pool, short
        out = ids[np.repeat(base - out_at[:-1], size) + np.arange(out_at[-1])]
        per_text = out_at[np.searchsorted(begin, bounds)]
        return out, np.diff(per_text)

    def _flat(self) -> np.ndarray:
        if len(self._array) < len(self.ids):
            self._array = np.concatenate([self._array, np.array(self.ids[len(self._array) :], np.uint32)])
        return self._array

    @staticmethod
    def _contractions(quote, cp, kind, first, start) -> None:
        n = len(cp)
        for q in quote.tolist():
            if not start[q] or q + 1 >= n or first[q + 1] or kind[q + 1] != LETTER:
                continue
            a = chr(cp[q + 1])
            b = chr(cp[q + 2]) if q + 2 < n and not first[q + 2] else ""
            k = 1 if a in "stmd" else 2 if a + b in ("re", "ve", "ll") else 0
            if k:
                start[q + 1] = False
                if k == 2:
                    start[q + 2] = False
                if q + 1 + k < n and kind[q + 1 + k] == LETTER:
                    start[q + 1 + k] = True


@lru_cache(4)
def tokenizer(vocabulary: str = VOCABULARY) -> Tokenizer:
    return Tokenizer(vocabulary)
