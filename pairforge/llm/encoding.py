"""Tokenising with a public vocabulary, each distinct piece of text once.

A text is cut where no token can span: before a single blank, or around a single line feed, that stands between two
characters known not to be white space, and between a letter and a punctuation mark.  Both supported pre-tokenisers start
anew there, so the ids of the pieces, joined, are those of the text.  Texts of added tokens (<|endoftext|>) are single ids, as
in the library: they are pieces of their own, and what stands between them is cut as texts are.  Pieces are hashed for a whole block at once; only those that this worker has not met
are given to the tokenizers library.  A met piece is known by 128 bits of two hashes with seeds that each worker draws; one that shares only the first with another is
encoded on its own.  The memory of met pieces is bounded and dropped when full.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from pairforge.llm.common import LOWER, byte_hash, ragged

MOST_PIECES, MOST_IDS, AT_ONCE = 1_200_000, 6_000_000, 4096
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, skip_blanks: bool) -> "Encoder":
    """The worker's encoder for a tokenizers file; skip_blanks: the vocabulary drops white space."""
    if (path, skip_blanks) not in _ENCODERS:
        _ENCODERS[path, skip_blanks] = Encoder(path, skip_blanks)
    return _ENCODERS[path, skip_blanks]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MARK = np.zeros(256, bool)
MARK[33:127] = True
MARK[48:58] = MARK[65:91] = MARK[97:123] = False


def cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of pieces, each text's start included."""
    n = len(buf)
    plain = np.zeros(n + 2, bool)
    plain[1 : n + 1] = (buf > 32) & (buf < 127)
    lead = np.zeros(n + 3, bool)
    lead[2 : n + 2] = (buf >= 0xC3) & (buf <= 0xDF)
    before = plain[:n] | lead[:n]
    after = plain[2 : n + 2] | lead[3 : n + 3]
    edge = offs[(offs < n)]
    before[edge] = False
    if n > 1:
        before[edge[edge < n - 1] + 1] &= plain[edge[edge < n - 1] + 1]
    last = offs[1:][offs[1:] > 0] - 1
    after[last] = False
    between = before & after
    starts = (buf == 32) & between
    feeds = (buf == 10) & between
    starts |= feeds
    starts[1:] |= feeds[:-1]
    if n > 1:
        letter, mark = LETTER[buf], MARK[buf]
        ends = letter[:-1].copy()  # a letter ends here: also one of two bytes led by C3, but for the signs x and /
        ends[1:] |= (buf[:-2] == 0xC3) & (buf[1:-1] != 0x97) & (buf[1:-1] != 0xB7)
        starts[1:] |= ends & mark[1:]
        starts[1:] |= mark[:-1] & (buf[:-1] != 39) & letter[1:]
    starts[edge] = True
    return np.flatnonzero(starts)


class Encoder:
    def __init__(self, path: str, skip_blanks: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError("added tokens are supported only where they match as they stand")
        literals = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, literals))) if literals else None
        self.skip_blanks = skip_blanks
        self.seeds = tuple(int.from_bytes(os.urandom(7), "little") for _ in range(2))
        self.clear()

    def clear(self) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []  # first hash, second hash, start and size in the pool
        self.pool, self.used, self.met = np.zeros(1 << 16, np.uint32), 0, 0

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, size, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for known, second, s, n in self.levels:
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = (known[at] == keys) & (second[at] == checks)
            start[hit], size[hit] = s[at[hit]], n[at[hit]]
            found |= hit
        return start, size, found

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and size in the pool of each text's ids."""
        ids = [e.ids for k in range(0, len(texts), AT_ONCE) for e in self.tokenizer.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(flat), self.used), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(size) - size
        self.used += len(flat)
        return start, size

    def _learn(self, keys: np.ndarray, checks: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        places = self._encode(texts)
        self.levels.append((keys, checks, *places))
        self.met += len(keys)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 3 * len(self.levels[-1][0]):
            merged = [np.concatenate(x) for x in zip(self.levels[-2], self.levels[-1], strict=True)]
            order = np.argsort(merged[0], kind="stable")
            self.levels[-2:] = [tuple(x[order] for x in merged)]
        return places

    def _added(self, raw: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the added tokens in the texts; matches are sought text by text."""
        found: list[tuple[int, int]] = []
        if self.added and (first := self.added.search(raw)):
            at = max(0, int(np.searchsorted(offs, first.start(), "right")) - 1)
            for lo, hi in zip(offs[at:-1].tolist(), offs[at + 1 :].tolist(), strict=True):
                found += [m.span() for m in self.added.finditer(raw, lo, hi)]
        spans = np.array(found, np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    def block(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and the texts' offsets among them."""
        raw = buf.tobytes()
        begin, end = self._added(raw, offs)
        starts = cuts(buf, np.unique(np.concatenate([offs, begin, end])) if len(begin) else offs)
        if len(begin):
            at = np.searchsorted(begin, starts, "right") - 1
            starts = starts[(at < 0) | (starts == begin[at]) | (starts >= end[at])]
        ends = np.append(starts[1:], len(buf))
        whole = np.searchsorted(starts, begin)
        if self.skip_blanks and len(starts):
            starts = starts + (buf[np.minimum(starts, max(len(buf) - 1, 0))] == 32)
        if self.met > MOST_PIECES or self.used > MOST_IDS:
            self.clear()
        low = LOWER[buf] if self.skip_blanks else buf
        hashes, checks = (byte_hash(low, starts, ends, seed) for seed in self.seeds)
        hashes[whole] ^= np.uint64(1)  # lower case may be that of other text
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        text_of = lambda at: [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        start, size, known = self._find(keys, checks[first])
        new = first[~known]
        if len(new):
            start[~known], size[~known] = self._learn(keys[~known], checks[new], text_of(new))
        start, size = start[back], size[back]
        odd = np.flatnonzero(checks != checks[first][back])
        if len(odd):
            start[odd], size[odd] = self._encode(text_of(odd))
        ids = self.pool[ragged(start, size)]
        piece_ends = np.concatenate([[0], np.cumsum(size)])
        return ids, piece_ends[np.searchsorted(starts, offs)] if len(starts) else np.zeros(len(offs), np.int64)
