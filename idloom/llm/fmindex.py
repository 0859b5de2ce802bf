"""An FM-index over the words of one shard of texts.

Words outside the vocabulary, and the ends of texts, are separators: each is a
symbol of its own for sorting, so no suffix compares beyond one, and all are 0
in the transform.  Rows with a separator before them are always sampled, since
the backward step is only defined for words of the vocabulary.
"""

from __future__ import annotations

import numpy as np



class WaveletMatrix:
    """rank and access over a sequence of small integers, one bit vector a level."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.n = levels, len(seq)
        self.words, self.ranks, self.zeros = [], [], []
        cur = seq
        for level in range(levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            padded = np.zeros(self.n + 64 - self.n % 64, bool)
            padded[: self.n] = bit
            w = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(w)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w), dtype=np.int64)]))
            self.zeros.append(self.n - int(self.ranks[-1][-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[k][i >> 6] + np.bitwise_count(self.words[k][i >> 6] & low)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands before i, for arrays of both."""
        lo, hi = np.zeros_like(i), i
        for k in range(self.levels):
            one = (c >> (self.levels - 1 - k)) & 1 == 1
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i and how often it stands before i."""
        c, lo, at = np.zeros_like(i), np.zeros_like(i), i
        for k in range(self.levels):
            one = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            c = (c << 1) | one
            a, b = self._ones(k, lo), self._ones(k, at)
            lo, at = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, at - b)
        return c, at - lo


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Order of all suffixes; ``sym`` is 0 at separators and at the last place."""
    n = len(sym)
    gap = sym == 0
    # as many words as 63 bits hold are compared at once
    bits = max(1, int(sym.max(initial=1)).bit_length())
    pack = min(n, 3, 63 // bits)
    ahead = np.concatenate([sym, np.zeros(pack, sym.dtype)]).astype(np.int64)
    key, cut = np.zeros(n, np.int64), gap.copy()
    for k in range(pack):
        part = np.where(cut, 0, ahead[k : k + n])
        cut |= part == 0
        key = (key << bits) | part
    order = np.argsort(key, kind="stable")
    ks, open_ = key[order], ~cut[order]
    # a suffix cut by a separator is settled: equal ones follow by place
    new = np.ones(n, bool)
    new[1:] = (ks[1:] != ks[:-1]) | ~open_[1:]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    width = pack
    tied = np.zeros(n, bool)
    tied[1:] |= ~new[1:]
    tied[:-1] |= ~new[1:]
    at = np.flatnonzero(tied)
    while len(at):
        pos = order[at]
        group, nxt = rank[pos], rank[pos + width]
        sub = np.lexsort((nxt, group))
        pos, group, nxt = pos[sub], group[sub], nxt[sub]
        order[at] = pos
        first = np.ones(len(at), bool)
        first[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        rank[pos] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        keep = np.zeros(len(at), bool)
        keep[1:] |= ~first[1:]
        keep[:-1] |= ~first[1:]
        at = at[keep]
        width *= 2
    return order


class FMIndex:
    def __init__(self, sym: np.ndarray, symbols: int, sample: int = 8):
        """``sym``: ids 1..symbols of the words in order, 0 at separators and last."""
        sa = suffix_array(sym)
        before = np.where(sa > 0, sym[sa - 1], 0).astype(np.int64)
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=symbols + 1))]).astype(np.int64)
        self.wavelet = WaveletMatrix(before, max(1, int(symbols).bit_length()))
        keep = (sa % sample == 0) | (before == 0)
        padded = np.zeros(len(sa) + 64 - len(sa) % 64, bool)
        padded[: len(sa)] = keep
        self.sampled = np.packbits(padded, bitorder="little").view(np.uint64)
        self.sample_rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.sampled), dtype=np.int64)])
        self.samples = sa[keep].astype(np.int32)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases (one a row, padded with 0 on the right)."""
        rows = np.arange(len(phrases))
        last = phrases[rows, lengths - 1]
        lo, hi = self.counts[last].copy(), self.counts[last + 1].copy()
        for back in range(2, phrases.shape[1] + 1):
            go = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(go):
                break
            c = phrases[go, lengths[go] - back].astype(np.int64)
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[go], hi[go]])) + self.counts[np.concatenate([c, c])]
            lo[go], hi[go] = both[: len(go)], both[len(go) :]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of suffix rows: step back to the nearest sampled one."""
        out, steps = np.zeros(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            hit = (self.sampled[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            a = at[hit]
            low = (np.uint64(1) << (a & 63).astype(np.uint64)) - np.uint64(1)
            out[left[hit]] = self.samples[self.sample_rank[a >> 6] + np.bitwise_count(self.sampled[a >> 6] & low)] + steps
            left, at = left[~hit], at[~hit]
            if len(left):
                c, r = self.wavelet.access_rank(at)
                at = self.counts[c] + r
            steps += 1
        return out
