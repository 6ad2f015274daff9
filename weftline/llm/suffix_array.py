"""Suffix arrays by induced sorting, and permuted common prefixes, on whole NumPy arrays.

Suffixes are classified as smaller (S) or larger (L) than their successor. The leftmost S ones (LMS) are sorted; from
them the L suffixes are induced in one scan over the buckets upwards, and the S suffixes in one downwards. A scan
handles a bucket's suffixes at once: what they induce goes to other buckets by a stable counting sort, and what falls into
the bucket itself (runs of one symbol) in further waves. To sort the LMS suffixes, LMS substrings are sorted by the same
two scans and named, and the string of names is sorted in the same way, level after level, until all names differ or the
string is short. Names beyond SCAN_SYMBOLS are written as two digits, which keeps their order and the scans' buckets few.
Short strings of many names are sorted by doubling of ranks: scans over thousands of near-empty buckets gain nothing there.

Substrings and prefixes are compared by their symbols, eight bytes at a time, never by hashes.
"""

from __future__ import annotations

import numpy as np

from weftline.llm.arrays import U64

#: Largest alphabet for scans over buckets; the longest string that is sorted by doubling if its alphabet is larger, and the
#: level from which any such string is.
SCAN_SYMBOLS, SHORT, LEVELS = 512, 1 << 18, 8


def _smaller(s: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S. The last symbol is a unique least one."""
    n = len(s)
    d = np.sign(np.diff(s.astype(np.int64)))
    known = np.where(d != 0, np.arange(n - 1), n)
    after = np.minimum.accumulate(known[::-1])[::-1]  # the next place where symbols differ
    out = np.ones(n, bool)
    out[:-1] = d[np.minimum(after, n - 2)] > 0 if n > 1 else True
    return out


def _place(sa: np.ndarray, pointer: np.ndarray, symbol: np.ndarray, suffix: np.ndarray, up: bool) -> None:
    """Append suffixes (in order) to their symbols' buckets, at the front going up or at the back going down."""
    size = np.bincount(symbol, minlength=len(pointer))
    before = np.cumsum(size) - size
    within = np.arange(len(symbol))
    if up:
        sa[within + np.repeat(pointer - before, size)] = suffix[symbol.argsort(kind="stable")]
        pointer += size
    else:
        sa[np.repeat(pointer + before, size) - within] = suffix[symbol.argsort(kind="stable")]
        pointer -= size


def _induce(s: np.ndarray, small: np.ndarray, heads: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, induced from LMS suffixes in the order given (by bucket; right within buckets if they are sorted)."""
    n, kinds = len(s), len(heads) - 1
    sa = np.full(n, -1, np.int32)
    lms_by = np.argsort(s[lms], kind="stable")
    lms = lms[lms_by]
    lms_cut = np.searchsorted(s[lms], np.arange(kinds + 1))
    front = heads[:-1].copy()
    for c in range(kinds):  # upwards: L suffixes
        done = heads[c]
        while True:
            to = front[c]
            wave = sa[done:to]
            extra = lms[lms_cut[c] : lms_cut[c + 1]] if not len(wave) else wave[:0]
            if not len(wave):
                before = extra[extra > 0] - 1
                before = before[~small[before]]
                if len(before):
                    _place(sa, front, s[before], before, True)
                break
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            done = to
            if len(before):
                _place(sa, front, s[before], before, True)
    back = heads[1:].copy() - 1
    for c in range(kinds - 1, -1, -1):  # downwards: S suffixes
        if c == 0:
            sa[0] = n - 1
            break
        done = heads[c + 1] - 1
        while True:
            to = back[c]
            wave = sa[to + 1 : done + 1][::-1]
            if not len(wave):
                wave = sa[heads[c] : front[c]][::-1]  # the bucket's L suffixes come last
                before = wave[wave > 0] - 1
                before = before[small[before]]
                if len(before):
                    _place(sa, back, s[before], before, False)
                break
            before = wave[wave > 0] - 1
            before = before[small[before]]
            done = to
            if len(before):
                _place(sa, back, s[before], before, False)
    return sa


def double_ranks(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes sorted by their first symbols, depth of them at least, by doubling of ranks; all of them without depth."""
    n = len(s)
    rank = (np.cumsum(np.bincount(s) > 0) - 1)[s]
    order = np.argsort(rank, kind="stable")
    k, depth = 1, n if depth is None else depth
    while k < depth:
        follow = np.zeros(n, np.int64)
        follow[: max(n - k, 0)] = rank[k:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key)
        held = key[order]
        new = np.concatenate(([False], held[1:] != held[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        k *= 2
        if rank[order[-1]] == n - 1:
            break
    return order


def _digits(s: np.ndarray, kinds: int) -> tuple[np.ndarray, int]:
    """Symbols as two digits each, the more significant first, and the closing 0: suffixes that begin at symbols keep their order."""
    base = int(np.ceil(np.sqrt(kinds)))
    out = np.zeros(2 * len(s) + 1, np.uint16)
    out[0:-1:2], out[1:-1:2] = s // base + 1, s % base + 1
    return out, 2


def suffix_array(s: np.ndarray, level: int = 0) -> np.ndarray:
    """Suffixes of s in ascending order; s holds small non-negative integers, its last a unique least one."""
    n = len(s)
    if n < 3:
        return np.arange(n)[::-1].astype(np.int32)
    used = np.bincount(s) > 0
    kinds = int(used.sum())
    s = (np.cumsum(used) - 1)[s]
    if kinds > SCAN_SYMBOLS and (n <= SHORT or level >= LEVELS):
        return double_ranks(s).astype(np.int32)
    if kinds > SCAN_SYMBOLS:
        digits, width = _digits(s, kinds)
        sa = suffix_array(digits, level + 1)
        return sa[(sa % width == 0) & (sa < n * width)] // width
    s = s.astype(np.uint8 if kinds <= 256 else np.uint16)  # stable sorts by such symbols are radix sorts
    small = _smaller(s)
    heads = np.concatenate(([0], np.cumsum(np.bincount(s))))
    is_lms = small.copy()
    is_lms[1:] &= ~small[:-1]
    is_lms[0] = False
    lms = np.flatnonzero(is_lms)
    sa = _induce(s, small, heads, lms.astype(np.int32))
    ordered = sa[is_lms[sa]]
    # Names of the LMS substrings: equal ones are neighbours now.
    size = np.zeros(n, np.int32)
    size[lms] = np.append(lms[1:], n - 1) + 1 - lms
    a, b = ordered[:-1], ordered[1:]
    new = size[a] != size[b]
    like = np.flatnonzero(~new)
    new[like[Prefixes(s).shared(a[like], b[like], size[a[like]]) < size[a[like]]]] = True
    if new.all():
        return _induce(s, small, heads, ordered)
    name = np.empty(n, np.int64)
    name[ordered] = np.concatenate(([0], np.cumsum(new)))
    # The last LMS suffix is the closing symbol, unique and least.
    return _induce(s, small, heads, lms[suffix_array(name[lms], level + 1)].astype(np.int32))


class Prefixes:
    """Common prefixes of suffixes of s, which holds 8- or 16-bit symbols."""

    def __init__(self, s: np.ndarray) -> None:
        self.step = 8 // s.dtype.itemsize
        raw = np.concatenate((s, np.zeros(self.step, s.dtype)))
        self.words = np.ascontiguousarray(np.ndarray(len(s) + 1, "<u8", raw, strides=(s.dtype.itemsize,)))
        self.shift = U64(3 if self.step == 8 else 4)

    def shared(self, a: np.ndarray, b: np.ndarray, limit: int | np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share, limit at most."""
        most = np.broadcast_to(np.asarray(limit, np.int64), len(a))
        end = len(self.words) - 1
        out = np.zeros(len(a), np.int64)
        go, done = np.arange(len(a)), 0
        while len(go):
            differ = self.words[np.minimum(a[go] + done, end)] ^ self.words[np.minimum(b[go] + done, end)]
            same = differ == 0
            stop = ~same
            low = differ[stop]
            out[go[stop]] = done + (np.bitwise_count((low & (~low + U64(1))) - U64(1)).astype(np.uint64) >> self.shift).astype(np.int64)
            go, done = go[same], done + self.step
            over = most[go] <= done
            out[go[over]] = done
            go = go[~over]
        return np.minimum(out, np.minimum(most, end - np.maximum(a, b)))


def permuted_lcp(s: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each suffix, by position: the symbols it shares with its predecessor in sa, limit at most. s holds 8- or 16-bit
    symbols. Where the symbols before both are equal too, the value is the previous position's less one."""
    n = len(s)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    at = np.arange(n)
    own = (phi < 1) | (at < 1)
    own[~own] = s[at[~own] - 1] != s[phi[~own] - 1]
    # A predecessor's predecessor need not be the pair's own; the shortcut holds where both step back together.
    own[1:] |= phi[1:] - 1 != phi[:-1]
    hard = np.flatnonzero(own & (phi >= 0))
    prefixes = Prefixes(s)
    out = np.zeros(n, np.int64)
    out[hard] = prefixes.shared(hard, phi[hard], limit)
    # Runs that step back together lose one symbol a step, unless the value had reached the limit: those are measured anew.
    soft = np.flatnonzero(~own)
    if len(soft):
        lead = np.maximum.accumulate(np.where(own, at, 0))[soft]
        cut = out[lead] >= limit
        out[soft] = np.maximum(out[lead] - (soft - lead), 0)
        again = soft[cut]
        out[again] = prefixes.shared(again, phi[again], limit)
    return out
