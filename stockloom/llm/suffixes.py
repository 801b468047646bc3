"""Suffix arrays by induced sorting, in numpy, and permuted common prefixes.

Suffixes are classified as S (smaller than the next one) or L; the leftmost S
of each run (LMS) start the substrings that are sorted first: an induced pass orders
them, equal ones share a name, and the string of names is sorted recursively.
From the sorted LMS suffixes two induced passes fill the array in linear time.

A pass goes through the buckets of first characters. All entries of a bucket
that are known are handled at once: those before them are dealt stably to their own buckets;
entries that fall into the same bucket make another round, as many as
the longest run of the character. So a level needs as many steps as its alphabet has
characters. Where the names are too many for that (WIDE), the recursion
ends in prefix doubling, which sorts by whole arrays.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet that is sorted bucket by bucket.
WIDE = 2048


def places(n: int) -> type:
    """The integers that name n places."""
    return np.int32 if n < 1 << 31 else np.int64


def classify(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes. The end of the text counts as smaller than any character, so the last one is L."""
    n = len(text)
    up = np.zeros(n, bool)
    np.greater(text[1:], text[:-1], out=up[:-1])
    change = np.ones(n, bool)
    np.not_equal(text[1:], text[:-1], out=change[:-1])
    # equal neighbours are of one type: that of the next place where the text changes
    at = np.nonzero(change)[0]
    return np.repeat(up[at], np.diff(at, prepend=-1))


class Buckets:
    """The array under construction, with the next free place at both ends of each bucket."""

    def __init__(self, text: np.ndarray, sigma: int, small: np.ndarray):
        self.text, self.small = text, small
        count = np.bincount(text, minlength=sigma)
        self.end = np.cumsum(count)
        self.start = self.end - count
        self.sigma = sigma

    def _deal(self, suffixes: np.ndarray, place: np.ndarray, free: np.ndarray, step: int) -> None:
        """Put suffixes, in order, at the free places of their buckets."""
        c = self.text[suffixes]
        order = np.argsort(c, kind="stable")
        sorted_c = c[order]
        count = np.bincount(c, minlength=self.sigma)
        if step > 0:
            place[(free - np.cumsum(count) + count)[sorted_c] + np.arange(len(c))] = suffixes[order]
        else:
            place[(free + np.cumsum(count) - count)[sorted_c] - np.arange(len(c))] = suffixes[order]
        free += step * count

    def induce(self, seeds: np.ndarray) -> np.ndarray:
        """All suffixes in order, given LMS suffixes in the order that shall hold among them."""
        n = len(self.text)
        held = np.full(n, -1, places(n))
        # seeds at the ends of their buckets
        c = self.text[seeds]
        order = np.argsort(c, kind="stable")
        by_bucket = seeds[order]
        cut = np.searchsorted(c[order], np.arange(self.sigma + 1))
        free = self.start.copy()
        last = np.array([n - 1])
        if not self.small[n - 1]:
            self._deal(last, held, free, 1)  # the suffix before the imagined end
        for b in range(self.sigma):
            done = self.start[b]
            while done < free[b]:
                now = held[done : free[b]]
                done = free[b]
                self._before(now, held, free, 1, large=True)
            now = by_bucket[cut[b] : cut[b + 1]]
            if len(now):
                self._before(now, held, free, 1, large=True)
        free = self.end - 1
        out = held  # L-type entries stay, S-type ones are filled from the ends
        for b in reversed(range(self.sigma)):
            done = self.end[b] - 1
            while done > free[b]:
                now = out[free[b] + 1 : done + 1][::-1]
                done = free[b]
                self._before(now, out, free, -1, large=False)
            now = out[self.start[b] : free[b] + 1]
            now = now[now >= 0][::-1]
            if len(now):
                self._before(now[~self.small[now]], out, free, -1, large=False)
        return out

    def _before(self, now: np.ndarray, place: np.ndarray, free: np.ndarray, step: int, large: bool) -> None:
        j = now[now > 0] - 1
        j = j[self.small[j] != large]
        if len(j):
            self._deal(j, place, free, step)


def doubled(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; suffixes that are alone in their group are not sorted again."""
    n = len(text)
    order = np.argsort(text)
    first = np.append(True, text[order[1:]] != text[order[:-1]])
    rank = np.empty(n, np.int64)  # where the group of equal suffixes starts in the order
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    live = np.nonzero(~(first & np.append(first[1:], True)))[0]
    width = 1
    while len(live):
        now = order[live]
        other = np.where(now + width < n, rank[np.minimum(now + width, n - 1)] + 1, 0)
        key = rank[now] * (n + 1) + other
        by = np.argsort(key)  # equal keys stay one group, in any order
        now, key = now[by], key[by]
        order[live] = now
        first = np.append(True, key[1:] != key[:-1])
        rank[now] = live[np.maximum.accumulate(np.where(first, np.arange(len(live)), 0))]
        live = live[~(first & np.append(first[1:], True))]
        width *= 2
    return order


def packed_words(text: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(word, bits, each): at each place and the end, the `each` characters of `bits` bits that start there in one integer.

    Beyond the end they count as a number that no character has.
    """
    end = int(text.max(initial=0)) + 1
    if text.dtype == np.uint8 and end < 256:  # the bytes themselves are such words
        padded = np.append(text, np.full(8, end, np.uint8))
        return np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(text) + 1,), (1,)).astype(np.uint64), 8, 8
    bits = end.bit_length()
    each = max(1, 64 // bits)
    padded = np.append(text.astype(np.uint64), np.full(each, end, np.uint64))
    word = padded[: len(text) + 1].copy()
    for i in range(1, each):
        word |= padded[i : i + len(text) + 1] << np.uint64(bits * i)
    return word, bits, each


def suffix_array(text: np.ndarray, sigma: int | None = None) -> np.ndarray:
    """Suffix array of an array of non-negative integers below sigma."""
    text = np.asarray(text)
    n = len(text)
    if n < 2:
        return np.arange(n)
    sigma = int(text.max()) + 1 if sigma is None else sigma
    if sigma > WIDE:
        return doubled(text)
    small = classify(text)
    lms = np.nonzero(small[1:] & ~small[:-1])[0] + 1
    buckets = Buckets(text, sigma, small)
    if not len(lms):
        return buckets.induce(lms)
    sorted_all = buckets.induce(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sorted_all[is_lms[sorted_all]]
    # names: neighbours in this order are equal if length and characters up to the next LMS are
    size = np.empty(n, places(n))
    size[lms] = np.diff(np.append(lms, n))
    differs = np.ones(len(ordered), bool)
    a, b = ordered[:-1], ordered[1:]
    same = np.nonzero((size[a] == size[b]) & (b + size[b] < n) & (a + size[a] < n))[0]
    word, bits, each = packed_words(text)
    length = size[b[same]] + 1  # the first character of the next LMS is compared too
    equal = np.ones(len(same), bool)
    live, at = np.arange(len(same)), 0
    while len(live):  # a word at a time; the last one may overlap the one before it
        x, y, more = a[same[live]], b[same[live]], length[live]
        step = np.maximum(np.minimum(at, more - each), 0)
        unlike = word[x + step] ^ word[y + step]
        short = more < each
        if short.any():
            unlike[short] &= (np.uint64(1) << (np.uint64(bits) * more[short].astype(np.uint64))) - np.uint64(1)
        ok = unlike == 0
        equal[live[~ok]] = False
        at += each
        live = live[ok & (more > at)]
    differs[same[equal] + 1] = False
    name = np.empty(n, places(n))
    name[ordered] = np.cumsum(differs) - 1
    names = name[lms]
    if differs.all():
        return buckets.induce(ordered)
    return buckets.induce(lms[suffix_array(names)])


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position of the text, the common prefix of its suffix with the one before it in `order`, up to `most`.

    `order` is the suffix array or a part of it in the same order.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    # words of several characters compare at once; the lowest bit that differs tells how many of the last word are equal.
    # Suffixes end at different places, so two words differ before both have ended.
    word, bits, each = packed_words(text)
    live, at = np.arange(len(a)), 0
    while len(live) and at < most:
        unlike = word[a[live] + at] ^ word[b[live] + at]
        stop = np.nonzero(unlike)[0]
        low = unlike[stop]
        low &= ~low + np.uint64(1)
        out[b[live[stop]]] = at + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // bits
        live = live[unlike == 0]
        at += each
    out[b[live]] = most
    return np.minimum(out, most)
