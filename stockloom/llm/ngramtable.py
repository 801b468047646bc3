"""An open-addressed table of n-grams in NumPy arrays."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import xxhash

#: Words are runs of the bytes that this table does not blank: digits, letters (lower-cased), all that is not ASCII.
WORDS = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: N-grams that are interned at once, and about the bytes of a text that are split into words at once.
CHUNK, PIECE = 1 << 16, 1 << 20
LEAST_SLOTS = 1 << 12


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, some at a time, so that a very long text is never a list of words."""
    at = 0
    clean = text.translate(WORDS)
    while at < len(clean):
        end = clean.find(b" ", at + PIECE)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def grams(text: bytes, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, n-grams) of a text piece by piece: all runs of 1 to `longest` consecutive words, joined by a space."""
    tail: list[bytes] = []
    for words in pieces(text):
        run = tail + words
        out = list(words)
        for n in range(2, longest + 1):
            # runs that end in a word of this piece
            first = max(0, len(tail) - n + 1)
            out += [b" ".join(run[i : i + n]) for i in range(first, len(run) - n + 1)]
        tail = run[len(run) - min(longest - 1, len(run)) :]
        yield len(words), out


class Table:
    """Interns n-grams: each distinct one owns a slot that holds its key, bucket and count.

    The key is the XXH64 of the bytes, and its low bits say where to look first; the next
    slots are tried in turn. A slot counts as an n-gram's own only if the bytes
    agree, so n-grams of equal keys keep apart. The table doubles before it is half full.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.entries: list[bytes] = []
        self._allocate(LEAST_SLOTS)

    def _allocate(self, slots: int) -> None:
        self.mask = slots - 1
        self.key = np.zeros(slots, np.uint64)
        self.entry = np.full(slots, -1, np.int64)
        self.bucket = np.zeros(slots, np.int64)
        self.count = np.zeros(slots, np.int64)

    def _grow(self, slots: int) -> None:
        used = np.flatnonzero(self.entry >= 0)
        old = [a[used] for a in (self.key, self.entry, self.bucket, self.count)]
        self._allocate(slots)
        at, todo = (old[0] & np.uint64(self.mask)).astype(np.int64), np.arange(len(used))
        while len(todo):
            spot = at[todo]
            free = self.entry[spot] < 0
            self.entry[spot[free]] = old[1][todo[free]]
            won = self.entry[spot] == old[1][todo]
            mine = todo[won]
            self.key[spot[won]], self.bucket[spot[won]], self.count[spot[won]] = old[0][mine], old[2][mine], old[3][mine]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & self.mask

    def intern(self, items: list[bytes]) -> np.ndarray:
        """The slot of each n-gram; counts them. Slots hold until the next call."""
        while 2 * (len(self.entries) + len(items)) > self.mask:
            self._grow(2 * (self.mask + 1))
        keys = np.fromiter(map(xxhash.xxh64_intdigest, items), np.uint64, len(items))
        slot = (keys & np.uint64(self.mask)).astype(np.int64)
        todo = np.arange(len(items))
        while len(todo):
            spot = slot[todo]
            free = np.flatnonzero(self.entry[spot] < 0)
            if len(free):  # the first of those that meet at a free slot gets it
                where, first = np.unique(spot[free], return_index=True)
                owner = todo[free[first]]
                own = [items[i] for i in owner.tolist()]
                self.entry[where] = np.arange(len(self.entries), len(self.entries) + len(own))
                self.key[where] = keys[owner]
                self.bucket[where] = np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % self.buckets
                self.entries += own
            same = self.key[spot] == keys[todo]
            maybe = np.flatnonzero(same)
            held = map(self.entries.__getitem__, self.entry[spot[maybe]].tolist())
            same[maybe] = np.fromiter(map(eq, held, map(items.__getitem__, todo[maybe].tolist())), bool, len(maybe))
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.count += np.bincount(slot, minlength=self.mask + 1)
        return slot

    def bucket_counts(self) -> np.ndarray:
        """How often n-grams of each bucket were interned."""
        out = np.zeros(self.buckets, np.int64)
        np.add.at(out, self.bucket, self.count)
        return out
