"""External induced sorting of one shard's suffixes, with the common prefixes of neighbours.

Suffixes are smaller (S) or larger (L) than the suffix one place on. Sorted leftmost S suffixes induce the L ones in one scan
upwards, sorted L suffixes induce the S ones in one scan downwards. The scans take tuples (first letter and order of the
suffix one place on, place, common prefix with the one before) from a priority queue. Tuples leave it in batches: all up to
the first that a tuple of the batch itself could still precede. The leftmost S suffixes are sorted by naming the substrings
between them and sorting the suffixes of the names in the same way, recursively.

The queue keeps sorted runs and merges those of like size; runs beyond its memory lie on disk and are read from the front.
"""

from __future__ import annotations

import os
import uuid

import numpy as np

#: Common prefixes are counted up to here.
MOST = 254
#: Tuples that are looked at at once: at most, and at least.
BATCH, LEAST = 1 << 16, 256
#: Fixed layout of keys: letter, seed or not, order.
LETTER, SEED = np.uint64(40), np.uint64(1 << 39)
NEVER = np.uint64((1 << 64) - 1)


class Store:
    """Arrays in memory up to `memory` bytes each, larger ones in files of `folder` (none: all in memory)."""

    def __init__(self, folder: str | None = None, memory: int = 1 << 26):
        self.folder, self.memory = folder, memory

    def keep(self, a: np.ndarray) -> np.ndarray:
        if self.folder is None or a.nbytes <= self.memory:
            return a
        path = os.path.join(self.folder, uuid.uuid4().hex)
        a.tofile(path)
        kept = np.memmap(path, a.dtype, "r", shape=a.shape)
        os.unlink(path)  # goes with the last reader
        return kept


class Queue:
    """A priority queue of (key, place, prefix) tuples in sorted runs."""

    def __init__(self, store: Store):
        self.store, self.runs = store, []

    def push(self, key: np.ndarray, place: np.ndarray, prefix: np.ndarray | None) -> None:
        """Add a sorted run; runs of like size in memory merge."""
        run = [a for a in (key, place, prefix) if a is not None]
        while self.runs and len(self.runs[-1][0]) <= 2 * len(run[0]) and not isinstance(self.runs[-1][0], np.memmap):
            both = [np.concatenate(pair) for pair in zip(self.runs.pop(), run, strict=True)]
            order = np.argsort(both[0], kind="stable")  # two sorted runs: one merge
            run = [a[order] for a in both]
        if len(run[0]):
            self.runs.append([self.store.keep(a) for a in run])

    def first(self, most: int) -> list[np.ndarray]:
        """The smallest tuples in order, at most so many."""
        heads = [[a[:most] for a in run] for run in self.runs]
        if len(heads) == 1:
            return heads[0]
        merged = [np.concatenate(parts) for parts in zip(*heads, strict=True)]
        order = np.argsort(merged[0], kind="stable")[:most]
        return [a[order] for a in merged]

    def drop(self, last: np.uint64) -> None:
        """Remove all tuples up to the key `last`."""
        left = [[a[np.searchsorted(run[0], last, "right") :] for a in run] for run in self.runs]
        self.runs = [run for run in left if len(run[0])]


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Letters that the suffixes at a and b share, up to MOST."""
    out = np.zeros(len(a), np.uint8)
    live, n = np.arange(len(a)), len(text)
    for step in range(MOST):
        x, y = a[live] + step, b[live] + step
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        out[live] = step + 1
    return out


def range_minima(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The minimum of values[begin:end] for each pair, 255 where that is empty."""
    table, width = [values], 1
    most = int((end - begin).max(initial=1))
    while width * 2 <= most:
        table.append(np.minimum(table[-1][:-width], table[-1][width:]))
        width *= 2
    out = np.full(len(begin), 255, np.uint8)
    k = np.frexp(np.maximum(end - begin, 1).astype(np.float64))[1] - 1
    for level in range(len(table)):
        here = np.flatnonzero((k == level) & (end > begin))
        out[here] = np.minimum(table[level][begin[here]], table[level][end[here] - (1 << level)])
    return out


def induce(text, wanted, seeds, prefixes, down: bool, store: Store):
    """(places, prefixes, seed or not) of the seeds and all they induce, in scan order.

    wanted: which suffixes are induced; seeds are in scan order; prefixes: of each seed with the one before, or None.
    """
    top = np.uint64(int(text.max()))

    def letter(at: np.ndarray) -> np.ndarray:
        own = text[at].astype(np.uint64)
        return top - own if down else own

    queue, rank, batch = Queue(store), 0, BATCH
    queue.push((letter(seeds) << LETTER) | SEED | np.arange(len(seeds), dtype=np.uint64), seeds, prefixes)
    since = np.full(int(top) + 1, 255, np.uint8) if prefixes is not None else None
    begun = np.zeros(int(top) + 1, bool)
    out, before = [], None
    while queue.runs:
        key, place, *rest = queue.first(batch)
        ahead = np.maximum(place - 1, 0)
        goes = (place > 0) & wanted[ahead]
        new = np.where(goes, (letter(ahead) << LETTER) | (np.uint64(rank) + np.arange(len(place), dtype=np.uint64)), NEVER)
        late = np.flatnonzero(key[1:] > np.minimum.accumulate(new)[:-1])
        n = int(late[0]) + 1 if len(late) else len(key)
        batch = min(BATCH, max(LEAST, 2 * n))
        key, place, goes, new = key[:n], place[:n], goes[:n], new[:n]
        seed = (key & SEED) != 0
        at = np.flatnonzero(goes)
        at = at[np.argsort(new[at], kind="stable")]
        prefix = lead = None
        if prefixes is not None:
            prefix = rest[0][:n].copy()
            letters = key >> LETTER
            turn = np.flatnonzero(seed[1:] & ~seed[:-1] & (letters[1:] == letters[:-1])) + 1
            prefix[turn] = common_prefix(text, place[turn - 1], place[turn])
            if before is not None and seed[0] and not before[2] and before[1] == letters[0]:
                prefix[0] = common_prefix(text, np.array([before[0]]), place[:1])[0]
            before = (place[-1], letters[-1], seed[-1])
            into = (new[at] >> LETTER).astype(np.int64)
            heads = np.flatnonzero(np.r_[True, into[1:] != into[:-1]]) if len(at) else at
            begin = np.r_[0, at[:-1] + 1] if len(at) else at
            begin[heads] = 0
            lead = range_minima(prefix, begin, at + 1)
            lead[heads] = np.where(begun[into[heads]], np.minimum(lead[heads], since[into[heads]]), 255)
            fresh = heads[~begun[into[heads]]]
            lead = np.minimum(lead, MOST - 1) + 1
            lead[fresh] = 0
            since = np.minimum(since, prefix.min())
            tails = np.r_[heads[1:], len(at)] - 1 if len(at) else at
            since[into[tails]] = range_minima(prefix, at[tails] + 1, np.full(len(tails), n))
            begun[into[heads]] = True
        out.append((place, prefix, seed))
        queue.drop(key[-1])
        if len(at):
            queue.push(new[at], place[at] - 1, lead)
        rank += n
    places, kept, seeded = zip(*out, strict=True)
    return (
        store.keep(np.concatenate(places)),
        store.keep(np.concatenate(kept)) if prefixes is not None else None,
        np.concatenate(seeded),
    )


def both_scans(text, larger, first, prefixes, store: Store):
    """All suffixes in order, and the prefix of each with the one before, induced from the leftmost S suffixes `first`."""
    places, lead, seed = induce(text, larger, first, prefixes, False, store)
    large, lead = places[~seed][::-1], None if lead is None else lead[~seed]
    if lead is not None:  # in the scan downwards the one before is the next larger suffix
        lead = np.r_[np.uint8(0), lead[::-1][:-1]]
    places, lead, _ = induce(text, ~larger, large, lead, True, store)
    places = np.r_[places, len(text) - 1][::-1]  # the last suffix follows none
    if lead is None:
        return places, None
    return places, np.r_[np.zeros(2, np.uint8), lead[::-1][:-1]]


def named_substrings(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The order number of the substring from each of first to the next one; equal substrings have equal numbers.

    Where one is the beginning of another, the longer is the smaller (it goes on with an L letter): the end sorts last.
    """
    length = np.r_[np.diff(first), 0] + 1
    last = int(text.max()) + 1  # the end
    wide, room = last.bit_length(), len(first).bit_length()
    letters = max(1, (63 - room) // wide)
    rank, live, done = np.zeros(len(first), np.int64), np.arange(len(first)), 0
    while len(live):
        key = rank[live].copy()
        for step in range(done, done + letters):
            at = np.minimum(first[live] + step, len(text) - 1)
            key = (key << wide) | np.where(step < length[live], text[at], last)
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        old, place = rank[live], np.arange(len(live))
        began = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[live] = old + np.maximum.accumulate(np.where(fresh, place, 0)) - began
        done += letters
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[heads, len(live)])
        open_ = (sizes > 1) & (np.maximum.reduceat(length[live], heads) > done)
        live = live[np.repeat(open_, sizes)]
    return np.unique(rank, return_inverse=True)[1]


def sorted_suffixes(text: np.ndarray, store: Store, with_prefixes: bool = True):
    """(places, prefixes) of all suffixes of text, which ends with its only smallest letter."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    change = np.r_[np.flatnonzero(text[1:] != text[:-1]), n - 1]  # the last of each run of equal letters decides
    falls = np.r_[text[change[:-1]] > text[change[:-1] + 1], False]
    larger = np.repeat(falls, np.diff(np.r_[-1, change]))
    first = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    names = named_substrings(text, first)
    if names.max() + 1 < len(first):
        order = first[sorted_suffixes(names, store, False)[0]]
    else:
        order = first[np.argsort(names)]
    prefixes = None
    if with_prefixes:
        prefixes = np.r_[np.uint8(0), common_prefix(text, order[:-1], order[1:])]
    return both_scans(text, larger, order, prefixes, store)
