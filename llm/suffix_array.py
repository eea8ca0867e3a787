"""Suffix arrays by induced sorting and longest common prefixes in text order, in numpy.

Induced sorting goes through the buckets of first symbols. What a bucket's suffixes induce into later buckets is placed at
once for all of them; what they induce into their own bucket is taken in waves, in the order in which one by one would take
it. A pass thus costs a few array operations per bucket and per length of a run of one symbol, and touches each suffix once.
"""

from __future__ import annotations

import numpy as np


def rises(text: np.ndarray) -> np.ndarray:
    """True for each suffix smaller than the one after it. The last symbol is the only 0."""
    step = np.sign(np.diff(text.astype(np.int32))).astype(np.int8)
    following = np.where(step != 0, np.arange(len(step), dtype=np.int32), np.int32(len(step)))
    following = np.minimum.accumulate(following[::-1])[::-1]  # the next place where neighbours differ
    up = np.ones(len(text), bool)
    up[:-1] = step[np.minimum(following, len(step) - 1)] > 0
    return up


class Induction:
    """One text's buckets, and the two passes over them."""

    def __init__(self, text: np.ndarray):
        self.text, self.up = text, rises(text)
        self.symbols = int(text.max()) + 1
        self.stop = np.cumsum(np.bincount(text, minlength=self.symbols))
        self.start = np.concatenate([[0], self.stop[:-1]])
        self.lowest = np.flatnonzero(self.up[1:] & ~self.up[:-1]).astype(np.int32) + 1  # leftmost of those smaller than the next

    def _place(self, array: np.ndarray, edge: np.ndarray, items: np.ndarray, up: bool) -> None:
        """Puts the suffixes before `items` of the given kind to the open edges of their buckets, in the order of items."""
        before = items[items > 0] - 1
        before = before[self.up[before] == up]
        if not len(before):
            return
        symbol = self.text[before]
        if len(before) == 1:
            s = int(symbol[0])
            edge[s] -= up
            array[edge[s]] = before[0]
            edge[s] += not up
            return
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        sizes = np.diff(np.append(first, len(symbol)))
        rank = np.arange(len(symbol)) - np.repeat(first, sizes)
        own = symbol[first]
        if up:
            array[edge[symbol] - 1 - rank] = before
            edge[own] -= sizes
        else:
            array[edge[symbol] + rank] = before
            edge[own] += sizes

    def induce(self, lowest: np.ndarray) -> np.ndarray:
        """All suffixes in order, given the leftmost-smaller ones in order."""
        array = np.full(len(self.text), -1, np.int32)
        bounds = np.searchsorted(self.text[lowest], np.arange(self.symbols + 1))
        head = self.start.copy()
        for s in range(self.symbols):
            done = self.start[s]
            while done < head[s]:
                wave, done = array[done : head[s]], head[s]
                self._place(array, head, wave, False)
            if bounds[s] < bounds[s + 1]:
                self._place(array, head, lowest[bounds[s] : bounds[s + 1]], False)
        tail = self.stop.copy()
        for s in range(self.symbols - 1, -1, -1):
            done = self.stop[s]
            while done > tail[s]:
                wave, done = array[tail[s] : done][::-1], tail[s]
                self._place(array, tail, wave, True)
            if head[s] > self.start[s]:
                self._place(array, tail, array[self.start[s] : head[s]][::-1], True)
        array[0] = len(self.text) - 1
        return array


def _names(induction: Induction, order: np.ndarray) -> np.ndarray:
    """For the leftmost-smaller substrings in the order found, from 0: a new number where one differs from the one before."""
    text, lowest = induction.text, induction.lowest
    length = np.zeros(len(text), np.int32)
    length[lowest] = np.diff(np.append(lowest, len(text) - 1)) + 1
    a, b = order[:-1], order[1:]
    differs = length[a] != length[b]
    active, k = np.flatnonzero(~differs), 0
    while len(active):
        x, y = a[active], b[active]
        other = text[x + k] != text[y + k]
        differs[active[other]] = True
        k += 1
        active = active[~other & (length[x] > k)]
    return np.concatenate([[0], np.cumsum(differs)])


def _ranks(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a sequence of names: its own suffixes are compared by twice as many names each time, only
    where they are still alike. The alphabet is as large as the sequence here, so that passes by bucket wouldn't pay."""
    size = len(names)
    order = np.argsort(names, kind="stable")
    rank = np.empty(size, np.int64)
    changed = np.concatenate([[True], names[order][1:] != names[order][:-1]])
    rank[order] = np.flatnonzero(changed)[np.cumsum(changed) - 1]
    width = 1
    while True:
        alike = np.concatenate([[False], rank[order][1:] == rank[order][:-1]])
        open_ = alike | np.append(alike[1:], False)
        at = np.flatnonzero(open_)
        if not len(at):
            return order
        own = order[at]
        further = own + width
        second = np.where(further < size, rank[np.minimum(further, size - 1)], -1)
        new = np.lexsort((second, rank[own]))
        own, second = own[new], second[new]
        first = rank[own]
        order[at] = own
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[own] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        width *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: small whole numbers, the last one the only 0. Returns the starts of its suffixes in order."""
    if len(text) == 1:
        return np.zeros(1, np.int32)
    induction = Induction(text)
    lowest = induction.lowest
    by_symbol = lowest[np.argsort(text[lowest], kind="stable")]
    is_lowest = np.zeros(len(text), bool)
    is_lowest[lowest] = True
    array = induction.induce(by_symbol)  # orders the leftmost-smaller substrings
    order = array[is_lowest[array]]
    names = _names(induction, order)
    if names[-1] + 1 < len(lowest):
        name_of = np.zeros(len(text), np.int64)
        name_of[order] = names
        order = lowest[_ranks(name_of[lowest])]
    return induction.induce(order)


def permuted_common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each start in text: the longest prefix that its suffix shares with the one before it in the array. Compared are
    only places whose left neighbours differ; elsewhere it is one less than at the place before."""
    size = len(text)
    before = np.full(size, -1, np.int32)
    before[array[1:]] = array[:-1]
    places = np.arange(size, dtype=np.int32)
    free = (before <= 0) | (places == 0)
    inner = np.flatnonzero(~free)
    free[inner] = text[inner - 1] != text[before[inner] - 1]
    padded = np.concatenate([text.astype(np.uint64), np.zeros(4, np.uint64)])
    words = padded[:size] << np.uint64(48) | padded[1 : size + 1] << np.uint64(32) | padded[2 : size + 2] << np.uint64(16) | padded[3 : size + 3]
    common = np.zeros(size, np.int32)
    active = np.flatnonzero(free & (before >= 0)).astype(np.int32)
    while len(active):
        at, k = active, common[active]
        differing = words[at + k] ^ words[before[at] + k]
        same = differing == 0
        some = differing[~same]
        more = (some < np.uint64(1) << np.uint64(48)).astype(np.int32) + (some < np.uint64(1) << np.uint64(32)) + (some < np.uint64(1) << np.uint64(16))
        common[at[~same]] += more.astype(np.int32)
        common[at[same]] += 4
        active = at[same]
    base = np.maximum.accumulate(np.where(free, places, 0))
    return common[base] - (places - base)


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """True for each start whose `length` symbols also start elsewhere in the text."""
    array = suffix_array(text)
    shared = permuted_common_prefixes(text, array)[array] >= length
    found = np.zeros(len(text), bool)
    found[array] = shared | np.append(shared[1:], False)
    return found
