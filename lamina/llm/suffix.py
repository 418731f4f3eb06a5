"""Suffix automaton of a sequence, and how much of a page its repeated substrings cover."""

from __future__ import annotations

from collections.abc import Hashable, Sequence
from itertools import accumulate

import numpy as np

#: Pages of more items are read off the suffix array, which says the same in a fraction of the memory.
AUTOMATON_ITEMS = 100_000


def repeats(items: Sequence[Hashable]) -> list[tuple[int, int]]:
    """For each end position i: the longest substring that ends there and ended before, as (length, first end).

    The automaton is built online. The suffix link of the state of a whole prefix is the longest of its
    suffixes that has another end position, all of which lie earlier; each state knows its first one.
    Together with the first ends this marks every occurrence of every repeated substring: at the second
    occurrence of one, the longest repeat that ends there began with the same first end.
    """
    arcs: list[dict] = [{}]
    link, length, first = [-1], [0], [-1]
    last, out = 0, []
    for i, c in enumerate(items):
        cur = len(arcs)
        arcs.append({})
        length.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = cur
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(arcs)
                arcs.append(arcs[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = clone
                    p = link[p]
        last = cur
        s = link[cur]
        out.append((length[s], first[s]))
    return out


def covered(found: list[tuple[int, int]], sizes: Sequence[int], least: Sequence[int]) -> list[int]:
    """Characters covered by repeated substrings of at least so many items, all their occurrences included.

    ``sizes`` has the characters of each item; the result has one figure for each of ``least``.
    """
    out = []
    n = len(found)
    for k in least:
        edge = [0] * (n + 1)
        any_ = False
        for i, (size, first) in enumerate(found):
            if size >= k:
                any_ = True
                edge[i - size + 1] += 1
                edge[i + 1] -= 1
                edge[first - size + 1] += 1
                edge[first + 1] -= 1
        out.append(sum([s for s, depth in zip(sizes, accumulate(edge)) if depth]) if any_ else 0)
    return out


def coverage(items: Sequence[Hashable], sizes: Sequence[int], least: Sequence[int]) -> tuple[int, list[int]]:
    """Length of the longest repeated substring, and the characters covered by repeats of at least so many items."""
    if len(items) <= AUTOMATON_ITEMS:
        found = repeats(items)
        return max(found)[0] if found else 0, covered(found, sizes, least)
    longest = longest_repeats(items)
    return int(longest.max()), covered_from(longest, np.asarray(sizes), least)


def longest_repeats(items: Sequence[Hashable]) -> np.ndarray:
    """For each start position the longest substring that starts there and occurs elsewhere too.

    The states of the suffix automaton are the inner nodes of the suffix tree of the reversed page; the same tree
    is spanned by suffix array and common prefixes: sorted by prefix doubling, in arrays of 8 bytes an item.
    """
    names: dict[Hashable, int] = {}
    rank = np.fromiter((names.setdefault(x, len(names)) for x in items), np.int64, len(items))
    n, step = len(rank), 1
    original = rank
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else after[:0]
        order = np.lexsort((after, rank))
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1]))))
        rank, step = new, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            break
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    shared, values, places, sorted_ = [0] * (n + 1), original.tolist(), place.tolist(), order.tolist()
    h = 0
    for i in range(n):  # common prefix with the suffix before in order, which shrinks by one at most from i to i + 1
        at = places[i]
        if not at:
            h = 0
            continue
        j = sorted_[at - 1]
        end = n - max(i, j)
        while h < end and values[i + h] == values[j + h]:
            h += 1
        shared[at] = h
        h = max(0, h - 1)
    lcp = np.array(shared)
    return np.maximum(lcp[:-1], lcp[1:])[place]


def covered_from(longest: np.ndarray, sizes: np.ndarray, least: Sequence[int]) -> list[int]:
    """covered() from the longest repeats by start position."""
    out, n = [], len(longest)
    for k in least:
        starts = np.flatnonzero(longest >= k)
        edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + longest[starts], minlength=n + 1)
        out.append(int(sizes[np.cumsum(edge)[:n] > 0].sum()))
    return out
