"""Suffix sorting by linear grouping (GSACA), for many strings at once in numpy.

Phase one: suffixes start grouped by their first symbol. Groups are processed in descending order; each suffix s of the
current group gets a previous-smaller pointer, the nearest earlier suffix in a lower group, and the suffixes pointed at move
behind the rest of their groups, those pointed at more often further. At the end a group holds the suffixes of one longest
Lyndon prefix, and the groups are in lexicographic order. Phase two walks the suffix array from its start: the suffix before
each entry, and those its pointers lead to, take the next free place of their groups. No string is renamed or sorted
recursively. The strings are independent, and each step handles the next group of every string together.
"""

from __future__ import annotations

import numpy as np


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., then the same for the next range."""
    total = int(size.sum())
    return np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def suffix_arrays(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """text: symbols of all strings end to end; the last of each must be its only 0, all others larger. bounds: n + 1 offsets.
    Returns positions in text: bounds[i]:bounds[i + 1] of the result are string i's suffixes in order."""
    n = len(text)
    base = np.repeat(bounds[:-1], np.diff(bounds))
    string = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(string.astype(np.int64) << 32 | text.astype(np.int64), kind="stable")  # suffixes by group
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    lead = np.ones(n, bool)
    lead[1:] = (text[order][1:] != text[order][:-1]) | (string[order][1:] != string[order][:-1])
    first = np.flatnonzero(lead)
    group = np.empty(n, np.int64)  # by suffix: where its group starts in order
    size = np.zeros(n, np.int64)  # by group start
    size[first] = np.diff(np.append(first, n))
    group[order] = np.repeat(first, size[first])
    prev = np.full(n, -1, np.int64)
    end = bounds[1:].copy()
    low = bounds[:-1] + 1  # the sentinel's group stands first and needs no step
    live = np.flatnonzero(end > low)
    while len(live):
        g = group[order[end[live] - 1]]
        members = order[_spans(g, end[live] - g)]
        mine = group[members]
        p = members - 1
        floor = base[members]
        prev[members] = p
        todo = np.flatnonzero((p >= floor) & (group[np.maximum(p, 0)] >= mine))
        while len(todo):
            p[todo] = prev[p[todo]]
            prev[members[todo]] = p[todo]
            q = p[todo]
            todo = todo[(q >= floor[todo]) & (group[np.maximum(q, 0)] >= mine[todo])]
        none = p < floor
        prev[members[none]] = -1
        end[live] = g
        live = live[g > low[live]]
        p = p[~none]
        if not len(p):
            continue
        p.sort()
        cut = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        count = np.diff(np.append(cut, len(p)))
        p = p[cut]
        by = np.lexsort((count, group[p]))
        p, count = p[by], count[by]
        old = group[p]
        cut = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        moved = np.diff(np.append(cut, len(p)))
        h = old[cut]
        tail = _spans(h + size[h] - moved, moved)  # the slots at the ends of the groups, in the order of p
        there = order[tail]
        staying = np.ones(len(tail), bool)
        is_moved = place[p]
        edge = np.repeat(h + size[h] - moved, moved)
        vacated = is_moved[is_moved < edge]  # by group, as p is
        mark = np.zeros(len(p), bool)
        in_tail = is_moved >= edge
        mark[np.repeat(np.cumsum(moved) - moved, moved)[in_tail] + is_moved[in_tail] - edge[in_tail]] = True
        staying = there[~mark]
        order[vacated], place[staying] = staying, vacated
        order[tail], place[p] = p, tail
        new = np.concatenate([[True], (old[1:] != old[:-1]) | (count[1:] != count[:-1])])
        at = np.flatnonzero(new)
        starts, sizes = tail[at], np.diff(np.append(at, len(p)))
        size[h] -= moved
        size[starts] = sizes
        group[p] = np.repeat(starts, sizes)
    # phase two
    sa = np.full(n, -1, np.int64)
    sa[bounds[:-1]] = bounds[1:] - 1
    free = np.arange(n)  # by group start: its next free place
    done = np.zeros(n, bool)
    done[bounds[1:] - 1] = True
    length = np.diff(bounds)
    at, left = bounds[:-1].copy(), np.argsort(-length, kind="stable")
    at, length, floor = at[left], length[left], bounds[:-1][left]
    for i in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -i, "left"))  # strings longer than i, as they are sorted by length
        s = sa[at[:live] + i] - 1
        s = s[s >= floor[:live]]
        s = s[~done[s]]
        while len(s):
            g = group[s]
            sa[free[g]] = s
            free[g] += 1
            done[s] = True
            s = prev[s]
            s = s[s >= 0]
            s = s[~done[s]]
    return sa
