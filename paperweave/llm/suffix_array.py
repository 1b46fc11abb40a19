"""A suffix array by linear grouping.

Suffixes are first grouped by their first symbol. Groups are processed in
descending order: each member's pointer to the previous suffix of a smaller group
is found over the pointers that are known, and the suffixes pointed at move into
new groups right above their old ones, by how many members point at them. In the
end a group holds the suffixes of one Lyndon prefix. Then, going up the array,
each suffix that is placed passes its predecessors, along the pointers, into the
next free places of their groups. No suffix is renamed recursively.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of a sequence of non-negative integers, in order; a suffix that ends first is smaller."""
    s = np.asarray(symbols, np.int64)
    n = len(s) + 1  # an end mark below all symbols
    if n == 1:
        return np.zeros(0, np.int64)
    s = np.append(np.unique(s, return_inverse=True)[1] + 1, 0)
    order = np.argsort(s, kind="stable")
    bound = np.flatnonzero(np.append(True, np.diff(s[order]) != 0))
    start = np.repeat(bound, np.diff(np.append(bound, n)))  # of each place's group
    group = np.empty(n, np.int64)
    group[order] = start
    sa, group = order.tolist(), group.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    end = {int(b): int(e) for b, e in zip(bound, np.append(bound[1:], n), strict=True)}  # groups by start
    prev = [-1] * n
    at = n
    while at > 0:
        i = sa[at - 1]
        first = group[i]
        if at - first == 1:  # a group of one: its pointer moves one suffix
            at, p = first, i - 1
            while p >= 0 and group[p] >= first:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                g = group[p]
                top = end[g] - 1
                if top > g:
                    a, other = place[p], sa[top]
                    sa[a], sa[top], place[p], place[other] = other, p, top, a
                    group[p], end[g], end[top] = top, top, top + 1
            continue
        counts: dict[int, int] = {}
        for i in sorted(sa[first:at]):
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if counts:
            parts: dict[tuple[int, int], list[int]] = {}
            for p, k in counts.items():
                parts.setdefault((group[p], k), []).append(p)
            for (g, _k), own in sorted(parts.items(), key=lambda x: -x[0][1]):
                # the larger counts go to the upper end first, the next ones below them
                top = end[g]
                if len(own) < top - g:
                    new = top - len(own)
                    for p in own:
                        top -= 1
                        a, other = place[p], sa[top]
                        sa[a], sa[top], place[p], place[other] = other, p, top, a
                    for p in own:
                        group[p] = new
                    end[g], end[new] = new, new + len(own)
        at = first
    free = list(range(n))  # the next free place of the group that starts there
    out, placed = [0] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = prev[p]
    return np.array(out[1:], np.int64)
