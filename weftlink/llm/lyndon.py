"""Linear-time suffix sorting by Lyndon grouping.

First step: suffixes start in groups by their first symbol.  Groups are taken
from the highest down.  For every suffix of a group, the previous suffix of a
lower group (one not taken yet) is found through previous-smaller pointers;
that suffix's Lyndon prefix grows by the group's, once for each suffix that
points to it, and it moves to a new group right above its own.  In the end the
groups are those of equal longest Lyndon prefixes, in order.

Second step: a suffix is its Lyndon prefix followed by its next smaller suffix.
Going through the order from the empty suffix up, each suffix puts those whose
next smaller one it is at the next free places of their groups.  Nothing is
renamed and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The places of the suffixes of ``symbols`` in ascending order; a prefix sorts before what it is a prefix of."""
    n = len(symbols)
    if not n:
        return []
    order = np.argsort(np.asarray(symbols), kind="stable")
    values = np.asarray(symbols)[order]
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist() + [n]
    members: list[list[int]] = [order[a:b].tolist() for a, b in zip(edges, edges[1:])]
    lower = list(range(-1, len(members) - 1))  # the next lower group
    upper = list(range(1, len(members) + 1))
    upper[-1] = -1
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    length = [1] * n  # of the Lyndon prefix
    previous = list(range(-1, n))  # previous[i + 1]: i while i's group is not taken, else a place before i
    taken: list[list[int]] = []
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        below = lower[g]
        if not own:
            g = below
            continue
        taken.append(own)
        for i in own:
            previous[i + 1] = i - 1
        width = length[own[0]]
        pointed: dict[int, int] = {}
        for i in own:
            # Follow the pointers to a suffix of a lower group, and shorten the way.
            p = i - 1
            while previous[p + 1] != p:
                q = previous[p + 1]
                previous[p + 1] = previous[q + 1]
                p = previous[p + 1]
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            if len(pointed) == 1:
                by_count = [next(iter(pointed.items()))]
            else:
                by_count = sorted(pointed.items(), key=lambda x: -x[1])
            last, made = 0, {}
            for p, times in by_count:
                if times != last:
                    last, made = times, {}
                old = group[p]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(members)
                    members.append([])
                    above = upper[old]
                    lower.append(old)
                    upper.append(above)
                    upper[old] = new
                    if above >= 0:
                        lower[above] = new
                members[new].append(p)
                group[p] = new
                length[p] += times * width
        g = lower[g]
    # Second step.
    free = [0] * len(members)
    at = 0
    for own in reversed(taken):
        free[group[own[0]]] = at
        at += len(own)
    waiting: list[list[int] | None] = [None] * (n + 1)
    for i in range(n):
        s = i + length[i]
        if waiting[s] is None:
            waiting[s] = [i]
        else:
            waiting[s].append(i)
    out = [0] * n
    for k in range(-1, n):
        found = waiting[out[k] if k >= 0 else n]
        if found is not None:
            for i in found:
                g = group[i]
                out[free[g]] = i
                free[g] += 1
    return out
