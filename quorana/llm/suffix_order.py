"""Suffix arrays by linear grouping, without recursive renaming.

Suffixes are grouped by their Lyndon prefix. Groups start as the classes of equal first
symbols and are processed from the highest to the lowest. Each member of the current group
points to its previous smaller position: the nearest position before it that stands in a
lower group. A position that is pointed at by k members has its prefix extended by k copies
of the group's, so it rises above the rest of its own group, further for larger k. Once the
lowest group is through, the groups are those of the Lyndon prefixes, in their order. A
second pass over the array, from the smallest suffix on, then fixes the order inside the
groups: each suffix that is read places the positions whose Lyndon prefix ends right before
it, along the previous-smaller pointers.
"""

from __future__ import annotations

from collections.abc import Sequence


def _rise(up: list[int], group: list[int], members: list[list[int]], below: list[int], above: list[int]) -> None:
    """Moves positions of one group into a new group right above it."""
    old, new = group[up[0]], len(members)
    members.append(up)
    for p in up:
        group[p] = new
    top = above[old]
    below.append(old)
    above.append(top)
    above[old] = new
    if top >= 0:
        below[top] = new


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The suffix array of non-negative integers whose last one is the unique smallest."""
    n = len(symbols)
    if n == 0:
        return []
    members: list[list[int]] = []
    group = [0] * n
    at = {c: k for k, c in enumerate(sorted(set(symbols)))}
    members = [[] for _ in at]
    for i, c in enumerate(symbols):
        k = group[i] = at[c]
        members[k].append(i)
    below, above = list(range(-1, len(at) - 1)), [*range(1, len(at)), -1]
    previous, hop, done = [-1] * n, list(range(-1, n - 1)), bytearray(n)

    current, order = len(at) - 1, []
    while current >= 0:
        own = [i for i in members[current] if group[i] == current]
        members[current] = own
        order.append(current)
        for i in own:
            done[i] = 1
        pointed: dict[int, int] = {}
        for i in own:  # ascending
            p = i - 1
            while p >= 0 and done[p]:
                p = hop[p]
            previous[i] = p
            q = i
            while hop[q] != p and hop[q] >= 0:  # shorten the way for later walks
                q, hop[q] = hop[q], p
            hop[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            ((p, _),) = pointed.items()
            _rise([p], group, members, below, above)
        elif pointed:
            risen: dict[tuple[int, int], list[int]] = {}
            for p, k in pointed.items():
                risen.setdefault((group[p], k), []).append(p)
            for old, k in sorted(risen, key=lambda x: (x[0], -x[1])):
                _rise(sorted(risen[old, k]), group, members, below, above)
        current = below[current]

    start = {}
    filled = 0
    for g in reversed(order):
        start[g] = filled
        filled += len(members[g])
    out = [-1] * n
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    start[group[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = previous[j]
    return out
