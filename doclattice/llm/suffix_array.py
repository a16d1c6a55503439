"""Suffix sorting by linear grouping.

Phase 1 refines groups of suffixes that begin with the same (growing) Lyndon prefix. Groups
are taken in descending order; each member's previous-smaller pointer leads to the nearest
suffix before it that lies in a lower group, and the suffixes pointed to leave their group
for new ones right above it, by how often they are pointed to. When all groups are done,
suffixes of one group share their Lyndon prefix and groups stand in their final order.

Phase 2 emits each group's order: going through the suffixes in sorted order, the chain of
previous-smaller pointers from the place before each one gives the suffixes whose Lyndon
prefix ends there, and they take the next free places of their groups. There is no recursion,
no renaming of the text, and each suffix is handled a constant number of times.
"""

from __future__ import annotations


def suffix_array(text: bytes | list[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in lexicographic order (a proper prefix comes first)."""
    n = len(text) + 1  # one more than the text: a sentinel below all symbols ends it
    if n == 1:
        return []
    values = sorted(set(text))
    symbol = {x: i + 1 for i, x in enumerate(values)}
    codes = [symbol[x] for x in text]
    codes.append(0)
    # groups by first symbol: contiguous stretches of `order`
    count = [0] * (len(values) + 2)
    for x in codes:
        count[x + 1] += 1
    for i in range(len(count) - 1):
        count[i + 1] += count[i]
    start_of = count[:-1]
    fill = list(start_of)
    order, place, group = [0] * n, [0] * n, [0] * n
    size = [0] * n
    for i, x in enumerate(codes):
        at = fill[x]
        order[at], place[i], group[i] = i, at, start_of[x]
        fill[x] = at + 1
        size[start_of[x]] += 1
    previous = [-1] * n
    starts = [False] * n

    end = n
    while end > 0:
        begin = group[order[end - 1]]
        members = order[begin:end]
        if end - begin > 1:
            members.sort()
        starts[begin] = True
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if len(pointed) == 1:
            classes = [list(pointed)]
        elif pointed:
            top = max(pointed.values())
            if top == 1:
                classes = [list(pointed)]
            else:
                by: dict[int, list[int]] = {}
                for p, k in pointed.items():
                    by.setdefault(k, []).append(p)
                classes = [by[k] for k in sorted(by, reverse=True)]
        else:
            classes = []
        for own in classes:  # most often pointed to: highest
            touched = []
            for p in own:
                g = group[p]
                last = g + size[g] - 1
                at, other = place[p], order[last]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
                size[g] -= 1
                touched.append(g)
            for p, g in zip(own, touched):
                group[p] = g + size[g]
            for p, g in zip(own, touched):
                size[group[p]] += 1
        end = begin

    # phase 2: `free` is the next place of each group
    free = {i: i for i in range(n) if starts[i]}
    out = [-1] * n
    out[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    for at in range(n):
        p = out[at] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[free[g]] = p
            free[g] += 1
            done[p] = True
            p = previous[p]
    return out[1:]
