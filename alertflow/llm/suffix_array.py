"""Suffix array of a byte string by linear grouping.

Suffixes are grouped by their longest Lyndon prefix.  Groups are processed
from the highest down: each suffix of a group points to the previous position
whose group is smaller, and that position's group is refined by how many
suffixes of the processed group point to it (more pointers: larger).  After
that, groups are in final order, and one ascending pass fills them: a suffix
is placed when the next smaller suffix after it is, by walking the pointers
back from it.  No rank is ever renamed and nothing recurses.
"""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Start positions of the suffixes of ``text`` in ascending order."""
    n = len(text) + 1                       # the end of the text is the smallest suffix
    count = [0] * 257
    count[0] = 1
    for c in text:
        count[c + 1] += 1
    first, at = [0] * 257, 0
    for c in range(257):
        first[c] = at
        at += count[c]
    # group[i]: where the group of suffix i starts in order; size[start]: its size
    group = [first[c + 1] for c in text]
    group.append(0)
    order, where = [0] * n, [0] * n
    fill = first[:]
    for i, c in enumerate(text):
        k = fill[c + 1]
        fill[c + 1] = k + 1
        order[k] = i
        where[i] = k
    order[0], where[n - 1] = n - 1, 0
    size = [0] * (n + 1)
    for c in range(257):
        if count[c]:
            size[first[c]] = count[c]
    before = [-1] * n

    end = n - 1
    while end >= 0:
        start = group[order[end]]
        if start == end:                    # one suffix: at most one position moves
            i = order[end]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                old = group[p]
                left = size[old] - 1
                if left:
                    last, k = old + left, where[p]
                    q = order[last]
                    order[k], where[q] = q, k
                    order[last], where[p] = p, last
                    size[old] = left
                    group[p] = last
                    size[last] = 1
            end -= 1
            continue
        pointed: dict[int, int] = {}
        for i in sorted(order[start:end + 1]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, times in pointed.items():
            by_count.setdefault(times, []).append(p)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[times]:
                moved.setdefault(group[p], []).append(p)
            for old, members in moved.items():
                rest = size[old]
                for p in members:           # to the back of its group
                    rest -= 1
                    last, k = old + rest, where[p]
                    q = order[last]
                    order[k], where[q] = q, k
                    order[last], where[p] = p, last
                new = old + rest
                if rest:
                    size[old] = rest
                for p in members:
                    group[p] = new
                size[new] = len(members)
        end = start - 1

    slot = list(range(n))                   # next free place of a group, by its start
    placed = bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            start = group[i]
            order[slot[start]] = i
            slot[start] += 1
            i = before[i]
    return order[1:]
