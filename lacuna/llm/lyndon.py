"""Suffix arrays by linear grouping.

Suffixes are kept in ordered groups that share a known prefix. Going through the groups from the highest to the lowest, each
member's previous-smaller pointer is found: the nearest position to its left that lies in a lower group. The positions pointed at
have their known prefix followed by the finished group's, so they rise above the rest of their own group; those pointed at more
often rise higher. In the end the prefix of a group is the Lyndon word at which its suffixes start. A pass from the smallest suffix
upwards then writes the suffixes of each group in order, by following the pointers from the position before each finished suffix:
nothing is renamed, and no part of the text is sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Start positions in the order of the suffixes. The last symbol must be smaller than all others and occur once."""
    n = len(text)
    if n < 2:
        return list(range(n))
    order = np.argsort(np.asarray(text, dtype=np.int64), kind="stable").tolist()
    # group[i]: where the group of position i starts in `order`; size by start; place[i]: where i stands in `order`
    group, place, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        group[i], place[i] = start, k
        size[start] += 1
    left = [-1] * n  # the pointers
    end = n
    while end > 0:
        low = group[order[end - 1]]
        members = order[low:end]
        if end - low > 1:
            members.sort()
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = left[j]
            left[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            most = max(times.values())
            levels = [times] if most == 1 else [[j for j in times if times[j] == m] for m in sorted(set(times.values()), reverse=True)]
            for level in levels:
                moved: dict[int, int] = {}
                for j in level:  # to the upper end of its own group
                    g = group[j]
                    m = moved.get(g, 0)
                    to, at = g + size[g] - 1 - m, place[j]
                    other = order[to]
                    order[to], order[at] = j, other
                    place[j], place[other] = to, at
                    moved[g] = m + 1
                for g, m in moved.items():
                    if m < size[g]:
                        size[g] -= m
                        new = g + size[g]
                        size[new] = m
                        for k in range(new, new + m):
                            group[order[k]] = new
        end = low
    out = [-1] * n
    following = list(range(n))  # by group start: the next free place
    done = bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[following[g]] = j
            following[g] += 1
            done[j] = 1
            j = left[j]
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """By position: the symbols that the suffix shares with the neighbour, before or after it in the order, with which it shares most."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    shared = [0] * (n + 1)  # with the suffix before it in the order
    h = 0
    for i in range(n - 1):
        k = rank[i]
        if k:
            j = order[k - 1]
            while text[i + h] == text[j + h]:
                h += 1
            shared[k] = h
            if h:
                h -= 1
        else:
            h = 0
    return [max(shared[rank[i]], shared[rank[i] + 1]) for i in range(n)]
