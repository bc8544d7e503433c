"""Suffix arrays by linear grouping.

First every suffix is put into the group of its Lyndon prefix, the longest prefix that is less than
all its own proper suffixes. Groups start as single symbols and are processed from the greatest
down. A suffix's previous smaller suffix is the nearest one to the left in a lesser group; those
that members of the processed group point to have their prefix extended by the group's, once per
member, so they move into a new group right above their old one, the more members the higher.
Then the order within the groups comes from one pass over the result as it fills: a suffix brings
the suffixes whose next smaller suffix it is, and these form the chain of previous smaller suffixes
that ends on its left. Nothing is renamed or sorted again; both parts are linear.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(codes: np.ndarray) -> tuple[list[int], list[int]]:
    """First place of each suffix's final group, and its previous smaller suffix (-1: none).

    ``codes`` ends with a value less than all others.
    """
    count = len(codes)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(heads, count))
    start_of, place = np.empty(count, np.int64), np.empty(count, np.int64)
    start_of[order], place[order] = np.repeat(heads, sizes), np.arange(count)
    by_start = np.zeros(count, np.int64)
    by_start[heads] = sizes
    suffixes, group, at, size = order.tolist(), start_of.tolist(), place.tolist(), by_start.tolist()
    smaller = [-1] * count

    end = count
    while end:
        i = suffixes[end - 1]
        start = group[i]
        if start == end - 1:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                head = group[j]
                if size[head] > 1:
                    size[head] -= 1
                    last, here = head + size[head], at[j]
                    other = suffixes[last]
                    suffixes[here], at[other] = other, here
                    suffixes[last], at[j] = j, last
                    group[j], size[last] = last, 1
            end = start
            continue
        children: dict[int, int] = {}
        for i in sorted(suffixes[start:end]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                children[j] = children.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in children.items():
            moves.setdefault((times, group[j]), []).append(j)
        # groups are apart from each other; within one, the more members point to a suffix the higher it goes
        for (_, head), members in sorted(moves.items(), reverse=True) if len(moves) > 1 else moves.items():
            rest = size[head] - len(members)
            if not rest:
                continue
            last = head + size[head]
            size[head] = rest
            for j in members:
                last -= 1
                here, other = at[j], suffixes[last]
                suffixes[here], at[other] = other, here
                suffixes[last], at[j] = j, last
            for j in members:
                group[j] = last
            size[last] = len(members)
        end = start
    return group, smaller


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``codes`` in their order; the last value is less than all others."""
    count = len(codes)
    if not count:
        return np.empty(0, np.int64)
    group, smaller = lyndon_groups(codes)
    result = [0] * count
    result[0] = count - 1
    free = list(range(count))
    for s in result:
        j, stop = s - 1, smaller[s]
        while j != stop:
            head = group[j]
            result[free[head]] = j
            free[head] += 1
            j = smaller[j]
    return np.array(result, np.int64)
