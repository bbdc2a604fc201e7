"""Linear suffix sorting by grouping, over many short texts at once.

A suffix's Lyndon prefix is the longest Lyndon word that starts it; it ends where the next smaller suffix starts. Phase one groups suffixes by Lyndon prefix, the groups in order:
they start as groups of one character each and are processed from the highest down. For each member of a group, the nearest earlier suffix of a lower group (its previous smaller
one) has a Lyndon prefix that goes on with this group's; those that are named by l members leave their group for a new one right above it, higher for larger l. Phase two
emits the suffixes in order: each emitted suffix puts the one before it, and that one's chain of previous smaller suffixes as far as they aren't placed, at the next free
place of their groups. Nothing is renamed and nothing recurs.

The texts of a batch take each step together, as vectors: a step of phase one takes the highest group that is left in each text, a step of phase two emits one suffix of each. So the work is
linear in the texts and the number of steps is that of the longest one; texts of like length should share a batch.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of sizes[0] items, then those of the next."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))


def suffix_order(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of all texts' suffixes, text after text, in order within each. Texts stand one after the other in `symbols` from `starts`; each must end with a symbol below all its others."""
    n, count = len(symbols), len(starts)
    ends = np.append(starts[1:], n)
    owner = np.repeat(np.arange(count), ends - starts)
    order = np.lexsort((symbols, owner)).astype(np.int64)
    # place 0 is a guard below all keys: keys are places, so those of earlier texts are below a text's own
    at = np.empty(n + 1, np.int64)
    at[order + 1] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    heads = np.flatnonzero(fresh)
    key = np.empty(n + 1, np.int64)
    key[0] = -1
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    key[order + 1] = np.repeat(heads, size[heads])
    held = order + 1  # suffixes by place, numbered from 1
    smaller = np.zeros(n + 1, np.int64)
    moving = np.zeros(n + 1, bool)
    floor, top = starts.copy(), ends.copy()

    while len(top):
        low = key[held[top - 1]]
        members = held[_ranges(low, top - low)]
        keys = np.repeat(low, top - low)
        first = np.repeat(floor, top - low)
        near = members - 1
        smaller[members] = near
        wait = np.flatnonzero(key[near] >= keys)
        while len(wait):
            own = members[wait]
            smaller[own] = smaller[smaller[own]]
            wait = wait[key[smaller[own]] >= keys[wait]]
        near = smaller[members]
        near = near[near > first]  # the text's own
        if len(near):
            near = np.sort(near)
            cut = np.flatnonzero(np.append(True, near[1:] != near[:-1]))
            parents, times = near[cut], np.diff(np.append(cut, len(near)))
            rank = np.lexsort((times, key[parents]))
            parents, times = parents[rank], times[rank]
            group = key[parents]
            head = np.append(True, group[1:] != group[:-1])
            begin = np.flatnonzero(head)
            many = np.diff(np.append(begin, len(group)))
            of = group[begin]
            slots = _ranges(of + size[of] - many, many)
            moving[parents] = True
            there = held[slots]
            out = there[~moving[there]]
            moving[parents] = False
            old = at[parents]
            tail = np.repeat(of + size[of] - many, many)
            gap = old[old < tail]  # places that are left, group by group, as many as are to be filled
            held[gap], at[out] = out, gap
            held[slots], at[parents] = parents, slots
            size[of] -= many
            new = np.flatnonzero(head | np.append(True, times[1:] != times[:-1]))
            sizes = np.diff(np.append(new, len(group)))
            key[parents] = np.repeat(slots[new], sizes)
            size[slots[new]] = sizes
        open_ = low > floor
        top, floor = low[open_], floor[open_]

    free = key.copy()  # the next free place of a group, at its first place
    free[:n] = np.arange(n)
    out, placed = np.zeros(n, np.int64), np.zeros(n + 1, bool)
    placed[0] = True
    out[starts], placed[ends] = ends, True
    step, alive, limit = 0, np.arange(count), ends - starts
    while len(alive):
        first = starts[alive]
        j = out[first + step] - 1
        while True:
            go = (j > first) & ~placed[j]
            if not go.all():
                j, first = j[go], first[go]
            if not len(j):
                break
            slot = free[key[j]]
            out[slot] = j
            free[key[j]] += 1
            placed[j] = True
            j = smaller[j]
        step += 1
        alive = alive[limit[alive] > step]
    return out - 1
