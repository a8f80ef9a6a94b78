"""Suffix arrays by linear grouping of Lyndon prefixes, many strings in step.

Phase 1 keeps the suffixes of a string in groups, at first by their first byte. Groups
are processed in descending order. For each member the previous smaller suffix
is the nearest one before it of a lower group; pointers of members processed before
skip what lies between. A suffix that is the previous smaller one of c members
is moved, with those of its group and the same c, to a new group right behind
its old one, a larger c further behind. At the end a group holds the suffixes with
one longest Lyndon prefix, and groups are in order (Baier, 2016).

Phase 2 goes through the result from the smallest suffix on, starting with the
empty one: from the suffix before each, it follows the pointers and gives every
suffix not yet placed the first free place of its group. There is no recursion and
no renaming.

Both phases work on a whole set of strings at a time: each step does the next step
of every string, as operations on arrays.
"""

from __future__ import annotations

import numpy as np


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def lyndon_groups(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, previous smaller suffix) of every suffix; a group is named by its first place."""
    n, lengths = len(data), np.diff(starts)
    key = np.repeat(np.arange(len(lengths)) * 256, lengths) + data
    order = np.argsort(key, kind="stable")
    first = heads(key[order])
    size = np.zeros(n + 1, np.int64)
    size[first] = np.diff(first, append=n)
    group, place = np.empty(n, np.int64), np.empty(n, np.int64)
    group[order] = np.repeat(first, size[first])
    place[order] = np.arange(n)
    previous, moving = np.full(n, -1), np.zeros(n, bool)

    live = np.flatnonzero(lengths)
    top, base = starts[1:][live] - 1, starts[:-1][live]
    while len(top):
        begin = group[order[top]]
        sizes = top - begin + 1
        members = order[ranges(begin, sizes)]
        own, lowest = np.repeat(begin, sizes), np.repeat(base, sizes)

        found = members - 1
        walk = np.flatnonzero(found >= lowest)
        walk = walk[group[found[walk]] > own[walk]]
        while len(walk):
            found[walk] = previous[found[walk]]
            walk = walk[found[walk] >= lowest[walk]]
            walk = walk[group[found[walk]] > own[walk]]
        previous[members] = found
        walk = np.flatnonzero(found >= lowest)
        walk = walk[group[found[walk]] == own[walk]]
        while len(walk):  # pointers inside the group, halved each time
            found[walk] = previous[found[walk]]
            previous[members[walk]] = found[walk]
            walk = walk[found[walk] >= lowest[walk]]
            walk = walk[group[found[walk]] == own[walk]]

        parents = np.sort(found[found >= lowest])
        if len(parents):
            at = heads(parents)
            moved, times = parents[at], np.diff(at, append=len(parents))
            old = group[moved]
            by = np.lexsort((times, old))
            moved, times, old = moved[by], times[by], old[by]
            at = heads(old)
            count = np.diff(at, append=len(old))
            tail = old[at] + size[old[at]] - count
            slots = ranges(tail, count)
            held = order[slots]
            moving[moved] = True
            displaced = held[~moving[held]]
            moving[moved] = False
            was = place[moved]
            holes = np.sort(was[was < np.repeat(tail, count)])
            order[holes], place[displaced] = displaced, holes
            order[slots], place[moved] = moved, slots
            size[old[at]] -= count
            at = heads(old, times)
            count = np.diff(at, append=len(old))
            size[slots[at]] = count
            group[moved] = np.repeat(slots[at], count)

        top = begin - 1
        more = top >= base
        top, base = top[more], base[more]
    return group, previous


def suffix_arrays(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each string ``data[starts[i]:starts[i + 1]]`` its suffixes' places in ``data``, in order.

    ``starts`` ends with ``len(data)``. The order of string i fills the same range.
    """
    group, previous = lyndon_groups(data, starts)
    n = len(data)
    out, free, placed = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
    live = np.flatnonzero(np.diff(starts))
    base, end = starts[:-1][live], starts[1:][live]
    at, read = end - 1, base.copy()  # the empty suffix comes first
    while len(at):
        open_ = at >= base
        open_ &= ~placed[at]
        now = at[open_]
        slot = group[now]
        spot = free[slot]
        out[spot] = now
        free[slot] = spot + 1
        placed[now] = True
        at[open_] = previous[now]
        ahead = np.flatnonzero(~open_)
        done = read[ahead] >= end[ahead]
        ahead = ahead[~done]
        at[ahead] = out[read[ahead]] - 1
        read[ahead] += 1
        if done.any():
            stay = np.ones(len(at), bool)
            stay[np.flatnonzero(~open_)[done]] = False
            at, read, base, end = at[stay], read[stay], base[stay], end[stay]
    return out
