"""Suffix arrays by linear grouping."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes of a text of small non-negative integers (or bytes) in ascending order; the end of the text sorts first and is left out.

    Nothing is sorted but the letters, by counting. Phase 1 visits groups of suffixes with equal context in descending order. For each member it finds the nearest place
    before it in a lower group (the previous smaller one, along pointers of places already visited); such a place's context grows by
    the group's, once for each member that it precedes, so it moves, by that count, into a new group right above its own. What results
    are the groups of suffixes by longest Lyndon prefix. Phase 2 goes over the array in ascending order: what precedes a placed
    suffix, and the chain of previous smaller places from there, takes the next free slots of their groups.
    """
    n = len(text)
    if not n:
        return []
    letters = max(text) + 1
    counts = [0] * letters
    for c in text:
        counts[c] += 1
    starts = [0] * letters
    at = 0
    for c in range(letters):
        starts[c] = at
        at += counts[c]
    order, slot, group = [0] * n, [0] * n, [0] * n
    fill = starts[:]
    for i, c in enumerate(text):
        k = fill[c]
        fill[c] = k + 1
        order[k], slot[i], group[i] = i, k, starts[c]
    size = [0] * n  # by first slot of a group
    for c in range(letters):
        if counts[c]:
            size[starts[c]] = counts[c]
    before = [-1] * n

    end = n
    while end:
        first = group[order[end - 1]]
        if first == end - 1:  # a single member
            p = order[first] - 1
            while p >= 0 and group[p] > first:
                p = before[p]
            before[order[first]] = p
            if p >= 0:
                g = group[p]
                m = size[g] - 1
                if m:  # else it is alone in its group already
                    k, last = slot[p], g + m
                    q = order[last]
                    order[k], order[last], slot[q], slot[p] = q, p, k, last
                    group[p], size[g], size[last] = last, m, 1
            end = first
            continue
        inside: dict[int, int] = {}  # members whose nearest such place is a member
        for s in order[first:end]:
            p = s - 1
            while p >= 0 and group[p] > first:
                p = before[p]
            if p >= 0 and group[p] == first:
                inside[s] = p
            else:
                before[s] = p
        for s in list(inside):  # along chains of members, each once
            chain = []
            while s in inside:
                chain.append(s)
                s = inside[s]
            for member in chain:
                before[member] = before[s]
                del inside[member]
        times: dict[int, int] = {}
        for s in order[first:end]:
            p = before[s]
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by_times: list[list[int]] = [[] for _ in range(max(times.values(), default=0) + 1)]
        for p, t in times.items():
            by_times[t].append(p)
        moved: dict[int, list[int]] = {}
        for places in reversed(by_times):
            for p in places:
                moved.setdefault(group[p], []).append(p)
        for g, members in moved.items():
            i = 0
            while i < len(members):
                t, j = times[members[i]], i
                m = size[g]
                while j < len(members) and times[members[j]] == t:
                    p = members[j]
                    m -= 1
                    k, last = slot[p], g + m
                    q = order[last]
                    order[k], order[last], slot[q], slot[p] = q, p, k, last
                    j += 1
                if m:  # the rest of the group stays below
                    new = g + m
                    for p in members[i:j]:
                        group[p] = new
                    size[new] = j - i
                    size[g] = m
                i = j
        end = first

    out, used, placed = [-1] * n, [0] * n, bytearray(n)

    def place(p: int) -> None:
        while p >= 0 and not placed[p]:
            g = group[p]
            out[g + used[g]] = p
            used[g] += 1
            placed[p] = 1
            p = before[p]

    place(n - 1)
    for i in range(n):
        place(out[i] - 1)
    return out
