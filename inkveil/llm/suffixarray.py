"""Linear suffix sorting by groups of Lyndon prefixes.

The Lyndon prefix of a suffix is what precedes the next smaller suffix. Phase 1 groups the suffixes by it:
the groups start as those of equal first symbols and are processed in descending order. A suffix's previous
smaller suffix is found by following previous-smaller pointers over suffixes of higher groups, each of which
is passed once in all; since it continues with one more copy of the group's Lyndon prefix, it moves, with all
that continue with equally many, to a group of its own just above those that continue with fewer. Phase 2
emits the order: going up the sorted suffixes, each fixes the place, at the front of its group, of every
suffix for which it is the next smaller one. There is no recursion and nothing is renamed (Baier,
"Linear-time Suffix Sorting", CPM 2016, gives the idea; this is a design of its own).

Nothing is sorted by comparison: symbols, groups and numbers of copies index lists.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of the suffixes of ``symbols`` in ascending order; symbols are numbers from 0, of the text's size at most or so.

    A suffix that is a prefix of another comes first.
    """
    n = len(symbols)
    if n == 0:
        return []
    # A group's number is the place of its first suffix in the order; groups tile the places, and ``place`` lists
    # their suffixes, in any order inside a group. ``at`` is its inverse.
    size = [0] * n
    ending = [0] * (n + 1)  # past a group's last place -> its number
    counts = [0] * (max(symbols) + 1)
    for s in symbols:
        counts[s] += 1
    first, start = [0] * len(counts), 0
    for s, k in enumerate(counts):
        if k:
            first[s], size[start], ending[start + k] = start, k, start
            start += k
    group = [first[s] for s in symbols]
    group.append(-1)  # of the place before the text, which is below all groups
    place, at = [0] * n, [0] * n
    for i, s in enumerate(symbols):
        at[i] = k = first[s]
        place[k] = i
        first[s] = k + 1
    unknown = -2
    before = [unknown] * n  # previous smaller suffix
    top = n
    while top > 0:
        g = ending[top]
        count: dict[int, int] = {}
        waiting = []
        for t in place[g:top]:
            if before[t] != unknown:
                continue
            # What stands in the way of a suffix, of its own group and not passed yet, is passed first.
            j = t - 1
            while True:
                while group[j] >= g:
                    k = before[j]
                    if k == unknown:
                        waiting.append(t)
                        t, k = j, j - 1
                    j = k
                before[t] = j
                if j >= 0:
                    count[j] = count.get(j, 0) + 1
                if not waiting:
                    break
                t, j = waiting.pop(), t
        top = g
        if not count:
            continue
        # The more copies, the higher the new group within the old one.
        most = max(count.values())
        copies: list[list[int]] = [list(count)] if most == 1 else [[] for _ in range(most)]
        if most > 1:
            for j, k in count.items():
                copies[-k].append(j)
        for some in copies:
            moved: dict[int, int] = {}
            for j in some:
                h = group[j]
                if size[h] == 1:
                    continue
                moved[h] = k = moved.get(h, 0) + 1
                p, q = at[j], h + size[h] - k
                other = place[q]
                place[p], at[other], place[q], at[j] = other, p, j, q
            for h, k in moved.items():
                if k == size[h]:
                    continue
                size[h] -= k
                new = h + size[h]
                size[new], ending[new + k], ending[new] = k, new, h
                for q in range(new, new + k):
                    group[place[q]] = new
    # Phase 2: the empty suffix comes first of all.
    order = [0] * n
    free = list(range(n))
    for i in range(-1, n):
        s = order[i] if i >= 0 else n
        stop = before[s] if i >= 0 else -1
        x = s - 1
        while x != stop:
            h = group[x]
            order[free[h]] = x
            free[h] += 1
            x = before[x]
    return order
