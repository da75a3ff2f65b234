"""Suffix arrays by linear grouping, and the longest repeats that they show."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Positions of all suffixes of ``text`` in ascending order.

    ``text`` holds small non-negative integers and ends with a symbol that occurs nowhere else and is the least.

    Suffixes start in groups by their first symbol. The groups are taken in descending order. For each suffix of a group
    the pointer to the previous suffix in a lower group is found; the suffixes pointed to now share the group's string
    as their continuation, so they move, those with more pointers first, to new groups just above the rest of theirs. When
    all groups are done, every group holds the suffixes that start with one Lyndon word. The second pass fills the order
    from the least suffix up: each entry places its left neighbour, and what the pointers chain from it, at the front of
    the group it belongs to. No symbols are renamed and nothing recurs.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # of each suffix in `order`
    group = [0] * n  # each suffix's group, named by its first place
    end: dict[int, int] = {}  # a group's past-the-end place
    start = 0
    for i, s in enumerate(order):
        if i and text[s] != text[order[i - 1]]:
            end[start] = i
            start = i
        place[s], group[s] = i, start
    end[start] = n
    previous = [-1] * n
    high = n
    while high > 0:
        low = group[order[high - 1]]
        members = order[low:high] if high - low == 1 else sorted(order[low:high])
        high = low
        count: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= low:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if not count:
            continue
        by_count: dict[int, list[int]] = {}
        for p, c in count.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}  # group: how many of it move
            for p in by_count[c]:
                g = group[p]
                k = moved.get(g, 0) + 1
                moved[g] = k
                # Swap to the end of its group, before those that have moved already.
                to, at = end[g] - k, place[p]
                other = order[to]
                order[at], order[to] = other, p
                place[other], place[p] = at, to
            for g, k in moved.items():
                top = end[g]
                first = top - k
                if first == g:
                    continue
                end[g], end[first] = first, top
                for s in order[first:top]:
                    group[s] = first
    # `group` is final; a group's front moves on as its suffixes are placed.
    front = {g: g for g in set(group)}
    done = bytearray(n)
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = 1
    front[group[n - 1]] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            done[s] = 1
            s = previous[s]
    return out


def _in_order(text: list[int]) -> tuple[list[int], list[int]]:
    """All suffixes in ascending order, and how many first symbols each shares with the one before it there."""
    n = len(text)
    order = suffix_array(text)
    rank = [0] * n
    for i, s in enumerate(order):
        rank[s] = i
    common = [0] * n
    k = 0
    for s in range(n):
        r = rank[s]
        if r == 0:
            k = 0
            continue
        other = order[r - 1]
        while text[s + k] == text[other + k]:
            k += 1
        common[r] = k
        if k:
            k -= 1
    return order, common


def longest_repeats(text: list[int], owner: list[int] | None = None) -> list[int]:
    """For each suffix how many of its first symbols also start another suffix, at most.

    With ``owner``, the other suffix must start at a place with another owner.
    """
    n = len(text)
    order, common = _in_order(text)
    longest = [0] * n
    for ranks, step in ((range(1, n), 1), (range(n - 2, -1, -1), -1)):
        best = 0
        for r in ranks:
            shared = common[r] if step > 0 else common[r + 1]
            if owner is None or owner[order[r]] != owner[order[r - step]] or shared < best:
                best = shared
            s = order[r]
            if best > longest[s]:
                longest[s] = best
    return longest


def owners_of_runs(text: list[int], owner: list[int], length: int) -> list[int]:
    """For each suffix how many owners have suffixes with its first ``length`` symbols, its own included."""
    n = len(text)
    order, common = _in_order(text)
    out = [0] * n
    first = 0
    for r in range(1, n + 1):
        if r == n or common[r] < length:
            owners = len({owner[s] for s in order[first:r]})
            for s in order[first:r]:
                out[s] = owners
            first = r
    return out
