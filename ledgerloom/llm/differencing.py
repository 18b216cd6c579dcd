"""Karmarkar-Karp multiway differencing of piece lengths into windows of bounded length."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heapify, heappop, heappush


def _leaves(tree, out: list) -> None:
    stack = [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += x
        else:
            out.append(x)


def _merged(low: list, sets: list, keys: list, others: list, ahead: bool) -> None:
    """Lay ``keys`` with their sets into ``low`` and its sets, before equal ones if ``ahead``, else after them."""
    if 16 * len(keys) > len(low):
        all_keys, all_sets = (keys + low, others + sets) if ahead else (low + keys, sets + others)
        order = sorted(range(len(all_keys)), key=all_keys.__getitem__)
        low[:], sets[:] = [all_keys[i] for i in order], [all_sets[i] for i in order]
        return
    for k, s in zip(reversed(keys), reversed(others), strict=True) if ahead else zip(keys, others, strict=True):
        at = bisect_left(low, k) if ahead else bisect_right(low, k)
        low.insert(at, k)
        sets.insert(at, s)


def partition(sizes: list[int], ways: int) -> tuple[list[int], list]:
    """Sums, largest first, and members of ``ways`` sets: merge, again and again, the two partial partitions of
    largest spread, laying the largest sets of one on the smallest of the other.

    A partial partition is a list of negated sums in ascending order beside its sets; the sets of the smaller one
    are laid into the larger one's list, so a single piece costs a search and not a pass over all sets.
    """
    heap = [(-s, i, [-s], [i]) for i, s in enumerate(sizes)]
    heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, sums_a, sets_a = heappop(heap)
        _, _, sums_b, sets_b = heappop(heap)
        over = max(0, len(sums_a) + len(sums_b) - ways)  # sets of a that meet a set of b: its smallest, against the largest of b
        met, met_sets = [], []
        if over:
            met = [x + y for x, y in zip(sums_a[-over:], reversed(sums_b[-over:]), strict=True)]
            met_sets = list(zip(sets_a[-over:], reversed(sets_b[-over:]), strict=True))
            del sums_a[-over:], sums_b[-over:], sets_a[-over:], sets_b[-over:]
        # The order among equal sums is: what a has kept, what has met, what b has kept.
        if len(sums_a) >= len(sums_b):
            _merged(sums_a, sets_a, met + sums_b, met_sets + sets_b, False)
            sums, sets = sums_a, sets_a
        else:
            _merged(sums_b, sets_b, sums_a + met, sets_a + met_sets, True)
            sums, sets = sums_b, sets_b
        heappush(heap, (sums[0] - (sums[-1] if len(sums) == ways else 0), serial, sums, sets))
        serial += 1
    return ([-s for s in heap[0][2]], heap[0][3]) if heap else ([], [])


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``: as few as the total needs, and more whenever one is exceeded."""
    if not sizes:
        return []
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        sums, sets = partition(sizes, ways)
        most = sums[0]
        if most <= capacity:
            out = []
            for tree in sets:
                out.append([])
                _leaves(tree, out[-1])
                out[-1].sort()
            return out
        ways = max(ways + 1, ways + (most - capacity) * ways // (24 * capacity))
