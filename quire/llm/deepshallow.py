"""Deep-shallow suffix sorting and the repeated windows of one anchor group
(plain Python, run inside Spark tasks on groups of bounded size).

Sorting: multikey quicksort (three-way partitioning by one byte) down to a
shallow depth; the groups that still share a prefix are ordered by a blind
trie, which stores branching depths only and compares whole strings once per
insertion.
"""

from __future__ import annotations

SHALLOW = 8


def lcp(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    difference = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (difference.bit_length() + 7) // 8


class _Node:
    __slots__ = ("children", "depth", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.children = depth, leaf, {}


def _blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """Order strings that share a prefix.  A node keeps the depth at which its
    strings branch, one leaf below it, and children by the branching byte (-1:
    the string ends there).  Equal strings lie in one leaf list."""
    same: dict[int, list[int]] = {members[0]: [members[0]]}
    root = _Node(len(strings[members[0]]), members[0])
    for m in members[1:]:
        s = strings[m]
        node = root
        while node.children:  # blind descent
            child = node.children.get(s[node.depth] if node.depth < len(s) else -1)
            if child is None:
                break
            node = child
        other = strings[node.leaf]
        d = lcp(s, other)
        if d == len(s) == len(other):
            same[node.leaf].append(m)
            continue
        node, parent, edge = root, None, 0
        while node.children and node.depth < d:
            parent, edge = node, s[node.depth] if node.depth < len(s) else -1
            node = node.children[edge]
        byte = s[d] if d < len(s) else -1
        same[m] = [m]
        fresh = _Node(len(s), m)
        if node.children and node.depth == d:
            node.children[byte] = fresh
            continue
        split = _Node(d, m)
        old = strings[node.leaf]
        split.children = {byte: fresh, (old[d] if d < len(old) else -1): node}
        if parent is None:
            root = split
        else:
            parent.children[edge] = split
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.children:
            stack.extend(node.children[b] for b in sorted(node.children, reverse=True))
        else:
            out.extend(same[node.leaf])
    return out


def suffix_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of the strings in byte order."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2:
            out.extend(members)
        elif depth >= shallow:
            out.extend(_blind_trie_order(strings, members))
        else:
            byte = [strings[m][depth] if depth < len(strings[m]) else -1 for m in members]
            pivot = sorted(byte)[len(byte) // 2]
            less = [m for m, b in zip(members, byte) if b < pivot]
            equal = [m for m, b in zip(members, byte) if b == pivot]
            more = [m for m, b in zip(members, byte) if b > pivot]
            if more:
                stack.append((more, depth))
            if pivot < 0:  # they all end here: equal strings
                stack.extend(([m], depth) for m in reversed(equal))
            else:
                stack.append((equal, depth + 1))
            if less:
                stack.append((less, depth))
    return out


def repeated_offsets(lefts: list[bytes], tails: list[bytes], slack: int) -> list[tuple[int, int] | None]:
    """For each member of a group that shares a core: the smallest and largest
    offset at which its window is the same as another member's, or None.

    A window at offset o takes the last o bytes of `left` and the first
    slack - o bytes of `tail`.  Sorting the tails gives intervals of members
    that share r bytes to the right; within one, members that share their last
    slack - r left bytes have a common window."""
    n = len(lefts)
    least: list[int | None] = [None] * n
    most = [-1] * n

    def close(r: int, members: list[int]) -> None:
        need = slack - r
        by_left: dict[bytes, list[int]] = {}
        for m in members:
            left = lefts[m]
            if len(left) >= need:
                by_left.setdefault(left[len(left) - need :], []).append(m)
        for found in by_left.values():
            if len(found) < 2:
                continue
            for m in found:
                if least[m] is None or need < least[m]:
                    least[m] = need
            if all(most[m] == len(lefts[m]) for m in found):
                continue
            backwards = sorted((lefts[m][::-1], m) for m in found)
            for (a, x), (b, y) in zip(backwards, backwards[1:]):
                shared = lcp(a, b)
                if shared > most[x]:
                    most[x] = shared
                if shared > most[y]:
                    most[y] = shared

    order = suffix_order(tails)
    # intervals of equal right extension, innermost first
    stack: list[list[int]] = []  # [r, first position]
    for at in range(1, n + 1):
        r = lcp(tails[order[at - 1]], tails[order[at]]) if at < n else -1
        first = at - 1
        while stack and stack[-1][0] > r:
            depth, first = stack.pop()
            close(depth, order[first:at])
        if r >= 0 and (not stack or stack[-1][0] < r):
            stack.append([r, first])
    return [None if x is None else (x, y) for x, y in zip(least, most)]
