"""Deep-shallow sorting of byte strings, with the lengths of common prefixes.

Shallow: multikey quicksort on symbols of eight bytes, one symbol of every open group per round, to
a fixed depth. Deep: the strings of a group that still agree there go into a blind trie, which
branches only where two of them differ, so a string is compared at the branching places and then
once with the string it ends at; reading the trie in order sorts the group.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Inner nodes are [depth, {symbol: child}], leaves lists of string numbers. The end of a
    string is symbol -1, so a prefix sorts first."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.root = strings, None

    def _symbol(self, text: bytes, at: int) -> int:
        return text[at] if at < len(text) else -1

    def _leaf(self, node) -> int:
        while not isinstance(node, _Leaf):
            node = next(iter(node[1].values()))
        return node[0]

    def insert(self, number: int) -> None:
        text = self.strings[number]
        if self.root is None:
            self.root = _Leaf([number])
            return
        node = self.root
        while not isinstance(node, _Leaf):  # blind: only the branching places are looked at
            child = node[1].get(self._symbol(text, node[0]))
            if child is None:
                break
            node = child
        other = self.strings[self._leaf(node)]
        depth = common_prefix(text, other)
        if depth == len(text) == len(other):
            node = self.root
            while not isinstance(node, _Leaf):
                node = node[1][self._symbol(text, node[0])]
            node.append(number)
            return
        parent, node = None, self.root
        while not isinstance(node, _Leaf) and node[0] < depth:
            parent, node = node, node[1][self._symbol(text, node[0])]
        leaf = _Leaf([number])
        if not isinstance(node, _Leaf) and node[0] == depth:
            node[1][self._symbol(text, depth)] = leaf
            return
        fork = [depth, {self._symbol(other, depth): node, self._symbol(text, depth): leaf}]
        if parent is None:
            self.root = fork
        else:
            parent[1][self._symbol(text, parent[0])] = fork

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, _Leaf):
                out.extend(node)
            else:
                stack.extend(child for _, child in sorted(node[1].items(), key=lambda x: -x[0]))
        return out


class _Leaf(list):
    """Numbers of equal strings."""


def deep_shallow_order(strings: list[bytes], groups: np.ndarray) -> np.ndarray:
    """Order by group and then by string; ties by number."""
    n = len(strings)
    heads = np.zeros((n, SHALLOW), np.uint8)
    for i, s in enumerate(strings):
        head = s[:SHALLOW]
        heads[i, :len(head)] = np.frombuffer(head, np.uint8)
    symbols = heads.view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    ranks = groups[order]
    for k in range(symbols.shape[1]):
        by = np.lexsort((symbols[order, k], ranks))
        order, ranks = order[by], ranks[by]
        new = np.concatenate([[False], (ranks[1:] != ranks[:-1]) | (symbols[order[1:], k] != symbols[order[:-1], k])])
        ranks = np.cumsum(new)
    starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])) if n else np.empty(0, np.int64)
    ends = np.append(starts[1:], n)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s > 1:
            trie = BlindTrie(strings)
            for number in sorted(order[s:e].tolist()):
                trie.insert(number)
            order[s:e] = trie.ordered()
    return order


def neighbour_prefixes(strings: list[bytes], groups: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each string in order with the one before; -1 at the start of a group."""
    out = np.full(len(order), -1, np.int64)
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        if groups[i] == groups[j]:
            out[k] = common_prefix(strings[i], strings[j])
    return out
