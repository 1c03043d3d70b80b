"""The clustering-feature tree that a worker builds over its group of fingerprints.  NumPy only.

An entry is (n, column sums, members); inner entries summarise a child node.  Items go down to the
entry of the most similar majority bits, merge there if the criterion accepts, else stand beside
it; nodes with more than ``branching`` entries split round their two most dissimilar ones.

Single fingerprints stay packed words until something merges with them.  The sums of an entry's
counts and of their squares are kept as whole numbers, so criteria on iSIM take a product of two
arrays for an insert at most, and none where both sides are single.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .merges import Accept, criterion, sums_criterion

#: Rows that are unpacked at a time.
ROWS = 512


def to_words(bits: np.ndarray) -> np.ndarray:
    """0/1 rows -> uint64 words (any fixed bit order will do for counting)."""
    packed = np.packbits(bits, axis=-1)
    short = -packed.shape[-1] % 8
    if short:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], short), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def to_bits(words: np.ndarray, n_features: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1)[..., :n_features]


def popcount(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


class Entry:
    """n fingerprints: their column sums ``ls`` (of a single one made when asked for), ids, sums of ls and of ls squared."""

    __slots__ = ("_ls", "child", "ids", "n", "n_features", "q", "s", "words")

    def __init__(self, n: int, ls: np.ndarray, ids: list, child: Node | None = None):
        self.n, self._ls, self.ids, self.child = n, ls, ids, child
        self.n_features, self.words = len(ls), None
        self.s = self.q = -1  # counted when needed: inner entries never are

    @classmethod
    def single(cls, words: np.ndarray, card: int, ident, n_features: int) -> Entry:
        e = cls.__new__(cls)
        e.n, e._ls, e.ids, e.child = 1, None, [ident], None
        e.n_features, e.words, e.s, e.q = n_features, words, card, card
        return e

    @property
    def ls(self) -> np.ndarray:
        if self._ls is None:
            self._ls = to_bits(self.words, self.n_features).astype(np.int64)
        return self._ls

    def counted(self) -> tuple[int, int, int]:
        """n, the sum of the column sums and that of their squares."""
        if self.s < 0:
            self.s, self.q = int(self._ls.sum()), int(np.dot(self._ls, self._ls))
        return self.n, self.s, self.q

    def centre(self) -> np.ndarray:
        """Words of the majority bits; half of them is a majority."""
        if self.words is not None:
            return self.words
        return to_words(self._ls >= max(1, (self.n + 1) // 2))

    def copy(self) -> Entry:
        if self.words is not None:
            return Entry.single(self.words, self.s, self.ids[0], self.n_features)
        return Entry(self.n, self._ls.copy(), list(self.ids))


class Node:
    """Up to ``branching`` entries (one more while it overflows), and their centroids side by side."""

    __slots__ = ("after", "before", "branching", "cards", "entries", "words")

    def __init__(self, branching: int, width: int):
        self.branching = branching
        self.entries: list[Entry] = []
        self.words = np.zeros((branching + 1, width), np.uint64)
        self.cards = np.zeros(branching + 1, np.int64)
        self.before: Node | None = None
        self.after: Node | None = None

    def put(self, i: int, words: np.ndarray, card: int | None = None) -> None:
        self.words[i] = words
        self.cards[i] = popcount(words) if card is None else card

    def add(self, e: Entry, words: np.ndarray, card: int | None = None) -> None:
        self.entries.append(e)
        self.put(len(self.entries) - 1, words, card)

    def fill(self, entries: list[Entry], words: np.ndarray, cards: np.ndarray) -> None:
        self.entries = entries
        self.words[: len(entries)] = words
        self.cards[: len(entries)] = cards


class Tree:
    def __init__(self, n_features: int, threshold: float = 0.65, branching: int = 50, merge: str | Accept = "diameter", tolerance: float = 0.05):
        self.n_features, self.width = n_features, (n_features + 63) // 64
        self.set_merge(threshold, branching, merge, tolerance)
        self.reset()

    def reset(self) -> None:
        """Forget everything that was inserted; the settings stay."""
        self.root: Node | None = None
        self.first: Node | None = None  # of the leaves
        self.fitted = 0
        self._both = np.zeros((self.branching + 1, self.width), np.uint64)
        self._counts = np.zeros(self._both.shape, np.uint8)

    def set_merge(self, threshold: float | None = None, branching: int | None = None, merge: str | Accept | None = None, tolerance: float | None = None) -> None:
        """Settings for later inserts; what isn't given stays.  Nodes keep the branching they were made with."""
        self.threshold = self.threshold if threshold is None else threshold
        self.branching = self.branching if branching is None else branching
        self.merge = self.merge if merge is None else merge
        self.tolerance = self.tolerance if tolerance is None else tolerance
        self._accept = criterion(self.merge, self.tolerance)
        self._accept_sums = sums_criterion(self.merge, self.tolerance)

    def insert_words(self, words: np.ndarray, ids: Sequence) -> None:
        """Single fingerprints, rows of words, one id each."""
        for at in range(0, len(words), ROWS):
            rows = words[at : at + ROWS]
            bits = to_bits(rows, self.n_features).astype(np.int64)
            cards = bits.sum(axis=1).tolist()
            for w, b, card, i in zip(rows, bits, cards, ids[at : at + ROWS], strict=True):
                self._insert(Entry.single(w, card, i, self.n_features), w, card, b)

    def insert(self, e: Entry) -> None:
        words = e.centre()
        self._insert(e, words, popcount(words), e.ls)

    def _insert(self, e: Entry, words: np.ndarray, card: int, ls: np.ndarray) -> None:
        self.fitted += e.n
        if self.root is None:
            self.root = self.first = Node(self.branching, self.width)
            self.root.add(e, words, card)
            return
        node, path = self.root, []
        while True:
            i, common = self._nearest(node, words, card)
            best = node.entries[i]
            if best.child is None:
                break
            path.append((node, i))
            node = best.child
        if self._merged(best, e, common, ls):
            node.put(i, best.centre())
        else:
            node.add(e, words, card)
        for parent, i in reversed(path):
            if len(node.entries) > node.branching:
                (one, w1), (two, w2) = self._split(node)
                parent.entries[i] = one
                parent.put(i, w1)
                parent.add(two, w2)
            else:
                over = parent.entries[i]
                over.n += e.n
                over._ls += ls
                parent.put(i, over.centre())
            node = parent
        if len(node.entries) > node.branching:
            halves = self._split(node)
            self.root = Node(self.branching, self.width)
            for half, w in halves:
                self.root.add(half, w)

    def _similarities(self, words: np.ndarray, cards: np.ndarray, probe: np.ndarray, card: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row to the probe, and the bits that both have."""
        k = len(words)
        if k > len(self._both):
            self._both = np.zeros((k, self.width), np.uint64)
            self._counts = np.zeros(self._both.shape, np.uint8)
        both = np.bitwise_and(words, probe, out=self._both[:k])
        common = np.add.reduce(np.bitwise_count(both, out=self._counts[:k]), axis=1, dtype=np.int64)
        either = cards + card
        either -= common
        return common / np.maximum(either, 1, out=either), common

    def _nearest(self, node: Node, words: np.ndarray, card: int) -> tuple[int, int]:
        k = len(node.entries)
        sims, common = self._similarities(node.words[:k], node.cards[:k], words, card)
        i = int(sims.argmax())
        return i, int(common[i])

    def _merged(self, old: Entry, e: Entry, common: int, ls: np.ndarray) -> bool:
        """Merge e into the old entry if the criterion accepts."""
        union = None
        if self._accept_sums is not None:
            (n, s, q), (m, t, r) = old.counted(), e.counted()
            product = common if n == 1 and m == 1 and old.words is not None and e.words is not None else int(np.dot(old.ls, ls))
            union = n + m, s + t, q + 2 * product + r
            if not self._accept_sums(self.threshold, union, (n, s, q), (m, t, r)):
                return False
            new = old.ls + ls if old.words is not None else None
        else:
            new = old.ls + ls
            if not self._accept(self.threshold, new, old.n + e.n, old.ls, ls, old.n, e.n):
                return False
        if new is None:
            old._ls += ls
        else:
            old._ls = new
        old.words = None
        old.n += e.n
        old.s, old.q = union[1:] if union else (-1, -1)
        old.ids.extend(e.ids)
        return True

    def _split(self, node: Node) -> list[tuple[Entry, np.ndarray]]:
        """Two entries over the halves of a node: first that of the new node, then that of the old one."""
        k = len(node.entries)
        words, cards, entries = node.words[:k].copy(), node.cards[:k].copy(), node.entries
        centre = to_words(2 * self._column_sums(words) >= k)
        sims = lambda w, card: self._similarities(words, cards, w, card)[0]
        a = int(sims(centre, popcount(centre)).argmin())
        to_a = sims(words[a], int(cards[a]))
        b = int(to_a.argmin())
        mine = to_a > sims(words[b], int(cards[b]))
        mine[a] = True
        new = Node(node.branching, self.width)
        out = []
        for half, which in ((new, mine), (node, ~mine)):
            at = np.flatnonzero(which)
            half.fill([entries[x] for x in at], words[at], cards[at])
            alone = [x for x in at if entries[x].words is not None]
            ls = self._column_sums(words[alone])
            for e in half.entries:
                if e.words is None:
                    ls += e._ls
            whole = Entry(sum(e.n for e in half.entries), ls, [], half)
            out.append((whole, whole.centre() if half.entries else np.zeros(self.width, np.uint64)))
        if entries[0].child is None:  # leaves are listed in order, the new one just before the old one
            new.before, new.after = node.before, node
            if node.before is not None:
                node.before.after = new
            else:
                self.first = new
            node.before = new
        return out

    def _column_sums(self, words: np.ndarray) -> np.ndarray:
        bits = to_bits(words, self.n_features) if len(words) else np.zeros((0, self.n_features), np.uint8)
        return np.add.reduce(bits, axis=0, dtype=np.uint8 if len(bits) < 256 else np.int64).astype(np.int64)

    def leaves(self) -> list[Entry]:
        out, node = [], self.first
        while node is not None:
            out += node.entries
            node = node.after
        return out

    def clusters(self) -> list[Entry]:
        """Leaf entries, largest first; equals stay in leaf order."""
        return sorted(self.leaves(), key=lambda e: -e.n)


def dtype_rank(n: int) -> int:
    return 8 if n <= 0xFF else 16 if n <= 0xFFFF else 32 if n <= 0xFFFFFFFF else 64


def regrouped(entries: list[Entry]) -> dict[int, list[Entry]]:
    """Entries by the width of their counters, groups in the order of first appearance: the order of a rebuild."""
    out: dict[int, list[Entry]] = {}
    for e in entries:
        out.setdefault(dtype_rank(e.n), []).append(e)
    return out


def exploded(entries: list[Entry], n_largest: int, words_of, n_features: int) -> dict[int, list[Entry]]:
    """The ``n_largest`` first entries taken apart into their fingerprints, after the others of 8-bit counters."""
    groups = regrouped(entries[n_largest:])
    for big in entries[:n_largest]:
        for i, words in zip(big.ids, words_of(big.ids), strict=True):
            groups.setdefault(8, []).append(Entry.single(words, popcount(words), i, n_features))
    return groups


def rebuild(tree: Tree, groups: dict[int, list[Entry]]) -> Tree:
    """A fresh tree of the same settings over the groups' entries, in their order."""
    out = Tree(tree.n_features, tree.threshold, tree.branching, tree.merge, tree.tolerance)
    for part in groups.values():
        for e in part:
            out.insert(e.copy())
    return out
