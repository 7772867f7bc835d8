"""A signature tree over sets of 64-bit tokens, and the linked groups and all links that its dual traversal finds.

A set's signature is a bitmap with a bit for each token. Sets are put in order of size; FAN of them form a node, FAN nodes a node of the next level. A node holds the OR of its sets' bitmaps, their smallest and largest size and fewest bits, and the most tokens that a set has beyond its bits.
A pair of nodes is pruned if their sizes are too far apart, or if no set of one can share enough tokens with a set of the other: at most the bits that both bitmaps have, and the tokens beyond a set's bits. Pairs of sets that stay are compared token by token.
"""

from __future__ import annotations

import numpy as np

FAN = 16
#: Tokens of two leaves that are compared as matrices at most, and open pairs from which on that pays.
TILE_TOKENS, TILE_PAIRS = 1 << 17, 6


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common tokens of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


class SignatureTree:
    """sets: sorted arrays of distinct uint64, none empty. Two sets link if den * shared >= num * union."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0])))
        self.sets, self.num, self.den = [sets[i] for i in self.order], num, den
        size = np.array([len(s) for s in self.sets], np.int64)
        bits = 256
        while bits < min(65536, 2 * (size.mean() if len(size) else 0)):
            bits *= 2
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for k, s in enumerate(self.sets):
            flat = np.zeros(bits, np.uint8)
            flat[(s >> np.uint64(17)) & np.uint64(bits - 1)] = 1
            maps[k] = np.packbits(flat).view(np.uint64)
        pop = np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [{"or": maps, "low": size, "high": size, "pop": pop, "over": size - pop}]
        while len(self.levels[-1]["low"]) > 1:
            x = self.levels[-1]
            at = np.arange(0, len(x["low"]), FAN)
            self.levels.append({"or": np.bitwise_or.reduceat(x["or"], at), "low": np.minimum.reduceat(x["low"], at), "high": np.maximum.reduceat(x["high"], at), "pop": np.minimum.reduceat(x["pop"], at), "over": np.maximum.reduceat(x["over"], at)})
        self.alike: list[list[bool]] = [[k == 0] * len(x["low"]) for k, x in enumerate(self.levels)]
        self.forest = Forest(len(sets))
        self.compared = self.seen = 0

    def _children(self, level: int, i: int) -> range:
        return range(i * FAN, min((i + 1) * FAN, len(self.levels[level - 1]["low"])))

    def _group(self, level: int, i: int) -> int | None:
        """The group of all sets of a node, None if they are in more than one. Once alike, they stay so."""
        if not self.alike[level][i]:
            first = None
            for c in self._children(level, i):
                g = self._group(level - 1, c)
                if g is None or (first is not None and g != first):
                    return None
                first = g
            self.alike[level][i] = True
        return self.forest.root(i * FAN**level)

    def _open_pairs(self, level: int, rows: range, columns: range) -> np.ndarray:
        """Which pairs of a level's nodes may hold a link."""
        x, num, den = self.levels[level], self.num, self.den
        r, c = slice(rows.start, rows.stop), slice(columns.start, columns.stop)
        ok = (den * x["high"][r, None] >= num * x["low"][None, c]) & (den * x["high"][None, c] >= num * x["low"][r, None])
        if not ok.any():
            return ok
        both = np.bitwise_count(x["or"][r, None] & x["or"][None, c]).sum(2, dtype=np.int64)
        most = both + np.minimum(x["over"][r, None], x["over"][None, c]) if level == 0 else both + np.maximum(x["over"][r, None], x["over"][None, c])
        return ok & ((den + num) * most >= num * (x["low"][r, None] + x["low"][None, c]))

    def groups(self) -> np.ndarray:
        """A number for each of the sets as given; linked sets, directly or over others, have the same."""
        if not self.sets:
            return np.zeros(0, np.int64)
        top = len(self.levels) - 1
        stack = [(top, 0, 0)] if top else []
        while stack:
            level, i, j = stack.pop()
            self.seen += 1
            a, b = self._group(level, i), self._group(level, j)
            if a is not None and a == b:
                continue
            rows, columns = self._children(level, i), self._children(level, j)
            open_ = np.argwhere(self._open_pairs(level - 1, rows, columns)).tolist()
            pairs = [(rows[x], columns[y]) for x, y in open_ if rows[x] < columns[y] or (level > 1 and rows[x] == columns[y])]
            if level > 1:
                pairs.sort(key=lambda p: p[0] == p[1])  # nodes with themselves come off the stack first
                stack += [(level - 1, x, y) for x, y in pairs]
                continue
            for x, y in pairs:
                if self.forest.root(x) != self.forest.root(y):
                    self.compared += 1
                    p, q = self.sets[x], self.sets[y]
                    n = shared(p, q)
                    if self.den * n >= self.num * (len(p) + len(q) - n):
                        self.forest.join(x, y)
        return self.joined()

    def _shared(self, rows: range, columns: range, open_: np.ndarray) -> np.ndarray:
        """Common tokens of the open pairs of two leaves' sets."""
        sets = [self.sets[k] for k in (*rows, *columns)]
        if np.count_nonzero(open_) < TILE_PAIRS or sum(map(len, sets)) > TILE_TOKENS:
            out = np.zeros(open_.shape, np.int64)
            for x, y in np.argwhere(open_).tolist():
                out[x, y] = shared(self.sets[rows[x]], self.sets[columns[y]])
            return out
        names, number = np.unique(np.concatenate(sets), return_inverse=True)
        has = np.zeros((len(sets), len(names)), np.float32)  # counts below 2**24 are exact
        has[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), number] = 1
        return (has[: len(rows)] @ has[len(rows) :].T).astype(np.int64)

    def links(self, side: np.ndarray | None = None):
        """All links, leaf by leaf, as (i, j, shared) arrays of the sets' places as given; each link once. With side, only those between sets whose sides differ. joined() has the groups that they make."""
        order, size = np.array(self.order, np.int64), self.levels[0]["low"]
        side = None if side is None else np.asarray(side)[order]
        top = len(self.levels) - 1
        stack = [(top, 0, 0)] if top else []
        while stack:
            level, i, j = stack.pop()
            rows, columns = self._children(level, i), self._children(level, j)
            open_ = self._open_pairs(level - 1, rows, columns)
            if level > 1:
                stack += [(level - 1, rows[x], columns[y]) for x, y in np.argwhere(open_).tolist() if rows[x] <= columns[y]]
                continue
            r, c = np.arange(rows.start, rows.stop), np.arange(columns.start, columns.stop)
            open_ &= r[:, None] < c[None, :]
            if side is not None:
                open_ &= side[r][:, None] != side[c][None, :]
            if not open_.any():
                continue
            n = self._shared(rows, columns, open_)
            x, y = np.nonzero(open_ & (self.den * n >= self.num * (size[r][:, None] + size[c][None, :] - n)))
            if not len(x):
                continue
            root = np.array([self.forest.root(int(k)) for k in (*r, *c)])
            new = root[x] != root[len(r) + y]
            for a, b in zip(r[x[new]].tolist(), c[y[new]].tolist()):
                self.forest.join(a, b)
            yield order[r[x]], order[c[y]], n[x, y]

    def joined(self) -> np.ndarray:
        """As groups(), by the links that were taken so far."""
        out = np.empty(len(self.sets), np.int64)
        out[self.order] = [self.forest.root(i) for i in range(len(self.sets))]
        return out
