"""Pair merging with a segment tree over byte positions, for one piece or for many at a time.

Leaf i of a piece's tree holds rank * size + i for the token that starts at byte i and its right
neighbour, or NONE. The root is then the leftmost of the pairs of least rank. A merge changes the
leaves of the merged token, of its left neighbour and of the token that went, and mends the paths
above those. Short pieces of about equal length go through this together, each numpy operation
serving one node of every tree.
"""

from __future__ import annotations

import numpy as np

NONE = 2**31 - 1
#: Leaves of the trees that are worked on together; longer pieces are merged one by one.
WIDTHS = (4, 8, 16, 32, 64)


class PairMerger:
    """pairs: (left id, right id) to (rank, merged id). Ids are below 65,536.

    first: the id of each byte. final: the same for the last byte of a piece, where that differs.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], first: list[int], final: list[int] | None = None, dtype: str = "<u4"):
        self.rank = {a << 16 | b: rank for (a, b), (rank, _) in pairs.items()}
        self.merged = {rank: token for rank, token in pairs.values()}
        self.dtype = np.dtype(dtype)
        keys = np.fromiter(self.rank, np.uint32, len(self.rank))
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.uint32(2**32 - 1))
        self._ranks = np.append(np.fromiter(self.rank.values(), np.int32, len(self.rank))[order], np.int32(NONE))
        self._merged = np.zeros(max(self.merged, default=0) + 1, np.int64)
        for rank, token in self.merged.items():
            self._merged[rank] = token
        self._first = np.array(first, np.int64)
        self._final = self._first if final is None else np.array(final, np.int64)
        inner = self._find((self._first[:, None] << 16 | self._first[None, :]).ravel()).reshape(256, 256)
        last = self._find((self._first[:, None] << 16 | self._final[None, :]).ravel()).reshape(256, 256)
        self._start, self._start_final = inner, last

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._keys, keys.astype(np.uint32))
        return np.where(self._keys[at] == keys, self._ranks[at], NONE)

    def one(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n, size, rank_of = len(piece), 1, self.rank.get
        if not n:
            return []
        while size < n:
            size *= 2
        token = [int(self._first[b]) for b in piece]
        token[-1] = int(self._final[piece[-1]])
        tree = [NONE << 32] * (2 * size)
        for i in range(n - 1):
            if (rank := rank_of(token[i] << 16 | token[i + 1])) is not None:
                tree[size + i] = rank * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(leaf: int, key: int) -> None:
            k = size + leaf
            tree[k] = key
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def key(i: int, j: int) -> int:
            rank = rank_of(token[i] << 16 | token[j])
            return NONE << 32 if rank is None else rank * size + i

        while (least := tree[1]) < NONE << 32:
            i = least % size
            gone = after[i]
            stop = after[i] = after[gone]
            before[stop] = i
            token[i] = self.merged[least // size]
            put(gone, NONE << 32)
            put(i, key(i, stop) if stop < n else NONE << 32)
            if (left := before[i]) >= 0:
                put(left, key(left, i))
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return out

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for width in WIDTHS:
            where = np.flatnonzero((lengths > low) & (lengths <= width))
            if len(where):
                self._together([pieces[i] for i in where], lengths[where], width, where, out)
            low = width
        for i in np.flatnonzero(lengths > low):
            out[i] = np.array(self.one(pieces[i]), self.dtype).tobytes()
        return out

    def _together(self, pieces: list[bytes], n: np.ndarray, width: int, where: np.ndarray, out: list[bytes]) -> None:
        rows = len(pieces)
        letters = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(rows, width)
        every, spot = np.arange(rows), np.arange(width)
        live = spot < n[:, None]
        token = self._first[letters]
        token[every, n - 1] = self._final[letters[every, n - 1]]
        tree = np.full((rows, 2 * width), NONE, np.int32)
        start = self._start[letters[:, :-1], letters[:, 1:]]
        two = n > 1
        start[every[two], n[two] - 2] = self._start_final[letters[every[two], n[two] - 2], letters[every[two], n[two] - 1]]
        leaf = np.where((start != NONE) & live[:, 1:], start * width + spot[:-1], NONE)
        tree[:, width : 2 * width - 1] = leaf
        half = width
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        after = np.broadcast_to(spot + 1, (rows, width)).copy()
        before = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy()
        at = np.flatnonzero(tree[:, 1] != NONE)
        flat_tree, flat_token, flat_after, flat_before = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
        while len(at):
            root = flat_tree[at * (2 * width) + 1].astype(np.int64)
            i, base = root % width, at * width
            merged = self._merged[root // width]
            gone = flat_after[base + i]
            stop = flat_after[base + gone]
            flat_after[base + i] = stop
            flat_before[at * (width + 1) + stop] = i
            flat_token[base + i] = merged
            live[at, gone] = False
            right = self._find(merged << 16 | flat_token[base + np.minimum(stop, width - 1)])
            right = np.where((stop < n[at]) & (right != NONE), right * width + i, NONE)
            left_at = flat_before[at * (width + 1) + i]
            left = self._find(flat_token[base + np.maximum(left_at, 0)] << 16 | merged)
            left = np.where(left != NONE, left * width + left_at, NONE)
            root_at = at * (2 * width)
            #: Slot 0 of a tree is unused: what has no left neighbour writes there.
            nodes = np.stack([width + gone, width + i, np.where(left_at >= 0, width + left_at, 0)])
            flat_tree[root_at + nodes[0]] = NONE
            flat_tree[root_at + nodes[1]] = right
            flat_tree[root_at + nodes[2]] = left
            up = width
            while up > 1:
                nodes >>= 1
                up >>= 1
                below = root_at + 2 * nodes
                flat_tree[root_at + nodes] = np.minimum(flat_tree[below], flat_tree[below + 1])
            flat_tree[root_at] = NONE
            at = at[flat_tree[root_at + 1] != NONE]
        packed = token[live].astype(self.dtype).tobytes()
        ends = np.cumsum(live.sum(1)) * self.dtype.itemsize
        begin = 0
        for k, end in zip(where.tolist(), ends.tolist(), strict=True):
            out[k] = packed[begin:end]
            begin = end
