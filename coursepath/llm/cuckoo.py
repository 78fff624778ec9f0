"""A cuckoo filter over 64-bit keys in numpy: like a Bloom filter, but what was inserted can be removed again."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_LOAD = 0.6
_ROUNDS = 2_000


class CuckooFilter:
    """Sixteen-bit fingerprints in buckets of four. Never denies an inserted key; takes about 1 in 8,000 others for one.

    A filter that overflows opens: it then holds every key, which costs look-ups and loses nothing, until it is built anew.
    """

    def __init__(self, table: np.ndarray | None):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 16
        while buckets * SLOTS * _LOAD < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray, room: int = 0) -> CuckooFilter:
        made = cls.sized(max(len(keys), room))
        made.insert(keys)
        return made

    @classmethod
    def read(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy() if data else None)

    def written(self) -> bytes:
        return b"" if self.table is None else self.table.tobytes()

    @property
    def room(self) -> int:
        """Keys that fit without crowding."""
        return 0 if self.table is None else int(len(self.table) * SLOTS * _LOAD)

    def _place(self, keys: np.ndarray):
        bits = keys.astype(np.uint64)
        mark = (bits >> np.uint64(48)).astype(np.uint16)
        return (bits & np.uint64(len(self.table) - 1)).astype(np.int64), np.where(mark == 0, 1, mark).astype(np.uint16)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ ((mark.astype(np.int64) * 0x5BD1E995 >> 7) & (len(self.table) - 1))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.ones(len(keys), bool)
        bucket, mark = self._place(keys)
        at = self.table[bucket] == mark[:, None]
        return at.any(1) | (self.table[self._other(bucket, mark)] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        if self.table is None:
            return
        bucket, mark = self._place(keys)
        rng, moved = np.random.default_rng(len(keys)), np.zeros(len(keys), bool)
        for _ in range(_ROUNDS):
            if not len(bucket):
                return
            _, now = np.unique(bucket, return_index=True)  # one key for a bucket in each round
            empty = self.table[bucket[now]] == 0
            fits, slot = empty.any(1), empty.argmax(1)
            self.table[bucket[now][fits], slot[fits]] = mark[now][fits]
            full = now[~fits]
            again = moved[full]
            out = full[again]
            if len(out):  # both buckets are full: take the place of another mark, which moves on
                seat = rng.integers(0, SLOTS, len(out))
                victim = self.table[bucket[out], seat]
                self.table[bucket[out], seat] = mark[out]
                mark[out] = victim
            bucket[full] = self._other(bucket[full], mark[full])
            moved[full] = True
            left = np.ones(len(bucket), bool)
            left[now[fits]] = False
            bucket, mark, moved = bucket[left], mark[left], moved[left]
        self.table = None

    def remove(self, keys: np.ndarray) -> None:
        """Takes out keys that were inserted. A key that never was may take out another's mark."""
        if self.table is None:
            return
        bucket, mark = self._place(keys)
        left = ~self._taken(bucket, mark)
        self._taken(self._other(bucket[left], mark[left]), mark[left])

    def _taken(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Take each mark out of its bucket; whether it was there."""
        taken, left = np.zeros(len(bucket), bool), np.arange(len(bucket))
        while len(left):
            _, first = np.unique(bucket[left], return_index=True)
            now = left[first]
            at = self.table[bucket[now]] == mark[now][:, None]
            hit = at.any(1)
            self.table[bucket[now][hit], at.argmax(1)[hit]] = 0
            taken[now[hit]] = True
            left = np.delete(left, first)
        return taken
