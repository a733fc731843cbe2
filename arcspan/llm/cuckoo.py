"""A cuckoo filter: membership of 64-bit hashes in two bytes each, with insertion and deletion."""

from __future__ import annotations

import struct

import numpy as np

#: Fingerprints of a bucket; share of slots that are filled at most; rounds of kicks before a hash goes to the stash; bytes before the table.
SLOTS, LOAD, KICKS, HEAD = 4, 0.85, 200, 24


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def buckets_for(keys: int) -> int:
    """The smallest power of two of buckets that holds so many keys."""
    out = 1
    while out * SLOTS * LOAD < keys:
        out *= 2
    return out


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each hash has two buckets, and either tells the other.

    Every hash must be inserted once at most and deleted only if it is in; then no lookup of a
    held hash fails, and one of another succeeds with a chance of about 8 in 65,535. Fingerprints
    that find no place after many kicks wait in a stash, so insertion never fails.
    """

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: np.ndarray | None = None, held: int = 0):
        self.buckets, self.held = buckets, held
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.stash = np.zeros(0, np.uint64) if stash is None else stash

    def to_bytes(self) -> bytes:
        return struct.pack("<qqq", self.buckets, len(self.stash), self.held) + self.table.tobytes() + self.stash.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, stash, held = struct.unpack_from("<qqq", data)
        table = np.frombuffer(data, "<u2", buckets * SLOTS, HEAD).reshape(buckets, SLOTS).copy()
        return cls(buckets, table, np.frombuffer(data, "<u8", stash, HEAD + table.nbytes).copy(), held)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mix(hashes)
        marks = np.maximum(mixed >> np.uint64(48), np.uint64(1)).astype(np.uint16)  # 0 is a free slot
        return marks, (mixed & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, marks: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(marks.astype(np.uint64) + np.uint64(1)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be in."""
        marks, one = self._places(hashes)
        two = self._other(marks, one)
        found = (self.table[one] == marks[:, None]).any(1) | (self.table[two] == marks[:, None]).any(1)
        return found | np.isin(self._code(marks, one), self.stash) if len(self.stash) else found

    def _code(self, marks: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """A fingerprint and the smaller of its two buckets."""
        return marks.astype(np.uint64) << np.uint64(48) | np.minimum(bucket, self._other(marks, bucket)).astype(np.uint64)

    def _fill(self, marks: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets; whether each found one."""
        order = np.argsort(bucket, kind="stable")
        at = bucket[order]
        new = np.concatenate([[True], at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]  # the marks of one bucket take turns
        free = np.cumsum(self.table[at] == 0, axis=1)
        fits = free[:, -1] > rank
        slot = (free == (rank + 1)[:, None]).argmax(1)
        self.table[at[fits], slot[fits]] = marks[order][fits]
        out = np.zeros(len(marks), bool)
        out[order] = fits
        return out

    def insert(self, hashes: np.ndarray) -> None:
        """Add distinct hashes that are not in."""
        if not len(hashes):
            return
        self.held += len(hashes)
        marks, bucket = self._places(hashes)
        left = ~self._fill(marks, bucket)
        marks, bucket = marks[left], self._other(marks[left], bucket[left])
        for turn in range(KICKS):
            if not len(marks):
                return
            left = ~self._fill(marks, bucket)
            marks, bucket = marks[left], bucket[left]
            _, one = np.unique(bucket, return_index=True)  # one kick a bucket and turn
            slot = (one + turn) % SLOTS
            victims = self.table[bucket[one], slot]
            self.table[bucket[one], slot] = marks[one]
            marks[one] = victims
            bucket[one] = self._other(victims, bucket[one])
        self.stash = np.append(self.stash, self._code(marks, bucket))

    def delete(self, hashes: np.ndarray) -> None:
        """Remove distinct hashes that are in."""
        self.held -= len(hashes)
        marks, one = self._places(hashes)
        for mark, a, b, code in zip(marks, one, self._other(marks, one), self._code(marks, one)):
            bucket = a if (self.table[a] == mark).any() else b
            if (self.table[bucket] == mark).any():
                self.table[bucket, int((self.table[bucket] == mark).argmax())] = 0
            else:
                self.stash = np.delete(self.stash, np.flatnonzero(self.stash == code)[:1])
