"""A cuckoo filter over 64-bit keys: membership without false negatives, with deletion."""

from __future__ import annotations

import numpy as np

#: Slots of a bucket, moves before the filter grows, and the fill it is planned for.
SLOTS, KICKS, FILL = 4, 500, 0.85
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class CuckooFilter:
    """16-bit fingerprints in buckets of four. A key's second bucket is its first xor a hash of its
    fingerprint, so a fingerprint can move without its key. Inserting a key twice takes two slots and two
    deletions; deleting a key that was never inserted is the caller's fault and may remove another's."""

    def __init__(self, keys: int, slots: np.ndarray | None = None):
        buckets = 1
        while buckets * SLOTS * FILL < max(1, keys):
            buckets *= 2
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @property
    def mask(self) -> np.uint64:
        return np.uint64(len(self.slots) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        mixed = (keys ^ (keys >> np.uint64(31))) * _MULTIPLIERS[0]
        mark = (mixed >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (mixed >> np.uint64(8)) & self.mask
        return mark, first, first ^ self._step(mark)

    def _step(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * _MULTIPLIERS[1] >> np.uint64(20)) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        mark, first, second = self._places(keys)
        return (self.slots[first] == mark[:, None]).any(1) | (self.slots[second] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if some key found no place: the caller then builds a larger filter from its keys."""
        mark, first, second = self._places(keys)
        todo = np.arange(len(keys))
        # All at once as long as places are free: of the keys that want a slot, one gets it in each round.
        for _ in range(2 * SLOTS):
            for places in (first, second):
                if not len(todo):
                    return True
                at = places[todo]
                free = self.slots[at] == 0
                has = free.any(1)
                slot = at[has] * np.uint64(SLOTS) + free[has].argmax(1).astype(np.uint64)
                _, won = np.unique(slot, return_index=True)
                winners = todo[has][won]
                self.slots.reshape(-1)[slot[won]] = mark[winners]
                todo = todo[~np.isin(todo, winners)]
        step, slots = self._step, self.slots
        for k in todo.tolist():
            at, held = int(first[k]), mark[k]
            for move in range(KICKS):
                free = np.flatnonzero(slots[at] == 0)
                if len(free):
                    slots[at, free[0]] = held
                    break
                out = (move * 7 + k) % SLOTS
                held, slots[at, out] = slots[at, out], held
                at = int(at ^ int(step(np.array([held]))[0]))
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        mark, first, second = self._places(keys)
        for k in range(len(keys)):
            for at in (int(first[k]), int(second[k])):
                found = np.flatnonzero(self.slots[at] == mark[k])
                if len(found):
                    self.slots[at, found[0]] = 0
                    break

    def dump(self) -> bytes:
        return self.slots.astype("<u2").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(raw, "<u2").reshape(-1, SLOTS).copy())

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        room = len(keys)
        while True:
            made = cls(room)
            if made.insert(keys):
                return made
            room = max(2 * room, len(made.slots) * SLOTS)
