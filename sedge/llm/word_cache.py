"""A bounded memory of values by word, for work that Zipf's law repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any
from weakref import WeakSet

#: Bytes that an entry takes besides its key and value, about.
ENTRY = 150


class WordCache:
    """Values by key, two generations of about `limit` bytes; `known` holds at least the keys last asked for.

    Keys of over `longest` units are made each time, so that odd texts push nothing out.
    """

    def __init__(self, make_all: Callable[[list], list], size_of: Callable[[Any], int] = len, limit: int = 96 << 20, longest: int = 256):
        self.make_all, self.size_of, self.limit, self.longest = make_all, size_of, limit, longest
        self.forget()
        _caches.add(self)

    def forget(self) -> None:
        self.known: dict = {}
        self.old: dict = {}
        self.size = 0

    def known_for(self, keys: Iterable[Any]) -> dict:
        """A dict that has all the keys; new values are made in one call."""
        wanted = set(keys)
        self.turn()
        new = wanted.difference(self.known)
        found = {k: self.old[k] for k in new if k in self.old}
        new = sorted(new.difference(found))
        if new:
            found.update(zip(new, self.make_all(new), strict=True))
        return self.known | long if (long := self.keep(found)) else self.known

    def values(self, keys: list) -> list:
        """Values, none of which is None, of keys that are all different, in their order."""
        self.turn()
        out = list(map(self.known.get, keys))
        missing = [k for k, v in enumerate(out) if v is None]
        if self.old:
            for k in missing:
                out[k] = self.old.get(keys[k])
        new = [k for k in missing if out[k] is None]
        if new:
            for k, v in zip(new, self.make_all([keys[k] for k in new]), strict=True):
                out[k] = v
        self.keep({keys[k]: out[k] for k in missing})
        return out

    def turn(self) -> None:
        if self.size >= self.limit:
            self.old, self.known, self.size = self.known, {}, 0

    def keep(self, found: dict) -> dict:
        """Remembers values, and returns those that are too long for it."""
        long = {k: v for k, v in found.items() if len(k) > self.longest}
        for k in long:
            del found[k]
        self.known.update(found)
        self.size += sum(map(len, found)) + sum(map(self.size_of, found.values())) + ENTRY * len(found)
        return long


_caches: WeakSet[WordCache] = WeakSet()


def forget_all() -> None:
    """Empties all caches of this worker, which stays when another operator's tasks come."""
    for c in _caches:
        c.forget()
