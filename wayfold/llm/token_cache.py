"""A bounded per-worker memory of encoded stretches of text."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

#: Entries kept for good (the first seen, so nearly all frequent ones), entries kept until the rest is full,
#: and the longest stretch remembered: some 200 MB a worker at most.
KEPT, PASSING, LONGEST = 600_000, 300_000, 48


class TokenCache(dict):
    """stretch -> its ids as little-endian unsigned 32-bit bytes, computed by `encode` where it isn't known."""

    def __init__(self, encode: Callable[[str], Iterable[int]], kept: int = KEPT, passing: int = PASSING):
        super().__init__()
        self.encode, self.kept, self.passing, self.young = encode, kept, passing, {}

    def __missing__(self, stretch: str) -> bytes:
        found = self.young.get(stretch)
        if found is None:
            found = array("I", self.encode(stretch)).tobytes()
            if len(stretch) <= LONGEST:
                if len(self) < self.kept:
                    self[stretch] = found
                else:
                    if len(self.young) >= self.passing:
                        self.young.clear()
                    self.young[stretch] = found
        return found

    def ids(self, stretches: list[str]) -> array:
        out = array("I")
        out.frombytes(b"".join(map(self.__getitem__, stretches)))
        return out
