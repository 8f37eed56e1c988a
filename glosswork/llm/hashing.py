"""64-bit hashes of words and sequences, the same in every Python worker."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

#: Words that a worker remembers before it starts anew.
MOST_WORDS = 400_000


def hash64(data: bytes) -> int:
    """All 64 bits of a BLAKE2b digest, unsigned."""
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little")


def signed(value: int) -> int:
    """The same 64 bits as a signed number, as columns hold them."""
    return value - 2**64 if value >= 2**63 else value


class WordHashes:
    """Words to 64-bit numbers, remembered within a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = hash64(w.encode("utf-8", "surrogatepass"))
            out.append(h)
        return np.array(out, dtype=np.uint64)
