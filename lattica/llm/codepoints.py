"""Texts as arrays of code points, in packs of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points worked on at a time.
PACK = 1 << 20

#: Classes of code points.
CLASSES = ("lower", "upper", "digit", "space", "newline", "sentence", "exclaim", "symbol", "other")


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case form if it is a letter, else 0; its class."""
    lower = np.zeros(0x110000, np.uint32)
    kinds = np.full(0x110000, CLASSES.index("other"), np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
            kinds[c] = ch.isupper()
        elif ch.isdecimal():
            kinds[c] = 2
        elif ch.isspace():
            kinds[c] = 4 if ch in "\n\r" else 3
    for chars, kind in ((".,;:'\"()-?", 5), ("!", 6), ("#*$%&|<>@^~_=+/\\{}[]", 7)):
        for ch in chars:
            kinds[ord(ch)] = kind
    return lower, kinds


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def packs(texts: list[str], step: int = PACK, overlap: int = 0) -> Iterator[list[tuple[int, str, int]]]:
    """Lists of (row, piece, length), together about `step` code points at most.

    A text longer than that is cut; a piece holds up to `overlap` more code
    points than its length, those that follow it in the text. step is a
    multiple of every passage length, so passages never straddle a cut.
    """
    pack, size = [], 0
    for row, text in enumerate(texts):
        for start in range(0, max(1, len(text)), step):
            n = min(step, len(text) - start)
            if pack and size + n > step:
                yield pack
                pack, size = [], 0
            pack.append((row, text[start : start + n + overlap] if start or n < len(text) else text, n))
            size += n
    if pack:
        yield pack
