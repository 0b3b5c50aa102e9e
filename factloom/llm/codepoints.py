"""Classes of code points, looked up for all bytes of a UTF-8 buffer at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import regex


@cache
def table(patterns: Sequence[str]) -> np.ndarray:
    """The class of every code point: the place of the first pattern that matches it, else their number."""
    found = np.full(0x110000, len(patterns), np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind in reversed(range(len(patterns))):
        for match in regex.finditer(f"(?:{patterns[kind]})+", every):
            found[ord(match[0][0]) : ord(match[0][-1]) + 1] = kind
    return found


def classes(data: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of valid UTF-8 belongs to."""
    kind = known[:256][data]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        lead = data[wide].astype(np.uint32)
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        point = lead & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            point[more] = point[more] << 6 | data[wide[more] + k] & 0x3F
        of_lead = known[np.minimum(point, 0x10FFFF)]
        kind[wide] = of_lead
        for k in range(1, 4):
            more = size > k
            kind[wide[more] + k] = of_lead[more]
    return kind
