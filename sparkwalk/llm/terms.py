"""Terms of whole texts as bytes: maximal runs of the wanted bytes, with only A-Z lower-cased.

In UTF-8 every byte of a character past ASCII is 0x80 or above, so runs of bytes are runs of characters.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc

#: Letters, digits and everything past ASCII; letters and everything past ASCII.
WORDS, LETTERS = rb"[0-9A-Za-z\x80-\xff]+", rb"[A-Za-z\x80-\xff]+"
#: Longer texts are counted piece by piece, cut between terms.
PIECE = 1 << 20


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in pc.cast(batch.column(name), pa.binary()).to_pylist()]


def count_terms(data: bytes, pattern: bytes) -> Counter:
    """Occurrences of each term of one text."""
    data, find, gap = data.lower(), re.compile(pattern), re.compile(pattern.replace(b"[", b"[^", 1)[:-1])
    if len(data) <= PIECE:
        return Counter(find.findall(data))
    counts: Counter = Counter()
    start = 0
    while start < len(data):
        space = gap.search(data, min(start + PIECE, len(data)))
        end = space.start() if space else len(data)
        counts.update(find.findall(data, start, end))
        start = max(end, start + 1)
    return counts
