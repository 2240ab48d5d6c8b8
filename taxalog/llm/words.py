"""Words and shingles on UTF-8 bytes, shared by the operators on word shingles."""

from __future__ import annotations

import numpy as np
import xxhash


def ascii_words(text: bytes) -> list[bytes]:
    """Runs without space, tab, newline, vertical tab, form feed and return; A-Z lower-cased.

    ``bytes.lower`` and ``bytes.split`` know ASCII only, so other letters and
    other white space stay as they are.
    """
    return text.lower().split()


def shingles(words: list[bytes], width: int):
    """The space-joined runs of ``width`` words; one shorter run when there are fewer."""
    joined, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    if len(words) <= width:
        return [joined] if words else []
    starts = [0, *(e + 1 for e in ends[:-width])]
    return [joined[a:b] for a, b in zip(starts, ends[width - 1:])]


def fingerprint(text: bytes | None, width: int, seed: int = 42) -> int:
    """64-bit SimHash: a bit is set where over half of the shingles' XXH64 have it."""
    parts = shingles(ascii_words(text), width) if text else []
    if not parts:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), "<u8", len(parts))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):  # a very long text is counted in slices
        block = hashes[a:a + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])
