"""Word shingles of texts as 64-bit hashes, many documents at a time (runs in tasks)."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bytes of text that are hashed together; a longer document is hashed alone, whole.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, size: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < size:
        steps = np.full(max(size, CHUNK + 1), base, dtype=np.uint64)
        steps[0] = 1
        held = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return held[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def normalised(text: bytes | None) -> bytes:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, joined by one blank."""
    return b" ".join((text or b"").lower().split())


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: entry i covers the first i bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    return sums


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges, the same wherever the same bytes stand."""
    down = _power("down", pow(_BASE, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each normalised text.

    Fewer words than ``size`` make one shingle of all; no words make none.
    """
    out: list[np.ndarray] = []
    chunk: list[bytes] = []
    held = 0
    for text in texts:
        if chunk and held + len(text) > CHUNK:
            out += _sets(chunk, size)
            chunk, held = [], 0
        chunk.append(text)
        held += len(text) + 1
    return out + (_sets(chunk, size) if chunk else [])


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero((data == 32) | (data == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = data[ends] == 10
    doc = np.cumsum(last) - last
    sums = prefix_sums(data)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    whole = max(0, len(ends) - size + 1)
    every = spans(sums, starts[:whole], ends[size - 1 :])
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= size:
            out.append(np.unique(every[lo : hi - size + 1]))
        elif ends[hi - 1] > starts[lo]:
            out.append(spans(sums, starts[lo : lo + 1], ends[hi - 1 : hi]))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
