"""Words and rolling hashes of UTF-8 texts as arrays."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

#: Base of the polynomial hash and of the final mixing (odd 64-bit numbers).
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)

#: Bytes lower-cased (A-Z only), and whether a byte is blank: 0x20, 0x09-0x0D.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def release() -> None:
    """Gives memory that is free in this worker back to the system: workers live on after a task, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(MIX1)
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX2)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    global _POWERS, _INVERSES
    if len(_POWERS) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
        _POWERS, _INVERSES = grow(BASE), grow(pow(BASE, -1, 1 << 64))
    return _POWERS[: n + 1], _INVERSES[: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with (p[j] - p[i]) * inverse[i] the hash of data[i:j]; bytes count from 1, so that zero bytes matter."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of data[start:end] for arrays of positions."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by one blank, and where each text starts (with the end as last)."""
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that aren't blank; data ends with a blank or is empty."""
    full = ~BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def chunks(texts, most: int = 1 << 21):
    """(first, list of UTF-8 texts) in groups of about `most` bytes; a longer text is a group of its own."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = (t or "").encode("utf-8", "surrogatepass") if not isinstance(t, bytes) else t
        if group and size + len(t) > most:
            yield first, group
            group, size, first = [], 0, i
        group.append(t)
        size += len(t)
    if group:
        yield first, group
