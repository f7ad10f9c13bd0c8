"""Vectorised word and shingle hashing for batches of texts (runs inside Spark tasks).

A batch of texts becomes one byte array; word hashes are differences of a polynomial prefix
sum, so that no Python loop touches single words.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; bounds a task's memory.
BLOCK = 1 << 20

_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_T = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_A = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        for k, base in enumerate((_R, _RINV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list, size: int = BLOCK):
    """Cut a list into runs of about ``size`` characters; a longer text is a run of its own."""
    run, total = [], 0
    for t in texts:
        n = len(t) if t else 0
        if run and total + n > size:
            yield run
            run, total = [], 0
        run.append(t)
        total += n
    if run:
        yield run


def text_runs(batches, at: int, size: int = BLOCK):
    """Cut Arrow batches into runs of rows of about ``size`` bytes of text in column ``at``; a longer text is a run of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
            yield batch.slice(a, b - a)
            a = b


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the index of each text's first word (one more at the end)."""
    buf = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
    bounds = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    space = _SPACE[buf]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(space & ~before)
    power, inverse = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_T[buf] * power[: len(buf)], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, bounds)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; runs that cross texts are for the caller to leave out."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = h[: len(h) - k + 1] * _A[0]
    for j in range(1, k):
        out = out + h[j : len(h) - k + 1 + j] * _A[j]
    return mix(out)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a shorter text is one shingle, one without words has none."""
    h, at = words(texts)
    win = windows(h, k)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(win[a : b - k + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _A[32 : 32 + b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def lower(text: str | None) -> bytes | None:
    """UTF-8 with A-Z lower-cased and nothing else."""
    return None if text is None else text.encode("utf-8", "surrogatepass").lower()
