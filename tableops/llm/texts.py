"""Word and n-gram hashes of whole Arrow text columns, computed with numpy.

A column is one run of UTF-8 bytes and the offsets of its rows. A word is a run of bytes that
are not separators; its 64-bit hash is a difference of prefix sums, so no Python object is made
for a word. All separators are ASCII, so no character is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The six ASCII white space characters.
WHITE = b" \t\n\x0b\x0c\r"
#: White space, other control characters and ASCII marks: what stands between plain words.
MARKS = bytes(b for b in range(128) if not chr(b).isalnum())

_SEED = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_BASE = int(_SEED.integers(2**40, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done = 1, 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 2**64))
        done += take
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a one-to-one map)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 row bounds; a missing text is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n, (_, ends, data) = len(column), column.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` text bytes, one row at least."""
    bounds, start = flat(batch.column(column))[1], 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def spans(data: np.ndarray, bounds: np.ndarray, between: bytes = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a word never crosses the bounds of its row."""
    n = len(data)
    is_between = np.zeros(256, bool)
    is_between[list(between)] = True
    gap = np.ones(n + 2, bool)
    gap[1:-1] = is_between[data]
    new = np.zeros(n + 1, bool)
    new[bounds] = True
    inside = ~gap[1:-1]
    return np.flatnonzero(inside & (gap[:-2] | new[:-1])), np.flatnonzero(inside & (gap[2:] | new[1:])) + 1


def words(data: np.ndarray, bounds: np.ndarray, between: bytes = WHITE, stem: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z taken as a-z, and the n + 1 bounds of each row's words.

    With ``stem``, only the first so many bytes of each word count.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    starts, ends = spans(data, bounds, between)
    if stem:
        ends = np.minimum(ends, starts + stem)
    out, done = np.empty(len(starts), np.uint64), 0
    up = down = np.ones(1, np.uint64)
    while done < len(starts):
        low = starts[done]
        stop = max(done + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        size = int(ends[stop - 1] - low)
        if len(up) < size:
            up, down = _powers(_BASE, max(size, min(n, _BLOCK))), _powers(_INVERSE, max(size, min(n, _BLOCK)))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTES[data[low : low + size]] * up[:size], out=sums[1:])
        s, e = starts[done:stop] - low, ends[done:stop] - low
        out[done:stop] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        done = stop
    return mixed(out), np.searchsorted(starts, bounds)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, gaps: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at the distances ``gaps`` from each place (the first is 0), within rows.

    Returns the hashes and the row of each.
    """
    n, reach = len(hashes), gaps[-1]
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if n <= reach:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n - reach, salt * 2 + 1, np.uint64)
    for k, gap in enumerate(gaps):
        total += hashes[gap : n - reach + gap] * np.uint64(pow(_BASE, k + 1, 2**64))
    same = rows[: n - reach] == rows[reach:]
    return mixed(total[same]), rows[: n - reach][same]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each value once (by sorting, which is faster here than hashing)."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values
