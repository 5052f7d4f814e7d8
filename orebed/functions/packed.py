"""Lists of whole numbers as bytes: each the gap to the one before it, seven bits a byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Types whose values fit.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """``values`` (64-bit, in lists that begin at ``first``, each sorted) as one binary value for each list."""
    gap = np.diff(values, prepend=0).astype(np.uint64)  # beyond 63 bits they wrap, and wrap back
    start = values[first].astype(np.int64)
    gap[first] = ((start << 1) ^ (start >> 63)).astype(np.uint64)  # a list's first number may be negative
    size = np.ones(len(gap), np.int64)
    some, k = np.flatnonzero(gap >= 128), 1
    while len(some):
        size[some] += 1
        k += 1
        some = some[gap[some] >> np.uint64(7 * (k - 1)) >= 128] if k < 10 else some[:0]
    until = np.cumsum(size)
    begin, out = until - size, np.empty(int(until[-1]) if len(until) else 0, np.uint8)
    some = np.arange(len(gap))
    for k in range(int(size.max(initial=0))):
        some = some[size[some] > k]
        out[begin[some] + k] = (gap[some] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    offsets = np.append(begin[first], len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and how many each has."""
    whole = lists.to_pylist()
    data = np.frombuffer(b"".join(whole), np.uint8)
    ends = np.flatnonzero(data < 128)
    bounds = np.cumsum([0, *map(len, whole)])
    first = np.searchsorted(ends, bounds)
    begin = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    size, gap = ends - begin + 1, (data[begin] & 127).astype(np.uint64)
    some, k = np.flatnonzero(size > 1), 1
    while len(some):
        gap[some] |= (data[begin[some] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        k += 1
        some = some[size[some] > k]
    counts, head = np.diff(first), first[:-1][np.diff(first) > 0]
    start = gap[head]
    gap[head] = (start >> np.uint64(1)) ^ (np.uint64(0) - (start & np.uint64(1)))
    total = np.cumsum(gap)
    before = np.concatenate((np.zeros(1, np.uint64), total))[first[:-1]]
    return (total - np.repeat(before, counts)).view(np.int64), counts
