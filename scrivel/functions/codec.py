"""Posting lists as zig-zag variable-length integers."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def put_varints(numbers: list[int]) -> bytes:
    out = bytearray()
    for n in numbers:
        u = n << 1 if n >= 0 else (-n << 1) - 1
        while u >= 0x80:
            out.append(u & 0x7F | 0x80)
            u >>= 7
        out.append(u)
    return bytes(out)


def get_varints(raw: bytes) -> list[int]:
    out, u, shift = [], 0, 0
    for b in raw:
        u |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append(u >> 1 if not u & 1 else -((u + 1) >> 1))
            u = shift = 0
    return out


def encode_postings(postings: list[tuple[int, int, list[int]]]) -> bytes:
    """(doc_id, title_end, positions) each as: id, number of positions, title_end, positions."""
    return put_varints([x for d, t, p in postings for x in (d, len(p), t, *p)])


def decode_postings(raw: bytes) -> list[tuple[int, int, list[int]]]:
    out, v, i = [], get_varints(raw), 0
    while i < len(v):
        n = v[i + 1]
        out.append((v[i], v[i + 2], v[i + 3 : i + 3 + n]))
        i += 3 + n
    return out


def merge_postings(a: list, b: list) -> list:
    return sorted(a + b, key=lambda p: p[0])


def _bounds(lists: pa.Array) -> np.ndarray:
    """Where each row of an array or binary column starts in its values, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_binary(lists.type) or pa.types.is_large_list(lists.type) else np.int32
    return np.frombuffer(lists.buffers()[1], dtype=kind)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)


def _put_all(lists: pa.Array) -> pa.Array:
    """put_varints of every row at once."""
    lists, missing = lists.fill_null([]), lists.is_null()
    if not len(lists):
        return pa.array([], pa.binary())
    at, values = _bounds(lists), lists.values
    n = values.slice(at[0], at[-1] - at[0]).cast(pa.int64()).to_numpy()
    u = ((n << 1) ^ (n >> 63)).view(np.uint64)
    size = np.ones(len(u), dtype=np.uint8)
    for k in range(1, -(-int(u.max(initial=0)).bit_length() // 7)):
        size += u >= np.uint64(1 << 7 * k)
    start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    out = np.empty(start[-1], dtype=np.uint8)
    here = start[:-1]
    for k in range(1, int(size.max(initial=0)) + 1):  # the numbers that have a k-th byte
        more = size > k
        out[here] = np.where(more, u.astype(np.uint8) | 0x80, u.astype(np.uint8) & 0x7F)
        here, u, size = here[more] + 1, u[more] >> np.uint64(7), size[more]
    rows = pa.py_buffer(start[at - at[0]].astype(np.int32))
    made = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, rows, pa.py_buffer(out)])
    return pc.if_else(missing, pa.scalar(None, pa.binary()), made)


def _get_all(raw: pa.Array) -> pa.Array:
    """get_varints of every row at once; rows with numbers beyond 64 bits or oddly padded ones go one by one."""
    raw, missing = raw.fill_null(b""), raw.is_null()
    kind = pa.list_(pa.int64())
    if not len(raw):
        return pa.array([], kind)
    at = _bounds(raw)
    b = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    last = np.flatnonzero(b < 0x80)  # where numbers end
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    ends = at[1:][np.diff(at) > 0] - 1
    if (b[ends] >= 0x80).any():  # what a row leaves unfinished belongs to no number
        first = np.maximum(first, at[np.searchsorted(at, last, side="right") - 1])
    size = last - first + 1
    if (size > 10).any() or (b[last[size == 10]] > 1).any():
        return pa.array([None if x is None else get_varints(x) for x in pc.if_else(missing, pa.scalar(None, raw.type), raw).to_pylist()], kind)
    u = (b[first] & 0x7F).astype(np.uint64)
    more = np.flatnonzero(size > 1)
    for k in range(1, int(size.max(initial=0))):
        u[more] |= (b[first[more] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
        more = more[size[more] > k + 1]
    n = (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)
    offsets = pa.array(np.searchsorted(last, at).astype(np.int32))
    return pc.if_else(missing, pa.scalar(None, kind), pa.ListArray.from_arrays(offsets, pa.array(n)))


def encoded(numbers: Column) -> Column:
    """array<long> to binary."""

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        return _put_all(lists)

    return run(numbers)


def decoded(raw: Column) -> Column:
    @F.arrow_udf("array<long>")
    def run(raw: pa.Array) -> pa.Array:
        return _get_all(raw)

    return run(raw)
