"""Bytes of many records at once, as whole columns: fields and cells read side by side
from one buffer, pieces joined row by row.

Whatever is not as expected raises ``Irregular``; the decoders of single records then
say what is wrong with it, or read what is allowed but rare."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Kinds of cells, by their number in a segment.
KINDS = "ntbu"
#: Bytes gathered by an index of eight times their size; more are copied one by one.
GATHERED = 16 << 20
_BYTES = pa.large_binary()


class Irregular(ValueError):
    """Records that are not read side by side."""


# --- reading -----------------------------------------------------------------------------


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, starts and ends of a binary column."""
    if column.null_count:
        raise Irregular("a record that is null")
    if column.type != pa.binary():
        column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), at[:-1], at[1:]


def fields(buffer: np.ndarray, at: np.ndarray, ends: np.ndarray, form) -> np.ndarray:
    """The fields (a packed type) at a place of each record."""
    form = np.dtype(form)
    if (at + form.itemsize > ends).any():
        raise Irregular("a record ends early")
    return buffer[at[:, None] + np.arange(form.itemsize)].view(form)[:, 0]


def cells_at(buffer: np.ndarray, at: np.ndarray, ends: np.ndarray, counts: np.ndarray, kinds: np.ndarray, length: str):
    """The cells of a tuple of each record, side by side: the places after them, and
    kind (a place in KINDS), start and size of all cells, tuple by tuple.  ``kinds``
    has the place of each of 256 marks, or 255; ``length`` is the type of a size."""
    if (counts > ends - at).any():
        raise Irregular("more cells than bytes")
    at, first = at.copy(), np.cumsum(counts) - counts
    total = int(counts.sum())
    kind, start, size = np.empty(total, np.uint8), np.zeros(total, np.int64), np.zeros(total, np.int64)
    for c in range(int(counts.max(initial=0))):
        lanes = np.flatnonzero(counts > c)
        here, end, place = at[lanes], ends[lanes], first[lanes] + c
        if (here >= end).any():
            raise Irregular("a record ends early")
        own = kind[place] = kinds[buffer[here]]
        if (own == 255).any():
            raise Irregular("an unknown kind of cell")
        here += 1
        sized = np.flatnonzero((own == 1) | (own == 2))
        n = fields(buffer, here[sized], end[sized], length).astype(np.int64)
        begin = here[sized] + 4
        if (n < 0).any() or (begin + n > end[sized]).any():
            raise Irregular("a record ends early")
        start[place[sized]], size[place[sized]] = begin, n
        here[sized] = begin + n
        at[lanes] = here
    return at, kind, start, size


def cells_column(buffer: np.ndarray, present: np.ndarray, counts: np.ndarray, kind: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Tuples of cells as a column of lists; ``counts`` is of the present ones' cells."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    if ends[-1] >= 1 << 31:
        raise Irregular("more than a batch holds")
    if ends[-1] > GATHERED:
        data = b"".join(buffer[s : s + n] for s, n in zip(start.tolist(), size.tolist(), strict=True))
    else:
        data = buffer[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    sized = (kind == 1) | (kind == 2)
    cells = pa.StructArray.from_arrays(
        [pa.array(list(KINDS)).take(pa.array(kind)), pa.Array.from_buffers(
            pa.binary(), len(kind), [pa.py_buffer(np.packbits(sized, bitorder="little")), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])],
        names=["kind", "data"])
    each = np.zeros(len(present), np.int64)
    each[present] = counts
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]).astype(np.int32)), cells, mask=pa.array(~present))


# --- writing -----------------------------------------------------------------------------


def pieces(values: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """The bytes of each value as a column; with ``there``, of the rows that have one."""
    has = np.ones(len(values), bool) if there is None else there
    ends = np.concatenate([[0], np.cumsum(has * values.dtype.itemsize)]).astype(np.int64)
    return pa.Array.from_buffers(_BYTES, len(has), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def joined(*columns: pa.Array) -> pa.Array:
    """The columns' bytes one behind the other, row by row."""
    return pc.binary_join_element_wise(*(c if c.type == _BYTES else c.cast(_BYTES) for c in columns), pa.scalar(b"", _BYTES))


def sized(column: pa.Array) -> pa.Array:
    """Texts or bytes behind their sizes."""
    column = column.cast(pa.binary()) if column.type == pa.string() else column
    return joined(pieces(pc.binary_length(column).to_numpy(zero_copy_only=False).astype("<u4")), column)


def grouped(column: pa.Array, ends: np.ndarray) -> pa.Array:
    """Rows of consecutive rows' bytes; ``ends`` has the bounds, from the first on."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1][ends]
    return pa.Array.from_buffers(_BYTES, len(ends) - 1, [None, pa.py_buffer(at), data])
