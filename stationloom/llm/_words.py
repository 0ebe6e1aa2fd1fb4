"""Arrow-vectorised text helpers shared by the operators of this subpackage.

A text's words are its runs of characters other than ``\\x20`` and
``\\x09-\\x0D``.  Batches are cut into slices of at most ``SLICE_BYTES`` of text
(one longer text is a slice of its own), so memory is bounded whatever the
number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 6 << 20
#: What forgets the caches that an operator keeps in a process, by the operator's name.
FORGET: dict[str, Callable[[], object]] = {}


def text_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as strings, null as empty."""
    text = batch.column(batch.schema.get_field_index(column))
    return whole(text.take(pa.array(np.arange(len(text)))))  # compact: ascii_lower misreads arrays with an offset


def whole(text: pa.Array) -> pa.Array:
    """The texts as large strings, null as empty."""
    return pc.fill_null(text.cast(pa.large_string()), "")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most so many bytes in ``column``.

    Processes serve one operator after another: the caches of all but the
    ``owner`` are forgotten, and unused memory goes back before each batch.
    """
    for name, forget in FORGET.items():
        if name != owner:
            forget()
    for batch in batches:
        pa.default_memory_pool().release_unused()
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        size = size.to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def flat_parts(lists: pa.Array, drop_empty: bool) -> tuple[pa.Array, np.ndarray]:
    """The parts of all rows, and the row offsets into them."""
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    if drop_empty:
        full = pc.greater(pc.binary_length(flat), 0)
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        flat, offsets = flat.filter(full), kept[offsets]
    return flat, offsets


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Integer codes of the strings, and the distinct strings."""
    code = flat.dictionary_encode()
    return code.indices.to_numpy(zero_copy_only=False).astype(np.int64), code.dictionary


def words_of(text: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word codes, distinct words, and the offsets of each text's words."""
    if lower:
        text = pc.ascii_lower(text)
    flat, offsets = flat_parts(pc.ascii_split_whitespace(text), drop_empty=True)
    return *coded(flat), offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the values of each row."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each part."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``width`` parts within a row begin, and their rows."""
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) - first[row] + offsets[:-1][row], row


def window_codes(codes: np.ndarray, n_codes: int, starts: np.ndarray, width: int) -> np.ndarray:
    """An integer for each window, equal exactly if the windows' parts are."""
    key, span = codes[starts], max(n_codes, 1)
    for k in range(1, width):
        if span >= (1 << 62) // max(n_codes, 1):
            distinct, key = np.unique(key, return_inverse=True)
            span = len(distinct)
        key = key * max(n_codes, 1) + codes[starts + k]
        span *= max(n_codes, 1)
    return key
