"""White-space-separated words of many texts at once, as Arrow arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_runs(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """``column`` in slices of whole texts of about ``size`` bytes together, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size)))
        yield column.slice(i, j - i)
        i = j


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of binary ``texts`` in order, and how many each text has.

    ``lower`` turns A-Z into a-z. Null and blank texts have no words.
    """
    text = pc.fill_null(texts, b"").view(pa.string())  # the kernels below look at ASCII bytes only
    if lower:
        text = pc.ascii_lower(text)
    cut = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    words, counts = cut.flatten(), pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():
        of = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(of[full.to_numpy(zero_copy_only=False)], minlength=len(counts))
        words = words.filter(full)
    return words.view(pa.binary()), counts


def last_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The last and the last but one byte of each word; -1 in place of the latter in words of one byte."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    last = data[ends[1:] - 1].astype(np.int64)
    return last, np.where(np.diff(ends) > 1, data[np.maximum(ends[1:] - 2, 0)].astype(np.int64), -1)
