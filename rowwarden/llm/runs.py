"""Runs of letters in the UTF-8 bytes of whole Arrow batches, found and counted without a step per character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rowwarden.llm.batches import LOWER

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def beyond_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of every character beyond ASCII."""
    return _LETTER[data] | (data >= 0x80)


def latin(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of U+00C0 to U+00FF, which are two bytes, the first of them 0xC3."""
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return inside


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each run of ``inside`` bytes begins and ends, and the text it lies in; no run crosses two texts."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def coded(data: np.ndarray, inside: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The runs, A-Z as a-z, as numbers into an array of the distinct ones.  Exact: compared as text, not by hash."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(LOWER[data[inside]])])
    found = words.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def portions(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose texts have about ``most`` bytes; a longer text is a slice by itself."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to
