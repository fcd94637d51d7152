"""Arrow batches as dictionary-coded words, so that Python sees each distinct word of a batch once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of a slice stays near ``most`` bytes; one text is never cut."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), nan=0)
    part = (np.cumsum(sizes) // most).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Lower-cased texts split at white space: token codes, offsets of the texts, and the distinct words."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    offsets = split.offsets.to_numpy().astype(np.int64)
    tokens = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, offsets, listed = tokens.indices.to_numpy().astype(np.int64), offsets - offsets[0], tokens.dictionary.to_pylist()
    if "" in listed:  # white space at an end leaves an empty piece
        real = codes != listed.index("")
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, offsets, listed
