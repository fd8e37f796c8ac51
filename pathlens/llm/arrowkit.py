"""Helpers for functions given to ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with their texts (null as empty), of about ``most`` bytes each.

    A text longer than that is a slice of its own.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        total, first = 0, 0
        for i, n in enumerate(sizes):
            if i > first and total + n > most:
                part = batch.slice(first, i - first)
                yield part, [t or "" for t in part.column(batch.schema.get_field_index(column)).to_pylist()]
                first, total = i, 0
            total += n
        if first < batch.num_rows:
            part = batch.slice(first)
            yield part, [t or "" for t in part.column(batch.schema.get_field_index(column)).to_pylist()]


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of one key each, from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        first = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or keys[i] != (keys[i - 1] if i else last):
                if i > first:
                    held.append(batch.slice(first, i - first))
                    first = i
                if i < len(keys) and held:
                    if i or last is not None:
                        yield pa.Table.from_batches(held)
                        held = []
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def binary_rows(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    """Each binary value as an array of ``dtype``."""
    return [np.frombuffer(v, dtype) for v in column.to_pylist()]
