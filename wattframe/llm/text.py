"""Text helpers shared by the corpus operators: A-Z lower-casing, word bytes, vectorised word hashes, mixing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = b" \t\n\x0b\x0c\r"
_BLOCK = 1 << 12
_MULTIPLIERS = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, _BLOCK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def fresh(table: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `table` has it in any case."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit values (a bijection), so that any bits of them can be used."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_table(word_bytes: bytes | None = None) -> np.ndarray:
    """256 flags: true for bytes that belong to words. By default all but ASCII white space."""
    table = np.ones(256, dtype=bool)
    if word_bytes is None:
        table[list(SPACES)] = False
    else:
        table[:] = False
        table[list(word_bytes)] = True
    return table


def word_hashes(data: bytes, table: np.ndarray) -> np.ndarray:
    """64-bit hashes of the maximal runs of word bytes, in order.

    A word of bytes b is hashed as the sum of (b + 1) times a fixed odd multiplier of its position, finalised with its length. Words of over 4,096 bytes are
    hashed block by block.
    """
    if not data:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = table[raw]
    edges = np.flatnonzero(np.diff(inside.view(np.int8)))
    starts, ends = edges[~inside[edges]] + 1, edges[inside[edges]] + 1
    if inside[0]:
        starts = np.concatenate([[0], starts])
    if inside[-1]:
        ends = np.concatenate([ends, [len(raw)]])
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    keep = np.flatnonzero(inside)
    firsts = np.cumsum(lengths) - lengths
    at = np.arange(len(keep)) - np.repeat(firsts, lengths)
    value = raw[keep].astype(np.uint64) + np.uint64(1)
    if lengths.max() > _BLOCK:
        value = mix(value + (at // _BLOCK).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at %= _BLOCK
    sums = np.add.reduceat(value * _MULTIPLIERS[at], firsts)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def record_batches(batches: Iterator[pa.RecordBatch], make, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Applies `make` (batch -> list of columns) to every batch."""
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(make(batch), schema, strict=True)], schema=schema)
