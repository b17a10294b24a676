"""A Bloom filter over 64-bit hashes, filled in pieces of the hash space, of a size with an upper bound."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits an entry, bits in all at least and at most (2^27 bits are 16 MB, small enough to broadcast), probes, pieces.
#: With more entries than fit, more keys pass the filter than need to; none is ever missed.
BITS_AN_ENTRY, BITS_MIN, BITS_MAX, PROBES, PIECES = 12, 1 << 16, 1 << 27, 4, 64


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    """(hashes, PROBES) bit numbers. The low bits of a hash choose its piece, so all its probes lie in one piece."""
    a, b = mix(h), mix(h + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    width = bits // PIECES
    inside = (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(width - 1)
    return ((h % np.uint64(PIECES))[:, None] * np.uint64(width) + inside).astype(np.int64)


def build(hashes: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """From a one-column DataFrame of longs: a test for uint64 arrays, false only where the hash is not there.

    A task fills the pieces it is dealt and nothing else, so no task holds the whole filter and nothing is merged.
    """
    bits = min(BITS_MAX, max(BITS_MIN, 1 << (BITS_AN_ENTRY * hashes.count()).bit_length()))
    width = bits // PIECES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = _slots(batch.column(0).to_numpy().view(np.uint64), bits).ravel()
            pieces = slots // width
            for p in np.unique(pieces).tolist():
                planes.setdefault(p, np.zeros(width, bool))[slots[pieces == p] - p * width] = True
        for p, plane in planes.items():
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([np.packbits(plane).tobytes()], pa.binary())], ["piece", "plane"])

    name = hashes.columns[0]
    dealt = hashes.repartition(F.col(name).bitwiseAND(F.lit(PIECES - 1).cast("long")))
    packed = np.zeros(bits // 8, np.uint8)
    for row in dealt.mapInArrow(fill, "piece long, plane binary").collect():  # BITS_MAX bits at most
        packed[row.piece * width // 8 : (row.piece + 1) * width // 8] = np.frombuffer(row.plane, np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(packed.tobytes())

    def test(h: np.ndarray) -> np.ndarray:
        plane, slots = np.frombuffer(shared.value, np.uint8), _slots(h, bits)
        return (plane[slots >> 3] >> (7 - (slots & 7)) & 1).all(axis=1)

    return test
