"""Exact deduplication that shuffles only rows whose hash may be repeated.

Pass 1 puts every row's hash into a Bloom filter whose bits saturate at two: each task fills its own filter, the
filters are merged piece by piece, and what is kept are the bits that at least two insertions hit. Pass 2 tests every
row: a hash that occurs twice finds all its bits hit twice, so no repeat is missed. Only rows that pass the test are
grouped; the others are alone for certain and pass straight through.

The filter has 16 bits a row up to FILTER_BITS_MAX, a fixed size that can be broadcast whatever the corpus. A corpus
beyond it fills the filter more, so that more rows are shuffled; results are the same. What is shuffled are hashes and
ids, some fifty bytes a row at worst, never texts, except that drop_exact_duplicates verifies the one row of a group
that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import SPACE_CLASS, materialise

#: Bits a row, at least and at most so many bits in all (2^27 bits are 16 MB), probes a hash, pieces for merging.
BITS_A_ROW, FILTER_BITS_MIN, FILTER_BITS_MAX, PROBES, PIECES = 16, 1 << 16, 1 << 27, 4, 64


def text_hash(text: Column) -> Column:
    """SHA-256, as binary, of the text with each run of white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", " "), 256))


def _slots(hashes: pa.Array, bits: int) -> np.ndarray:
    """(rows, PROBES) bit numbers by double hashing; SHA-256 is already uniform."""
    words = np.frombuffer(b"".join(hashes.to_pylist()), "<u8").reshape(-1, 4)
    step = words[:, 1] | np.uint64(1)
    return ((words[:, :1] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def filter_bits(rows: int) -> int:
    return min(FILTER_BITS_MAX, max(FILTER_BITS_MIN, 1 << (BITS_A_ROW * rows).bit_length()))


def repeated_bits(keys: DataFrame, bits: int) -> np.ndarray:
    """Pass 1 over column `hash`: one boolean a bit, true where two insertions or more hit it."""
    width = bits // PIECES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            slots, counts = np.unique(_slots(batch.column(0), bits), return_counts=True)
            marks, place = np.left_shift(1, 7 - (slots & 7)).astype(np.uint8), slots >> 3
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            place, hit = place[first], np.bitwise_or.reduceat(marks, first)
            again = np.bitwise_or.reduceat(np.where(counts > 1, marks, 0).astype(np.uint8), first)
            twice[place] |= again | once[place] & hit
            once[place] |= hit
        for p in range(PIECES):
            own = slice(p * width // 8, (p + 1) * width // 8)
            if once[own].any():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([once[own].tobytes()], pa.binary()), pa.array([twice[own].tobytes()], pa.binary())], ["piece", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for p, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
                if p in pieces:
                    have = pieces[p]
                    have[1] |= b | have[0] & a
                    have[0] |= a
                else:
                    pieces[p] = [a.copy(), b.copy()]
        for p, (_, twice) in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([twice.tobytes()], pa.binary())], ["piece", "twice"])

    filled = keys.select("hash").mapInArrow(fill, "piece long, once binary, twice binary")
    merged = filled.repartition("piece").mapInArrow(merge, "piece long, twice binary").collect()  # FILTER_BITS_MAX bits at most
    out = np.zeros(bits, bool)
    for row in merged:
        out[row.piece * width : (row.piece + 1) * width] = np.unpackbits(np.frombuffer(row.twice, np.uint8)).astype(bool)
    return out


def _tester(keys: DataFrame):
    """Pass 1, and a function of a hash column that tells whether the hash may be repeated."""
    bits = filter_bits(keys.count())
    shared = keys.sparkSession.sparkContext.broadcast(np.packbits(repeated_bits(keys, bits)).tobytes())

    def maybe(hashes: pa.Array) -> pa.Array:
        plane = np.frombuffer(shared.value, np.uint8)
        slots = _slots(hashes, bits)
        return pa.array((plane[slots >> 3] >> (7 - (slots & 7)) & 1).all(axis=1))

    return maybe


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256.

    Of rows whose texts are equal up to runs of white space the one with the smallest id is kept; null texts equal
    empty ones; null ids come after all others; of rows equal in id and text exactly one is kept. An empty table
    gives an empty one; further columns are not read.
    """
    keys = materialise(df.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("hash"), F.monotonically_increasing_id().alias("row")), "dedup-keys")
    maybe = _tester(keys)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, maybe(batch.column(1))], [*batch.schema.names, "maybe"])

    tested = materialise(keys.mapInArrow(test, f"id {keys.schema['id'].dataType.simpleString()}, hash binary, row long, maybe boolean"), "dedup-tested")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    groups = materialise(tested.where("maybe").groupBy("hash").agg(F.count(F.lit(1)).alias("group_size"), first), "dedup-groups")
    repeated = tested.where("maybe").join(groups, "hash").select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "hash")
    alone = tested.where("not maybe").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "hash")
    return repeated.union(alone).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("hash")).alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that exact_duplicates keeps, all columns, whatever their types and names.

    Which rows stay is settled by hashes and ids alone. A row whose hash may be repeated is then asked of a filter of
    those that stay: one that is not there goes on the spot, so of a group of copies one row is shuffled, to be
    verified, and never the texts of the others. Null texts equal empty ones, null ids come last, of rows equal in id and
    text one stays, the first by the columns that have an order; an empty table gives an empty one.
    """
    names = df.columns  # whatever df calls its columns, here they are c0, c1, …
    df = df.toDF(*(f"c{i}" for i in range(len(names))))
    id_col, text_col = (df.columns[names.index(c)] for c in (id_col, text_col))
    hash_col, maybe_col, pair_col, turn = "text_hash", "maybe_repeated", "hash_and_id", "turn"
    hashed = df.withColumn(hash_col, text_hash(F.col(text_col)))
    pair = lambda h, i: F.xxhash64(F.col(h), F.col(i).isNull(), F.col(i))
    keys = materialise(hashed.select(F.col(id_col).alias("id"), F.col(hash_col).alias("hash")), "dedup-keys")
    maybe = _tester(keys)

    @F.arrow_udf("boolean")
    def may_repeat(hashes: pa.Array) -> pa.Array:
        return maybe(hashes)

    doubtful = materialise(keys.where(may_repeat(F.col("hash"))), "dedup-doubtful")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
    stay = materialise(doubtful.groupBy("hash").agg(first).select(F.col("hash").alias("of_hash"), F.col("first.id").alias("of_id")), "dedup-stay")
    known = bloom.build(stay.select(pair("of_hash", "of_id").alias("pair")))

    @F.arrow_udf("boolean")
    def may_stay(pairs: pa.Array) -> pa.Array:
        return pa.array(known(pairs.to_numpy(zero_copy_only=False).view(np.uint64)))

    tested = hashed.withColumn(maybe_col, may_repeat(F.col(hash_col)))
    alone = tested.where(~F.col(maybe_col)).select(*df.columns)
    rest = tested.where(F.col(maybe_col)).withColumn(pair_col, pair(hash_col, id_col)).where(may_stay(F.col(pair_col)))
    kept = rest.join(stay, (F.col(hash_col) == F.col("of_hash")) & F.col(id_col).eqNullSafe(F.col("of_id")), "left_semi")
    ordered = [F.col(f.name) for f in df.schema.fields if not f.dataType.simpleString().startswith(("map", "variant")) and "map<" not in f.dataType.simpleString()]
    one = Window.partitionBy(hash_col, id_col).orderBy(*ordered)
    return alone.union(kept.withColumn(turn, F.row_number().over(one)).where(F.col(turn) == 1).select(*df.columns)).toDF(*names)
