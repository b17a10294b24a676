"""Removal of word windows that already start in an earlier document, through a log-structured fingerprint index.

The index is kept between calls and knows what earlier batches held, in two families of immutable runs, each bucketed
and sorted by its key:

* grams: winnowed fingerprints of windows of 13 words (the least hash among the 6-word grams of a window stands for
  it; equal windows choose the same gram, neighbouring windows mostly share theirs, so there are some two for nine
  windows), with the number of documents, up to two, that have each;
* windows: for grams that two documents have, the windows they stand for, by 96 bits of the SHA-256 of their words, and
  the smallest document that has each.

A new batch is written as a run of grams and merge-joined with the runs before it. Only windows whose gram history or
another document of the batch has can be repeated; a filter of bounded size tells them, lets some others through and
misses none. A gram that one earlier document alone had until now brings that document's windows in. The windows
are verified by their digests against each other and, in a merge join, against the runs of windows; what is new
becomes a run of its own. Runs are compacted by tiers: MAX_RUNS runs of a tier are merged into one of the next.

Within a task the earliest document of a window answers for all others of the task, which are settled on the spot; so
a passage that a third of the corpus shares sends one row a task into the shuffle, not one a document.

Words, windows and digests are of whole texts; nothing is capped.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom
from .common import drop_path, file_names, materialise, put_file, read_file, scratch_path

WINDOW, GRAM = 13, 6
#: Words of a text that are hashed at a time; windows that a task combines before it hands rows on; runs of a tier before
#: they are compacted; bytes of text of a batch, about, when a corpus is dealt into batches, and batches at least.
PART_WORDS, COMBINE, MAX_RUNS, BATCH_BYTES, BATCHES_MIN = 1 << 17, 1 << 18, 4, 2 << 30, 2
#: Rows of one bucket of a run, about, and buckets at most; rows of an Arrow batch that are unpacked at a time.
BUCKET_ROWS, BUCKETS_MAX, SLICE = 500_000, 20_000, 500
LAST = (1 << 63) - 1
EMPTY = hashlib.sha256(b"").hexdigest()

#: Two families of polynomial hashes over the bytes of words. They only propose windows; digests decide.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=2)
def _byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(1009 + which).integers(0, 2**64, 256, dtype=np.uint64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, at least n of them."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size, base = max(1 << 16, 1 << (n - 1).bit_length()), _BASES[which]
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = _powers[which] = (both[0], both[1])
    return have


class Words:
    """Rolling hashes over the words of one text (or a part of it), joined by single spaces."""

    def __init__(self, joined: bytes):
        self.joined, self.bytes = joined, np.frombuffer(joined, np.uint8)
        spaces = np.flatnonzero(self.bytes == 32)
        self.start = np.concatenate([[0], spaces + 1])
        self.end = np.concatenate([spaces, [len(joined)]])
        self.n = len(self.start)
        self.prefix: dict[int, np.ndarray] = {}

    def hashes(self, length: int, which: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the runs of `length` words that start at the given words, or at every word that has one."""
        powers, inverse = _power_tables(which, len(self.bytes) + 1)
        prefix = self.prefix.get(which)
        if prefix is None:
            prefix = self.prefix[which] = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum(_byte_values(which)[self.bytes] * powers[: len(self.bytes)], out=prefix[1:])
        if at is None:
            at = np.arange(self.n - length + 1)
        start, end = self.start[at], self.end[at + length - 1]
        return bloom.mix((prefix[end] - prefix[start]) * inverse[start])

    def digests(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits, as a long and an int, of the SHA-256 of the runs of `length` words that start at the given words."""
        joined, sha = self.joined, hashlib.sha256
        found = b"".join([sha(joined[a:b]).digest()[:12] for a, b in zip(self.start[at].tolist(), self.end[at + length - 1].tolist(), strict=True)])
        both = np.frombuffer(found, np.dtype([("w", "<i8"), ("v", "<i4")]))
        return both["w"].astype(np.int64), both["v"].astype(np.int32)

    def winnowed(self) -> tuple[np.ndarray, np.ndarray]:
        """Gram hashes, and for every window the gram that stands for it."""
        grams = self.hashes(GRAM, 0)
        width = WINDOW - GRAM + 1
        least = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
        return grams, least + np.arange(len(least))


def _parts(data: bytes) -> Iterator[tuple[int, Words]]:
    """(first word, words) of a text in parts that overlap so that each window is in exactly one."""
    words = data.split()
    for at in range(0, max(0, len(words) - WINDOW + 1), PART_WORDS):
        yield at, Words(b" ".join(words[at : at + PART_WORDS + WINDOW - 1]))


def row_key(data: bytes) -> int:
    """64 bits that tell rows of one id apart by their words."""
    return int.from_bytes(hashlib.sha256(b" ".join(data.split())).digest()[:8], "little", signed=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def fingerprints(df: DataFrame) -> DataFrame:
    """Of (id, text): h, n: the fingerprints of a task's documents, n the number of them that have h, up to two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "n"])

        for batch in _slices(batches):
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                own = [grams[np.unique(chosen)] for grams, chosen in (part.winnowed() for _, part in _parts(data or b""))]
                if own:
                    h = np.unique(np.concatenate(own))
                    held.append(h)
                    size += len(h)
                    if size >= COMBINE:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return df.mapInArrow(run, "h long, n int")


class Runs:
    """Immutable runs of one family: bucketed, sorted tables under `folder`, in tiers."""

    def __init__(self, spark: SparkSession, folder: str, family: str, keys: list[str], schema: str, value: str, merge: Callable[[Column, Column], Column], buckets: int):
        self.spark, self.folder, self.family, self.keys, self.schema, self.value, self.merge, self.buckets = spark, folder, family, keys, schema, value, merge, buckets
        self.runs: list[tuple[str, str, int]] = []  # table, path, tier

    def write(self, rows: DataFrame, tier: int = 0) -> tuple[str, str, int]:
        """rows, one a key, as a run that does not belong to the index yet."""
        name = f"lisible_{self.family}_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        rows.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", path).format("parquet").saveAsTable(name)
        return name, path, tier

    def reopen(self, path: str, tier: int) -> None:
        """A run that an earlier session wrote, under a name of this session's catalog."""
        name, keys = f"lisible_{self.family}_{uuid.uuid4().hex}", ", ".join(self.keys)
        self.spark.sql(f"CREATE TABLE {name} ({self.schema}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        self.runs.append((name, path, tier))

    def before(self, rows: DataFrame) -> DataFrame:
        """rows, bucketed by the keys, with what all runs say of their keys in column `old`, null where they say nothing."""
        out, said = rows, []
        for i, (name, _, _) in enumerate(self.runs):
            other = self.spark.table(name).withColumnRenamed(self.value, f"old{i}")
            out = out.join(other.hint("merge"), self.keys, "left")
            said.append(F.col(f"old{i}"))
        old = reduce(lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(self.merge(a, b)), said) if said else F.lit(None).cast(rows.schema[self.value].dataType)
        return out.select(*rows.columns, old.alias("old"))

    def merged(self, runs: list[tuple[str, str, int]]) -> DataFrame:
        """Merge join of runs: one row a key. Pairs of runs meet without a shuffle."""
        out = self.spark.table(runs[0][0])
        for name, _, _ in runs[1:]:
            other = self.spark.table(name).withColumnRenamed(self.value, "other")
            both = F.when(F.col(self.value).isNull(), F.col("other")).when(F.col("other").isNull(), F.col(self.value)).otherwise(self.merge(F.col(self.value), F.col("other")))
            out = out.join(other.hint("merge"), self.keys, "full_outer").select(*self.keys, both.alias(self.value))
        return out

    def push(self, run: tuple[str, str, int]) -> None:
        """The run becomes part of the index; a full tier is compacted into a run of the next."""
        self.runs.append(run)
        while True:
            tiers = [t for _, _, t in self.runs]
            full = next((t for t in sorted(set(tiers)) if tiers.count(t) >= MAX_RUNS), None)
            if full is None:
                return
            self._compact([r for r in self.runs if r[2] == full], full + 1)

    def _compact(self, old: list[tuple[str, str, int]], tier: int) -> None:
        new = self.write(self.merged(old), tier)
        self.runs = [r for r in self.runs if r not in old] + [new]
        self.drop(old)

    def drop(self, runs: list[tuple[str, str, int]]) -> None:
        for name, path, _ in runs:
            self.spark.sql(f"DROP TABLE {name}")
            drop_path(self.spark, path)


class FingerprintIndex(Runs):
    """The runs of grams: h, and n, the number of documents (up to two) that have it."""

    def __init__(self, spark: SparkSession, buckets: int, folder: str | None = None):
        super().__init__(spark, folder or scratch_path(spark, "grams"), "grams", ["h"], "h BIGINT, n INT", "n", lambda a, b: F.least(a + b, F.lit(2)), buckets)

    def run_of(self, batch: DataFrame) -> tuple[str, str, int]:
        # dealt by bucket once; the group-by and the bucketed write keep that partitioning, and tasks have combined before
        return self.write(batch.repartition(self.buckets, "h").groupBy("h").agg(F.least(F.sum("n"), F.lit(2)).cast("int").alias("n")))

    def add(self, batch: DataFrame) -> None:
        self.push(self.run_of(batch))

    def compact(self) -> None:
        if len(self.runs) > 1:
            self._compact(list(self.runs), max(t for _, _, t in self.runs) + 1)

    def repeated(self) -> DataFrame:
        return self.merged(self.runs).where("n > 1").select("h")

    def close(self) -> None:
        self.drop(self.runs)
        self.runs = []


class WindowIndex:
    """What earlier batches held; add_batch() tells which windows of a new one are repeats.

    With a folder the index outlives the session: runs and a manifest stay there and open() takes them up again.
    Without one it lies in the shared folder until close().
    """

    def __init__(self, spark: SparkSession, buckets: int, folder: str | None = None):
        self.spark, self.buckets, self.folder, self.turn = spark, buckets, folder or scratch_path(spark, "window-index"), 0
        self.grams = FingerprintIndex(spark, buckets, self.folder)
        self.windows = Runs(spark, self.folder, "windows", ["w", "v"], "w BIGINT, v INT, doc BIGINT", "doc", F.least, buckets)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> WindowIndex:
        """The index that the last finished add_batch() left in the folder."""
        turn = max(int(n.removeprefix("manifest-")) for n in file_names(spark, folder) if n.startswith("manifest-"))
        told = json.loads(read_file(spark, f"{folder}/manifest-{turn:08d}"))
        out = cls(spark, told["buckets"], folder)
        out.turn = turn
        for family in ("grams", "windows"):
            for name, tier in told[family]:
                getattr(out, family).reopen(f"{folder}/{name}", tier)
        return out

    def _keep(self) -> None:
        """The manifest of the runs there are; runs of a batch that failed are in none and are never read."""
        self.turn += 1
        told = {family: [[path.rpartition("/")[2], tier] for _, path, tier in getattr(self, family).runs] for family in ("grams", "windows")}
        put_file(self.spark, f"{self.folder}/manifest-{self.turn:08d}", json.dumps({"buckets": self.buckets, **told}))

    def add_batch(self, batch: DataFrame, earlier: DataFrame | None = None, last: bool = False) -> DataFrame:
        """doc, key, pos: the windows of the batch (id, text) that also start in a document with a smaller id.

        earlier: the documents of all batches before, asked only for those windows whose gram was one document's until
        now. Batches are meant to come in the order of their ids; answers given for earlier batches stand. After the
        last batch nothing more is remembered, which saves writing its windows.
        """
        if self.grams.runs and earlier is None:
            raise ValueError("the index holds batches: give their documents as `earlier`")
        run = self.grams.run_of(fingerprints(batch))
        met = self.grams.before(self.spark.table(run[0]))
        known = bloom.build(met.where("n > 1 OR old IS NOT NULL").select("h"))
        found = candidate_windows(batch, known)
        if self.grams.runs:
            found = found.union(candidate_windows(earlier, bloom.build(met.where("old = 1").select("h")), holders=True))
        rows = found.repartition(self.buckets, "w", "v")
        rows = self.windows.before(rows) if self.windows.runs else rows.select("*", F.lit(None).cast("long").alias("old"))
        told = rows.sortWithinPartitions("w", "v", "doc").mapInArrow(_later(not last), "w long, v int, doc long, key long, pos int")
        if last:
            self.grams.drop([run])
            return told.select("doc", "key", "pos")
        told = materialise(told, "windows")
        self.windows.push(self.windows.write(told.where("pos < 0").select("w", "v", "doc").repartition(self.buckets, "w", "v")))
        self.grams.push(run)
        self._keep()
        return told.where("pos >= 0").select("doc", "key", "pos")

    def close(self) -> None:
        """Drops the index and its folder."""
        for family in (self.grams, self.windows):
            family.drop(family.runs)
            family.runs = []
        drop_path(self.spark, self.folder)


def candidate_windows(df: DataFrame, known, holders: bool = False) -> DataFrame:
    """Of (id, text): windows that may be repeated: w, v (digest), doc, key, pos, settled.

    settled: a document with a smaller id in the same task has the window, so the answer is known. Of the others only
    the earliest document's rows are there. holders: the documents are asked only for what they have first; pos is -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            w, v, doc, key, pos = (np.concatenate([x[i] for x in held]) for i in range(5))
            order = np.lexsort((doc, v, w))
            w, v, doc, key, pos = w[order], v[order], doc[order], key[order], pos[order]
            first = np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
            if holders:
                w, v, doc = w[first], v[first], doc[first]
                key, pos, settled = np.zeros(len(w), np.int64), np.full(len(w), -1, np.int32), np.zeros(len(w), bool)
            else:
                settled = doc > doc[np.maximum.accumulate(np.where(first, np.arange(len(w)), 0))]
                # these compare with nothing any more: dealt at random, so that a common window's do not meet in one task
                w = np.where(settled, bloom.mix((key + pos).view(np.uint64)).view(np.int64), w)
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(v), pa.array(doc), pa.array(key), pa.array(pos), pa.array(settled)], ["w", "v", "doc", "key", "pos", "settled"])

        for batch in _slices(batches):
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                key = None
                for at, part in _parts(data or b""):
                    grams, chosen = part.winnowed()
                    distinct, which = np.unique(chosen, return_inverse=True)
                    hit = np.flatnonzero(known(grams[distinct])[which])
                    if len(hit):
                        if key is None:
                            key = row_key(data)
                        held.append((*part.digests(WINDOW, hit), np.full(len(hit), LAST if doc is None else doc), np.full(len(hit), key), (hit + at).astype(np.int32)))
                        size += len(hit)
                if size >= COMBINE:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return df.mapInArrow(run, "w long, v int, doc long, key long, pos int, settled boolean")


def _later(firsts: bool):
    """Over rows (w, v, doc, key, pos, settled, old) sorted by w, v, doc: those that a smaller doc, or old, precedes.

    firsts: also, with pos -1, the earliest doc of each window that history does not know from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            w, v, doc, pos, settled = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5))
            old = batch.column(6).fill_null(LAST).to_numpy()
            first = np.concatenate([[last is None or (w[0], v[0]) != last[:2]], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])
            at = np.maximum.accumulate(np.where(first, np.arange(len(w)), -1))
            earliest = np.where(at >= 0, np.minimum(doc, old)[np.maximum(at, 0)], last[2] if last else 0)
            last = (w[-1], v[-1], earliest[-1])
            late = pa.array((pos >= 0) & (settled | (doc > earliest)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(late) for i in range(5)], ["w", "v", "doc", "key", "pos"])
            if firsts:
                new = np.flatnonzero(first & ~settled & ((old > doc) | (old == LAST) & batch.column(6).is_null().to_numpy(zero_copy_only=False)))
                one = batch.take(pa.array(new))
                yield pa.RecordBatch.from_arrays([*(one.column(i) for i in range(4)), pa.array(np.full(len(new), -1, np.int32))], ["w", "v", "doc", "key", "pos"])

    return run


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by doc, key, pos: doc, key, n_removed and the removed word ranges [from, to) as a flat list."""

    def out(groups: list[tuple[int, int, list[np.ndarray]]]) -> pa.RecordBatch:
        docs, keys, counts, ranges = [], [], [], []
        for doc, key, found in groups:
            pos = np.unique(np.concatenate(found)).astype(np.int64)
            cut = np.concatenate([[True], pos[1:] > pos[:-1] + WINDOW])
            start, end = pos[cut], pos[np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(pos) - 1]])] + WINDOW
            docs.append(doc)
            keys.append(key)
            counts.append(int((end - start).sum()))
            ranges.append(np.stack([start, end], axis=1).ravel())
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(ranges, pa.list_(pa.int64()))], ["doc", "key", "n_removed", "ranges"])

    open_group: tuple[int, int, list[np.ndarray]] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, key, pos = (batch.column(i).to_numpy() for i in range(3))
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])).tolist()
        done = []
        for a, b in zip(cut, [*cut[1:], len(doc)], strict=True):
            if open_group and open_group[:2] == (doc[a], key[a]):
                open_group[2].append(pos[a:b])
            else:
                if open_group:
                    done.append(open_group)
                open_group = (doc[a], key[a], [pos[a:b]])
        if done:
            yield out(done)
    if open_group:
        yield out([open_group])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        docs, keys, counts, digests = [], [], [], []
        for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = (data or b"").split()
            digest = hashlib.sha256(b" ".join(words))
            docs.append(LAST if doc is None else doc)
            keys.append(int.from_bytes(digest.digest()[:8], "little", signed=True))
            counts.append(len(words))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["id", "doc", "key", "n_words", "digest"])


def kept_words(data: bytes, ranges: list[int]) -> bytes:
    words, out, at = data.split(), [], 0
    for start, end in zip(ranges[::2], ranges[1::2], strict=True):
        out += words[at:start]
        at = end
    return b" ".join(out + words[at:])


def buckets_for(n_bytes: int) -> int:
    """Buckets of a run: some two fingerprints for nine words of six bytes."""
    return min(BUCKETS_MAX, max(8, n_bytes // 27 // BUCKET_ROWS + 1))


def _ranges(gone: DataFrame) -> DataFrame:
    return gone.repartition("doc", "key").sortWithinPartitions("doc", "key", "pos").mapInArrow(_covered, "doc long, key long, n_removed long, ranges array<long>")


def removed_ranges(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None) -> DataFrame:
    """doc (the id, null as the largest long), key (see row_key), n_removed, ranges: rows of df that lose words.

    The corpus goes through an index of its own in `batches` ranges of the id, by default of some BATCH_BYTES of text
    each, so that the filter of a batch stays within its bound.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = batches or max(BATCHES_MIN, -(-n_bytes // BATCH_BYTES))
    cuts = sorted(set(docs.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] or [])) if batches > 1 else []
    index = WindowIndex(spark, buckets_for(n_bytes))
    try:
        gone = []
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = docs
            if low is not None:
                part = part.where((F.col("id") > low) | F.col("id").isNull() if high is None else F.col("id") > low)
            if high is not None:
                part = part.where(F.col("id") <= high)
            gone.append(index.add_batch(part, docs.where(F.col("id") <= low) if low is not None else None, last=high is None))
        return materialise(_ranges(reduce(DataFrame.union, gone)), "removed")
    finally:
        index.close()


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None) -> DataFrame:
    """One row per row of df: id, n_words, n_removed, kept_sha256.

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id; windows are those
    of the input. Ids are whole numbers; null ids count as larger than all others; null texts have no words; rows that
    share an id do not take words from each other; repeated rows give repeated rows; an empty table gives an empty one;
    further columns are not read.
    """
    return _results(df, removed_ranges(df, id_col, text_col, batches), id_col, text_col)


def deduplicate_batch(index: WindowIndex, df: DataFrame, earlier: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As deduplicate, for a new batch against everything the index holds; the batch then belongs to the index.

    earlier: the documents of the batches before. With batches in the order of their ids the answers together are those
    of one call over all rows.
    """
    narrow = lambda t: t.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    gone = index.add_batch(narrow(df), None if earlier is None else narrow(earlier))
    return _results(df, materialise(_ranges(gone), "removed"), id_col, text_col)


def _results(df: DataFrame, removed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    summaries = materialise(docs.mapInArrow(_summaries, "id long, doc long, key long, n_words long, digest string"), "summaries")
    joined = materialise(summaries.join(removed.select("doc", "key", "n_removed"), ["doc", "key"], "left"), "joined")
    n_removed = F.coalesce("n_removed", F.lit(0))
    simple = joined.where((n_removed == 0) | (n_removed == F.col("n_words")))
    out = simple.select(F.col("id").alias(id_col), "n_words", n_removed.alias("n_removed"), F.when(n_removed == 0, F.col("digest")).otherwise(EMPTY).alias("kept_sha256"))

    # texts are needed again only where a part of the words goes; the filter keeps most others out of the shuffle
    partly = materialise(joined.where((F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_words"))).select("doc", "key").distinct(), "partly")
    wanted = bloom.build(partly.select("doc"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            doc = np.array([LAST if x is None else x for x in batch.column(0).to_pylist()], np.int64)
            mask = pa.array(wanted(doc.view(np.uint64))) if len(doc) else pa.array([], pa.bool_())
            some = batch.filter(mask)
            data = [x or b"" for x in some.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(doc).filter(mask), pa.array(list(map(row_key, data)), pa.int64()), pa.array(data, pa.binary())], ["id", "doc", "key", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            data, ranges = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.split()) for x in data], pa.int64()), batch.column(2), pa.array([hashlib.sha256(kept_words(x, r)).hexdigest() for x, r in zip(data, ranges, strict=True)], pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    texts = docs.mapInArrow(pick, "id long, doc long, key long, data binary")
    partial = removed.join(partly, ["doc", "key"], "left_semi")
    rest = texts.join(partial, ["doc", "key"]).select("id", "data", "n_removed", "ranges").mapInArrow(cut, "id long, n_words long, n_removed long, kept_sha256 string")
    return out.union(rest.withColumnRenamed("id", id_col))
