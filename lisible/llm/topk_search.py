"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks by a hash of their id, queries into chunks, and each pair of block and chunk is one
unit of work of bounded size. A block keeps one sorted list for each dimension. A query reads its lists in step, from
the end that suits the sign of its component, scores each vector on first sight, and stops when the bound, the score
of a vector that had in every dimension the value last read, cannot beat the kth score so far. The k best of each
block then meet for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Candidates of a block and queries of a chunk, about; small tables are still dealt into some blocks.
BLOCK_ROWS, CHUNK_ROWS, SOME_BLOCKS, LEAST_ROWS = 4096, 4096, 16, 512
#: Entries of each list that are read at first; each further round reads twice as many.
FIRST_READ = 16
TOP = (1 << 63) - 1


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, v array<long>: floor(scale * x) as double; vectors that are null or hold null or non-finite components go."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(v).all():
                    ids.append(i)
                    out.append(np.clip(np.floor(v * scale), -(2.0**62), 2.0**62).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(out, pa.list_(pa.int64()))], ["id", "v"])

    return df.select(id_col, vector_col).mapInArrow(run, f"id {kind}, v array<long>")


class Block:
    """The candidates of one block that have one dimension, and their sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.values = ids, vectors
        self.rising = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.rising, axis=0)

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best, ties to smaller ids, and how many vectors were scored."""
        n, used = len(self.ids), np.flatnonzero(q != 0)
        score = np.zeros(n, self.values.dtype)
        seen = self.ids == query_id  # a row does not compete with itself
        own = int(seen.sum())
        alive = ~seen
        if not len(used):  # every score is 0
            seen[:] = True
        up, at, step, kth = q[used] > 0, 0, FIRST_READ, None
        while at < n and not seen.all():
            to = min(n, at + step)
            falling = self.rising[n - to : n - at, used]
            fresh = np.zeros(n, bool)
            fresh[np.where(up, falling, self.rising[at:to, used]).ravel()] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            score[new] = self.values[new] @ q
            at, step = to, 2 * step
            found = score[seen & alive]
            if len(found) >= k:
                kth = np.sort(found)[-k] if found.dtype == object else np.partition(found, len(found) - k)[len(found) - k]
                last = np.where(up, self.sorted[n - to, used], self.sorted[to - 1, used])
                if (last * q[used]).sum() < kth:  # at equality an unseen vector could tie with a smaller id
                    break
        rows = np.flatnonzero(seen & alive)
        if kth is not None and len(used):
            rows = rows[score[rows] >= kth]
        order = np.lexsort((self.ids[rows], np.negative(score[rows]).astype(np.float64))) if score.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (-score[rows[i]], self.ids[rows[i]])), np.int64)
        rows = rows[order[:k]]
        return self.ids[rows], score[rows], int(seen.sum()) - own


def _matrices(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) for each dimension there is."""
    ids, lists = table.column("id").combine_chunks().to_numpy(zero_copy_only=False), table.column("v").combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat, start = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield ids[rows], flat[(start[rows][:, None] + np.arange(d)[None, :])].reshape(len(rows), d)


def _exact(vectors: np.ndarray, other: np.ndarray) -> np.dtype:
    """A type in which every inner product is exact: doubles below 2^53, else Python's integers."""
    most = max(1, int(np.abs(vectors).max(initial=0))) * max(1, int(np.abs(other).max(initial=0))) * max(1, vectors.shape[1])
    return np.dtype(np.float64) if most < 1 << 53 else np.dtype(object)


def top_k(df: DataFrame, k: int, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, every_row: bool = False) -> DataFrame:
    """query_id, rank (from 1), id, score: for every query the k other rows with the highest inner products.

    Components become floor(scale * x) and scores are exact whole numbers; ties go to the smaller id; a query with
    fewer rows beside it gets all of them, one with none has no row here. Rows whose id or vector is null or whose
    vector holds null or non-finite components take no part. Of rows that repeat an id the one with the least vector
    takes part; with every_row all do, each a candidate of its own, and a query competes with no row of its id. Only vectors of the query's own length compare. An empty table gives an empty one. Components are held to
    2^62 and scores to the range of a long.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = whole_numbers(df, id_col, vector_col, scale)
    if not every_row:
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    rows = materialise(rows.withColumnRenamed("id", id_col).withColumn("asks", is_query).withColumnRenamed(id_col, "id"), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks = max(-(-n // BLOCK_ROWS), min(SOME_BLOCKS, -(-n // LEAST_ROWS)), 1)
    chunks = max(-(-n_queries // CHUNK_ROWS), 1)
    block, chunk = F.pmod(F.xxhash64("id"), F.lit(blocks)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks))
    candidates = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "id", "v")
    queries = rows.where("asks").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), chunk.alias("chunk"), "id", "v")

    def work(candidate_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        asked = {v.shape[1]: (ids, v) for ids, v in _matrices(query_rows)} if query_rows.num_rows else {}
        out: list[tuple[list, list, list]] = []
        for ids, vectors in _matrices(candidate_rows) if asked and candidate_rows.num_rows else ():
            if vectors.shape[1] in asked:
                query_ids, qs = asked[vectors.shape[1]]
                exact = _exact(vectors, qs)
                own = Block(ids, vectors.astype(exact))
                for i, q in zip(query_ids.tolist(), qs.astype(exact), strict=True):
                    found, scores, _ = own.best(i, q, k)
                    out.append(([i] * len(found), found.tolist(), [min(TOP, max(-TOP - 1, int(s))) for s in scores.tolist()]))
        q, c, s = ([x for part in out for x in part[j]] for j in range(3))
        kinds = query_rows.schema.field("id").type
        return pa.table({"query_id": pa.array(q, kinds), "id": pa.array(c, kinds), "score": pa.array(s, pa.int64())})

    pairs = candidates.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(work, f"query_id {kind}, id {kind}, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
