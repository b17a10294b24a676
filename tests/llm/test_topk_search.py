import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lisible.llm import topk_search


def plain(rows, k):
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(256 * y) for y in v]
            ints[i] = min(ints.get(i, x), x)
    out = []
    for q in sorted(ints):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


def corpus(n=700, d=6, levels=None):
    rnd = random.Random(3)
    value = (lambda: rnd.gauss(0, 0.3)) if levels is None else (lambda: rnd.choice(levels))
    return [(i, [value() for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("levels", [None, [0.0, 0.5, -0.5]])
def test_equals_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk_search, "CHUNK_ROWS", 5)
    rows = corpus(levels=levels)
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [math.inf] * 6), (1150, [math.nan] * 6), (None, [1.0] * 6), (1200, [0.5, 0.5]), (1201, [0.25, 0.5]), (1250, []), (1300, [0.0] * 6)]
    rows += [(50, [9.0] * 6), (60, rows[60][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = topk_search.top_k(df, 5, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == plain(rows, 5)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    run = lambda rows: [tuple(r) for r in topk_search.top_k(spark.createDataFrame(rows, schema), 5, F.col("vec_id") % 50 == 0).collect()]
    assert run([]) == [] and run([(50, [1.0])]) == []
    assert run([(50, [1.0]), (7, [-1.0])]) == [(50, 1, 7, -65536)]


def test_large_components_stay_exact():
    big = np.array([[2**40, 1], [2**40, 2], [2**40, 3]], np.int64)
    own = topk_search.Block(np.array([1, 2, 3]), big.astype(topk_search._exact(big, big)))
    ids, scores, _ = own.best(1, np.array([2**40, 1], object), 1)
    assert list(ids) == [3] and list(scores) == [2**80 + 3]


def test_threshold_stops_early():
    rnd = np.random.default_rng(2)
    x = rnd.integers(-100, 100, (5000, 3)).astype(float)
    own = topk_search.Block(np.arange(5000), x)
    ids, scores, scored = own.best(-1, np.array([3.0, -2.0, 0.0]), 5)
    want = sorted((-s, i) for i, s in enumerate((x @ [3.0, -2.0, 0.0]).tolist()))[:5]
    assert [(-s, i) for s, i in zip(scores, ids, strict=True)] == want and scored < 2500


def test_every_row_is_a_candidate(spark):
    """Rows that repeat an id count one by one, as in the query's SQL; only rows of the query's own id do not."""
    import duckdb

    from lisible.llm.queries import OP3_SQL

    rows = [(50, [1.0, 0.5]), (1, [0.5, 0.5]), (1, [0.25, 1.0]), (2, [0.5, 0.5]), (100, [0.5, -0.5]), (None, [1.0, 1.0]), (3, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk_search.top_k(df, 5, F.col("vec_id") % 50 == 0, every_row=True).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert got == sorted(con.sql(OP3_SQL).fetchall()) and len(got) == 8
