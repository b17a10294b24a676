import random
from collections import Counter, defaultdict

import pytest

from lisible.llm import pfair_mix


def rows_of(spark, sizes, extra=()):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, s, f"t{i}"))
            i += 1
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows + list(extra), "doc_id long, source string, slot string").repartition(5)


@pytest.mark.parametrize("weights", [None, {"a": 1, "b": 2, "c": 0.5, "d": 0.2}])
def test_windows_and_deviation(spark, weights):
    df = rows_of(spark, {"a": 900, "b": 500, "c": 220, "d": 31})
    out = pfair_mix.mix(df, weights, block_rows=1).collect()
    assert sorted(r.doc_id for r in out) == list(range(1651))
    assert all(r.release <= r.slot < r.deadline for r in out)
    assert len({r.slot for r in out}) == len(out)
    sizes = df.groupBy(df.source.alias("src")).count().withColumnRenamed("count", "n")
    shares = {r.src: (r.slots, r.cycle) for r in pfair_mix.cycle_shares(sizes, weights).collect()}
    assert sum(s for s, _ in shares.values()) == 1000
    left, sent = Counter(r.source for r in out), Counter()
    by_slot = {r.slot: r.source for r in out}
    for t in range(max(by_slot) + 1):
        if t not in by_slot:
            break
        sent[by_slot[t]] += 1
        left[by_slot[t]] -= 1
        for s, (c, cycle) in shares.items():
            assert abs(sent[s] - (t + 1) * c / cycle) < 1
        if not all(left.values()):
            break
    assert sum(sent.values()) > 300


def test_blocks_are_filled_in_order(spark):
    out = pfair_mix.mix(rows_of(spark, {"a": 300, "b": 77}), block_rows=16).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append((r.block, r.position))
    for s, n in (("a", 300), ("b", 77)):
        assert sorted(by[s]) == [(i // 16, i % 16) for i in range(n)]


def test_odd_rows(spark):
    extra = [(None, None, None), (None, "a", "x"), (3, "a", "t3"), (3, "a", "t3"), (7, None, "y"), (8, "", "z")]
    df = rows_of(spark, {"a": 20, "unnamed": 4}, extra)
    out = pfair_mix.mix(df).collect()
    assert len(out) == 30 and Counter(r.source for r in out) == {"a": 23, "unnamed": 4, "": 3}
    part = pfair_mix.mix(df, {"a": 1.0}).collect()
    assert len(part) == 30 and all((r.slot is None) == (r.source != "a") for r in part)
    assert pfair_mix.mix(df.limit(0)).count() == 0
    kept = pfair_mix.mixed_rows(df)
    assert kept.columns == df.columns and Counter(map(tuple, kept.collect())) == Counter(map(tuple, df.collect()))
    assert pfair_mix.mixed_rows(df.limit(0)).count() == 0


def test_mixed_rows_are_in_order(spark):
    df = rows_of(spark, {"a": 400, "b": 100})
    places = {r.doc_id: (r.slot, r.position) for r in pfair_mix.mix(df).collect()}
    got = [places[r.doc_id] for r in pfair_mix.mixed_rows(df).collect()]
    assert got == sorted(got)
