import hashlib
import random

import numpy as np
import pytest

from lisible.llm import bloom, substring_dedup
from lisible.llm.substring_dedup import FingerprintIndex


def plain(rows):
    """Every window of every document against every document with a smaller id."""
    first, words = {}, []
    for i, t in rows:
        w = [x for x in (t or "").encode().split()]
        words.append(w)
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            i_ = float("inf") if i is None else i
            first[k] = min(first.get(k, float("inf")), i_)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < (float("inf") if i is None else i):
                gone.update(range(p, p + 13))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(n=140):
    rnd = random.Random(11)
    vocabulary = ["w%d" % i for i in range(60)] + ["É", "x\x85y", "Foo"]
    passages = [[rnd.choice(vocabulary) for _ in range(k)] for k in (12, 13, 14, 30, 80)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 6)):
            words += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))]
        rows.append(((i * 37) % 1009, "".join(w + rnd.choice([" ", "\n", " \t"]) for w in words)))
    rows += [(2000, rows[3][1]), (2001, rows[5][1]), (None, rows[5][1]), (2002, None), (2003, ""), (2004, "the " * 40), (2005, "the " * 15), (rows[9][0], rows[9][1]), (rows[9][0], rows[4][1])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many parts, many combined pieces, a full filter
        monkeypatch.setattr(substring_dedup, "PART_WORDS", 9)
        monkeypatch.setattr(substring_dedup, "COMBINE", 50)
        monkeypatch.setattr(bloom, "BITS_MAX", 1 << 10)
        monkeypatch.setattr(bloom, "BITS_MIN", 1 << 10)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int").repartition(6)
    got = sorted(map(tuple, substring_dedup.deduplicate(df, batches=3 if small else 2).collect()), key=str)
    want = plain(rows)
    assert got == want and sum(0 < r[2] < r[1] for r in want) > 20


def test_empty(spark):
    assert substring_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r)[:3] for r in substring_dedup.deduplicate(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0)]


def test_equal_windows_choose_equal_grams():
    rnd = random.Random(1)
    shared = [("s%d" % rnd.randrange(50)).encode() for _ in range(13)]
    for _ in range(50):
        texts = [b" ".join([b"x%d" % rnd.randrange(9) for _ in range(k)] + shared + [b"y%d" % rnd.randrange(9) for _ in range(9)]) for k in (3, 8)]
        (ga, ca), (gb, cb) = (substring_dedup.Words(t).winnowed() for t in texts)
        assert ga[ca[3]] == gb[cb[8]]
    a, b = substring_dedup.Words(b"a b c d"), substring_dedup.Words(b"zz a b c e")
    assert a.hashes(3, 0)[0] == b.hashes(3, 0)[1] and len(set(np.concatenate([a.hashes(3, 1), b.hashes(3, 1)]).tolist())) == 4


def test_runs_are_compacted(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MAX_RUNS", 3)
    index = FingerprintIndex(spark, 4)
    for hashes in ([1, 2, 3], [3, 4], [4, 5, 5], [1, 9]):
        index.add(spark.createDataFrame([(h, 1) for h in hashes], "h long, n int"))
        assert 1 <= len(index.runs) < 3
    assert sorted(r.h for r in index.repeated().collect()) == [1, 3, 4, 5]
    index.compact()
    assert len(index.runs) == 1 and sorted(r.h for r in index.repeated().collect()) == [1, 3, 4, 5]
    index.close()


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_windows_are_verified_by_their_words(spark):
    """Polynomial hashes modulo 2^64 collide on these two words for every odd base; the windows differ."""
    rest = " ".join("w%d" % i for i in range(12))
    rows = [(1, f"{thue_morse(4096)} {rest}"), (2, f"{thue_morse(4096, True)} {rest}"), (3, f"{thue_morse(4096)} {rest}")]
    a, b = (substring_dedup.Words(t.encode()) for _, t in rows[:2])
    assert a.hashes(13, 0)[0] == b.hashes(13, 0)[0]
    got = sorted(tuple(r) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain(rows) and [r[2] for r in got] == [0, 0, 13]


@pytest.mark.parametrize("folder", [False, True])
def test_batches_one_by_one_equal_one_call(spark, monkeypatch, tmp_path, folder):
    """Four batches in the order of their ids, the index closed and opened again in between, compacted on the way."""
    monkeypatch.setattr(substring_dedup, "MAX_RUNS", 2)
    rows = sorted((r for r in corpus(120) if r[0] is not None), key=lambda r: r[0])
    path = str(tmp_path / "index")
    index = substring_dedup.WindowIndex(spark, 3, path if folder else None)
    got, schema = [], "doc_id long, text string"
    cuts = [0, 30, 55, 100, len(rows)]
    cuts = [next((j for j in range(c, len(rows)) if rows[j][0] != rows[j - 1][0]), len(rows)) if 0 < c < len(rows) else c for c in cuts]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if folder and k:
            index = substring_dedup.WindowIndex.open(spark, path)
        earlier = spark.createDataFrame(rows[:a], schema) if a else None
        got += [tuple(r) for r in substring_dedup.deduplicate_batch(index, spark.createDataFrame(rows[a:b], schema), earlier).collect()]
    assert sorted(got, key=str) == plain(rows)
    assert len(index.grams.runs) < 4 and len(index.windows.runs) < 4
    with pytest.raises(ValueError):
        index.add_batch(spark.createDataFrame(rows[:1], "id long, text string"))
    index.close()
