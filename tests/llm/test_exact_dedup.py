import hashlib
import random
import re
from collections import defaultdict

from lisible.llm import exact_dedup


def corpus():
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 4))) for _ in range(400)]
    rows = [(i * 13 % 997, t.replace(" ", rnd.choice([" ", "\n", "\t \r"])), i) for i, t in enumerate(texts)]
    return rows + [(5000, None, 0), (5001, "", 0), (None, "a b", 0), (None, None, 0), (7, "same", 1), (7, "same", 1), (None, "only here", 2), (6000, "x y", 1), (6001, "x y", 1), (6002, "x\x85y", 1)]


def plain(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for t, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, order[0], len(ids), at == 0, hashlib.sha256(t.encode()).hexdigest()) for at, i in enumerate(order)]
    return sorted(out, key=str)


def test_rows(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, hash long").repartition(5)
    for most in (1 << 27, 1 << 10):  # the second filter is full: everything is shuffled, nothing changes
        monkeypatch.setattr(exact_dedup, "FILTER_BITS_MAX", most)
        assert sorted(map(tuple, exact_dedup.exact_duplicates(df).collect()), key=str) == plain(rows)
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_filter_spares_rows_without_repeats(spark):
    df = spark.range(5000).select(exact_dedup.text_hash(exact_dedup.F.col("id").cast("string")).alias("hash")).repartition(7)
    bits = exact_dedup.filter_bits(5000)
    twice = exact_dedup.repeated_bits(df.union(df.limit(3)), bits)
    assert 0 < twice.mean() < 0.05


def test_kept_rows(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, text_hash long").repartition(3)
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    want = sorted((r[0], r[4]) for r in plain(rows) if r[3] and r[0] is not None)
    norm = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    got = kept.collect()
    assert sorted((r.doc_id, norm(r.text)) for r in got if r.doc_id is not None) == want
    assert [r.text for r in got if r.doc_id is None] == ["only here"]
    assert exact_dedup.drop_exact_duplicates(df.limit(0)).count() == 0


def test_any_column_type_and_large_groups(spark, monkeypatch):
    """Map columns, clashing names, one text shared by a third of the rows, and full filters."""
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 400}", {"k": i}, i) for i in range(3000)] + [(None, "the same text", {"k": 1}, 1), (0, "the same  text", {"k": 2}, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,int>, of_hash int").repartition(6)
    for most in (1 << 27, 1 << 10):
        monkeypatch.setattr(exact_dedup, "FILTER_BITS_MAX", most)
        monkeypatch.setattr(exact_dedup.bloom, "BITS_MAX", most)
        monkeypatch.setattr(exact_dedup.bloom, "BITS_MIN", 1 << 10)
        kept = exact_dedup.drop_exact_duplicates(df)
        want = {}
        for i, t, _, _ in rows:
            if i is not None:
                want.setdefault(re.sub(r"\s+", " ", t), i)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want.values())
