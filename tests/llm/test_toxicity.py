import random
import zlib

import numpy as np

from lisible.llm import boosting, toxicity


def test_isotonic_is_monotone_and_pools():
    knots, values = boosting.fit_isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert list(np.round(knots, 2)) == [0.1, 0.25, 0.4] and (np.diff(values) > 0).all() and (0 <= values).all() and (values <= 1).all()


def test_trees_learn_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.random((1500, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] > 0.3)).astype(float)
    held = boosting.sigmoid(boosting.fit_trees(x[:1000], y[:1000]).margin(x[1000:])) >= 0.5
    assert (held == y[1000:]).mean() > 0.97


def test_features_by_hand():
    x = dict(zip(toxicity.FEATURES, toxicity.features_of("You are an IDIOT! an 1d1ot, id1ot? sooo vequ", {"vequ": 2.0}, {"vequ"}), strict=True))
    assert x["fixed_hits"] == 1 and x["learnt_hits"] == 1 and x["learnt_most"] == 2.0 and x["second_density"] == 1 / 9
    assert x["near_second"] == 1 / 9 and x["shouted"] == 1 / 9 and x["masked_hits"] == 1 and x["exclaimed"] == 1 / 9
    assert len(toxicity.features_of("", {}, set())) == len(toxicity.FEATURES)


def corpus(n: int = 1500):
    rnd = random.Random(9)
    common = ["".join(rnd.choice("bcdlmnrst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(common) for _ in range(rnd.randint(20, 120))]
        bad = i % 7 == 0
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zorgal", "zorgen", "zorgix", "idiot"]))
        docs.append((i, " ".join(words), "s", 1.0))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_rows(spark):
    docs, labels = corpus()
    more = [(None, None, None, None), (90_000, "", "s", 0.0), (5, docs[5][1], "s", 1.0)]
    d = spark.createDataFrame(docs + more, "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1), (77_777, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(d, lab).collect()
    assert len(out) == len(docs) + 3
    truth, right = {i: t for i, _, t in labels}, []
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert np.mean(right) > 0.97
    clean = toxicity.drop_toxic(d, lab)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in out if not r.predicted}


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(600)
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, score double")
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (dict(map(tuple, toxicity.toxicity(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).select("doc_id", "score").collect())) for x in (labels, flip))
    assert a == b


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(d, none).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), none).count() == 0
