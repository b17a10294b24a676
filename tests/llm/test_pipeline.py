import hashlib
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from lisible.llm import byte_bpe, simhash, toxicity

from .test_simhash import plain_fingerprint


def test_run_equals_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("bcdlmnrst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(500)]
    docs, labels = [], []
    for i in range(420):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 150))]
        if i % 6 == 0:
            words[3:3] = ["idiot", "zorgal"]
            words[9:9] = ["zorgen", "scum"]
        docs.append((i, " ".join(words), "en", f"s{0 if i % 3 else i % 7}", 1))
        labels.append((i, 1, int(i % 6 == 0)))
    for j in range(60):
        i, t, lang, s, n = docs[rnd.randrange(420)]
        docs.append((1000 + j, t.replace(" ", "\n", 3) if j % 2 else t + " end", lang, s, n))
    docs += [(2000, None, None, None, None), (2001, "", "fr", "s1", 0), (None, "short", None, "s1", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    read = lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet")
    model = toxicity.fit(read("documents"), read("labels"))
    left = [(i, t) for (i, t, *_), p in zip(docs, model.score([d[1] or "" for d in docs]), strict=True) if p < 0.5]
    assert 330 < len(left) < len(docs) - 50
    first = {}
    for i, t in left:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    order = lambda i: (i is None, i or 0)
    stay = {min(ids, key=order) for ids in first.values()}
    left = [(i, t) for i, t in left if i in stay]
    fps = {i: plain_fingerprint(t or "") for i, t in left if i is not None}
    wide = {i: simhash.wide_fingerprint((t or "").encode()) for i, t in left if i is not None}
    bits = lambda a, b: (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    near = {i: [j for j in fps if j != i and ((fps[i] ^ fps[j]).bit_count() <= 3 or bits(wide[i], wide[j]) <= simhash.WIDE_BITS)] for i in fps}
    roots = {}
    for i in sorted(fps):
        todo = [] if i in roots else [i]
        while todo:
            j = todo.pop()
            if j not in roots:
                roots[j] = i
                todo += near[j]
    left = [(i, t) for i, t in left if i is None or roots[i] == i]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(open(path, "rb").read()), special_tokens={})
    want = []
    for i, t in left:
        ids = real.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_stages_keep_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_order_of_the_mix_survives_rereading(spark, tmp_path):
    """Part files of different sizes, which Spark reads largest first."""
    rnd = random.Random(9)
    docs = [(i, "w " * (1 + i % 300), "en", rnd.choice("aab"), 1) for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, df, str(tmp_path))
    places = {r.doc_id: (r.slot, r.position) for r in corpus_pipeline.pfair_mix.mix(df).collect()}
    own = mixed.collect()
    assert [places[r.doc_id] for r in own] == sorted(places.values())
    for k, part in enumerate((own[:200], own[200:1900], own[1900:])):
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append" if k else "overwrite").parquet(f"{tmp_path}/mixed")
    reread = spark.read.parquet(f"{tmp_path}/mixed")
    assert [r.doc_id for r in reread.collect()] != [r.doc_id for r in own]
    out = corpus_pipeline.tokenise(spark, reread, str(tmp_path)).collect()
    assert [places[r.doc_id] for r in out] == sorted(places.values())
