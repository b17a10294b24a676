import random

import numpy as np
import xxhash

from lisible.llm import simhash


def plain_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: dict[int, int], bits: int = 3) -> dict[int, int]:
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def corpus(n: int = 240) -> dict[int, str]:
    rnd, out = random.Random(5), {}
    words = ["w%d" % i for i in range(400)] + ["É", "ñ", "A\x85b", "x y"]
    for i in range(n):
        if i % 3 and out:
            base = out[rnd.choice(sorted(out))].split(" ")
            if rnd.random() < 0.6:
                base[rnd.randrange(len(base))] = rnd.choice(words)
            out[i * 7 % 1009] = " ".join(base)
        else:
            out[i * 7 % 1009] = "".join(rnd.choice(words) + rnd.choice([" ", "\n", "\t ", " "]) for _ in range(rnd.randint(0, 300)))
    return out | {2000: "", 2001: " \n", 2002: "one", 2003: "ONE", 2004: "one two", 2005: "É two three four"}


def test_fingerprints(monkeypatch):
    texts = [*corpus().values()]
    want = [plain_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t.encode()) for t in texts] == want
    monkeypatch.setattr(simhash, "PART", 5)
    assert [simhash.fingerprint(t.encode()) for t in texts] == want


def test_near_duplicates(spark):
    texts = corpus()
    rows = [(i, t, 1) for i, t in texts.items()] + [(3000, None, 2), (2002, "one", 3), (None, "one two", 4)]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    want = plain_components({i: plain_fingerprint(t) for i, t in (texts | {3000: ""}).items()})
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id == want[2004]
        else:
            assert r.component_id == want[r.doc_id]
            assert r.fingerprint == "%016x" % plain_fingerprint(texts.get(r.doc_id, ""))
    assert len(set(want.values())) < len(want) - 20
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_of_fingerprints(spark):
    """Long chains, stars and bit 63: links between different fingerprints alone."""
    rnd = random.Random(2)
    fps, x = {}, (1 << 64) - 1
    for i in range(300):
        fps[i] = x
        x = rnd.getrandbits(64) if i % 40 == 39 else x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
    nodes = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in fps.items()], "low long, fp long")
    links = simhash.postings(nodes).repartition("key").sortWithinPartitions("key").mapInArrow(simhash._links(3), "u long, v long")
    from lisible.llm.common import connected_components

    got = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(links, "t").collect()}
    want = plain_components(fps)
    for i in fps:
        for j in fps:
            assert (got.get(fps[i], fps[i]) == got.get(fps[j], fps[j])) == (want[i] == want[j])


def test_large_lists_equal_pairwise(monkeypatch):
    rnd = np.random.default_rng(3)
    fps = np.unique(rnd.integers(0, 1 << 16, 900).astype(np.uint64) * np.uint64(33) | np.uint64(1 << 63))
    rnd.shuffle(fps)
    by_lookup = simhash.forest(fps, 3)
    monkeypatch.setattr(simhash, "PAIRWISE_UP_TO", 10**6)
    pairwise = simhash.forest(fps, 3)
    same = lambda x: {frozenset(np.flatnonzero(x == r)) for r in set(x.tolist())}
    assert same(by_lookup) == same(pairwise)


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(5, "a b c d", "x"), (2, "a b c d", "y"), (9, "quite another text here", "z"), (None, "a b c d", "n")], "doc_id long, text string, source string")
    assert sorted((r.doc_id or 0) for r in simhash.keep_one_of_each_group(df).collect()) == [0, 2, 9]


def jaccard(a: str, b: str) -> float:
    x, y = ({" ".join(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_texts_are_found_and_others_left(spark, monkeypatch):
    rnd = random.Random(12)
    words = ["w%d" % i for i in range(3000)]
    texts, pairs = {}, []
    for i in range(150):
        base = [rnd.choice(words) for _ in range(rnd.randint(80, 300))]
        texts[2 * i] = " ".join(base)
        for _ in range(max(1, len(base) * rnd.choice([0, 1, 2, 4]) // 200)):
            base[rnd.randrange(len(base))] = "changed"
        texts[2 * i + 1] = " ".join(base)
    df = spark.createDataFrame([*texts.items(), (9000, None), (9001, " "), (None, texts[0])], "doc_id long, text string")
    for small in (16, 1):  # with 1 every list grows its groups
        monkeypatch.setattr(simhash, "SMALL_LIST", small)
        roots = {r.node: r.root for r in simhash.similar_groups(df).collect()}
        near = [i for i in range(0, 300, 2) if jaccard(texts[i], texts[i + 1]) >= 0.85]
        assert len(near) > 80 and sum(roots.get(i + 1) == i for i in near) >= 0.95 * len(near)
        assert all(root in (node, node - 1) for node, root in roots.items())
        assert roots[9001] == 9000


def test_wide_fingerprint():
    a = "one two three four five six seven"
    assert simhash.wide_fingerprint(b"") == bytes(32) != simhash.wide_fingerprint(b"one")
    assert simhash.wide_fingerprint(a.encode()) == simhash.wide_fingerprint(a.upper().replace(" ", "\n ").encode())
    positions = simhash._positions()
    assert len(set(positions)) == 64 and all(sum(p in pair for pair in positions) == 4 for p in range(32))


def near_pairs(seed: int, n: int, share: float) -> dict[int, str]:
    """2 i and 2 i + 1 are copies with so many changed words that their similarity is about `share`."""
    rnd, texts = random.Random(seed), {}
    for i in range(n):
        base = ["v%d" % rnd.randrange(50_000) for _ in range(rnd.randint(150, 400))]
        texts[2 * i] = " ".join(base)
        for _ in range(round(len(base) * (1 - share) / (1 + share) / 5)):
            base[rnd.randrange(len(base))] = "changed"
        texts[2 * i + 1] = " ".join(base)
    return texts


def test_all_pairs_at_the_threshold_are_found(spark, monkeypatch):
    """Recall at 0.8 and little above is that of brute force; so it is in lists that are large or of common shingles."""
    texts = near_pairs(4, 150, 0.81)
    shared = " ".join(texts[0].split()[:60])
    texts |= {1000 + i: f"{t} {shared}" for i, t in near_pairs(5, 40, 0.8).items()}
    near = [i for i in texts if i % 2 == 0 and jaccard(texts[i], texts[i + 1]) >= 0.8]
    assert 100 < len(near) and sum(jaccard(texts[i], texts[i + 1]) < 0.83 for i in near) > 60
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    for small, least in ((16, 4), (2, 10**6)):
        monkeypatch.setattr(simhash, "SMALL_LIST", small)
        monkeypatch.setattr(simhash, "COMMON_LEAST", least)
        roots = {r.node: r.root for r in simhash.similar_groups(df).collect()}
        assert all(roots.get(i + 1) == i for i in near)


def test_filters_never_drop_similar_sets():
    rnd = np.random.default_rng(8)
    for n in [*range(1, 40), 100, 127, 128, 129, 1000] * 4:
        own = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        keep = own[rnd.permutation(n)[: n - rnd.integers(0, n // 8 + 1)]]
        other = np.unique(np.concatenate([keep, rnd.integers(0, 1 << 63, rnd.integers(0, n // 8 + 1)).astype(np.uint64)]))
        common = np.sort(own[:: int(rnd.integers(1, 5))])
        if simhash.similar(own, other):
            assert np.isin(simhash.prefix(own, common), simhash.prefix(other, common)).any()
            assert simhash.may_be_similar(len(own), simhash.parities(own), len(other), simhash.parities(other))
            (a, b), (c, d) = (map(lambda x: np.array([x], np.int64), simhash.short_parities(s)) for s in (own, other))
            assert simhash._plausible(np.array([len(own)]), np.array([len(other)]), (a, c), (b, d))[0]


def test_links_are_verified_on_the_texts(spark):
    """Repeats, which fingerprints count and sets do not, link no texts; nor do 64-bit fingerprints of texts under 0.8."""
    rnd, texts = random.Random(1), {}
    for i in range(0, 20, 2):
        passage = " ".join("q%d" % rnd.randrange(5000) for _ in range(30))
        for j in (i, i + 1):
            texts[j] = " ".join([passage] * 10 + ["q%d" % rnd.randrange(5000) for _ in range(100)])
    for i in range(100, 120, 2):
        passage = " ".join("r%d" % rnd.randrange(5000) for _ in range(9))
        for j in (i, i + 1):
            texts[j] = " ".join([passage] * 100 + ["r%d" % rnd.randrange(5000) for _ in range(10)])
    assert all(jaccard(texts[i], texts[i + 1]) < 0.8 for i in texts if i % 2 == 0)
    apart = [(simhash.fingerprint(texts[i].encode()) ^ simhash.fingerprint(texts[i + 1].encode())).bit_count() for i in range(100, 120, 2)]
    assert min(apart) <= 3
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert simhash.similar_groups(df).count() == 0


def test_groups_come_through_the_byte_position_index(spark, monkeypatch):
    """The index of fingerprints links first, verified on the texts; the exact search asks only for what it has not joined."""
    rnd = random.Random(21)
    words = ["w%d" % i for i in range(5000)]
    base = [[rnd.choice(words) for _ in range(900)] for _ in range(12)]
    texts = {2 * i: " ".join(b) for i, b in enumerate(base)} | {2 * i + 1: " ".join([*b, "end"]) for i, b in enumerate(base)}
    prints = {i: simhash.set_fingerprint(simhash.shingle_set(t.encode())) for i, t in texts.items()}
    near = [i for i in range(0, 24, 2) if ((prints[i] ^ prints[i + 1]) % (1 << 64)).bit_count() <= simhash.MAX_BITS]
    assert len(near) >= 10
    asked, real = [], simhash._verified

    def verified(pairs, nodes, *rest):
        out = real(pairs, nodes, *rest)
        asked.append(({tuple(sorted(r)) for r in pairs.where("u <> v").distinct().collect()}, {tuple(sorted(r)) for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "_verified", verified)
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    roots = {r.node: r.root for r in simhash.similar_groups(df).collect()}
    assert roots == {i: i - i % 2 for i in texts}
    names = {i: simhash._name(simhash.shingle_set(t.encode())) for i, t in texts.items()}
    pair = lambda i: tuple(sorted((names[i], names[i + 1])))
    assert {pair(i) for i in near} <= asked[0][0] and {pair(i) for i in near} <= asked[0][1]
    assert not {pair(i) for i in near} & asked[1][1]
