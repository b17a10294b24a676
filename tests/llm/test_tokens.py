import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from lisible.llm import byte_bpe, unigram_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = byte_bpe.read_ranks(open(PATH, "rb").read())
REAL = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "a", "Hello world, it's 42!\n\n  x", "é" * 300, "aaaaaaaaab" * 700, "日本語のテキスト 😀😀", "<|endoftext|> x", "\t\r\n \x0b", "ab" * 20_000]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.ByteBPE(RANKS, PATTERN)


def noise(seed: int) -> str:
    rnd = random.Random(seed)
    return "".join(rnd.choice("aabbcde éèü '.,\n0123日€😀") for _ in range(rnd.randint(1, 400)))


def test_encoding_equals_tiktoken(codec):
    for text in TEXTS + [noise(i) for i in range(150)]:
        ids = codec.encode(text)
        assert ids == REAL.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_long_text_in_parts_equals_whole(codec, monkeypatch):
    text = " ".join(noise(i) for i in range(80))
    whole = codec.digest(text)
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(byte_bpe, "PART", 7)
    monkeypatch.setattr(byte_bpe, "MEMO_ENTRIES", 5)
    assert codec.digest(text) == whole and codec.encode(text) == REAL.encode_ordinary(text)


def merged_by_scan(piece: bytes, ranks: dict) -> tuple:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while piece not in ranks:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if found is None:
            return tuple(ranks[p] for p in parts)
        parts[found[1] : found[1] + 2] = [b"".join(parts[found[1] : found[1] + 2])]
    return (ranks[piece],)


@pytest.mark.parametrize("seed", range(6))
def test_one_queue_for_many_pieces_equals_scan_for_any_ranks(seed, monkeypatch):
    """Ranks in no order of training, so a merge often makes a pair of a lower rank than its own."""
    rnd = random.Random(seed)
    tokens = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 6))) for _ in range(250)}
    tokens = [bytes([b]) for b in range(256)] + sorted(tokens)
    rnd.shuffle(tokens)
    ranks = {t: r for r, t in enumerate(tokens)}
    codec = byte_bpe.ByteBPE(ranks, PATTERN)
    pieces = list({"".join(rnd.choice("aabbcdé") for _ in range(rnd.randint(1, 40))) for _ in range(400)}) + ["ab" * 300]
    monkeypatch.setattr(byte_bpe, "SHARED", rnd.choice([1, 100, 1 << 18]))
    assert codec.encode_new(pieces) == {p: merged_by_scan(p.encode(), ranks) for p in pieces}
    assert not codec.queue.buckets and not any(codec.buckets) and not any(codec.queue.low) and not any(codec.queue.mid)


def test_chunks_have_the_matches_of_the_whole_text(codec):
    rnd = random.Random(5)
    parts = [*" \n\t\r\x0b\x1c\x1f\x85\xa0\u2028\u3000", " ", "  ", "a", "é", "4", "²", "'", "'s", "'ve", "_", ".", "!?", "日本", "😀", "\u0301"]
    for text in TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]:
        first, *rest = codec.cut(text)
        assert [p for c in (first[1:], *(" " + c for c in rest)) for p in codec.split(c)] == codec.split(text)


def test_repeated_words_are_cut_up_and_encoded_once(codec, monkeypatch):
    """What a worker has seen costs it a look-up: the pattern and the queue see only what is new, over all texts together."""
    words = [f"word{i}x," for i in range(300)]
    texts = [" ".join(words[i % 7 :]) for i in range(60)]
    cut, queued = [], []
    own = byte_bpe.ByteBPE(RANKS, PATTERN)
    split, short = own.split, own.encode_short
    own.split = lambda t: cut.append(t) or split(t)
    own.encode_short = lambda pieces: queued.append(len(pieces)) or short(pieces)
    want = [(len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts for ids in [REAL.encode_ordinary(t)]]
    assert own.digests(texts) == want and own.digests(texts[::-1]) == want[::-1]
    assert len(cut) <= 307 and len(queued) == 1


def test_digests_of_a_group_equal_each_text_alone(codec, monkeypatch):
    texts = TEXTS + [noise(i) for i in range(60)] + ["x" * 300 + " y", " lead", "trail ", "a \nb"]
    whole = [codec.digest(t) for t in texts]
    assert codec.digests(texts) == whole and codec.digests([]) == []
    for name, value in (("GROUP", 50), ("LONG_TEXT", 300), ("MEMO_ENTRIES", 5)):
        monkeypatch.setattr(byte_bpe, name, value)
        assert codec.digests(texts) == whole
    assert all(len(m) < 5 and len(m.old) < 200 for m in (codec.memo, codec.chunks))
    other = byte_bpe.ByteBPE(RANKS, r"\S+|\s+")
    assert other.digests(texts) == [other.digest(t) for t in texts] and not other.chunks


def test_memory_keeps_what_comes_up_again(monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO_ENTRIES", 3)
    memory = byte_bpe.Memory()
    for keys in ("abc", "ad", "aef", "agh"):
        new = memory.unknown(set(keys))
        assert ("a" in new) == (keys == "abc") and not memory.keys() & set(new)
        memory.update(zip(new, new))
        assert all(memory[k] == k for k in keys)
        memory.settle(new)
        assert len(memory) < 3
    assert "a" in memory.old and memory.unknown({"b"}) == ["b"] and memory.unknown({"x" * 400}) == ["x" * 400]


def test_rank_queue_orders_ranks_then_positions():
    q, rnd = byte_bpe.RankQueue(50_000), random.Random(1)
    want = [(rnd.randrange(50_000), rnd.randrange(30)) for _ in range(2000)]
    for x in want:
        q.push(*x)
    assert [q.pop() for _ in want] == sorted(want) and not q.top and not q.buckets


def test_digest_rows(spark):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = byte_bpe.encode_digests(df, PATH, PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == 4 and out[0] == out[1] and out[0].decoded_sha256 == hashlib.sha256(b"Hello world").hexdigest()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out[2:]} == {(None, 0, empty, empty), (3, 0, empty, empty)}
    assert byte_bpe.encode_digests(df.limit(0), PATH, PATTERN).count() == 0
    back = byte_bpe.decode(byte_bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in back] == [r[1] or "" for r in rows] and back[0].n_tokens == "x"


def plain_count(piece: bytes, costs: dict) -> int:
    best = [(0, 0)]
    for d in range(1, len(piece) + 1):
        best.append(min((best[s][0] + costs[piece[s:d]], best[s][1] + 1) for s in range(d) if piece[s:d] in costs))
    return best[-1][1]


def test_trie_counts_equal_plain_programme(monkeypatch):
    costs = unigram_counts.zipf_costs(RANKS)
    trie = unigram_counts.UnigramTrie(costs, PATTERN)
    for n_nodes in (10**6, 40):
        monkeypatch.setattr(unigram_counts, "TRIE_NODES", n_nodes)
        for text in TEXTS[:5] + ["x" * 700, "y" * 255] + [noise(i) for i in range(60)]:
            pieces = trie.split(text)
            assert trie.count(text) == (len(pieces), sum(plain_count(p.encode(), costs) for p in pieces))


def test_prefixes_share_nodes():
    trie = unigram_counts.UnigramTrie(unigram_counts.zipf_costs(RANKS), PATTERN)
    trie.insert(b"reading")
    before = len(trie.cost)
    trie.insert(b"reads")
    assert len(trie.cost) == before + 1


def test_token_count_rows(spark):
    df = spark.createDataFrame([(1, "Hello"), (None, None), (2, "")], "doc_id long, text string")
    out = unigram_counts.token_counts(df, PATH, PATTERN).collect()
    assert [(r.doc_id, r.n_pieces) for r in out] == [(1, 1), (None, 0), (2, 0)] and out[1].n_tokens == 0 < out[0].n_tokens
    assert unigram_counts.token_counts(df.limit(0), PATH, PATTERN).count() == 0
