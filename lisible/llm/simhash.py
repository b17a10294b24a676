"""SimHash near-duplicate groups through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Fingerprints that differ in at most 3 bits differ in at most 3 bytes,
so they share at least 5 positional bytes: that is the guaranteed minimum of matches. A posting list for a single
positional byte would hold 1/256 of the corpus and pair it quadratically, so postings are kept for each choice of 5 of
the 8 positions (56 lists for each distinct fingerprint): a pair reaches the minimum exactly if it meets in one of
them. Within a list the shared positional bytes of the pairs are tallied, pairs under the minimum dropped and the
others verified bit by bit.

Equal fingerprints are one node from the start, so a group of copies, however large, is one posting. A list holds
distinct values of three free bytes, 2^24 at most. Small lists compare their pairs in vector operations; in large ones
every member looks up the 2,324 values within 3 bits of it, so the work is linear in the list. Either way only a
spanning forest of the links leaves a list, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import mix
from .common import connected_components, handing_back, materialise, slices, with_fields

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: Lists up to this size compare all pairs; larger ones look up neighbours.
PAIRWISE_UP_TO = 512
#: Shingles of a text that are hashed at a time.
PART = 1 << 16


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of UTF-8 text: bit set where over half the shingles' XXH64 have it; repeats count. No words: 0."""
    words = data.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return int.from_bytes(digest(joined, SEED), "big")
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, PART):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PART], ends[at : at + PART], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, fp long (the 64 bits, as a signed number) for every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x or b"", shingle) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            fps = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [batch.schema.names[0], "fp"])

    return df.select(id_col, text_col).mapInArrow(run, with_fields(df.select(id_col), ("fp", T.LongType())))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(max_bits: int) -> list[tuple[int, int]]:
    """(mask of the kept bytes, the list's number in a byte that it leaves free) for each choice of 8 - max_bits positions."""
    out = []
    for i, kept in enumerate(combinations(range(8), 8 - max_bits)):
        free = next(b for b in range(8) if b not in kept)
        out.append((_signed(sum(0xFF << 8 * b for b in kept)), _signed(i << 8 * free)))
    return out


def postings(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """key, fp: one row for each distinct fingerprint and list. Two lists can share a key; pairs are verified."""
    keys = [F.col("fp").bitwiseAND(F.lit(mask).cast("long")).bitwiseOR(F.lit(number).cast("long")) for mask, number in _masks(max_bits)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """For each of the distinct fingerprints of one list, the index of its group's first member."""
    n, least = len(fps), 8 - max_bits
    label = np.arange(n)
    if n <= PAIRWISE_UP_TO:
        x = fps[:, None] ^ fps[None, :]
        shared = (x.view(np.uint8).reshape(n, n, 8) == 0).sum(axis=2)
        near = (shared >= least) & (np.bitwise_count(x) <= max_bits)
        while True:
            new = np.where(near, label[None, :], n).min(axis=1)
            new = new[new]
            if (new == label).all():
                return label
            label = new
    order = np.argsort(fps)
    ranked = fps[order]
    free = np.flatnonzero(np.bitwise_or.reduce(ranked ^ ranked[0]) >> np.arange(64, dtype=np.uint64) & np.uint64(1))
    flips = [sum(1 << int(b) for b in bits) for k in range(1, max_bits + 1) for bits in combinations(free, k)]
    while True:
        new = label.copy()
        for flip in flips:
            near = ranked ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(ranked, near), n - 1)
            np.minimum(new, np.where(ranked[at] == near, label[at], n), out=new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    # labels are ranks within `ranked`; back to the caller's order
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def _links(max_bits: int):
    """Over rows sorted by key: (u, v) fingerprints, u linked to v, a forest for each list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
            """Whole lists only."""
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            sizes = np.diff(cut)
            first = cut[:-1][sizes == 2]
            a, b = fps[first], fps[first + 1]
            x = a ^ b
            near = ((x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)
            us, vs = [a[near]], [b[near]]
            for start, size in zip(cut[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                own = fps[start : start + size]
                root = forest(own, max_bits)
                child = np.flatnonzero(root != np.arange(size))
                us.append(own[child])
                vs.append(own[root[child]])
            u, v = np.concatenate(us), np.concatenate(vs)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"]) if len(u) else None

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last or held and held[-1][0][-1] != keys[-1]:  # all that came before `last` is whole
                out = links(np.concatenate([h[0] for h in held] + [keys[:last]]), np.concatenate([h[1] for h in held] + [fps[:last]]))
                held = []
                if out is not None:
                    yield out
            held.append((keys[last:], fps[last:]))
        if held:
            out = links(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            if out is not None:
                yield out

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id linked to it, directly or through others.

    Two texts link when their fingerprints differ in max_bits bits or fewer. Null, empty and wordless texts have
    fingerprint zero and link like any other. Rows with a null id take part; a group of such rows alone has a null
    component_id. Repeated rows stay repeated; an empty table gives an empty one; further columns are not read.
    """
    fps = materialise(fingerprints(df, id_col, text_col, shingle).withColumnRenamed(id_col, "id"), "simhash-fps")
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-nodes")
    lists = postings(nodes, max_bits).repartition("key").sortWithinPartitions("key")
    links = lists.mapInArrow(_links(max_bits), "u long, v long")
    groups = connected_components(links, "simhash")
    rooted = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = materialise(rooted.join(materialise(smallest, "simhash-roots"), "root").select("fp", "component_id"), "simhash-groups")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- similarity of 0.8 or more: wide fingerprints -------------------------------------------------------------------

#: Words of a shingle, 64-bit words of a wide fingerprint, tables of two byte positions each.
WIDE_SHINGLE, WIDE_WORDS, WIDE_TABLES = 5, 4, 64
#: Shingle sets of Jaccard similarity 0.8 stand at a cosine of 8/9, so 15.2 % of the bits (39 of 256) are expected to
#: differ, give or take 5.7, and 8.6 of 32 positional bytes to be shared; unrelated texts share one in eight times.
WIDE_BITS, WIDE_SHARED = 44, 4
#: Lists up to this size compare all pairs at once; in larger ones all meet so many members first.
SMALL_LIST, PIVOTS = 16, 8
#: Common shingles: one text in so many is looked at, so many of these hold the shingle, so many shingles at most.
COMMON_ONE_IN, COMMON_LEAST, COMMON_MOST = 16, 4, 100_000
_SALTS = np.array([0x0, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)


def _positions() -> list[tuple[int, int]]:
    """Pairs of byte positions by the circle method: every position is in as many tables."""
    n, out, ring = 8 * WIDE_WORDS, [], list(range(1, 8 * WIDE_WORDS))
    while len(out) < WIDE_TABLES:
        seats = [0, *ring]
        out += [tuple(sorted((seats[i], seats[n - 1 - i]))) for i in range(n // 2)]
        ring = ring[1:] + ring[:1]
    return out[:WIDE_TABLES]


def wide_fingerprint(data: bytes, shingle: int = WIDE_SHINGLE) -> bytes:
    """SimHash of 64 * WIDE_WORDS bits; each further word comes from the same hashes, salted and mixed."""
    words = data.lower().split()
    if not words:
        return bytes(8 * WIDE_WORDS)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    n = max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[min(len(words), shingle) - 1 :].tolist()
    counts = np.zeros(64 * WIDE_WORDS, np.int64)
    for at in range(0, n, PART):
        h = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PART], ends[at : at + PART], strict=True)]), "<u8")
        wide = mix(mix(h[:, None] + _SALTS[None, :]))
        counts += np.unpackbits(wide.view(np.uint8).reshape(len(h), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def shingle_set(data: bytes, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Distinct XXH64 of the text's shingles, sorted; a shorter text is one shingle, a wordless one the empty shingle."""
    words = data.lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        return np.frombuffer(digest(joined, SEED), ">u8").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[:n].tolist(), ends[shingle - 1 :].tolist()
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]), ">u8").astype(np.uint64))


def set_fingerprint(own: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed number: a bit is 1 if set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), PART):
        counts += np.unpackbits(own[at : at + PART].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own)).view(np.int64)[0])


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare before common, then by hash: sets of similarity 0.8 or more share one of them.

    Such sets share ceil(0.8 n) shingles of each, so not all of these lie behind the first n - ceil(0.8 n) + 1.
    """
    n = len(own)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
        own = np.concatenate([own[~late], own[late]])
    return own[: n - -(-4 * n // 5) + 1]


def parities(own: np.ndarray) -> bytes:
    """For 2^k buckets, two a shingle at least, whether a bucket holds an odd number of shingles."""
    size = max(8, 1 << (2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def short_parities(own: np.ndarray) -> tuple[int, int]:
    """The same over 128 buckets whatever the size of the set, as two longs, to sift pairs where they meet."""
    packed = np.packbits((np.bincount((own & np.uint64(127)).astype(np.int64), minlength=128) & 1).astype(np.uint8))
    return tuple(packed.view(np.int64).tolist())


def _plausible(n: np.ndarray, m: np.ndarray, *parities: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of pairs of sets with n and m shingles and these short parities, those that sizes and parities do not rule out."""
    # as unsigned words: of a negative number the bits of its absolute value would be counted
    apart = sum(np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64)).astype(np.int64) for a, b in parities)
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * apart <= n + m)


def may_be_similar(n: int, a: bytes, m: int, b: bytes) -> bool:
    """Never false for similar sets: they differ in (n + m) / 9 shingles at most, and each changes one parity."""
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) ^ int.from_bytes(a[half:])).to_bytes(half)
    return 9 * (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() <= n + m


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two shingle sets is 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _name(own: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "big", signed=True)


def _common_shingles(df: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles that many texts of a sample hold, COMMON_MOST at most. They only order the sets; no result depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for x in batch.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x or b"").view(np.int64))], ["h"])

    sample = df.where(F.pmod(F.xxhash64(id_col), F.lit(COMMON_ONE_IN)) == 0).select(text_col)
    top = sample.mapInArrow(handing_back(run), "h long").groupBy("h").count().where(F.col("count") >= COMMON_LEAST).orderBy(F.desc("count"), "h").limit(COMMON_MOST)
    return np.sort(np.array([r.h for r in top.select("h").collect()], np.int64).view(np.uint64))


def _described(df: DataFrame, id_col: str, text_col: str, common: np.ndarray) -> DataFrame:
    """id, node (a name of the shingle set), n, first (its prefix), odd (its parities), p and q (its short ones), fp (its SimHash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([prefix(s, common).view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.binary())]
            short = [short_parities(s) for s in sets]
            columns += [pa.array([x[i] for x in short], pa.int64()) for i in (0, 1)]
            columns.append(pa.array([set_fingerprint(s) for s in sets], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "node", "n", "first", "odd", "p", "q", "fp"])

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), text_col).mapInArrow(handing_back(run), "id long, node long, n long, first array<long>, odd binary, p long, q long, fp long")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Over rows sorted by their first column: (that column, the others), whole lists only."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        keys = columns[0]
        last = int(np.searchsorted(keys, keys[-1]))
        if last or held and held[-1][0][-1] != keys[-1]:
            keys, *rest = (np.concatenate(x) for x in zip(*held, [c[:last] for c in columns], strict=True))
            held = []
            yield keys, rest
        held.append([c[last:] for c in columns])
    if held:
        keys, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
        yield keys, rest


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, p, q) → (key, u, v, n, p, q, large): all plausible pairs of a small list; of a large one every
    member with the first, large then, and the plausible pairs of all with the next pivots."""
    for keys, (nodes, n, p, q) in _lists(batches):
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(cut)
        size, start = np.repeat(sizes, sizes), np.repeat(cut[:-1], sizes)
        out = []

        def pairs(a: np.ndarray, b: np.ndarray) -> None:
            ok = _plausible(n[a], n[b], (p[a], p[b]), (q[a], q[b]))  # noqa: B023
            a, b = a[ok], b[ok]
            out.append((keys[a], nodes[a], nodes[b], n[a], p[a], q[a], np.zeros(len(a), bool)))  # noqa: B023

        for k in range(1, SMALL_LIST):
            at = np.flatnonzero((keys[k:] == keys[:-k]) & (size[k:] <= SMALL_LIST))
            if not len(at):
                break
            pairs(at + k, at)
        at = np.flatnonzero(size > SMALL_LIST)
        out.append((keys[at], nodes[at], nodes[start[at]], n[at], p[at], q[at], np.ones(len(at), bool)))
        for k in range(1, PIVOTS):
            later = at[(at - start[at] > k) & (size[at] > k)]
            pairs(later, start[later] + k)
        columns = [np.concatenate(x) for x in zip(*out, strict=True)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "u", "v", "n", "p", "q", "large"])


def _other_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n, root, p, q) of large lists → (u, v): the plausible pairs whose groups differ."""
    for keys, (nodes, n, root, p, q) in _lists(batches):
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if (root[a:b] == root[a]).all():
                continue
            order = a + np.argsort(n[a:b], kind="stable")
            own, m, r, x, y = nodes[order], n[order], root[order], p[order], q[order]
            upto = np.searchsorted(4 * m, 5 * m, "right")
            for i in range(len(own)):
                rest = slice(i + 1, upto[i])
                v = own[rest][(r[rest] != r[i]) & _plausible(m[i], m[rest], (x[i], x[rest]), (y[i], y[rest]))]
                if len(v):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(v, own[i])), pa.array(np.minimum(v, own[i]))], ["u", "v"])


def _indexed_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): pairs of nodes that the byte-position index links, by fingerprints that differ in MAX_BITS bits at most.

    A spanning forest of these links, as postings() and _links() leave it; of equal fingerprints each node with the first.
    """
    firsts = materialise(nodes.groupBy("fp").agg(F.min("node").alias("leader")), "similar-fps")
    met = postings(firsts, MAX_BITS).repartition("key").sortWithinPartitions("key").mapInArrow(_links(MAX_BITS), "u long, v long").distinct()
    side = lambda at, name: firsts.select(F.col("fp").alias(at), F.col("leader").alias(name))
    across = met.join(side("u", "a"), "u").join(side("v", "b"), "v").select("a", "b")
    equal = nodes.join(firsts, "fp").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    return across.union(equal).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _verified(pairs: DataFrame, nodes: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (u, v) of nodes whose shingle sets have a similarity of 0.8 or more, computed from the texts.

    Pairs of nodes of one root are linked already and are not compared again.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, _, n, a, m, b = (c.to_pylist() for c in batch.columns)
            yield batch.select([0, 1]).filter(pa.array(list(map(may_be_similar, n, a, m, b)), pa.bool_()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_set(x or b"") for x in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(list(map(similar, a, b)), pa.bool_()))

    side = lambda t, name, *columns: t.select(F.col("node").alias(name), *(F.col(c).alias(c + name) for c in columns))
    joined = pairs.where("u <> v").distinct().join(side(nodes, "u", "n", "odd", "root"), "u").join(side(nodes, "v", "n", "odd", "root"), "v").where("rootu <> rootv").select("u", "v", "nu", "oddu", "nv", "oddv")
    left = materialise(joined.mapInArrow(handing_back(possible), "u long, v long"), "similar-possible")
    asked = left.select(F.col("u").alias("node")).union(left.select("v")).distinct()
    ids = nodes.join(asked, "node", "left_semi").select(F.col("low").alias("asked_id")).distinct()
    rows = df.select(F.col(id_col).cast("long").alias("asked_id"), F.col(text_col).alias("asked_text")).join(ids, "asked_id", "left_semi")
    texts = materialise(rows.select("asked_text").mapInArrow(handing_back(sets), "node long, shingles binary").join(asked, "node", "left_semi").dropDuplicates(["node"]), "similar-sets")
    both = left.join(side(texts, "u", "shingles"), "u").join(side(texts, "v", "shingles"), "v").select("u", "v", "shinglesu", "shinglesv")
    return materialise(both.mapInArrow(handing_back(compared), "u long, v long"), "similar-links")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, root for texts that have a near copy: sets of five-word shingles with a similarity of 0.8 or more.

    SimHash fingerprints of the sets meet in the byte-position index, which guarantees every pair within MAX_BITS bits five
    shared positional bytes; its links are compared shingle by shingle. Many pairs at 0.8 differ in more bits than any
    number of shared bytes covers, so an exact search follows for those that the index has not joined:
    every pair at 0.8 or more is in the list of a shingle that both sets' prefixes hold. Pairs of a list are dropped by
    size and parities where these rule 0.8 out, and otherwise compared shingle by shingle; no other link counts. In a list of over SMALL_LIST
    members all meet PIVOTS of them, and then the plausible pairs that no link joins yet. Equal sets are one node. root is the
    smallest id.
    """
    common = _common_shingles(df, id_col, text_col)
    told = materialise(_described(df, id_col, text_col, common), "similar-told")
    told_once = told.groupBy("node", "n").agg(F.min("id").alias("low"), F.first("first").alias("first"), F.first("odd").alias("odd"), F.first("p").alias("p"), F.first("q").alias("q"), F.first("fp").alias("fp"))
    nodes = materialise(told_once, "similar-nodes").withColumn("root", F.col("node"))
    indexed = _verified(_indexed_pairs(nodes), nodes, df, id_col, text_col)
    found = connected_components(indexed, "similar-indexed")
    nodes = materialise(nodes.drop("root").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "similar-rooted")
    lists = nodes.select(F.explode("first").alias("key"), "node", "n", "p", "q").repartition("key").sortWithinPartitions("key", "node")
    met = materialise(lists.mapInArrow(handing_back(_first_pairs), "key long, u long, v long, n long, p long, q long, large boolean"), "similar-met")
    links = indexed.union(_verified(met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), nodes, df, id_col, text_col))
    large = met.where("large").select("key", F.col("u").alias("node"), "n", "p", "q")
    if not large.isEmpty():
        roots = connected_components(links, "similar-first")
        rest = large.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"), "p", "q").repartition("key").sortWithinPartitions("key", "node")
        links = links.union(_verified(rest.mapInArrow(handing_back(_other_pairs), "u long, v long"), nodes, df, id_col, text_col))
    roots = connected_components(links, "similar-nodes")
    rooted = nodes.select("node", "low").join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    smallest = materialise(rooted.groupBy("root").agg(F.min("low").alias("v")), "similar-smallest")
    named = materialise(rooted.join(smallest, "root").select("node", "v"), "similar-named")
    edges = told.select("id", "node").join(named, "node").select(F.col("id").alias("u"), "v")
    return connected_components(edges, "similar")


def keep_one_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df but those whose group (see similar_groups) has a smaller id, all columns.

    Rows with a null id have nothing to be found by and stay; so do repeated rows of an id that stays.
    """
    groups = similar_groups(df, id_col, text_col)
    gone = materialise(groups.where("node <> root").select(F.col("node").alias("gone_id")).distinct(), "simhash-gone")
    names = [f"c{i}" for i in range(len(df.columns))]  # whatever df calls its columns
    rows = df.toDF(*names)
    return rows.join(gone, F.col(names[df.columns.index(id_col)]) == F.col("gone_id"), "left_anti").toDF(*df.columns)
