"""Byte-level BPE with a hierarchical-bitmap rank queue.

Every merge rank has a bucket with the linked-list positions whose pair has that rank. A three-level bitmap marks
the buckets that hold something, and find-first-set on it gives the next rank; entries that a merge has made stale
are skipped when they come up. A pre-token of n bytes takes O(n log n), so very long ones are no trouble.

Short pre-tokens stand in one linked list, with a separator that pairs with nothing between them, and share one queue:
each sees its own pairs come up by rank and then position, as alone, and a rank is looked for once for all of them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import KEPT, handing_back, slices, with_fields


#: Distinct pre-tokens, and distinct chunks, after which a worker's memory of them grows old; what does not come up again until as
#: many others have is forgotten. Results are the same.
MEMO_ENTRIES = 250_000
#: Bytes up to which a pre-token shares a queue, and bytes of those that share one; characters of texts cut up at a time.
SHORT_PIECE, SHARED, GROUP = 256, 1 << 18, 1 << 21
#: Longer pre-tokens and chunks (characters) are not remembered.
REMEMBERED = 256
#: A text over so many characters is cut into pre-tokens lazily, a part at a time.
LONG_TEXT, PART = 1 << 20, 1 << 16


#: The pattern whose matches cut() keeps whole; with another one, texts are not cut into chunks.
CHUNKED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern's \s has it, which is not str.isspace().
SPACES = "".join(map(re.escape, regex.findall(r"\s", "".join(map(chr, range(0x3100))))))
#: A space before no other or before white space, and one before something else.
IRREGULAR, REGULAR = re.compile(f" (?:[{SPACES}]|\\Z)"), re.compile(f" (?=[^{SPACES}])")

#: A chunk of letters that no version of Unicode has otherwise: with its space it is one match.
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+").fullmatch


class RankQueue:
    """Priority queue of (rank, position) over a fixed range of ranks."""

    def __init__(self, n_ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * (n_ranks // 64 + 1)
        self.mid = [0] * (n_ranks // 4096 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The lowest rank's leftmost position."""
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = (b << 6) + (m & -m).bit_length() - 1
        w = self.low[a]
        rank = (a << 6) + (w & -w).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[a] = w = w & (w - 1)
            if not w:
                self.mid[b] = m = m & (m - 1)
                if not m:
                    self.top &= self.top - 1
        return rank, position


class Memory(dict):
    """The entries of late, and in old those before them that have not come up since."""

    def __init__(self):
        self.old: dict = {}

    def unknown(self, keys: set[str]) -> list[str]:
        """The keys that are in neither; old ones come up."""
        missing, old = keys.difference(self), self.old
        known = list(filter(old.__contains__, missing))
        self.update(zip(known, map(old.__getitem__, known)))
        return list(missing.difference(known))

    def settle(self, new: list[str]) -> None:
        """After a group: long entries go, and too many grow old."""
        for key in new:
            if len(key) > REMEMBERED:
                del self[key]
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()


class ByteBPE:
    """Encoder and decoder for one rank table and split pattern; special tokens do not exist here."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank table lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.split_lazily = regex.compile(pattern).finditer
        self.queue = RankQueue(max(ranks.values()))
        self.vocab = {rank: token for token, rank in ranks.items()}
        self.names = {rank: f",{rank}" for rank in self.vocab}
        self.memo = Memory()  # ids by pre-token
        self.chunks = Memory()  # names of ids and decoded bytes by chunk
        self.chunked = pattern == CHUNKED
        # the ranks of a token's pairs, by the other token; the separator's id is no token's
        self.separator = max(ranks.values()) + 1
        self.rights: dict[int, dict[int, int]] = {rank: {} for rank in self.vocab}
        self.lefts: dict[int, dict[int, int]] = {rank: {} for rank in self.vocab}
        of_bytes = np.full((257, 257), -1, np.int32)
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                x, y = ranks.get(token[:at]), ranks.get(token[at:])
                if x is not None and y is not None:
                    self.rights[x][y] = self.lefts[y][x] = rank
            if len(token) == 2:
                of_bytes[token[0], token[1]] = rank
        self.of_bytes = of_bytes.ravel()
        self.buckets: list[list[int]] = [[] for _ in range(self.separator)]  # the shared queue's, by rank
        self.singles = np.array([*(ranks[bytes([b])] for b in range(256)), self.separator])

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        # the queue's push and pop are written out here: most pre-tokens are short, and calls would cost more than the work
        n, get = len(piece), ranks.get
        buckets, low, mid, top = self.queue.buckets, self.queue.low, self.queue.mid, 0
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        pair = [-1] * n  # the rank of the pair that starts at a position now; entries with another rank are stale
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = [i]
                    a = r >> 6
                    low[a] |= 1 << (r & 63)
                    mid[a >> 6] |= 1 << (a & 63)
                    top |= 1 << (a >> 6)
                else:
                    bucket.append(i)  # positions rise, so the list stays a heap
        while top:
            m = (top & -top).bit_length() - 1
            w = mid[m]
            a = (m << 6) + (w & -w).bit_length() - 1
            bits = low[a]
            r = (a << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[r]
                low[a] = bits = bits & (bits - 1)
                if not bits:
                    mid[m] = w = w & (w - 1)
                    if not w:
                        top &= top - 1
            if pair[i] != r:
                continue
            j = after[i]
            k = after[j]
            after[i], end[i], pair[j], pair[i] = k, end[j], -1, -1
            h = before[i]
            changed = []
            if k < n:
                before[k] = i
                r = get(piece[i : end[k]])
                if r is not None:
                    pair[i] = r
                    changed.append((r, i))
            if h >= 0:
                r = get(piece[h : end[i]])
                pair[h] = -1 if r is None else r
                if r is not None:
                    changed.append((r, h))
            for r, i in changed:
                bucket = buckets.get(r)
                if bucket is None:
                    buckets[r] = [i]
                    a = r >> 6
                    low[a] |= 1 << (r & 63)
                    mid[a >> 6] |= 1 << (a & 63)
                    top |= 1 << (a >> 6)
                else:
                    heappush(bucket, i)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def encode_short(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of pieces that are no tokens themselves, by one queue."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        kinds = np.full(int(lengths.sum()) + 1, 256)
        within = np.ones(len(kinds), bool)
        within[0] = False
        within[np.cumsum(lengths)] = False
        kinds[within] = np.frombuffer(b"".join(pieces), np.uint8)
        first = self.of_bytes[kinds[:-1] * 257 + kinds[1:]]
        n, separator = len(kinds), self.separator
        token, pair = self.singles[kinds].tolist(), [*first.tolist(), -1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets, low, mid, top = self.buckets, self.queue.low, self.queue.mid, 0
        order = np.argsort(first, kind="stable")[::-1]  # positions fall in each bucket: the last is the leftmost
        order = order[: np.count_nonzero(first >= 0)]
        places, ranked = order.tolist(), first[order]
        starts = [0, *(np.flatnonzero(ranked[1:] != ranked[:-1]) + 1).tolist(), len(places)]
        for x, y in zip(starts, starts[1:]):
            if x < y:
                r = int(ranked[x])
                buckets[r] = places[x:y]
                a = r >> 6
                low[a] |= 1 << (r & 63)
                mid[a >> 6] |= 1 << (a & 63)
                top |= 1 << (a >> 6)
        while top:
            m = (top & -top).bit_length() - 1
            w = mid[m]
            a = (m << 6) + (w & -w).bit_length() - 1
            bits = low[a]
            r = (a << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                bucket.sort(reverse=True)
            right, left, later = self.rights[r].get, self.lefts[r].get, []
            while bucket:
                i = bucket.pop()
                if pair[i] != r:
                    continue
                j = after[i]
                k = after[j]
                h = before[i]
                after[i], before[k], token[i], token[j], pair[j] = k, i, r, -1, -1
                pair[i] = s = right(token[k], -1)
                pair[h] = t = left(token[h], -1)
                if s >= 0:
                    to = buckets[s]
                    if not to:
                        a = s >> 6
                        low[a] |= 1 << (s & 63)
                        mid[a >> 6] |= 1 << (a & 63)
                        top |= 1 << (a >> 6)
                    to.append(i)
                if t >= 0:
                    to = buckets[t]
                    if not to:
                        a = t >> 6
                        low[a] |= 1 << (t & 63)
                        mid[a >> 6] |= 1 << (a & 63)
                        top |= 1 << (a >> 6)
                    to.append(h)
                if 0 <= s < r or 0 <= t < r:  # a lower rank has come up: the rest of this piece waits for it
                    while token[k] != separator:
                        k = after[k]
                    while bucket and bucket[-1] < k:
                        later.append(bucket.pop())
            if later:
                buckets[r] = later
                continue
            a = r >> 6
            low[a] = bits = low[a] & ~(1 << (r & 63))
            if not bits:
                mid[a >> 6] = w = mid[a >> 6] & ~(1 << (a & 63))
                if not w:
                    top &= ~(1 << (a >> 6))
        ids = np.array(token)
        ids = ids[ids >= 0]
        ends, ids = np.flatnonzero(ids == separator).tolist(), ids.tolist()
        return [tuple(ids[x + 1 : y]) for x, y in zip(ends, ends[1:])]

    def encode_new(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The ids of distinct pieces."""
        found, short, waiting, size = {}, [], [], 0
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                found[piece] = (whole,)
            elif len(raw) > SHORT_PIECE:
                found[piece] = self.encode_piece(raw)
            else:
                short.append(piece)
                waiting.append(raw)
                size += len(raw)
                if size >= SHARED:
                    found.update(zip(short, self.encode_short(waiting)))
                    short, waiting, size = [], [], 0
        if short:
            found.update(zip(short, self.encode_short(waiting)))
        return found

    def look_up(self, lists: list[list[str]]) -> list[list[int]]:
        """The ids of each list's pieces, one after the other."""
        memo = self.memo
        new = memo.unknown(set().union(*lists))
        memo.update(self.encode_new(new))
        out = [list(chain.from_iterable(map(memo.__getitem__, pieces))) for pieces in lists]
        memo.settle(new)
        return out

    def parts(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, a bounded part at a time."""
        if len(text) <= LONG_TEXT:
            yield from self.look_up([self.split(text)])
            return
        found = (m[0] for m in self.split_lazily(text))
        while pieces := list(islice(found, PART)):
            yield from self.look_up([pieces])

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Count, SHA-256 of the comma-joined decimal ids, SHA-256 of the decoded bytes."""
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.parts(text):
            if ids:
                of_ids.update("".join(map(self.names.__getitem__, ids))[not n :].encode())
                of_bytes.update(self.decode(ids))
                n += len(ids)
        return n, of_ids.hexdigest(), of_bytes.hexdigest()

    def cut(self, text: str) -> list[str]:
        """Chunks of a text, each without the space that it begins with; the first, which need not have one, is marked by one.

        A match never goes on over a space that stands before a character that is no white space, whatever precedes it, and
        only white space looks ahead. So chunks that begin there have the matches of the whole text.
        """
        chunks = IRREGULAR.search(text) and REGULAR.split(text) or text.split(" ")
        chunks[0] = " " + chunks[0]
        return chunks

    def digest_group(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """digest() of each text: a chunk's ids are found and decoded when it is new, a text's are its chunks' joined."""
        lists, memo, split = [self.cut(t) for t in texts], self.chunks, self.split
        new = memo.unknown(set().union(*lists))
        pieces = [[" " + c] if WORD(c) else split(c[1:] if c[0] == " " else " " + c) for c in new]
        for chunk, ids in zip(new, self.look_up(pieces)):
            memo[chunk] = "".join(map(self.names.__getitem__, ids)), self.decode(ids)
        out = []
        for chunks in lists:
            of_ids, of_bytes = zip(*map(memo.__getitem__, chunks))
            joined = "".join(of_ids)
            out.append((joined.count(","), hashlib.sha256(joined[1:].encode()).hexdigest(), hashlib.sha256(b"".join(of_bytes)).hexdigest()))
        memo.settle(new)
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """digest() of each text; chunks that come again are looked up once for all texts of a group."""
        if not self.chunked:
            return [self.digest(t) for t in texts]
        out, group, size, collects = [], [], 0, gc.isenabled()
        gc.disable()  # nothing here refers to itself, and many lists live for a moment
        try:
            for text in texts:
                if len(text) > LONG_TEXT or size + len(text) > GROUP:
                    out += self.digest_group(group)
                    group, size = [], 0
                if len(text) > LONG_TEXT:
                    out.append(self.digest(text))
                else:
                    group.append(text)
                    size += len(text)
            return out + self.digest_group(group)
        finally:
            if collects:
                gc.enable()


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines of a rank file: base64 token, space, rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@lru_cache(maxsize=2)
def _codec(data: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(data), pattern)


def _forget() -> None:
    _codec.cache_clear()


KEPT["byte_bpe"] = _forget


def _strings(column: pa.Array) -> list[str]:
    """Null becomes empty; bytes that are no UTF-8 become U+FFFD."""
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _shared(df: DataFrame, ranks_path: str):
    """The rank file as a broadcast: a vocabulary of fixed size, so executors need no file of their own."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of df and ids_col array<int>, the ids of the whole text.

    Null and empty texts give an empty array; rows, repeated ones too, stay one to one; an ids_col that df already
    has is replaced. No shuffle: one Arrow batch at a time is encoded where it is.
    """
    shared = _shared(df, ranks_path)
    df = df.drop(ids_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            ids = pa.array([codec.encode(t) for t in _strings(batch.column(at))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, ids_col])

    return df.mapInArrow(run, with_fields(df, (ids_col, T.ArrayType(T.IntegerType()))))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns of df and bytes_col binary, the joined bytes of the ids; null ids give null."""
    shared = _shared(df, ranks_path)
    df = df.drop(bytes_col)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            out = [None if ids is None else codec.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, bytes_col])

    return df.mapInArrow(run, with_fields(df, (bytes_col, T.BinaryType())))


def encode_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes each whole text, keeping only digests.

    Null text counts as empty (no ids, digests of the empty string); a null id stays null; repeated rows give
    repeated rows; an empty table gives an empty one; further columns of df are not read.
    """
    shared = _shared(df, ranks_path)
    schema = with_fields(df.select(id_col), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in slices(batches):
            rows = codec.digests(_strings(batch.column(1)))
            n, a, b = ([r[i] for r in rows] for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(id_col, text_col).mapInArrow(handing_back(run, "byte_bpe"), schema)


__all__ = ["ByteBPE", "RankQueue", "decode", "encode", "encode_digests", "read_ranks"]
