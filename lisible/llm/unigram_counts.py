"""Token counts under a unigram model, with a trie that shares the dynamic programme between pre-tokens.

Distinct pre-tokens go into a trie, byte by byte. A node's forward score is the cheapest segmentation of the bytes
from the root to it; it depends on nothing else, so it is computed once however many pre-tokens share the prefix.
The node where a pre-token ends holds its token count.

The model is a unigram language model over the tokens of a public rank file with Zipf's prior, p(rank) proportional
to 1 / (rank + 2). Costs are -log p in whole millionths, so sums are exact and do not depend on order; among equally
cheap segmentations the one with fewest tokens counts. Nothing is trained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .byte_bpe import LONG_TEXT, PART, _shared, _strings, read_ranks
from .common import with_fields

#: Nodes of a worker's trie, and pre-tokens it looks up directly; beyond either both are emptied, results are the same.
TRIE_NODES, TERMINALS = 600_000, 400_000
#: Pre-tokens over so many bytes are counted apart from the trie, so that one of them cannot fill it.
LONG_PIECE = 256


def zipf_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    norm = math.log(sum(1 / (r + 2) for r in ranks.values()))
    return {token: round(1e6 * (math.log(rank + 2) + norm)) for token, rank in ranks.items()}


class UnigramTrie:
    def __init__(self, costs: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in costs for b in range(256)):
            raise ValueError("every single byte needs a cost, else some texts have no segmentation")
        self.costs, self.longest = costs, max(map(len, costs))
        self.split, self.split_lazily = regex.compile(pattern).findall, regex.compile(pattern).finditer
        outer = self

        class Terminals(dict):
            def __missing__(self, piece: str) -> int:
                data = piece.encode("utf-8", "surrogatepass")
                if len(data) > LONG_PIECE:
                    return outer.count_apart(data)
                if len(self) >= TERMINALS or len(outer.cost) >= TRIE_NODES:
                    outer.clear()
                found = self[piece] = outer.insert(data)
                return found

        self.terminals = Terminals()
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.cost, self.tokens = [0], [0]
        self.terminals.clear()

    def insert(self, piece: bytes) -> int:
        """Walks or grows the path of piece; returns the token count at its end."""
        edges, cost, tokens, price, longest = self.edges, self.cost, self.tokens, self.costs, self.longest
        path, node = [0], 0
        for depth, byte in enumerate(piece, 1):
            child = edges.get(node << 8 | byte)
            if child is None:
                best, count = None, 0
                for start in range(max(0, depth - longest), depth):
                    p = price.get(piece[start:depth])
                    if p is not None:
                        via = path[start]
                        total, n = cost[via] + p, tokens[via] + 1
                        if best is None or total < best or total == best and n < count:
                            best, count = total, n
                child = edges[node << 8 | byte] = len(cost)
                cost.append(best)
                tokens.append(count)
            path.append(child)
            node = child
        return tokens[node]

    def count_apart(self, piece: bytes) -> int:
        """The same recurrence along one long pre-token, with only a window of scores kept."""
        price, longest = self.costs, self.longest
        cost, tokens = [0], [0]  # of the last `longest` depths
        for depth in range(1, len(piece) + 1):
            best, count, first = None, 0, depth - len(cost)
            for start in range(first, depth):
                p = price.get(piece[start:depth])
                if p is not None:
                    total, n = cost[start - first] + p, tokens[start - first] + 1
                    if best is None or total < best or total == best and n < count:
                        best, count = total, n
            cost.append(best)
            tokens.append(count)
            if len(cost) > longest:
                del cost[0], tokens[0]
        return tokens[-1]

    def count(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        get = self.terminals.__getitem__
        if len(text) <= LONG_TEXT:
            pieces = self.split(text)
            return len(pieces), sum(map(get, pieces))
        n = total = 0
        found = (m[0] for m in self.split_lazily(text))
        while pieces := list(islice(found, PART)):
            n += len(pieces)
            total += sum(map(get, pieces))
        return n, total


@lru_cache(maxsize=2)
def _trie(data: bytes, pattern: str) -> UnigramTrie:
    return UnigramTrie(zipf_costs(read_ranks(data)), pattern)


def token_counts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_pieces, n_tokens for every row; no shuffle.

    Null and empty texts count 0 and 0; a null id stays null; repeated rows give repeated rows; an empty table gives
    an empty one; further columns of df are not read. Whole texts count, however long.
    """
    shared = _shared(df, ranks_path)
    schema = with_fields(df.select(id_col), ("n_pieces", T.LongType()), ("n_tokens", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(shared.value, pattern)
        for batch in batches:
            rows = [trie.count(t) for t in _strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], [batch.schema.names[0], "n_pieces", "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
