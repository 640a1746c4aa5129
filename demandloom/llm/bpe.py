"""Byte-level BPE as a tree reduction: halves are encoded on their own and joined at their border.

A join encodes a window around the border again. The window grows until the
tokens on its two edges form, with their neighbours outside, pairs that the
merges leave apart. A sequence whose neighbouring pairs all stay apart is the encoding of its
bytes, so nothing outside the window can change and the joined sequence is final.
Decoding concatenates up the tree: the bytes of runs of ids are the leaves, and neighbours are joined level by level.

The pieces that the split pattern cuts out never merge with each other; joining them is
concatenation. Only inside a piece do borders matter, so an endless run of letters
costs a logarithmic number of levels.

Defined results: null text is empty text, which has no tokens; rows that repeat
an id are encoded one by one; lone pieces of any length and any bytes are allowed.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.tables import pick

LEAF_BYTES = 8
# Entries of a worker's memory of pieces, leaves, windows and pairs before it starts afresh.
MEMORY = 200_000
# Longer pieces are encoded each time, so the memory is bounded in bytes too.
REMEMBERED = 64
# Ids of a leaf of the decoding tree.
LEAF_IDS = 1024
# Pieces of a longer text, in characters, are held this many at a time.
LONG, PIECES = 1 << 20, 1 << 16


class Codec:
    """Encoder and decoder for one table of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self._merged = _Memory(self._merge)
        self._apart = _Memory(self._pair_stays_apart)
        self._pieces = _Memory(self._piece)

    def _merge(self, data: bytes) -> tuple[int, ...]:
        """Plain merging, the lowest rank first and the leftmost of equals: a heap over a linked list of parts."""
        ranks, size = self.ranks, len(data)
        ends = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * size
        while heap:
            _, start, stop = heapq.heappop(heap)
            # an entry holds only while both of its parts are as they were
            if not alive[start] or ends[start] >= size or ends[ends[start]] != stop or not alive[ends[start]]:
                continue
            gone = ends[start]
            alive[gone] = False
            ends[start] = stop
            if stop < size:
                before[stop] = start
                if (r := ranks.get(data[start : ends[stop]])) is not None:
                    heapq.heappush(heap, (r, start, ends[stop]))
            if (left := before[start]) >= 0 and (r := ranks.get(data[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        return tuple(ranks[data[i : ends[i]]] for i in range(size) if alive[i])

    def _window(self, data: bytes) -> tuple[int, ...]:
        return self._merged[data] if len(data) <= 32 else self._merge(data)

    def _pair_stays_apart(self, pair: tuple[int, int]) -> bool:
        return self._window(self.token[pair[0]] + self.token[pair[1]]) == pair

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbours from their own encodings."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            inside = left[-i:] + right[:j]
            window = self._window(b"".join([self.token[t] for t in inside]))
            left_final = i == len(left) or self._apart[left[-i - 1], window[0]]
            right_final = j == len(right) or self._apart[window[-1], right[j]]
            if left_final and right_final:
                return left[:-i] + window + right[j:]
            i = i if left_final else min(2 * i, len(left))
            j = j if right_final else min(2 * j, len(right))

    def tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF_BYTES:
            return self._merged[data]
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = self.tree(data) if whole is None else (whole,)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if len(text) <= LONG:
            return b"".join(map(self._pieces.__getitem__, self.pattern.findall(text)))
        pieces = map(regex.Match.group, self.pattern.finditer(text))
        runs = [b"".join(map(self._pieces.__getitem__, run)) for run in batched(pieces, PIECES)]
        return b"".join(runs)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids: leaves of ``LEAF_IDS`` ids, joined two by two until one is left."""
        numbers, token = np.frombuffer(ids, "<u4"), self.token.__getitem__
        parts = [b"".join(map(token, numbers[low : low + LEAF_IDS].tolist())) for low in range(0, len(numbers), LEAF_IDS)]
        while len(parts) > 1:
            parts = [b"".join(parts[at : at + 2]) for at in range(0, len(parts), 2)]
        return parts[0] if parts else b""


class _Memory(dict):
    """Results of short arguments; emptied when full, so a worker's memory stays bounded."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) > REMEMBERED:
            return value
        if len(self) >= MEMORY:
            self.clear()
        self[key] = value
        return value


@lru_cache(maxsize=2)
def codec(rank_file: bytes, pattern: str) -> Codec:
    """The codec of a rank file's content: lines of base64 token and rank."""
    pairs = (line.split() for line in rank_file.splitlines() if line)
    return Codec({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded), one row per input row: little-endian 32-bit ids, and the bytes they decode to.

    The rank file is read once by the driver and sent to each executor; its size is that of the vocabulary.
    """
    with open(rank_path, "rb") as f:
        rank_file = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file.value, pattern)
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.slice(low, 500)
                ids = [own.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "ids": pa.array(ids, pa.binary()),
                        "decoded": pa.array([own.decode(x) for x in ids], pa.binary()),
                    }
                )

    source = pick(docs, doc_id=doc_id, text=text)
    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {id_type}, ids binary, decoded binary")


def bpe_digest(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_texts(docs, rank_path, pattern).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
