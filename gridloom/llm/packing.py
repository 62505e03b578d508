"""Cost-balanced packing of documents into fixed-length training sequences.

Each task packs the rows that it reads, a bounded block at a time, so that nothing is shuffled: a block is some
thousand sequences, and all of them are full. In a block, the cost of a piece of n tokens is estimated as
`linear * n + quadratic * n * n` (attention is quadratic within a document). Documents longer than a sequence give
full sequences of their own first. What is left goes, longest first, to the open sequence of the least cost that has
room for all of it; where none has, it is cut and fills the cheapest one. The tokens beyond the
last full sequence form sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from gridloom.llm import bytebpe
from gridloom.llm.arrowtext import raw, slices, tidy
from gridloom.llm.session import id_and_text, ship

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Open:
    """Open sequences: the one of the least cost among those with some room, by a tree over room of the least costs."""

    def __init__(self, rooms: list[int]):
        self.size = 1 << max(rooms, default=0).bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.best = [(float("inf"), -1)] * (2 * self.size)
        for s, room in enumerate(rooms):
            self.put(room, 0.0, s)

    def _changed(self, room: int) -> None:
        heap, i = self.heaps[room], room + self.size
        self.best[i] = heap[0] if heap else (float("inf"), -1)
        while i > 1:
            i >>= 1
            self.best[i] = min(self.best[2 * i], self.best[2 * i + 1])

    def put(self, room: int, cost: float, s: int) -> None:
        heapq.heappush(self.heaps[room], (cost, s))
        if self.heaps[room][0] == (cost, s):
            self._changed(room)

    def least(self, room: int) -> tuple[float, int]:
        """(cost, sequence) of the cheapest with that much room, or sequence -1."""
        found, i = (float("inf"), -1), room + self.size
        if room >= self.size:
            return found
        found = min(found, self.best[i])
        while i > 1:
            if not i & 1:
                found = min(found, self.best[i + 1])
            i >>= 1
        return found

    def take(self, room: int) -> None:
        """Remove the cheapest sequence with exactly that room."""
        heapq.heappop(self.heaps[room])
        self._changed(room)


def pack(sizes: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of the given sizes; returns (document, start, length, sequence, offset) rows.

    Every token of every document lies in exactly one piece, offsets of a sequence have no gap, and each sequence is
    full or has a power of two of tokens. Ties go to the earlier document and the lower sequence. No sizes, no rows.
    """
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rest: list[tuple[int, int, int]] = []  # (-size, document, start)
    for d, n in enumerate(sizes.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            out.append((d, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((-(n % capacity), d, n - n % capacity))
    total = -sum(x[0] for x in rest)
    full, tail = divmod(total, capacity)
    rooms = [capacity] * full
    while tail:
        rooms.append(1 << (tail.bit_length() - 1))
        tail -= rooms[-1]
    used = [0] * len(rooms)
    cost = [0.0] * len(rooms)
    open_ = Open(rooms)
    rest.sort()
    for size, d, start in rest:
        left = -size
        while left:
            s = open_.least(left)[1]
            if s < 0:
                s = open_.least(1)[1]
            room = rooms[s] - used[s]
            open_.take(room)
            n = min(left, room)
            out.append((d, start, n, sequence + s, used[s]))
            used[s] += n
            cost[s] += linear * n + quadratic * n * n
            start, left = start + n, left - n
            if n < room:
                open_.put(room - n, cost[s], s)
    return out


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 0, block_bytes: int = 5 << 20) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer file, then `end_id`; a null or empty text has that id alone. Repeated
    rows and null doc_ids are packed like any row. An empty table gives no rows. `sequence_id` is unique over the
    result: the task's number and a count within it. Other columns are ignored, whatever their names; a very long text is
    a block of its own. Costs are balanced within a block.
    """
    ship(docs.sparkSession)
    path = tokenizer or bytebpe.default_path()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bytebpe.load(path)
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, limit=block_bytes):
                ids, bound = bytebpe.token_ids(*raw(part.column("text")), bpe)
                sizes = np.diff(bound) + 1
                ends = bound + np.arange(len(bound))
                whole = np.full(len(ids) + len(sizes), end_id, "<u4")
                whole[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = ids
                rows = np.array(pack(sizes, capacity), np.int64).reshape(-1, 5)
                d = rows[:, 0]
                at = ends[d] + rows[:, 1]
                crc = [zlib.crc32(whole[a:b]) for a, b in zip(at.tolist(), (at + rows[:, 2]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(d)), pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(crc, pa.int64()), pa.array(sizes[d]), pa.array(rows[:, 3] + sequence), pa.array(rows[:, 4])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
                sequence += int(rows[:, 3].max()) + 1

    return id_and_text(docs).mapInArrow(tidy(blocks), SCHEMA)
