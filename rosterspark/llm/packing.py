"""Packing token ids into windows of equal capacity by multiway number differencing (Karmarkar and Karp)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.tokens import file_encoder, slices

CAPACITY = 2048
#: Pieces that are differenced together. A merge costs as much as there are windows, so larger blocks cost more and waste less.
BLOCK = 256
#: What a document leaves beyond full windows is cut into pieces of this many tokens at most: windows of several
#: pieces can be levelled, windows of one or two can't.
PIECE = 512
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differenced(sizes: list[int], ways: int) -> list[list[int]]:
    """Split the items into ``ways`` groups of near-equal sums; returns the items' indices by group.

    Every item starts as a partition with one filled group. The two partitions whose groups differ most are merged,
    the fullest group of one with the emptiest of the other, until one is left. Ties go to the older partition.
    """
    import heapq

    import numpy as np

    groups: list[list[int]] = [[] for _ in range(ways)]
    if not sizes:
        return groups
    heap: list = []
    for i, size in enumerate(sizes):
        sums = np.zeros(ways, np.int64)
        sums[0] = size
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    merged: list[tuple] = []  # (first, second, order of the merged groups); numbered on from the items
    while len(heap) > 1:
        _, first, a = heapq.heappop(heap)
        _, second, b = heapq.heappop(heap)
        sums = a + b[::-1]  # both stand in falling order
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        merged.append((first, second, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), len(sizes) + len(merged) - 1, sums))
    # From the last merge back to the items: which group each group of a part ended in.
    ended = {heap[0][1]: np.arange(ways)}
    for number in range(len(merged) - 1, -1, -1):
        first, second, order = merged[number]
        label = ended.pop(len(sizes) + number)
        ended[first], ended[second] = (np.empty_like(label), np.empty_like(label))
        ended[first][order] = label
        ended[second][ways - 1 - order] = label
    for i in range(len(sizes)):
        groups[ended[i][0]].append(i)
    return groups


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups whose sums stay within ``capacity``: as few as the total allows, one more each time one is too full.

    No size may exceed the capacity. Ends at the latest when every item has a group of its own.
    """
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = differenced(sizes, ways)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        ways += 1


def cut(length: int, capacity: int, piece: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of the full windows of a document, and of the near-equal pieces of the rest."""
    full = [(s, capacity) for s in range(0, length - capacity + 1, capacity)]
    start = capacity * len(full)
    rest = length - start
    parts = -(-rest // piece)
    ends = [start + rest * i // parts for i in range(parts + 1)] if parts else []
    return full, [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def pack(docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", end_id: int = 1, capacity: int = CAPACITY, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """Encode the texts and pack their ids into windows of ``capacity`` tokens.

    One row per piece: doc_id, start (ids of the document before it), length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit), doc_tokens (with the end id), sequence_id, offset (in the window, without gaps from 0).

    A document is its ids and then ``end_id``. Full windows of a long document stand alone; the rests are packed block
    by block inside the task that read them, so nothing is shuffled, no group of documents is gathered, and a task
    that is run again numbers its windows alike: the task's number, then a count. Memory holds one block of pieces.
    Null or empty text: the end id alone. Rows with a null or repeated id are packed like others. Empty table: no rows.
    """
    if not 0 < piece <= capacity:
        raise ValueError("piece must be between 1 and capacity")

    def run(batches: Iterator) -> Iterator:
        import struct
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        encoder = file_encoder(tokenizer_path)
        end = struct.pack("<I", end_id)
        base = TaskContext.get().partitionId() << 40
        count = 0
        waiting: list[tuple] = []
        ready: list[tuple] = []

        def out():
            columns = list(zip(*ready, strict=True))
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        def level():
            nonlocal count
            for group in windows([p[2] for p in waiting], capacity):
                at = 0
                for i in group:
                    ready.append((*waiting[i], base + count, at))
                    at += waiting[i][2]
                count += 1
            waiting.clear()

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                for doc, coded in zip(ids[a:b], encoder.ids(texts[a:b]), strict=True):
                    data = memoryview(coded + end)
                    length = len(data) // 4
                    full, rest = cut(length, capacity, piece)
                    for start, n in full:
                        ready.append((doc, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), length, base + count, 0))
                        count += 1
                    waiting += [(doc, start, n, zlib.crc32(data[4 * start : 4 * (start + n)]), length) for start, n in rest]
                    while len(waiting) >= block:
                        later = waiting[block:]
                        del waiting[block:]
                        level()
                        waiting += later
                if len(ready) > 20_000:
                    yield out()
        level()
        if ready:
            yield out()

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, SCHEMA)
