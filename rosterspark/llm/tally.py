"""How often codes occur over the whole input, told to the chunk that asked, without a row for each code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import Scratch

#: Codes are sorted integers below 2 to the power of this.
CODE_BITS = 40
#: Codes that one task adds up at once, about.
RANGE = 1_000_000
#: Answers stop here: that often, or more.
MOST = 255


def ranges(rows: DataFrame, text_column: str = "text", bytes_each: int = 4) -> int:
    """Ranges of codes, from the size of the texts: about RANGE codes in each, if there is a code every ``bytes_each`` bytes."""
    total = rows.agg(F.sum(F.octet_length(text_column).cast("long"))).first()[0] or 0
    return max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // (bytes_each * RANGE)))


def packed(values: np.ndarray) -> bytes:
    """Sorted integers as differences, byte by byte: 2 to 3 bytes each."""
    import pyarrow as pa

    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, count: int) -> np.ndarray:
    import pyarrow as pa

    planes = np.frombuffer(pa.decompress(data, 8 * count, codec="zstd", asbytes=True), np.uint8).reshape(8, count)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    import pyarrow as pa

    return pa.compress(np.minimum(counts, MOST).astype(np.uint8).tobytes(), codec="zstd", asbytes=True)


def tally(rows: DataFrame, chunks: Callable[[Iterator], Iterator[tuple[np.ndarray, np.ndarray]]], n_ranges: int, scratch: Scratch) -> str:
    """Count the codes of all chunks; the place of a table that is laid out by the task and chunk that will ask for it.

    ``chunks``: a task's batches to (sorted distinct codes, their counts), chunk by chunk, the same at every reading: the rows
    must come straight from files. Codes go, packed and cut into ranges, to a task for each range; that one adds up and answers
    each chunk with a byte for each code, in the order it was asked.
    """

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bounds = np.array([(i << CODE_BITS) // n_ranges for i in range(n_ranges + 1)], np.uint64)
        for chunk, (codes, counts) in enumerate(chunks(batches)):
            cuts = np.searchsorted(codes, bounds)
            filled = np.nonzero(np.diff(cuts))[0]
            spans = [(int(cuts[r]), int(cuts[r + 1])) for r in filled]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(filled, pa.int32()), pa.array([part] * len(spans), pa.int32()), pa.array([chunk] * len(spans), pa.int32()), pa.array([b - a for a, b in spans], pa.int32()),
                    pa.array([packed(codes[a:b]) for a, b in spans], pa.binary()), pa.array([_small(counts[a:b]) for a, b in spans], pa.binary()),
                ],
                names=["range", "part", "chunk", "n", "codes", "counts"],
            )

    def answer(table):
        import pyarrow as pa

        sizes = table.column("n").to_pylist()
        codes = np.concatenate([unpacked(d, n) for d, n in zip(table.column("codes").to_pylist(), sizes, strict=True)])
        counts = np.concatenate([np.frombuffer(pa.decompress(d, n, codec="zstd", asbytes=True), np.uint8) for d, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
        _, inverse = np.unique(codes, return_inverse=True)
        held = np.minimum(np.bincount(inverse, counts), MOST).astype(np.uint8)[inverse]
        ends = np.cumsum(sizes)
        replies = [_small(held[e - n : e]) for e, n in zip(ends.tolist(), sizes, strict=True)]
        return pa.table({"part": table.column("part"), "chunk": table.column("chunk"), "range": table.column("range"), "n": table.column("n"), "held": pa.array(replies, pa.binary())})

    asked = rows.mapInArrow(ask, "range int, part int, chunk int, n int, codes binary, counts binary")
    replies = asked.groupBy("range").applyInArrow(answer, "part int, chunk int, range int, n int, held binary")
    path = scratch.path("tally")
    replies.repartition("part").sortWithinPartitions("part", "chunk", "range").write.partitionBy("part").parquet(path)
    return path if "://" in path else "file://" + path


class Replies:
    """The answers to the task that runs, read chunk by chunk."""

    def __init__(self, place: str):
        from pyarrow import fs
        from pyspark import TaskContext

        system, inner = fs.FileSystem.from_uri(f"{place}/part={TaskContext.get().partitionId()}")
        found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
        self.files = [self._rows(system, f.path) for f in found if f.is_file and f.path.endswith(".parquet")]
        self.heads = [next(f, None) for f in self.files]

    @staticmethod
    def _rows(system, path: str) -> Iterator[tuple[int, int, int, bytes]]:
        from pyarrow import parquet

        with system.open_input_file(path) as source:
            for batch in parquet.ParquetFile(source).iter_batches(batch_size=128, columns=["chunk", "range", "n", "held"]):
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def of(self, chunk: int, count: int) -> np.ndarray:
        """How often each of the chunk's ``count`` codes occurs, MOST at most; chunks are asked for in order."""
        import pyarrow as pa

        got = []
        for i, head in enumerate(self.heads):
            while head is not None and head[0] <= chunk:
                if head[0] == chunk:
                    got.append(head[1:])
                head = next(self.files[i], None)
            self.heads[i] = head
        held = [np.frombuffer(pa.decompress(d, n, codec="zstd", asbytes=True), np.uint8) for _, n, d in sorted(got, key=lambda g: g[0])]
        if sum(map(len, held)) != count:
            raise RuntimeError("the rows' partitions changed between two readings")
        return np.concatenate(held) if held else np.zeros(0, np.uint8)
