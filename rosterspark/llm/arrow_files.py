"""Token ids in Arrow stream files of fixed-size lists, written and read by Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import Scratch
from rosterspark.llm.tokens import file_encoder, slices

LENGTH = 2048
#: Sequences in a record batch.
BATCH = 64
FILES = "file string, part int, sequences long, documents long, tokens long"
DOCUMENTS = "part int, doc_id long, nth long, local_start long, n_tokens long, ids_crc32 long"


def file_schema(length: int, id_type):
    """``ids`` and ``mask`` (1: an id, 0: padding) of equal length; the documents that end in the sequence and where."""
    import pyarrow as pa

    return pa.schema([
        ("ids", pa.list_(pa.field("item", id_type, nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length)),
        ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int32())),
    ])


def open_file(path: str, mode: str):
    """A file of any file system that Arrow knows by its URI. A local one is mapped for reading, without a copy."""
    import pyarrow as pa
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    if mode == "r":
        return pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, *, id_column: str = "doc_id", text_column: str = "text", end_id: int = 2, length: int = LENGTH, batch_rows: int = BATCH) -> DataFrame:
    """Encode the texts and write their ids below ``folder``, in ascending order of id; returns a row per file.

    Rows are range-partitioned by id, sorted, and each task writes one Arrow stream file: batches of ``batch_rows``
    sequences of ``length`` ids (unsigned 16-bit where the vocabulary fits) with a mask. A document is its ids and
    ``end_id``; documents run on across sequences; only the last sequence of a file is padded. Ends of documents are
    stored, as the end id also occurs inside texts. A file's name is new in every attempt, and the rows returned name
    only the files of attempts that finished, so a lost executor leaves at most a file that nothing refers to.
    Memory holds one batch. Null ids come first, rows with equal id are ordered by the text's hash. Null or
    empty text: the end id alone. Empty table: no files.
    """

    def run(batches: Iterator) -> Iterator:
        import struct
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        end = struct.pack("<I", end_id)
        encoder = writer = sink = schema = None
        rest, ends, names = np.zeros(0, np.uint32), [], []
        sequences = documents = tokens = 0

        def put(ids, last: bool):
            """Write whole batches; at the end, what is left as well, padded. Returns the ids that wait."""
            nonlocal ends, names, sequences
            while len(ids) >= length * batch_rows or last and len(ids):
                real = min(len(ids), length * batch_rows)
                rows = -(-real // length)
                full = np.zeros(rows * length, schema.field("ids").type.value_type.to_pandas_dtype())
                full[:real] = ids[:real]
                mask = np.arange(rows * length) < real
                inside = int(np.searchsorted(ends, real, side="right"))
                at = np.array(ends[:inside], np.int64)
                cuts = pa.array(np.searchsorted((at - 1) // length, np.arange(rows + 1)), pa.int32())
                writer.write_batch(pa.RecordBatch.from_arrays([
                    pa.FixedSizeListArray.from_arrays(pa.array(full), type=schema.field("ids").type), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=schema.field("mask").type),
                    pa.ListArray.from_arrays(cuts, pa.array(names[:inside], pa.int64())), pa.ListArray.from_arrays(cuts, pa.array((at - 1) % length, pa.int32())),
                ], schema=schema))
                sequences += rows
                ends, names, ids = [e - real for e in ends[inside:]], names[inside:], ids[real:]
            return ids

        for batch in batches:
            if encoder is None:
                encoder = file_encoder(tokenizer_path)
                schema = file_schema(length, pa.uint16() if encoder.size <= 65536 and end_id < 65536 else pa.uint32())
                sink = open_file(path, "w")
                writer = pa.ipc.new_stream(sink, schema)
            docs_, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                coded = [c + end for c in encoder.ids(texts[a:b])]
                ends += (len(rest) + np.cumsum([len(c) // 4 for c in coded])).tolist()
                names += docs_[a:b]
                documents += b - a
                tokens += sum(len(c) // 4 for c in coded)
                rest = put(np.concatenate([rest, np.frombuffer(b"".join(coded), "<u4")]), False)
        if writer is not None:
            put(rest, True)
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), *(pa.array([n], pa.int64()) for n in (sequences, documents, tokens))], names=["file", "part", "sequences", "documents", "tokens"])

    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.xxhash64(text_column).alias("h"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "h", "place"]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return rows.select("doc_id", "text").mapInArrow(run, FILES)


def read_sequence(path: str, batch: int, row: int):
    """One sequence of a file, by number, as numpy views of the mapped file: (ids, mask as bools)."""
    import pyarrow as pa

    stream = pa.ipc.open_stream(open_file(path, "r"))
    for _ in range(batch):
        stream.read_next_batch()  # only its header is read
    found = stream.read_next_batch()
    length = found.schema.field("ids").type.list_size
    ids = found.column("ids").flatten()[row * length : (row + 1) * length]
    return ids.to_numpy(zero_copy_only=True), found.column("mask").flatten()[row * length : (row + 1) * length].to_numpy(zero_copy_only=False)


def read_tokens(files: DataFrame) -> DataFrame:
    """Documents as the files of ``write_tokens`` hold them: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Each file is read batch by batch in a task of its own; the files' starts are a running sum over one row per file, which is all
    that is broadcast (a file per shuffle partition).
    """

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for some in batches:
            for path, part in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                start, nth, crc, size = 0, 0, 0, 0
                for found in pa.ipc.open_stream(open_file(path, "r")):
                    length = found.schema.field("ids").type.list_size
                    real = found.column("mask").flatten().to_numpy(zero_copy_only=False)
                    ids = found.column("ids").flatten().to_numpy()[real].astype("<u4")
                    counts = np.diff(found.column("doc_ends").offsets.to_numpy())
                    ends = found.column("doc_ends").flatten().to_numpy() + np.repeat(np.arange(found.num_rows), counts) * length + 1
                    rows, at = [], 0
                    for doc, end in zip(found.column("doc_ids").flatten().to_pylist(), ends.tolist(), strict=True):
                        crc = zlib.crc32(ids[at:end], crc)
                        size += end - at
                        rows.append((part, doc, nth, start, size, crc))
                        start, nth, crc, size, at = start + size, nth + 1, 0, 0, end
                    crc = zlib.crc32(ids[at:], crc)
                    size += len(ids) - at
                    if rows:
                        columns = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=[f.split()[0] for f in DOCUMENTS.split(", ")])

    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    documents = files.select("file", "part").repartition(parts, "part").mapInArrow(run, DOCUMENTS)
    return documents.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the files below the shared folder, keep the list of them as a table, and read all documents back."""
    scratch = Scratch(docs.sparkSession)
    folder = scratch.path("tokens")
    if "://" not in folder:
        folder = "file://" + folder
    return read_tokens(scratch.table(write_tokens(docs, tokenizer_path, folder, **options), "files"))
