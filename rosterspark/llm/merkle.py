"""Merkle manifest of a dataset: a tree of digests per source, a tree over the sources, and a proof for every document.

Both directions are time-forward processing. Nodes are labelled so that children come before their parent; a sweep in
order of labels sends each node's digest to its parent through a priority queue, and a sweep in the opposite order sends
proof suffixes back. Trees are cut into blocks of consecutive nodes: inside a block the queue is a heap in the task, and what
goes from one block to another is a message in a written table, which Spark sorts by receiver (the queue's external part).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import Scratch

#: Children of a node, at most.
FAN = 3
#: Levels of a block; a block has up to 3 to the power of this many nodes at its foot (6,561), and only one block is in memory.
BLOCK_LEVELS = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The digest (binary) of a document's fields; ``changed`` gives other values for some."""
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]), 256))


def parent(digests: Iterable[bytes]) -> bytes:
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def label(level: int, last: int) -> int:
    """Time of a node: after the last leaf below it (``last``, counted at the foot), lower levels first."""
    return last << 6 | level


def sweep_up(foot: list[bytes]) -> tuple[bytes, int, list[tuple[int, list[tuple[int, bytes]]]]]:
    """Time-forward: (digest of the top node, its level, inner nodes in order of time with their children's labels and digests).

    Every node sends its digest to its parent's time. The queue holds at most ``FAN`` messages a level.
    """
    n = len(foot)
    height = 0
    while FAN**height < n:
        height += 1
    queue: list[tuple[int, int, bytes]] = []
    inner: list[tuple[int, list[tuple[int, bytes]]]] = []
    top = foot[0]

    def send(level: int, place: int, last: int, digest: bytes) -> None:
        nonlocal top
        if level == height:
            top = digest
            return
        end = min(n, (place // FAN + 1) * FAN ** (level + 1)) - 1
        heapq.heappush(queue, (label(level + 1, end), label(level, last), digest))

    for i, digest in enumerate(foot):
        send(0, i, i, digest)
        while queue and queue[0][0] >> 6 <= i:
            now = queue[0][0]
            children = []
            while queue and queue[0][0] == now:
                _, child, got = heapq.heappop(queue)
                children.append((child, got))
            inner.append((now, children))
            level, last = now & 63, now >> 6
            send(level, last // FAN**level, last, parent([d for _, d in children]))
    return top, height, inner


def sweep_down(foot: list[bytes], suffix: bytes, path: bytes) -> list[tuple[bytes, bytes]]:
    """Time-backward: for each node at the foot its siblings' digests, level by level from below, then ``suffix``; and its path.

    A path has a byte a level: 3 times the size of the run plus the place in it. Parents come before their children here, so
    the queue is ordered by falling time.
    """
    top, height, inner = sweep_up(foot)
    out: list = [(suffix, path)] * len(foot)
    queue = [(-label(height, len(foot) - 1), suffix, path)]
    for now, children in reversed(inner):
        _, above, steps = heapq.heappop(queue)
        digests = [d for _, d in children]
        for place, (child, _) in enumerate(children):
            message = b"".join(digests[:place] + digests[place + 1 :]) + above, bytes([FAN * len(children) + place]) + steps
            if child & 63:
                heapq.heappush(queue, (-child, *message))
            else:
                out[child >> 6] = message
    return out


def fold(digest: bytes, proof: bytes, path: bytes) -> bytes:
    """The root that a leaf and its proof give."""
    at = 0
    for step in path:
        size, place = divmod(step, FAN)
        run = [proof[at + 32 * i : at + 32 * (i + 1)] for i in range(size - 1)]
        at += 32 * (size - 1)
        digest = parent([*run[:place], digest, *run[place:]])
    return digest


def alone(digest: bytes, levels: int) -> bytes:
    for _ in range(levels):
        digest = parent([digest])
    return digest


def _runs(batches: Iterator, columns: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, a list for each value of the first ``columns`` columns."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:columns] != now:
                if rows:
                    yield rows
                now, rows = row[:columns], []
            rows.append(row)
    if rows:
        yield rows


def _batches(rows: Iterator[tuple], names: list[str], types: list, most: int = 5_000) -> Iterator:
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    waiting: list[tuple] = []

    def out():
        columns = zip(*waiting, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=names)

    for row in rows:
        waiting.append(row)
        if len(waiting) >= most:
            yield out()
            waiting = []
    if waiting:
        yield out()


def _map(df: DataFrame, step, schema: str) -> DataFrame:
    """``step``: batches to rows (tuples) of ``schema``."""
    names, types = zip(*[f.split() for f in schema.split(", ")], strict=True)
    return df.mapInArrow(lambda batches: _batches(step(batches), list(names), list(types)), schema)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` (tree, digest and others) with ``place``: the number from 0 in its tree, by ``order``.

    Rows are range-partitioned by tree and order, so a tree with a third of all rows is split. A task counts along its
    sorted rows; a tree that began in an earlier partition adds what stands there. That is one row a partition at most.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order, "tie"]
    # Equal rows are dealt out by where they were read, so that very many of them are split too.
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie")
    names = dealt.columns
    at = names.index("tree")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, tree, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            here = []
            for value in batch.column(at).to_pylist():
                tree, seen = (tree, seen + 1) if value == tree else (value, 1)
                here.append(seen - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(here), pa.int32()), pa.array(here, pa.int64())], names=[*names, "part", "here"])

    schema = dealt.withColumns({"part": F.lit(0), "here": F.lit(0).cast("long")}).schema
    counted = scratch.table(dealt.mapInArrow(count, schema), "numbered")
    totals = counted.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    continued = scratch.table(totals.select("tree", "part", before.alias("before")).where(F.col("before") > 0), "continued")
    joined = counted.join(F.broadcast(continued), ["tree", "part"], "left")
    return joined.withColumn("place", F.col("here") + F.coalesce("before", F.lit(0))).drop("part", "here", "before")


def _foot(rows: list[tuple]) -> tuple[list[bytes], bool]:
    """Digests at a block's foot (rows: tree, block, place, digest, missing), and whether the tree has more than one node there."""
    several = len(rows) > 1 or rows[0][1] > 0
    return [alone(r[3], r[4]) if several else r[3] for r in rows], several


def _up(block_levels: int):
    def step(batches: Iterator) -> Iterator[tuple]:
        for rows in _runs(batches, 2):
            foot, several = _foot(rows)
            top, height, _ = sweep_up(foot)
            # A node that was the only one of its tree keeps what it lacks, should a level be added above it.
            yield rows[0][0], rows[0][1], top, (block_levels - height) if several else rows[0][4]

    return step


def _down(batches: Iterator) -> Iterator[tuple]:
    for rows in _runs(batches, 2):
        message, nodes = rows[0], rows[1:]
        foot, several = _foot(nodes)
        for node, (proof, path) in zip(nodes, sweep_down(foot, message[5], message[6]), strict=True):
            raised = bytes([FAN]) * node[4] if several else b""  # runs of one on the way to this level
            yield node[0], node[2], node[3], proof, raised + path, message[7], *node[8:]


class Forest:
    """Trees of ``nodes`` (tree string, place long, digest binary), level by level of blocks.

    ``levels[k]`` has a row for each node at the foot of level k: tree, place, digest, missing. The digest is the one at which
    a block had one node left; a block that isn't the only one of its tree takes part in the next level after ``missing``
    more hashes of its single node. The last level has one node a tree.
    """

    def __init__(self, nodes: DataFrame, scratch: Scratch, block_levels: int = BLOCK_LEVELS):
        self.scratch, self.size = scratch, FAN**block_levels
        self.levels = [nodes.withColumn("missing", F.lit(0))]
        last = self._last(self.levels[0])
        while last:
            now = self._swept(self.levels[-1].select("tree", F.expr(f"place div {self.size}").alias("block"), "place", "digest", "missing"))
            table = scratch.table(_map(now, _up(block_levels), "tree string, place long, digest binary, missing int"), "level")
            self.levels.append(table)
            last = self._last(table)

    @staticmethod
    def _last(nodes: DataFrame) -> int:
        return nodes.agg(F.max("place")).first()[0] or 0

    @staticmethod
    def _swept(rows: DataFrame) -> DataFrame:
        return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")

    def tops(self) -> DataFrame:
        """tree, digest: the top node of each tree."""
        return self.levels[-1].select("tree", "digest")

    def deliver(self, messages: DataFrame, carried: list[str], out) -> DataFrame:
        """Send ``messages`` (tree, suffix, path, top; one for each tree) from the tops to the nodes.

        Result: a row for each node with its own proof, path and top and the ``carried`` columns of ``nodes``. Only the messages
        to blocks are written; those to the nodes are not.
        """
        now = messages.withColumn("place", F.lit(0).cast("long"))
        for k in range(len(self.levels) - 2, -1, -1):
            keep = carried if k == 0 else []
            nodes = self.levels[k].select("tree", F.expr(f"place div {self.size}").alias("block"), "place", "digest", "missing", F.lit(None).cast("binary").alias("suffix"), F.lit(None).cast("binary").alias("path"), F.lit(None).cast("binary").alias("top"), *keep)
            sent = now.select("tree", F.col("place").alias("block"), F.lit(-1).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("missing"), "suffix", "path", "top")
            met = self._swept(nodes.unionByName(sent, allowMissingColumns=True))
            kinds = dict(met.dtypes)
            schema = ", ".join(["tree string", "place long", "digest binary", "suffix binary", "path binary", "top binary", *[f"{c} {kinds[c].replace('bigint', 'long')}" for c in keep]])
            now = _map(met, _down, schema)
            if k:
                now = self.scratch.table(now.drop("digest"), "messages")
        if len(self.levels) == 1:  # every tree is one node
            now = self.levels[0].join(messages, "tree").select("tree", "place", "digest", "suffix", "path", "top", *carried)
        return out(now)


def proofs(leaves: DataFrame, scratch: Scratch, *, carried: list[str], block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """The proofs of ``leaves``: source, doc_id, leaf (binary) and the ``carried`` columns.

    Adds subroot, root, proof (binary: siblings' digests from the leaf's run up to the root) and path (a byte a run). Leaves of
    a source stand in order of doc_id, equal ids in order of digest; the null source comes first, others in byte order.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = leaves.select(tree.alias("tree"), "doc_id", F.col("leaf").alias("digest"), *carried)
    placed = numbered(rows, ["doc_id", "digest"], scratch)
    documents = Forest(placed, scratch, block_levels)
    tops = scratch.table(documents.tops().select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest"), "subroots")
    sources = Forest(numbered(tops, ["source"], scratch), scratch, block_levels)
    root = sources.tops().first()
    if root is None:
        empty = leaves.select("doc_id", "leaf", *carried, *[F.lit(None).cast("binary").alias(c) for c in ("subroot", "root", "proof", "path")])
        return empty.where(F.lit(False))
    nothing = F.lit(b"")
    top = leaves.sparkSession.range(1).select(F.lit("").alias("tree"), nothing.alias("suffix"), nothing.alias("path"), nothing.alias("top"))
    to_sources = sources.deliver(top, ["source"], lambda got: got.select(F.col("source").alias("tree"), "suffix", "path", F.col("digest").alias("top")))
    to_sources = scratch.table(to_sources, "to-sources")
    root_digest = F.lit(bytes(root["digest"]))
    return documents.deliver(
        to_sources, ["doc_id", *carried],
        lambda got: got.select("doc_id", F.col("digest").alias("leaf"), *carried, F.col("top").alias("subroot"), root_digest.alias("root"), F.col("suffix").alias("proof"), "path"),
    )


def manifest(docs: DataFrame, *, checked: Column | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Leaf, subroot, root, proof and path (all binary) of every row of ``docs``, and ``folded``: the root that ``checked`` gives.

    ``checked``: the digest to hold against the manifest, such as ``leaf`` of the documents as they are found later (null or
    not given: the leaf itself). A document is unchanged if ``folded`` equals ``root``.

    Only ids, sources and digests leave the scan of the texts. Nulls count as such in a leaf; a null id comes first in its
    source, a null source first of all. Rows with a repeated id are leaves of their own, in order of their digests; equal rows
    are interchangeable. Other columns are ignored. A single document is subroot and root itself, with an empty proof. Empty
    table: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    names = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    held = F.lit(None).cast("binary") if checked is None else checked
    leaves = docs.select(*[F.col(c).cast(t).alias(c) for c, t in names.items()]).select("doc_id", "source", leaf().alias("leaf"), held.alias("checked"))
    found = proofs(leaves, scratch, carried=["checked"], block_levels=block_levels)

    def folded(batches: Iterator) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                doc_id, digest, other, subroot, root, proof, path = row
                yield doc_id, digest, subroot, root, proof, path, fold(digest if other is None else other, proof, path)

    return _map(found.select("doc_id", "leaf", "checked", "subroot", "root", "proof", "path"), folded, "doc_id long, leaf binary, subroot binary, root binary, proof binary, path binary, folded binary")


def without_line_ends() -> Column:
    """The leaf of a document that lost its line ends; null where the crc32 of its id is odd, or the id is null."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    return F.when(even, leaf(text=F.translate("text", "\n", "")))
