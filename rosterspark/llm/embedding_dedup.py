"""Near-duplicate vectors: Euclidean p-stable hashing in several tables, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import Scratch, connected, tiles

#: Tables, projections in a table, width of a projection's steps, bits of the sketch, and the distance of sketches up to
#: which two vectors of a bucket count as candidates. At cosine 0.9 a pair meets in some table with probability 0.94, at
#: 0.95 with more than 0.9999; the sketches of a pair at 0.9 are that near with probability above 0.9999.
TABLES, PROJECTIONS, STEP, SKETCH, NEAR = 96, 18, 2.0, 128, 38
#: Vectors of a bucket that are compared by sketch; in a bucket with more, all are candidates.
BUCKET = 512
#: Vectors in a tile.
TILE = 4096


def hashing(dimension: int, seed: int, tables: int, projections: int, step: float):
    """(projections, offsets, mixers, sketch planes) for vectors of one dimension, the same everywhere."""
    rng = np.random.default_rng([seed, dimension])
    lines = rng.standard_normal((dimension, tables * projections))
    offsets = rng.uniform(0, step, tables * projections)
    mixers = rng.integers(1, 1 << 62, (tables, projections), dtype=np.int64) | 1
    planes = rng.standard_normal((dimension, SKETCH))
    return lines, offsets, mixers, planes


def usable(vector) -> bool:
    if vector is None or len(vector) == 0 or any(x is None for x in vector):
        return False
    v = np.asarray(vector, np.float64)
    return bool(np.isfinite(v).all() and np.abs(v).max() > 0)


def normalised(v: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def describe(vectors: DataFrame) -> DataFrame:
    """vec_id, node (64-bit hash of the components; null if the vector can't be compared), vector (doubles, 8 bytes each)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            held = [np.asarray(v, np.float64).tobytes() if usable(v) else None for v in batch.column(1).to_pylist()]
            nodes = [None if v is None else xxhash.xxh3_64_intdigest(v) - (1 << 63) for v in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(held, pa.binary())], names=["vec_id", "node", "vector"])

    return vectors.mapInArrow(run, "vec_id long, node long, vector binary")


def buckets(nodes: DataFrame, seed: int, tables: int, projections: int, step: float) -> DataFrame:
    """bucket (hash of table, dimension and quantised projections), node, sketch (signs of further projections)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            names, held = np.array(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
            for width in sorted({len(v) for v in held}):
                here = np.array([i for i, v in enumerate(held) if len(v) == width])
                lines, offsets, mixers, planes = hashing(width // 8, seed, tables, projections, step)
                for at in range(0, len(here), 2000):
                    part = here[at : at + 2000]
                    unit = normalised(np.frombuffer(b"".join([held[i] for i in part]), np.float64).reshape(len(part), -1))
                    steps = np.floor((unit @ lines + offsets) / step).astype(np.int64).reshape(len(part), tables, projections)
                    with np.errstate(over="ignore"):
                        keys = (steps * mixers).sum(axis=2)
                        keys ^= keys >> 29
                        keys = keys * np.int64(0x5851F42D4C957F2D) + np.arange(tables) * np.int64(0x14057B7EF767814F) + width
                        keys ^= keys >> 32
                    sketches = np.packbits(unit @ planes > 0, axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(np.repeat(names[part], tables)), *(pa.array(np.repeat(sketches[:, i], tables)) for i in range(SKETCH // 64))],
                        names=["bucket", "node", "s0", "s1"],
                    )

    return nodes.select("node", "vector").mapInArrow(run, "bucket long, node long, s0 long, s1 long")


def candidate_edges(hashed: DataFrame, near: int, bucket: int) -> DataFrame:
    """Edges ``a, b`` that connect the candidates of each bucket; never all pairs.

    Buckets come sorted, one after the other. Up to ``bucket`` vectors are compared by sketch and joined into
    trees; a larger bucket becomes a star around its first vector, without a comparison, as it streams by.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def trees(nodes, sketches):
            if len(nodes) > bucket:
                return [(nodes[0], n) for n in nodes[1:]]
            apart = np.bitwise_count((sketches[:, None, :] ^ sketches[None, :, :]).view(np.uint64)).sum(axis=2, dtype=np.int64)
            roots, out = np.arange(len(nodes)), []
            for i, j in zip(*np.nonzero(np.triu(apart <= near, 1)), strict=True):
                if roots[i] != roots[j]:
                    out.append((nodes[i], nodes[j]))
                    roots[roots == roots[j]] = roots[i]
            return out

        open_key, nodes, sketches = None, [], []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            names = batch.column(1).to_numpy()
            marks = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1)
            cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)] if len(keys) else []
            found = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if open_key is not None and keys[a] != open_key:
                    if len(nodes) > 1:
                        found += trees(nodes, np.array(sketches))
                    nodes, sketches = [], []
                open_key = keys[a]
                if len(nodes) > bucket:  # it is a star already
                    found += [(nodes[0], n) for n in names[a:b].tolist()]
                    continue
                nodes += names[a:b].tolist()
                sketches += marks[a:b].tolist()
                if len(nodes) > bucket:
                    found += [(nodes[0], n) for n in nodes[1:]]
                    nodes, sketches = nodes[:1] * (bucket + 1), []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
        if 1 < len(nodes) <= bucket:
            found = trees(nodes, np.array(sketches))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[i]) for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return hashed.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a long, b long").distinct()


def count_links(members: DataFrame, least: float) -> DataFrame:
    """``members``: tile, cluster, node, block, copies, vector. Rows a, b, n: with b an edge, without it n more links of a."""

    def run(table):
        import pyarrow as pa

        rows: dict = {}
        for cluster, node, block, copies, vector in zip(*(table.column(c).to_pylist() for c in ("cluster", "node", "block", "copies", "vector")), strict=True):
            rows.setdefault((cluster, len(vector)), {})[node] = (block or "", copies, vector)
        out = []
        for inside in rows.values():
            nodes = list(inside)
            blocks = np.array([inside[n][0] for n in nodes])
            copies = np.array([inside[n][1] for n in nodes], np.int64)
            unit = normalised(np.frombuffer(b"".join([inside[n][2] for n in nodes]), np.float64).reshape(len(nodes), -1))
            across = len(set(blocks.tolist())) > 1
            roots, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
            for start in range(0, len(nodes), 512):
                near = unit[start : start + 512] @ unit.T >= least
                near[np.arange(len(near)), start + np.arange(len(near))] = False
                if across:
                    near &= blocks[start : start + 512, None] != blocks[None, :]
                links[start : start + 512] += near @ copies
                for i in range(len(near)):
                    partners = np.nonzero(near[i])[0]
                    while len(partners := partners[roots[partners] != roots[start + i]]):
                        out.append((nodes[start + i], nodes[partners[0]], 0))
                        roots[roots == roots[partners[0]]] = roots[start + i]
            out += [(n, None, int(k)) for n, k in zip(nodes, links, strict=True) if k]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({k: pa.array(c, pa.int64()) for k, c in zip("abn", columns, strict=True)})

    return members.groupBy("tile").applyInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, *, least: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding", seed: int = 7, tables: int = TABLES, projections: int = PROJECTIONS, step: float = STEP, near: int = NEAR) -> DataFrame:
    """Links between vectors found with cosine ``least`` or more (in doubles, exact), none below it.

    One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept
    (vec_id = component_id).

    Equal vectors are one node with a count, so copies cost nothing more. Quantised random projections of the normalised
    nodes give a bucket in each table; only hashes and a 128-bit sketch are shuffled. Candidates of a bucket are
    connected, never listed as pairs; the connected ones form clusters, which are dealt into tiles of bounded size, and
    every pair of a tile gets its exact cosine, once. Recall is a matter of the tables; see the constants above.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept.
    Vectors of different length never link. Repeated and null ids: rows count on their own; a component whose ids are
    all null has a null id and its rows aren't kept apart. Empty table: no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    described = scratch.table(describe(rows), "vectors")
    nodes = described.where(F.col("node").isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    nodes = scratch.table(nodes, "nodes")
    edges = candidate_edges(buckets(nodes, seed, tables, projections, step), near, BUCKET)
    clusters = connected(edges, scratch)
    members = scratch.table(clusters.select(F.col("root").alias("cluster"), "node", F.lit(0).alias("band"), F.lit(1).cast("long").alias("weight")), "members")
    dealt = tiles(members, TILE, scratch).join(nodes, "node")
    found = scratch.table(count_links(dealt, least), "links")
    roots = connected(found.where(F.col("b").isNotNull()).select("a", "b"), scratch)
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    each = nodes.select("node", "copies").join(counts, "node", "left").join(roots, "node", "left")
    each = each.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    named = scratch.table(described.select("vec_id", "node").join(each, "node", "left"), "named")
    scratch.keep_only(named)
    smallest = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("vec_id").alias("smallest"))
    out = named.join(smallest, "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("smallest", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
