"""Exact Jaccard self-join of word n-gram sets: size bands, bitmap bounds, sorted-array intersection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import Scratch, connected, free_name, tiles
from rosterspark.llm.tally import Replies, ranges, tally
from rosterspark.llm.tokens import forget_words, slices

#: Weight of a tile: shingles, and 256 for each document.
TILE = 1_000_000
#: Bits of a signature for each shingle, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 15
#: Shingles that a task holds at once while shingles are counted.
CHUNK = 500_000
#: Words that a task remembers.
REMEMBERED = 150_000

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


class Words(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, width: int, words: Words) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of ``width`` words; of the whole sequence if it is shorter.

    Words are what stands between ASCII white space; A-Z count as a-z.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(width, len(parts))
    out = np.full(len(hashed) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ hashed[i : len(hashed) - n + 1 + i]) * np.uint64(_MULTIPLIERS[i % 8] + 2 * (i // 8))
            out ^= out >> np.uint64(32)
    return np.unique(out)


def needed(n: int, num: int, den: int) -> int:
    """Shingles that any partner of a set of ``n`` must share with it: den * shared >= num * n."""
    return -(-num * n // den)


def prefix(found: np.ndarray, held: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set in one global order, the rarest first, then by hash: so many that partners share one.

    ``held``: for each shingle, how many sets hold it.
    """
    count = len(found) - needed(len(found), num, den) + 1
    return found[np.lexsort((found, held))[:count]]


def _identity(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _rows(batch, width: int, words: Words):
    texts = batch.column(1).to_pylist()
    for a, b in slices([t or "" for t in texts]):
        yield a, [shingles(t, width, words) for t in texts[a:b]]


class Chunks:
    """Sets that a task meets for the first time, in chunks of about ``most`` shingles; the same at every reading."""

    def __init__(self, width: int, most: int = CHUNK):
        forget_words()
        self.words, self.met, self.width, self.most = Words(), set(), width, most

    def of(self, batches: Iterator) -> Iterator[tuple[list, list[np.ndarray], list[int | None], list[bool]]]:
        """(doc ids, sets, nodes, whether new) of each chunk."""
        ids, sets, nodes, new, size = [], [], [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, found in _rows(batch, self.width, self.words):
                for i, s in enumerate(found, a):
                    node = _identity(s) if len(s) else None
                    fresh = node is not None and node not in self.met
                    self.met.add(node)
                    ids.append(names[i])
                    sets.append(s)
                    nodes.append(node)
                    new.append(fresh)
                    size += len(s) if fresh else 1
                if size >= self.most:
                    yield ids, sets, nodes, new
                    ids, sets, nodes, new, size = [], [], [], [], 0
        if ids:
            yield ids, sets, nodes, new


def _codes(sets: list[np.ndarray], new: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 40-bit codes of the shingles of new sets, and in how many of these sets each stands."""
    some = [s for s, fresh in zip(sets, new, strict=True) if fresh]
    return np.unique(np.concatenate(some) >> np.uint64(24), return_counts=True) if some else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _chunk_codes(width: int):
    """For ``tally``: the codes of each chunk of a task."""
    return lambda batches: (_codes(sets, new) for _, sets, _, new in Chunks(width).of(batches))


def describe(docs: DataFrame, width: int, num: int, den: int, holders: str) -> DataFrame:
    """doc_id, n (set size), node (64-bit hash of the set; null: empty), prefix (only where a task first meets the set)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        replies = Replies(holders)
        for chunk, (ids, sets, nodes, new) in enumerate(Chunks(width).of(batches)):
            codes, _ = _codes(sets, new)
            held = replies.of(chunk, len(codes))
            prefixes = [_signed(prefix(s, held[np.searchsorted(codes, s >> np.uint64(24))], num, den)) if fresh else None for s, fresh in zip(sets, new, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, prefix array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """node, items (the set's hashes, sorted, 8 bytes each)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = Words()
        for batch in batches:
            for _, sets in _rows(batch, width, words):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_identity(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, items binary")


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits), np.float32)
    for i, s in enumerate(sets):
        out[i, (s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return out


def _close_pairs(sets: list[np.ndarray], blocks: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, indices of later sets that may link with it) for sets in order of size.

    Every set bit of one signature that the other lacks is at least one shingle of its own, so set size less such bits
    bounds the overlap from above. Sets of two blocks are compared across the blocks only.
    """
    n = np.array([len(s) for s in sets])
    across = len(set(blocks.tolist())) > 1
    # Chunks of about 4 million signature bits; the sizes in a chunk are near each other, the partners' follow.
    start = 0
    while start < len(sets):
        last = int(np.searchsorted(n * num, n[start] * den, side="right"))
        bits = min(MOST_BITS, 1 << int(BITS_EACH * n[min(last, len(n)) - 1] - 1).bit_length())
        stop = min(len(sets), start + max(1, 4_000_000 // bits))
        stop = min(stop, max(last, start + 1))
        partner_end = int(np.searchsorted(n * num, n[stop - 1] * den, side="right"))
        left = bitmaps(sets[start:stop], bits)
        left_bits = left.sum(axis=1)
        for begin in range(start, partner_end, max(1, 8_000_000 // bits)):
            end = min(partner_end, begin + max(1, 8_000_000 // bits))
            right = left if (begin, end) == (start, stop) else bitmaps(sets[begin:end], bits)
            both = left @ right.T
            sizes_a, sizes_b = n[start:stop, None], n[None, begin:end]
            bound = np.minimum(sizes_a - (left_bits[:, None] - both), sizes_b - (right.sum(axis=1)[None, :] - both))
            fit = (bound * (num + den) >= num * (sizes_a + sizes_b)) & (np.arange(begin, end)[None, :] > np.arange(start, stop)[:, None])
            if across:
                fit &= blocks[start:stop, None] != blocks[None, begin:end]
            for i in np.nonzero(fit.any(axis=1))[0].tolist():
                yield start + i, begin + np.nonzero(fit[i])[0]
        start = stop


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    return len(np.intersect1d(a, b, assume_unique=True)) * (num + den) >= num * (len(a) + len(b))


def _by_size(sets: list[np.ndarray], *more: list) -> tuple:
    order = np.argsort([len(s) for s in sets], kind="stable")
    return [sets[i] for i in order], *(np.array([m[i] for i in order]) for m in more)


def tile_links(nodes: np.ndarray, sets: list[np.ndarray], blocks: list, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of nodes that link and join what wasn't joined before: enough to keep the tile connected as its links do.

    Pairs whose bound and sizes allow a link are intersected exactly, unless both ends are connected already.
    """
    sets, nodes, blocks = _by_size(sets, nodes.tolist(), [b or "" for b in blocks])
    roots, out = np.arange(len(sets)), []
    for mine, partners in _close_pairs(sets, blocks, num, den):
        while len(partners := partners[roots[partners] != roots[mine]]):
            other, partners = int(partners[0]), partners[1:]
            if _linked(sets[mine], sets[other], num, den):
                out.append((int(nodes[mine]), int(nodes[other])))
                roots[roots == roots[other]] = roots[mine]
    return out


def tile_counts(nodes: np.ndarray, sets: list[np.ndarray], blocks: list, copies: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """(node, documents of other sets that link with it in this tile); all pairs that the bound allows are intersected."""
    sets, nodes, blocks, copies = _by_size(sets, nodes.tolist(), [b or "" for b in blocks], copies)
    found = np.zeros(len(sets), np.int64)
    for mine, partners in _close_pairs(sets, blocks, num, den):
        for other in partners.tolist():
            if _linked(sets[mine], sets[other], num, den):
                found[mine] += copies[other]
                found[other] += copies[mine]
    return [(int(nodes[i]), int(found[i])) for i in np.nonzero(found)[0]]


def link(members: DataFrame, num: int, den: int) -> DataFrame:
    """``members``: tile, cluster, node, block, items. Edges ``a, b`` of each tile; a tile is bounded by construction."""

    def run(table):
        import pyarrow as pa

        rows = {}
        for cluster, node, block, items in zip(*(table.column(c).to_pylist() for c in ("cluster", "node", "block", "items")), strict=True):
            rows.setdefault(cluster, {})[node] = (block, items)
        found = []
        for inside in rows.values():
            if len(inside) > 1:
                found += tile_links(np.array(list(inside)), [np.frombuffer(i, np.uint64) for _, i in inside.values()], [b for b, _ in inside.values()], num, den)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return members.groupBy("tile").applyInArrow(run, "a long, b long")


def count_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """``members``: tile, cluster, node, block, items, copies. node, links: documents of other sets that it links with."""

    def run(table):
        import pyarrow as pa

        rows = {}
        for cluster, node, block, items, copies in zip(*(table.column(c).to_pylist() for c in ("cluster", "node", "block", "items", "copies")), strict=True):
            rows.setdefault(cluster, {})[node] = (block, items, copies)
        found = []
        for inside in rows.values():
            if len(inside) > 1:
                blocks, items, copies = (list(c) for c in zip(*inside.values(), strict=True))
                found += tile_counts(np.array(list(inside)), [np.frombuffer(i, np.uint64) for i in items], blocks, copies, num, den)
        return pa.table({"node": pa.array([n for n, _ in found], pa.int64()), "links": pa.array([k for _, k in found], pa.int64())})

    # Two nodes meet in one tile only, so the tiles' counts add up.
    return members.groupBy("tile").applyInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def stars(heads: DataFrame, scratch: Scratch) -> DataFrame:
    """``heads``: shingle, node. Edges ``a, b`` from each node to the smallest one of each of its shingles.

    Smallest nodes are combined before the shuffle. They are written, so that both sides of the join come straight from
    a shuffle: Spark splits a common shingle only then.
    """
    centres = heads.groupBy("shingle").agg(F.min("node").alias("b"), F.max("node").alias("last")).where(F.col("b") != F.col("last")).select("shingle", "b")
    centres = scratch.table(centres, "centres")
    return heads.join(centres, "shingle").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()


def jaccard_components(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (80, 100), id_column: str = "doc_id", text_column: str = "text", stable: bool = False, links: bool = False) -> DataFrame:
    """Documents whose word n-gram sets have a Jaccard similarity of ``threshold`` (a fraction) or more, as components.

    One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included); with ``links``
    also n_links, the number of other documents linked with it. Counting needs every pair that the bounds allow; components
    alone need only pairs that aren't connected yet.

    1. Equal sets are one node from here on, so copies cost nothing more, however many there are.
    2. Two sets that link share a shingle of their prefixes in a common global order. Shingles that few sets hold come
       first, so what many documents share makes no candidates; for that, all shingles are counted. Nodes that share one
       are candidates; they are connected by edges to the first node of a shingle, never as pairs, and components of those
       edges are clusters: no link leaves a cluster.
    3. A cluster is dealt into tiles of bounded weight, by bands of set size; only the same and neighbouring bands can link.
       In a tile, bitmap signatures bound the overlap, then sorted arrays are intersected exactly.
    4. Components of the links are the result. No link is lost: each step only leaves out pairs that can't link. A
       cluster of very many different near copies costs tiles in proportion to the square of its blocks.

    Sets and shingles are compared by 64-bit hashes. Null, empty and blank texts: n_shingles 0, linked with nothing.
    Fewer words than ``width``: the whole sequence is one shingle. Rows with a repeated id count on their own (their
    component's id is the same number); null ids link, but never name a component unless all are null. Empty table: no rows.

    ``stable``: the rows come straight from files, so each reading deals them into the same partitions; otherwise they are
    written once before.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    if not stable:
        rows = scratch.table(rows, "documents")
    named = rooted(rows, width, threshold, scratch, links)
    scratch.keep_only(named)
    # Signed node order isn't document order, so the smallest document names the component.
    smallest = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("smallest"))
    return named.join(smallest, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"), *(["n_links"] if links else []))


def rooted(rows: DataFrame, width: int, threshold: tuple[int, int], scratch: Scratch, count: bool = False) -> DataFrame:
    """``rows``: doc_id, text, straight from files. A staged table with a row for each: doc_id, n, node, root (and n_links).

    root: one node for each component; null for documents without words.
    """
    num, den = threshold
    # How many sets hold each shingle: all are counted, without a row for each.
    holders = tally(rows.select("doc_id", "text"), _chunk_codes(width), ranges(rows), scratch)
    described = scratch.table(describe(rows, width, num, den, holders), "sets")
    classes = described.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    heads = described.select(F.explode("prefix").alias("shingle"), "node")
    clusters = scratch.table(connected(stars(heads, scratch), scratch), "clusters")
    # Bands are a thousandth wider than the threshold asks, so rounding never puts linked sizes two bands apart.
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num * 1.001))).cast("int")
    members = clusters.join(classes, "node").select(F.col("root").alias("cluster"), "node", "first", band.alias("band"), (F.col("n") + 256).alias("weight"))
    members = scratch.table(members, "members")
    wanted = members.select(F.col("first").alias("wanted")).distinct()
    chosen = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    dealt = tiles(members, TILE, scratch).join(sets_of(chosen, width), "node")
    if count:
        dealt = scratch.table(dealt, "dealt")
    links = scratch.table(link(dealt, num, den), "links")
    roots = connected(links, scratch)
    found = described.select("doc_id", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if count:
        others = count_links(dealt.join(classes.select("node", "copies"), "node"), num, den)
        found = found.join(classes.select("node", "copies"), "node", "left").join(others, "node", "left")
        found = found.withColumn("n_links", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))).drop("copies", "links")
    return scratch.table(found, "named")


def keep_one(docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (80, 100), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the smallest id, and of equal ids the first.

    Rows count on their own, whether or not their ids repeat; a null id stays only if all of the component are null. Rows
    without words stay. Other columns pass through, whatever their names. Empty table: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    number = free_name(docs, "__row")
    # Written, so that a row has the same number whenever it is read.
    keyed = scratch.table(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    rows = keyed.select(F.col(number).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    found = rooted(rows, width, threshold, scratch)
    scratch.keep_only(keyed, found)
    ids = keyed.select(F.col(number).alias("row"), F.col(id_column).cast("long").alias("id"))
    places = found.where(F.col("root").isNotNull()).select("root", F.col("doc_id").alias("row")).join(ids, "row")
    first = places.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).getField("row").alias(number))
    wordless = found.where(F.col("root").isNull()).select(F.col("doc_id").alias(number))
    return keyed.join(first.select(number).unionByName(wordless), number, "left_semi").select(*docs.columns)
