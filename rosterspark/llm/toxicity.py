"""Toxicity by a linear-chain conditional random field over tokens: offending spans, and document scores from their marginals."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import Scratch

TOKEN = re.compile(r"\w+")
#: Distinct texts of each label that fitting reads at most, whole; those with the smallest hashes. This bounds what it gathers.
SAMPLE = 2000
#: A word, or the first letters of words, marks toxic tokens if it stands in so many toxic texts, near copies counted once, is
#: so many times as frequent in those as in clean texts, and its log-likelihood ratio is at least this.
LEAST_TEXTS, LEAST_RATIO, LEAST_LLR = 5, 4.0, 25.0
PREFIX = 4
#: Hashed features of a token: the word, its first four letters, the word before and the word after; then bias, begin, transitions.
SIZES = (1 << 16, 1 << 14, 1 << 12, 1 << 12)
OFFSETS = np.cumsum((0, *SIZES))
BIAS, BEGIN, MOVES = int(OFFSETS[-1]), int(OFFSETS[-1]) + 1, int(OFFSETS[-1]) + 2
DIMENSIONS = MOVES + 4
ROUNDS, PENALTY = 30, 1.0
#: Characters of a text that form one chain; longer texts are tagged in parts cut between words.
PART = 1_000_000
#: Words whose weights a task remembers.
REMEMBERED = 200_000


def hashed(words: list[str]) -> np.ndarray:
    """Places (4, words) of the words' features: own, prefix, as the word before, as the word after."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    own = np.array([zlib.crc32(d) for d in data], np.int64)
    prefix = np.array([zlib.crc32(w[:PREFIX].encode("utf-8", "surrogatepass"), 1) for w in words], np.int64)
    return np.stack([o + c % n for o, c, n in zip(OFFSETS, (own, prefix, own >> 8, own >> 8), SIZES, strict=False)])


def _products(m: list[np.ndarray], forward: bool) -> list[np.ndarray]:
    """Running products of 2x2 matrices along the first axis, each scaled to a sum of 1; ``m``: m00, m01, m10, m11 of (steps, rows).

    Backward, the product at a step is that of the matrices after it.
    """
    out = [np.empty_like(x) for x in m]
    steps, rows = m[0].shape
    a, b, c, d = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for j in range(steps) if forward else range(steps - 1, -1, -1):
        m00, m01, m10, m11 = m[0][j], m[1][j], m[2][j], m[3][j]
        if not forward:
            for o, x in zip(out, (a, b, c, d), strict=True):
                o[j] = x
            a, b, c, d = m00 * a + m01 * c, m00 * b + m01 * d, m10 * a + m11 * c, m10 * b + m11 * d
        else:
            a, b, c, d = a * m00 + b * m10, a * m01 + b * m11, c * m00 + d * m10, c * m01 + d * m11
        scale = 1 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
        if forward:
            for o, x in zip(out, (a, b, c, d), strict=True):
                o[j] = x
    return out


def forward_backward(scores: np.ndarray, starts: np.ndarray, moves: np.ndarray, begin: float) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of state 1 for each token, expected moves 2x2) of chains laid end to end.

    ``scores``: log potential of state 1 against 0; ``starts``: where chains begin; ``moves``: log potentials of transitions.
    A chain's first matrix has equal rows, so nothing passes from one chain to the next. Both passes are scans of 2x2 matrix
    products: along all blocks of about the square root of the length at once, then from block to block.
    """
    n = len(scores)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    e = np.exp(np.clip(scores, -30, 30))
    move = np.exp(moves)
    m = [np.where(starts, 1.0, move[0, 0]), np.where(starts, np.exp(begin), move[0, 1]) * e, np.where(starts, 1.0, move[1, 0]), np.where(starts, np.exp(begin), move[1, 1]) * e]
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    laid = [np.concatenate([x, np.full(rows * width - n, u)]).reshape(rows, width).T.copy() for x, u in zip(m, (1.0, 0.0, 0.0, 1.0), strict=True)]
    ahead = _products(laid, True)
    whole = [x[-1] for x in ahead]
    first = np.empty((2, rows))
    v0, v1 = 0.5, 0.5
    for r in range(rows):
        first[:, r] = v0, v1
        v0, v1 = v0 * whole[0][r] + v1 * whole[2][r], v0 * whole[1][r] + v1 * whole[3][r]
        v0, v1 = v0 / (v0 + v1), v1 / (v0 + v1)
    alpha = [first[0] * ahead[0] + first[1] * ahead[2], first[0] * ahead[1] + first[1] * ahead[3]]
    behind = _products(laid, False)
    last = np.empty((2, rows))
    v0, v1 = 0.5, 0.5
    for r in range(rows - 1, -1, -1):
        last[:, r] = v0, v1
        v0, v1 = whole[0][r] * v0 + whole[1][r] * v1, whole[2][r] * v0 + whole[3][r] * v1
        v0, v1 = v0 / (v0 + v1), v1 / (v0 + v1)
    beta = [behind[0] * last[0] + behind[1] * last[1], behind[2] * last[0] + behind[3] * last[1]]
    a0, a1, b0, b1 = (x.T.ravel()[:n] for x in (*alpha, *beta))
    at = a0 * b0 + a1 * b1
    marginal = a1 * b1 / at
    inner = ~starts[1:]
    pairs = [a0[:-1] * m[0][1:] * b0[1:], a0[:-1] * m[1][1:] * b1[1:], a1[:-1] * m[2][1:] * b0[1:], a1[:-1] * m[3][1:] * b1[1:]]
    total = sum(pairs)
    expected = np.array([(p[inner] / total[inner]).sum() for p in pairs]).reshape(2, 2) if n > 1 else np.zeros((2, 2))
    return marginal, expected


def gradient(theta: np.ndarray, places: np.ndarray, starts: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Observed less expected feature counts of tagged chains; ``places``: 4 features of each token."""
    scores = theta[places].sum(axis=0) + theta[BIAS]
    marginal, expected = forward_backward(scores, starts, theta[MOVES:].reshape(2, 2), theta[BEGIN])
    left = tags - marginal
    out = np.zeros(DIMENSIONS)
    for row in places:
        out[:BIAS] += np.bincount(row, left, BIAS)
    out[BIAS], out[BEGIN] = left.sum(), left[starts].sum()
    inner = ~starts[1:]
    observed = np.bincount((2 * tags[:-1] + tags[1:])[inner].astype(np.int64), minlength=4) if len(tags) > 1 else np.zeros(4)
    out[MOVES:] = observed - expected.ravel()
    return out


def features(words: list[str], starts: np.ndarray) -> np.ndarray:
    """Feature places (4, tokens); the first and last word of a chain have the empty word beside them."""
    seen: dict[str, int] = {}
    at = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    table = hashed([*seen, ""])
    return neighbours(table, at, starts, len(seen))


def neighbours(table: np.ndarray, at: np.ndarray, starts: np.ndarray, none: int) -> np.ndarray:
    """Rows own, prefix, before, after of ``table`` for tokens ``at``; ``none`` is the empty word's column."""
    before = np.concatenate([[none], at[:-1]])
    before[starts] = none
    after = np.concatenate([at[1:], [none]])
    after[:-1][starts[1:]] = none
    return np.stack([table[0][at], table[1][at], table[2][before], table[3][after]])


def parts(text: str, most: int = PART) -> list[str]:
    """The text, or pieces of at least ``most`` characters cut where no word is."""
    out, at = [], 0
    while len(text) - at > most:
        end = next((m.start() for m in re.compile(r"\W").finditer(text, at + most)), len(text))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]] if at < len(text) or not out else out


def _sketch(words: list[str]) -> int:
    """The smallest hash of three words in a row: near copies mostly share it."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))), default=0)


@dataclass
class Model:
    """Weights by feature, and a logistic curve from the two document figures to a score. ``share``: used if nothing was learned."""

    theta: np.ndarray | None
    curve: np.ndarray
    share: float
    words: tuple[str, ...] = ()

    def score(self, most: np.ndarray, expected: np.ndarray) -> np.ndarray:
        if self.theta is None:
            return np.full(len(most), self.share)
        return 1 / (1 + np.exp(-np.clip(figures(most, expected) @ self.curve, -30, 30)))


def figures(most: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Of a document: 1, the log odds of its most toxic token, the log of its expected number of toxic tokens."""
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(most)), np.log(most / (1 - most)), np.log(expected + 1e-3)], axis=1)


class Tagger:
    """Marginals of texts under a model; what each word adds is remembered."""

    def __init__(self, theta: np.ndarray):
        self.theta = theta
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[str, int] = {}
        self.table = np.zeros((4, 1 << 12))
        self._learn([""])

    def _learn(self, tokens: list[str]) -> None:
        first, count = len(self.seen), len(self.seen) + len(tokens)
        self.seen.update(zip(tokens, range(first, count), strict=True))
        while count > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.table[:, first:count] = self.theta[hashed([t.lower() for t in tokens])]

    def tag(self, texts: list[str]) -> list[tuple[float, float, int, list[tuple[int, int, float]]]]:
        """For each text: largest marginal, expected toxic tokens, tokens, and spans (start, end, largest marginal) of tokens above a half."""
        if len(self.seen) > REMEMBERED:
            self._reset()
        pieces = [(i, piece) for i, text in enumerate(texts) for piece in parts(text)]
        owner, pieces = [i for i, _ in pieces], [p for _, p in pieces]
        found = [TOKEN.findall(p) for p in pieces]
        chains = [len(f) for f in found]
        new = set().union(*found).difference(self.seen)
        if new:
            self._learn(list(new))
        at = np.fromiter((n for f in found for n in map(self.seen.__getitem__, f)), np.int64, sum(chains))
        del found
        ends = np.cumsum(chains)
        begins = ends - chains
        starts = np.zeros(len(at), bool)
        starts[begins[np.array(chains) > 0]] = True
        weights = neighbours(self.table, at, starts, 0).sum(axis=0) + self.theta[BIAS] if len(at) else np.zeros(0)
        marginal, _ = forward_backward(weights, starts, self.theta[MOVES:].reshape(2, 2), self.theta[BEGIN])
        most, expected, count = np.zeros(len(texts)), np.zeros(len(texts)), [0] * len(texts)
        spans: list[list] = [[] for _ in texts]
        moved = [0] * len(texts)
        for piece, a, b, i in zip(pieces, begins.tolist(), ends.tolist(), owner, strict=True):
            if b > a:
                here = marginal[a:b]
                most[i], expected[i], count[i] = max(most[i], here.max()), expected[i] + here.sum(), count[i] + b - a
                if here.max() >= 0.5:
                    spans[i] += _spans(piece, here, moved[i])
            moved[i] += len(piece)
        return list(zip(most.tolist(), expected.tolist(), count, spans, strict=True))


def _spans(piece: str, marginal: np.ndarray, moved: int) -> list[tuple[int, int, float]]:
    """Tokens above a half; neighbours are one span."""
    out: list[tuple[int, int, float]] = []
    last = -2
    for n, m in enumerate(TOKEN.finditer(piece)):
        if marginal[n] >= 0.5:
            start, end, p = m.start() + moved, m.end() + moved, float(marginal[n])
            if n == last + 1:
                out[-1] = (out[-1][0], end, max(out[-1][2], p))
            else:
                out.append((start, end, p))
            last = n
    return out


def held_out(id_column: str = "doc_id") -> Column:
    """Documents whose labels are never read: crc32 of the id as text, modulo 5, is 0. A null id is not held out (it has no label)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int, scratch: Scratch, *, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most ``sample`` distinct texts a label, those with the smallest hashes; and how many there are of each.

    Only ids and hashes meet the labels. What is chosen is bounded by ``sample``, so it is broadcast and only chosen texts
    leave the scan. A text with both labels is toxic.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull()).where(~held_out("id"))
    hashes = docs.where(F.col(text_column).rlike(r"\w") & ~held_out(id_column)).select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("h"))
    texts = hashes.join(known, "id").groupBy("h").agg(F.max("label").alias("label"), F.min("id").alias("id"))
    texts = scratch.table(texts, "labelled")
    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    chosen = scratch.table(texts.withColumn("nth", nth).where(F.col("nth") <= sample).select("id", "h", "label"), "chosen")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.join(F.broadcast(chosen), ["id", "h"]).dropDuplicates(["h"]).select("label", "text")
    return scratch.table(rows.repartition(8), "sample"), totals


def marks(word: str, marking: frozenset[str]) -> bool:
    return word in marking or (len(word) > PREFIX and word[:PREFIX] + "*" in marking)


def marking_words(sample: DataFrame) -> list[str]:
    """Words, and beginnings of words (with a star), that set toxic texts apart: LEAST_TEXTS, LEAST_RATIO and LEAST_LLR, in distinct sketches."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w.lower() for w in TOKEN.findall(text)]
                distinct = sorted(set(words) | {w[:PREFIX] + "*" for w in words if len(w) > PREFIX})
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(distinct), pa.int32()), pa.array([_sketch(words)] * len(distinct), pa.int64()), pa.array(distinct)], names=["label", "sketch", "word"])

    held = sample.mapInArrow(run, "label int, sketch long, word string").groupBy("word", "sketch").agg(F.max("label").alias("label"))
    held = held.groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).where(F.col("t") >= LEAST_TEXTS)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            sketches = [_sketch([w.lower() for w in TOKEN.findall(t)]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(sketches, pa.int64())], names=["label", "sketch"])

    totals = sample.mapInArrow(count, "label int, sketch long").groupBy("sketch").agg(F.max("label").alias("label")).agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    toxic, clean = (float(x or 0) for x in totals)
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    rate = (t + c) / (toxic + clean)
    part = lambda n, of: F.when(n > 0, n * F.log(n / of)).otherwise(0.0)
    ratio = (t / toxic) / ((c + 0.5) / (clean + 1))
    llr = 2 * (part(t, toxic * rate) + part(c, clean * rate) + part(toxic - t, toxic * (1 - rate)) + part(clean - c, clean * (1 - rate)))
    # A row for each word that stands in LEAST_TEXTS of at most `sample` texts: bounded by the sample.
    return sorted(r["word"] for r in held.where((ratio >= LEAST_RATIO) & (llr >= LEAST_LLR)).select("word").collect())


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Learn from at most ``sample`` distinct texts of each label (parameter), never from held-out rows.

    1. Words, and beginnings of words, that set toxic texts apart mark tokens: in toxic texts those are toxic, all others are not.
    2. The field's weights follow the gradient of the likelihood of these tags: every round the tasks run forward-backward
       over their part of the sample, and the driver adds up a vector of fixed length from each (resilient steps by sign).
    3. A logistic curve takes a document's two figures to the label, with texts weighted as frequent as they are.

    Without labelled texts of both kinds, or without such words, every score is the share of toxic texts (0 if there are none).
    """
    scratch = Scratch(docs.sparkSession)
    rows, totals = labelled_sample(docs, labels, sample, scratch, id_column=id_column, text_column=text_column)
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    words = marking_words(rows) if len(totals) == 2 else []
    if not words:
        scratch.keep_only()
        return Model(None, np.zeros(3), share)
    marking = frozenset(words)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in parts(text):
                    found = [w.lower() for w in TOKEN.findall(piece)]
                    if found:
                        starts = np.zeros(len(found), bool)
                        starts[0] = True
                        out.append((features(found, starts).astype("<i4").tobytes(), np.array([label and marks(w, marking) for w in found], np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["places", "tags"])

    encoded = scratch.table(rows.mapInArrow(encode, "places binary, tags binary"), "encoded")
    theta, step, before = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 0.1), np.zeros(DIMENSIONS)
    theta[BIAS] = -4.0
    for _ in range(rounds):
        slope = _slope(encoded, theta) - PENALTY * theta
        same = np.sign(slope) * np.sign(before)
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-4, 1.0)
        slope = np.where(same < 0, 0.0, slope)
        theta = theta + np.sign(slope) * step
        before = slope
    theta = theta.astype(np.float32).astype(np.float64)
    tagged = _tagged(rows.select("text", "label"), theta, ["label"], 0).select("label", "most", "expected").collect()  # at most 2 * sample rows
    tagged.sort()
    x = figures(np.array([r["most"] for r in tagged]), np.array([r["expected"] for r in tagged]))
    y = np.array([r["label"] for r in tagged], float)
    weight = np.where(y == 1, totals[1] / max(1, y.sum()), totals[0] / max(1, (1 - y).sum()))
    scratch.keep_only()
    return Model(theta, logistic(x, y, weight / weight.sum() * len(y)), share, tuple(words))


def _slope(encoded: DataFrame, theta: np.ndarray) -> np.ndarray:
    """The gradient over all chains: tasks add up theirs, the driver one vector of each task, in order."""
    small = theta.astype(np.float32)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        total, weights = np.zeros(DIMENSIONS), small.astype(np.float64)
        for batch in batches:
            places, tags, starts, size = [], [], [], 0
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for i, (p, t) in enumerate(rows):
                places.append(np.frombuffer(p, "<i4").reshape(4, -1))
                tags.append(np.frombuffer(t, np.uint8).astype(np.float64))
                starts.append(np.arange(len(t)) == 0)
                size += len(t)
                if size >= 200_000 or i + 1 == len(rows):
                    total += gradient(weights, np.concatenate(places, axis=1), np.concatenate(starts), np.concatenate(tags))
                    places, tags, starts, size = [], [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part", "slope"])

    got = sorted(encoded.mapInArrow(run, "part int, slope binary").collect(), key=lambda r: r["part"])
    return sum((np.frombuffer(r["slope"], "<f8") for r in got), np.zeros(DIMENSIONS))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w = w + move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
    return w


def _tagged(rows: DataFrame, theta: np.ndarray, keep: list[str], text_at: int) -> DataFrame:
    """``keep`` and most, expected, n_tokens, spans of each row."""
    from rosterspark.llm.tokens import slices

    small = theta.astype(np.float32)
    names = rows.columns
    picked = [names.index(c) for c in keep]
    span = "array<struct<start:long,end:long,p:double>>"
    schema = rows.select(*keep).withColumns({"most": F.lit(0.0), "expected": F.lit(0.0), "n_tokens": F.lit(0).cast("long"), "spans": F.lit(None).cast(span)}).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tagger = Tagger(small.astype(np.float64))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(text_at).to_pylist()]
            for a, b in slices(texts):
                found = tagger.tag(texts[a:b])
                spans = [[{"start": s, "end": e, "p": p} for s, e, p in f[3]] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, b - a) for i in picked], pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64()), pa.array(spans, kind)],
                    names=[*keep, "most", "expected", "n_tokens", "spans"],
                )

    return rows.mapInArrow(run, schema)


def tag(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), n_tokens and spans (start, end in code points, end exclusive; p) of every row, from whole texts.

    A map without a shuffle. Tokens are runs of word characters; those with a marginal of a half or more are offending, and
    neighbours are one span. Texts above a million characters are tagged in parts that are cut between words; all parts count.
    Null, empty and wordless texts: no tokens, no spans, the score of a text without any sign. Copies and repeated rows get
    equal values, null ids pass through. Other columns are ignored. Empty table: no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    theta = np.zeros(DIMENSIONS) if model.theta is None else model.theta
    out = _tagged(rows, theta, ["doc_id"], 1)
    if model.theta is None:
        return out.select("doc_id", F.lit(float(model.share)).alias("score"), "n_tokens", F.filter("spans", lambda s: F.lit(False)).alias("spans"))
    most = F.least(F.greatest("most", F.lit(1e-6)), F.lit(1 - 1e-6))
    a, b, c = (float(x) for x in model.curve)
    line = F.lit(a) + F.lit(b) * F.log(most / (1 - most)) + F.lit(c) * F.log(F.col("expected") + F.lit(1e-3))
    return out.select("doc_id", (1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))))).alias("score"), "n_tokens", "spans")


def score_documents(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labelled rows that aren't held out, then tag all."""
    return tag(docs, fit(docs, labels, sample=sample))
