"""Language identification by rank-order n-gram profiles and their out-of-place distance (Cavnar and Trenkle)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import first_of

UNKNOWN = "und"
#: N-grams in a profile.
TOP = 300
#: Documents learned from in each language at most, chosen by a hash of the text. This bounds what fitting collects.
SAMPLE = 2000
#: Characters that are counted at once; longer texts are counted in overlapping pieces.
CHUNK = 1_000_000
#: Scores below this mean that a text fits no profile.
LEAST_SCORE = 0.05


def ngram_counts(text: str, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of 1 to 3 characters, as sorted integers, and how often each occurs.

    Letters are lower-cased, whatever stands between words counts as one space, and n-grams don't reach across it.
    """
    out_codes, out_counts = [], []
    for at in range(0, max(1, len(text)), chunk):
        piece = text[max(0, at - 2) : at + chunk]
        fresh = at - max(0, at - 2)
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        low = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        points = low if len(low) == len(points) else points
        kinds, inverse = np.unique(points, return_inverse=True)
        letters = np.array([unicodedata.category(chr(p))[0] == "L" for p in kinds.tolist()], bool)[inverse] if len(kinds) else np.zeros(0, bool)
        points = np.where(letters, points, 32)
        edge = at <= 2
        # One space in front of the text and after it; runs of spaces shrink to one.
        points = np.concatenate([[32] * edge, points, [32] * (at + chunk >= len(text))]).astype(np.int64)
        new = np.concatenate([[at == 0] * edge, np.arange(len(letters)) >= fresh, [True] * (at + chunk >= len(text))]).astype(bool)
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        points, new = points[keep], new[keep]
        space = points == 32
        one = points[~space & new]
        two = (points[:-1] << 21 | points[1:])[new[1:] & ~(space[:-1] & space[1:])] if len(points) > 1 else one[:0]
        three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[new[2:] & ~space[1:-1]] if len(points) > 2 else one[:0]
        codes, counts = np.unique(np.concatenate([one, two, three]), return_counts=True)
        out_codes.append(codes)
        out_counts.append(counts)
    if len(out_codes) == 1:
        return out_codes[0], out_counts[0]
    codes, inverse = np.unique(np.concatenate(out_codes), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate(out_counts)).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first; ties by n-gram."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))][:top]


def _learnable(docs: DataFrame, sample: int, text_column: str, language_column: str) -> DataFrame:
    """Distinct texts with their language, the ``sample`` with the smallest hashes of each."""
    rows = docs.select(F.col(language_column).cast("string").alias("language"), F.col(text_column).alias("text")).where(F.col("language").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    chosen = first_of(rows.select("language", "h").distinct(), ["language"], [F.asc("h")], sample, "h").select("language", "h")
    # At most `sample` hashes a language; with them at hand in every task only chosen texts leave the scan.
    return rows.join(F.broadcast(chosen), ["language", "h"], "left_semi").dropDuplicates(["language", "h"]).select("language", "text")


def learn_profiles(docs: DataFrame, *, text_column: str = "text", language_column: str = "lang", top: int = TOP, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Profiles by language: its ``top`` most frequent n-grams, in order.

    Learns from at most ``sample`` distinct texts of a language, those with the smallest hashes, each read whole; n-grams are
    counted in the tasks and summed by Spark, and the driver gets ``top`` n-grams a language. Rows without language or
    without a letter teach nothing. No such row: no profiles.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            gathered: dict[str, list] = {}
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gathered.setdefault(language, []).append(ngram_counts(text))
            for language, pairs in gathered.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in pairs]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([n for _, n in pairs])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes)), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["language", "code", "n"])

    counted = _learnable(docs, sample, text_column, language_column).mapInArrow(run, "language string, code long, n long")
    summed = counted.groupBy("language", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("language").orderBy(F.desc("n"), "code")
    best = summed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top)
    profiles: dict[str, list] = {}
    for row in best.orderBy("language", "nth").collect():
        profiles.setdefault(row["language"], []).append(row["code"])
    return {k: np.array(v, np.int64) for k, v in profiles.items()}


class Profiles:
    """Out-of-place distances of a text to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.languages, self.top = sorted(profiles), top
        self.codes = np.unique(np.concatenate([profiles[k] for k in self.languages])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.languages), len(self.codes)), -1, np.int64)
        for i, k in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.codes, profiles[k])] = np.arange(len(profiles[k]))

    def predict(self, text: str) -> tuple[str, float]:
        """(language, score). An n-gram that a profile lacks is ``top`` places out; the score is 1 minus the share of the worst distance."""
        best = ranked(*ngram_counts(text), self.top)
        if not len(best) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, best)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == best
        ranks = np.where(known, self.ranks[:, at], -1)
        out = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(best)))).sum(axis=1)
        first = int(np.argmin(out))  # ties: the first in order of name
        return self.languages[first], float(1 - out[first] / (self.top * len(best)))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], *, text_column: str = "text", top: int = TOP) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` (0 to 1), from whole texts, without a shuffle.

    ``und`` with score 0 for texts that are null, or have no letter, and for all if there are no profiles. Columns
    named lang_pred or score are replaced. Copies and repeated rows get equal values. Empty table: no rows.
    """
    rows = docs.drop("lang_pred", "score")
    fields = [*rows.columns, "lang_pred", "score"]
    schema = rows.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    position = rows.columns.index(text_column)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Profiles(profiles, top)
        for batch in batches:
            found = [model.predict(t) if t else (UNKNOWN, 0.0) for t in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=fields)

    return rows.mapInArrow(run, schema)


def held_out(id_column: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2. Null ids are learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """Learn from the documents that aren't held out, then predict all rows."""
    profiles = learn_profiles(docs.where(~held_out(id_column)), text_column=text_column, language_column=language_column)
    return predict_language(docs, profiles, text_column=text_column)


def accepted(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents in a known language; goes: ``und``, and scores below ``least``."""
    return docs.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
