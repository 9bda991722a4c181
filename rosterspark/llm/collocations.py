"""Phrase collocations: windows of the longest order are counted, and a rollup sums them to all shorter phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import Scratch, first_of
from rosterspark.llm.tally import CODE_BITS, MOST, Replies, ranges, tally

UNKNOWN = "und"
#: Words of a window, and of the runs whose counts bound it.
ORDER, BOUND = 4, 3
#: A phrase occurs at least so often; so many are reported for each language.
LEAST, TOP = 30, 2000
#: A cut's score is this times the count, over the counts of its two parts.
SCALE = 2_000_000
#: A phrase goes if a longer candidate around it has at least this share of its count (a percentage).
COVERED = 80
#: Words that a task holds at once, and bytes of a text that are split at once.
CHUNK, SLICE = 400_000, 2_000_000

#: What stands between pieces becomes this byte, which no UTF-8 text holds.
BREAK = b"\xff"
_TABLE = bytearray(range(256))
_TABLE[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = BREAK[0]
for _c in range(65, 91):
    _TABLE[_c] = _c + 32


def words(text: str | None) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """A text's words and breaks, part by part, each with the next words after it (as far as a window reaches)."""
    data = (text or "").encode().translate(bytes(_TABLE))
    now: list[bytes] = []
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        more = data[at:end].replace(BREAK, b" \xff ").split()
        at = end
        if len(now) and len(more) >= ORDER - 1:
            yield now, more[: ORDER - 1]
            now = more
        else:
            now += more
    if now:
        yield now, []


class Chunk:
    """Words of one language of one chunk, numbered from 1; 0 is a break. Windows start at ``own`` words only."""

    def __init__(self, language: str):
        self.language, self.tokens, self.borrowed = language, [], []

    def add(self, tokens: list[bytes], ahead: list[bytes]) -> None:
        self.tokens += tokens
        if ahead:
            self.borrowed.append((len(self.tokens), len(self.tokens) + len(ahead)))
            self.tokens += ahead
        self.tokens.append(BREAK)

    def close(self) -> None:
        import xxhash

        class Numbers(dict):
            def __missing__(self, word: bytes) -> int:
                n = self[word] = len(self)
                return n

        numbers = Numbers({BREAK: 0})
        n = len(self.tokens)
        ids = np.fromiter(map(numbers.__getitem__, self.tokens), np.int64, n)
        self.tokens = []
        self.words = list(numbers)
        own = ids > 0
        for a, b in self.borrowed:
            own[a:b] = False
        self.ids, self.own = np.concatenate([ids, np.zeros(ORDER, np.int64)]), own
        seed = xxhash.xxh3_64_intdigest(self.language.encode()) or 1
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)
        # For runs of 1 to BOUND words: their codes, how often they start at own words, and which one starts at each place (-1: none).
        self.codes, self.counts, self.places = [], [], []
        found, here = hashes, np.where(ids > 0, ids, -1)
        for order in range(1, BOUND + 1):
            if order > 1:
                after = self.ids[order - 1 : n + order - 1]
                whole = (here >= 0) & (after > 0)
                keys, inverse = np.unique((here << 32 | after)[whole], return_inverse=True)
                with np.errstate(over="ignore"):
                    found = (found[keys >> 32] ^ hashes[keys & 0xFFFFFFFF] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)) * np.uint64(0xC2B2AE3D27D4EB4F)
                found ^= found >> np.uint64(31)
                here = np.full(n, -1)
                here[whole] = inverse
            counted = own & (here >= 0)
            self.codes.append(found >> np.uint64(64 - CODE_BITS))
            self.counts.append(np.bincount(here[counted], minlength=len(found)))
            self.places.append(here)

    def windows(self, frequent: list[np.ndarray]):
        """Padded longest windows and their counts: (word numbers (ORDER, n), counts). Lead columns, cut before what is rare.

        ``frequent``: for runs of 1 to BOUND words, whether each is. A window ends where its next word makes a rare run: no phrase
        with that run in it can be a candidate, nor a part of one.
        """
        n = len(self.own)
        there = []
        for known, here in zip(frequent, self.places, strict=True):
            there.append(np.zeros(n + ORDER, bool))
            there[-1][:n] = np.append(known, False)[here]  # none: the last
        lead, going = [], np.ones(n, bool)
        for i in range(ORDER):
            for order in range(1, min(BOUND, i + 1) + 1):
                going = going & there[order - 1][i + 1 - order : n + i + 1 - order]
            lead.append(np.where(going, self.ids[i : n + i], 0))
        lead = [x[self.own] for x in lead]
        # Two columns at a time become one number, so that rows compare as a whole.
        code = lead[0]
        for x in lead[1:]:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64) << 32 | x
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        return np.stack([x[first] for x in lead]), counts


def chunks(batches: Iterator, most: int) -> Iterator[list[Chunk]]:
    """A task's rows (lang, text) in chunks of about ``most`` words, a Chunk for each language."""
    groups: dict[str, Chunk] = {}
    size = 0

    def closed():
        out = [groups[k] for k in sorted(groups)]
        groups.clear()
        for chunk in out:
            chunk.close()
        return out

    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for tokens, ahead in words(text):
                groups.setdefault(language, Chunk(language)).add(tokens, ahead)
                size += len(tokens)
                if size >= most:
                    yield closed()
                    size = 0
    if groups:
        yield closed()


def _codes(group: list[Chunk]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([x for c in group for x in c.codes])
    counts = np.concatenate([x for c in group for x in c.counts])
    distinct, inverse = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct)).astype(np.int64)


def count_windows(rows: DataFrame, least: int, scratch: Scratch, most: int = CHUNK) -> DataFrame:
    """lang, w1 to w4 (padded with ''), n: the longest windows that start at each word, counted by chunk.

    ``rows``: lang, text, straight from files. They are read twice: first every chunk asks for bounds, how often its words, pairs
    and triples occur in all (``tally``, 40-bit codes; a collision only counts too much), then windows are cut where a bound is
    below ``least``. So the rows that are shuffled are phrases that may matter, and their number grows with the input and no
    faster. Words that are too rare still count, as empty windows.
    """
    if least > MOST:
        raise ValueError(f"at most {MOST}")
    place = tally(rows, lambda batches: map(_codes, chunks(batches, most)), ranges(rows, bytes_each=2), scratch)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        replies = Replies(place)
        for number, group in enumerate(chunks(batches, most)):
            codes, _ = _codes(group)
            frequent = replies.of(number, len(codes)) >= least
            for chunk in group:
                found, counts = chunk.windows([frequent[np.searchsorted(codes, c)] for c in chunk.codes])
                spelled = pa.array(["", *[w.decode() for w in chunk.words[1:]]], pa.string())
                for a in range(0, len(counts), 20_000):
                    columns = [spelled.take(pa.array(x[a : a + 20_000])) for x in found]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk.language] * len(columns[0]), pa.string()), *columns, pa.array(counts[a : a + 20_000], pa.int64())], names=["lang", *_NAMES, "n"])

    return rows.mapInArrow(run, f"lang string, {', '.join(f'{c} string' for c in _NAMES)}, n long")


_NAMES = [f"w{i}" for i in range(1, ORDER + 1)]


def rolled_up(windows: DataFrame) -> DataFrame:
    """lang, words (array), f: every prefix of a window with the sum over all windows that begin so; no words: all of a language.

    One rollup, from the longest order down. Where a prefix ends in padding, a shorter one says the same.
    """
    sums = windows.rollup("lang", *_NAMES).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    kept = F.lit(False)
    for i in range(ORDER + 1):  # i columns stay, ORDER - i are summed over
        kept |= (F.col("g") == (1 << (ORDER - i)) - 1) & ((F.col(_NAMES[i - 1]) != "") if i else F.lit(True))
    return sums.where(kept).select("lang", F.filter(F.array(*_NAMES), lambda w: w.isNotNull()).alias("words"), "f")


def _wide(value: str) -> Column:
    return F.col(value).cast("decimal(20,0)")


def phrases(docs: DataFrame, *, least: int = LEAST, top: int | None = TOP, text_column: str = "text", language_column: str = "lang", stable: bool = False) -> DataFrame:
    """The ``top`` phrases of two to four words of each language: lang, rank (from 1), phrase, a, l, r, n, score. None: all.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words at spaces and tabs. n counts all words of the language, a
    the phrase's occurrences, l and r those of its two parts at the cut with the lowest score. The score is floor(2000000 a / (l + r)),
    exact; of equal cuts the first counts. A phrase goes if a longer candidate that holds it has 80 % or more of its count.
    Order: score, a (both falling), then phrase in byte order.

    Null language: ``und``; null, empty and wordless texts add nothing. Rows count as often as they occur, whatever their
    ids. Words of any length stay whole. Other columns are ignored. Empty table: no rows. ``least`` is at most 255.

    ``stable``: the rows come straight from files, so each reading deals them into the same partitions; otherwise they are written first.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(language_column).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_column).cast("string").alias("text"))
    if not stable:
        rows = scratch.table(rows, "documents")
    sums = rolled_up(count_windows(rows, least, scratch))
    frequent = scratch.table(sums.where((F.col("f") >= least) | (F.size("words") == 0)), "frequent")
    totals = frequent.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    spell = lambda c: F.array_join(c, " ")
    named = frequent.where(F.size("words") > 0).select("lang", spell("words").alias("phrase"), "words", F.col("f").alias("a"))
    candidates = named.where(F.size("words") > 1)
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", spell(F.expr("slice(words, 1, k)")).alias("first"), spell(F.expr("slice(words, k + 1, size(words) - k)")).alias("rest"))
    part = lambda name, count: named.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    scored = scored.withColumns({"wide_a": _wide("a") * SCALE, "parts": _wide("l") + _wide("r")}).withColumn("score", F.expr("wide_a div parts"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Each phrase inside a longer candidate, with the largest count of such a one.
    inside = candidates.where(F.size("words") > 2).select("lang", "a", "words", F.explode(F.expr("sequence(2, size(words) - 1)")).alias("long"))
    inside = inside.select("lang", "a", F.explode(F.expr("transform(sequence(1, size(words) - long + 1), i -> array_join(slice(words, i, long), ' '))")).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * COVERED))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is None:
        ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    else:
        ranked = first_of(kept, ["lang"], order, top, "phrase", "rank")
    ranked = ranked.withColumn("rank", F.col("rank").cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
