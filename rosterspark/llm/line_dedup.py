"""Removal of boilerplate lines: lines that occur on many distinct sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import Scratch, free_name

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 10
#: Sketches have 2 to the power of this many registers; their standard error is 1.04 / sqrt of that, 1.6 %.
REGISTERS_LOG2 = 12


def _key(line: Column) -> list[Column]:
    """A line's identity: its text without white space at both ends, as 96 bits of two hashes."""
    bare = F.btrim(line, F.lit(" \t\r\x0b\x0c"))
    return [F.xxhash64(bare).alias("h1"), F.hash(bare).alias("h2")]


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, *, site_column: str = "source", text_column: str = "text") -> DataFrame:
    """Hashes ``h1, h2`` of lines that occur on ``min_sites`` or more distinct sites.

    A HyperLogLog sketch of sites per line hash, merged by aggregation, so a line with very many occurrences arrives as
    one small sketch per task. Estimates within five standard errors (and one) of the threshold are near it: those
    lines, and only those, get an exact distinct count.
    """
    lines = docs.select(F.col(site_column).cast("string").alias("site"), F.explode(F.split(F.col(text_column), "\n")).alias("line"))
    lines = lines.where(F.col("site").isNotNull() & (F.btrim("line", F.lit(" \t\r\x0b\x0c")) != "")).select(*_key(F.col("line")), "site")
    slack = 5 * 1.04 / 2 ** (REGISTERS_LOG2 / 2)
    sketched = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", REGISTERS_LOG2).alias("sketch"))
    sketched = sketched.where(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    sketched = sketched.where(F.col("sites") >= min_sites * (1 - slack) - 1)
    near = F.col("sites") <= min_sites * (1 + slack) + 1
    exact = (
        lines.join(sketched.where(near).select("h1", "h2"), ["h1", "h2"], "left_semi")
        .distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    )
    return sketched.where(~near).select("h1", "h2").unionByName(exact.select("h1", "h2"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, *, id_column: str = "doc_id", site_column: str = "source", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, with boilerplate lines taken out of the text and new columns ``n_lines``, ``n_removed``.

    A boilerplate line goes from every document, its line end with it; other lines stay as they are, in order. Lines are
    compared without white space at both ends; blank lines stay. Documents without a site count for no line, but lose
    boilerplate too. A document that loses all lines keeps its row with an empty text; null text stays null (0 lines).

    Lines that go are found by a join on the hash (occurrences of a hot line are split by adaptive execution) and
    gathered as a set of hashes per document id, which is bounded by one document; the text is shuffled once. Rows that
    share an id, or have none, are right too, as a line goes wherever it stands. Other columns pass through; those named
    n_lines or n_removed are replaced. Empty table: no rows.
    """
    key, gone = free_name(docs, "__key"), free_name(docs, "__gone")
    bad = Scratch(docs.sparkSession).table(boilerplate_lines(docs, min_sites, site_column=site_column, text_column=text_column), "boilerplate")
    places = docs.select(F.col(id_column).alias("k"), F.explode(F.split(F.col(text_column), "\n")).alias("line")).select("k", *_key(F.col("line")))
    hits = places.join(bad, ["h1", "h2"], "left_semi").groupBy("k").agg(F.collect_set(F.struct("h1", "h2")).alias(gone)).withColumnRenamed("k", key)
    kept = docs.drop("n_lines", "n_removed")
    kept = kept.join(hits, F.col(id_column).eqNullSafe(F.col(key)), "left").drop(key)
    lines = F.split(F.col(text_column), "\n")
    stay = F.filter(lines, lambda line: ~F.array_contains(F.col(gone), F.struct(*_key(line))))
    cleaned = F.when(F.col(gone).isNull(), F.col(text_column)).otherwise(F.array_join(stay, "\n"))
    before = F.coalesce(F.size(lines), F.lit(0))
    kept = kept.withColumn("n_lines", F.when(F.col(text_column).isNull(), 0).otherwise(before))
    kept = kept.withColumn("n_removed", F.when(F.col(text_column).isNull() | F.col(gone).isNull(), 0).otherwise(F.size(lines) - F.size(stay)))
    return kept.withColumn(text_column, cleaned).drop(gone)
