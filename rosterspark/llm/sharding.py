"""Contiguous shards of near-equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterspark.llm.common import Scratch, text_or_empty

SHARDS = 24
#: Bytes that a row counts besides its text.
ROW_BYTES = 8


def assign_shards(docs: DataFrame, shards: int = SHARDS, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Deal the rows, in order of their id, into ``shards`` runs of near-equal bytes.

    One row per document: doc_id, size (UTF-8 bytes of the text plus 8), text_crc32 (unsigned), shard, slot (from 0 in
    the shard, without gaps).

    Only ids, sizes and checksums leave the scan. They are range-partitioned by id (ties by size, checksum and row
    place, so that one id with very many rows is split too) and written once; each partition's totals give the sums
    before it, a window inside the partition adds its own. A row goes to the shard that the middle of its bytes falls
    in, so shards differ from an equal share by less than the row at each end. The driver sees nothing; the totals are a
    row per partition, the shards' starts a row per shard.

    Null ids come first. Null or empty text: size 8, checksum 0. Rows that are equal in id, size and checksum are
    interchangeable. Fewer rows than shards leave shards empty. Empty table: no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = text_or_empty(text_column)
    narrow = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("place"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "size", "text_crc32", "place"]
    rows = scratch.table(narrow.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sizes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_bytes"))
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("base"), F.sum("part_bytes").over(everything).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        rows.withColumn("through", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(F.broadcast(bases), "part")
        .withColumn("middle", 2 * (F.col("base") + F.col("through")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (middle * {shards}L) div (2 * total)) as int)"))
        .select(*order, "part", "shard")
    )
    placed = scratch.table(placed, "placed")
    scratch.drop(rows)
    # Where a shard's rows begin: in its own partition's run, plus its rows in the partitions before.
    runs = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    slot = F.row_number().over(Window.partitionBy("part", "shard").orderBy(*order))
    return placed.withColumn("here", slot).join(F.broadcast(runs), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("here") + F.col("earlier") - 1).cast("long").alias("slot"))
