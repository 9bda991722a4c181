"""Sinks: partition-wise upserts and append tables.

Tables are laid out by a partition column and overwritten partition by partition: only partitions with new rows
are read and rewritten. Rows are rebalanced before the write, so a partition with a third of all rows is split
over as many tasks and files as its size needs, and small ones are packed together.
"""

from __future__ import annotations

import hashlib
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rosterspark.functions.text import filled
from rosterspark.operators.records import coverage_stats, fold_incoming, upsert_folded
from rosterspark.schema import OFFICIAL
from rosterspark.session import drop_staged, staged


def shard_state() -> Column:
    return F.upper(F.coalesce(filled(F.col("jurisdiction")["state"]), F.lit("US")))


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}:
            return None
        raise


def touched_only(stored: DataFrame, fresh: DataFrame, partition: str) -> DataFrame:
    """Rows of the stored partitions that ``fresh`` touches: a semi join, from which Spark prunes folders as it runs."""
    return stored.join(fresh.select(partition).distinct(), partition, "left_semi")


def overwrite_partitions(df: DataFrame, path: str, partition: list[str], sort: list[str]) -> None:
    laid_out = df.hint("rebalance", *[F.col(c) for c in partition]).sortWithinPartitions(*partition, *sort)
    laid_out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


#: Buckets of each state's officials, by id. A table keeps the number that it was made with.
SHARD_BUCKETS = 16


def shard_table(spark: SparkSession, path: str, buckets: int = SHARD_BUCKETS) -> str:
    """The session's name for the officials table at ``path``: a folder for each state, files by a hash of the id.

    The files alone are the table; the name only tells Spark how they are laid out, so a new session registers it again. The
    number of buckets stands in the name of an empty folder beside the data, and the first writer decides it. That writes replace
    only the states that they touch is an option of the table: ``insertInto`` takes none of the writer's, and the session's may differ.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(conf)
    marks = system.globStatus(jvm.org.apache.hadoop.fs.Path(path, "_buckets-*"))
    if marks:
        buckets = int(marks[0].getPath().getName().partition("-")[2])
    else:
        system.mkdirs(jvm.org.apache.hadoop.fs.Path(path, f"_buckets-{buckets}"))
    # By the whole address, so that one table has one name.
    address = system.makeQualified(folder).toString()
    name = f"officials_{hashlib.sha256(address.encode()).hexdigest()[:20]}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in OFFICIAL)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}, state STRING) USING parquet OPTIONS (path '{address}', partitionOverwriteMode 'dynamic') PARTITIONED BY (state) CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return name


def merged_shards(table: str, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """The touched states' officials after the merge of ``rows`` (with ``_state``). Stored rows stay where their buckets are."""
    spark = rows.sparkSession
    stored = spark.table(table)
    touched = rows.select(F.col("_state").alias("state")).distinct()  # no more than the table has folders
    stored = stored.join(F.broadcast(touched), "state", "left_semi").select(*OFFICIAL.fieldNames())
    return upsert_folded(stored, fold_incoming(rows, seq)).withColumn("state", shard_state())


def upsert_shards(incoming: DataFrame, path: str, seq: str = "seq", buckets: int = SHARD_BUCKETS) -> DataFrame:
    """Merge new officials into the table at ``path``; returns the touched states' rows as they are now.

    Incoming rows are evaluated once, into the shared folder, and folded by id. The table is bucketed by id inside its states, so
    they meet the stored rows in one join that moves the incoming side only, and every task rewrites its own buckets of
    the touched states. Spark writes them beside the old ones and swaps folders when all are done; if the driver is lost
    while it swaps, run the same upsert again: merging the same rows twice changes nothing. Rows in a file are in binary id order.
    """
    spark = incoming.sparkSession
    rows = staged(incoming.withColumn("_state", shard_state()))
    table = shard_table(spark, path, buckets)
    merged = merged_shards(table, rows, seq)
    merged.select(*OFFICIAL.fieldNames(), "state").write.mode("overwrite").insertInto(table)
    touched = [r["_state"] for r in rows.select("_state").distinct().collect()]  # folders of the table
    drop_staged(rows)
    return spark.read.parquet(path).where(F.col("state").isin(touched))


def upsert_coverage(previous: DataFrame, touched: DataFrame) -> DataFrame:
    """Coverage index with this run's states replaced."""
    return previous.join(touched.select("state"), "state", "left_anti").unionByName(touched)


def write_coverage(shards: DataFrame, path: str, now: str) -> DataFrame:
    """Coverage rows of the touched states, each replacing its own partition of the index."""
    rows = coverage_stats(shards.select("state", F.col("jurisdiction.city").alias("city")), "state", "city")
    rows = rows.withColumn("updated", F.lit(now))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state").parquet(path)
    return rows


def write_shards_json(shards: DataFrame, path: str) -> None:
    """Officials as JSON lines per state, for consumers without parquet."""
    shards.hint("rebalance", F.col("state")).sortWithinPartitions("state", "id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("state").json(path)


def write_universe(universe: DataFrame, path: str) -> None:
    overwrite_partitions(universe.select("state", "level", "name", "population"), path, ["state"], ["level", "name"])


def append_rows(df: DataFrame, path: str, partition: list[str] | None = None, run: str | None = None) -> None:
    """Append table for problems, probe reports, search events and triaged reports.

    With a ``run`` id the rows go to that run's own folders, which a repeated write replaces: a job that is tried again
    leaves its rows once. Without one, every write adds to the table.
    """
    folders = list(partition or [])
    if run is None:
        writer = df.write.mode("append")
        (writer.partitionBy(*folders) if folders else writer).parquet(path)
    else:
        # The run comes first, so that all of an earlier try goes, also on days that the new one doesn't have.
        place = f"{path}/run={quote(run, safe='')}"
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
        (writer.partitionBy(*folders) if folders else writer).parquet(place)


def write_problems(problems: DataFrame, path: str, now: str, run: str | None = None) -> None:
    append_rows(problems.withColumn("generated_at", F.lit(now)), path, run=run)


def write_probe_report(report: DataFrame, path: str, now: str, run: str | None = None) -> None:
    append_rows(report.withColumn("generated_at", F.lit(now)), path, run=run)


def append_log(entries: DataFrame, path: str, run: str | None = None) -> None:
    append_rows(entries.withColumn("day", F.left("t", F.lit(10))), path, ["day"], run)


def append_reports(reports: DataFrame, path: str, run: str | None = None) -> None:
    append_rows(reports, path, run=run)


def run_summary(shards: DataFrame, attempted: DataFrame, problems: DataFrame) -> DataFrame:
    """Counts of a run as rows (measure, state, value): officials and cities per state, jurisdictions
    attempted and pages failed (state null)."""
    states = coverage_stats(shards.select("state", F.col("jurisdiction.city").alias("city")), "state", "city")
    per_state = states.select("state", F.inline(F.array(
        F.struct(F.lit("officials").alias("measure"), F.col("count").alias("value")),
        F.struct(F.lit("cities").alias("measure"), F.size("cities").cast("bigint").alias("value")),
    )))

    def total(df, measure):
        return df.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit(None).cast("string").alias("state"), F.lit(measure).alias("measure"), "value"
        )

    return per_state.unionByName(total(attempted, "jurisdictions_attempted")).unionByName(total(problems, "pages_failed"))


class Observed:
    """Measures of a run, taken from its frames while they are written.

    ``watch`` gives the frame to write in place of the one it gets; after the writes, ``rows`` has what Spark counted on the
    way, so no table is read again. The rows are those that ``shares`` counts in a pass of its own.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.seen = spark, []

    def watch(self, df: DataFrame, **conditions: Column) -> DataFrame:
        seen = Observation()
        self.seen.append((seen, list(conditions)))
        return df.observe(seen, F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])

    def rows(self) -> DataFrame:
        """measure, value, total; waits for writes that haven't ended."""
        found = [(k, seen.get[k], seen.get["total"]) for seen, names in self.seen for k in names]
        return self.spark.createDataFrame(found, "measure string, value bigint, total bigint")


def shares(df: DataFrame, **conditions: Column) -> DataFrame:
    """A row per condition: measure, value (rows that meet it), total (all rows). One aggregation."""
    counted = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in conditions])
    return counted.select(F.inline(rows), "total")


#: Conditions of the measures of each run, for ``shares`` or ``Observed.watch``.
def finding_measures() -> dict[str, Column]:
    return {"findings": F.lit(True), "unreachable": F.col("issue").isNotNull()}


def federal_measures() -> dict[str, Column]:
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return {"with_district_offices": some("district_offices"), "with_dc_office": F.col("dc_office").isNotNull(), "with_committees": some("committees")}


def seed_measures() -> dict[str, Column]:
    return {"seeds_ok": F.col("status") == "OK"}


def qa_summary(checked: DataFrame, findings: DataFrame, pages: DataFrame) -> DataFrame:
    """Outcome of a re-check: pages checked and pages that disagree, each of how many."""
    every = shares(pages, pages_known=F.lit(True))
    seen = shares(checked, pages_checked=F.lit(True))
    return every.unionByName(seen).unionByName(shares(findings, **finding_measures()))


def links_summary(staged_officials: DataFrame, review: DataFrame) -> DataFrame:
    """Outcome of reported links: officials taken in, links left for review."""
    return shares(staged_officials, officials_staged=F.lit(True)).unionByName(shares(review, links_for_review=F.lit(True)))


def federal_coverage(details: DataFrame) -> DataFrame:
    """Members with district offices, with a capital office and with committees, of all."""
    return shares(details, **federal_measures())


def seeds_ok(report: DataFrame) -> DataFrame:
    """Seed pages whose probe is OK, of all."""
    return shares(report, **seed_measures())
