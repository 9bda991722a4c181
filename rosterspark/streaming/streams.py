"""Structured Streaming forms of the logs, limits, caches and ingestion.

Append and daily-sum streams are native streaming queries; "the first k per key and day" is keyed state with a timer.
Lookups, refills and keyed upserts run per micro-batch with ``foreachBatch`` on the batch operators; a repeated batch
replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.operators.limits import REPORTS_PER_DAY, search_log_rows, ttl_lookup, utc_day
from rosterspark.operators.records import latest_per_key
from rosterspark.operators.selection import first_k_per_group
from rosterspark.sources.writers import overwrite_partitions, read_if_exists, touched_only, upsert_shards
from rosterspark.session import drop_staged, staged


def search_log_stream(raw: DataFrame, path: str, checkpoint: str):
    """Validated search events appended to a table."""
    return search_log_rows(raw).writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    ).outputMode("append")


def usage_ledger_stream(calls: DataFrame, at: str = "ts", phase: str = "phase", n: str = "n", late: str = "1 day") -> DataFrame:
    """Running sums per UTC day and phase (use update mode); days older than the watermark leave the state."""
    sums = calls.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w"), F.col(phase).alias("phase")).agg(F.sum(n).alias("n"))
    return sums.select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), "phase", "n")


def ttl_lookup_stream(requests: DataFrame, cache: DataFrame, on: list[str], now, **ttl) -> DataFrame:
    """Streaming requests against a cache that doesn't change while the stream runs (stream-static left join)."""
    return ttl_lookup(requests, cache, on, now, **ttl)


def ttl_lookup_batch(
    cache: str, path: str, on: list[str], at: str = "ts", run: str = "first", buckets: int | None = None, **ttl
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: requests with the state of their cache entry, as the cache at ``cache`` is when the batch runs.

    The cache is read anew for every batch, so entries that ``cache_refill_batch`` wrote in between are seen, and an entry's age
    is taken at the request's own time ``at``: it passes from 'cache' to 'absent' while the stream runs. Answers go to
    ``path``, by run and batch, so a repeated batch replaces its own. No cache yet: all 'absent'. ``buckets`` is that of the
    refill (for one key column); only folders that the batch's keys fall in are read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = staged(batch)
        stored = read_if_exists(spark, cache)
        if stored is None:
            answers = rows.withColumn("source", F.lit("absent"))
        else:
            entries = stored.select(*on, "ok", "checked_at", *(["bucket"] if buckets else []))
            if buckets:
                keyed = rows.select(key_bucket(on[0], buckets).alias("bucket"))
                entries = touched_only(entries, keyed, "bucket").drop("bucket")
            answers = ttl_lookup(rows, entries, on, F.col(at), **ttl).select(*rows.columns, "source")
        tagged = answers.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")})
        overwrite_partitions(tagged, path, ["run", "batch_id"], on)
        drop_staged(rows)

    return write


def _first_rows(columns: list[str], group: list[str], order: list[str], per_day: int):
    """Of each batch the first ``per_day`` rows of a group: what one task sends on for a key is bounded."""
    def cut(batches):
        for rows in batches:
            yield rows.sort_values(order, kind="stable").groupby(group, sort=False, dropna=False).head(per_day)[columns]

    return cut


def rate_limit_stream(
    events: DataFrame, key: list[str], at: str = "ts", seq: str = "seq", per_day: int = REPORTS_PER_DAY, late: str = "1 hour", buckets: int = 128
) -> DataFrame:
    """Rows accepted under ``per_day`` per key and UTC day, as a stream (append mode) that keeps one counter a key and day.

    The counters of a day lie in ``buckets`` rows of state, by a hash of the key, so that Python is called for a bucket of keys and
    not for each; a call holds the first ``per_day`` rows of its keys. A timer at the end of the day, when the watermark passes,
    removes them, so state holds the keys of the days that are still open. Rows of a micro-batch count in order of time and ``seq``;
    earlier micro-batches come first. Rows later than ``late`` after their day's end find no counter any more and are refused.

    Every task first cuts its rows to ``per_day`` a key, so a key with a third of all rows sends few to its counter. Column types
    must be ones that pandas carries; nothing outside the checkpoint is written or read again. A checkpoint goes with its ``buckets``.
    """
    names = events.columns
    order = [at, seq]
    time = F.col(at).cast("timestamp")
    day = F.date_from_unix_date(F.floor(F.unix_micros(time) / 86_400_000_000).cast("int")).cast("string")
    rows = events.withColumns({at: time, "day": day})
    few = rows.mapInPandas(_first_rows(rows.columns, ["day", *key], order, per_day), rows.schema).withWatermark(at, late)
    few = few.withColumns({"_key": F.to_json(F.struct(*key)), "_bucket": F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")})

    def count(of, batches, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else {}
        kept, waiting = None, []

        def first(some):
            return pd.concat(some).sort_values(order, kind="stable").groupby("_key", sort=False).head(per_day)

        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) > 10_000 + (0 if kept is None else len(kept)):
                kept, waiting = first([*([] if kept is None else [kept]), *waiting]), []
        found = first([*([] if kept is None else [kept]), *waiting])
        nth = found.groupby("_key", sort=False).cumcount() + found["_key"].map(used).fillna(0)
        found = found[nth < per_day]
        for k, n in found["_key"].value_counts().items():
            used[k] = used.get(k, 0) + int(n)
        state.update((used,))
        ends = pd.Timestamp(of[0], tz="UTC") + pd.Timedelta(days=1)
        state.setTimeoutTimestamp(max(int(ends.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield found[names]

    out = ", ".join(f"`{f.name}` {'timestamp' if f.name == at else f.dataType.simpleString()}" for f in events.schema)
    return few.groupBy("day", "_bucket").applyInPandasWithState(count, out, "used map<string,bigint>", "append", "EventTimeTimeout")


def rate_limit_batch(path: str, key: list[str], at: str = "ts", seq: str = "seq", per_day: int = REPORTS_PER_DAY, run: str = "first") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: accepted rows go to ``path``, at most ``per_day`` per day and key, whatever order days come in.

    ``rate_limit_stream`` does the same for streams in order of time, with state in place of a table.

    A batch first keeps its own first ``per_day`` rows per key (cut inside each task), then subtracts what
    earlier batches accepted on the same days. Batch ids start anew when a stream loses its checkpoint: give it
    another ``run`` then, so that rows of the former run stay and still count. A batch is evaluated once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = staged(batch.withColumn("day", utc_day(at)))
        own = first_k_per_group(rows, ["day", *key], [F.col(at).asc(), F.col(seq).asc()], per_day, "_rank")
        stored = read_if_exists(batch.sparkSession, path)
        if stored is not None:
            before = (F.col("run") != run) | (F.col("batch_id") < batch_id)
            earlier = stored.filter(before).withColumn("day", F.col("day").cast("string"))
            used = (
                touched_only(earlier, rows, "day").groupBy("day", *key).agg(F.count(F.lit(1)).alias("_used"))
            )
            own = own.join(used, ["day", *key], "left")
        else:
            own = own.withColumn("_used", F.lit(0).cast("bigint"))
        accepted = own.filter(F.coalesce("_used", F.lit(0)) + F.col("_rank") <= per_day).drop("_used", "_rank")
        accepted = staged(accepted)
        overwrite_partitions(accepted.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")}), path, ["day", "run", "batch_id"], [at, seq])
        drop_staged(rows)
        drop_staged(accepted)

    return write


def key_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def cache_refill_batch(path: str, key: str = "key", seq: str = "seq", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: the newest outcome per key replaces the stored cache entry.

    The table is bucketed by key hash into partitions; only buckets with new keys are rewritten.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = staged(latest_per_key(batch, key, seq).drop(seq).withColumn("bucket", key_bucket(key, buckets)))
        stored = read_if_exists(batch.sparkSession, path)
        entries = fresh
        if stored is not None:
            kept = touched_only(stored, fresh, "bucket").join(fresh.select(key), key, "left_anti")
            entries = staged(kept.select(*fresh.columns).unionByName(fresh))
        overwrite_partitions(entries, path, ["bucket"], [key])
        for table in {id(t): t for t in (fresh, entries)}.values():
            drop_staged(table)

    return write


def ingest_officials_batch(path: str, seq: str = "seq") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: micro-batch upsert into the officials table; repeats change nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_shards(batch, path, seq)

    return write
