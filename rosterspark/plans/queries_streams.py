"""Queries that run the streaming forms over the event table until all of it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterspark.plans.catalog import Tables, query
from rosterspark.plans.queries_jobs import scratch
from rosterspark.plans.queries_records import _official
from rosterspark.streaming import streams


#: Deliveries of the event table; the stream runs after each, from where it stopped.
DELIVERIES = 4


def _delivery(number, first: int, last: int):
    """The delivery, from 0, that a number between ``first`` and ``last`` falls in."""
    return F.floor((number - first) * DELIVERIES / (last - first + 1))


def _stream(t: Tables, folder: str, *starts, by=None) -> None:
    """Deliver the events in ``DELIVERIES`` parts, in order of ``by`` (a number; the event's own unless given).

    Each of ``starts`` makes a writer from the streaming frame. After every delivery the writers run one after the other, each
    started again from its own checkpoint, so what a stream remembers must have been kept there.
    """
    by = F.col("event_id") if by is None else by
    first, last = t.events.agg(F.min(by), F.max(by)).first()
    events = t.events.withColumn("_part", _delivery(by, first, last))
    for number in range(DELIVERIES):
        events.filter(F.col("_part") == number).drop("_part").write.mode("append").parquet(folder + "/in")
        for i, start in enumerate(starts):
            writer = start(t.spark.readStream.schema(t.events.schema).parquet(folder + "/in"))
            writer.option("checkpointLocation", f"{folder}/progress{i}").trigger(availableNow=True).start().awaitTermination()


@query(
    "stream_rate_limit",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 2",
)
def stream_rate_limit(t):
    """Delivered in order of time; days are cut by deliveries, so counters must outlive a restart."""
    folder = scratch(t)
    accepted = lambda events: streams.rate_limit_stream(events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], seq="event_id", per_day=2)
    _stream(t, folder, lambda events: accepted(events).writeStream.format("parquet").option("path", folder + "/accepted").outputMode("append"), by=F.unix_seconds(F.col("ts").cast("timestamp")))
    return t.spark.read.parquet(folder + "/accepted").select("event_id")


@query(
    "stream_usage",
    "SELECT strftime(ts, '%Y-%m-%d') AS date, event_type AS phase, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_usage(t):
    """Daily sums per phase; each batch writes the running sums, the newest batch counts."""
    folder = scratch(t)
    calls = lambda events: events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("phase"), F.lit(1).cast("bigint").alias("n"))

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(folder + "/sums")

    _stream(t, folder, lambda events: streams.usage_ledger_stream(calls(events), late="400 days").writeStream.outputMode("update").foreachBatch(keep))
    sums = t.spark.read.parquet(folder + "/sums")
    return sums.groupBy("date", "phase").agg(F.max_by("n", "batch").alias("n"))


@query(
    "stream_cache",
    "SELECT user_id, arg_max(event_type <> 'error', event_id) AS ok, max(event_id) AS last_event FROM events GROUP BY 1",
)
def stream_cache(t):
    folder = scratch(t)
    write = streams.cache_refill_batch(folder + "/cache", key="user_id", buckets=8)
    entries = lambda events: events.select(
        "user_id", (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("last_event"), F.col("event_id").alias("seq")
    )
    _stream(t, folder, lambda events: entries(events).writeStream.foreachBatch(write))
    return t.spark.read.parquet(folder + "/cache").select("user_id", "ok", "last_event")


@query(
    "stream_ingest",
    """
    SELECT 'u' || user_id AS id, 'N' || max(event_id) AS name, arg_max('p' || event_id, event_id) FILTER (event_id % 4 <> 0) AS phone FROM events GROUP BY user_id
    """,
)
def stream_ingest(t):
    folder = scratch(t)
    n = F.col("event_id")
    write = streams.ingest_officials_batch(folder + "/officials")
    rows = lambda events: events.select(
        *_official(F.concat(F.lit("u"), "user_id"), n, phone=F.when(n % 4 != 0, F.concat(F.lit("p"), n))), n.alias("seq")
    )
    _stream(t, folder, lambda events: rows(events).writeStream.foreachBatch(write))
    return t.spark.read.parquet(folder + "/officials").select("id", "name", "phone")


@query(
    "stream_search_log",
    "SELECT event_id::VARCHAR AS t, 'find ' || event_type AS query, CASE WHEN event_id % 3 = 0 THEN 'TX' END AS state FROM events WHERE event_id % 5 <> 0",
)
def stream_search_log(t):
    """Search events appended as they come; blank queries are left out."""
    folder, n = scratch(t), F.col("event_id")
    place = F.when(n % 3 == 0, F.struct(F.lit("TX").alias("state"), F.lit(None).cast("string").alias("county"), F.lit(None).cast("string").alias("place")))
    rows = lambda events: events.select(
        n.cast("string").alias("t"), F.when(n % 5 != 0, F.concat(F.lit(" find "), "event_type")).otherwise(F.lit(" ")).alias("query"), F.lit(None).cast("string").alias("typed"), place.alias("geo"))
    _stream(t, folder, lambda events: streams.search_log_stream(rows(events), folder + "/log", folder + "/progress0"))
    return t.spark.read.parquet(folder + "/log").select("t", "query", "resolved.state")


@query(
    "stream_ttl_lookup",
    "SELECT event_id, CASE WHEN user_id % 4 = 0 OR user_id % 4 = 3 THEN 'absent' WHEN user_id % 4 = 1 THEN 'cache' ELSE 'cache-miss' END AS source FROM events",
)
def stream_ttl_lookup(t):
    """Requests as they come against a stored cache: a fresh hit, a fresh miss, an entry too old, none."""
    folder, u = scratch(t), F.col("user_id")
    users = t.events.select("user_id").distinct().filter(u % 4 != 0)
    users.select(
        "user_id", (u % 4 != 2).alias("ok"), F.when(u % 4 == 1, F.lit("2026-08-01T00:00:00Z")).when(u % 4 == 2, F.lit("2026-08-16T00:00:00Z")).otherwise(F.lit("2026-01-01T00:00:00Z")).alias("checked_at")
    ).write.parquet(folder + "/cache")
    cache = t.spark.read.parquet(folder + "/cache")
    answer = lambda events: streams.ttl_lookup_stream(events.select("event_id", "user_id"), cache, ["user_id"], "2026-08-19T00:00:00Z").select("event_id", "source")
    _stream(t, folder, lambda events: answer(events).writeStream.format("parquet").option("path", folder + "/out").outputMode("append"))
    return t.spark.read.parquet(folder + "/out")


@query(
    "stream_ttl_refill",
    f"""
    WITH e AS (SELECT event_id, user_id, event_type, floor((event_id - a) * {DELIVERIES} / (b - a + 1)) AS p FROM events, (SELECT min(event_id) AS a, max(event_id) AS b FROM events)),
    refills AS (SELECT user_id, p AS q, arg_max(event_type <> 'error', event_id) AS ok FROM e GROUP BY 1, 2)
    SELECT event_id, CASE WHEN arg_max(ok, q) AND 2 * (any_value(e.p) - max(q)) < 5 THEN 'cache' WHEN NOT arg_max(ok, q) AND 2 * (any_value(e.p) - max(q)) < 4 THEN 'cache-miss' ELSE 'absent' END AS source
    FROM e LEFT JOIN refills r ON r.user_id = e.user_id AND q < p GROUP BY event_id
    """,
)
def stream_ttl_refill(t):
    """A delivery every two days: its requests are answered from the cache, then its outcomes refill it. Hits live for five days, misses for four."""
    folder = scratch(t)
    first, last = t.events.agg(F.min("event_id"), F.max("event_id")).first()
    at = F.date_format(F.timestamp_seconds(F.lit(1_767_225_600) + 2 * 86_400 * _delivery(F.col("event_id"), first, last)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lookup = streams.ttl_lookup_batch(folder + "/cache", folder + "/out", ["user_id"], at="at", buckets=8, hit_days=5, miss_days=4)
    refill = streams.cache_refill_batch(folder + "/cache", key="user_id", buckets=8)
    _stream(
        t, folder,
        lambda events: events.select("event_id", "user_id", at.alias("at")).writeStream.foreachBatch(lookup),
        lambda events: events.select("user_id", (F.col("event_type") != "error").alias("ok"), at.alias("checked_at"), F.col("event_id").alias("seq")).writeStream.foreachBatch(refill),
    )
    return t.spark.read.parquet(folder + "/out").select("event_id", "source")
