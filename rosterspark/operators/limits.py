"""Rate limits, cache lookups and the usage ledger in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.functions.text import clip_input, col, filled, parse_time
from rosterspark.operators.selection import first_k_per_group

# Limits of the submission and log endpoints, cache lifetimes in days.
REPORTS_PER_DAY = 8
NOTE_LENGTH = 2000
LINK_LENGTH = 500
QUERY_LENGTH = 300
HIT_TTL_DAYS = 90
MISS_TTL_DAYS = 7
LEGISLATOR_TTL_DAYS = 30
EXECUTIVE_TTL_DAYS = 90


def utc_day(c: Column | str) -> Column:
    return F.date_format(F.to_date(col(c)), "yyyy-MM-dd")


def rate_limit(events: DataFrame, key: list[str], at: str = "ts", seq: str = "seq", per_day: int = REPORTS_PER_DAY) -> DataFrame:
    """Rows accepted under ``per_day`` per key and day, in time order.

    ``row_number() <= per_day`` is cut inside each task before the shuffle: a key with a third of
    all rows sends at most ``per_day`` rows per task.
    """
    day = events.withColumn("day", utc_day(at))
    return first_k_per_group(day, ["day", *key], [F.col(at).asc(), F.col(seq).asc()], per_day)


def rate_limit_flags(events: DataFrame, key: list[str], at: str = "ts", seq: str = "seq", per_day: int = REPORTS_PER_DAY) -> DataFrame:
    """Every row with ``accepted``; the last accepted row per key and day is the cut-off."""
    last = rate_limit(events, key, at, seq, per_day).groupBy("day", *key).agg(F.max(F.struct(at, seq)).alias("_cut"))
    rows = events.withColumn("day", utc_day(at))
    return rows.join(last, ["day", *key], "left").withColumn(
        "accepted", F.struct(at, seq) <= F.col("_cut")
    ).drop("_cut")


def cache_source(ok: Column, checked_at: Column, now, hit_days: int = HIT_TTL_DAYS, miss_days: int = MISS_TTL_DAYS) -> Column:
    """'cache', 'cache-miss' or 'absent' (no entry, or one at or past its lifetime)."""
    at = F.unix_micros(parse_time(F.lit(now) if isinstance(now, str) else now))
    age = (at - F.unix_micros(parse_time(checked_at))) / F.lit(86_400_000_000)
    life = F.when(ok, F.lit(hit_days)).otherwise(F.lit(miss_days))
    fresh = F.coalesce(age < life, F.lit(False))
    return F.when(fresh & ok, F.lit("cache")).when(fresh, F.lit("cache-miss")).otherwise(F.lit("absent"))


def ttl_lookup(
    requests: DataFrame, cache: DataFrame, on: list[str], now, hit_days: int = HIT_TTL_DAYS, miss_days: int = MISS_TTL_DAYS
) -> DataFrame:
    """Requests with the state of their cache entry (one entry per key; ``ok``, ``checked_at``)."""
    rows = requests.join(cache, on, "left")
    source = cache_source(F.coalesce(F.col("ok"), F.lit(False)), F.col("checked_at"), now, hit_days, miss_days)
    return rows.withColumn("source", source)


def usage_by_day(calls: DataFrame, at: str = "ts", phase: str = "phase", n: str = "n") -> DataFrame:
    """Calls per UTC day: total and a map phase -> calls. Sums are taken per (day, phase) first."""
    parts = calls.groupBy(utc_day(at).alias("date"), F.col(phase).alias("phase")).agg(F.sum(n).alias("n"))
    entries = F.filter(F.collect_list(F.struct("phase", "n")), lambda e: e["phase"].isNotNull())
    return parts.groupBy("date").agg(
        F.sum("n").alias("calls_used"), F.map_from_entries(F.array_sort(entries)).alias("by_phase")
    )


def used_on(ledger: DataFrame, day: str) -> DataFrame:
    """Calls used on ``day``; a ledger of another day counts as 0."""
    return ledger.agg(F.coalesce(F.sum(F.when(F.col("date") == day, F.col("calls_used"))), F.lit(0)).alias("used"))


def search_log_rows(raw: DataFrame, at: str = "t", query: str = "query", typed: str = "typed", geo: str = "geo", length: int | None = QUERY_LENGTH) -> DataFrame:
    """Validated log rows, texts clipped to ``length`` (None: whole); only the resolved place is kept of the geo answer."""
    g = F.col(geo)
    text = clip_input(query, length)
    return raw.filter(text != "").select(
        F.col(at).alias("t"), text.alias("query"), filled(clip_input(typed, length)).alias("typed"),
        F.when(g.isNotNull(), F.struct(*[g[k].alias(k) for k in ("state", "county", "place")])).alias("resolved"),
    )
