"""Predicates, ranked selections under a budget, and anti-join queues.

Selections that end in "the first k of all rows" use ``orderBy().limit()``, which Spark runs as a
bounded heap per task. "The first k per group" uses ``row_number() <= k``, which Spark cuts per
task before the shuffle, so a big group never reaches one task whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rosterspark.functions.text import (
    col, filled, has, jurisdiction_key, level_from_body, parse_time,
)
from rosterspark.operators.records import first_per_key

# Fixed values of the selection rules.
ENRICHMENT_FIELDS = ["photo_url", "address", "phone", "email", "hours", "bio"]
BIO_RECHECK_DAYS = 90
REFRESH_DAYS = 30
MISS_COOLDOWN_DAYS = 90
ENRICH_BUDGET = 10
REVIEW_SAMPLE = 25
MAX_LINKS = 15
DAILY_CAP = 1450
SAFETY_MARGIN = 0.85
PROMOTABLE_LEVELS = ["local", "county"]
MIN_PROMOTABLE_CONFIDENCE = 0.6


def _days(now, then: Column) -> Column:
    """Age in days (fractional) of ``then`` at ``now``; null when either is unreadable."""
    at = parse_time(F.lit(now) if isinstance(now, str) else now)
    return (F.unix_micros(at) - F.unix_micros(then)) / F.lit(86_400_000_000)


# --- predicates -----------------------------------------------------------------------------


def needs_enrichment(fields: list[str] | None = None) -> Column:
    return reduce(Column.__or__, [F.col(f).isNull() for f in fields or ENRICHMENT_FIELDS])


def recently_checked(checked_at: Column | str, now, days: int = BIO_RECHECK_DAYS) -> Column:
    return F.coalesce(_days(now, parse_time(checked_at)) < days, F.lit(False))


def is_promotable(gov: Column, jurisdiction: Column, officials: Column) -> Column:
    """A government source with a city, a state, a supported level and one confident official."""
    confident = F.exists(officials, lambda o: F.coalesce(o["confidence"], F.lit(0.0)) >= MIN_PROMOTABLE_CONFIDENCE)
    return F.coalesce(
        gov & has(jurisdiction["city"]) & has(jurisdiction["state"])
        & jurisdiction["level"].isin(PROMOTABLE_LEVELS) & confident,
        F.lit(False),
    )


def reason_not_promotable(ok: Column, error: Column, gov: Column, jurisdiction: Column, officials: Column) -> Column:
    """First unmet condition, in the order they are reported."""
    level = jurisdiction["level"]
    return (
        F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("couldn't load the page: "), F.coalesce(filled(error), F.lit("unknown error"))))
        .when(F.coalesce(F.size(officials), F.lit(0)) < 1, F.lit("no officials extracted"))
        .when(~F.coalesce(gov, F.lit(False)), F.lit("doesn't look like an official government source"))
        .when(~(has(jurisdiction["city"]) & has(jurisdiction["state"])), F.lit("jurisdiction not resolved"))
        .when(
            ~F.coalesce(level.isin(PROMOTABLE_LEVELS), F.lit(False)),
            F.concat(F.lit("out of scope for this dataset (level: "), F.coalesce(filled(level), F.lit("unknown")), F.lit(")")),
        )
        .otherwise(F.lit("extraction confidence too low"))
    )


def link_from_body(body: Column | str) -> Column:
    return filled(F.regexp_extract(col(body), r"\*\*Link:\*\*\s*(\S+)", 1))


def split_by_link(issues: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    tagged = issues.withColumn("link", link_from_body(body))
    return tagged.filter("link is not null"), tagged.filter("link is null").drop("link")


def checkable_issues(issues: DataFrame, label: str = "link-checked", is_pr: str = "is_pr", labels: str = "labels") -> DataFrame:
    marked = F.coalesce(F.array_contains(labels, label), F.lit(False))
    return issues.filter(~F.coalesce(F.col(is_pr), F.lit(False)) & ~marked)


def active_places(df: DataFrame, state: str, usps: str = "USPS", status: str | None = "FUNCSTAT") -> DataFrame:
    rows = df.filter(F.upper(usps) == state.upper())
    return rows.filter(F.col(status) == "A") if status else rows


# --- budgets --------------------------------------------------------------------------------


def remaining_budget(used: Column | str, cap: int = DAILY_CAP) -> Column:
    return F.greatest(F.lit(0), F.lit(cap) - F.coalesce(col(used), F.lit(0)))


def budget_from_remaining(remaining: Column | str, average: float, margin: float = SAFETY_MARGIN) -> Column:
    if not average:
        return F.lit(0).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.floor(col(remaining) / F.lit(float(average)) * F.lit(margin)))


# --- ranked selections ----------------------------------------------------------------------


def first_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group; ``rank`` keeps their 1-based position.

    One plan for every ``k``: tasks cut their rows to k a group before the shuffle, up to the k that the session
    allows for that (``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 unless set higher).
    """
    name = rank or "_rank"
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    picked = df.withColumn(name, place).filter(F.col(name) <= k)
    return picked if rank else picked.drop(name)


def enrichment_candidates(
    df: DataFrame, batch: list[str], now, budget: int = ENRICH_BUDGET, url: str = "url", seq: str = "seq",
    fields: list[str] | None = None, checked_at: str = "bio_checked_at",
) -> DataFrame:
    """Per batch the first ``budget`` records with an own url that lack a contact field.

    A url used twice in the batch is nobody's own page. Uniqueness comes from one aggregation
    that keeps a single row per url, however many rows share it.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    single = (
        df.filter(has(url)).groupBy(*batch, url).agg(F.count(F.lit(1)).alias("_n"), F.min_by(row, F.col(seq)).alias("_r"))
        .filter("_n = 1").select("_r.*")
    )
    wanted = single.filter(needs_enrichment(fields) & ~recently_checked(checked_at, now))
    return first_k_per_group(wanted, batch, [F.col(seq).asc()], budget)


def last_seen(df: DataFrame, keys: list[str], at: str, out: str = "last_seen") -> DataFrame:
    """Newest readable time per key."""
    return df.groupBy(*keys).agg(F.max_by(F.col(at), parse_time(at)).alias(out))


def due_for_refresh(
    items: DataFrame, last: DataFrame, on: list[str], now, budget: int | None = None,
    refresh_days: int = REFRESH_DAYS, last_col: str = "last_seen", seq: str = "seq",
) -> DataFrame:
    """Items never seen, then the oldest ones, at least ``refresh_days`` old; unreadable times drop out."""
    age = _days(now, parse_time(last_col))
    rows = items.join(last, on, "left").withColumn("_age", age)
    due = rows.filter(~has(F.col(last_col).cast("string")) | (F.col("_age") >= refresh_days))
    ranked = due.orderBy(F.col("_age").desc_nulls_first(), F.col(seq).asc())
    return (ranked if budget is None else ranked.limit(budget)).drop("_age")


def discovery_candidates(
    universe: DataFrame, known: list[DataFrame], misses: DataFrame, key: list[str], now,
    population: str = "population", seq: str = "seq", cooldown_days: int = MISS_COOLDOWN_DAYS,
    budget: int | None = None, checked_at: str = "checked_at",
) -> DataFrame:
    """Universe rows not known yet and without a recent miss, biggest population first.

    The last miss per key counts; one without a time is old enough to retry. All exclusions are
    one key set, so the universe meets one anti join.
    """
    latest = misses.groupBy(*key).agg(F.max_by(checked_at, seq).alias("_at"))
    recent = latest.filter(recently_checked("_at", now, cooldown_days)).select(*key)
    excluded = reduce(DataFrame.unionByName, [k.select(*key) for k in known], recent)
    left = universe.join(excluded, key, "left_anti")
    ranked = left.orderBy(F.col(population).desc_nulls_last(), F.col(seq).asc())
    return ranked if budget is None else ranked.limit(budget)


def entry_jurisdictions(entries: DataFrame, now: str) -> DataFrame:
    """Cache entries with officials of a known city and state, as jurisdictions."""
    first = F.try_element_at("officials", F.lit(1))
    place = first["jurisdiction"]
    return (
        entries.filter(F.col("ok") & (F.size("officials") > 0))
        .filter(has(place["city"]) & has(place["state"]))
        .select(
            place["city"].alias("city"), place["state"].alias("state"),
            level_from_body(F.coalesce(first["body"], F.lit(""))).alias("level"),
            filled(first["body"]).alias("body"),
            F.when(has("source_url"), F.array("source_url")).otherwise(F.array().cast("array<string>")).alias("urls"),
            F.coalesce(filled("checked_at"), F.lit(now)).alias("discovered_at"),
            "officials", "seq",
        )
        .withColumn("key", jurisdiction_key("state", "city", "level"))
    )


def promote_new(entries: DataFrame, known: list[DataFrame], key: list[str], seq: str = "seq") -> DataFrame:
    """First entry per key that is not known by any other list."""
    taken = reduce(DataFrame.unionByName, [k.select(*key) for k in known])
    return first_per_key(entries.join(taken, key, "left_anti"), key, seq)


def rank_for_review(
    records: DataFrame, url: str = "source_url", at: str = "extracted_at", confidence: str = "confidence",
    sample: int | None = REVIEW_SAMPLE, seq: str = "seq",
) -> DataFrame:
    """Source pages by oldest record, then lowest confidence; an unreadable time counts as oldest."""
    groups = records.filter(has(url)).groupBy(url).agg(
        F.min(F.coalesce(F.unix_micros(parse_time(at)), F.lit(0))).alias("oldest"),
        F.min(F.coalesce(F.col(confidence).cast("double"), F.lit(1.0))).alias("min_confidence"),
        F.count(F.lit(1)).alias("records"),
        F.min(seq).alias("first_seq"),
    )
    ranked = groups.orderBy(F.col("oldest").asc(), F.col("min_confidence").asc(), F.col("first_seq").asc())
    return ranked if sample is None else ranked.limit(sample)


def first_reported(issues: DataFrame, limit: int | None = MAX_LINKS) -> DataFrame:
    """The oldest ``limit`` issues, as many as one run checks; None: all, without a sort."""
    return issues if limit is None else issues.orderBy("issue").limit(limit)


def review_sample_size(requested: int, affordable: int) -> int:
    """Pages or links to check now: what was asked for, within what the budget still allows."""
    return max(0, min(requested, affordable))


def newest_log(df: DataFrame, seq: list[str], limit: int | None = None, keep: int | None = 5000) -> DataFrame:
    """Newest log rows first: ``limit`` of them (200 unless given), within the ``keep`` rows a log retains (None: all)."""
    wanted = max(limit or 200, 1)
    wanted = wanted if keep is None else min(wanted, keep)
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in seq]).limit(wanted)
