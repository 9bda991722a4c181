"""Composite jobs: the operators wired into the runs a user schedules.

Inputs and outputs are tables. Anything a job publishes goes through ``sources.writers``. Some jobs stage tables that their
results read from; run a job and write its results inside ``with session.staging(spark):``, which removes them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.functions.text import (
    clip_input, excerpt, filled, guess_body_name, has, hash_key, jurisdiction_key, pin, place_slug,
)
from rosterspark.functions.urls import check_submission_url, url_origin
from rosterspark.operators import crawl, extraction, limits, qa, records, selection, serve, tiers, universe, web
from rosterspark.session import staged
from rosterspark.sources import writers

_PLACE = ["city", "state", "level", "body"]


def _place() -> object:
    return F.struct(*[F.col(c).alias(c) for c in _PLACE])


# --- roster run -----------------------------------------------------------------------------


@dataclass
class RosterResult:
    officials: DataFrame
    problems: DataFrame
    detail_queue: DataFrame


def roster_job(
    pages: DataFrame, responses: DataFrame, now: str, details: DataFrame | None = None,
    stored: DataFrame | None = None, budget: int = selection.ENRICH_BUDGET, homes: DataFrame | None = None,
) -> RosterResult:
    """Landed pages and model answers to deduplicated, enriched officials.

    ``pages``: page_id (order), city, state, level, body, requested_url, url, ok, status, html, error.
    ``responses``: page_id, finish_reason, response. ``details``: page_id-free answers per official
    (id, response, page url ``source_url``). ``stored`` officials turn on the 90-day bio cooldown across runs.
    ``homes``: fetched home pages of the sites (requested_url, url, ok, html); problems then suggest links from them.
    """
    keyed = pages.withColumn("batch", jurisdiction_key("state", "city", "level"))
    failed = keyed.filter(~F.coalesce("ok", F.lit(False))).select("city", "state", F.col("requested_url").alias("url"), "error")
    read = web.page_text(keyed.filter("ok").withColumn("html", F.coalesce("html", F.lit(""))), out="_text")
    # Pinned, or every filter by the text would make it anew where the pages are read.
    good = web.page_quality(pin(read, text=F.col("_text")).drop("_text"))
    thin = good.filter("needs_browser").select(
        "city", "state", F.col("requested_url").alias("url"), F.lit("needs-browser (empty static render)").alias("error")
    )
    whole, cut = extraction.split_truncated(responses)
    usable = good.filter("not needs_browser").select("page_id", "batch", *_PLACE, F.col("url").alias("source_url"), F.col("requested_url"))
    lost = cut.join(usable, "page_id").select(
        "city", "state", F.col("requested_url").alias("url"), F.concat(F.lit("extract failed: "), F.col("error")).alias("error")
    )
    answers = whole.select("page_id", "response").join(usable, "page_id")
    raw = extraction.parse_roster_response(answers)
    raw = raw.withColumns({
        "jurisdiction": _place(), "extracted_at": F.lit(now),
        "seq": F.shiftleft(F.col("page_id").cast("bigint"), 32) + F.col("pos"),
    }).select("batch", "seq", "raw", "jurisdiction", "source_url", "extracted_at")
    clean = records.normalize(raw)
    best = staged(records.dedupe_best(clean, ["batch", "id"], "confidence")).withColumn("_row", F.concat_ws("\u0000", "batch", "id"))
    own = records.strip_shared_media(best, ["batch"], "_row").drop("_row")
    pool = own
    if stored is not None:
        checked = stored.select("id", F.col("bio_checked_at").alias("_checked"))
        pool = own.join(checked, "id", "left").withColumn("bio_checked_at", F.coalesce("bio_checked_at", "_checked")).drop("_checked")
    queue = selection.enrichment_candidates(pool, ["batch"], now, budget)
    officials = own
    if details is not None:
        wanted = extraction.parse_detail_response(details).join(queue.select("id"), "id", "left_semi")
        officials = records.merge_enrichment(own, wanted.withColumn("extracted_at", F.lit(now)))
    problems = reduce(DataFrame.unionByName, [failed, thin, lost])
    return RosterResult(officials, problems if homes is None else web.with_home_links(problems, homes), queue)


def publish_job(officials: DataFrame, path: str, coverage_path: str, now: str, seq: str = "seq") -> DataFrame:
    """Upsert the officials table and its coverage rows; returns the coverage of touched states."""
    return writers.write_coverage(writers.upsert_shards(officials, path, seq), coverage_path, now)


# --- universe and discovery -----------------------------------------------------------------


def universe_job(
    places: DataFrame, counties: DataFrame, place_population: DataFrame, county_population: DataFrame, state: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Universe rows, match metrics per state and level, and names without a known suffix."""
    by_place = universe.population_by_geoid(place_population, "PLACE", universe.PLACE_WIDTH)
    by_county = universe.population_by_geoid(county_population, "COUNTY", universe.COUNTY_WIDTH)
    rows = universe.build_places(places, by_place, state)
    table = rows.unionByName(universe.build_counties(counties, by_county, state))
    return table, universe.coverage_metrics(table, ["state", "level"]), universe.unrecognized_names(rows)


#: Parts that the officials of one site are dealt to when they meet the groups on it.
ORIGIN_SALTS = 16


@dataclass
class DiscoveryResult:
    hits: DataFrame
    misses: DataFrame
    officials: DataFrame


def discovery_job(
    candidates: DataFrame, sites: DataFrame, pages: DataFrame, links: DataFrame, raw_officials: DataFrame,
    old_misses: DataFrame, now: str, hits: DataFrame | None = None, errors: DataFrame | None = None,
    links_per_page: int | None = crawl.LINKS_PER_PAGE,
) -> DiscoveryResult:
    """Resolve sites, walk them, and split candidates into hits and misses.

    ``candidates``: key, city, state, level, population (already selected under the budget). ``sites``: group (=key), city,
    recalled, hits. ``pages``: url, final_url, ok, text. ``raw_officials``: url (final), raw. ``errors``: key, error of
    candidates whose crawl or extraction failed: those are misses, with the error as reason. A hit needs a roster page and
    officials left after normalization, and removes an older miss of its key. Misses keep the candidate's population.
    """
    if "population" not in candidates.columns:
        candidates = candidates.withColumn("population", F.lit(None).cast("bigint"))
    site = crawl.resolve_site(sites, pages.select("url", "final_url", "ok", "text"))
    starts = site.select(
        "group", F.col("requested_url").alias("start_url"), F.col("url").alias("final_url"), url_origin("url").alias("origin")
    )
    named = candidates.withColumn("body", guess_body_name("city", "level"))
    # Ids depend on the jurisdiction, so rows are normalized per candidate over the pages of its own site.
    by_origin = raw_officials.withColumn("origin", url_origin("url"))
    # A site can have very many officials and several groups: the groups' side is small per site, and the rows of a hot
    # site are dealt over salts, which each group is copied to.
    salted = by_origin.withColumn("_salt", F.pmod(F.xxhash64("url", F.to_json("raw")), F.lit(ORIGIN_SALTS)).cast("int"))
    owners = starts.join(named.withColumnRenamed("key", "group"), "group").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(ORIGIN_SALTS - 1))))
    rows = owners.join(salted, ["origin", "_salt"])
    rows = rows.select("group", F.col("url").alias("source_url"), "raw", _place().alias("jurisdiction"), F.lit(now).alias("extracted_at"))
    clean = staged(records.normalize(rows))
    found = clean.select("group", "id", F.col("source_url").alias("url"))
    walk = crawl.expand_frontier(starts, pages, links, found, hits, links_per_page=links_per_page)
    source = walk.filter("is_source").select("group", F.col("final_url").alias("roster_url"))
    visits = walk.filter("ok").select("group", F.col("final_url").alias("source_url"), "visit")
    collected = clean.join(visits, ["group", "source_url"])
    officials = records.strip_shared_media(
        records.latest_per_key(collected, ["group", "id"], "visit").withColumn("_row", F.concat_ws("\u0000", "group", "id")), ["group"], "_row"
    ).drop("_row")
    officials = staged(officials)
    failed = errors if errors is not None else candidates.select("key", F.lit(None).cast("string").alias("error")).limit(0)
    failed = failed.groupBy("key").agg(F.min("error").alias("_error"))
    state = (
        named.join(site.select(F.col("group").alias("key"), F.lit(True).alias("_site")), "key", "left")
        .join(source.withColumnRenamed("group", "key"), "key", "left").join(failed, "key", "left")
        .join(officials.select(F.col("group").alias("key"), F.lit(True).alias("_any")).distinct(), "key", "left")
    )
    hit = F.col("roster_url").isNotNull() & F.col("_any").isNotNull() & F.col("_error").isNull()
    new_hits = state.filter(hit).select(
        "key", *_PLACE, F.array("roster_url").alias("urls"), F.lit(now).alias("discovered_at")
    )
    reason = (
        F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_site").isNull(), F.lit("no site found"))
        .when(F.col("roster_url").isNull(), F.lit("roster page not found")).otherwise(F.lit("no officials extracted"))
    )
    new_misses = state.filter(~hit).select("key", "city", "state", "level", "population", F.lit(now).alias("checked_at"), reason.alias("reason"))
    kept = old_misses.join(candidates.select("key"), "key", "left_anti")
    officials = officials.join(new_hits.select(F.col("key").alias("group")), "group", "left_semi")
    return DiscoveryResult(new_hits, kept.unionByName(new_misses, allowMissingColumns=True), officials)


# --- checks, promotion, reports -------------------------------------------------------------


def qa_job(
    stored: DataFrame, fetches: DataFrame, fresh_raw: DataFrame, now: str, sample: int = selection.REVIEW_SAMPLE,
) -> tuple[DataFrame, DataFrame]:
    """Findings of a re-check with their jurisdiction, and the stored officials with fresh ones merged in (none is deleted).

    ``fetches``: source_url, ok, error of the pages fetched again (a page whose extraction is empty counts as
    checked). ``fresh_raw``: source_url, raw, seq. The page's first stored record gives its jurisdiction.
    """
    chosen = staged(selection.rank_for_review(stored, sample=sample).select("source_url"))
    checked = staged(fetches.join(chosen, "source_url", "left_semi"))
    good = checked.filter("ok").select("source_url")
    lost = checked.filter(~F.coalesce("ok", F.lit(False))).select(
        "source_url", F.concat(F.lit("page no longer reachable: "), F.coalesce(filled("error"), F.lit("fetch failed"))).alias("issue")
    )
    known = stored.filter(has("source_url")).join(chosen, "source_url", "left_semi")
    place = records.first_per_key(known, "source_url").select(
        "source_url", F.struct(F.col("jurisdiction.city").alias("city"), F.col("jurisdiction.state").alias("state"), "level", "body").alias("jurisdiction")
    )
    place = staged(place)
    raw = fresh_raw.join(good, "source_url", "left_semi").join(place, "source_url").withColumn("extracted_at", F.lit(now))
    fresh = staged(records.normalize(raw.select("seq", "raw", "jurisdiction", "source_url", "extracted_at")))
    drift = staged(qa.qa_lists(stored.join(good, "source_url", "left_semi"), fresh))
    findings = drift.withColumn("issue", F.lit(None).cast("string")).unionByName(lost, allowMissingColumns=True)
    findings = findings.join(place.select("source_url", "jurisdiction.city", "jurisdiction.state"), "source_url", "left")
    corrections = fresh.join(drift.select("source_url"), "source_url", "left_semi")
    return findings, records.merge_records(stored.drop("seq"), corrections)


def promote_job(entries: DataFrame, seeded: DataFrame, discovered: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Cached finds to permanent jurisdictions and the officials that come with them."""
    picked = selection.promote_new(selection.entry_jurisdictions(entries, now), [seeded, discovered], ["key"])
    officials = picked.select("seq", F.posexplode("officials").alias("pos", "o")).select(
        "o.*", (F.shiftleft(F.col("seq").cast("bigint"), 32) + F.col("pos")).alias("seq")
    )
    return picked.drop("officials", "seq"), officials


def reported_links_job(
    issues: DataFrame, fetches: DataFrame, responses: DataFrame, now: str, max_links: int | None = selection.MAX_LINKS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Promotable officials, links that need review with the reason, and their jurisdictions.

    ``issues``: issue, body, labels, is_pr (in issue order). ``fetches``: url, ok, error.
    ``responses``: url, response.
    """
    with_link, _ = selection.split_by_link(selection.checkable_issues(issues))
    todo = selection.first_reported(with_link, max_links).select("issue", F.col("link").alias("url"))
    checked = todo.withColumn("_c", check_submission_url("url"))
    refused = checked.filter("not _c.ok").select("issue", "url", F.col("_c.reason").alias("reason"))
    allowed = checked.filter("_c.ok").select("issue", F.col("_c.href").alias("url"))
    parsed = extraction.parse_submission_response(responses)
    rows = allowed.join(fetches.select("url", "ok", "error"), "url", "left").join(parsed, "url", "left")
    place = F.col("jurisdiction")
    rows = rows.withColumn("jurisdiction", F.struct(
        place["city"].alias("city"), place["state"].alias("state"),
        F.coalesce(filled(place["level"]), F.lit("local")).alias("level"), place["body"].alias("body"),
    ))
    gov, listed = F.col("is_government_source"), F.col("officials")
    judged = rows.withColumns({
        "promotable": selection.is_promotable(F.coalesce(gov & F.col("ok"), F.lit(False)), F.col("jurisdiction"), listed),
        "reason": selection.reason_not_promotable(F.col("ok"), F.col("error"), gov, F.col("jurisdiction"), listed),
    })
    review = refused.unionByName(judged.filter("not promotable").select("issue", "url", "reason"))
    raw = judged.filter("promotable").select("issue", "url", "jurisdiction", F.posexplode("officials").alias("pos", "raw"))
    staged = records.normalize(raw.select(
        (F.shiftleft(F.col("issue").cast("bigint"), 32) + F.col("pos")).alias("seq"), "raw", "jurisdiction",
        F.col("url").alias("source_url"), F.lit(now).alias("extracted_at"),
    ))
    return staged, review, records.jurisdictions_of(staged)


def report_triage_job(
    submissions: DataFrame, responses: DataFrame, open_issues: DataFrame, note_length: int | None = limits.NOTE_LENGTH,
    link_length: int | None = limits.LINK_LENGTH, title_length: int | None = extraction.TITLE_LENGTH,
) -> DataFrame:
    """Rate-limited reports with their triage and duplicate status.

    ``submissions``: seq, ts, ip, note, url. ``responses``: seq, response. Texts are clipped to the lengths given; None keeps them whole.
    """
    clean = submissions.select(
        "seq", "ts", hash_key("ip").alias("key"), clip_input("note", note_length).alias("note"),
        clip_input("url", link_length).alias("url"),
    ).filter(has("note"))
    accepted = limits.rate_limit(clean, ["key"])
    # Both sides grow with the submissions, and Spark guesses the size of texts from their columns: neither goes through the driver.
    triaged = extraction.parse_triage(responses, title_length=title_length).join(accepted.hint("merge"), "seq")
    return extraction.resolve_duplicates(triaged, open_issues).withColumn("excerpt", excerpt("note"))


# --- federal, lookup, collapse, probe -------------------------------------------------------


def federal_job(
    legislators: DataFrame, committees: DataFrame, membership: DataFrame, district_offices: DataFrame, bios: DataFrame | None = None,
) -> DataFrame:
    members = tiers.committee_members(membership, tiers.committee_names(committees))
    return tiers.federal_details(
        legislators, tiers.invert_committees(members), tiers.district_offices_by_person(district_offices), bios
    )


def social_job(handles: DataFrame) -> DataFrame:
    return tiers.social_urls(handles)


def lookup_job(
    requests: DataFrame, officials: DataFrame, reps: DataFrame, social: DataFrame, details: DataFrame,
    legislators: DataFrame, executives: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Ordered, grouped cards per request, and the requests left for the on-demand queue.

    ``requests``: request_id, state, place, county. ``reps`` and ``legislators`` carry request_id (their
    upstream answers are per location); ``executives`` are per state.
    """
    keep = ["request_id"]
    flat = officials.withColumns({"state": F.upper("jurisdiction.state"), "city": F.col("jurisdiction.city")})
    keys = serve.match_keys(requests)
    # What a card shows is made once per official or executive, then joined to the requests of the place or the state.
    local = serve.match_local(keys, serve.grouped_cards(serve.rep_card(flat, ["level", "city"])), tile=serve.MATCH_TILE).drop("level", "city")
    federal = serve.as_cards(serve.enrich_federal(reps, social, details), keep)
    upper = serve.as_cards(tiers.legislator_cards(legislators), keep)
    merged = serve.grouped_cards(serve.replace_state_tier(federal, upper))
    heads = requests.select("request_id", "state").join(serve.grouped_cards(serve.as_cards(tiers.executive_cards(executives), [])), "state")
    cards = serve.assemble_results(local, merged, heads)
    first = [*keep, *serve.CARD_COLUMNS, "tier"]
    cards = cards.select(*first, *[c for c in cards.columns if c not in first])
    queue = serve.unmatched(requests, serve.match_local(keys, flat, how="left_semi")).withColumn("cache_key", place_slug("state", F.coalesce("place", "county")))
    return cards, queue


def collapse_job(officials: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Officials after the duplicate collapse, and its report (use the report alone for a dry run)."""
    collapsed = records.collapse_duplicates(officials, seq)
    return collapsed.drop("_n"), records.collapse_report(collapsed)


def seed_probe_job(jurisdictions: DataFrame, fetches: DataFrame) -> DataFrame:
    """Probe report of every seed url."""
    targets = jurisdictions.select("city", "state", F.explode("urls").alias("url"))
    return web.probe(targets, fetches)
