"""Bounded expansion over stored pages and links, and choosing a site."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterspark.functions.html import is_noise_href, looks_like_gov_site
from rosterspark.functions.urls import url_origin
from rosterspark.operators.records import first_per_key
from rosterspark.operators.selection import first_k_per_group
from rosterspark.session import staged, staging

# Crawl bounds.
FETCH_BUDGET = 8
MIN_OFFICIALS = 7
LINKS_PER_PAGE = 4


def same_origin_new_links(links: DataFrame, visited: DataFrame, group: str, url: str = "link", origin: str = "origin") -> DataFrame:
    """Links on the group's own origin that are not visited yet."""
    own = links.filter(url_origin(url) == F.col(origin))
    return own.join(visited.select(group, F.col("url").alias(url)), [group, url], "left_anti")


def initial_frontier(starts: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """First queue per group: search hits of the same origin without noise, in rank order, then the
    start page. ``starts``: group, start_url, final_url, origin; ``hits``: group, url, rank."""
    first = starts.select("group", F.col("final_url").alias("url"), F.lit(2**31).cast("bigint").alias("place"))
    if hits is None:
        return first
    known = starts.select("group", "origin", "start_url", "final_url")
    seeds = hits.join(known, "group").filter(
        ~is_noise_href("url") & (url_origin("url") == F.col("origin"))
        & (F.col("url") != F.col("start_url")) & (F.col("url") != F.col("final_url"))
    )
    seeds = seeds.select("group", "url", F.col("rank").cast("bigint").alias("place"))
    return seeds.unionByName(first)


def expand_frontier(
    starts: DataFrame, pages: DataFrame, links: DataFrame, officials: DataFrame, hits: DataFrame | None = None,
    fetch_budget: int = FETCH_BUDGET, min_officials: int = MIN_OFFICIALS, links_per_page: int | None = LINKS_PER_PAGE,
) -> DataFrame:
    """Breadth-first walk per group, all groups at once, one round per link distance.

    First-in-first-out order equals (round, rank of the parent visit, link position), so a round is:
    rank the frontier, keep what the budget allows, stop a group where it has enough distinct ids,
    take the links of the visited pages that are not queued before. At most ``fetch_budget`` rounds.

    A round works on what is new only. It writes two tables: its visits with the ids they found first, and the links to go on
    with. A group whose frontier has links was visited in the round before, so its state is read from that round's visits
    alone; what was queued or found earlier is the union of the rounds' tables and is only probed (anti-joins). All of them, and
    the pruned inputs, are removed at the end; the walk is one table.

    ``starts``: group, start_url (what the walk starts from), final_url (what it led to), origin. ``pages``: url,
    final_url, ok (one row per url); a start page that is known only by its requested url is that page, not fetched again.
    ``links``: url (final), pos, link - the page's suggestions, the first ``links_per_page`` used (None: all).
    ``officials``: url (final), id, and group where ids depend on it: several groups may share a site. Result: group, visit (0-based), url, final_url, ok, found_ids (distinct ids
    after the visit), is_source (the page a result of the walk is credited to).
    """
    with staging(starts.sparkSession) as block:
        return block.keep(_walk(starts, pages, links, officials, hits, fetch_budget, min_officials, links_per_page))


def _walk(starts, pages, links, officials, hits, fetch_budget, min_officials, links_per_page) -> DataFrame:
    by_url = pages.select("url", "final_url", "ok")
    # The first visit goes by the address that a redirect led to; that page is there under the requested address.
    started = starts.select(F.col("start_url").alias("url"), F.col("final_url").alias("_to")).distinct().join(by_url, "url").select(F.col("_to").alias("url"), "final_url", "ok")
    by_url = staged(by_url.unionByName(started.join(by_url, "url", "left_anti").dropDuplicates(["url"])))
    used = links if links_per_page is None else links.filter(F.col("pos") < links_per_page)
    suggestions = staged(used.select(F.col("url").alias("final_url"), "pos", "link"))
    on = ["group", "final_url"] if "group" in officials.columns else ["final_url"]
    ids = staged(officials.select(*on[:-1], F.col("url").alias("final_url"), "id").distinct())
    starts = staged(starts.select("group", "start_url", "final_url", "origin"))
    origins = starts.select("group", "origin")

    frontier = staged(initial_frontier(starts, hits))
    queued = [frontier.select("group", "url"), starts.select("group", F.col("start_url").alias("url"))]
    live = starts.select("group", F.lit(0).alias("visits"), F.lit(0).cast("bigint").alias("n_ids"))
    rounds: list[DataFrame] = []
    while len(rounds) < fetch_budget:
        ranked = first_k_per_group(frontier.join(live, "group"), ["group"], [F.col("place").asc(), F.col("url").asc()], fetch_budget, "_k")
        within = ranked.withColumn("visit", F.col("visits") + F.col("_k") - 1).filter(F.col("visit") < fetch_budget)
        fetched = within.join(by_url, "url", "left").select(
            "group", "visit", "url", "n_ids", F.coalesce("final_url", "url").alias("final_url"), F.coalesce("ok", F.lit(False)).alias("ok")
        )
        rounds.append(staged(_round(fetched, ids, on, [_ids(r) for r in rounds], min_officials)))
        visited = _visits(rounds[-1])
        live = visited.groupBy("group").agg((F.max("visit") + 1).alias("visits"), F.max("found_ids").alias("n_ids"))
        live = live.filter((F.col("visits") < fetch_budget) & (F.col("n_ids") < min_officials))
        # A page that reaches the minimum ends its walk, so its links are not queued.
        parents = visited.filter(F.col("ok") & (F.col("found_ids") < min_officials))
        found = parents.join(suggestions, "final_url").join(origins, "group")
        fresh = same_origin_new_links(found, reduce(DataFrame.unionByName, queued), "group")
        place = F.shiftleft(F.col("visit").cast("bigint"), 32) + F.col("pos")
        frontier = staged(fresh.groupBy("group", F.col("link").alias("url")).agg(F.min(place).alias("place")))
        if frontier.isEmpty():
            break
        queued.append(frontier.select("group", "url"))
    walk = reduce(DataFrame.unionByName, [_visits(r) for r in rounds])
    source = F.max_by("visit", F.when(F.col("ok") & (F.col("found_ids") > 0), F.col("visit")))
    credited = walk.groupBy("group").agg(source.alias("_source"))
    return walk.join(credited, "group", "left").withColumn(
        "is_source", F.coalesce(F.col("visit") == F.col("_source"), F.lit(False))
    ).drop("_source")


def _visits(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("id").isNull()).drop("id")


def _ids(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("id").isNotNull()).select("group", "id")


def _round(fetched: DataFrame, ids: DataFrame, on: list[str], seen: list[DataFrame], min_officials: int) -> DataFrame:
    """Visits of a round up to the one that reaches the minimum, and below them (``id`` set) the ids that they found first."""
    # Ids first seen at a visit of this round; running sum of at most fetch_budget rows per group.
    new_ids = fetched.filter("ok").join(ids, on).filter(F.col("id").isNotNull()).groupBy("group", "id").agg(F.min("visit").alias("visit"))
    if seen:
        new_ids = new_ids.join(reduce(DataFrame.unionByName, seen), ["group", "id"], "left_anti")
    gained = new_ids.groupBy("group", "visit").agg(F.count(F.lit(1)).alias("_gain"))
    order = Window.partitionBy("group").orderBy("visit")
    counted = fetched.join(gained, ["group", "visit"], "left").withColumn(
        "found_ids", F.col("n_ids") + F.sum(F.coalesce("_gain", F.lit(0))).over(order)
    ).withColumn("_before", F.coalesce(F.lag("found_ids").over(order), F.col("n_ids")))
    visited = counted.filter(F.col("_before") < min_officials).select("group", "visit", "url", "final_url", "ok", "found_ids")
    step = new_ids.join(visited.select("group", "visit"), ["group", "visit"], "left_semi").select("group", "id")
    return visited.withColumn("id", F.lit(None).cast("string")).unionByName(step.withColumn("id", F.col("id").cast("string")), allowMissingColumns=True)


def resolve_site(candidates: DataFrame, pages: DataFrame, city: str = "city") -> DataFrame:
    """The first candidate page that reads like the official site of its group.

    ``candidates``: group, city, recalled (url or null), and hits: array of urls in rank order. The
    recalled url comes first, then per hit its origin (once per origin) and the hit itself.
    ``pages``: url (requested), final_url, ok, text. At most a handful of candidates per group.
    """
    def options(hits):
        origins = F.transform(hits, lambda u: url_origin(u))
        return F.flatten(F.transform(hits, lambda u, i: F.array(
            F.struct((i * 2 + 1).alias("place"), F.when(
                F.array_position(origins, origins[i]) == (i + 1).cast("bigint"), origins[i]).alias("url")),
            F.struct((i * 2 + 2).alias("place"), u.alias("url")),
        )))

    recalled = F.array(F.struct(F.lit(0).alias("place"), F.col("recalled").alias("url")))
    rows = candidates.select("group", F.col(city).alias("city"), F.inline(F.concat(recalled, options(F.col("hits")))))
    joined = rows.filter("url is not null").join(pages, "url")
    good = joined.filter(looks_like_gov_site(F.col("ok"), F.col("text"), F.col("final_url"), F.col("city")))
    return first_per_key(good, "group", "place").select("group", F.col("final_url").alias("url"), F.col("url").alias("requested_url"))
