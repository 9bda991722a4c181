"""Queries for predicates, ranked selections, queues, limits, caches and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterspark.functions.text import jurisdiction_key
from rosterspark.operators import limits, records, selection, universe
from rosterspark.plans.catalog import query
from rosterspark.plans.queries_web import submission_answers
from rosterspark.operators.extraction import parse_submission_response

NOW = "2001-09-01T00:00:00Z"


def _iso(c, pattern="yyyy-MM-dd'T'HH:mm:ss'Z'"):
    return F.date_format(c, pattern)


# --- predicates -----------------------------------------------------------------------------


@query(
    "enrichment_flags",
    """
    SELECT o_orderkey, o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 AS needs, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE o_orderdate > TIMESTAMP '2001-09-01' - INTERVAL 90 DAY END AS recent FROM orders
    """,
)
def enrichment_flags(t):
    n = F.col("o_orderkey")
    rows = t.orders.select(
        "o_orderkey", F.when(n % 2 != 0, F.lit("p")).alias("phone"), F.when(n % 3 != 0, F.lit("")).alias("bio"),
        F.when(n % 5 != 0, _iso("o_orderdate")).when(n % 10 == 0, F.lit("never")).alias("checked"),
    )
    return rows.select("o_orderkey", selection.needs_enrichment(["phone", "bio"]).alias("needs"), selection.recently_checked("checked", NOW).alias("recent"))


@query(
    "promotable",
    """
    WITH p AS (SELECT c_custkey AS n, c_custkey % 11 <> 0 AS good, CASE WHEN c_custkey % 11 <> 0 THEN ['local', 'county', 'state', NULL][(c_custkey % 4) + 1] END AS lv FROM customer),
    q AS (SELECT *, n % 13 <> 0 AS ok, good AND n % 3 <> 0 AS gov, good AND n % 7 <> 0 AS has_city, CASE WHEN good AND n % 5 <> 0 THEN (n % 10) / 10.0 END AS conf FROM p)
    SELECT n AS c_custkey, coalesce(gov AND has_city AND lv IN ('local', 'county') AND conf >= 0.6, false) AS promotable,
      CASE WHEN NOT ok THEN 'couldn''t load the page: ' || CASE WHEN n % 2 = 0 THEN 'HTTP 500' ELSE 'unknown error' END WHEN conf IS NULL THEN 'no officials extracted'
        WHEN NOT gov THEN 'doesn''t look like an official government source' WHEN NOT has_city THEN 'jurisdiction not resolved'
        WHEN lv IS NULL OR lv = 'state' THEN 'out of scope for this dataset (level: ' || coalesce(lv, 'unknown') || ')' ELSE 'extraction confidence too low' END AS reason
    FROM q
    """,
)
def promotable(t):
    n = F.col("c_custkey")
    p = parse_submission_response(submission_answers(t))
    gov, place, listed = F.col("is_government_source"), F.col("jurisdiction"), F.col("officials")
    return p.select(
        "c_custkey", selection.is_promotable(gov, place, listed).alias("promotable"),
        selection.reason_not_promotable(n % 13 != 0, F.when(n % 2 == 0, F.lit("HTTP 500")), gov, place, listed).alias("reason"),
    )


def _issues(t):
    n = F.col("o_orderkey")
    body = F.concat(F.lit("Note\n"), F.when(n % 3 != 0, F.concat(F.lit("**Link:**  https://x.gov/"), n, F.lit(" end\n"))).otherwise(F.lit("**Link:**")))
    labels = F.when(n % 4 == 0, F.array(F.lit("user-reported"), F.lit("link-checked"))).when(n % 5 != 0, F.array(F.lit("user-reported")))
    return t.orders.select(n.alias("issue"), body.alias("body"), labels.alias("labels"), (n % 7 == 0).alias("is_pr"))


@query(
    "reported_links",
    "SELECT o_orderkey AS issue, CASE WHEN o_orderkey % 3 <> 0 THEN 'https://x.gov/' || o_orderkey END AS link FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0",
)
def reported_links(t):
    with_link, without = selection.split_by_link(selection.checkable_issues(_issues(t)))
    return with_link.select("issue", "link").unionByName(without.select("issue", F.lit(None).cast("string").alias("link")))


@query(
    "link_review",
    """
    SELECT o_orderkey AS issue FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 ORDER BY 1 LIMIT 15
    """,
)
def link_review(t):
    with_link, _ = selection.split_by_link(selection.checkable_issues(_issues(t)))
    return selection.first_reported(with_link, selection.review_sample_size(selection.MAX_LINKS, 100)).select("issue")


@query(
    "active_places",
    "SELECT s_suppkey, 'place' AS kind FROM supplier WHERE s_suppkey % 4 = 1 AND s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'county' FROM supplier WHERE s_suppkey % 4 = 1",
)
def active_places(t):
    """Places (active ones) and counties (all) of one state."""
    n = F.col("s_suppkey")
    rows = t.supplier.select(
        "s_suppkey", F.get(F.array(*[F.lit(x) for x in ("CA", "tx", "NY", "DE")]), (n % 4).cast("int")).alias("USPS"),
        F.when(n % 3 != 0, F.lit("A")).otherwise(F.lit("S")).alias("FUNCSTAT"),
    )
    places = selection.active_places(rows, "tx").select("s_suppkey", F.lit("place").alias("kind"))
    return places.unionByName(selection.active_places(rows, "TX", status=None).select("s_suppkey", F.lit("county").alias("kind")))


# --- ranked selections ----------------------------------------------------------------------


@query(
    "enrich_pick",
    """
    WITH d AS (SELECT doc_id, source, md5(text) AS url, doc_id % 3 = 0 AS gap, doc_id % 4 = 0 AS recent FROM documents),
    u AS (SELECT *, count(*) OVER (PARTITION BY source, url) AS n FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM u WHERE n = 1 AND gap AND NOT recent)
    SELECT doc_id, source FROM r WHERE rk <= 10
    """,
)
def enrich_pick(t):
    n = F.col("doc_id")
    rows = t.documents.select(
        "doc_id", "source", F.md5("text").alias("url"), F.when(n % 3 != 0, F.lit("x")).alias("phone"),
        F.when(n % 4 == 0, F.lit("2001-08-15T00:00:00Z")).when(n % 4 == 1, F.lit("1999-01-01T00:00:00Z")).alias("bio_checked_at"), n.alias("seq"),
    )
    picked = selection.enrichment_candidates(rows, ["source"], NOW, fields=["phone"])
    return picked.select("doc_id", "source")


@query(
    "last_scraped",
    "SELECT o_custkey, strftime(max(o_orderdate) FILTER (o_orderkey % 9 <> 0), '%Y-%m-%dT%H:%M:%SZ') AS last_seen FROM orders GROUP BY 1",
)
def last_scraped(t):
    rows = t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 9 != 0, _iso("o_orderdate")).otherwise(F.lit("bad time")).alias("at"))
    return selection.last_seen(rows, ["o_custkey"], "at")


_DUE = """
    WITH last AS (SELECT o_custkey AS k, max(o_orderdate) AS d FROM orders WHERE o_custkey % 6 <> 0 GROUP BY 1)
    SELECT c_custkey FROM customer LEFT JOIN last ON k = c_custkey WHERE c_custkey % 10 <> 1 AND (d IS NULL OR d <= TIMESTAMP '2001-09-01' - INTERVAL 30 DAY)
"""


@query("refresh_due", _DUE + "ORDER BY d NULLS FIRST, c_custkey LIMIT 50")
def refresh_due(t):
    """The first 50 due customers; a broken time (every tenth) never comes up."""
    return _due(t, 50)


@query("refresh_due_all", _DUE)
def refresh_due_all(t):
    return _due(t, None)


def _due(t, budget):
    seen = t.orders.filter(F.col("o_custkey") % 6 != 0).select(F.col("o_custkey").alias("c_custkey"), _iso("o_orderdate").alias("at"))
    last = selection.last_seen(seen, ["c_custkey"], "at")
    broken = t.customer.filter(F.col("c_custkey") % 10 == 1).select("c_custkey", F.lit("soon").alias("last_seen"))
    last = last.join(broken, "c_custkey", "left_anti").unionByName(broken)
    items = t.customer.select("c_custkey", F.col("c_custkey").alias("seq"))
    return selection.due_for_refresh(items, last, ["c_custkey"], NOW, budget).select("c_custkey")


_NEXT = """
    WITH miss AS (SELECT o_custkey AS k, arg_max(CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate END, o_orderkey) AS at0, max(o_orderkey) AS mx FROM orders GROUP BY 1),
    m AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate END AS seen_at FROM orders JOIN miss ON k = o_custkey AND mx = o_orderkey)
    SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = c_custkey AND p_size = 7)
      AND NOT EXISTS (SELECT 1 FROM m WHERE k = c_custkey AND seen_at > TIMESTAMP '2001-09-01' - INTERVAL 90 DAY)
"""


@query("discover_next", _NEXT + "ORDER BY CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END DESC NULLS LAST, c_custkey LIMIT 100")
def discover_next(t):
    return _next(t, 100)


@query("discover_queue", _NEXT)
def discover_queue(t):
    return _next(t, None)


def _next(t, budget):
    u = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("population"), F.col("c_custkey").alias("seq"))
    seeds = t.supplier.select(F.col("s_suppkey").alias("c_custkey"))
    found = t.part.filter("p_size = 7").select(F.col("p_partkey").alias("c_custkey"))
    misses = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 8 != 0, _iso("o_orderdate")).alias("checked_at"), F.col("o_orderkey").alias("seq"))
    return selection.discovery_candidates(u, [seeds, found], misses, ["c_custkey"], NOW, budget=budget).select("c_custkey")


@query(
    "promote_new",
    """
    WITH e AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || (c_custkey % 50) END AS city, 'S' || (c_nationkey % 3) AS st, CASE WHEN c_custkey % 4 = 0 THEN 'county' ELSE 'local' END AS lv FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0),
    k AS (SELECT *, st || ':' || lower(city) || ':' || lv AS key FROM e WHERE city IS NOT NULL),
    known AS (SELECT DISTINCT 'S' || (s_suppkey % 3) || ':' || lower(['BUILDING', 'MACHINERY'][(s_suppkey % 2) + 1]) || (s_suppkey % 50) || ':local' AS key FROM supplier)
    SELECT key, min(n) AS first_entry, arg_min(city, n) AS city FROM k WHERE key NOT IN (SELECT key FROM known) GROUP BY 1
    """,
)
def promote_new(t):
    n = F.col("c_custkey")
    city = F.when(n % 5 != 0, F.concat(F.col("c_mktsegment"), n % 50))
    place = F.struct(city.alias("city"), F.concat(F.lit("s"), F.col("c_nationkey") % 3).alias("state"))
    body = F.when(n % 4 == 0, F.lit("X Commissioners Court")).otherwise(F.lit("X City Council"))
    person = F.struct(F.col("c_name").alias("name"), place.alias("jurisdiction"), body.alias("body"))
    listed = F.when(n % 7 != 0, F.array(person)).otherwise(F.array().cast("array<struct<name:string,jurisdiction:struct<city:string,state:string>,body:string>>"))
    entries = t.customer.select((n % 3 != 0).alias("ok"), listed.alias("officials"), F.lit("u").alias("source_url"), F.lit("").alias("checked_at"), n.alias("seq"))
    cities = F.get(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), (F.col("s_suppkey") % 2).cast("int"))
    seeded = t.supplier.select(jurisdiction_key(F.concat(F.lit("S"), F.col("s_suppkey") % 3), F.concat(cities, F.col("s_suppkey") % 50), F.lit("local")).alias("key"))
    out = selection.promote_new(selection.entry_jurisdictions(entries, NOW), [seeded], ["key"])
    return out.select("key", F.col("seq").alias("first_entry"), "city")


@query(
    "qa_rank",
    """
    WITH g AS (SELECT o_custkey, min(CASE WHEN o_orderkey % 200 = 0 THEN 0 ELSE epoch_us(o_orderdate) END) AS oldest, min(CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE o_totalprice / 1e6 END) AS min_confidence, count(*) AS records, min(o_orderkey) AS seq FROM orders GROUP BY 1)
    SELECT o_custkey, oldest, min_confidence, records FROM g ORDER BY oldest, min_confidence, seq LIMIT 25
    """,
)
def qa_rank(t):
    n = F.col("o_orderkey")
    rows = t.orders.select(
        F.col("o_custkey"), F.when(n % 200 == 0, F.lit("??")).otherwise(_iso("o_orderdate")).alias("extracted_at"),
        F.when(n % 2 != 0, F.col("o_totalprice") / 1e6).alias("confidence"), n.alias("seq"), F.col("o_custkey").cast("string").alias("source_url"),
    )
    ranked = selection.rank_for_review(rows)
    return ranked.select(F.col("source_url").cast("bigint").alias("o_custkey"), "oldest", "min_confidence", "records")


@query(
    "budgets",
    """
    SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS calls_used, greatest(0, 1450 - count(*)) AS remaining,
      greatest(0, floor(greatest(0, 1450 - count(*)) / 2.5 * 0.85))::BIGINT AS estimate, 0::BIGINT AS none FROM events GROUP BY 1
    """,
)
def budgets(t):
    calls = t.events.select("ts", F.col("event_type").alias("phase"), F.lit(1).cast("bigint").alias("n"))
    ledger = limits.usage_by_day(calls).select("date", "calls_used")
    left = selection.remaining_budget("calls_used")
    return ledger.select(
        "date", "calls_used", left.alias("remaining"), selection.budget_from_remaining(left, 2.5).alias("estimate"),
        selection.budget_from_remaining(left, 0).alias("none"),
    )


@query("log_tail", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def log_tail(t):
    return selection.newest_log(t.events, ["ts", "event_id"]).select("event_id", "user_id")


@query("log_tail_kept", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def log_tail_kept(t):
    return selection.newest_log(t.events, ["ts", "event_id"], 99999).select("event_id")


# --- limits, caches, ledgers ----------------------------------------------------------------


@query(
    "usage_daily",
    """
    SELECT date, sum(n)::BIGINT AS calls_used, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_phase
    FROM (SELECT strftime(ts, '%Y-%m-%d') AS date, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1
    """,
)
def usage_daily(t):
    calls = t.events.select("ts", F.col("event_type").alias("phase"), F.lit(1).cast("bigint").alias("n"))
    ledger = limits.usage_by_day(calls)
    shown = F.transform(F.array_sort(F.map_entries("by_phase")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return ledger.select("date", "calls_used", F.array_join(shown, ",").alias("by_phase"))


@query("usage_today", "SELECT count(*) AS used FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-09'")
def usage_today(t):
    calls = t.events.select("ts", F.col("event_type").alias("phase"), F.lit(1).cast("bigint").alias("n"))
    return limits.used_on(limits.usage_by_day(calls), "2024-01-09")


@query(
    "rate_limit",
    "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3",
)
def rate_limit(t):
    return limits.rate_limit(t.events, ["user_id"], seq="event_id", per_day=3).select("event_id")


# One in three events belongs to the same key.
@query(
    "rate_limit_flags",
    """
    SELECT event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), k ORDER BY ts, event_id) <= 8 AS accepted
    FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS k FROM events)
    """,
)
def rate_limit_flags(t):
    rows = t.events.withColumn("k", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    return limits.rate_limit_flags(rows, ["k"], seq="event_id").select("event_id", "accepted")


@query(
    "ttl_lookup",
    """
    WITH c AS (SELECT user_id, arg_max(event_type <> 'error', event_id) AS ok, arg_max(ts, event_id) AS seen_at FROM events WHERE user_id % 10 <> 3 GROUP BY 1)
    SELECT event_id, CASE WHEN ok AND seen_at > TIMESTAMP '2024-02-07' - INTERVAL 90 DAY THEN 'cache' WHEN NOT ok AND seen_at > TIMESTAMP '2024-02-07' - INTERVAL 8 DAY THEN 'cache-miss' ELSE 'absent' END AS source
    FROM events LEFT JOIN c USING (user_id)
    """,
)
def ttl_lookup(t):
    entries = t.events.filter(F.col("user_id") % 10 != 3).select(
        "user_id", (F.col("event_type") != "error").alias("ok"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("checked_at"), F.col("event_id").alias("seq")
    )
    cache = records.latest_per_key(entries, "user_id").drop("seq")
    found = limits.ttl_lookup(t.events.select("event_id", "user_id"), cache, ["user_id"], "2024-02-07T00:00:00Z", miss_days=8)
    return found.select("event_id", "source")


@query(
    "search_log",
    """
    SELECT conv_id, turn, q AS query, CASE WHEN turn % 2 = 0 THEN q END AS typed, CASE WHEN conv_id % 3 <> 0 THEN role END AS place
    FROM (SELECT *, regexp_replace(text, '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g')[1:300] AS q FROM conversations) WHERE q <> ''
    """,
)
def search_log(t):
    geo = F.when(F.col("conv_id") % 3 != 0, F.struct(F.lit("TX").alias("state"), F.lit(None).cast("string").alias("county"), F.col("role").alias("place"), F.lit(1.5).alias("lat")))
    raw = t.conversations.select(
        F.struct("conv_id", "turn").alias("t"), F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("query"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.col("text"))).otherwise(F.lit("  ")).alias("typed"), geo.alias("geo"),
    )
    return limits.search_log_rows(raw).select("t.conv_id", "t.turn", "query", "typed", "resolved.place")


@query(
    "log_lines",
    """
    SELECT event_id, event_type AS query FROM events WHERE event_id % 4 <> 0
    """,
)
def log_lines(t):
    from rosterspark.sources.readers import jsonl_rows

    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("t"), F.col("event_type").alias("query")))
    broken = F.when(F.col("event_id") % 8 == 0, F.lit("")).otherwise(F.expr("left('{\"t\": \"12', 7)"))
    lines = t.events.select(F.when(F.col("event_id") % 4 == 0, broken).otherwise(line).alias("value"))
    rows = jsonl_rows(lines, "t string, query string")
    return rows.select(F.col("t").cast("bigint").alias("event_id"), "query")


# --- universe -------------------------------------------------------------------------------

_POP = """
    pop AS (SELECT lpad((o_custkey % 100)::VARCHAR, 2, '0') || lpad((o_custkey // 100)::VARCHAR, 5, '0') AS geoid,
      arg_max(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey END, o_orderkey) AS population FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY 1),
    place AS (SELECT c_custkey, n_name AS state, c_mktsegment || [' city', ' town', '', ' CDP'][(c_custkey % 4) + 1] AS raw_name,
      CASE WHEN c_custkey % 4 = 2 THEN c_mktsegment ELSE c_mktsegment END AS name, lpad((c_custkey % 100)::VARCHAR, 2, '0') || lpad((c_custkey // 100)::VARCHAR, 5, '0') AS geoid
      FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 6 <> 0)
"""


def _population(t):
    k, n = F.col("o_custkey"), F.col("o_orderkey")
    value = F.when(n % 13 == 0, F.lit("(X)")).when(n % 10 == 0, F.lit("")).otherwise(n.cast("string"))
    return t.orders.select(
        (k % 100).cast("string").alias("state"), F.floor(k / 100).cast("string").alias("Place"), F.lit("1").alias("POPESTIMATE2020"), value.alias("POPESTIMATE2023"), n.alias("seq")
    )


def _places(t):
    k = F.col("c_custkey")
    tail = F.get(F.array(F.lit(" city"), F.lit(" town"), F.lit(""), F.lit(" CDP")), (k % 4).cast("int"))
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lower("n_name").alias("usps"), F.concat("c_mktsegment", tail).alias("Name"), F.when(k % 6 != 0, F.lit("A")).otherwise(F.lit("I")).alias("FUNCSTAT"),
        F.concat(F.lpad((k % 100).cast("string"), 2, "0"), F.lpad(F.floor(k / 100).cast("string"), 5, "0")).alias("GEOID"),
    )


@query("population_latest", "WITH " + _POP + " SELECT * FROM pop")
def population_latest(t):
    return universe.population_by_geoid(_population(t), "PLACE", universe.PLACE_WIDTH)


@query("population_join", "WITH " + _POP + " SELECT state, name, p.geoid, population FROM place p LEFT JOIN pop USING (geoid)")
def population_join(t):
    pop = universe.population_by_geoid(_population(t), "PLACE", universe.PLACE_WIDTH)
    return universe.build_places(_places(t), pop).select("state", "name", "geoid", "population")


@query("county_table", "WITH " + _POP + " SELECT state, raw_name AS name, geoid, population FROM place LEFT JOIN pop USING (geoid) WHERE state = 'NATION_3'")
def county_table(t):
    pop = universe.population_by_geoid(_population(t), "PLACE", universe.PLACE_WIDTH)
    rows = _places(t).filter("FUNCSTAT = 'A'")
    return universe.build_counties(rows, pop, "nation_3").select("state", "name", "geoid", "population")


@query(
    "coverage_metrics",
    "WITH " + _POP + """ SELECT state, count(*) AS total, count(population) AS matched, count(population) / count(*)::DOUBLE AS ratio, count(population) / count(*) < 0.5 AS low_match
    FROM place LEFT JOIN pop USING (geoid) GROUP BY 1""",
)
def coverage_metrics(t):
    full = universe.population_by_geoid(_population(t), "PLACE", universe.PLACE_WIDTH)
    return universe.coverage_metrics(universe.build_places(_places(t), full), ["state"])


@query("unrecognized_names", "WITH " + _POP + " SELECT DISTINCT state, raw_name FROM place WHERE raw_name = name")
def unrecognized_names(t):
    pop = universe.population_by_geoid(_population(t), "PLACE", universe.PLACE_WIDTH)
    return universe.unrecognized_names(universe.build_places(_places(t), pop))


@query(
    "latest_vintage",
    "SELECT 'year' AS kind, max(y)::VARCHAR AS vintage FROM (SELECT 1995 + o_orderkey % 30 AS y FROM orders) WHERE y % 7 <> 0 UNION ALL SELECT 'range', max((y - 3) || '-' || y) FROM (SELECT 1995 + o_orderkey % 30 AS y FROM orders) WHERE y % 7 <> 0 UNION ALL SELECT 'none', 'F'",
)
def latest_vintage(t):
    y = F.lit(1995) + F.col("o_orderkey") % 30
    span = F.concat((y - 3).cast("string"), F.lit("-"), y.cast("string"))
    listing = t.orders.select(F.concat(F.lit('<a href="'), y, F.lit('_Gazetteer/">x</a> <a href="'), span, F.lit('/">y</a>')).alias("html"))
    good = t.orders.filter(y % 7 != 0)
    parts = [
        ("year", universe.latest_populated_vintage(listing, good.select(y.cast("string").alias("vintage")), "F")),
        ("range", universe.latest_populated_vintage(listing, good.select(span.alias("vintage")), "F", kind="range")),
        ("none", universe.latest_populated_vintage(listing, good.select(F.concat(F.lit("x"), y).alias("vintage")), "F")),
    ]
    out = None
    for kind, df in parts:
        df = df.select(F.lit(kind).alias("kind"), "vintage")
        out = df if out is None else out.unionByName(df)
    return out
