"""Queries that run composite jobs and the file sinks end to end on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterspark.functions.text import jurisdiction_key
from rosterspark.operators.records import merge_records
from rosterspark.plans import jobs
from rosterspark.plans.catalog import Tables, query, s_id, s_text
from rosterspark.plans.queries_records import _DUP_SQL, _duplicates, _official, _order_officials
from rosterspark.plans.queries_selection import _POP, NOW, _places, _population
from rosterspark.plans.queries_tiers import _MEMBER_SQL, _committees, _district_entries, _executive, _legislators, _membership, _people
from rosterspark.schema import OFFICE_KEYS, OFFICIAL, RAW_OFFICIAL, SOCIAL_KEYS
from rosterspark.session import new_folder
from rosterspark.sources import readers, writers


def scratch(t: Tables) -> str:
    """A new folder below the one that the session shares with its executors."""
    return new_folder(t.spark)


# --- roster run -----------------------------------------------------------------------------


def _roster_inputs(t: Tables):
    n, k = F.col("c_custkey"), F.col("c_custkey").cast("string")
    html = F.concat(F.lit("<p>"), F.expr("repeat('word ', cast(if(c_custkey % 5 = 0, 10, 200) as int))"), F.lit("</p>"))
    rows = t.spread("customer")
    pages = rows.select(
        n.alias("page_id"), F.concat(F.lit("City"), F.col("c_nationkey")).alias("city"), F.lit("TX").alias("state"), F.lit("local").alias("level"),
        F.lit("Council").alias("body"), F.concat(F.lit("https://c.gov/"), k).alias("requested_url"), F.concat(F.lit("https://c.gov/"), k).alias("url"),
        (n % 7 != 0).alias("ok"), F.lit(200).alias("status"), html.alias("html"), F.when(n % 7 == 0, F.lit("HTTP 500")).alias("error"),
    )
    person = F.struct(
        F.concat(F.lit("Person "), n % 40).alias("name"), F.lit("Mayor").alias("office"), F.concat(F.lit("p/"), k).alias("url"),
        F.lit("/seal.png").alias("photo_url"), F.when(n % 2 == 0, F.lit("5125550000")).alias("phone"), (n % 100 / 100).alias("confidence"),
    )
    body = F.to_json(F.struct(F.array(person).alias("officials")))
    responses = rows.select(
        n.alias("page_id"), F.when(n % 11 == 0, F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"), body.alias("response")
    )
    return pages, responses


_ROSTER_SQL = """
    WITH r AS (SELECT c_custkey AS n, c_nationkey AS city, c_custkey % 40 AS p, (c_custkey % 100) / 100.0 AS conf FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 <> 0),
    b AS (SELECT city, p, arg_max(n, (conf, -n)) AS n, min(n) AS first_n, max(conf) AS conf FROM r GROUP BY 1, 2),
    m AS (SELECT *, count(*) OVER (PARTITION BY city) AS people FROM b)
"""


@query(
    "roster_run",
    _ROSTER_SQL + """
    SELECT 'tx:city' || city || ':mayor:person-' || p AS id, 'Person ' || p AS name, 'Mayor' AS office, 'local' AS level, 'Council' AS body, NULL AS district, conf AS confidence,
      CASE WHEN n % 2 = 0 THEN '512-555-0000' END AS phone, NULL AS email, 'https://c.gov/p/' || n AS url, CASE WHEN people < 3 THEN 'https://c.gov/seal.png' END AS photo_url,
      'twitter=~,facebook=~,instagram=~,linkedin=~,youtube=~' AS social, NULL AS address, '' AS offices, NULL AS hours, NULL AS bio, NULL AS bio_checked_at,
      'City' || city AS city, 'TX' AS state, 'https://c.gov/' || n AS source_url, '{now}' AS extracted_at, 'TX:city' || city || ':local' AS batch FROM m
    """.replace("{now}", NOW),
)
def roster_run(t):
    pages, responses = _roster_inputs(t)
    return _whole(jobs.roster_job(pages, responses, NOW).officials, "batch")


def _whole(officials, *more):
    """All fields of officials, nested ones spelled out."""
    social = F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col("social")[k], F.lit("~"))) for k in SOCIAL_KEYS])
    offices = F.array_join(F.transform("offices", lambda o: F.concat_ws("/", *[F.coalesce(o[k], F.lit("~")) for k in OFFICE_KEYS])), ",")
    plain = [f.name for f in OFFICIAL.fields if f.name not in {"social", "offices", "jurisdiction"}]
    return officials.select(*plain, *more, social.alias("social"), offices.alias("offices"), "jurisdiction.city", "jurisdiction.state")


@query(
    "roster_enriched",
    _ROSTER_SQL + """
    , q AS (SELECT city, p, row_number() OVER (PARTITION BY city ORDER BY first_n) AS rk FROM m WHERE p % 4 <> 0),
    d AS (SELECT city, p FROM q WHERE rk <= 10 AND p % 3 <> 0)
    SELECT 'tx:city' || m.city || ':mayor:person-' || m.p AS id, CASE WHEN n % 2 = 0 THEN '512-555-0000' WHEN d.p IS NOT NULL THEN '512-999-0000' END AS phone,
      CASE WHEN d.p IS NOT NULL THEN 'p' || m.p || '@b.gov' END AS email, CASE WHEN d.p IS NOT NULL THEN 'bio ' || m.p END AS bio, CASE WHEN d.p IS NOT NULL THEN '{now}' END AS bio_checked_at
    FROM m LEFT JOIN d ON d.city = m.city AND d.p = m.p
    """.replace("{now}", NOW),
)
def roster_enriched(t):
    """With answers for detail pages, and stored records: those looked at lately aren't asked for again."""
    pages, responses = _roster_inputs(t)
    person = t.customer.select(F.col("c_nationkey").alias("city"), (F.col("c_custkey") % 40).alias("p")).distinct()
    person = person.withColumn("id", F.concat(F.lit("tx:city"), "city", F.lit(":mayor:person-"), "p"))
    answer = F.to_json(F.struct(F.lit("5129990000").alias("phone"), F.concat(F.lit("p"), "p", F.lit("@b.gov")).alias("email"), F.concat(F.lit("bio "), "p").alias("bio")))
    details = person.filter("p % 3 <> 0").select("id", answer.alias("response"), F.lit("https://c.gov/d").alias("source_url"))
    stored = person.select("id", F.when(F.col("p") % 4 == 0, F.lit(NOW)).alias("bio_checked_at"))
    return jobs.roster_job(pages, responses, NOW, details, stored).officials.select("id", "phone", "email", "bio", "bio_checked_at")


@query(
    "roster_problems",
    """
    SELECT 'https://c.gov/' || c_custkey AS url, CASE WHEN c_custkey % 7 = 0 THEN 'HTTP 500' WHEN c_custkey % 5 = 0 THEN 'needs-browser (empty static render)'
      ELSE 'extract failed: response truncated at the output limit' END AS error, 'https://c.gov/council=Council,https://c.gov/mayor=(no text)' AS tries FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 5 = 0 OR c_custkey % 11 = 0
    """,
)
def roster_problems(t):
    pages, responses = _roster_inputs(t)
    html = F.lit('<a href="/council">Council</a><a href="/x">x</a><a href="/mayor"> </a>')
    homes = t.region.filter("r_regionkey = 0").select(F.lit("https://c.gov/").alias("requested_url"), F.lit("https://c.gov/").alias("url"), F.lit(True).alias("ok"), html.alias("html"))
    problems = jobs.roster_job(pages, responses, NOW, homes=homes).problems
    return problems.select("url", "error", F.array_join(F.transform("suggestions", lambda r: F.concat(r["url"], F.lit("="), r["text"])), ",").alias("tries"))


@query(
    "roster_detail_queue",
    _ROSTER_SQL + """
    , q AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY first_n) AS rk FROM m)
    SELECT 'tx:city' || city || ':mayor:person-' || p AS id FROM q WHERE rk <= 10
    """,
)
def roster_detail_queue(t):
    pages, responses = _roster_inputs(t)
    return jobs.roster_job(pages, responses, NOW).detail_queue.select("id")


# --- publishing -----------------------------------------------------------------------------


def _by_state(df):
    """Give records a state from their id, so that they spread over the partitions of the table."""
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % 5
    place = F.struct(F.concat(F.lit("City"), number).alias("city"), F.concat(F.lit("s"), number).alias("state"))
    return df.withColumn("jurisdiction", place)


@query(
    "shard_upsert",
    """
    SELECT 'id' || o_custkey AS id, 'N' || max(o_orderkey) AS name, 'S' || (o_custkey % 5) AS state, arg_max(CASE WHEN o_orderkey % 5 = 0 THEN 'e' || o_orderkey END, o_orderkey) FILTER (o_orderkey % 5 = 0) AS email
    FROM orders GROUP BY o_custkey
    """,
)
def shard_upsert(t):
    """Write stored records, upsert the incoming ones twice, read the table back."""
    stored, incoming = _order_officials(t)
    path = scratch(t) + "/officials"
    writers.upsert_shards(_by_state(stored).withColumn("seq", F.lit(0)), path)
    for _ in range(2):
        writers.upsert_shards(_by_state(incoming), path)
    return readers.read_officials(t.spark, path).select("id", "name", "state", "email")


@query(
    "publish_run",
    """
    SELECT 'S' || (o_custkey % 5) AS state, count(DISTINCT o_custkey) AS count, 'City' || (o_custkey % 5) AS cities FROM orders GROUP BY 1, 3
    """,
)
def publish_run(t):
    stored, incoming = _order_officials(t)
    merged = merge_records(stored, incoming)
    folder = scratch(t)
    rows = _by_state(merged).withColumn("seq", F.lit(0))
    out = jobs.publish_job(rows, folder + "/officials", folder + "/coverage", NOW)
    return out.select("state", "count", F.array_join("cities", ",").alias("cities"))


@query(
    "run_summary",
    """
    SELECT 'officials' AS measure, 'S' || (o_custkey % 5) AS state, count(DISTINCT o_custkey) AS value FROM orders GROUP BY 2
    UNION ALL SELECT 'cities', 'S' || (o_custkey % 5), 1 FROM orders GROUP BY 2
    UNION ALL SELECT 'jurisdictions_attempted', NULL, count(*) FROM supplier UNION ALL SELECT 'pages_failed', NULL, count(*) FROM pages
    """,
)
def run_summary(t):
    merged = _by_state(merge_records(*_order_officials(t))).withColumn("state", writers.shard_state())
    return writers.run_summary(merged, t.supplier, t.pages)


@query("gazetteer_file", "SELECT 'nation_' || c_nationkey AS usps, c_mktsegment AS name, lpad(c_custkey::VARCHAR, 7, '0') AS geoid FROM customer")
def gazetteer_file(t):
    """Pipe-delimited file with padded cells and blank lines, written and read back."""
    path = scratch(t) + "/gaz"
    padded = t.customer.select(
        F.concat(F.lit(" nation_"), "c_nationkey").alias("USPS "), F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("GEOID"),
        F.concat("c_mktsegment", F.lit("  ")).alias(" NAME"),
    )
    blank = t.customer.select(*[F.lit("  ").alias(c) for c in padded.columns])
    padded.unionByName(blank).write.option("sep", "|").option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    rows = readers.read_gazetteer(t.spark, path)
    return rows.select(F.col("USPS").alias("usps"), F.col("NAME").alias("name"), F.col("GEOID").alias("geoid"))


# --- discovery ------------------------------------------------------------------------------

# Documents as pages of sites of 40. Two candidates, a city and a county, share each site; its start page is known by
# an address that redirects. Page 0 lists nobody, page 1 three people on even sites, page 2 seven on every third one.


def _discovery(t):
    d = t.documents.select(F.floor(F.col("doc_id") / 40).alias("g"), (F.col("doc_id") % 40).alias("i"))
    g, i = F.col("g"), F.col("i")
    site = F.concat(F.lit("https://s"), g, F.lit(".gov/"))
    asked = F.concat(F.lit("http://s"), g, F.lit(".gov"))
    address = F.when(i == 0, site).otherwise(F.concat(site, i))
    words = F.when(g % 5 != 4, F.concat(F.lit("City of town"), g, F.lit(" and land"), g, F.lit(" county council")))
    pages = d.select(F.when(i == 0, asked).otherwise(address).alias("url"), address.alias("final_url"), F.lit(True).alias("ok"), F.coalesce(words, F.lit("parked")).alias("text"))
    links = d.filter("i = 0").select(address.alias("url"), F.posexplode(F.array(F.concat(site, F.lit("1")), F.concat(site, F.lit("2")))).alias("pos", "link"))
    most = F.when((i == 1) & (g % 2 == 0), 3).when((i == 2) & (g % 3 == 0), 7).otherwise(0)
    people = d.select("g", "i", address.alias("url"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(6)), lambda k: k < most)).alias("k"))
    fields = {"name": F.concat(F.lit("P"), i, F.lit(" "), F.col("k")), "office": F.lit("Mayor")}
    raw = F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_OFFICIAL])
    officials = people.select("url", raw.alias("raw"))
    both = d.filter("i = 0").select("g", F.explode(F.array(F.lit("local"), F.lit("county"))).alias("level"))
    city = F.when(F.col("level") == "local", F.concat(F.lit("Town"), g)).otherwise(F.concat(F.lit("Land"), g))
    candidates = both.select("g", jurisdiction_key(F.lit("TX"), city, "level").alias("key"), city.alias("city"), F.lit("TX").alias("state"), "level", (g * 10).cast("bigint").alias("population"))
    sites = candidates.select(F.col("key").alias("group"), "city", asked.alias("recalled"), F.array().cast("array<string>").alias("hits"))
    errors = candidates.filter((g % 7 == 3) & (F.col("level") == "local")).select("key", F.lit("extraction failed").alias("error"))
    old = candidates.select(
        F.explode(F.array("key", F.concat(F.lit("old-"), "key"))).alias("key"), "city", "state", "level", "population", F.lit("2026-01-01").alias("checked_at"), F.lit("older").alias("reason"))
    return jobs.discovery_job(candidates.drop("g"), sites, pages, links, officials, old, NOW, errors=errors)


_DISCOVERY_SQL = """
    WITH c AS (SELECT g, level, CASE level WHEN 'local' THEN 'Town' ELSE 'Land' END || g AS city, g % 7 = 3 AND level = 'local' AS broken FROM (SELECT DISTINCT doc_id // 40 AS g FROM documents), (SELECT unnest(['local', 'county']) AS level)),
    s AS (SELECT *, CASE WHEN broken THEN 'extraction failed' WHEN g % 5 = 4 THEN 'no site found' WHEN g % 2 <> 0 AND g % 3 <> 0 THEN 'roster page not found' END AS reason FROM c)
"""


@query(
    "discovery_hits",
    _DISCOVERY_SQL + """
    SELECT city, state, level, 'https://s' || g || '.gov/2' AS roster_url FROM (SELECT *, 'TX' AS state FROM s) WHERE reason IS NULL
    """,
)
def discovery_hits(t):
    return _discovery(t).hits.select("city", "state", "level", F.array_join("urls", ",").alias("roster_url"))


@query(
    "discovery_misses",
    _DISCOVERY_SQL + """
    SELECT city, level, g * 10 AS population, reason, substr(checked_at, 1, 10) AS checked_at FROM (
      SELECT city, level, g, reason, {now} AS checked_at FROM s WHERE reason IS NOT NULL UNION ALL SELECT city, level, g, 'older', '2026-01-01' FROM s)
    """.replace("{now}", f"'{NOW}'"),
)
def discovery_misses(t):
    return _discovery(t).misses.select("city", "level", "population", "reason", F.left("checked_at", F.lit(10)).alias("checked_at"))


@query(
    "discovery_officials",
    _DISCOVERY_SQL + """
    , p AS (SELECT 1 AS i, unnest(range(3)) AS k UNION ALL SELECT 2, unnest(range(7)))
    SELECT 'tx:' || lower(city) || ':mayor:p' || i || '-' || k AS id, 'https://s' || g || '.gov/' || i AS source_url, 'P' || i || ' ' || k AS name, level
    FROM s, p WHERE reason IS NULL AND ((i = 1 AND g % 2 = 0) OR (i = 2 AND g % 3 = 0))
    """,
)
def discovery_officials(t):
    return _discovery(t).officials.select("id", "source_url", "name", "level")


# --- other jobs -----------------------------------------------------------------------------


@query(
    "collapse_run",
    f"SELECT DISTINCT {s_id(chr(39) + 'TX' + chr(39), chr(39) + 'C' + chr(39) + ' || o_custkey', chr(39) + 'Councilmember' + chr(39), chr(39) + 'José Pat Vela' + chr(39))} AS id FROM orders",
)
def collapse_run(t):
    rows, _ = jobs.collapse_job(_duplicates(t))
    return rows.select("id")


@query(
    "universe_run",
    """
    WITH place AS (SELECT n_name AS state, lpad((c_custkey % 100)::VARCHAR, 2, '0') || lpad((c_custkey // 100)::VARCHAR, 5, '0') AS geoid, c_custkey % 6 <> 0 AS active FROM customer JOIN nation ON c_nationkey = n_nationkey),
    pop AS (SELECT DISTINCT lpad((o_custkey % 100)::VARCHAR, 2, '0') || lpad((o_custkey // 100)::VARCHAR, 5, '0') AS geoid FROM orders WHERE o_orderkey % 13 <> 0),
    cpop AS (SELECT DISTINCT lpad((o_custkey % 100)::VARCHAR, 2, '0') || lpad((o_custkey // 100)::VARCHAR, 3, '0') AS geoid FROM orders WHERE o_orderkey % 13 <> 0 AND length((o_custkey // 100)::VARCHAR) <= 3),
    u AS (SELECT state, 'local' AS level, pop.geoid IS NOT NULL AS hit FROM place LEFT JOIN pop USING (geoid) WHERE active UNION ALL SELECT state, 'county', cpop.geoid IS NOT NULL FROM place LEFT JOIN cpop USING (geoid))
    SELECT state, level, count(*) AS total, sum(hit::INT)::BIGINT AS matched FROM u GROUP BY 1, 2
    """,
)
def universe_run(t):
    counties = _population(t).withColumnRenamed("Place", "COUNTY")
    _, metrics, _ = jobs.universe_job(_places(t), _places(t), _population(t), counties)
    return metrics.select("state", "level", "total", "matched")


@query(
    "federal_run",
    "SELECT 'B' || s_suppkey AS bioguide, CASE WHEN s_suppkey % 7 <> 0 THEN '2027-01-03' END AS term_start FROM supplier WHERE s_suppkey % 11 <> 0",
)
def federal_run(t):
    return jobs.federal_job(_legislators(t), _committees(t), _membership(t), _district_entries(t)).select("bioguide", "term_start")


@query(
    "lookup_run",
    """
    WITH o AS (SELECT s_suppkey, 'R' || n_regionkey AS st, n_nationkey AS nk, s_suppkey % 2 AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    q AS (SELECT c_custkey AS request_id, 'R' || (c_custkey % 5) AS st, c_nationkey AS place, c_custkey % 25 AS county FROM customer),
    loc AS (SELECT request_id FROM q JOIN o ON q.st = o.st AND ((kind = 0 AND nk = place) OR (kind = 1 AND nk = county))),
    leg AS (SELECT c_custkey AS request_id FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 5 < 3),
    fed AS (SELECT c_custkey AS request_id, 'Federal' AS g FROM customer UNION ALL SELECT c_custkey, 'State' FROM customer WHERE c_custkey NOT IN (SELECT request_id FROM leg)),
    ex AS (SELECT n_nationkey AS n, n_regionkey AS st FROM nation WHERE n_nationkey % 4 <> 3),
    a AS (SELECT request_id, 'Local' AS g FROM loc UNION ALL SELECT * FROM fed UNION ALL SELECT request_id, 'State' FROM leg UNION ALL SELECT c_custkey, 'State' FROM customer JOIN ex ON c_custkey % 5 = st)
    SELECT request_id, g AS "group", count(*) AS cards FROM a GROUP BY 1, 2
    """,
)
def lookup_run(t):
    return _lookup(t)[0].groupBy("request_id", "group").agg(F.count(F.lit(1)).alias("cards"))


def _lookup(t):
    n, customer = F.col("c_custkey"), t.spread("customer")
    requests = customer.select(
        n.alias("request_id"), F.concat(F.lit("R"), n % 5).alias("state"), F.concat(F.lit("NATION_"), "c_nationkey", F.lit(" city")).alias("place"),
        F.concat(F.lit("Nation "), n % 25, F.lit(" County")).alias("county"),
    )
    s = F.col("s_suppkey")
    place = F.struct(F.concat(F.initcap("n_name"), F.when(s % 2 == 1, F.lit(" County")).otherwise(F.lit(""))).alias("city"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("state"))
    officials = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        *_official(s.cast("string"), s, level=F.when(s % 2 == 1, F.lit("county")).otherwise(F.lit("local")), jurisdiction=place)
    )
    reps = customer.select(
        n.alias("request_id"), F.inline(F.array(
            F.struct(F.lit("B4").alias("id"), F.lit("US House").alias("area")), F.struct(F.lit("S1").alias("id"), F.lit("StateUpper").alias("area")))),
        F.array().cast("array<struct<phone:string,city:string>>").alias("field_offices"),
    )
    m = F.col("s_suppkey")
    handles = F.struct(*[(F.concat(F.lit("t"), m) if k == "twitter" else F.lit(None).cast("string")).alias(k) for k in ("twitter", "facebook", "instagram", "youtube", "youtube_id")])
    social = jobs.social_job(t.supplier.select(F.concat(F.lit("B"), m).alias("bioguide"), handles.alias("social")))
    details = jobs.federal_job(_legislators(t), _committees(t), _membership(t), _district_entries(t))
    people = _people(t)
    legislators = people.withColumn("request_id", F.col("c_custkey")).drop("c_custkey")
    executives = t.nation.select(F.concat(F.lit("R"), "n_regionkey").alias("state"), _executive(F.col("n_nationkey"), F.col("n_name")).alias("person"))
    return jobs.lookup_job(requests, officials, reps, social, details, legislators, executives)


@query(
    "report_triage_run",
    """
    WITH a AS (SELECT event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY ts, event_id) AS n FROM events WHERE event_id % 10 <> 0)
    SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'Duplicate of #' || (event_id % 50) ELSE 'New issue' END AS status_line FROM a WHERE n <= 8
    """,
)
def report_triage_run(t):
    n = F.col("event_id")
    submissions = t.events.select(
        n.alias("seq"), "ts", F.col("user_id").cast("string").alias("ip"), F.when(n % 10 != 0, F.concat(F.lit(" note "), n)).otherwise(F.lit("  ")).alias("note"), F.lit("u").alias("url")
    )
    responses = t.events.select(n.alias("seq"), F.concat(F.lit('{"duplicate_of": '), n % 50, F.lit("}")).alias("response"))
    issues = t.events.select((n % 50).alias("issue")).distinct().filter("issue % 2 = 0")
    return jobs.report_triage_job(submissions, responses, issues).select("seq", "status_line")


@query(
    "reported_links_run",
    """
    SELECT issue, CASE WHEN issue % 3 = 0 THEN 'That host isn''t reachable from here.' WHEN issue % 5 = 0 THEN 'doesn''t look like an official government source' END AS reason
    FROM (SELECT s_suppkey AS issue FROM supplier WHERE s_suppkey % 7 <> 0) WHERE issue % 3 = 0 OR issue % 5 = 0
    """,
)
def reported_links_run(t):
    """Review list of the reported links (the cap on links per run lifted to the whole table)."""
    review = _reported(t)[1]
    return review.select("issue", "reason")


@query(
    "reported_links_staged",
    "SELECT 'https://ok.gov/' || s_suppkey AS source_url, s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0",
)
def reported_links_staged(t):
    return _reported(t)[0].select("source_url", "name")


def _reported(t):
    n = F.col("s_suppkey")
    url = F.when(n % 3 == 0, F.concat(F.lit("http://10.0.0."), n % 250)).otherwise(F.concat(F.lit("https://ok.gov/"), n))
    issues = t.supplier.select(
        n.alias("issue"), F.concat(F.lit("text **Link:** "), url).alias("body"), F.array().cast("array<string>").alias("labels"), (n % 7 == 0).alias("is_pr")
    )
    person = F.struct(F.col("s_name").alias("name"), F.lit("Mayor").alias("office"), F.lit(0.9).alias("confidence"))
    place = F.struct(F.lit("City").alias("city"), F.lit("TX").alias("state"), F.lit(None).cast("string").alias("level"), F.lit("Council").alias("body"))
    body = F.to_json(F.struct((n % 5 != 0).alias("is_government_source"), place.alias("jurisdiction"), F.array(person).alias("officials")))
    responses = t.supplier.select(F.concat(F.lit("https://ok.gov/"), n).alias("url"), body.alias("response"))
    fetches = responses.select("url", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    return jobs.reported_links_job(issues, fetches, responses, NOW, max_links=None)


@query(
    "qa_run",
    """
    WITH s AS (SELECT s_nationkey AS g, s_suppkey AS n FROM supplier),
    c AS (SELECT g, count(*) AS stored_count, sum((n % 10 <> 0)::INT)::BIGINT AS fresh_count, sum((n % 10 = 0)::INT)::BIGINT AS missing FROM s GROUP BY 1)
    SELECT 'https://n' || g || '.gov/' AS source_url, NULL AS issue, stored_count, fresh_count, missing AS missing_from_fresh, 'C' AS city, 'TX' AS state FROM c WHERE missing > 0 AND g % 8 <> 0
    UNION ALL SELECT 'https://n' || g || '.gov/', 'page no longer reachable: HTTP 404', NULL, NULL, NULL, 'C', 'TX' FROM c WHERE g % 8 = 0
    """,
)
def qa_run(t):
    findings, _, _ = _qa(t)
    return findings.select("source_url", "issue", "stored_count", "fresh_count", "missing_from_fresh", "city", "state")


@query(
    "qa_merged",
    """
    WITH s AS (SELECT s_nationkey AS g, s_suppkey AS n FROM supplier), bad AS (SELECT g FROM s GROUP BY g HAVING sum((n % 10 = 0)::INT) > 0 AND g % 8 <> 0)
    SELECT n::VARCHAR AS id, 'N' || n AS name, 'https://n' || g || '.gov/' AS source_url FROM s
    UNION ALL SELECT 'tx:c:?:n' || n, 'n' || n, 'https://n' || g || '.gov/' FROM s WHERE n % 10 <> 0 AND g IN (SELECT g FROM bad)
    """,
)
def qa_merged(t):
    """Fresh officials of pages that disagree, merged into the stored ones."""
    _, merged, _ = _qa(t)
    return merged.select("id", "name", "source_url")


@query(
    "qa_summary",
    """
    WITH c AS (SELECT s_nationkey AS g, sum((s_suppkey % 10 = 0)::INT) AS missing FROM supplier GROUP BY 1), f AS (SELECT g % 8 = 0 AS lost FROM c WHERE g % 8 = 0 OR missing > 0)
    SELECT 'pages_known' AS measure, count(*) AS value, count(*) AS total FROM c UNION ALL SELECT 'pages_checked', count(*), count(*) FROM c
    UNION ALL SELECT 'findings', count(*), count(*) FROM f UNION ALL SELECT 'unreachable', sum(lost::INT)::BIGINT, count(*) FROM f
    """,
)
def qa_summary(t):
    findings, _, fetches = _qa(t)
    pages = t.supplier.select("s_nationkey").distinct()
    return writers.qa_summary(fetches, findings, pages)


@query(
    "coverage_shares",
    """
    WITH d AS (SELECT s_suppkey AS n FROM supplier WHERE s_suppkey % 11 <> 0)
    SELECT 'with_dc_office' AS measure, count(*) FILTER (n % 7 <> 0 AND (n % 3 = 0 OR n % 5 = 0)) AS value, count(*) AS total FROM d
    UNION ALL SELECT 'links_for_review', (SELECT count(*) FROM supplier WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0)), (SELECT count(*) FROM supplier WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0))
    """,
)
def coverage_shares(t):
    details = jobs.federal_job(_legislators(t), _committees(t), _membership(t), _district_entries(t))
    _, review, _ = _reported(t)
    return writers.federal_coverage(details).filter("measure = 'with_dc_office'").unionByName(writers.links_summary(review.limit(0), review).filter("measure = 'links_for_review'"))


def _qa(t):
    n, g = F.col("s_suppkey"), F.col("s_nationkey")
    url = F.concat(F.lit("https://n"), g, F.lit(".gov/"))
    place = F.struct(F.lit("C").alias("city"), F.lit("TX").alias("state"))
    stored = t.supplier.select(*_official(n.cast("string"), n, source_url=url, jurisdiction=place), n.alias("seq"))
    raw = F.struct(*[(F.concat(F.lit(" n"), n) if f.name == "name" else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_OFFICIAL])
    fresh = t.supplier.filter(n % 10 != 0).select(url.alias("source_url"), raw.alias("raw"), n.alias("seq"))
    fetches = t.supplier.select(url.alias("source_url"), (g % 8 != 0).alias("ok"), F.lit("HTTP 404").alias("error")).distinct()
    findings, merged = jobs.qa_job(stored, fetches, fresh, NOW)
    return findings, merged, fetches


@query(
    "promote_run",
    "SELECT c_mktsegment || (c_custkey % 50) AS city, min(c_custkey) AS first_entry FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1",
)
def promote_run(t):
    n = F.col("c_custkey")
    place = F.struct(F.concat(F.col("c_mktsegment"), n % 50).alias("city"), F.lit("TX").alias("state"))
    person = F.struct(*_official(n.cast("string"), n, jurisdiction=place, body=F.lit("X City Council")))
    entries = t.customer.select((n % 3 != 0).alias("ok"), F.array(person).alias("officials"), F.lit("u").alias("source_url"), F.lit("").alias("checked_at"), n.alias("seq"))
    none = t.supplier.select(jurisdiction_key(F.lit("ZZ"), "s_name", F.lit("local")).alias("key"))
    _, officials = jobs.promote_job(entries, none, none, NOW)
    return officials.select("jurisdiction.city", F.col("id").cast("bigint").alias("first_entry"))


# --- whole outputs --------------------------------------------------------------------------


@query(
    "promote_officials",
    """
    SELECT min(c_custkey)::VARCHAR AS id, 'N' || min(c_custkey) AS name, NULL AS office, 'local' AS level, 'X City Council' AS body, NULL AS district, NULL AS confidence, NULL AS phone, NULL AS email, NULL AS url,
      NULL AS photo_url, 'twitter=~,facebook=~,instagram=~,linkedin=~,youtube=~' AS social, NULL AS address, '~' AS offices, NULL AS hours, NULL AS bio, NULL AS bio_checked_at,
      c_mktsegment || (c_custkey % 50) AS city, 'TX' AS state, NULL AS source_url, '2026-08-19T00:00:00Z' AS extracted_at, min(c_custkey) << 32 AS seq
    FROM customer WHERE c_custkey % 3 <> 0 GROUP BY c_mktsegment || (c_custkey % 50)
    """,
)
def promote_officials(t):
    return _whole(jobs.promote_job(*_promotion(t), NOW)[1], "seq").withColumn("offices", F.coalesce("offices", F.lit("~")))


@query(
    "promote_places",
    """
    SELECT c_mktsegment || (c_custkey % 50) AS city, 'TX' AS state, 'local' AS level, 'X City Council' AS body, 'u' AS urls, '{now}' AS discovered_at, 'TX:' || lower(c_mktsegment || (c_custkey % 50)) || ':local' AS key
    FROM customer WHERE c_custkey % 3 <> 0 GROUP BY c_mktsegment || (c_custkey % 50)
    """.replace("{now}", NOW),
)
def promote_places(t):
    return jobs.promote_job(*_promotion(t), NOW)[0].withColumn("urls", F.array_join("urls", ","))


def _promotion(t):
    n = F.col("c_custkey")
    place = F.struct(F.concat(F.col("c_mktsegment"), n % 50).alias("city"), F.lit("TX").alias("state"))
    person = F.struct(*_official(n.cast("string"), n, jurisdiction=place, body=F.lit("X City Council")))
    entries = t.customer.select((n % 3 != 0).alias("ok"), F.array(person).alias("officials"), F.lit("u").alias("source_url"), F.lit("").alias("checked_at"), n.alias("seq"))
    none = t.supplier.select(jurisdiction_key(F.lit("ZZ"), "s_name", F.lit("local")).alias("key"))
    return entries, none, none


@query(
    "collapse_whole",
    _DUP_SQL + """
    SELECT id, 'José "Pat" Vela' AS name, CASE WHEN base % 2 = 0 THEN 'Councilmember' ELSE 'City Council Member' END AS office, 'local' AS level, NULL AS body, NULL AS district, NULL AS confidence,
      g.phone, NULL AS email, NULL AS url, NULL AS photo_url, CASE WHEN has_social THEN 'twitter=' || coalesce(g.twitter, '~') || ',facebook=' || coalesce(s.facebook, '~') || ',instagram=' || coalesce(s.instagram, '~')
        || ',linkedin=' || coalesce(s.linkedin, '~') || ',youtube=' || coalesce(s.youtube, '~') ELSE 'twitter=~,facebook=~,instagram=~,linkedin=~,youtube=~' END AS social,
      NULL AS address, CASE WHEN office_phone IS NOT NULL THEN 'm/~/c/~/' || office_phone || '/~/~' ELSE '~' END AS offices, NULL AS hours, g.bio, NULL AS bio_checked_at, 'C' || s.cust AS city, 'TX' AS state, NULL AS source_url,
      strftime(s.at, '%Y-%m-%dT%H:%M:%SZ') AS extracted_at
    FROM g JOIN (
      SELECT {id} AS id, o_custkey AS cust, max(o_orderdate) AS at, {social} FROM orders GROUP BY 1, 2) s USING (id)
    """.replace("{id}", s_id("'TX'", "'C' || o_custkey", "'Councilmember'", "'José Pat Vela'")).replace(
        "{social}", ", ".join(f"arg_max('{k}' || o_orderkey, (o_orderdate, -o_orderkey)) FILTER (o_orderkey % 7 <> 0 AND o_orderkey % {i + 2} = 0) AS {k}" for i, k in enumerate(SOCIAL_KEYS) if i)
    ),
)
def collapse_whole(t):
    rows, _ = jobs.collapse_job(_duplicates(t))
    return _whole(rows).withColumn("offices", F.coalesce("offices", F.lit("~")))


@query(
    "collapse_totals",
    """
    WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT count(*) FILTER (n > 1) AS groups, sum(n - 1)::BIGINT AS removed, sum(n)::BIGINT AS before, count(*) AS after FROM g
    """,
)
def collapse_totals(t):
    return jobs.collapse_job(_duplicates(t))[1]


@query(
    "federal_whole",
    _MEMBER_SQL + """,
    c AS (SELECT bioguide, string_agg(committee_id || '=' || committee || '/' || coalesce(role, ''), ';' ORDER BY n) AS committees FROM j GROUP BY 1),
    r AS (SELECT 'B' || (s_suppkey % 50) AS bioguide, max(s_suppkey) AS n FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 6 <> 0 GROUP BY 1),
    o AS (SELECT bioguide, 'district/' || CASE WHEN n % 2 = 0 THEN 'Hall, ' ELSE '' END || 'S' || n || '/C/~/~/~/~,district/~/' || CASE WHEN n % 3 = 0 THEN 'D' ELSE '~' END || '/Elm/~/~/~' AS offices FROM r)
    SELECT 'B' || s_suppkey AS bioguide, CASE WHEN s_suppkey % 7 <> 0 THEN '2027-01-03' END AS term_start, CASE WHEN s_suppkey % 7 <> 0 THEN '2029-01-03' END AS term_end,
      CASE WHEN s_suppkey % 7 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0) THEN 'dc/' || CASE WHEN s_suppkey % 5 = 0 THEN 'Room ' || s_suppkey ELSE 'Washington DC Office' END || '/~/'
        || CASE WHEN s_suppkey % 3 = 0 THEN 'A' || s_suppkey ELSE '~' END || '/~/~/~' ELSE '~' END AS dc_office,
      coalesce(committees, '') AS committees, coalesce(offices, '') AS district_offices, CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS bio, CASE WHEN s_suppkey % 4 = 0 THEN 'enc' END AS bio_source
    FROM supplier LEFT JOIN c ON c.bioguide = 'B' || s_suppkey LEFT JOIN o ON o.bioguide = 'B' || s_suppkey WHERE s_suppkey % 11 <> 0
    """,
)
def federal_whole(t):
    rows = _federal(t)
    office = lambda o: F.concat_ws("/", *[F.coalesce(o[k], F.lit("~")) for k in OFFICE_KEYS])
    lists = F.transform("committees", lambda c: F.concat(c["id"], F.lit("="), c["name"], F.lit("/"), F.coalesce(c["role"], F.lit(""))))
    return rows.select(
        "bioguide", "term_start", "term_end", F.when(F.col("dc_office").isNotNull(), office(F.col("dc_office"))).otherwise(F.lit("~")).alias("dc_office"),
        F.array_join(lists, ";").alias("committees"), F.array_join(F.transform("district_offices", office), ",").alias("district_offices"), "bio", "bio_source",
    )


def _federal(t):
    bios = t.supplier.filter(F.col("s_suppkey") % 4 == 0).select(F.concat(F.lit("B"), "s_suppkey").alias("bioguide"), F.col("s_name").alias("bio"), F.lit("enc").alias("bio_source"))
    return jobs.federal_job(_legislators(t), _committees(t), _membership(t), _district_entries(t), bios)


@query(
    "report_triage_whole",
    """
    WITH a AS (SELECT event_id AS n, ts, user_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id ORDER BY ts, event_id) AS k FROM events WHERE event_id % 10 <> 0)
    SELECT n AS seq, sha256(user_id::VARCHAR)[1:16] AS key, 'note ' || n AS note, 'u' AS url, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN n % 2 = 0 THEN 'Duplicate of #' || (n % 50) ELSE 'New issue' END AS status_line,
      'T' || n || repeat('t', (n % 3 * 150)::INT) AS title, 'd' || n AS cleaned_description, 'note ' || n AS excerpt FROM a WHERE k <= 8
    """,
)
def report_triage_whole(t):
    """Every text of a report, none of them clipped."""
    n = F.col("event_id")
    submissions = t.events.select(
        n.alias("seq"), "ts", F.col("user_id").cast("string").alias("ip"), F.when(n % 10 != 0, F.concat(F.lit(" note "), n)).otherwise(F.lit("  ")).alias("note"), F.lit("u").alias("url")
    )
    title = F.concat(F.lit("T"), n, F.expr("repeat('t', cast(event_id % 3 * 150 as int))"))
    answer = F.to_json(F.struct((n % 50).alias("duplicate_of"), title.alias("title"), F.concat(F.lit("d"), n).alias("cleaned_description")))
    issues = t.events.select((n % 50).alias("issue")).distinct().filter("issue % 2 = 0")
    out = jobs.report_triage_job(submissions, t.events.select(n.alias("seq"), answer.alias("response")), issues, note_length=None, link_length=None, title_length=None)
    return out.select("seq", "key", "note", "url", "day", "status_line", "title", "cleaned_description", "excerpt")


@query(
    "universe_rows",
    "WITH " + _POP + """,
    cpop AS (SELECT lpad((o_custkey % 100)::VARCHAR, 2, '0') || lpad((o_custkey // 100)::VARCHAR, 3, '0') AS geoid, arg_max(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE o_orderkey END, o_orderkey) AS population
      FROM orders WHERE o_orderkey % 13 <> 0 AND length((o_custkey // 100)::VARCHAR) <= 3 GROUP BY 1),
    county AS (SELECT n_name AS state, c_mktsegment || [' city', ' town', '', ' CDP'][(c_custkey % 4) + 1] AS name, lpad((c_custkey % 100)::VARCHAR, 2, '0') || lpad((c_custkey // 100)::VARCHAR, 5, '0') AS geoid
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT state, 'local' AS level, name, place.geoid, raw_name, name <> raw_name AS recognized, population FROM place LEFT JOIN pop USING (geoid)
    UNION ALL SELECT state, 'county', name, county.geoid, name, true, population FROM county LEFT JOIN cpop USING (geoid)
    """,
)
def universe_rows(t):
    counties = _population(t).withColumnRenamed("Place", "COUNTY")
    return jobs.universe_job(_places(t), _places(t), _population(t), counties)[0]


@query(
    "lookup_queue",
    """
    WITH o AS (SELECT 'R' || n_regionkey AS st, n_nationkey AS nk, s_suppkey % 2 AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    q AS (SELECT c_custkey AS request_id, 'R' || (c_custkey % 5) AS st, c_nationkey AS place, c_custkey % 25 AS county FROM customer),
    loc AS (SELECT DISTINCT request_id FROM q JOIN o ON q.st = o.st AND ((kind = 0 AND nk = place) OR (kind = 1 AND nk = county)))
    SELECT request_id, st AS state, 'NATION_' || place || ' city' AS place, 'Nation ' || county || ' County' AS county, st || '/nation-' || place || '-city' AS cache_key FROM q WHERE request_id NOT IN (SELECT request_id FROM loc)
    """,
)
def lookup_queue(t):
    """Requests that no stored official answers, whole, with the key under which an answer will be kept."""
    return _lookup(t)[1]


@query(
    "lookup_cards",
    """
    WITH o AS (SELECT s_suppkey, 'R' || n_regionkey AS st, n_nationkey AS nk, s_suppkey % 2 AS kind, 'r' || n_regionkey AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    q AS (SELECT c_custkey AS request_id, 'R' || (c_custkey % 5) AS st, c_nationkey AS place, c_custkey % 25 AS county FROM customer),
    ex AS (SELECT n_nationkey AS n, n_regionkey AS st, n_name FROM nation WHERE n_nationkey % 4 <> 3)
    SELECT request_id, 0 AS tier, s_suppkey::VARCHAR AS id, 'N' || s_suppkey AS name, 'Local' AS area, 'Local' AS "group", '2026-08-19T00:00:00Z' AS verified_at, 0 AS n_offices FROM q JOIN o ON q.st = o.st AND ((kind = 0 AND nk = place) OR (kind = 1 AND nk = county))
    UNION ALL SELECT c_custkey, 1, 'B4', NULL, 'US House', 'Federal', NULL, {offices} FROM customer
    UNION ALL SELECT c_custkey, 1, 'S1', NULL, 'StateUpper', 'State', NULL, 0 FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 5 >= 3
    UNION ALL SELECT c_custkey, 1, 'p' || c_custkey, c_name, ['StateUpper', 'StateLower', 'StateUpper'][(c_custkey % 5) + 1], 'State', NULL, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE CASE WHEN c_custkey % 3 <> 0 OR c_custkey % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + 1 END
      FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey % 5 < 3
    UNION ALL SELECT c_custkey, 2, 'x' || n, n_name, ['Governor', 'Lieutenant Governor', 'Secretary of State'][(n % 4) + 1], 'State', NULL, 0 FROM customer JOIN ex ON c_custkey % 5 = st
    """.replace("{offices}", "(SELECT count(*) * 2 FROM (SELECT 1 FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 6 <> 0 AND s_suppkey % 50 = 4 LIMIT 1))"),
)
def lookup_cards(t):
    """Every card of every request with what names it; texts of the kinds of cards are compared in the queries of their own."""
    return _lookup(t)[0].select(
        "request_id", "tier", "id", "name", "area", "group", "verified_at", F.coalesce(F.size("offices"), F.lit(0)).alias("n_offices")
    )


# --- measures -------------------------------------------------------------------------------


@query(
    "run_measures",
    _MEMBER_SQL + """,
    d AS (SELECT s_suppkey AS n, 'B' || s_suppkey AS bioguide FROM supplier WHERE s_suppkey % 11 <> 0),
    o AS (SELECT DISTINCT 'B' || (s_suppkey % 50) AS bioguide FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 6 <> 0),
    c AS (SELECT s_nationkey AS g, sum((s_suppkey % 10 = 0)::INT) AS missing FROM supplier GROUP BY 1), f AS (SELECT g % 8 = 0 AS lost FROM c WHERE g % 8 = 0 OR missing > 0),
    l AS (SELECT s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AS good FROM supplier WHERE s_suppkey % 7 <> 0),
    p AS (SELECT page_id % 9 <> 0 AND length(txt) >= 500 AND regexp_matches(txt, {roster}) AS ok FROM (SELECT page_id, {text} AS txt FROM pages)),
    x AS (
      SELECT 'with_district_offices' AS measure, count(*) FILTER (bioguide IN (SELECT bioguide FROM o)) AS value, count(*) AS total FROM d
      UNION ALL SELECT 'with_dc_office', count(*) FILTER (n % 7 <> 0 AND (n % 3 = 0 OR n % 5 = 0)), count(*) FROM d UNION ALL SELECT 'with_committees', count(*) FILTER (bioguide IN (SELECT bioguide FROM j)), count(*) FROM d
      UNION ALL SELECT 'findings', count(*), count(*) FROM f UNION ALL SELECT 'unreachable', count(*) FILTER (lost), count(*) FROM f
      UNION ALL SELECT 'officials_staged', count(*) FILTER (good), count(*) FILTER (good) FROM l UNION ALL SELECT 'links_for_review', count(*) FILTER (NOT good), count(*) FILTER (NOT good) FROM l
      UNION ALL SELECT 'seeds_ok', count(*) FILTER (ok), count(*) FROM p)
    SELECT measure, value, total, way FROM x, (SELECT unnest(['observed', 'counted']) AS way)
    """.replace("{roster}", "'(?i)council ?member|councilmember|city council|mayor|commissioner|alderman|place [0-9]|district [0-9]|precinct [0-9]'").replace("{text}", s_text("html")),
)
def run_measures(t):
    """The measures of four runs, taken while their results are written, and counted again from what was written."""
    folder = scratch(t)
    seen = writers.Observed(t.spark)
    findings, _, _ = _qa(t)
    officials, review, _ = _reported(t)
    pages = t.pages.select(F.col("url").alias("requested_url"), "url", (F.col("page_id") % 9 != 0).alias("ok"), "html", F.lit("HTTP 404").alias("error"))
    seeds = t.pages.select(F.lit("c").alias("city"), F.lit("S").alias("state"), F.array("url").alias("urls"))
    frames = {
        "details": (_federal(t), writers.federal_measures()), "findings": (findings, writers.finding_measures()), "officials": (officials, {"officials_staged": F.lit(True)}),
        "review": (review, {"links_for_review": F.lit(True)}), "seeds": (jobs.seed_probe_job(seeds, pages), writers.seed_measures()),
    }
    for name, (frame, measures) in frames.items():
        seen.watch(frame, **measures).write.parquet(f"{folder}/{name}")
    read = lambda name: t.spark.read.parquet(f"{folder}/{name}")
    counted = writers.federal_coverage(read("details")).unionByName(writers.links_summary(read("officials"), read("review"))).unionByName(writers.seeds_ok(read("seeds")))
    counted = counted.unionByName(writers.shares(read("findings"), **writers.finding_measures()))
    return seen.rows().withColumn("way", F.lit("observed")).unionByName(counted.withColumn("way", F.lit("counted")))
