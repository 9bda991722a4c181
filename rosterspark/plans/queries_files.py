"""Queries that write files of the given tables in the layout of each source or sink and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.operators import universe
from rosterspark.plans.catalog import query
from rosterspark.plans.queries_jobs import scratch
from rosterspark.plans.queries_selection import NOW
from rosterspark.schema import JURISDICTION, OFFICIAL, PERSON, SEARCH_LOG
from rosterspark.sources import readers, writers

#: Entries of one document; a document is one row of the file it stands in, so this bounds it.
EACH = 100


def _entry(schema, **given):
    """A struct of ``schema``, null where nothing is given."""
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _documents(df: DataFrame, number, entry, field: str, path: str) -> None:
    """A file for every ``EACH`` entries: one JSON object with them, in order, under ``field`` (None: a bare array)."""
    rows = df.select(F.floor(number / EACH).alias("file"), number.alias("n"), entry.alias("e"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda r: r["e"])
    whole = rows.groupBy("file").agg(F.to_json(listed if field is None else F.struct(listed.alias(field))).alias("value"))
    whole.repartition("file").write.partitionBy("file").text(path)


@query(
    "shard_files",
    "SELECT 'id' || c_custkey AS id, c_name AS name, c_mktsegment AS phone, 'City' || c_nationkey AS city, 'Desk ' || c_custkey AS office FROM customer",
)
def shard_files(t):
    path, n = scratch(t) + "/shards", F.col("c_custkey")
    person = _entry(
        OFFICIAL, id=F.concat(F.lit("id"), n), name=F.col("c_name"), phone=F.col("c_mktsegment"),
        jurisdiction=F.struct(F.concat(F.lit("City"), F.col("c_nationkey")).alias("city"), F.lit("TX").alias("state")), office=F.concat(F.lit("Desk "), n))
    _documents(t.customer, n, person, "officials", path)
    return readers.read_shards(t.spark, path, names="part-*").select("id", "name", "phone", "jurisdiction.city", "office")


@query(
    "popest_files",
    """
    SELECT lpad((c_nationkey % 100)::VARCHAR, 2, '0') || lpad((c_custkey % 1000)::VARCHAR, 5, '0') AS geoid, arg_max(2 * c_custkey, (c_custkey // 1000, c_custkey)) AS population
    FROM customer GROUP BY 1
    """,
)
def popest_files(t):
    """Comma-delimited files; of an area that stands in several, the file that comes last by name counts."""
    path, n = scratch(t) + "/popest", F.col("c_custkey")
    rows = t.customer.select(
        F.floor(n / 1000).cast("int").alias("file"), n.alias("n"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("STATE"), F.lpad((n % 1000).cast("string"), 5, "0").alias("PLACE"),
        n.alias("POPESTIMATE2022"), (2 * n).alias("POPESTIMATE2023"))
    rows = rows.withColumn("file", F.lpad(F.col("file").cast("string"), 6, "0"))
    rows.repartition("file").sortWithinPartitions("file", "n").drop("n").write.partitionBy("file").option("header", True).csv(path)
    table = readers.read_popest(t.spark, path + "/*")
    return universe.population_by_geoid(table, "PLACE", 5).withColumn("population", F.col("population").cast("bigint"))


@query(
    "jurisdiction_files",
    """
    WITH d AS (SELECT c_custkey AS n, 'City' || c_custkey AS city FROM customer),
    s AS (SELECT s_suppkey * 2 AS n, 'City' || (s_suppkey * 2) AS city FROM supplier)
    SELECT 'TX:' || lower(coalesce(s.city, d.city)) || ':local' AS key, coalesce(s.city, d.city) AS city, CASE WHEN s.n IS NULL THEN 'https://found/' || d.n ELSE 'https://seed/' || s.n END AS url FROM d FULL JOIN s ON d.city = s.city
    """,
)
def jurisdiction_files(t):
    folder = scratch(t)
    place = lambda n, at: _entry(JURISDICTION, city=F.concat(F.lit("City"), n), state=F.lit("TX"), level=F.lit("local"), urls=F.array(F.concat(F.lit(at), n)))
    found, seeds = F.col("c_custkey"), F.col("s_suppkey") * 2
    _documents(t.customer, found, place(found, "https://found/"), "jurisdictions", folder + "/found")
    _documents(t.supplier, seeds, place(seeds, "https://seed/"), "jurisdictions", folder + "/seeds")
    rows = readers.read_jurisdictions(t.spark, folder + "/seeds", folder + "/found")
    return rows.select("key", "city", F.array_join("urls", ",").alias("url"))


@query("people_files", "SELECT 'p' || c_custkey AS id, c_name AS name, c_custkey % 100 AS place, 'OH' AS state FROM customer")
def people_files(t):
    path, n = scratch(t) + "/people", F.col("c_custkey")
    empty = F.struct(F.lit("ocd-jurisdiction/country:us/state:oh/government").alias("id"), F.lit("Ohio").alias("name"), F.lit("state").alias("classification"))
    person = _entry(PERSON, id=F.concat(F.lit("p"), n), name=F.col("c_name"), jurisdiction=empty)
    _documents(t.customer, n, person, "results", path)
    return readers.read_people(t.spark, path).select("person.id", "person.name", F.col("seq").cast("bigint").alias("place"), "state")


@query(
    "federal_files",
    """
    SELECT 'B' || s_suppkey AS bioguide, 'N' || s_name AS committee, 'T' || s_suppkey AS role, s_name AS phone, 'h' || s_suppkey AS twitter FROM supplier
    """,
)
def federal_files(t):
    """Legislators, committees, membership, district offices and social handles, each in its file form."""
    folder, n = scratch(t), F.col("s_suppkey")
    s, b = t.supplier, F.concat(F.lit("B"), F.col("s_suppkey"))
    who = F.struct(b.alias("bioguide"))
    _documents(s, n, F.struct(who.alias("id"), F.array(F.struct(F.lit("2025-01-03").alias("start"))).alias("terms")), None, folder + "/legislators")
    _documents(s, n, F.struct(F.concat(F.lit("C"), n).alias("thomas_id"), F.concat(F.lit("N"), F.col("s_name")).alias("name")), None, folder + "/committees")
    members = s.select(F.to_json(F.create_map(F.concat(F.lit("C"), n), F.array(F.struct(b.alias("bioguide"), F.concat(F.lit("T"), n).alias("title"))))).alias("value"), n.alias("file"))
    members.withColumn("file", F.floor(F.col("file") / EACH)).groupBy("file").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list(F.expr("substring(value, 2, length(value) - 2)")), ","), F.lit("}")).alias("value")
    ).repartition("file").write.partitionBy("file").text(folder + "/membership")
    _documents(s, n, F.struct(who.alias("id"), F.array(F.struct(F.col("s_name").alias("phone"))).alias("offices")), None, folder + "/offices")
    _documents(s, n, F.struct(who.alias("id"), F.struct(F.concat(F.lit("h"), n).alias("twitter")).alias("social")), None, folder + "/social")
    people = readers.read_legislators(t.spark, folder + "/legislators").select("bioguide")
    names = readers.read_committees(t.spark, folder + "/committees").select(F.col("thomas_id").alias("committee_id"), F.col("name").alias("committee"))
    roles = readers.read_membership(t.spark, folder + "/membership").select("committee_id", F.inline("members")).withColumnRenamed("title", "role")
    phones = readers.read_district_offices(t.spark, folder + "/offices").select("bioguide", F.try_element_at("offices", F.lit(1))["phone"].alias("phone"))
    handles = readers.read_social_handles(t.spark, folder + "/social").select("bioguide", "social.twitter")
    out = people.join(roles, "bioguide").join(names, "committee_id").join(phones, "bioguide").join(handles, "bioguide")
    return out.select("bioguide", "committee", "role", "phone", "twitter")


@query(
    "page_fetch_files",
    "SELECT url, html, fmt, page_id % 3 <> 0 AS ok, CASE WHEN fmt = 'json' THEN 200 END AS status FROM pages, (SELECT unnest(['json', 'parquet']) AS fmt)",
)
def page_fetch_files(t):
    """Landed pages as JSON lines with all columns, and as a table that lacks some."""
    folder = scratch(t)
    pages = t.pages.select("url", "html", (F.col("page_id") % 3 != 0).alias("ok"))
    pages.withColumn("status", F.lit(200)).write.json(folder + "/json")
    pages.write.parquet(folder + "/parquet")
    both = [readers.read_page_fetches(t.spark, f"{folder}/{f}", f).withColumn("fmt", F.lit(f)) for f in ("json", "parquet")]
    return both[0].unionByName(both[1]).select("url", "html", "ok", "status", "fmt")


@query("universe_files", "SELECT 's' || c_nationkey AS state, 'local' AS level, c_name AS name, c_custkey AS population FROM customer")
def universe_files(t):
    path = scratch(t) + "/universe"
    rows = t.customer.select(F.concat(F.lit("s"), "c_nationkey").alias("state"), F.lit("local").alias("level"), F.col("c_name").alias("name"), F.col("c_custkey").alias("population"))
    for _ in range(2):  # the second write replaces the first
        writers.write_universe(rows, path)
    return t.spark.read.parquet(path).select("state", "level", "name", "population")


@query("problem_files", f"SELECT url, 'HTTP ' || page_id AS error, '{NOW}' AS generated_at, kind FROM pages, (SELECT unnest(['problem', 'probe']) AS kind)")
def problem_files(t):
    """Problems and probe reports are appended, run by run."""
    folder = scratch(t)
    rows = t.pages.select("url", F.concat(F.lit("HTTP "), "page_id").alias("error"), (F.col("page_id") % 2).alias("run"))
    for run in (0, 1):
        writers.write_problems(rows.filter(F.col("run") == run).drop("run"), folder + "/problems", NOW)
        writers.write_probe_report(rows.filter(F.col("run") == run).drop("run"), folder + "/probes", NOW)
    read = lambda name, kind: t.spark.read.parquet(f"{folder}/{name}").withColumn("kind", F.lit(kind))
    return read("problems", "problem").unionByName(read("probes", "probe"))


@query("log_files", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS query, count(*) AS n FROM events GROUP BY 1, 2")
def log_files(t):
    """Search log: appended by day, and as JSON lines with broken lines among them."""
    folder = scratch(t)
    entry = _entry(SEARCH_LOG, t=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), query=F.col("event_type"))
    rows = t.events.select(F.inline(F.array(entry)))
    writers.append_log(rows.filter("query < 'm'"), folder + "/log")
    writers.append_log(rows.filter("not query < 'm'"), folder + "/log")
    days = t.spark.read.parquet(folder + "/log").groupBy("day", "query").agg(F.count(F.lit(1)).alias("n"))
    t.events.select(F.explode(F.array(F.to_json(entry), F.lit('{"t": '))).alias("value")).write.text(folder + "/lines")
    lines = readers.read_jsonl_log(t.spark, folder + "/lines").groupBy(F.left("t", F.lit(10)).alias("day"), "query").agg(F.count(F.lit(1)).alias("again"))
    both = days.withColumn("day", F.col("day").cast("string")).join(lines, ["day", "query"])
    return both.filter("n = again").select("day", "query", "n")


@query("report_files", "SELECT event_id AS seq, 'note ' || event_id AS note FROM events")
def report_files(t):
    path = scratch(t) + "/reports"
    rows = t.events.select(F.col("event_id").alias("seq"), F.concat(F.lit("note "), "event_id").alias("note"))
    for part in (0, 1, 2):
        writers.append_reports(rows.filter(F.col("seq") % 3 == part), path)
    return t.spark.read.parquet(path)


@query(
    "sinks_repeated",
    f"""
    SELECT 'problems' AS sink, url AS item, '{NOW}' AS at, 'r' || (page_id % 2) AS run FROM pages UNION ALL SELECT 'probes', url, '{NOW}', 'r' || (page_id % 2) FROM pages
    UNION ALL SELECT 'log', event_type || event_id, strftime(ts, '%Y-%m-%d'), 'r' || (event_id % 2) FROM events UNION ALL SELECT 'reports', event_id::VARCHAR, '', 'r' || (event_id % 2) FROM events
    """,
)
def sinks_repeated(t):
    """Two runs of every append table; each is tried twice, the first time with only a part of its rows, and leaves them once."""
    folder = scratch(t)
    pages = t.pages.select("page_id", "url", F.lit("HTTP 500").alias("error"))
    events = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.concat("event_type", "event_id").alias("query"))
    for run, part in ((0, 3), (1, 1), (0, 1), (1, 1)):
        name = f"r{run}"
        some = lambda df, key: df.filter((F.col(key) % 2 == run) & (F.col(key) % part == 0)).drop(key)  # noqa: B023,E731
        writers.write_problems(some(pages, "page_id"), folder + "/problems", NOW, name)
        writers.write_probe_report(some(pages, "page_id"), folder + "/probes", NOW, name)
        writers.append_log(some(events, "event_id"), folder + "/log", name)
        writers.append_reports(some(events.select("event_id", F.col("event_id").alias("seq")), "event_id"), folder + "/reports", name)
    read = lambda sink, item, at: t.spark.read.parquet(f"{folder}/{sink}").select(F.lit(sink).alias("sink"), item.alias("item"), at.cast("string").alias("at"), F.col("run").cast("string").alias("run"))
    return (
        read("problems", F.col("url"), F.col("generated_at")).unionByName(read("probes", F.col("url"), F.col("generated_at")))
        .unionByName(read("log", F.col("query"), F.col("day"))).unionByName(read("reports", F.col("seq").cast("string"), F.lit("")))
    )
