"""Readers, writers and streams on small files."""

import json
import threading

from pyspark.sql import functions as F
import pytest

from rosterspark.operators import limits, universe, web
from rosterspark.plans import jobs
from rosterspark.sources import readers, writers
from rosterspark.streaming import streams
from test_values import officials


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def put(folder, name, data):
    text = data if isinstance(data, str) else json.dumps(data)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as out:
        out.write(text)
    return f"{folder}/{name}"


# --- readers --------------------------------------------------------------------------------


def test_shards_leave_the_index_out(spark, folder):
    put(folder, "TX.json", {"state": "TX", "count": 2, "officials": [{"id": "a", "name": "A", "confidence": 1}, {"id": "b", "name": "B", "social": {"twitter": "t"}}]})
    put(folder, "index.json", {"generated_at": "t", "states": {"TX": {"count": 2, "cities": ["X"], "updated": "t"}}})
    rows = {r["id"]: r for r in readers.read_shards(spark, folder).collect()}
    assert sorted(rows) == ["a", "b"] and rows["a"]["social"] is None and rows["b"]["social"]["facebook"] is None
    assert readers.read_coverage(spark, f"{folder}/index.json").first()["cities"] == ["X"]


def test_delimited_files(spark, folder):
    gaz = put(folder, "gaz.txt", "USPS|GEOID | NAME  \nTX|4801| Larkmoor city \n\n   \nTX|4802|\"Q\" town\n")
    rows = readers.read_gazetteer(spark, gaz).orderBy("seq").collect()
    assert [(r["GEOID"], r["NAME"]) for r in rows] == [("4801", "Larkmoor city"), ("4802", '"Q" town')]
    pop = put(folder, "pop.csv", "SUMLEV,STATE,PLACE,POPESTIMATE2020,POPESTIMATE2024\n162,1,124,5,6\n157,01,00124,7,8\n162,01,125,9,\n162,01,126,9,X\n162,01,127,9\n")
    table = universe.population_by_geoid(readers.read_popest(spark, pop), "PLACE", 5)
    assert {r["geoid"]: r["population"] for r in table.collect()} == {"0100124": 8, "0100125": 0}
    kept = universe.population_by_geoid(readers.read_popest(spark, pop), "place", 5, sumlev="162")
    assert {r["geoid"]: r["population"] for r in kept.collect()}["0100124"] == 6


def test_jurisdictions(spark, folder):
    seeds = put(folder, "seeds.json", {"jurisdictions": [{"city": "Quillby", "state": "TX", "level": "local", "urls": ["u1"]}]})
    found = put(folder, "found.json", {"jurisdictions": [{"city": "quillby", "state": "tx", "level": "local", "urls": ["u2"]}, {"city": "Larkmoor", "state": "TX", "urls": []}], "misses": [{"city": "M", "state": "TX", "level": "local", "checked_at": "t"}]})
    rows = readers.read_jurisdictions(spark, seeds, found).orderBy("position").collect()
    assert [(r["city"], r["urls"]) for r in rows] == [("Quillby", ["u1"]), ("Larkmoor", [])]
    assert readers.read_misses(spark, found).first()["key"] == "TX:m:local"
    assert readers.read_jurisdictions(spark, seeds).count() == 1


def test_people_and_congress(spark, folder):
    people = put(folder, "people.json", {"results": [{"id": "p1", "name": "A", "current_role": {"district": 5}, "jurisdiction": {"id": "ocd-jurisdiction/country:us/state:tx/government"}}]})
    row = readers.read_people(spark, people).first()
    assert (row["state"], row["person"]["current_role"]["district"]) == ("TX", "5")
    legislators = put(folder, "leg.json", [{"id": {"bioguide": "B1"}, "terms": [{"start": "2025-01-03", "end": "2027-01-03", "phone": "1"}]}, {"id": {"wikipedia": "x"}}])
    committees = put(folder, "com.json", [{"thomas_id": "A", "name": "Ag", "subcommittees": [{"thomas_id": "01", "name": "F"}]}])
    membership = put(folder, "mem.json", {"A": [{"bioguide": "B1", "title": "Chair"}], "A01": [{"bioguide": "B1"}]})
    offices = put(folder, "off.json", [{"id": {"bioguide": "B1"}, "offices": [{"building": "H", "suite": "2", "city": "Ostrell"}]}])
    handles = put(folder, "soc.json", [{"id": {"bioguide": "B1"}, "social": {"youtube_id": "UC"}}, {"id": {"bioguide": "B2"}, "social": {"facebook": ""}}])
    d = jobs.federal_job(readers.read_legislators(spark, legislators), readers.read_committees(spark, committees), readers.read_membership(spark, membership), readers.read_district_offices(spark, offices)).collect()
    assert len(d) == 1 and d[0]["term_end"] == "2027-01-03" and d[0]["dc_office"]["name"] == "Washington DC Office"
    assert [c["name"] for c in d[0]["committees"]] == ["Ag", "Ag — F"] and d[0]["district_offices"][0]["name"] == "H, 2"
    s = jobs.social_job(readers.read_social_handles(spark, handles)).collect()
    assert [(r["bioguide"], r["social"]["youtube"]) for r in s] == [("B1", "https://youtube.com/channel/UC")]
    reps = put(folder, "reps.json", {"representatives": [{"id": "B1", "area": "US House", "field_offices": [{"phone": "1", "city": "Ostrell"}]}]})
    assert readers.read_reps(spark, reps).first()["field_offices"][0]["city"] == "Ostrell"


def test_log_lines(spark, folder):
    path = put(folder, "log.jsonl", '{"t": "1", "query": "a", "resolved": {"state": "TX"}}\nnot json\n\n{"t": "2", "query": "b"}\n')
    assert sorted((r["t"], r["resolved"] and r["resolved"]["state"]) for r in readers.read_jsonl_log(spark, path).collect()) == [("1", "TX"), ("2", None)]


def test_page_fetches(spark, folder):
    spark.createDataFrame([("u", "<p>")], "url string, html string").write.parquet(folder + "/p")
    row = readers.read_page_fetches(spark, folder + "/p").first()
    assert row["html"] == "<p>" and row["status"] is None


def test_universe_table(spark, folder):
    put(folder, "DE.json", {"state": "DE", "places": [{"name": "B", "population": 5}, {"name": "A"}], "counties": [{"name": "Kent"}]})
    table = readers.read_universe(spark, folder + "/DE.json")
    writers.write_universe(table, folder + "/out")
    assert sorted((r["level"], r["name"], r["population"]) for r in spark.read.parquet(folder + "/out").collect()) == [("county", "Kent", None), ("local", "A", None), ("local", "B", 5)]


# --- writers --------------------------------------------------------------------------------


def test_only_touched_states_change(spark, folder):
    tx, ca = dict(city="A", state="tx"), dict(city="B", state="CA")
    path, index = folder + "/officials", folder + "/index"
    jobs.publish_job(officials(spark, dict(id="t", name="T", phone="1", jurisdiction=tx), dict(id="c", name="C", jurisdiction=ca), dict(id="u", name="U")), path, index, "day1")
    before = {r["state"]: r["f"] for r in spark.read.parquet(path).select("state", F.input_file_name().alias("f")).collect()}
    jobs.publish_job(officials(spark, dict(id="t", name="T2", email="e", jurisdiction=tx), dict(id="t2", name="N", jurisdiction=tx)), path, index, "day2")
    rows = {r["id"]: r for r in readers.read_officials(spark, path).collect()}
    after = {r["state"]: r["f"] for r in spark.read.parquet(path).select("state", F.input_file_name().alias("f")).collect()}
    assert sorted(rows) == ["c", "t", "t2", "u"] and (rows["t"]["name"], rows["t"]["phone"], rows["t"]["email"]) == ("T2", "1", "e")
    assert before["CA"] == after["CA"] and before["TX"] != after["TX"] and rows["u"]["state"] == "US"
    coverage = {r["state"]: (r["count"], r["updated"]) for r in spark.read.parquet(index).collect()}
    assert coverage == {"TX": (2, "day2"), "CA": (1, "day1"), "US": (1, "day1")}


def test_upserts_in_a_session_that_overwrites_whole_tables(spark, folder):
    """Spark's own setting is static: an upsert must still replace only the states that it touches."""
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "static")
        for name, state in [("A", "TX"), ("B", "CA"), ("C", "TX")]:
            writers.upsert_shards(officials(spark, dict(id=f"i{state}", name=name, jurisdiction=dict(city="X", state=state)), dict(id=name, name=name, jurisdiction=dict(city="X", state=state))), folder + "/officials")
        assert sorted((r["id"], r["name"], r["state"]) for r in readers.read_officials(spark, folder + "/officials").collect()) == [("A", "A", "TX"), ("B", "B", "CA"), ("C", "C", "TX"), ("iCA", "B", "CA"), ("iTX", "C", "TX")]
    finally:
        spark.conf.set(key, before)


def test_append_tables(spark, folder):
    problems = spark.createDataFrame([("u", "HTTP 500")], "url string, error string")
    for _ in range(2):
        writers.write_problems(problems, folder + "/problems", "now")
        writers.append_reports(problems, folder + "/reports")
        writers.append_log(spark.createDataFrame([("2026-01-02T00:00:00Z", "q")], "t string, query string"), folder + "/log")
    for name in ("problems", "reports", "log"):
        assert spark.read.parquet(f"{folder}/{name}").count() == 2
    report = jobs.seed_probe_job(
        spark.createDataFrame([("C", "TX", ["https://c.gov/x"])], "city string, state string, urls array<string>"),
        spark.createDataFrame([("https://c.gov", "https://c.gov/", True, '<a href="/council">C</a>', None)], "requested_url string, url string, ok boolean, html string, error string"),
    )
    writers.write_probe_report(report, folder + "/probe", "now")
    row = spark.read.parquet(folder + "/probe").first()
    assert row["status"] == "FAIL (not fetched)" and row["suggestions"][0]["url"] == "https://c.gov/council"
    writers.write_shards_json(officials(spark, dict(id="a", name="A")).withColumn("state", F.lit("TX")), folder + "/json")
    assert spark.read.json(folder + "/json").first()["state"] == "TX"


def test_discovery(spark):
    candidates = spark.createDataFrame([("TX:larkmoor:local", "Larkmoor", "TX", "local"), ("TX:ostrell:local", "Ostrell", "TX", "local")], "key string, city string, state string, level string")
    sites = spark.createDataFrame([("TX:larkmoor:local", "Larkmoor", "https://larkmoor.gov/", []), ("TX:ostrell:local", "Ostrell", None, [])], "group string, city string, recalled string, hits array<string>")
    html = '<a href="/council">Council</a>'
    pages = spark.createDataFrame([("https://larkmoor.gov/", "https://larkmoor.gov/", True, "City of Larkmoor", html), ("https://larkmoor.gov/council", "https://larkmoor.gov/council", True, "x", "")], "url string, final_url string, ok boolean, text string, html string")
    links = web.explode_candidates(web.suggest_links(pages.select(F.col("final_url").alias("url"), "html")), "suggestions")
    links = pages.select(F.col("final_url").alias("url"), "html")
    links = web.suggest_links(links).select("url", F.posexplode("suggestions").alias("pos", "s")).select("url", "pos", F.col("s.url").alias("link"))
    from rosterspark.schema import RAW_OFFICIAL
    from pyspark.sql import types as P

    raw = spark.createDataFrame([("https://larkmoor.gov/council", {f.name: "Ann" if f.name == "name" else None for f in RAW_OFFICIAL})], P.StructType([P.StructField("url", P.StringType()), P.StructField("raw", RAW_OFFICIAL)]))
    old = spark.createDataFrame([("TX:larkmoor:local", "Larkmoor", "TX", "local", "t0", "r"), ("TX:x:local", "X", "TX", "local", "t0", "r")], "key string, city string, state string, level string, checked_at string, reason string")
    out = jobs.discovery_job(candidates, sites, pages, links, raw, old, "now")
    assert [(r["city"], r["body"], r["urls"]) for r in out.hits.collect()] == [("Larkmoor", "Larkmoor City Council", ["https://larkmoor.gov/council"])]
    assert sorted((r["city"], r["reason"]) for r in out.misses.collect()) == [("Ostrell", "no site found"), ("X", "r")]
    assert [r["id"] for r in out.officials.collect()] == ["tx:larkmoor:?:ann"]


# --- streams --------------------------------------------------------------------------------


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


@pytest.fixture
def events(spark, folder):
    """Events split into files, read one file per batch."""
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = folder + "/src"
    for lo in (0, 400, 800):
        df.filter((F.col("event_id") >= lo) & (F.col("event_id") < (lo + 400 if lo < 800 else 10**9))).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    return df, stream


def test_rate_limit_stream_equals_batch(spark, folder, events):
    batch, stream = events
    write = streams.rate_limit_batch(folder + "/accepted", ["user_id"], seq="event_id", per_day=3)
    run(stream.writeStream.foreachBatch(write).option("checkpointLocation", folder + "/cp"))
    got = {r["event_id"] for r in spark.read.parquet(folder + "/accepted").collect()}
    want = {r["event_id"] for r in limits.rate_limit(batch, ["user_id"], seq="event_id", per_day=3).collect()}
    assert got == want


def test_stateful_rate_limit_equals_batch(spark, folder):
    """Deliveries in order of time, a restart after each; counters of closed days leave the state."""
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    hot = df.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id").cast("int"))).withColumnRenamed("props", "index")
    first, last = hot.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    for part in range(4):
        hot.filter(F.floor((F.unix_seconds("ts") - first) * 4 / (last - first + 1)) == part).repartition(3).write.mode("append").parquet(folder + "/src")
        stream = spark.readStream.schema(hot.schema).parquet(folder + "/src")
        query = streams.rate_limit_stream(stream, ["user_id"], seq="event_id", per_day=3).writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1]
    rows = spark.read.parquet(folder + "/out")
    assert rows.columns == hot.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, limits.rate_limit(hot, ["user_id"], seq="event_id", per_day=3).select(*hot.columns).collect()))
    assert state < limits.rate_limit(hot, ["user_id"], seq="event_id", per_day=3).select("day", "user_id").distinct().count()


def test_counters_of_many_keys_share_rows_of_state(spark, folder):
    """State has a row a day and bucket, not one a key; null keys, many rows of a key and several Arrow batches of a bucket count as before."""
    n = F.col("id")
    rows = spark.range(40_000).select(
        n.alias("event_id"), F.timestamp_seconds(1_767_225_600 + n * 4).alias("ts"), F.when(n % 3 != 0, n % 9_000).alias("user_id"), F.when(n % 2 == 0, F.lit("a")).alias("kind")
    )
    for part in range(2):
        rows.filter(F.floor(n / 20_000) == part).repartition(2).write.mode("append").parquet(folder + "/src")
        stream = spark.readStream.schema(rows.schema).parquet(folder + "/src")
        accepted = streams.rate_limit_stream(stream, ["user_id", "kind"], seq="event_id", per_day=2, buckets=1)
        query = accepted.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert max(states) <= 2, states
    got = [r["event_id"] for r in spark.read.parquet(folder + "/out").collect()]
    want = [r["event_id"] for r in limits.rate_limit(rows, ["user_id", "kind"], seq="event_id", per_day=2).collect()]
    assert sorted(got) == sorted(want) and len(set(want)) > 20_000


def test_repeated_batch_changes_nothing(spark, folder, events):
    batch, _ = events
    write = streams.rate_limit_batch(folder + "/accepted", ["user_id"], seq="event_id", per_day=3)
    for batch_id in (0, 1, 1):
        write(batch.filter(F.col("event_id") % 2 == batch_id), batch_id)
    day_user = spark.read.parquet(folder + "/accepted").groupBy("day", "user_id").count()
    assert day_user.agg(F.max("count")).first()[0] == 3


def test_ledger_stream_equals_batch(spark, folder, events):
    batch, stream = events
    calls = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("phase"), F.lit(1).cast("bigint").alias("n"))
    name = f"ledger_{threading.get_ident()}"
    run(streams.usage_ledger_stream(calls(stream), late="60 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", folder + "/cp"))
    got = {(r["date"], r["phase"]): r["n"] for r in spark.table(name).collect()}
    want = {(r["date"], p): n for r in limits.usage_by_day(calls(batch)).collect() for p, n in r["by_phase"].items()}
    assert got == want


def test_search_log_stream(spark, folder):
    put(folder, "a.json", '{"t": "1", "query": "  Quillby ", "geo": {"state": "TX", "lat": 1.0}}\n{"t": "2", "query": " "}\n')
    raw = spark.readStream.schema("t string, query string, typed string, geo struct<state:string,county:string,place:string,lat:double>").json(folder + "/a.json*")
    run(streams.search_log_stream(raw, folder + "/log", folder + "/cp"))
    rows = spark.read.parquet(folder + "/log").collect()
    assert [(r["query"], r["typed"], r["resolved"]["state"]) for r in rows] == [("Quillby", None, "TX")]


def test_cache_refill_and_ttl_stream(spark, folder, events):
    batch, stream = events
    entry = lambda df: df.select(F.col("user_id").cast("string").alias("key"), (F.col("event_type") != "error").alias("ok"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("checked_at"), F.col("event_id").alias("seq"))
    run(entry(stream).writeStream.foreachBatch(streams.cache_refill_batch(folder + "/cache", buckets=4)).option("checkpointLocation", folder + "/cp"))
    got = {r["key"]: (r["ok"], r["checked_at"]) for r in spark.read.parquet(folder + "/cache").collect()}
    last = {}
    for r in entry(batch).orderBy("seq").collect():
        last[r["key"]] = (r["ok"], r["checked_at"])
    assert got == last
    cache = spark.read.parquet(folder + "/cache").select("key", "ok", "checked_at")
    asked = stream.select(F.col("user_id").cast("string").alias("key"), "event_id")
    name = f"ttl_{threading.get_ident()}"
    run(streams.ttl_lookup_stream(asked, cache, ["key"], "2024-02-01T00:00:00Z").writeStream.format("memory").queryName(name).option("checkpointLocation", folder + "/cp2"))
    assert spark.table(name).count() == batch.count() and spark.table(name).filter("source = 'cache'").count() > 0


def test_lookup_sees_refills_and_ages(spark, folder):
    """Answers change as the cache is filled and grows old; a repeated batch replaces its own answers."""
    cache, out = folder + "/cache", folder + "/out"
    lookup = streams.ttl_lookup_batch(cache, out, ["key"], at="at", buckets=4)
    refill = streams.cache_refill_batch(cache, buckets=4)
    ask = lambda at: spark.createDataFrame([("a", at), ("b", at), ("c", at)], "key string, at string")
    put = lambda *rows: spark.createDataFrame(rows, "key string, ok boolean, checked_at string, seq long")
    lookup(ask("2026-01-01T00:00:00Z"), 0)
    refill(put(("a", True, "2026-01-01T00:00:00Z", 1), ("b", False, "2026-01-01T00:00:00Z", 2)), 0)
    for _ in range(2):
        lookup(ask("2026-01-02T00:00:00Z"), 1)
    lookup(ask("2026-01-09T00:00:00Z"), 2)
    refill(put(("b", True, "2026-01-09T00:00:00Z", 3)), 1)
    lookup(ask("2026-04-01T00:00:00Z"), 3)
    rows = spark.read.parquet(out).orderBy("batch_id", "key").collect()
    got = ["".join({"absent": "-", "cache": "h", "cache-miss": "m"}[r["source"]] for r in rows if r["batch_id"] == b) for b in range(4)]
    assert got == ["---", "hm-", "h--", "-h-"]


def test_ingest_stream(spark, folder, events):
    _, stream = events
    from rosterspark.plans.queries_records import _official

    n = F.col("event_id")
    rows = stream.select(*_official(F.concat(F.lit("u"), "user_id"), n, phone=F.concat(F.lit("p"), n)), n.alias("seq"))
    run(rows.writeStream.foreachBatch(streams.ingest_officials_batch(folder + "/officials")).option("checkpointLocation", folder + "/cp"))
    got = {r["id"]: r["phone"] for r in spark.read.parquet(folder + "/officials").collect()}
    want = {f"u{r['user_id']}": f"p{r['m']}" for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    assert got == want
