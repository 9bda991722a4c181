"""Plan shapes and hot keys: what must hold when the tables are large."""

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import functions as F
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from rosterspark import session
from rosterspark.plans import jobs
from rosterspark.plans.catalog import QUERIES, Tables
from rosterspark.plans.queries_jobs import _by_state
from rosterspark.plans.queries_records import _order_officials
from rosterspark.plans.queries_tiers import _site_tables
from rosterspark.operators import crawl, limits, records, selection, serve, universe, web
from rosterspark.sources import writers

FOLDER = "/root/testdata/sf0.001"
# Jobs that write or checkpoint while they are built.
ACTING = {
    "qa_run", "qa_merged", "qa_summary", "roster_run", "roster_problems", "roster_detail_queue", "roster_enriched", "site_walk", "discovery_hits", "discovery_misses", "discovery_officials", "shard_upsert", "publish_run", "gazetteer_file", "shard_files", "popest_files", "jurisdiction_files",
    "people_files", "federal_files", "page_fetch_files", "universe_files", "problem_files", "log_files", "report_files",
    "stream_rate_limit", "stream_usage", "stream_cache", "stream_ingest", "stream_search_log", "stream_ttl_lookup", "stream_ttl_refill", "sinks_repeated", "run_measures",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTING))
def test_no_cross_or_nested_loop_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", text)


def tables(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_first_k_per_group_is_cut_before_the_shuffle(spark):
    df = limits.rate_limit(tables(spark, "events"), ["user_id"], seq="event_id")
    text = plan(df)
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Partial")


def test_limits_are_heaps(spark):
    df = selection.newest_log(tables(spark, "events"), ["ts", "event_id"])
    assert "TakeOrderedAndProject" in plan(df)


def test_pages_do_not_shuffle(spark):
    df = web.explode_candidates(web.media_candidates(tables(spark, "pages")), "links")
    assert "Exchange" not in plan(df)


def test_scan_reads_only_what_is_used(spark):
    df = records.latest_per_key(tables(spark, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>", plan(df))


def test_keyed_merges_combine_before_the_shuffle(spark):
    df = records.latest_per_key(tables(spark, "orders"), "o_custkey", "o_orderkey")
    assert "partial_max_by" in plan(df) and plan(df).count("Exchange hashpartitioning") == 1


@pytest.fixture
def hot(spark):
    """Every third event on one key."""
    return tables(spark, "events").withColumn("k", F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("user_id").cast("string")))


def test_hot_key_merges_keep_every_row(spark, hot):
    rows = hot.select("k", F.col("event_id").alias("seq"), F.col("props").alias("phone"), F.col("event_type").alias("office"))
    merged = {r["k"]: r for r in records.merge_fields(rows, "k", "seq", ["phone"], ["office"]).collect()}
    last = rows.filter("k = 'hot'").orderBy(F.col("seq").desc()).first()
    assert merged["hot"]["office"] == last["office"] and len(merged) == rows.select("k").distinct().count()


def test_hot_value_is_spread_by_row(spark, hot):
    rows = hot.select("event_id", F.lit("b").alias("batch"), F.col("k").alias("v"))
    out = records.strip_shared(rows, ["batch"], ["v"], "event_id", threshold=3)
    assert "_salt" in plan(out)
    counts = {r["k"]: r["count"] for r in hot.groupBy("k").count().collect()}
    assert out.count() == rows.count()
    assert out.filter("v is null").count() == sum(n for n in counts.values() if n >= 3)


def test_touched_partitions_are_a_semi_join(spark, hot):
    stored = hot.select("k", "event_id")
    few = writers.touched_only(stored, hot.filter("k = 'hot'").select("k"), "k")
    many = writers.touched_only(stored, hot.select("k"), "k")
    assert "LeftSemi" in plan(few) and "LeftSemi" in plan(many)
    assert many.count() == stored.count() and few.count() == stored.filter("k = 'hot'").count()


def test_large_k_has_the_same_plan(spark, hot):
    big = selection.first_k_per_group(hot.select("k", "event_id"), ["k"], [F.col("event_id").asc()], 1001, "rank")
    assert plan(big).count("Window [") == 1
    want = {(r["k"], r["event_id"]) for r in hot.select("k", "event_id").collect()}
    assert {(r["k"], r["event_id"]) for r in big.collect()} == want
    ranks = [r["rank"] for r in big.filter("k = 'hot'").orderBy("event_id").collect()]
    assert ranks == list(range(1, len(ranks) + 1))


@pytest.mark.parametrize("name", ["reported_links_run", "reported_links_staged"])
def test_no_limit_means_no_single_task(spark, name):
    assert "SinglePartition" not in plan(QUERIES[name](spark, FOLDER))


def test_requests_are_salted_where_a_site_is_hot(spark):
    """A third of all officials on one site, two groups on it: each group gets every one of them."""
    from rosterspark.plans import jobs
    from rosterspark.schema import RAW_OFFICIAL

    hot_site = F.when(F.col("event_id") % 3 == 0, F.lit("https://hot.gov/")).otherwise(F.concat(F.lit("https://s"), F.col("event_id"), F.lit(".gov/")))
    given = {"name": F.concat(F.lit("P "), "event_id"), "office": F.lit("Mayor")}
    raw = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_OFFICIAL.fields])
    officials = tables(spark, "events").select(hot_site.alias("url"), raw.alias("raw"))
    candidates = spark.createDataFrame([(f"TX:{c}:local", c, "TX", "local", 5) for c in ("Alma", "Birk")], "key string, city string, state string, level string, population long")
    sites = candidates.select(F.col("key").alias("group"), "city", F.lit("https://hot.gov/").alias("recalled"), F.array().cast("array<string>").alias("hits"))
    pages = spark.createDataFrame([("https://hot.gov/", "https://hot.gov/", True, "Alma and Birk city council")], "url string, final_url string, ok boolean, text string")
    links = spark.createDataFrame([], "url string, pos int, link string")
    none = candidates.limit(0).select("key", "city", "state", "level", "population", F.lit("").alias("checked_at"), F.lit("").alias("reason"))
    found = jobs.discovery_job(candidates, sites, pages, links, officials, none, "2026-08-19T00:00:00Z")
    each = officials.where("url = 'https://hot.gov/'").count()
    assert {r["key"]: r["urls"] for r in found.hits.collect()} == {k: ["https://hot.gov/"] for k in ("TX:Alma:local", "TX:Birk:local")}
    assert found.officials.groupBy("group").count().select("count").distinct().collect() == [(each,)] and found.misses.count() == 0


def test_a_hot_place_is_split_when_requests_meet_officials(spark):
    """A third of the requests and of the officials on one key: every pair is there, and Spark deals the key over tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        n = F.col("id")
        place = F.when(n % 3 == 0, F.lit("Hot")).otherwise(F.concat(F.lit("Town"), n % 997))
        requests = spark.range(90_000).select(n.alias("request_id"), F.lit("TX").alias("state"), place.alias("place"), F.lit(None).cast("string").alias("county")).repartition(8)
        some = F.when(n < 30, F.lit("Hot")).otherwise(F.concat(F.lit("Town"), n))
        officials = spark.range(1000).select(n.alias("official"), F.lit("TX").alias("state"), F.lit("local").alias("level"), some.alias("city")).repartition(8)
        joined = serve.match_local(serve.match_keys(requests), officials)
        folder = tempfile.mkdtemp(prefix="hot-") + "/out"
        joined.write.parquet(folder)
        assert spark.read.parquet(folder).groupBy().agg(F.count_if(F.col("city") == "Hot"), F.count(F.lit(1))).first() == (30 * 30_000, 30 * 30_000 + sum(1 for i in range(90_000) if i % 3 and i % 997 >= 30))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_only_matched_keys_decide_the_queue(spark):
    """Officials of one place don't multiply the requests that are looked for; the queue of the job is built that way."""
    n = F.col("id")
    requests = spark.range(20).select(n.alias("request_id"), F.lit("TX").alias("state"), F.when(n % 2 == 0, F.lit("Hot city")).otherwise(F.lit("Cold")).alias("place"), F.when(n == 3, F.lit("Hot County")).alias("county"))
    officials = spark.range(3000).select(n.alias("official"), F.lit("TX").alias("state"), F.when(n % 2 == 0, F.lit("local")).otherwise(F.lit("county")).alias("level"), F.lit("Hot").alias("city"))
    met = serve.match_local(serve.match_keys(requests), officials, how="left_semi")
    assert met.columns == ["request_id"] and sorted(r[0] for r in met.collect()) == sorted([*range(0, 20, 2), 3])
    assert sorted(r[0] for r in serve.unmatched(requests, met).select("request_id").collect()) == [x for x in range(1, 20, 2) if x != 3]
    for name in ("unmatched_requests", "lookup_queue"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert not re.search(r"_name#\d+\], Inner", text) and re.search(r"_name#\d+\], LeftSemi", text), name


def test_small_requests_meet_officials_in_many_tasks(spark):
    """Few bytes can make very many pairs: neither side is broadcast, and the requests of one place lie on many keys."""
    n = F.col("id")
    requests = spark.range(400).select(n.alias("request_id"), F.lit("TX").alias("state"), F.lit("Hot").alias("place"), F.lit(None).cast("string").alias("county"))
    officials = spark.range(50).select(n.alias("official"), F.lit("TX").alias("state"), F.lit("local").alias("level"), F.lit("Hot").alias("city"))
    joined = serve.match_local(serve.match_keys(requests), officials)
    text = plan(joined)
    assert "SortMergeJoin" in text and "_salt" in text and "Broadcast" not in text
    assert joined.columns == ["request_id", "official", "state", "level", "city"]
    assert joined.distinct().count() == joined.count() == 400 * 50


def test_lists_of_requests_meet_officials(spark):
    """The same pairs as row by row, with ids that repeat or are null, and far smaller files of them."""
    n = F.col("id")
    ids = F.when(n % 10 != 0, n - n % 3)
    requests = spark.range(4000).select(ids.alias("request_id"), F.lit("TX").alias("state"), F.when(n < 3900, F.lit("Hot")).otherwise(F.concat(F.lit("Town"), n % 7)).alias("place"), F.lit("Hot").alias("county"))
    officials = spark.range(1001).select(n.alias("official"), F.lit("TX").alias("state"), F.when(n == 5, F.lit("county")).otherwise(F.lit("local")).alias("level"), F.when(n > 9, F.lit("Hot")).otherwise(F.concat(F.lit("Town"), n % 5)).alias("city"))
    officials = officials.unionByName(officials.filter("official = 3"))
    sizes, counts = {}, {}
    for tile in (None, serve.MATCH_TILE, 8):
        joined = serve.match_local(serve.match_keys(requests), officials, tile=tile)
        assert joined.columns == ["request_id", "official", "state", "level", "city"]
        folder = tempfile.mkdtemp(prefix="lists-") + "/out"
        joined.select("request_id", "official").write.parquet(folder)
        sizes[tile] = sum(p.stat().st_size for p in Path(folder).glob("*.parquet"))
        pairs = spark.read.parquet(folder).groupBy("request_id", "official").agg(F.count(F.lit(1)).alias("n"))
        counts[tile] = pairs.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.xxhash64("request_id", "official", "n").cast("decimal(38,0)"))).first()
    assert counts[None] == counts[serve.MATCH_TILE] == counts[8] and counts[None][1] > 3900 * 990
    assert sizes[serve.MATCH_TILE] < 0.7 * sizes[None], sizes
    with pytest.raises(ValueError):
        serve.match_local(serve.match_keys(requests), officials, tile=7)
    text = plan(QUERIES["match_local"](spark, FOLDER))
    assert text.index("Generate explode") < text.index("SortMergeJoin") < text.index("collect_list") and "BroadcastNestedLoopJoin" not in text


def test_cards_are_grouped_before_they_meet_requests(spark, monkeypatch):
    """What a card of an official or executive shows is made once, not once for every request that it is shown to."""
    made = []
    monkeypatch.setattr(serve, "grouped_cards", lambda cards, whole=serve.grouped_cards: made.append("request_id" in cards.columns) or whole(cards))
    lookup_job, got = jobs.lookup_job, []
    monkeypatch.setattr(jobs, "lookup_job", lambda *frames: got.append(lookup_job(*frames)) or got[0])
    QUERIES["lookup_cards"](spark, FOLDER)
    assert made == [False, True, False]
    assert got[0][0].columns == ["request_id", *serve.CARD_COLUMNS, "tier", "group", "group_order", "area_label", "low_confidence", "extra_offices"]


def test_pages_are_read_as_text_once(spark, monkeypatch):
    """The inputs of the runs are dealt out before they are made, and no filter by a page's text goes below that."""
    seen = []
    monkeypatch.setattr(jobs, "staged", lambda df: seen.append(df) or df)
    frames = [QUERIES["roster_problems"](spark, FOLDER), *seen]
    for text in map(plan, frames):
        scans = [x for x in text.splitlines() if "REPARTITION_BY_NUM" in x]
        assert scans
        below = text[text.index("REPARTITION_BY_NUM") :]
        assert "script" not in "".join(x for x in below.splitlines() if x.strip(" :+-").startswith("Filter"))


def test_vintages_meet_once(spark):
    """A row of each listed and each probed folder meets, not one of each listing."""
    listing = spark.range(1000).select(F.concat(F.lit('<a href="'), F.lit(2000) + F.col("id") % 5, F.lit('_Gazetteer/">x</a>')).alias("html"))
    probes = spark.range(1000).select((F.lit(2000) + F.col("id") % 3).cast("string").alias("vintage"))
    out = universe.latest_populated_vintage(listing, probes, "F")
    text = plan(out)
    assert text.count("HashAggregate(keys=[vintage") == 4, text
    assert out.collect() == [("2002",)]


def test_triaged_answers_do_not_pass_the_driver(spark):
    """Spark takes the texts of answers for smaller than they are: they must not be broadcast, however small the guess."""
    n = F.col("id")
    submissions = spark.range(50).select(n.alias("seq"), F.current_timestamp().alias("ts"), (n % 9).cast("string").alias("ip"), F.lit("note").alias("note"), F.lit("u").alias("url"))
    responses = spark.range(50).select(n.alias("seq"), F.lit('{"duplicate_of": 2}').alias("response"))
    out = jobs.report_triage_job(submissions, responses, spark.range(4).select(n.alias("issue")))
    joins = [x.strip(" :+-") for x in plan(out).splitlines() if "Join [seq" in x]
    assert joins and all(x.startswith("SortMergeJoin") for x in joins), joins
    assert out.count() == 50 and out.filter("status_line = 'Duplicate of #2'").count() == 50


def test_stored_shards_do_not_move(spark, tmp_path):
    """The merge shuffles and sorts what comes in; stored rows stay in their buckets, and only touched states are read."""
    path = str(tmp_path / "officials")
    stored, incoming = _order_officials(Tables(spark, FOLDER))
    writers.upsert_shards(_by_state(stored).withColumn("seq", F.lit(0)), path, buckets=4)
    table = writers.shard_table(spark, path)
    few = _by_state(incoming).filter("id like '%1'").withColumn("_state", writers.shard_state())
    text = plan(writers.merged_shards(table, few))
    scan = text[: text.index(f"FileScan parquet spark_catalog.default.{table}")]
    above = []  # operators on the way from the scan to the top: lines that stand further left, one by one
    depth = None
    for line in reversed(scan.splitlines()):
        here = len(line) - len(line.lstrip(" :+-"))
        if depth is None or here < depth:
            above.append(line.strip(" :+-"))
            depth = here
    assert any("SortMergeJoin" in x and "FullOuter" in x for x in above)
    assert not any(x.startswith(("Exchange", "ShuffleQueryStage")) for x in above), above
    assert "SelectedBucketsCount: 4 out of 4" in text and "dynamicpruning" in text.lower()


def test_walk_writes_what_is_new_and_leaves_one_table(spark, monkeypatch):
    """Two tables a round, none as large as all rounds before it, and nothing but the walk is left."""
    sizes = []
    write = session._write

    def counted(df, block):
        out = write(df, block)
        sizes.append((out.staged_path, out.count()))
        return out

    monkeypatch.setattr(session, "_write", counted)
    starts, pages, links, officials, hits = _site_tables(Tables(spark, "/root/testdata/sf0.01"))
    walk = crawl.expand_frontier(starts, pages, links, officials, hits)
    groups = starts.count()
    rounds = sizes[5:-1]
    assert 4 <= len(rounds) <= 2 * crawl.FETCH_BUDGET and len(rounds) % 2 == 0
    visits = walk.count()
    assert sum(n for _, n in rounds[::2]) <= visits + walk.agg(F.sum("found_ids")).first()[0] and all(n <= groups * 4 * crawl.FETCH_BUDGET for _, n in rounds)
    left = [p for p, _ in sizes if os.path.exists(p.removeprefix("file://"))]
    assert left == [walk.staged_path]
    session.drop_staged(walk)
    assert not os.path.exists(walk.staged_path.removeprefix("file://"))


def test_staging_blocks(spark):
    df = spark.range(3)
    with session.staging(spark) as outer:
        first = session.staged(df)
        with session.staging(spark) as inner:
            second, kept = session.staged(df), inner.keep(df)
        there = [os.path.exists(x.staged_path.removeprefix("file://")) for x in (first, second, kept)]
        assert there == [True, False, True] and kept.count() == 3 and outer.paths == [first.staged_path, kept.staged_path]
    assert not any(os.path.exists(x.staged_path.removeprefix("file://")) for x in (first, kept))
