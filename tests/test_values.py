"""Literal-value tests of the rules, with the odd cases spelled out."""

import re
import time

from pyspark.sql import functions as F
import pytest

from rosterspark.functions import html as H
from rosterspark.functions import offices as O
from rosterspark.functions import text as T
from rosterspark.functions.urls import absolutize, check_submission_url
from rosterspark.operators import crawl, extraction, limits, records, selection, serve, tiers, universe, web
from rosterspark.schema import OFFICE, OFFICIAL, RAW_OFFICIAL, SOCIAL_KEYS


def one(spark, column, *values, names="abcdef"):
    df = spark.createDataFrame([tuple(values) or ("x",)], ", ".join(f"{n} string" for n in names[: max(len(values), 1)]))
    return df.select(column.alias("v")).first()["v"]


def column(spark, expr, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, a string")
    return [r["v"] for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def official(**kw):
    social = kw.pop("social", None)
    offices = kw.pop("offices", None)
    row = {f.name: None for f in OFFICIAL} | kw
    row["social"] = None if social is None else {k: social.get(k) for k in SOCIAL_KEYS}
    row["offices"] = None if offices is None else [{f.name: o.get(f.name) for f in OFFICE} for o in offices]
    return row


def officials(spark, *rows):
    from pyspark.sql import types as P

    schema = P.StructType(OFFICIAL.fields + [P.StructField("seq", P.LongType())])
    return spark.createDataFrame([official(**r) | {"seq": r.get("seq", i)} for i, r in enumerate(rows)], schema)


# --- contact fields and ids -----------------------------------------------------------------


def test_phone(spark):
    given = ["(512) 555-1234", "1-512-555-1234", "2-512-555-1234", "", None, "  ext 5  ", "   "]
    assert column(spark, T.clean_phone("a"), given) == ["512-555-1234", "512-555-1234", "2-512-555-1234", None, None, "ext 5", ""]


def test_email(spark):
    given = [" a@b.gov ", "https://x.gov/email/1", "a@b", "a b@c.d", "", None]
    assert column(spark, T.clean_email("a"), given) == ["a@b.gov", None, None, None, None, None]


def test_ids_agree_across_quotes_and_titles(spark):
    ids = [
        one(spark, T.build_id("a", "b", "c", "d"), "QQ", "Lowmere", office, name)
        for office, name in [
            ("City Council Member", "Zoë “Pim” Harl"), ("Council Member", "Zoë 'Pim' Harl"),
            ("Councilmember", 'Zoë "Pim"  Harl '), ("City  Councilmember", "Zoë Pim Harl"),
        ]
    ]
    assert set(ids) == {"qq:lowmere:council-member:zoë-pim-harl"}
    assert one(spark, T.build_id("a", F.lit(None).cast("string"), "b", "c"), "TX", "", "A B") == "tx:null:?:a-b"
    assert one(spark, T.canonicalize_office("a"), " Mayor /  Chair ") == "mayor/chair"


def test_places(spark):
    assert column(spark, T.strip_place_suffix("a"), ["Quillby city", "X city (balance)", "Foo CDP", "Bar cdp", "City", "Kansas City city"]) == [
        "Quillby", "X city", "Foo", "Bar", "City", "Kansas City",
    ]
    assert column(spark, T.normalize_place("a"), ["Fennick County", "St. Louis city", None, "Townsend"]) == ["fennick", "st louis", "", "townsend"]
    assert T.expand_states(" tx, ca ,") == ["TX", "CA"] and len(T.expand_states(None)) == 52


def test_excerpt(spark):
    assert one(spark, T.excerpt("a", 5), " ab\n cd  ef ") == "ab cd…"
    assert one(spark, T.excerpt("a", 8), " ab\n cd  ef ") == "ab cd ef"


# --- urls -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("ref", "base", "out"),
    [
        ("/a", "https://h.gov/x/y?z", "https://h.gov/a"), ("../a", "https://h.gov/x/y/z", "https://h.gov/x/a"),
        ("a b", "https://h.gov/x/", "https://h.gov/x/a%20b"), ("?q", "https://h.gov/x#f", "https://h.gov/x?q"),
        ("//o.gov", "http://h.gov", "http://o.gov/"), ("HTTPS://O.GOV:443/%7E", "http://h.gov", "https://o.gov/%7E"),
        ("mailto:a@b.c", "http://h.gov", "mailto:a@b.c"), ("", "http://h.gov", None), ("http://", "http://h.gov", None),
        ("http://a b/", "http://h.gov", None), ("x", "not a base", None), ("http://h:99999/", "http://h.gov", None),
        ("\\a\\b", "http://h.gov/c", "http://h.gov/a/b"), ("#", "http://h.gov/c#d", "http://h.gov/c#"),
    ],
)
def test_absolutize(spark, ref, base, out):
    assert one(spark, absolutize("a", "b"), ref, base) == out


def test_submitted_urls(spark):
    blocked = [
        "http://localhost", "http://a.localhost/", "http://printer.local", "http://127.0.0.1", "http://2130706433/", "http://0x7f.0.0.1/",
        "http://0177.0.0.1", "http://169.254.169.254/latest", "http://[::1]/", "http://[::]/", "http://[fe80::1]/", "http://[fd00::1]",
        "http://[::ffff:10.0.0.1]/", "http://[::ffff:7f00:1]/", "http://100.64.0.1", "http://224.0.0.1", "http://198.51.100.7", "http://203.0.113.9",
    ]
    allowed = ["https://x.gov/a", "http://172.32.0.1/", "http://100.128.0.1/", "http://[2606:4700::1]/", "http://198.20.0.1/"]
    assert column(spark, check_submission_url("a")["ok"], blocked) == [False] * len(blocked)
    assert column(spark, check_submission_url("a")["ok"], allowed) == [True] * len(allowed)
    reasons = column(spark, check_submission_url("a")["reason"], ["", "x" * 2001, "nope", "javascript:alert(1)", "https://u:p@x.gov"])
    assert [r.split()[0] for r in reasons] == ["Enter", "That", "That", "Only", "URLs"]


# --- pages ----------------------------------------------------------------------------------


def page(spark, html, url="https://c.gov/council"):
    return spark.createDataFrame([(url, html)], "url string, html string")


def test_text(spark):
    html = "<style>p{}</style><script>x='</p>'</script><!-- c --><p>A&nbsp;&amp; B</p>\n\n\n\n<div>C<br>D</div>"
    assert one(spark, H.html_to_text("a"), html) == "A & B\n\n C D"


def test_link_rules(spark):
    html = (
        '<a href="/council#top">self</a><a href="/news/1">noise</a><a href="https://o.gov/">off</a><a href="/m"><img></a>'
        '<a href="/m">Mayor <b>Ann</b></a><a href="/m">again</a><a href="https://facebook.com/c">fb</a><a href="mailto:x@c.gov?subject=a">mail</a>'
    )
    row = web.media_candidates(page(spark, html)).first()
    assert [(link["url"], link["text"]) for link in row["links"]] == [("https://c.gov/m", "Mayor Ann")]
    assert [(s["platform"], s["url"]) for s in row["social_links"]] == [("facebook", "https://facebook.com/c")]
    assert [(e["email"], e["text"]) for e in row["emails"]] == [("x@c.gov", "mail")]
    assert "Mayor Ann" in row["links"][0]["context"]


def test_caps(spark):
    many = "".join(f'<a href="/p/{i}">{i}</a><img src="/i/{i}.jpg"><a href="mailto:{i}@c.gov">m</a>' for i in range(100))
    row = web.media_candidates(page(spark, many), context=False).first()
    assert len(row["links"]) == 80 and len(row["emails"]) == 40
    assert len(web.image_candidates(page(spark, many)).first()["images"]) == 40


def test_late_text_after_the_cap(spark):
    many = '<a href="/p/0"></a>' + "".join(f'<a href="/p/{i}">{i}</a>' for i in range(1, 90)) + '<a href="/p/0">late</a>'
    links = web.media_candidates(page(spark, many), context=False).first()["links"]
    assert len(links) == 80 and links[0]["text"] == "late"


def test_suggestions(spark):
    html = '<a href="/council">Our council</a><a href="/council">x</a><a href="/gov/mayor"></a><a href="/council/agenda">a</a><a href="/parks">p</a>'
    found = web.suggest_links(page(spark, html)).first()["suggestions"]
    assert [(s["url"], s["text"]) for s in found] == [("https://c.gov/council", "Our council"), ("https://c.gov/gov/mayor", "(no text)")]


# --- answers --------------------------------------------------------------------------------


def test_json_answers(spark):
    given = ['```json\n{"officials": []}\n```', 'x {"officials": [{"name": "A", "confidence": "0.5"}]} y', '{"officials": [{"name": "A"', '{"officials": {}}', "none"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, response string")
    rows = extraction.parse_roster_response(df).collect()
    assert [(r["i"], r["raw"]["name"], r["raw"]["confidence"]) for r in rows] == [(1, "A", None)]


def test_triage_defaults(spark):
    given = [
        '{"duplicate_of": "12", "title": 5, "category": "x", "severity": "high"}', '{"duplicate_of": "", "title": "t"}', "no",
        '{"duplicate_of": null, "title": "t", "category": "ui", "severity": "low", "cleaned_description": "d"}',
    ]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, response string")
    rows = {r["i"]: r for r in extraction.parse_triage(df).collect()}
    assert sorted(rows) == [0, 1, 3]
    assert (rows[0]["duplicate_of"], rows[0]["title"], rows[0]["category"], rows[0]["severity"]) == (12, "Reported issue", "other", "high")
    assert rows[1]["duplicate_of"] is None and rows[3]["cleaned_description"] == "d"


# --- records --------------------------------------------------------------------------------


def raw_row(**kw):
    return {f.name: kw.get(f.name) for f in RAW_OFFICIAL}


def test_normalize(spark):
    from pyspark.sql import types as P

    schema = P.StructType([
        P.StructField("raw", RAW_OFFICIAL), P.StructField("jurisdiction", P.StructType([P.StructField(k, P.StringType()) for k in ("city", "state", "level", "body")])),
        P.StructField("source_url", P.StringType()), P.StructField("extracted_at", P.StringType()),
    ])
    place = ("Larkmoor", "TX", None, "Larkmoor City Council")
    rows = [
        (raw_row(name=" Ann  ", office="Mayor", phone="5125551234", email="https://x/email", url="ann", address="  ", social=None), place, "https://e.gov/c/", "t"),
        (raw_row(name="  "), place, "https://e.gov/", "t"),
    ]
    out = records.normalize(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["id"], r["name"], r["level"], r["phone"], r["email"], r["url"], r["address"]) == (
        "tx:larkmoor:mayor:ann", "Ann", "local", "512-555-1234", None, "https://e.gov/c/ann", "",
    )
    assert r["offices"] == [] and r["social"]["twitter"] is None and r["bio_checked_at"] is None


def test_upsert(spark):
    old = officials(spark, dict(id="a", name="A", phone="1", email="e", url="", bio="b", bio_checked_at="2026-01-01", confidence=0.9, social={"twitter": "t"}, offices=[dict(classification="m", city="X", phone="1")]))
    new = officials(
        spark,
        dict(id="a", name="A2", phone="2", email="", bio=None, confidence=None, social={"facebook": "f"}, offices=[dict(classification="m", city="x", fax="9"), dict(classification="d", city="Y", phone="3")], seq=0),
        dict(id="a", name="A3", phone=None, confidence=0.1, seq=1),
        dict(id="b", name="B", phone="", offices=[dict(classification="m", phone="1"), dict(classification="m", phone="1")], seq=2),
    )
    rows = {r["id"]: r for r in records.merge_records(old.drop("seq"), new).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["name"], a["phone"], a["email"], a["url"], a["bio"], a["bio_checked_at"], a["confidence"]) == ("A3", "2", "e", "", "b", None, 0.1)
    assert (a["social"]["twitter"], a["social"]["facebook"]) == ("t", "f")
    assert [(o["city"], o["phone"], o["fax"]) for o in a["offices"]] == [("x", "1", "9"), ("Y", "3", None)]
    assert b["phone"] == "" and len(b["offices"]) == 2


def test_repeated_office_keys(spark):
    dup = [dict(classification="m", city="X", phone="1", fax="f"), dict(classification="m", city="X", phone="2")]
    old = officials(spark, dict(id="a", name="A", offices=dup))
    new = officials(spark, dict(id="a", name="A", offices=[dict(classification="m", city="X", hours="h")]))
    offices = records.merge_records(old.drop("seq"), new).first()["offices"]
    assert [(o["phone"], o["fax"], o["hours"]) for o in offices] == [("2", None, "h")]
    first = officials(spark, dict(id="a", name="A", offices=[dict(classification="m", city="Q")], seq=0), dict(id="a", name="A", offices=dup, seq=1))
    offices = records.merge_records(old.drop("seq").limit(0), first).first()["offices"]
    assert [(o["city"], o["phone"], o["fax"]) for o in offices] == [("Q", None, None), ("X", "2", "f")]


def test_upsert_is_idempotent(spark):
    old = officials(spark, dict(id="a", name="A", phone="1", offices=[dict(classification="m", city="X")]))
    new = officials(spark, dict(id="a", name="A", email="e", offices=[dict(classification="m", city="x", phone="2")]))
    once = records.merge_records(old.drop("seq"), new)
    twice = records.merge_records(once, new)
    assert once.collect() == twice.collect()


def test_best_row_keeps_first_on_ties(spark):
    df = spark.createDataFrame([("k", 0, None, "x"), ("k", 1, 0.0, "y"), ("k", 2, 0.5, "z"), ("k", 3, 0.5, "w"), ("j", 4, None, "v")], "id string, seq long, confidence double, v string")
    rows = {r["id"]: (r["v"], r["seq"]) for r in records.dedupe_best(df, "id", "confidence").collect()}
    assert rows == {"k": ("z", 0), "j": ("v", 4)}


def test_shared_media(spark):
    rows = [dict(id=str(i), name="n", photo_url="seal" if i < 3 else "own", social={"twitter": "city" if i < 2 else None, "facebook": "fb"}) for i in range(5)]
    df = officials(spark, *rows).withColumn("batch", F.when(F.col("seq") < 4, F.lit("a")))
    got = {r["id"]: (r["photo_url"], r["social"]["twitter"], r["social"]["facebook"]) for r in records.strip_shared_media(df, ["batch"]).collect()}
    assert got == {"0": (None, "city", None), "1": (None, "city", None), "2": (None, None, None), "3": ("own", None, None), "4": ("own", None, "fb")}


def test_collapse(spark):
    place = dict(city="Quillby", state="TX")
    rows = officials(
        spark,
        dict(id="x1", name="Ann 'A' B", office="Councilmember", jurisdiction=place, extracted_at="2026-01-01T00:00:00Z", photo_url="p1", phone="old", social={"twitter": "t1"}),
        dict(id="x2", name="Ann “A” B", office="City Council Member", jurisdiction=place, extracted_at="2026-03-01T00:00:00Z", phone="new", social={"facebook": "f3"}),
        dict(id="x3", name="Ann A B", office="Council Member", jurisdiction=place, extracted_at="2026-02-01T00:00:00Z", photo_url="p2", offices=[dict(classification="m", phone="1")]),
    )
    out = records.collapse_duplicates(rows)
    r = out.first()
    assert (r["name"], r["phone"], r["photo_url"], r["social"]["twitter"], r["social"]["facebook"], len(r["offices"]), r["_n"]) == (
        "Ann “A” B", "new", "p2", "t1", "f3", 1, 3,
    )
    assert records.collapse_report(out).first().asDict() == {"groups": 1, "removed": 2, "before": 3, "after": 1}


# --- selection ------------------------------------------------------------------------------

NOW = "2026-08-19T00:00:00Z"


def test_due_for_refresh(spark):
    items = spark.createDataFrame([("new", 3), ("old", 1), ("edge", 0), ("fresh", 2), ("bad", 4), ("new2", 5)], "k string, seq long")
    last = spark.createDataFrame([("old", "2026-01-01T00:00:00Z"), ("edge", "2026-07-20T00:00:00Z"), ("fresh", "2026-08-18T00:00:00Z"), ("bad", "soon")], "k string, last_seen string")
    assert [r["k"] for r in selection.due_for_refresh(items, last, ["k"], NOW).collect()] == ["new", "new2", "old", "edge"]
    assert [r["k"] for r in selection.due_for_refresh(items, last, ["k"], NOW, budget=1).collect()] == ["new"]


def test_recheck_window(spark):
    assert column(spark, selection.recently_checked("a", NOW), ["2026-08-01T00:00:00Z", "2026-05-21T00:00:00Z", "2026-05-21T00:00:01Z", "x", None]) == [True, False, True, False, False]


def test_candidates(spark):
    rows = [("b", f"u{min(i, 3)}", None if i != 1 else "p", i) for i in range(6)] + [("c", "u0", None, 9)]
    df = spark.createDataFrame(rows, "batch string, url string, phone string, seq long").withColumn("bio_checked_at", F.lit(None).cast("string"))
    picked = selection.enrichment_candidates(df, ["batch"], NOW, budget=1, fields=["phone"])
    assert sorted((r["batch"], r["url"]) for r in picked.collect()) == [("b", "u0"), ("c", "u0")]


def test_promotion_needs_one_confident_official(spark):
    schema = "gov boolean, j struct<city:string,state:string,level:string>, officials array<struct<name:string,confidence:double>>"
    rows = [
        (True, ("A", "TX", "local"), [("x", 0.1), ("y", 0.6)]), (True, ("A", "TX", "local"), [("x", None)]), (True, (None, "TX", "local"), [("x", 1.0)]),
        (True, ("A", "TX", "state"), [("x", 1.0)]), (False, ("A", "TX", "county"), [("x", 1.0)]), (True, ("A", "TX", "county"), []),
    ]
    df = spark.createDataFrame(rows, schema)
    got = [r[0] for r in df.select(selection.is_promotable(F.col("gov"), F.col("j"), F.col("officials"))).collect()]
    assert got == [True, False, False, False, False, False]


def test_cache_lifetimes(spark):
    rows = [(True, "2026-05-22T00:00:00Z"), (True, "2026-05-21T00:00:00Z"), (False, "2026-08-13T00:00:00Z"), (False, "2026-08-12T00:00:00Z"), (True, None)]
    df = spark.createDataFrame(rows, "ok boolean, at string")
    got = [r[0] for r in df.select(limits.cache_source(F.col("ok"), F.col("at"), NOW)).collect()]
    assert got == ["cache", "absent", "cache-miss", "absent", "absent"]


# --- universe -------------------------------------------------------------------------------


def test_columns(spark):
    df = spark.createDataFrame([("1", "2")], "`POPESTIMATE2020` string, `POPESTIMATE2024` string")
    assert universe.latest_year_column(df) == "POPESTIMATE2024"
    assert universe.resolve_column(df, ["x", "popestimate2020"]) == "POPESTIMATE2020"
    with pytest.raises(ValueError):
        universe.resolve_column(df, ["NAME"])
    with pytest.raises(ValueError):
        universe.latest_year_column(df, "EST")


# --- tiers and cards ------------------------------------------------------------------------


def test_county_and_city_of_one_name(spark):
    requests = spark.createDataFrame([(1, "TX", "Larkmoor city", "Fennick County"), (2, "TX", None, ""), (3, None, "Larkmoor", None)], "request_id long, state string, place string, county string")
    stored = spark.createDataFrame([("TX", "local", "Fennick"), ("TX", "county", "Fennick County"), ("TX", "local", "Larkmoor"), ("TX", "state", "Larkmoor")], "state string, level string, city string")
    got = serve.match_local(serve.match_keys(requests), stored).collect()
    assert sorted((r["request_id"], r["level"], r["city"]) for r in got) == [(1, "county", "Fennick County"), (1, "local", "Larkmoor")]


def test_state_cards_replace_only_when_present(spark):
    reps = spark.createDataFrame([(1, "StateUpper", "a"), (1, "US House", "b"), (2, "StateLower", "c"), (3, None, "d")], "request_id long, area string, name string")
    cards = spark.createDataFrame([(1, "StateLower", "z")], "request_id long, area string, name string")
    assert sorted(r["name"] for r in serve.replace_state_tier(reps, cards).collect()) == ["b", "c", "d", "z"]


def test_same_office_from_two_sources(spark):
    def office(**kw):
        return F.struct(*[F.lit(kw.get(f.name)).cast("string").alias(f.name) for f in OFFICE])

    merged = O.merge_same_place(
        F.array(office(classification="district", city="Ostrell", phone="1"), office(classification="district", city="Hilby", phone="2")),
        F.array(office(classification="district", city="OSTRELL", phone="1", address="A"), office(classification="x", city="ostrell", phone="1", address="B")),
    )
    rows = spark.range(1).select(merged.alias("m")).first()["m"]
    assert [(o["city"], o["address"]) for o in rows] == [("OSTRELL", "A"), ("Hilby", None)]


# --- walk -----------------------------------------------------------------------------------


def walk(spark, pages, links, found, hits=None, **kw):
    starts = spark.createDataFrame([("g", "http://g.gov/", "http://g.gov/", "http://g.gov")], "group string, start_url string, final_url string, origin string")
    p = spark.createDataFrame([(f"http://g.gov/{u}", f"http://g.gov/{u}", ok) for u, ok in pages], "url string, final_url string, ok boolean")
    l = spark.createDataFrame([(f"http://g.gov/{u}", i, v if v.startswith("http") else f"http://g.gov/{v}") for u, vs in links.items() for i, v in enumerate(vs)], "url string, pos int, link string")
    o = spark.createDataFrame([(f"http://g.gov/{u}", i) for u, ids in found.items() for i in ids] or [("none", "x")], "url string, id string")
    h = None if hits is None else spark.createDataFrame([("g", f"http://g.gov/{u}", i) for i, u in enumerate(hits)], "group string, url string, rank int")
    rows = crawl.expand_frontier(starts, p, l, o, h, **kw).orderBy("visit").collect()
    return [r["url"].removeprefix("http://g.gov/") for r in rows], [r["url"].removeprefix("http://g.gov/") for r in rows if r["is_source"]]


def test_walk_order_and_credit(spark):
    pages = [("", True), ("a", True), ("b", True), ("c", False), ("d", True)]
    seen, source = walk(spark, pages, {"": ["a", "b", "http://o.gov/x", "c", "d"], "a": ["b", "", "d"]}, {"b": ["1", "2"]})
    assert seen == ["", "a", "b", "c", "d"] and source == ["d"]


def test_walk_stops(spark):
    pages = [(u, True) for u in ["", *"abcdefghijk"]]
    chain = {"": ["a"], **{u: [v] for u, v in zip("abcdefghij", "bcdefghijk", strict=True)}}
    assert walk(spark, pages, chain, {})[0] == ["", *"abcdefg"]
    seen, source = walk(spark, pages, {"": ["a", "b", "c"]}, {"a": [str(i) for i in range(7)]})
    assert seen == ["", "a"] and source == ["a"]


def test_walk_visits_search_hits_first(spark):
    pages = [(u, True) for u in ["", "a", "hit", "news/1"]]
    assert walk(spark, pages, {"": ["hit", "a"]}, {}, hits=["hit", "news/1", ""])[0] == ["hit", "", "a"]


def test_committees(spark):
    committees = spark.createDataFrame([("A1", "Ag", [("01", "Farms")], 0)], "thomas_id string, name string, subcommittees array<struct<thomas_id:string,name:string>>, seq long")
    members = spark.createDataFrame([("A1", [("B1", "Chair"), (None, None)], 0), ("A101", [("B1", "")], 1), ("ZZ", [("B1", None)], 2)], "committee_id string, members array<struct<bioguide:string,title:string>>, seq long")
    out = tiers.invert_committees(tiers.committee_members(members, tiers.committee_names(committees))).first()
    assert [(c["id"], c["name"], c["role"]) for c in out["committees"]] == [("A1", "Ag", "Chair"), ("A101", "Ag — Farms", None), ("ZZ", "ZZ", None)]


def test_offsets_of_very_many_matches(spark):
    """Offsets of a page with 100,000 anchors, in time that follows their number and not its square."""
    page = "".join(f"x{'y' * (i % 5)}<a href='/{i}'>é{i}</a>" for i in range(100_000))
    begin = time.perf_counter()
    got = spark.createDataFrame([(page,), ("",), ("no match",), (None,)], "h string").select(H.match_starts("h", H.ANCHOR).alias("s")).collect()
    spent = time.perf_counter() - begin
    assert got[0]["s"] == [m.start() + 1 for m in re.finditer(r"<a .*?</a>", page)]
    assert got[1]["s"] == [] and got[2]["s"] == [] and not got[3]["s"] and spent < 60


HOSTS = [
    ("münchen.de", "xn--mnchen-3ya.de"), ("MÜNCHEN.DE", "xn--mnchen-3ya.de"), ("bücher.españa.example", "xn--bcher-kva.xn--espaa-rta.example"), ("日本語.jp", "xn--wgv71a119e.jp"),
    ("www.例え.テスト", "www.xn--r8jz45g.xn--zckzah"), ("пример.испытание", "xn--e1afmkfd.xn--80akhbyknj4f"), ("faß.de", "xn--fa-hia.de"), ("a%62c.gov", "abc.gov"), ("m%C3%BCnchen.de", "xn--mnchen-3ya.de"),
    ("%41.gov", "a.gov"), ("\U0001f600.example", "xn--e28h.example"), ("ὀδός.gr", None), ("a。b.gov", "a.b.gov"), ("a+b.gov", "a+b.gov"), ("a%2Fb.gov", "null"), ("a%20b.gov", "null"), ("a%zz.gov", "null"), ("%31%30.0.0.1", "10.0.0.1"), ("a\u00adb.gov", "ab.gov"),
]


def test_international_and_encoded_hosts(spark):
    """Hosts as the address standard writes them; a part that can't be a host makes the address unusable."""
    rows = spark.createDataFrame([(f"http://{h}/x",) for h, _ in HOSTS], "u string")
    got = [r[0] for r in rows.select(absolutize(F.col("u"), F.lit("https://base.gov/"))).collect()]
    for (host, want), href in zip(HOSTS, got, strict=True):
        if want is None:
            labels = [x.encode("punycode").decode() for x in host.lower().split(".")]
            want = ".".join(f"xn--{a}" if not o.isascii() else o for a, o in zip(labels, host.lower().split("."), strict=True))
        assert href == (None if want == "null" else f"http://{want}/x"), host


def test_a_page_of_an_international_host_keeps_its_links(spark):
    rows = spark.createDataFrame([("/a", "https://www.köln.example/b/"), ("c", "https://www.k%C3%B6ln.example/b/")], "u string, at string")
    assert [r[0] for r in rows.select(absolutize(F.col("u"), F.col("at"))).collect()] == ["https://www.xn--kln-sna.example/a", "https://www.xn--kln-sna.example/b/c"]
    private = spark.createDataFrame([("http://%31%30.0.0.1/",), ("http://１0.0.0.1/",), ("http://loc%61lhost/",)], "u string")
    assert [r[0] for r in private.select(check_submission_url("u")["ok"]).collect()] == [False] * 3
