"""Queries for the state and federal tiers, serving joins, cards and the site walk."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterspark.functions import offices as O
from rosterspark.operators import crawl, serve, tiers
from rosterspark.plans.catalog import query
from rosterspark.schema import DISTRICT_OFFICES, OFFICE_KEYS, PERSON, SOCIAL_KEYS, TERM


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _none():
    return F.lit(None).cast("string")


# --- state people ---------------------------------------------------------------------------

_ROLES = ["upper", "lower", "legislature", "executive", "other"]
_TITLES = ["Governor", "Lt_Governor", "Secretary_of_State", ""]


def _people(t):
    n, k = F.col("c_custkey"), F.col("c_custkey").cast("string")
    link = lambda *parts: F.struct(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("url"), _none().alias("note"))
    links = F.array(
        F.struct(F.lit("").alias("url"), _none().alias("note")), link("https://www.Facebook.com/f", k), link("https://x.com/a", k),
        link("https://twitter.com/b", k), link("https://site", k, ".gov/"), link("not a url"),
    )
    office = lambda kind, voice, address: F.struct(
        F.lit("O").alias("name"), F.lit("").alias("fax"), voice.alias("voice"), address.alias("address"), kind.alias("classification"))
    offices = F.array(
        office(F.lit("district"), F.when(n % 3 != 0, F.concat(F.lit("d"), k)), F.when(n % 4 == 0, F.lit("Addr"))),
        office(F.lit("capitol"), F.when(n % 2 == 0, F.concat(F.lit("c"), k)).otherwise(F.lit("")), _none()),
        office(F.lit(""), _none(), F.lit("Z")),
    )
    person = F.struct(
        F.concat(F.lit("p"), k).alias("id"), F.col("c_name").alias("name"), F.when(n % 4 != 0, F.col("c_mktsegment")).alias("party"),
        F.struct(_pick(_TITLES, n % 4).alias("title"), _pick(_ROLES, n % 5).alias("org_classification"), F.when(n % 6 != 0, (n % 30).cast("string")).alias("district"), _none().alias("division_id")).alias("current_role"),
        F.struct(_none().alias("id"), _none().alias("name"), F.when(n % 9 == 0, F.lit("country")).otherwise(F.lit("state")).alias("classification")).alias("jurisdiction"),
        _none().alias("image"), F.when(n % 3 == 0, F.concat(F.lit("e"), k)).otherwise(F.lit("")).alias("email"),
        F.when(n % 5 == 1, F.concat(F.lit("https://os/"), k)).alias("openstates_url"), F.when(n % 8 != 0, links).alias("links"),
        F.when(n % 10 != 0, offices).alias("offices"),
        F.array(
            F.struct(F.lit("email").alias("type"), F.lit("").alias("value")), F.struct(F.lit("email").alias("type"), F.lit("old@x").alias("value")),
            F.struct(F.lit("voice").alias("type"), F.lit("v-old").alias("value")),
        ).alias("contact_details"),
    ).cast(PERSON)
    return t.spread("customer").select("c_custkey", person.alias("person"), F.concat(F.lit("S"), F.col("c_nationkey")).alias("state"))


_PERSON_SQL = """
      CASE WHEN n % 4 <> 0 THEN c_mktsegment ELSE '' END AS party,
      CASE WHEN n % 10 = 0 THEN 'v-old' WHEN n % 2 = 0 THEN 'c' || n WHEN n % 3 <> 0 THEN 'd' || n ELSE 'v-old' END AS phone,
      CASE WHEN n % 3 = 0 THEN 'e' || n ELSE 'old@x' END AS email,
      CASE WHEN n % 5 = 1 THEN 'https://os/' || n WHEN n % 8 <> 0 THEN 'https://site' || n || '.gov/' ELSE '' END AS url,
      CASE WHEN n % 8 <> 0 THEN 'https://x.com/a' || n END AS twitter, CASE WHEN n % 8 <> 0 THEN 'https://www.Facebook.com/f' || n END AS facebook,
      CASE WHEN n % 10 = 0 THEN '' ELSE concat_ws(';', CASE WHEN n % 3 <> 0 OR n % 4 = 0 THEN 'district:' || CASE WHEN n % 3 <> 0 THEN 'd' || n ELSE '~' END END,
        CASE WHEN n % 2 = 0 THEN 'capitol:c' || n END, 'other:~') END AS offices
"""


def _shown(cards):
    label = F.transform("offices", lambda o: F.concat(o["classification"], F.lit(":"), F.coalesce(o["phone"], F.lit("~"))))
    return cards.select(
        "c_custkey", "id", "name", "area", "state", "party", "district", "phone", "email", "url", "social.twitter", "social.facebook",
        F.array_join(label, ";").alias("offices"),
    )


@query(
    "legislator_cards",
    f"""
    SELECT n AS c_custkey, 'p' || n AS id, c_name AS name, ['StateUpper', 'StateLower', 'StateUpper'][(n % 5) + 1] AS area, 'S' || c_nationkey AS state,
      CASE WHEN n % 6 <> 0 THEN 'District ' || (n % 30) ELSE '' END AS district, {_PERSON_SQL}
    FROM (SELECT *, c_custkey AS n FROM customer) WHERE n % 9 <> 0 AND n % 5 < 3
    """,
)
def legislator_cards(t):
    return _shown(tiers.legislator_cards(_people(t)))


def _executive(n, name):
    """A person with a statewide title; each nation has one, so a state has a few."""
    fields = {
        "id": F.concat(F.lit("x"), n), "name": name, "current_role": F.struct(
            _pick(_TITLES, n % 4).alias("title"), F.lit("executive").alias("org_classification"), _none().alias("district"), _none().alias("division_id")),
        "jurisdiction": F.struct(_none().alias("id"), _none().alias("name"), F.lit("state").alias("classification")),
    }
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PERSON.fields])


@query(
    "executive_cards",
    f"""
    SELECT n AS c_custkey, 'p' || n AS id, c_name AS name, ['Governor', 'Lieutenant Governor', 'Secretary of State'][(n % 4) + 1] AS area, 'S' || c_nationkey AS state, '' AS district, {_PERSON_SQL}
    FROM (SELECT *, c_custkey AS n FROM customer) WHERE n % 9 <> 0 AND n % 5 = 3 AND n % 4 <> 3
    """,
)
def executive_cards(t):
    return _shown(tiers.executive_cards(_people(t)))


# --- federal people -------------------------------------------------------------------------


def _legislators(t):
    n, k = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    term = lambda year, **kw: F.struct(*[
        {"start": F.lit(f"{year}-01-03"), "end": F.lit(f"{year + 2}-01-03"), **kw}.get(f.name, _none()).cast("string").alias(f.name) for f in TERM
    ])
    last = term(2027, address=F.when(n % 3 == 0, F.concat(F.lit("A"), k)), phone=F.when(n % 4 == 0, F.lit("")), office=F.when(n % 5 == 0, F.concat(F.lit("Room "), k)))
    terms = F.when(n % 7 != 0, F.array(term(2025, phone=F.lit("old")), last))
    return t.supplier.select(F.when(n % 11 != 0, F.concat(F.lit("B"), k)).alias("bioguide"), terms.alias("terms"), n.alias("seq"))


@query(
    "dc_offices",
    """
    SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN '2029-01-03' END AS term_end, CASE WHEN s_suppkey % 7 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0) THEN
      CASE WHEN s_suppkey % 5 = 0 THEN 'Room ' || s_suppkey ELSE 'Washington DC Office' END || '@' || CASE WHEN s_suppkey % 3 = 0 THEN 'A' || s_suppkey ELSE '' END END AS office
    FROM supplier
    """,
)
def dc_offices(t):
    office = tiers.dc_office("terms")
    shown = F.when(office.isNotNull(), F.concat(office["name"], F.lit("@"), F.coalesce(office["address"], F.lit(""))))
    return _legislators(t).select(F.col("seq").alias("s_suppkey"), tiers.current_term("terms")["end"].alias("term_end"), shown.alias("office"))


@query(
    "social_urls",
    """
    SELECT 'B' || s_suppkey AS bioguide, CASE WHEN s_suppkey % 2 = 0 THEN 'https://twitter.com/t' || s_suppkey END AS twitter,
      CASE WHEN s_suppkey % 5 = 0 THEN 'https://youtube.com/y' WHEN s_suppkey % 3 = 0 THEN 'https://youtube.com/channel/id' END AS youtube
    FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0
    """,
)
def social_urls(t):
    n = F.col("s_suppkey")
    handles = F.struct(
        F.when(n % 2 == 0, F.concat(F.lit("t"), n)).alias("twitter"), F.lit("").alias("facebook"), _none().alias("instagram"),
        F.when(n % 5 == 0, F.lit("y")).alias("youtube"), F.when(n % 3 == 0, F.lit("id")).alias("youtube_id"),
    )
    rows = t.supplier.select(F.concat(F.lit("B"), n).alias("bioguide"), handles.alias("social"))
    return tiers.social_urls(rows).select("bioguide", "social.twitter", "social.youtube")


def _committees(t):
    sub = lambda c: F.struct(c.alias("thomas_id"), F.concat(F.lit("Sub "), c).alias("name"))
    key = F.concat(F.lit("K"), F.col("n_nationkey"))
    return t.nation.select(
        F.when(F.col("n_nationkey") % 6 != 5, key).alias("thomas_id"), F.col("n_name").alias("name"),
        F.array(sub(F.lit("01")), sub(F.when(F.col("n_nationkey") % 2 == 0, F.lit("02")))).alias("subcommittees"), F.col("n_nationkey").alias("seq"),
    )


def _membership(t):
    n = F.col("p_partkey")
    code = F.concat(F.lit("K"), F.col("p_size") % 25, F.when(n % 3 == 1, F.lit("01")).when(n % 3 == 2, F.lit("02")).otherwise(F.lit("")))
    member = F.struct(F.when(n % 10 != 0, F.concat(F.lit("B"), n % 40)).alias("bioguide"), F.when(n % 4 == 0, F.lit("Chair")).when(n % 4 == 1, F.lit("")).alias("title"))
    return t.part.select(code.alias("committee_id"), F.array(member).alias("members"), n.alias("seq"))


_MEMBER_SQL = """
    WITH m AS (SELECT p_partkey AS n, 'K' || (p_size % 25) || ['', '01', '02'][(p_partkey % 3) + 1] AS committee_id, p_size % 25 AS c, p_partkey % 3 AS s, 'B' || (p_partkey % 40) AS bioguide,
      CASE WHEN p_partkey % 4 = 0 THEN 'Chair' END AS role FROM part WHERE p_partkey % 10 <> 0),
    j AS (SELECT n, bioguide, committee_id, role, CASE WHEN c % 6 = 5 THEN committee_id WHEN s = 0 THEN n_name WHEN s = 1 THEN n_name || ' — Sub 01' WHEN c % 2 = 0 THEN n_name || ' — Sub 02' ELSE committee_id END AS committee
      FROM m JOIN nation ON n_nationkey = c)
"""


@query("committee_members", _MEMBER_SQL + "SELECT n, bioguide, committee_id, role, committee FROM j")
def committee_members(t):
    rows = tiers.committee_members(_membership(t), tiers.committee_names(_committees(t)))
    return rows.select(F.col("seq").alias("n"), "bioguide", "committee_id", "role", "committee")


@query(
    "committee_lists",
    _MEMBER_SQL + "SELECT bioguide, string_agg(committee_id || '=' || committee || '/' || coalesce(role, ''), ';' ORDER BY n) AS committees FROM j GROUP BY 1",
)
def committee_lists(t):
    lists = tiers.invert_committees(tiers.committee_members(_membership(t), tiers.committee_names(_committees(t))))
    label = F.transform("committees", lambda c: F.concat(c["id"], F.lit("="), c["name"], F.lit("/"), F.coalesce(c["role"], F.lit(""))))
    return lists.select("bioguide", F.array_join(label, ";").alias("committees"))


def _district_entries(t):
    n = F.col("s_suppkey")
    shape = DISTRICT_OFFICES["offices"].dataType.elementType.fieldNames()
    office = lambda **kw: F.struct(*[kw.get(k, _none()).cast("string").alias(k) for k in shape])
    offices = F.when(n % 6 == 0, F.array().cast(DISTRICT_OFFICES["offices"].dataType)).otherwise(F.array(
        office(building=F.when(n % 2 == 0, F.lit("Hall")), suite=F.concat(F.lit("S"), n), city=F.lit("C"), phone=F.lit("")),
        office(address=F.lit("Elm"), city=F.when(n % 3 == 0, F.lit("D")).otherwise(F.lit(""))),
    ))
    return t.supplier.select(F.when(n % 11 != 0, F.concat(F.lit("B"), n % 50)).alias("bioguide"), offices.alias("offices"), n.alias("seq"))


@query(
    "district_offices",
    """
    WITH r AS (SELECT 'B' || (s_suppkey % 50) AS bioguide, max(s_suppkey) AS n FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 6 <> 0 GROUP BY 1)
    SELECT bioguide, CASE WHEN n % 2 = 0 THEN 'Hall, ' ELSE '' END || 'S' || n || '@C|~@' || CASE WHEN n % 3 = 0 THEN 'D' ELSE '~' END AS offices FROM r
    """,
)
def district_offices(t):
    rows = tiers.district_offices_by_person(_district_entries(t))
    label = F.transform("district_offices", lambda o: F.concat(F.coalesce(o["name"], F.lit("~")), F.lit("@"), F.coalesce(o["city"], F.lit("~"))))
    return rows.select("bioguide", F.array_join(label, "|").alias("offices"))


def _details(t):
    members = tiers.committee_members(_membership(t), tiers.committee_names(_committees(t)))
    bios = t.supplier.filter(F.col("s_suppkey") % 4 == 0).select(F.concat(F.lit("B"), "s_suppkey").alias("bioguide"), F.col("s_name").alias("bio"), F.lit("enc").alias("bio_source"))
    return tiers.federal_details(_legislators(t), tiers.invert_committees(members), tiers.district_offices_by_person(_district_entries(t)), bios)


@query(
    "federal_details",
    _MEMBER_SQL + """,
    c AS (SELECT bioguide, count(*) AS n_committees FROM j GROUP BY 1),
    o AS (SELECT DISTINCT 'B' || (s_suppkey % 50) AS bioguide FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 6 <> 0)
    SELECT 'B' || s_suppkey AS bioguide, CASE WHEN s_suppkey % 7 <> 0 THEN '2029-01-03' END AS term_end, coalesce(n_committees, 0) AS n_committees,
      CASE WHEN o.bioguide IS NULL THEN 0 ELSE 2 END::BIGINT AS n_offices, CASE WHEN s_suppkey % 4 = 0 THEN s_name END AS bio
    FROM supplier LEFT JOIN c ON c.bioguide = 'B' || s_suppkey LEFT JOIN o ON o.bioguide = 'B' || s_suppkey WHERE s_suppkey % 11 <> 0
    """,
)
def federal_details(t):
    return _details(t).select(
        "bioguide", "term_end", F.size("committees").cast("bigint").alias("n_committees"), F.size("district_offices").cast("bigint").alias("n_offices"), "bio"
    )


@query(
    "enrich_federal",
    _MEMBER_SQL + """,
    c AS (SELECT bioguide, count(*) AS n_committees FROM j GROUP BY 1),
    o AS (SELECT 'B' || (s_suppkey % 50) AS bioguide, max(s_suppkey) AS n FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 6 <> 0 GROUP BY 1),
    r AS (SELECT c_custkey, c_custkey % 3 <> 0 AS fed, 'B' || (c_custkey % 120) AS id, c_custkey % 120 AS s FROM customer),
    e AS (SELECT r.*, s_suppkey IS NOT NULL AND s % 11 <> 0 AS known FROM r LEFT JOIN supplier ON s_suppkey = s)
    SELECT c_custkey, CASE WHEN fed AND known AND s % 7 <> 0 THEN '2029-01-03' WHEN NOT fed THEN 'keep' END AS term_end, CASE WHEN fed THEN CASE WHEN known THEN coalesce(n_committees, 0) ELSE 0 END END AS n_committees,
      CASE WHEN fed AND EXISTS (SELECT 1 FROM supplier z WHERE z.s_suppkey = s AND (s % 2 = 0)) THEN 'https://twitter.com/t' || s END AS twitter,
      CASE WHEN fed THEN 1 + CASE WHEN NOT known THEN 0 ELSE (CASE WHEN o.n IS NULL THEN 0 WHEN o.n % 3 = 0 THEN 2 ELSE 2 END) + CASE WHEN s % 7 <> 0 AND (s % 3 = 0 OR s % 5 = 0)
        AND NOT (o.n IS NOT NULL AND o.n % 3 <> 0) THEN 1 ELSE 0 END END END::BIGINT AS n_offices
    FROM e LEFT JOIN c ON c.bioguide = e.id LEFT JOIN o ON o.bioguide = e.id
    """,
)
def enrich_federal(t):
    n = F.col("c_custkey")
    field = F.array(F.struct(F.lit("555").alias("phone"), F.lit("C").alias("city")))
    reps = t.customer.select(
        "c_custkey", F.concat(F.lit("B"), n % 120).alias("id"), _pick(["StateUpper", "US House", "US Senate"], n % 3).alias("area"),
        field.alias("field_offices"), F.lit("keep").alias("term_end"),
    )
    m = F.col("s_suppkey")
    handles = F.struct(F.concat(F.lit("t"), m).alias("twitter"), _none().alias("facebook"), _none().alias("instagram"), _none().alias("youtube"), _none().alias("youtube_id"))
    social = tiers.social_urls(t.supplier.filter(m % 2 == 0).select(F.concat(F.lit("B"), m).alias("bioguide"), handles.alias("social")))
    out = serve.enrich_federal(reps, social, _details(t))
    federal = F.col("area") != "StateUpper"
    return out.select(
        "c_custkey", "term_end", F.when(federal, F.size("committees")).cast("bigint").alias("n_committees"), "social.twitter",
        F.when(federal, F.size("offices")).cast("bigint").alias("n_offices"),
    )


# --- geography ------------------------------------------------------------------------------


@query(
    "geo_projection",
    """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'T' || c_nationkey ELSE 'S' || c_nationkey END AS state, CASE WHEN c_custkey % 3 = 0 THEN 'Full ' || c_name ELSE c_name END AS county,
      CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS place, 'CD' || (c_custkey % 9) AS congressional, 'U' || (c_custkey % 7) AS state_upper, NULL::VARCHAR AS state_lower
    FROM customer
    """,
)
def geo_projection(t):
    n = F.col("c_custkey")
    area = lambda base, name=None, usab=None: F.array(F.struct(
        base.cast("string").alias("BASENAME"), (name if name is not None else _none()).alias("NAME"), (usab if usab is not None else _none()).alias("STUSAB")))
    empty = F.array().cast("array<struct<BASENAME:string,NAME:string,STUSAB:string>>")
    layers = F.map_from_arrays(
        F.array(*[F.lit(x) for x in ["119th Congressional Districts", "2024 State Legislative Districts - Upper", "Counties", "Incorporated Places", "States", "Old Congressional"]]),
        F.array(
            area(F.concat(F.lit("CD"), n % 9)), area(F.concat(F.lit("U"), n % 7)), area(F.when(n % 3 == 0, F.lit("")).otherwise(F.col("c_name")), F.concat(F.lit("Full "), "c_name")),
            F.when(n % 4 != 0, area(F.col("c_mktsegment"))).otherwise(empty), area(F.lit("x"), None, F.concat(F.lit("S"), "c_nationkey")), area(F.lit("never")),
        ),
    )
    rows = t.customer.select("c_custkey", layers.alias("geographies"), F.when(n % 2 == 0, F.concat(F.lit("T"), "c_nationkey")).otherwise(F.lit("")).alias("hint"))
    out = tiers.geo_projection(rows, state_hint=F.col("hint"))
    return out.select("c_custkey", "state", "county", "place", "districts.*")


@query(
    "resolve_locations",
    """
    WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (10000 + c_custkey % 300)::VARCHAR ELSE 'Addr ' || (c_custkey % 500) END AS q FROM customer)
    SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN (c_custkey % 300) % 2 = 0 THEN 'zip ' || (10000 + c_custkey % 300) END
      WHEN (c_custkey % 500) % 2 = 0 THEN 'address' WHEN (c_custkey % 500) % 5 = 0 THEN 'name' END AS via FROM r
    """,
)
def resolve_locations(t):
    n = F.col("c_custkey")
    zip5 = (F.lit(10000) + n % 300).cast("string")
    asked = F.when(n % 3 == 0, F.concat(F.lit(" "), zip5, F.when(n % 2 == 0, F.lit("-1234")).otherwise(F.lit("")))).otherwise(F.concat(F.lit("Addr "), n % 500))
    requests = t.customer.select(n.alias("request_id"), asked.alias("query"))
    geo = lambda c: F.struct(c.alias("via")).alias("geo")
    numbers = t.customer.select((F.lit(10000) + n % 300).alias("z")).distinct()
    by_zip = numbers.filter("z % 2 = 0").select(F.col("z").cast("string").alias("zip5"), geo(F.concat(F.lit("zip "), "z")))
    names = t.customer.select((n % 500).alias("i")).distinct()
    by_address = names.filter("i % 2 = 0").select(F.concat(F.lit("Addr "), "i").alias("query"), geo(F.lit("address")))
    by_name = names.filter("i % 5 = 0").select(F.concat(F.lit("Addr "), "i").alias("query"), geo(F.lit("name")))
    return tiers.resolve_locations(requests, by_zip, by_address, by_name).select("request_id", "geo.via")


# --- serving --------------------------------------------------------------------------------


def _requests(t):
    n = F.col("o_orderkey")
    return t.orders.select(
        n.alias("request_id"), F.concat(F.lit("R"), F.col("o_custkey") % 5).alias("state"),
        F.when(n % 3 != 0, F.concat(F.lit("Nation "), F.col("o_custkey") % 25, F.lit(" city"))).alias("place"),
        F.when(n % 2 == 0, F.concat(F.lit("NATION_"), n % 25, F.lit(" County"))).otherwise(F.lit(" County ")).alias("county"),
    )


def _local_officials(t):
    n = F.col("s_suppkey")
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.concat(F.lit("R"), F.col("n_regionkey")).alias("state"), _pick(["local", "county", "state"], n % 3).alias("level"),
        F.concat(F.initcap("n_name"), F.when(n % 3 == 1, F.lit(" County")).otherwise(F.lit(" Town"))).alias("city"),
    )


_MATCH_SQL = """
    WITH o AS (SELECT s_suppkey, 'R' || n_regionkey AS st, n_nationkey AS nk, s_suppkey % 3 AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    q AS (SELECT o_orderkey AS request_id, 'R' || (o_custkey % 5) AS st, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 25 END AS place, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 25 END AS county FROM orders),
    m AS (SELECT request_id, s_suppkey FROM q JOIN o ON q.st = o.st AND nk = place WHERE kind = 0 UNION ALL SELECT request_id, s_suppkey FROM q JOIN o ON q.st = o.st AND nk = county WHERE kind = 1)
"""


@query("match_local", _MATCH_SQL + "SELECT request_id, s_suppkey FROM m")
def match_local(t):
    return serve.match_local(serve.match_keys(_requests(t)), _local_officials(t), tile=serve.MATCH_TILE).select("request_id", "s_suppkey")


@query("unmatched_requests", _MATCH_SQL + "SELECT request_id FROM q WHERE request_id NOT IN (SELECT request_id FROM m)")
def unmatched_requests(t):
    r = _requests(t)
    return serve.unmatched(r, serve.match_local(serve.match_keys(r), _local_officials(t), how="left_semi")).select("request_id")


@query(
    "conditional_replace",
    """
    WITH cards AS (SELECT s_suppkey * 3 AS req, 'card' AS kind FROM supplier)
    SELECT o_custkey AS request_id, o_orderkey::VARCHAR AS item FROM orders WHERE NOT (o_orderstatus IN ('F', 'P') AND o_custkey IN (SELECT req FROM cards))
    UNION ALL SELECT req, kind FROM cards
    """,
)
def conditional_replace(t):
    area = F.when(F.col("o_orderstatus") == "F", F.lit("StateUpper")).when(F.col("o_orderstatus") == "P", F.lit("StateLower")).otherwise(F.lit("US House"))
    reps = t.orders.select(F.col("o_custkey").alias("request_id"), area.alias("area"), F.col("o_orderkey").cast("string").alias("item"))
    cards = t.supplier.select((F.col("s_suppkey") * 3).alias("request_id"), F.lit("StateUpper").alias("area"), F.lit("card").alias("item"))
    return serve.replace_state_tier(reps, cards).select("request_id", "item")


def _card_rows(t):
    n = F.col("p_partkey")
    office = F.struct(*[
        {"classification": F.lit("m"), "phone": F.concat(F.lit("t"), n), "address": F.when(n % 3 == 0, F.lit("A"))}.get(k, _none()).alias(k) for k in OFFICE_KEYS
    ])
    social = F.struct(*[_none().alias(k) for k in SOCIAL_KEYS])
    return t.part.select(
        n.alias("request_id"), F.col("p_name").alias("id"), F.col("p_name").alias("name"), F.when(n % 3 == 0, F.lit("")).otherwise(F.col("p_type")).alias("office"),
        F.when(n % 2 == 0, F.col("p_brand")).alias("body"), F.lit("TX").alias("state"), F.when(n % 4 != 0, F.concat(F.lit("t"), n)).alias("phone"),
        *[_none().alias(c) for c in ("url", "photo_url", "email", "district", "address", "hours", "bio", "source_url")],
        social.alias("social"), F.when(n % 5 != 0, F.array(office)).alias("offices"), F.lit("2026-08-19").alias("extracted_at"), (n % 10 / 10).alias("confidence"),
    )


@query(
    "local_cards",
    """
    SELECT p_partkey AS request_id, CASE WHEN p_partkey % 3 <> 0 THEN p_type WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Local' END AS area,
      CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 2 = 0 THEN p_brand ELSE '' END AS body, CASE WHEN p_partkey % 4 <> 0 THEN 't' || p_partkey ELSE '' END AS phone,
      'Local' AS "group", (p_partkey % 10) / 10.0 < 0.7 AS low_confidence, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 THEN 0 ELSE 1 END::BIGINT AS n_extra
    FROM part
    """,
)
def local_cards(t):
    cards = serve.grouped_cards(serve.rep_card(_card_rows(t), ["request_id"]))
    return cards.select("request_id", "area", "body", "phone", "group", "low_confidence", F.size("extra_offices").cast("bigint").alias("n_extra"))


@query(
    "assembled_results",
    """
    SELECT p_partkey AS request_id, 0::BIGINT AS tier, 'Local' AS "group", 0::BIGINT AS group_order, CASE WHEN p_partkey % 3 <> 0 THEN p_type WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Local' END AS area_label FROM part
    UNION ALL SELECT s_suppkey, 1, CASE WHEN s_suppkey % 2 = 0 THEN 'Federal' ELSE 'State' END, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END,
      CASE WHEN s_suppkey % 2 = 0 THEN 'US House' WHEN s_suppkey % 3 = 0 THEN 'CA Senate' ELSE 'CA House' END FROM supplier
    """,
)
def assembled_results(t):
    n = F.col("s_suppkey")
    area = F.when(n % 2 == 0, F.lit("US House")).when(n % 3 == 0, F.lit("StateUpper")).otherwise(F.lit("StateLower"))
    others = serve.as_cards(t.supplier.select(n.alias("request_id"), area.alias("area"), F.lit("CA").alias("state")), ["request_id"])
    out = serve.grouped_cards(serve.assemble_results(serve.rep_card(_card_rows(t), ["request_id"]), others))
    return out.select("request_id", F.col("tier").cast("bigint").alias("tier"), "group", F.col("group_order").cast("bigint").alias("group_order"), "area_label")


@query(
    "field_offices",
    "SELECT p_partkey, 'district/' || p_brand || '/' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '~' END AS office FROM part",
)
def field_offices(t):
    given = F.array(F.struct(F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("")).alias("phone"), F.col("p_brand").alias("city")))
    o = F.try_element_at(O.offices_from_field_offices(given), F.lit(1))
    return t.part.select("p_partkey", F.concat_ws("/", o["classification"], o["city"], F.coalesce(o["phone"], F.lit("~"))).alias("office"))


# --- walks ----------------------------------------------------------------------------------

# Documents as pages of sites of 40 pages: page i links to 2i+1 .. 2i+4 (the fifth link is over the limit) and
# to another site; some pages are down; each page lists up to three officials.


def _site_tables(t):
    d = t.documents.select(F.floor(F.col("doc_id") / 40).alias("g"), (F.col("doc_id") % 40).alias("i"))
    at = lambda g, i: F.concat(F.lit("http://s"), g, F.lit(".example.org/"), i)
    g, i = F.col("g"), F.col("i")
    pages = d.select(at(g, i).alias("url"), at(g, i).alias("final_url"), ((i + g) % 6 != 4).alias("ok"))
    links = d.select(at(g, i).alias("url"), F.posexplode(F.array(
        at(g, 2 * i + 1), at(g + 1, i), at(g, 2 * i + 2), at(g, i + 3), at(g, i + 4))).alias("pos", "link"))
    officials = d.select(at(g, i).alias("url"), F.explode(F.expr("filter(sequence(0L, 2L), k -> k < (i + g) % 3)")).alias("k")).select(
        "url", F.concat(F.lit("id"), F.regexp_extract("url", r"(\d+)$", 1).cast("int") % 9, F.lit("-"), "k").alias("id"))
    starts = d.filter("i = 0").select(
        F.concat(F.lit("s"), g).alias("group"), at(g, i).alias("start_url"), at(g, i).alias("final_url"),
        F.concat(F.lit("http://s"), g, F.lit(".example.org")).alias("origin"))
    hits = d.filter("i = 5 or i = 7").select(F.concat(F.lit("s"), g).alias("group"), at(g, i).alias("url"), (F.lit(9) - i).alias("rank")).filter("group like '%3'")
    return starts, pages, links, officials, hits


def _walk_sql(budget: int = 8, least: int = 7) -> str:
    """The walk in rounds, written out round by round."""
    parts = [f"""
    d AS (SELECT doc_id // 40 AS g, doc_id % 40 AS i, (doc_id % 40 + doc_id // 40) % 6 <> 4 AS ok FROM documents),
    l AS (SELECT g, i, unnest([0, 2, 3]) AS pos, unnest([2 * i + 1, 2 * i + 2, i + 3]) AS j FROM d),
    o AS (SELECT g, i, 'id' || (i % 9) || '-' || k AS id FROM d, (SELECT unnest([0, 1, 2]) AS k) WHERE k < (i + g) % 3),
    f0 AS (SELECT g, 0 AS i, 99::BIGINT AS place FROM d WHERE i = 0 UNION ALL SELECT g, i, (9 - i)::BIGINT FROM d WHERE i IN (5, 7) AND g % 10 = 3),
    v_ AS (SELECT g, i FROM f0), s_ AS (SELECT DISTINCT g, 0::BIGINT AS visits, 0::BIGINT AS n FROM f0), i_ AS (SELECT g, 'x' AS id, 0::BIGINT AS visit FROM d WHERE false)"""]
    queued, state, ids = "v_", "s_", "i_"
    for r in range(budget):
        parts.append(f"""
    r{r} AS (SELECT f.g, f.i, s.n, s.visits + row_number() OVER (PARTITION BY f.g ORDER BY f.place) - 1 AS visit FROM f{r} f JOIN {state} s ON f.g = s.g AND s.visits < {budget} AND s.n < {least}),
    t{r} AS (SELECT r.g, r.i, r.n, r.visit, coalesce(d.ok, false) AS ok FROM r{r} r LEFT JOIN d ON d.g = r.g AND d.i = r.i WHERE r.visit < {budget}),
    n{r} AS (SELECT t.g, o.id, min(t.visit) AS visit FROM t{r} t JOIN o ON o.g = t.g AND o.i = t.i WHERE t.ok AND NOT EXISTS (SELECT 1 FROM {ids} x WHERE x.g = t.g AND x.id = o.id) GROUP BY 1, 2),
    c{r} AS (SELECT t.*, t.n + (SELECT count(*) FROM n{r} n WHERE n.g = t.g AND n.visit <= t.visit) AS found, t.n + (SELECT count(*) FROM n{r} n WHERE n.g = t.g AND n.visit < t.visit) AS before FROM t{r} t),
    w{r} AS (SELECT g, i, visit, ok, found FROM c{r} WHERE before < {least}),
    i{r} AS (SELECT * FROM {ids} UNION ALL SELECT n.g, n.id, n.visit FROM n{r} n WHERE EXISTS (SELECT 1 FROM w{r} w WHERE w.g = n.g AND w.visit = n.visit)),
    s{r} AS (SELECT s.g, coalesce(max(w.visit) + 1, max(s.visits)) AS visits, coalesce(max(w.found), max(s.n)) AS n FROM {state} s LEFT JOIN w{r} w ON w.g = s.g GROUP BY 1),
    f{r + 1} AS (SELECT w.g, l.j AS i, min(w.visit * 4 + l.pos) AS place FROM w{r} w JOIN l ON l.g = w.g AND l.i = w.i WHERE w.ok AND w.found < {least}
      AND NOT EXISTS (SELECT 1 FROM {queued} q WHERE q.g = w.g AND q.i = l.j) GROUP BY 1, 2),
    v{r} AS (SELECT * FROM {queued} UNION ALL SELECT g, i FROM f{r + 1})""")
        queued, state, ids = f"v{r}", f"s{r}", f"i{r}"
    union = " UNION ALL ".join(f"SELECT * FROM w{r}" for r in range(budget))
    # Each round is used several times by the next ones, so it is materialized.
    body = ",".join(parts).replace(" AS (", " AS MATERIALIZED (")
    return f"""WITH {body}, w AS ({union}), src AS (SELECT g, max(visit) AS v FROM w WHERE ok AND found > 0 GROUP BY 1)
    SELECT 's' || w.g AS "group", visit::BIGINT AS visit, 'http://s' || w.g || '.example.org/' || i AS url, ok, found::BIGINT AS found_ids, coalesce(visit = v, false) AS is_source
    FROM w LEFT JOIN src ON src.g = w.g"""


@query("site_walk", _walk_sql())
def site_walk(t):
    starts, pages, links, officials, hits = _site_tables(t)
    walk = crawl.expand_frontier(starts, pages, links, officials, hits)
    return walk.select("group", F.col("visit").cast("bigint").alias("visit"), "url", "ok", "found_ids", "is_source")


@query(
    "new_links",
    """
    SELECT DISTINCT 's' || (doc_id // 40) AS "group", 'http://s' || (doc_id // 40) || '.example.org/' || j AS link
    FROM (SELECT doc_id, unnest([2 * (doc_id % 40) + 1, 2 * (doc_id % 40) + 2, doc_id % 40 + 3, doc_id % 40 + 4]) AS j FROM documents) WHERE j % 4 <> 0
    """,
)
def new_links(t):
    _, _, links, _, _ = _site_tables(t)
    site = F.regexp_extract("url", r"^(http://(s\d+)[^/]*)", 2)
    rows = links.withColumns({"group": site, "origin": F.regexp_extract("url", r"^(http://[^/]*)", 1)})
    seen = links.filter(F.regexp_extract("link", r"(\d+)$", 1).cast("int") % 4 == 0).select(F.regexp_extract("link", r"^http://(s\d+)", 1).alias("group"), F.col("link").alias("url")).distinct()
    return crawl.same_origin_new_links(rows, seen, "group").select("group", "link").distinct()


@query(
    "resolved_sites",
    """
    SELECT c_custkey::VARCHAR AS "group", CASE WHEN c_custkey % 4 = 0 THEN 'http://r' || c_custkey || '.gov/' WHEN c_custkey % 4 = 1 THEN 'http://h' || c_custkey || '.gov/' WHEN c_custkey % 4 = 2 THEN 'http://k' || c_custkey || '.org/x' END AS url
    FROM customer WHERE c_custkey % 4 <> 3
    """,
)
def resolved_sites(t):
    n, k = F.col("c_custkey"), F.col("c_custkey").cast("string")
    recalled = F.concat(F.lit("http://r"), k, F.lit(".gov/"))
    hit1, hit2 = F.concat(F.lit("http://h"), k, F.lit(".gov/a")), F.concat(F.lit("http://k"), k, F.lit(".org/x"))
    rows = t.customer.select(k.alias("group"), F.lower("c_mktsegment").alias("city"), F.when(n % 8 != 3, recalled).alias("recalled"), F.array(hit1, hit2).alias("hits"))
    page = lambda when, url, final, words: t.customer.filter(when).select(
        url.alias("url"), final.alias("final_url"), F.lit(True).alias("ok"), F.concat(words, F.lit(" page")).alias("text"))
    seg = F.col("c_mktsegment")
    pages = (
        page(n % 4 == 0, recalled, recalled, seg).unionByName(page(n % 4 != 0, recalled, recalled, F.lit("other")))
        .unionByName(page(n % 4 == 1, F.concat(F.lit("http://h"), k, F.lit(".gov")), F.concat(F.lit("http://h"), k, F.lit(".gov/")), seg))
        .unionByName(page(n % 2 == 0, hit2, hit2, F.concat(seg, F.lit(" city council")))).unionByName(page(n % 4 == 3, hit2, hit2, seg))
    )
    return crawl.resolve_site(rows, pages).select("group", "url")
