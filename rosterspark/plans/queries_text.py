"""Queries for contact fields, ids, keys, short texts and canonical records."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterspark.functions import text as T
from rosterspark.functions.urls import absolutize
from rosterspark.operators import records
from rosterspark.plans.catalog import (
    query, s_anchors, s_email, s_encode, s_id, s_name, s_office, s_phone, s_place, s_squeeze, s_trim,
)

PHONE_LIKE = r"(\+?1?[ -]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4})"
EMAIL_LIKE = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)"


@query(
    "clean_contacts",
    f"""
    SELECT doc_id, {s_phone('p')} AS phone, {s_email('e')} AS email
    FROM (SELECT doc_id, regexp_extract(text, '{PHONE_LIKE}', 1) AS p, ' ' || regexp_extract(text, '{EMAIL_LIKE}', 1) || chr(160) AS e FROM documents)
    """,
)
def clean_contacts(t):
    found = t.documents.select(
        "doc_id", F.regexp_extract("text", PHONE_LIKE, 1).alias("phone"),
        F.concat(F.lit(" "), F.regexp_extract("text", EMAIL_LIKE, 1), F.lit(" ")).alias("email"),
    )
    return records.clean_contacts(found)


_OFFICE_SQL = """
  p_partkey, 'ST' || (p_size % 10) AS state, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS city,
  CASE p_partkey % 5 WHEN 0 THEN 'City Councilmember' WHEN 1 THEN ' council  member / ' || p_type
    WHEN 2 THEN 'Mayor' || chr(160) || '/ ' || p_type WHEN 3 THEN '' ELSE p_type || ' "At-Large"' END AS office,
  '“' || p_name || '” O''' || p_type || chr(8195) || 'Jr' AS name
"""


def _office_rows(t):
    k, kind = F.col("p_partkey") % 5, F.col("p_type")
    office = (
        F.when(k == 0, F.lit("City Councilmember")).when(k == 1, F.concat(F.lit(" council  member / "), kind))
        .when(k == 2, F.concat(F.lit("Mayor / "), kind)).when(k == 3, F.lit(""))
        .otherwise(F.concat(kind, F.lit(' "At-Large"')))
    )
    return t.part.select(
        "p_partkey", F.concat(F.lit("ST"), F.col("p_size") % 10).alias("state"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("city"), office.alias("office"),
        F.concat(F.lit("“"), F.col("p_name"), F.lit("” O'"), kind, F.lit(" Jr")).alias("name"),
    )


@query("record_ids", f"SELECT p_partkey, {s_id('state', 'city', 'office', 'name')} AS id FROM (SELECT {_OFFICE_SQL} FROM part)")
def record_ids(t):
    return records.record_ids(_office_rows(t), "state", "city", "office", "name").select("p_partkey", "id")


@query(
    "office_names",
    f"SELECT p_partkey, {s_office('office')} AS office, {s_name('name')} AS name, translate(name, '“”''', '') AS bare FROM (SELECT {_OFFICE_SQL} FROM part)",
)
def office_names(t):
    return _office_rows(t).select(
        "p_partkey", T.canonicalize_office("office").alias("office"), T.canonical_name("name").alias("name"),
        T.strip_quotes("name").alias("bare"),
    )


_PLACE_SQL = """
  c_custkey, c_mktsegment || ['', ' city', ' TOWN', ' Village', ' borough', ' CDP', ' municipality', ' city (balance)', ' County', ' Parish'][(c_custkey % 10) + 1] AS name
"""


def _place_rows(t):
    tails = F.array(*[F.lit(x) for x in ["", " city", " TOWN", " Village", " borough", " CDP", " municipality", " city (balance)", " County", " Parish"]])
    return t.customer.select("c_custkey", F.concat("c_mktsegment", F.get(tails, (F.col("c_custkey") % 10).cast("int"))).alias("name"))


@query(
    "place_names",
    f"""
    SELECT c_custkey, {s_place('name')} AS normalized,
      CASE WHEN lower(name) LIKE '% city' THEN trim(name[1:-6]) WHEN lower(name) LIKE '% town' THEN trim(name[1:-6])
        WHEN lower(name) LIKE '% village' THEN trim(name[1:-9]) WHEN lower(name) LIKE '% borough' THEN trim(name[1:-9])
        WHEN lower(name) LIKE '% cdp' THEN trim(name[1:-5]) WHEN lower(name) LIKE '% municipality' THEN trim(name[1:-14])
        WHEN lower(name) LIKE '% (balance)' THEN trim(name[1:-11]) ELSE name END AS short
    FROM (SELECT {_PLACE_SQL} FROM customer)
    """,
)
def place_names(t):
    return _place_rows(t).select("c_custkey", T.normalize_place("name").alias("normalized"), T.strip_place_suffix("name").alias("short"))


@query(
    "jurisdiction_keys",
    """
    SELECT c_custkey, upper(coalesce(st, '')) || ':' || lower(coalesce(c_mktsegment, '')) || ':' || coalesce(nullif(lv, ''), 'local') AS key
    FROM (SELECT *, CASE WHEN c_nationkey <> 3 THEN 's' || c_nationkey END AS st, ['', 'county', 'local', NULL][(c_custkey % 4) + 1] AS lv FROM customer)
    """,
)
def jurisdiction_keys(t):
    levels = F.array(F.lit(""), F.lit("county"), F.lit("local"), F.lit(None).cast("string"))
    state = F.when(F.col("c_nationkey") != 3, F.concat(F.lit("s"), F.col("c_nationkey")))
    return t.customer.select("c_custkey", T.jurisdiction_key(state, "c_mktsegment", F.get(levels, (F.col("c_custkey") % 4).cast("int"))).alias("key"))


_STATES = list(T.STATE_FIPS)


@query(
    "state_codes",
    f"""
    SELECT c_custkey, {_STATES + ['ZZ']}[(c_custkey % 53) + 1] AS usps, list_extract({list(T.STATE_FIPS.values())}, ((c_custkey % 53) + 1)::INT) AS fips
    FROM customer
    """,
)
def state_codes(t):
    codes = F.array(*[F.lit(s) for s in [*_STATES, "ZZ"]])
    usps = F.get(codes, (F.col("c_custkey") % 53).cast("int"))
    return t.customer.select("c_custkey", usps.alias("usps"), T.state_fips(F.lower(usps)).alias("fips"))


@query(
    "body_names",
    """
    SELECT s_suppkey, body, CASE WHEN lower(body) LIKE '%commissioners court%' THEN 'county' ELSE 'local' END AS level
    FROM (SELECT s_suppkey, n_name || CASE WHEN s_suppkey % 3 = 0 THEN ' Commissioners Court' ELSE ' City Council' END AS body
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    """,
)
def body_names(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    level = F.when(F.col("s_suppkey") % 3 == 0, F.lit("county")).otherwise(F.lit("local"))
    named = rows.select("s_suppkey", T.guess_body_name("n_name", level).alias("body"))
    return named.withColumn("level", T.level_from_body("body"))


@query(
    "cache_keys",
    """
    SELECT c_custkey, upper(st) || '/' || regexp_replace(regexp_replace(lower(city), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
      printf('%.4f', c_acctbal / 100) || ',' || printf('%.4f', -c_acctbal / 100) AS coords
    FROM (SELECT *, 's' || c_nationkey AS st, ' St. ' || c_name || '! ' AS city FROM customer)
    """,
)
def cache_keys(t):
    return t.customer.select(
        "c_custkey",
        T.place_slug(F.concat(F.lit("s"), F.col("c_nationkey")), F.concat(F.lit(" St. "), F.col("c_name"), F.lit("! "))).alias("slug"),
        T.coord_key(F.col("c_acctbal") / 100, -F.col("c_acctbal") / 100).alias("coords"),
    )


@query("hashed_keys", "SELECT event_id, sha256('ip-' || user_id)[1:16] AS key FROM events")
def hashed_keys(t):
    return t.events.select("event_id", T.hash_key(F.concat(F.lit("ip-"), F.col("user_id"))).alias("key"))


@query(
    "excerpts",
    f"""
    SELECT doc_id, CASE WHEN length(s) > 300 THEN s[1:300] || '…' ELSE s END AS excerpt, {s_trim('text')}[1:2000] AS note
    FROM (SELECT doc_id, text, {s_squeeze('text')} AS s FROM documents)
    """,
)
def excerpts(t):
    return t.documents.select("doc_id", T.excerpt("text").alias("excerpt"), T.clip_input("text", 2000).alias("note"))


@query(
    "absolute_urls",
    f"""
    WITH a AS (SELECT *, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM ({s_anchors()})),
    v AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS folder FROM a)
    SELECT page_id, pos, CASE pos % 6
      WHEN 0 THEN site || {s_encode('href')}
      WHEN 1 THEN site || path || '?q=' || {s_encode('href')}
      WHEN 2 THEN split_part(url, '#', 1) || '#' || {s_encode('href')}
      WHEN 3 THEN site || CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END || {s_encode('href[2:]')}
      WHEN 4 THEN regexp_extract(site, '^(https?:)', 1) || '//other.example.org' || {s_encode('href')}
      ELSE NULL END AS url
    FROM v
    """,
)
def absolute_urls(t):
    from rosterspark.functions.html import ANCHOR

    hrefs = t.pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("pos", "href"))
    h, k = F.col("href"), F.col("pos") % 6
    ref = (
        F.when(k == 0, h).when(k == 1, F.concat(F.lit("?q="), h)).when(k == 2, F.concat(F.lit("#"), h))
        .when(k == 3, F.concat(F.lit(".."), h)).when(k == 4, F.concat(F.lit("//Other.example.org:/./x/.."), h)).otherwise(F.lit(""))
    )
    return hrefs.select("page_id", F.col("pos").cast("bigint").alias("pos"), absolutize(ref, "url").alias("url"))


def raw_officials(t):
    """Raw extracted officials derived from suppliers and their nation."""
    s = F.col("s_suppkey")
    key = s.cast("string")

    def every(n, value, other=None):
        return F.when(s % n == 0, other if other is not None else F.lit(None).cast("string")).otherwise(value)

    office = F.struct(
        F.when(s % 2 == 0, F.lit(" district ")).alias("classification"), F.lit(None).cast("string").alias("name"),
        F.col("n_name").alias("city"), F.when(s % 3 == 0, F.concat(key, F.lit(" Main St "))).alias("address"),
        F.when(s % 4 == 0, F.concat(F.lit("1 (512) 555-"), F.lpad(key, 4, "0"))).alias("phone"),
        F.lit(None).cast("string").alias("fax"), F.lit("").alias("hours"),
    )
    social = F.struct(
        F.concat(F.lit("/tw/"), key).alias("twitter"), F.lit("").alias("facebook"),
        F.concat(F.lit("https://Instagram.com/"), key).alias("instagram"), F.lit(None).cast("string").alias("linkedin"),
        F.lit(None).cast("string").alias("youtube"),
    )
    raw = F.struct(
        every(10, F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")), F.lit("  ")).alias("name"),
        every(4, F.lit(" Council Member ")).alias("office"),
        every(3, F.concat(F.lit("District "), key), F.lit("")).alias("district"),
        every(6, F.concat(F.lit("(512) 555-"), F.lpad(key, 4, "0")), F.lit("")).alias("phone"),
        every(7, F.concat(F.lit("s"), key, F.lit("@x.gov")), F.lit("https://x.gov/email")).alias("email"),
        every(5, F.concat(F.lit("p/"), key)).alias("url"), F.concat(F.lit("/img/"), key).alias("photo_url"),
        social.alias("social"), every(9, F.lit("  1 Main  "), F.lit("   ")).alias("address"),
        F.array(office, office).alias("offices"), F.lit(None).cast("string").alias("hours"),
        F.lit(" Bio ").alias("bio"), F.when(s % 8 != 0, F.col("s_acctbal")).alias("confidence"),
    )
    place = F.struct(
        F.col("n_name").alias("city"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("state"),
        F.when(s % 2 == 0, F.lit("county")).alias("level"), F.lit("").alias("body"),
    )
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("s_suppkey").alias("seq"), raw.alias("raw"), place.alias("jurisdiction"),
        F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example.gov/dir/roster?x=1")).alias("source_url"),
        F.lit("2026-08-19T00:00:00Z").alias("extracted_at"),
    )


@query(
    "normalize_records",
    f"""
    WITH r AS (SELECT *, 'R' || n_regionkey AS st, CASE WHEN s_suppkey % 4 <> 0 THEN ' Council Member ' END AS off, s_suppkey::VARCHAR AS k,
        'https://' || lower(replace(n_name, '_', '_')) || '.example.gov' AS site
      FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0)
    SELECT s_suppkey AS seq, {s_id('st', 'n_name', 'off', 's_name')} AS id, s_name AS name, trim(off) AS office,
      CASE WHEN s_suppkey % 2 = 0 THEN 'county' ELSE 'local' END AS level, NULL::VARCHAR AS body,
      CASE WHEN s_suppkey % 3 <> 0 THEN 'District ' || k END AS district,
      CASE WHEN s_suppkey % 6 <> 0 THEN '512-555-' || lpad(k, 4, '0') END AS phone,
      CASE WHEN s_suppkey % 7 <> 0 THEN 's' || k || '@x.gov' END AS email,
      CASE WHEN s_suppkey % 5 <> 0 THEN site || '/dir/p/' || k END AS url, site || '/img/' || k AS photo_url,
      site || '/tw/' || k AS twitter, NULL::VARCHAR AS facebook, 'https://instagram.com/' || k AS instagram,
      CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE '1 Main' END AS address, 'Bio' AS bio,
      CASE WHEN s_suppkey % 8 <> 0 THEN s_acctbal END AS confidence,
      CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 THEN 2 ELSE 0 END AS n_offices,
      CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 4 = 0 THEN
        CASE WHEN s_suppkey % 2 = 0 THEN 'district' ELSE 'other' END || '|' || CASE WHEN s_suppkey % 3 = 0 THEN k || ' Main St' ELSE '' END
        || '|' || CASE WHEN s_suppkey % 4 = 0 THEN '512-555-' || lpad(k, 4, '0') ELSE '' END END AS first_office
    FROM r
    """,
)
def normalize_records(t):
    rows = records.normalize(raw_officials(t))
    first = F.try_element_at("offices", F.lit(1))
    return rows.select(
        "seq", "id", "name", "office", "level", "body", "district", "phone", "email", "url", "photo_url",
        F.col("social.twitter").alias("twitter"), F.col("social.facebook").alias("facebook"),
        F.col("social.instagram").alias("instagram"), "address", "bio", "confidence", F.size("offices").alias("n_offices"),
        F.when(F.size("offices") > 0, F.concat_ws("|", first["classification"], F.coalesce(first["address"], F.lit("")), F.coalesce(first["phone"], F.lit("")))).alias("first_office"),
    )
