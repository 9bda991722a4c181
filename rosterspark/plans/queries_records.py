"""Queries for duplicates, keyed merges, unions, coverage and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterspark.functions import offices as O
from rosterspark.operators import qa, records, serve
from rosterspark.plans.catalog import Tables, query, s_id, s_squeeze
from rosterspark.plans.queries_text import raw_officials
from rosterspark.schema import OFFICE_KEYS, SOCIAL_KEYS


@query(
    "best_by_confidence",
    """
    SELECT digest, arg_max(doc_id, (coalesce(quality, 0), -doc_id)) AS doc_id, min(doc_id) AS first_doc, max(coalesce(quality, 0))::BIGINT AS best
    FROM (SELECT md5(text) AS digest, d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id)) GROUP BY 1
    """,
)
def best_by_confidence(t):
    docs = t.documents.select(F.md5("text").alias("digest"), "doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    best = records.dedupe_best(docs.withColumn("seq", F.col("doc_id")), "digest", "quality")
    return best.select("digest", "doc_id", F.col("seq").alias("first_doc"), F.coalesce("quality", F.lit(0)).cast("bigint").alias("best"))


@query(
    "latest_wins",
    "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1",
)
def latest_wins(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return records.latest_per_key(rows, "o_custkey", "o_orderkey")


@query(
    "first_wins",
    "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1",
)
def first_wins(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("priority"))
    return records.first_per_key(rows, "o_custkey", "o_orderkey")


@query(
    "shared_values",
    """
    WITH v AS (SELECT event_id, event_type, CASE WHEN event_id % 4 <> 0 THEN props END AS photo, 'u' || user_id AS link, strftime(ts, '%d') AS day FROM events)
    SELECT event_id, CASE WHEN count(photo) OVER (PARTITION BY event_type, day, photo) < 3 THEN photo END AS photo,
      CASE WHEN count(link) OVER (PARTITION BY event_type, day, link) < 3 THEN link END AS link
    FROM v
    """,
)
def shared_values(t):
    rows = t.events.select(
        "event_id", "event_type", F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("photo"),
        F.concat(F.lit("u"), F.col("user_id")).alias("link"), F.date_format("ts", "dd").alias("day"),
    )
    return records.strip_shared(rows, ["event_type", "day"], ["photo", "link"], "event_id").select("event_id", "photo", "link")


@query(
    "shared_media",
    """
    WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS batch, '/p/' || (o_orderkey % 5000) AS photo_url, 'tw' || (o_custkey % 97) AS twitter, 'fb' || o_custkey AS facebook FROM orders)
    SELECT id, CASE WHEN count(*) OVER (PARTITION BY batch, photo_url) < 3 THEN photo_url END AS photo_url,
      CASE WHEN count(*) OVER (PARTITION BY batch, twitter) < 3 THEN twitter END AS twitter, CASE WHEN count(*) OVER (PARTITION BY batch, facebook) < 3 THEN facebook END AS facebook
    FROM r
    """,
)
def shared_media(t):
    k = F.col("o_custkey")
    keys = {"twitter": F.concat(F.lit("tw"), k % 97), "facebook": F.concat(F.lit("fb"), k)}
    social = F.struct(*[keys.get(p, F.lit(None).cast("string")).alias(p) for p in SOCIAL_KEYS])
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("batch"),
        F.concat(F.lit("/p/"), F.col("o_orderkey") % 5000).alias("photo_url"), social.alias("social"),
    )
    return records.strip_shared_media(rows, ["batch"]).select("id", "photo_url", "social.twitter", "social.facebook")


# --- upserts --------------------------------------------------------------------------------


@query(
    "upsert_merge",
    """
    WITH r AS (SELECT o_custkey AS k, o_orderkey AS ord, o_orderstatus AS src, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS phone,
        CASE WHEN o_orderkey % 4 <> 0 THEN 'a' || o_orderkey END AS address FROM orders)
    SELECT k, arg_max(src, ord) AS src, coalesce(arg_max(phone, ord) FILTER (phone <> ''), (array_agg(phone ORDER BY ord))[1]) AS phone,
      coalesce(arg_max(address, ord) FILTER (address <> ''), (array_agg(address ORDER BY ord))[1]) AS address
    FROM r GROUP BY 1
    """,
)
def upsert_merge(t):
    n = F.col("o_orderkey")
    rows = t.orders.select(
        F.col("o_custkey").alias("k"), n.alias("ord"), F.col("o_orderstatus").alias("src"),
        F.when(n % 3 == 0, F.lit(None)).when(n % 5 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("phone"),
        F.when(n % 4 != 0, F.concat(F.lit("a"), n)).alias("address"),
    )
    return records.merge_fields(rows, "k", "ord", ["phone", "address"], ["src"])


@query(
    "merge_reverse",
    """
    WITH r AS (SELECT o_custkey AS k, o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS phone FROM orders)
    SELECT k, coalesce(arg_min(phone, ord) FILTER (phone <> ''), (array_agg(phone ORDER BY ord DESC))[1]) AS phone FROM r GROUP BY 1
    """,
)
def merge_reverse(t):
    n = F.col("o_orderkey")
    rows = t.orders.select(
        F.col("o_custkey").alias("k"), n.alias("ord"),
        F.when(n % 3 == 0, F.lit(None)).when(n % 5 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("phone"),
    )
    return records.merge_reverse(rows, "k", "ord", ["phone"])


def _official(key, n, **fields):
    """Canonical record columns; unnamed ones are null."""
    from rosterspark.schema import OFFICIAL

    out = {"id": key, "name": F.concat(F.lit("N"), n), "level": F.lit("local"), "extracted_at": F.lit("2026-08-19T00:00:00Z"), **fields}
    return [(out[f.name] if f.name in out else F.lit(None)).cast(f.dataType).alias(f.name) for f in OFFICIAL]


def _office(kind, city, phone):
    known = {"classification": kind, "city": city, "phone": phone}
    return F.struct(*[known.get(k, F.lit(None)).cast("string").alias(k) for k in OFFICE_KEYS])


def _order_officials(t: Tables):
    """Orders as records of their customer; the smallest order of each is the stored one."""
    n = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    office = F.array(
        _office(F.lit("main"), F.concat(F.lit("C"), n % 3), F.when(n % 2 == 0, F.concat(F.lit("p"), n))),
        _office(F.lit("main"), F.concat(F.lit("c"), n % 3), F.when(n % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("q"), n))),
    )
    social = F.struct(*[F.when(n % (i + 2) == 0, F.concat(F.lit(k), n)).alias(k) for i, k in enumerate(SOCIAL_KEYS)])
    rows = t.orders.select(
        *_official(
            F.concat(F.lit("id"), F.col("o_custkey")), n, office=F.col("o_orderpriority"), source_url=F.col("o_orderstatus"),
            phone=F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), n)), email=F.when(n % 5 == 0, F.concat(F.lit("e"), n)),
            bio_checked_at=F.when(n % 2 == 0, day), confidence=F.col("o_totalprice"), social=social, offices=F.when(n % 4 != 0, office),
        ),
        n.alias("seq"),
    )
    stored = records.first_per_key(rows, "id", "seq")
    incoming = rows.join(stored.select("id", "seq"), ["id", "seq"], "left_anti")
    return stored.drop("seq"), incoming


@query(
    "upsert_records",
    """
    WITH r AS (SELECT 'id' || o_custkey AS id, o_orderkey AS n, o_orderpriority AS office, o_orderstatus AS source_url, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 't' || o_orderkey END AS phone,
        CASE WHEN o_orderkey % 5 = 0 THEN 'e' || o_orderkey END AS email, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS checked,
        o_totalprice AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'twitter' || o_orderkey END AS twitter, CASE WHEN o_orderkey % 6 = 0 THEN 'youtube' || o_orderkey END AS youtube FROM orders)
    SELECT id, 'N' || max(n) AS name, arg_max(office, n) AS office, arg_max(source_url, n) AS source_url,
      coalesce(arg_max(phone, n) FILTER (phone <> ''), (array_agg(phone ORDER BY n))[1]) AS phone, arg_max(email, n) FILTER (email <> '') AS email,
      (array_agg(checked ORDER BY n DESC))[1] AS bio_checked_at, arg_max(confidence, n) AS confidence,
      arg_max(twitter, n) FILTER (twitter <> '') AS twitter, arg_max(youtube, n) FILTER (youtube <> '') AS youtube
    FROM r GROUP BY 1
    """,
)
def upsert_records(t):
    merged = records.merge_records(*_order_officials(t))
    return merged.select(
        "id", "name", "office", "source_url", "phone", "email", "bio_checked_at", "confidence", "social.twitter", "social.youtube"
    )


# Each record lists the same office key twice ('C1' and 'c1'); the first row of an id keeps the last of them,
# later rows fold both, then rows fold by key in order.
@query(
    "upsert_offices",
    """
    WITH r AS (SELECT o_custkey AS id, o_orderkey AS n, min(o_orderkey) OVER (PARTITION BY o_custkey) AS n0, count(*) OVER (PARTITION BY o_custkey) AS cnt FROM orders),
    e AS (SELECT *, p, CASE p WHEN 0 THEN 'C' ELSE 'c' END || (n % 3) AS city, CASE WHEN p = 0 THEN CASE WHEN n % 2 = 0 THEN 'p' || n END ELSE CASE WHEN n % 7 = 0 THEN '' ELSE 'q' || n END END AS phone
      FROM r, (SELECT unnest([0, 1]) AS p) WHERE n % 4 <> 0),
    m AS (SELECT id, lower(city) AS k, arg_max(city, (n, p)) AS city, arg_max(phone, (n, p)) FILTER (phone <> '') AS phone,
        (array_agg(phone ORDER BY n, p))[1] AS fallback, min((n, p)) AS first_at FROM e WHERE cnt > 1 AND NOT (n = n0 AND p = 0) GROUP BY 1, 2),
    s AS (SELECT id, string_agg(city || '=' || coalesce(phone, fallback, '~'), ',' ORDER BY first_at) AS offices, count(*) AS n_offices FROM m GROUP BY 1),
    one AS (SELECT id, string_agg(city || '=' || coalesce(phone, '~'), ',' ORDER BY p) AS offices, count(*) AS n_offices FROM e WHERE cnt = 1 GROUP BY 1)
    SELECT 'id' || r.id AS id, coalesce(s.offices, one.offices, '') AS offices, coalesce(s.n_offices, one.n_offices, 0) AS n_offices
    FROM (SELECT DISTINCT id FROM r) r LEFT JOIN s ON s.id = r.id LEFT JOIN one ON one.id = r.id
    """,
)
def upsert_offices(t):
    merged = records.merge_records(*_order_officials(t))
    label = F.transform("offices", lambda o: F.concat(o["city"], F.lit("="), F.coalesce(o["phone"], F.lit("~"))))
    return merged.select(
        "id", F.coalesce(F.array_join(label, ","), F.lit("")).alias("offices"), F.greatest(F.lit(0), F.coalesce(F.size("offices"), F.lit(0))).cast("bigint").alias("n_offices")
    )


@query(
    "office_lists",
    """
    WITH b AS (SELECT p_partkey, p_brand, p_type, p_size FROM part)
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'main:' || p_brand || ':in' ELSE 'main:' || p_brand || ':old2' END
        || CASE WHEN p_size % 3 = 0 THEN '' ELSE ',other:' || p_type || ':x' END AS incoming_wins,
      'main:' || p_brand || ':old2' || CASE WHEN p_size % 3 = 0 THEN '' ELSE ',other:' || p_type || ':x' END AS existing_wins
    FROM b
    """,
)
def office_lists(t):
    brand, kind, n = F.col("p_brand"), F.col("p_type"), F.col("p_size")
    existing = F.array(_office(F.lit("main"), F.lower(brand), F.lit("old1")), _office(F.lit("main"), brand, F.lit("old2")))
    incoming = F.concat(
        F.array(_office(F.lit("main"), F.when(n % 2 == 0, brand).otherwise(F.upper(brand)), F.when(n % 2 == 0, F.lit("in")))),
        F.when(n % 3 != 0, F.array(_office(F.lit("other"), kind, F.lit("x")))).otherwise(O.no_offices()),
    )

    def label(wins):
        merged = O.merge_office_lists(existing, incoming, incoming_wins=wins)
        shown = F.transform(merged, lambda o: F.concat_ws(":", o["classification"], F.when(F.lower(o["city"]) == F.lower(brand), brand).otherwise(o["city"]), o["phone"]))
        return F.array_join(shown, ",")

    return t.part.select("p_partkey", label(True).alias("incoming_wins"), label(False).alias("existing_wins"))


@query(
    "merge_enrichment",
    """
    SELECT seq, CASE WHEN k % 6 <> 0 THEN '512-555-' || lpad(k::VARCHAR, 4, '0') WHEN k % 5 <> 0 THEN '999-555-' || lpad(k::VARCHAR, 4, '0') END AS phone,
      CASE WHEN k % 9 <> 0 OR k % 5 = 0 THEN CASE WHEN k % 9 = 0 THEN '' ELSE '1 Main' END ELSE 'New ' || k END AS address,
      CASE WHEN k % 5 <> 0 THEN '9-5' END AS hours, CASE WHEN k % 5 <> 0 THEN 'https://d.gov/fb/' || k END AS facebook,
      CASE WHEN k % 5 <> 0 THEN '2026-09-01' END AS bio_checked_at,
      (CASE WHEN k % 3 = 0 OR k % 4 = 0 THEN 2 ELSE 0 END)::BIGINT AS old_offices, (CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 3 = 0 OR k % 4 = 0 THEN 2 ELSE 1 END WHEN k % 3 = 0 OR k % 4 = 0 THEN 2 ELSE 0 END)::BIGINT AS n_offices
    FROM (SELECT s_suppkey AS seq, s_suppkey AS k FROM supplier WHERE s_suppkey % 10 <> 0)
    """,
)
def merge_enrichment(t):
    found = records.normalize(raw_officials(t)).withColumn("key", F.col("seq"))
    k = F.col("s_suppkey").cast("string")
    detail = F.struct(
        F.concat(F.lit("999555"), F.lpad(k, 4, "0")).alias("phone"), F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("photo_url"),
        F.struct(*[(F.concat(F.lit("fb/"), k) if p == "facebook" else F.lit(None).cast("string")).alias(p) for p in SOCIAL_KEYS]).alias("social"),
        F.concat(F.lit(" New "), k).alias("address"), F.array(_office(F.lit("extra"), F.lit("X"), F.lit("5125550000"))).alias("offices"),
        F.lit("9-5").alias("hours"), F.lit("B2").alias("bio"),
    )
    details = t.supplier.filter(F.col("s_suppkey") % 5 != 0).select(
        F.col("s_suppkey").alias("key"), detail.alias("detail"), F.lit("https://d.gov/x").alias("source_url"), F.lit("2026-09-01").alias("extracted_at")
    )
    merged = records.merge_enrichment(found.withColumn("old_offices", F.size("offices").cast("bigint")), details, key="key")
    return merged.select(
        "seq", "phone", "address", "hours", "social.facebook", "bio_checked_at", "old_offices",
        F.size(F.filter("offices", lambda o: (o["classification"] != "extra") | (o["city"] == "X"))).cast("bigint").alias("n_offices"),
    )


@query(
    "merge_places",
    """
    SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'dc@Addr' ELSE 'district' END || ',' || 'district' || CASE WHEN p_size % 3 = 0 THEN ',dc@Addr' ELSE '' END AS offices FROM part
    """,
)
def merge_places(t):
    n = F.col("p_size")
    field = F.array(_office(F.lit("district"), F.col("p_brand"), F.lit("1")), _office(F.lit("district"), F.lit("Z"), F.lit("2")))

    def dc(when, city, phone):
        o = _office(F.lit("dc"), city, phone)
        with_address = F.struct(*[(F.lit("Addr") if k == "address" else o[k]).alias(k) for k in OFFICE_KEYS])
        return F.when(when, F.array(with_address, with_address)).otherwise(O.no_offices())

    merged = O.merge_same_place(field, dc(n % 2 == 0, F.upper("p_brand"), F.lit("1")), dc(n % 3 == 0, F.lit("Q"), F.lit("3")))
    shown = F.transform(merged, lambda o: F.concat_ws("@", o["classification"], o["address"]))
    return t.part.select("p_partkey", F.array_join(shown, ",").alias("offices"))


# --- collapse -------------------------------------------------------------------------------


@query(
    "collapse_rows",
    """
    SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS base_order,
      arg_max(status, (o_orderdate, -o_orderkey)) FILTER (status IS NOT NULL) AS status, arg_max(priority, (o_orderdate, -o_orderkey)) FILTER (priority IS NOT NULL) AS priority, count(*) AS n
    FROM (SELECT *, nullif(o_orderstatus, 'O') AS status, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders) GROUP BY 1
    """,
)
def collapse_rows(t):
    rows = t.orders.select(
        "o_custkey", F.col("o_orderkey").alias("base_order"), "o_orderdate", F.nullif("o_orderstatus", F.lit("O")).alias("status"),
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"), F.col("o_orderkey").alias("seq"),
    )
    out = records.collapse_rows(rows, "o_custkey", F.col("o_orderdate"), "seq", ["base_order"], ["status", "priority"])
    return out.withColumnRenamed("_n", "n")


def _duplicates(t):
    n = F.col("o_orderkey")
    social = F.struct(*[F.when(n % (i + 2) == 0, F.concat(F.lit(k), n)).alias(k) for i, k in enumerate(SOCIAL_KEYS)])
    place = F.struct(F.concat(F.lit("C"), F.col("o_custkey")).alias("city"), F.lit("TX").alias("state"))
    return t.orders.select(
        *_official(
            F.concat(F.lit("old"), n), n, office=F.when(n % 2 == 0, F.lit("Councilmember")).otherwise(F.lit("City Council Member")), jurisdiction=place,
            phone=F.when(n % 3 == 0, F.concat(F.lit("t"), n)), bio=F.when(n % 5 == 0, F.lit("")), social=F.when(n % 7 != 0, social),
            offices=F.when(n % 4 == 0, F.array(_office(F.lit("m"), F.lit("c"), n))), extracted_at=F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        ),
        n.alias("seq"),
    ).withColumn("name", F.lit('José "Pat" Vela'))


_DUP_SQL = f"""
    WITH r AS (SELECT {s_id("'TX'", "'C' || o_custkey", "'Councilmember'", "'José Pat Vela'")} AS id, o_orderkey AS n, o_orderdate AS d,
        CASE WHEN o_orderkey % 3 = 0 THEN 't' || o_orderkey END AS phone, CASE WHEN o_orderkey % 5 = 0 THEN '' END AS bio, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0 THEN 'twitter' || o_orderkey END AS twitter,
        CASE WHEN o_orderkey % 7 <> 0 THEN 1 END AS has_social, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS office FROM orders),
    g AS (SELECT id, count(*) AS cnt, arg_max(n, (d, -n)) AS base, arg_max(phone, (d, -n)) FILTER (phone IS NOT NULL) AS phone, arg_max(bio, (d, -n)) FILTER (bio IS NOT NULL) AS bio,
        arg_max(twitter, (d, -n)) FILTER (twitter IS NOT NULL) AS twitter, max(has_social) IS NOT NULL AS has_social, arg_max(office, (d, -n)) FILTER (office IS NOT NULL)::VARCHAR AS office_phone FROM r GROUP BY 1)
"""


@query(
    "collapse_duplicates",
    _DUP_SQL + "SELECT id, CASE WHEN base % 2 = 0 THEN 'Councilmember' ELSE 'City Council Member' END AS office, phone, bio, twitter, has_social, office_phone FROM g",
)
def collapse_duplicates(t):
    rows = records.collapse_duplicates(_duplicates(t))
    return rows.select(
        "id", "office", "phone", "bio", "social.twitter", F.col("social").isNotNull().alias("has_social"),
        F.try_element_at("offices", F.lit(1))["phone"].alias("office_phone"),
    )


@query(
    "collapse_report",
    _DUP_SQL + "SELECT sum((cnt > 1)::INT)::BIGINT AS groups, sum(cnt - 1)::BIGINT AS removed, sum(cnt)::BIGINT AS before, count(*) AS after FROM g",
)
def collapse_report(t):
    return records.collapse_report(records.collapse_duplicates(_duplicates(t)))


# --- coverage, unions, drift ----------------------------------------------------------------


@query(
    "coverage",
    """
    SELECT n_name AS state, count(*) AS count, coalesce(string_agg(DISTINCT nullif(seg, ''), ',' ORDER BY nullif(seg, '')), '') AS cities
    FROM (SELECT n_name, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY 1
    """,
)
def coverage(t):
    seg = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", seg.alias("city"))
    return records.coverage_stats(rows, "n_name", "city").withColumn("cities", F.array_join("cities", ","))


@query(
    "coverage_upsert",
    """
    SELECT n_name AS state, CASE WHEN n_nationkey % 3 = 0 THEN nc ELSE ns END AS count, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'old' END AS updated
    FROM nation JOIN (SELECT c_nationkey AS k, count(*) AS nc FROM customer GROUP BY 1) ON k = n_nationkey JOIN (SELECT s_nationkey AS k2, count(*) AS ns FROM supplier GROUP BY 1) ON k2 = n_nationkey
    UNION ALL SELECT n_name, ns, 'old' FROM nation JOIN (SELECT s_nationkey AS k2, count(*) AS ns FROM supplier GROUP BY 1) ON k2 = n_nationkey WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)
    UNION ALL SELECT n_name, nc, 'new' FROM nation JOIN (SELECT c_nationkey AS k, count(*) AS nc FROM customer GROUP BY 1) ON k = n_nationkey WHERE n_nationkey % 3 = 0 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
    """,
)
def coverage_upsert(t):
    from rosterspark.sources.writers import upsert_coverage

    n = t.nation
    old = records.coverage_stats(t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")), "n_name", "s_name").withColumn("updated", F.lit("old"))
    fresh = t.customer.join(n.filter(F.col("n_nationkey") % 3 == 0), F.col("c_nationkey") == F.col("n_nationkey"))
    new = records.coverage_stats(fresh, "n_name", "c_mktsegment").withColumn("updated", F.lit("new"))
    return upsert_coverage(old, new).select("state", "count", "updated")


@query(
    "override_union",
    """
    WITH b AS (SELECT c_mktsegment AS name, c_nationkey AS k, max(c_custkey) AS id, min(c_custkey) AS pos FROM customer GROUP BY 1, 2),
    o AS (SELECT ['BUILDING', 'MACHINERY', 'X'][(s_suppkey % 3) + 1] AS name, s_nationkey AS k, max(s_suppkey) AS id, min(s_suppkey) AS pos FROM supplier GROUP BY 1, 2)
    SELECT coalesce(o.name, b.name) AS name, coalesce(o.k, b.k)::BIGINT AS k, CASE WHEN o.id IS NOT NULL THEN 's' || o.id ELSE 'c' || b.id END AS id,
      CASE WHEN b.id IS NULL THEN 1 ELSE 0 END::BIGINT AS side, coalesce(b.pos, o.pos) AS pos
    FROM b FULL JOIN o ON b.name = o.name AND b.k = o.k
    """,
)
def override_union(t):
    base = t.customer.select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("bigint").alias("k"), F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("seq"))
    names = F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("X"))
    over = t.supplier.select(
        F.get(names, (F.col("s_suppkey") % 3).cast("int")).alias("name"), F.col("s_nationkey").cast("bigint").alias("k"),
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.col("s_suppkey").alias("seq"),
    )
    out = records.override_union(base, over, ["name", "k"])
    return out.select("name", "k", "id", F.col("position._side").cast("bigint").alias("side"), F.col("position._seq").alias("pos"))


@query(
    "staged_jurisdictions",
    """
    SELECT upper(st) || ':' || lower(city) || ':' || lv AS key, arg_max(city, c_custkey) AS city, arg_max(lv, c_custkey) AS level,
      arg_max('u' || c_custkey, c_custkey) AS url FROM (SELECT *, 's' || (c_nationkey % 5) AS st, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS city,
      CASE WHEN c_custkey % 3 = 0 THEN 'county' ELSE 'local' END AS lv FROM customer) GROUP BY 1
    """,
)
def staged_jurisdictions(t):
    n = F.col("c_custkey")
    place = F.struct(
        F.when(n % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("city"), F.concat(F.lit("s"), F.col("c_nationkey") % 5).alias("state")
    )
    rows = t.customer.select(
        place.alias("jurisdiction"), F.when(n % 3 == 0, F.lit("county")).otherwise(F.lit("local")).alias("level"), F.lit("b").alias("body"),
        F.concat(F.lit("u"), n).alias("source_url"), F.lit("t").alias("extracted_at"), n.alias("seq"),
    )
    out = records.jurisdictions_of(rows)
    return out.select("key", "city", "level", F.try_element_at("urls", F.lit(1)).alias("url"))


@query(
    "source_groups",
    "SELECT CASE WHEN lang = 'fr' THEN NULL ELSE source END AS source_url, count(*) AS records FROM documents WHERE lang <> 'fr' GROUP BY 1",
)
def source_groups(t):
    rows = t.documents.select(F.when(F.col("lang") != "fr", F.col("source")).alias("source_url"))
    return qa.group_by_source(rows)


def _stored_and_fresh(t):
    stored = t.orders.select(F.col("o_custkey").cast("string").alias("source_url"), F.concat(F.lit(" Name "), F.floor(F.col("o_orderkey") % 40)).alias("name"))
    fresh = t.orders.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_custkey").cast("string").alias("source_url"), F.concat(F.lit("NAME "), F.floor((F.col("o_orderkey") + F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0)) % 40)).alias("name")
    )
    return stored, fresh


_QA_SQL = """
    WITH s AS (SELECT o_custkey::VARCHAR AS source_url, 'name ' || (o_orderkey % 40) AS name FROM orders),
    f AS (SELECT o_custkey::VARCHAR AS source_url, 'name ' || ((o_orderkey + (o_orderpriority = '5-LOW')::INT) % 40) AS name FROM orders WHERE o_orderstatus <> 'P'),
    miss AS (SELECT * FROM s EXCEPT SELECT * FROM f), fresh_only AS (SELECT * FROM f EXCEPT SELECT * FROM s)
"""


@query("qa_changes", _QA_SQL + "SELECT source_url, name, 'missing' AS change FROM miss UNION ALL SELECT source_url, name, 'new' FROM fresh_only")
def qa_changes(t):
    return qa.name_changes(*_stored_and_fresh(t))


@query(
    "qa_diff",
    _QA_SQL + """
    SELECT k.source_url, (SELECT count(*) FROM s WHERE s.source_url = k.source_url) AS stored_count, (SELECT count(*) FROM f WHERE f.source_url = k.source_url) AS fresh_count,
      (SELECT count(*) FROM miss WHERE miss.source_url = k.source_url) AS missing_from_fresh, (SELECT count(*) FROM fresh_only x WHERE x.source_url = k.source_url) AS new_in_fresh
    FROM (SELECT source_url FROM miss UNION SELECT source_url FROM fresh_only) k
    """,
)
def qa_diff(t):
    return qa.qa_diff(*_stored_and_fresh(t))


@query(
    "qa_lists",
    _QA_SQL + """
    SELECT k.source_url, coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM miss WHERE miss.source_url = k.source_url), '') AS missing_names,
      coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM fresh_only x WHERE x.source_url = k.source_url), '') AS new_names
    FROM (SELECT source_url FROM miss UNION SELECT source_url FROM fresh_only) k
    """,
)
def qa_lists(t):
    out = qa.qa_lists(*_stored_and_fresh(t))
    return out.select("source_url", F.array_join("missing_names", ",").alias("missing_names"), F.array_join("new_names", ",").alias("new_names"))


@query(
    "official_summaries",
    """
    SELECT s_nationkey::BIGINT AS s_nationkey, string_agg(s_name || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' (Seat ' || (s_suppkey % 4) || ')' END, ', ' ORDER BY s_suppkey) AS summary FROM supplier GROUP BY 1
    """,
)
def official_summaries(t):
    n = F.col("s_suppkey")
    rows = t.supplier.select(
        F.col("s_nationkey").cast("bigint").alias("s_nationkey"), "s_name", F.when(n % 3 != 0, F.concat(F.lit("Seat "), n % 4)).alias("office"), n.alias("seq")
    )
    return serve.summarize_officials(rows, ["s_nationkey"], "s_name")


@query("squeezed_texts", f"SELECT conv_id, turn, md5({s_squeeze('text')}) AS digest FROM conversations")
def squeezed_texts(t):
    from rosterspark.functions.text import squeeze

    return t.conversations.select("conv_id", "turn", F.md5(squeeze("text")).alias("digest"))
