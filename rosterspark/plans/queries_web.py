"""Queries over landed pages: text, candidates, probes, requests and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterspark.functions import html as H
from rosterspark.functions.urls import check_submission_url, url_origin
from rosterspark.operators import extraction, web
from rosterspark.plans.catalog import S_NOISE, query, s_anchors, s_encode, s_tag_free, s_text, s_trim

STATUSES = [200, 403, 404, 429, 503, 500, 200]


@query(
    "page_text",
    f"""
    SELECT page_id, length(txt) AS n_chars, md5(txt) AS digest, length(txt) < 500 AS needs_browser,
      {STATUSES}[(page_id % 7) + 1] IN (403, 429, 503) AS blocked
    FROM (SELECT page_id, {s_text('html')} AS txt FROM pages)
    """,
)
def page_text(t):
    status = F.get(F.array(*[F.lit(s) for s in STATUSES]), (F.col("page_id") % 7).cast("int"))
    pages = web.page_quality(web.page_text(t.pages.withColumn("status", status)), status="status")
    return pages.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "needs_browser", "blocked")


@query(
    "host_quality",
    f"""
    SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, count(*) AS pages, sum((length(txt) < 2500)::INT)::BIGINT AS short_pages
    FROM (SELECT url, {s_text('html')} AS txt FROM pages) GROUP BY 1
    """,
)
def host_quality(t):
    """Flagship: visible text, thin pages and page counts per site."""
    pages = web.page_text(t.pages).select(url_origin("url").alias("site"), (F.length("text") < 2500).alias("short"))
    return pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.count_if("short").alias("short_pages"))


# --- candidates -----------------------------------------------------------------------------

# Markup derived from each page's own address and number, put in front of the page.
_MARK_SQL = """'<p>Head ' || page_id || '</p><IMG class="x" SRC="/photos/' || page_id || '.jpg" alt=" P ' || page_id || ' "><img src="/site-logo.png">'
  || '<img src="data:image/png;base64,AA"><img alt="none"><img src="b/' || (page_id % 5) || '.png"><p>mid</p><img src="/photos/' || page_id || '.jpg">'
  || '<a href="mailto:o' || page_id || '@x.gov?subject=hi">Mail <b>us</b></a><a href="MAILTO:o' || page_id || '@x.gov">again</a><a href="mailto:?x">none</a>'
  || '<a class="s" href="https://www.facebook.com/p' || page_id || '"><i>Face</i> book</a><a href="https://x.com/p">X</a><a href="https://notx.com/p">not</a>'
  || '<a href="https://youtu.be/' || page_id || '">Y</a><a href="https://x.com/p">X again</a><a href="https://bsky.app/z">B</a>'"""


def _marked(t):
    k = F.col("page_id").cast("string")
    front = [
        "<p>Head ", k, '</p><IMG class="x" SRC="/photos/', k, '.jpg" alt=" P ', k, ' "><img src="/site-logo.png">',
        '<img src="data:image/png;base64,AA"><img alt="none"><img src="b/', (F.col("page_id") % 5).cast("string"),
        '.png"><p>mid</p><img src="/photos/', k, '.jpg">',
        '<a href="mailto:o', k, '@x.gov?subject=hi">Mail <b>us</b></a><a href="MAILTO:o', k, '@x.gov">again</a><a href="mailto:?x">none</a>',
        '<a class="s" href="https://www.facebook.com/p', k, '"><i>Face</i> book</a><a href="https://x.com/p">X</a><a href="https://notx.com/p">not</a>',
        '<a href="https://youtu.be/', k, '">Y</a><a href="https://x.com/p">X again</a><a href="https://bsky.app/z">B</a>',
    ]
    parts = [F.lit(p) if isinstance(p, str) else p for p in front]
    return t.pages.withColumn("html", F.concat(*parts, F.col("html")))


def _starts_sql(pattern: str, alias: str) -> str:
    """1-based match starts from the pieces between matches."""
    return f"""list_transform(range(1, len({alias}_m) + 1), lambda i: 1 + list_sum(list_transform({alias}_p[1:i], lambda p: length(p)))
      + coalesce(list_sum(list_transform({alias}_m[1:i-1], lambda p: length(p))), 0))"""


_IMG = r"(?i)<img\b[^>]*>"
_CONTEXT = "html[greatest(start - 200, 1)::INT:(start + 199)::INT]"


@query(
    "page_images",
    f"""
    WITH h AS (SELECT page_id, url, {_MARK_SQL} || html AS html FROM pages),
    s AS (SELECT *, regexp_extract_all(html, '{_IMG}') AS i_m, string_split_regex(html, '{_IMG}') AS i_p FROM h),
    m AS (SELECT page_id, url, html, unnest(i_m) AS tag, unnest({_starts_sql(_IMG, 'i')}) AS start FROM s),
    r AS (SELECT *, regexp_extract(tag, '(?i)\\bsrc=["'']([^"'']+)["'']', 1) AS ref, trim(regexp_extract(tag, '(?i)\\balt=["'']([^"'']*)["'']', 1)) AS alt,
        regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, regexp_extract(url, '^https?://[^/?#]*([^?#]*/)', 1) AS folder FROM m),
    u AS (SELECT *, CASE WHEN ref[1] = '/' THEN site || ref ELSE site || folder || ref END AS src FROM r
      WHERE ref <> '' AND NOT regexp_matches(ref, '(?i)^data:') AND NOT regexp_matches(ref, '(?i)logo|icon|sprite|favicon')),
    d AS (SELECT *, row_number() OVER (PARTITION BY page_id, src ORDER BY start) AS n FROM u)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY start) - 1 AS pos, src, alt, {s_tag_free(_CONTEXT)} AS context
    FROM d WHERE n = 1
    """,
)
def page_images(t):
    found = web.image_candidates(_marked(t)).select("page_id", "images")
    return web.explode_candidates(found, "images").withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "page_emails",
    f"""
    WITH a AS (SELECT page_id, pos, {s_tag_free('raw')} AS text, {s_trim("split_part(split_part(href[8:], '?', 1), '#', 1)")} AS email
      FROM ({s_anchors("html", "", f"(SELECT page_id, url, {_MARK_SQL} || html AS html FROM pages)")}) WHERE lower(href) LIKE 'mailto:%'),
    d AS (SELECT *, row_number() OVER (PARTITION BY page_id, email ORDER BY pos) AS n FROM a WHERE email <> '')
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, email, text FROM d WHERE n = 1
    """,
)
def page_emails(t):
    found = web.media_candidates(_marked(t), context=False).select("page_id", "emails")
    return web.explode_candidates(found, "emails").select("page_id", F.col("pos").cast("bigint").alias("pos"), "email", "text")


@query(
    "page_social",
    f"""
    WITH a AS (SELECT page_id, pos, {s_tag_free('raw')} AS text, href AS url, regexp_extract(href, '^https?://([^/]*)', 1) AS host
      FROM ({s_anchors("html", "", f"(SELECT page_id, url, {_MARK_SQL} || html AS html FROM pages)")})),
    p AS (SELECT *, CASE WHEN regexp_matches(host, '(^|\\.)(twitter\\.com|x\\.com)$') THEN 'twitter' WHEN regexp_matches(host, '(^|\\.)facebook\\.com$') THEN 'facebook'
      WHEN regexp_matches(host, '(^|\\.)(youtube\\.com|youtu\\.be)$') THEN 'youtube' WHEN host = 'bsky.app' THEN 'bluesky' END AS platform FROM a),
    d AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS n FROM p WHERE platform IS NOT NULL)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, platform, url, text FROM d WHERE n = 1
    """,
)
def page_social(t):
    found = web.media_candidates(_marked(t), context=False).select("page_id", "social_links")
    return web.explode_candidates(found, "social_links").select("page_id", F.col("pos").cast("bigint").alias("pos"), "platform", "url", "text")


_LINKS_SQL = f"""
    WITH a AS (SELECT page_id, pos, split_part(url, '#', 1) AS self, href, {s_tag_free('raw')} AS text, site || {s_encode('href')} AS url
      FROM ({s_anchors("html", "", "SRC")})),
    k AS (SELECT * FROM a WHERE url <> self AND NOT regexp_matches(href, '{S_NOISE}')),
    d AS (SELECT page_id, url, min(pos) AS pos, coalesce(arg_min(text, pos) FILTER (text <> ''), '') AS text FROM k GROUP BY 1, 2),
    r AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, url, text FROM d)
    SELECT * FROM r WHERE pos < 80
"""


@query("page_links", _LINKS_SQL.replace("SRC", "pages"))
def page_links(t):
    found = web.media_candidates(t.pages, context=False).select("page_id", "links")
    return web.explode_candidates(found, "links").select("page_id", F.col("pos").cast("bigint").alias("pos"), "url", "text")


# Every page gets an empty link, 90 own links and a later text for the first one.
@query(
    "page_links_capped",
    _LINKS_SQL.replace(
        "SRC",
        """(SELECT page_id, url, '<a href="/late"><img></a>' || coalesce((SELECT string_agg('<a href="/n/' || i || '">' || i || '</a>', '' ORDER BY i) FROM range(page_id % 90) r(i)), '')
        || '<a href="/late">Named</a><a href="/news/1">n</a>' AS html FROM pages)""",
    ),
)
def page_links_capped(t):
    numbers = F.transform(
        F.sequence(F.lit(0), F.lit(89)),
        lambda i: F.when(i < F.col("page_id") % 90, F.concat(F.lit('<a href="/n/'), i, F.lit('">'), i, F.lit("</a>"))),
    )
    html = F.concat(F.lit('<a href="/late"><img></a>'), F.array_join(numbers, ""), F.lit('<a href="/late">Named</a><a href="/news/1">n</a>'))
    found = web.media_candidates(t.pages.withColumn("html", html), context=False).select("page_id", "links")
    return web.explode_candidates(found, "links").select("page_id", F.col("pos").cast("bigint").alias("pos"), "url", "text")


@query(
    "link_context",
    f"""
    WITH s AS (SELECT page_id, html, regexp_extract_all(html, '{H.ANCHOR.replace("'", "''")}') AS a_m, string_split_regex(html, '{H.ANCHOR.replace("'", "''")}') AS a_p FROM pages),
    m AS (SELECT page_id, html, unnest(range(len(a_m))) AS pos, unnest({_starts_sql('', 'a')}) AS start FROM s)
    SELECT page_id, pos, start::BIGINT AS start, {s_tag_free(_CONTEXT)} AS context FROM m
    """,
)
def link_context(t):
    starts = t.pages.select("page_id", "html", F.posexplode_outer(H.match_starts("html", H.ANCHOR)).alias("pos", "start")).filter("pos is not null")
    return starts.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), F.col("start").cast("bigint").alias("start"),
        H.context_window("html", F.col("start")).alias("context"),
    )


WANTED = "(?i)the|and|de|ion"


@query(
    "page_suggestions",
    f"""
    WITH a AS (SELECT page_id, pos, href, {s_tag_free('raw')} AS text, site || {s_encode('href')} AS url FROM ({s_anchors()})),
    k AS (SELECT * FROM a WHERE regexp_matches(href || ' ' || text, '{WANTED}') AND NOT regexp_matches(href, '{S_NOISE}')),
    d AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS n FROM k),
    r AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, url, coalesce(nullif(text, ''), '(no text)') AS text FROM d WHERE n = 1)
    SELECT * FROM r WHERE pos < 6
    """,
)
def page_suggestions(t):
    found = web.suggest_links(t.pages, wanted=WANTED).select("page_id", "suggestions")
    return web.explode_candidates(found, "suggestions").withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "page_probe",
    f"""
    SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'FAIL (HTTP 404)' WHEN length(txt) < 500 THEN 'NEEDS-BROWSER (empty static render)'
      WHEN NOT regexp_matches(txt, '(?i)district [0-9]|thereble|tionand') THEN 'NO-ROSTER-KEYWORDS' ELSE 'OK' END AS status
    FROM (SELECT page_id, {s_text('html')} AS txt FROM pages)
    """,
)
def page_probe(t):
    pages = web.page_text(t.pages).withColumns({"ok": F.col("page_id") % 9 != 0, "error": F.lit("HTTP 404")})
    return web.probe_status(pages, roster="(?i)district [0-9]|thereble|tionand").select("page_id", "status")


@query(
    "seed_probe",
    f"""
    WITH p AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, page_id % 9 <> 0 AS ok, {s_text('html')} AS txt FROM pages),
    st AS (SELECT page_id, url, site, CASE WHEN NOT ok THEN 'FAIL (HTTP 404)' WHEN length(txt) < 500 THEN 'NEEDS-BROWSER (empty static render)'
      WHEN NOT regexp_matches(txt, '(?i)council ?member|councilmember|city council|mayor|commissioner|alderman|place [0-9]|district [0-9]|precinct [0-9]')
      THEN 'NO-ROSTER-KEYWORDS' ELSE 'OK' END AS status FROM p),
    home AS (SELECT DISTINCT site FROM p)
    SELECT url, status, CASE WHEN status <> 'OK' THEN 2 ELSE 0 END::BIGINT AS n_suggestions,
      CASE WHEN status <> 'OK' THEN site || '/council' END AS first_suggestion
    FROM st
    """,
)
def seed_probe(t):
    """Probe of every page as a seed; each site has a home page derived from its address."""
    fetched = t.pages.select(
        F.col("url").alias("requested_url"), "url", (F.col("page_id") % 9 != 0).alias("ok"), "html", F.lit("HTTP 404").alias("error")
    )
    site = t.pages.select(url_origin("url").alias("site")).distinct()
    home = site.select(
        F.concat("site", F.lit("/")).alias("requested_url"), F.concat("site", F.lit("/")).alias("url"), F.lit(True).alias("ok"),
        F.lit('<a href="/council">Council</a><a href="/news/council">n</a><a href="/mayor">M</a><a href="/x">x</a>').alias("html"),
        F.lit(None).cast("string").alias("error"),
    )
    targets = t.pages.select(F.lit("c").alias("city"), F.lit("S").alias("state"), "url")
    report = web.probe(targets, fetched.unionByName(home))
    return report.select(
        "url", "status", F.coalesce(F.size("suggestions"), F.lit(0)).cast("bigint").alias("n_suggestions"),
        F.try_element_at("suggestions", F.lit(1))["url"].alias("first_suggestion"),
    )


@query(
    "gov_sites",
    f"""
    SELECT page_id, page_id % 8 <> 0 AND contains(low, w1) AND contains(low, w2) AND (page_id % 3 = 0 OR regexp_matches(low, 'government|city council|county|commissioners|municipal')) AS is_gov
    FROM (SELECT page_id, lower({s_text('html')}) AS low, ['the', 'of', 'zzz', 'que'][(page_id % 4) + 1] AS w1, ['and', 'de', 'der'][(page_id % 3) + 1] AS w2 FROM pages)
    """,
)
def gov_sites(t):
    first = F.get(F.array(*[F.lit(w) for w in ("The", "of", "zzz", "que")]), (F.col("page_id") % 4).cast("int"))
    second = F.get(F.array(*[F.lit(w) for w in ("and", "De", "der")]), (F.col("page_id") % 3).cast("int"))
    pages = web.page_text(t.pages).withColumns({
        "city": F.concat(first, F.lit(" County  "), second), "ok": F.col("page_id") % 8 != 0,
        "url": F.concat(F.lit("https://x"), F.when(F.col("page_id") % 3 == 0, F.lit(".gov/")).otherwise(F.lit(".govern/"))),
    })
    return web.gov_sites(pages, "city").select("page_id", "is_gov")


@query(
    "first_urls",
    """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN regexp_replace(url, '[.,)\\]]+$', '') ELSE url || 'a' END AS url FROM pages
    """,
)
def first_urls(t):
    k, u = F.col("page_id") % 4, F.col("url")
    answer = (
        F.when(k == 0, F.lit(" UNKNOWN ")).when(k == 1, F.lit("no idea"))
        .when(k == 2, F.concat(F.lit("See ("), u, F.lit(").,] or http://b.c"))).otherwise(F.concat(F.lit('"'), u, F.lit('a" ok')))
    )
    return t.pages.select("page_id", H.first_url(answer).alias("url"))


@query(
    "search_hits",
    """
    SELECT page_id, provider, n.rank AS rank, 'T' || n.rank AS title, CASE WHEN n.rank = 0 THEN url ELSE url || n.rank END AS url,
      CASE WHEN n.rank = 2 THEN '' ELSE 'S' END AS snippet
    FROM pages, (SELECT unnest([0, 2]) AS rank) n, (SELECT unnest(['brave', 'google']) AS provider)
    """,
)
def search_hits(t):
    u = F.col("url")

    def item(url, title, snippet, keys):
        fields = {"title": F.lit(title), keys[0]: url, keys[1]: F.lit(snippet)}
        return F.struct(*[v.cast("string").alias(k) for k, v in fields.items()])

    out = []
    for provider, keys in (("brave", ("url", "description")), ("google", ("link", "snippet"))):
        items = F.array(
            item(u, "T0", "S", keys), item(F.lit(None), "T1", "S", keys), item(F.concat(u, F.lit("2")), "T2", None, keys)
        )
        body = F.struct(F.struct(items.alias("results")).alias("web")) if provider == "brave" else F.struct(items.alias("items"))
        answers = t.pages.select("page_id", F.lit(provider).alias("provider"), F.to_json(body).alias("answer"))
        out.append(web.search_results(answers, "answer", provider))
    return out[0].unionByName(out[1]).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "url_safety",
    """
    WITH v AS (SELECT page_id, k, url, CASE k WHEN 0 THEN url WHEN 1 THEN '  ' WHEN 2 THEN 'http://10.' || (page_id % 256) || '.0.1/x'
        WHEN 3 THEN 'ftp' || url[5:] WHEN 4 THEN 'http://100.' || (page_id % 256) || '.1.1' WHEN 5 THEN 'http://' || (page_id * 77777 % 4294967296)
        WHEN 6 THEN 'http://172.' || (page_id % 64) || '.9.9:8080/' WHEN 7 THEN 'http://u' || page_id || '@a.gov' WHEN 8 THEN 'http://a' || page_id || '.local'
        ELSE url || repeat('x', 1900 + (page_id % 200)::INT) END AS u FROM pages, (SELECT unnest(range(10)) AS k))
    SELECT page_id, k, CASE k WHEN 1 THEN 'Enter a URL.' WHEN 2 THEN 'That host isn''t reachable from here.'
      WHEN 3 THEN 'Only http:// and https:// URLs are allowed.'
      WHEN 4 THEN CASE WHEN page_id % 256 BETWEEN 64 AND 127 THEN 'That host isn''t reachable from here.' END
      WHEN 5 THEN CASE WHEN (page_id * 77777 // 16777216) IN (0, 10, 127) OR page_id * 77777 // 16777216 >= 224 THEN 'That host isn''t reachable from here.' END
      WHEN 6 THEN CASE WHEN page_id % 64 BETWEEN 16 AND 31 THEN 'That host isn''t reachable from here.' END
      WHEN 7 THEN 'URLs with a username/password aren''t allowed.' WHEN 8 THEN 'That host isn''t reachable from here.'
      WHEN 9 THEN CASE WHEN length(u) > 2000 THEN 'That URL is too long.' END END AS reason,
      CASE WHEN k = 0 THEN url WHEN k = 6 AND page_id % 64 NOT BETWEEN 16 AND 31 THEN u END AS href
    FROM v
    """,
)
def url_safety(t):
    n, u = F.col("page_id"), F.col("url")
    forms = [
        u, F.lit("  "), F.concat(F.lit("http://10."), n % 256, F.lit(".0.1/x")),
        F.concat(F.lit("ftp"), F.substring(u, F.lit(5), F.length(u))), F.concat(F.lit("http://100."), n % 256, F.lit(".1.1")),
        F.concat(F.lit("http://"), n * 77777 % 4294967296), F.concat(F.lit("http://172."), n % 64, F.lit(".9.9:8080/")),
        F.concat(F.lit("http://u"), n, F.lit("@a.gov")), F.concat(F.lit("http://a"), n, F.lit(".local")),
        F.concat(u, F.expr("repeat('x', cast(1900 + page_id % 200 as int))")),
    ]
    rows = t.pages.select("page_id", F.posexplode(F.array(*forms)).alias("k", "u"))
    checked = rows.withColumn("c", check_submission_url("u"))
    return checked.select(
        "page_id", F.col("k").cast("bigint").alias("k"), "c.reason", F.when(F.col("k").isin(0, 6), F.col("c.href")).alias("href")
    )


# --- requests and answers -------------------------------------------------------------------


@query(
    "extraction_requests",
    """
    WITH b AS (SELECT doc_id, source, lang, 'https://' || source || '.gov/' || doc_id AS url, text[1:24000] AS clip FROM documents),
    k AS (SELECT *, unnest(['roster', 'detail', 'submission']) AS kind FROM b),
    r AS (SELECT doc_id, kind, 'kind=' || kind || nl || 'url=' || url || nl || CASE kind WHEN 'roster' THEN 'subject=B ' || source || ', ' || source || ', ' || lang || nl
        WHEN 'detail' THEN 'subject=N ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ', ' || lang ELSE '' END || nl ELSE '' END
      || CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat_ws(tab, 'image', url || '/a.jpg', 'A', 'c' || doc_id) || nl || concat_ws(tab, 'email', 'e' || doc_id || '@x.gov', 't', 'n') || nl
        || concat_ws(tab, 'email', 'f@x.gov', '', 'n') || nl END
      || '---' || nl || clip AS request FROM k, (SELECT chr(10) AS nl, chr(9) AS tab))
    SELECT doc_id, kind, length(request) AS n_chars, md5(request) AS digest FROM r
    """,
)
def extraction_requests(t):
    d, key = t.documents, F.col("doc_id")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".gov/"), key)
    bare = key % 3 == 0

    def items(schema, *rows):
        return F.when(bare, F.array().cast(f"array<{schema}>")).otherwise(F.array(*rows))

    def text(**kw):
        return F.struct(*[v.cast("string").alias(k) for k, v in kw.items()])

    base = d.select(
        "doc_id", "text", url.alias("url"), F.concat(F.lit("B "), F.col("source")).alias("body"), F.col("source").alias("city"),
        F.col("lang").alias("state"), F.concat(F.lit("N "), key).alias("name"), F.when(key % 2 == 0, F.col("lang")).alias("office"),
        items("struct<src:string,alt:string,context:string>", text(src=F.concat(url, F.lit("/a.jpg")), alt=F.lit("A"), context=F.concat(F.lit("c"), key))).alias("images"),
        F.array().cast("array<struct<platform:string,url:string,text:string,context:string>>").alias("social_links"),
        items(
            "struct<email:string,text:string,context:string>",
            text(email=F.concat(F.lit("e"), key, F.lit("@x.gov")), text=F.lit("t"), context=F.lit("n")),
            text(email=F.lit("f@x.gov"), text=F.lit(""), context=F.lit("n")),
        ).alias("emails"),
        F.array().cast("array<struct<url:string,text:string,context:string>>").alias("links"),
    )
    out = None
    for kind in ("roster", "detail", "submission"):
        part = extraction.build_extraction_requests(base, kind).select(
            "doc_id", F.lit(kind).alias("kind"), F.length("request").alias("n_chars"), F.md5("request").alias("digest")
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("n_chars", F.col("n_chars").cast("bigint"))


def _roster_answers(t):
    n, bal = F.col("c_custkey"), F.col("c_acctbal")
    person = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("office"), bal.alias("confidence"))
    ghost = F.struct(F.concat(F.lit("Ghost "), n).alias("name"), F.lit(None).cast("string").alias("office"), F.lit(None).cast("double").alias("confidence"))
    body = F.to_json(F.struct(F.array(person, ghost).alias("officials")))
    k = n % 6
    response = (
        F.when(k == 0, body).when(k == 1, F.concat(F.lit("Sure!\n```json\n"), body, F.lit("\n``` {x}")))
        .when(k == 2, F.concat(F.lit("prose "), body, F.lit(" more"))).when(k == 3, F.expr("left('{\"officials\": [{\"name\": \"A\"', 20)"))
        .when(k == 4, F.lit('{"officials": {"name": "A"}}')).otherwise(F.lit("no json at all"))
    )
    return t.customer.select(
        n.alias("page_id"), F.when(k == 3, F.lit("length")).when(k == 5, F.lit("stop")).otherwise(F.lit("end_turn")).alias("finish_reason"), response.alias("response")
    )


@query(
    "roster_answers",
    """
    SELECT c_custkey AS page_id, p AS pos, CASE p WHEN 0 THEN c_name ELSE 'Ghost ' || c_custkey END AS name, CASE p WHEN 0 THEN c_mktsegment END AS office,
      CASE p WHEN 0 THEN c_acctbal END AS confidence
    FROM customer, (SELECT unnest([0, 1]) AS p) WHERE c_custkey % 6 IN (0, 1, 2)
    """,
)
def roster_answers(t):
    whole, _ = extraction.split_truncated(_roster_answers(t))
    rows = extraction.parse_roster_response(whole)
    return rows.select("page_id", F.col("pos").cast("bigint").alias("pos"), "raw.name", "raw.office", "raw.confidence")


@query(
    "truncated_answers",
    "SELECT c_custkey AS page_id, 'response truncated at the output limit' AS error FROM customer WHERE c_custkey % 6 = 3",
)
def truncated_answers(t):
    _, cut = extraction.split_truncated(_roster_answers(t))
    return cut.select("page_id", "error")


@query(
    "json_answers",
    """
    WITH w AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'a ```json ' || props || ' ``` b' WHEN 2 THEN 'text ' || props || ' tail'
        WHEN 3 THEN props[1:5] ELSE 'x } y { z' END AS answer FROM events),
    b AS (SELECT event_id, regexp_extract(CASE WHEN contains(answer, '```') THEN regexp_extract(answer, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE answer END, '(?s)(\\{.*\\})', 1) AS body FROM w)
    SELECT event_id, CASE WHEN body <> '' AND json_valid(body) THEN (body ->> '$.k')::BIGINT END AS k FROM b
    """,
)
def json_answers(t):
    from pyspark.sql import types as T

    k, p = F.col("event_id") % 5, F.col("props")
    answer = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("a ```json "), p, F.lit(" ``` b"))).when(k == 2, F.concat(F.lit("text "), p, F.lit(" tail")))
        .when(k == 3, F.left(p, F.lit(5))).otherwise(F.lit("x } y { z"))
    )
    schema = T.StructType([T.StructField("k", T.LongType())])
    return t.events.select("event_id", extraction.extract_json(answer, schema)["k"].alias("k"))


@query(
    "detail_answers",
    """
    SELECT s_suppkey, '512' || lpad(s_suppkey::VARCHAR, 7, '0') AS phone, 'https://t.co/' || s_suppkey AS twitter, 1::BIGINT AS n_offices, s_name AS bio
    FROM supplier WHERE s_suppkey % 4 <> 0
    """,
)
def detail_answers(t):
    key = F.col("s_suppkey").cast("string")
    body = F.to_json(F.struct(
        F.concat(F.lit("512"), F.lpad(key, 7, "0")).alias("phone"), F.struct(F.concat(F.lit("https://t.co/"), key).alias("twitter")).alias("social"),
        F.array(F.struct(F.lit("main").alias("classification"))).alias("offices"), F.col("s_name").alias("bio"),
    ))
    answers = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.lit("nothing {")).otherwise(body).alias("response"))
    d = extraction.parse_detail_response(answers)
    return d.select("s_suppkey", "detail.phone", "detail.social.twitter", F.size("detail.offices").cast("bigint").alias("n_offices"), "detail.bio")


def submission_answers(t):
    n = F.col("c_custkey")
    person = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("office"), ((n % 10) / 10).alias("confidence"))
    officials = F.when(n % 5 == 0, F.array().cast("array<struct<name:string,office:string,confidence:double>>")).otherwise(F.array(person))
    levels = F.array(F.lit("local"), F.lit("county"), F.lit("state"), F.lit(None).cast("string"))
    place = F.struct(
        F.when(n % 7 != 0, F.concat(F.lit("City "), F.col("c_nationkey"))).otherwise(F.lit("")).alias("city"), F.lit("TX").alias("state"),
        F.get(levels, (n % 4).cast("int")).alias("level"),
    )
    body = F.to_json(F.struct((n % 3 != 0).alias("is_government_source"), place.alias("jurisdiction"), officials.alias("officials")))
    return t.customer.select(n, F.concat(F.lit("https://x.gov/"), n).alias("url"), F.when(n % 11 == 0, F.lit("oops")).otherwise(body).alias("response"))


@query(
    "submission_answers",
    """
    SELECT c_custkey, c_custkey % 11 <> 0 AND c_custkey % 3 <> 0 AS is_government_source, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 THEN 'City ' || c_nationkey END AS city,
      CASE WHEN c_custkey % 11 <> 0 THEN ['local', 'county', 'state', NULL][(c_custkey % 4) + 1] END AS level, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS n_officials
    FROM customer
    """,
)
def submissions(t):
    p = extraction.parse_submission_response(submission_answers(t))
    return p.select(
        "c_custkey", "is_government_source", "jurisdiction.city", "jurisdiction.level", F.size("officials").cast("bigint").alias("n_officials")
    )


@query(
    "triage",
    """
    WITH r AS (SELECT c_custkey, c_custkey % 13 AS k, ['data-accuracy', 'functionality', 'ui', 'other', 'bogus'][(c_custkey % 5) + 1] AS cat, ['high', 'medium', 'low', 'urgent'][(c_custkey % 4) + 1] AS sev FROM customer),
    p AS (SELECT c_custkey, CASE k WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE c_custkey END AS dup, cat, sev, k FROM r WHERE k <> 12)
    SELECT c_custkey, dup AS duplicate_of, CASE WHEN k = 4 THEN 'Reported issue' ELSE repeat('t', 190) || c_custkey END[1:200] AS title,
      CASE WHEN cat = 'bogus' THEN 'other' ELSE cat END AS category, CASE WHEN sev = 'urgent' THEN 'low' ELSE sev END AS severity,
      CASE WHEN dup IS NOT NULL AND dup % 2 = 0 THEN 'Duplicate of #' || dup ELSE 'New issue' END AS status_line
    FROM p
    """,
)
def triage(t):
    n = F.col("c_custkey")
    k = n % 13
    dup = (
        F.when(k == 0, F.lit("null")).when(k == 1, F.lit('""')).when(k == 2, F.lit('"abc"')).when(k == 3, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n.cast("string"))
    )
    title = F.when(k == 4, F.lit("17")).otherwise(F.concat(F.lit('"'), F.expr("repeat('t', 190)"), n, F.lit('"')))
    cat = F.get(F.array(*[F.lit(c) for c in ("data-accuracy", "functionality", "ui", "other", "bogus")]), (n % 5).cast("int"))
    sev = F.get(F.array(*[F.lit(c) for c in ("high", "medium", "low", "urgent")]), (n % 4).cast("int"))
    body = F.concat(
        F.lit('{"duplicate_of": '), dup, F.lit(', "title": '), title, F.lit(', "cleaned_description": "d", "category": "'), cat, F.lit('", "severity": "'), sev, F.lit('"}')
    )
    answers = t.customer.select(n, F.when(k == 12, F.lit("{broken")).otherwise(body).alias("response"))
    issues = t.customer.filter(n % 2 == 0).select(n.alias("issue"))
    rows = extraction.resolve_duplicates(extraction.parse_triage(answers), issues)
    return rows.select("c_custkey", "duplicate_of", "title", "category", "severity", "status_line")
