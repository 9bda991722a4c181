"""Registry of runnable queries over the test tables and the SQL that checks them.

A query takes ``(spark, folder)`` and reads whole tables. Its check is the same result in DuckDB SQL,
written from the rules rather than from the Spark code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterspark.functions.text import QUOTES, WS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazily read tables of one folder: ``t.pages``, ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table dealt over all cores, for inputs that are far larger than the rows they are made of: Spark reads a small
        file in one task, which would make and process all of them."""
        return getattr(self, name).repartition(2 * self.spark.sparkContext.defaultParallelism)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


# --- SQL fragments for the checks (DuckDB) --------------------------------------------------


def s_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def s_squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def s_phone(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    ten = f"CASE WHEN length({d}) = 10 THEN {d} WHEN length({d}) = 11 AND {d}[1] = '1' THEN {d}[2:11] END"
    return (
        f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL "
        f"WHEN ({ten}) IS NOT NULL THEN ({ten})[1:3] || '-' || ({ten})[4:6] || '-' || ({ten})[7:10] ELSE {s_trim(x)} END"
    )


def s_email(x: str) -> str:
    t = s_trim(x)
    return rf"CASE WHEN regexp_matches({t}, '^[^{WS}@]+@[^{WS}@]+\.[^{WS}@]+$') THEN {t} END"


def s_name(x: str) -> str:
    quotes = QUOTES.replace("'", "''")
    return s_squeeze(f"lower(translate(coalesce({x}, ''), '{quotes}', ''))")


def s_office(x: str) -> str:
    v = f"regexp_replace({s_name(x)}, ' ?/ ?', '/', 'g')"
    v = rf"regexp_replace({v}, '\bcouncilmember\b', 'council member', 'g')"
    v = rf"regexp_replace({v}, '\bcity council member\b', 'council member', 'g')"
    return f"coalesce(nullif({v}, ''), '?')"


def s_id(state: str, city: str, office: str, name: str) -> str:
    parts = f"coalesce({state}, 'null') || ':' || coalesce({city}, 'null') || ':' || {s_office(office)} || ':' || {s_name(name)}"
    return rf"regexp_replace(lower({parts}), '[{WS}]+', '-', 'g')"


def s_encode(x: str) -> str:
    """Percent-encode non-ASCII characters."""
    return (
        f"list_aggregate(list_transform(string_split({x}, ''), lambda ch: CASE WHEN regexp_matches(ch, '[^\\x21-\\x7e]') "
        f"THEN regexp_replace(hex(encode(ch)), '(..)', '%\\1', 'g') ELSE ch END), 'string_agg', '')"
    )


def s_place(x: str) -> str:
    words = "city|town|village|borough|municipality|cdp|county|parish"
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\b({words})\b', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


TEXT_RULES = [
    (r"(?is)<script[\s\S]*?</script>", " "), (r"(?is)<style[\s\S]*?</style>", " "), (r"<!--[\s\S]*?-->", " "),
    (r"(?i)</(p|div|li|tr|h[1-6]|section|article)>", "\n"), (r"<[^>]+>", " "), (r"&nbsp;", " "), (r"&amp;", "&"),
    (r"[ \t]+", " "), (r"\n{3,}", "\n\n"),
]


def s_text(x: str) -> str:
    for pattern, by in TEXT_RULES:
        by = by.replace("\n", "' || chr(10) || '")
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return s_trim(x)


def s_tag_free(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '[{WS}]+', ' ', 'g'))"


S_ANCHOR = r"""(?i)<a\b[^>]*href=["'']([^"'']+)["''][^>]*>([\s\S]*?)</a>"""
S_NOISE = r"(?i)agenda|minute|video|calendar|meeting|archive|news|press|blog|article|story|stories|event|\.pdf$"


def s_anchors(html: str = "html", extra: str = "", source: str = "pages") -> str:
    """Rows page_id, url, pos (0-based), href, txt and the site of the page."""
    return f"""
      SELECT page_id, url, {extra} regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site,
        unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(x) AS raw
      FROM (SELECT *, regexp_extract_all({html}, '{S_ANCHOR}', 1) AS h, regexp_extract_all({html}, '{S_ANCHOR}', 2) AS x FROM {source})
    """
