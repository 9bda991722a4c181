"""Column expressions for contact fields, record ids, keys and short texts.

Everything here is ``Column -> Column`` built from Spark's own functions, so it runs inside the
JVM and fuses into the projection that uses it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space characters of the record format (wider than Spark's \s and trim).
WS = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# The same characters as text, for trimming.
WS_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

_ODD_WS = "".join(c for c in WS_CHARS if c != " ")

# Straight and curly quote characters left out of ids.
QUOTES = "'\"‘’‚‛“”„‟′″"

# Words dropped when place names are compared.
PLACE_WORDS = ["city", "town", "village", "borough", "municipality", "cdp", "county", "parish"]

# Legal-status suffixes of a place name, tried in this order.
PLACE_SUFFIXES = [" city", " town", " village", " borough", " CDP", " municipality", " (balance)"]

# State FIPS codes (50 states, DC, PR).
STATE_FIPS = {
    "AL": "01", "AK": "02", "AZ": "04", "AR": "05", "CA": "06", "CO": "08", "CT": "09",
    "DE": "10", "DC": "11", "FL": "12", "GA": "13", "HI": "15", "ID": "16", "IL": "17",
    "IN": "18", "IA": "19", "KS": "20", "KY": "21", "LA": "22", "ME": "23", "MD": "24",
    "MA": "25", "MI": "26", "MN": "27", "MS": "28", "MO": "29", "MT": "30", "NE": "31",
    "NV": "32", "NH": "33", "NJ": "34", "NM": "35", "NY": "36", "NC": "37", "ND": "38",
    "OH": "39", "OK": "40", "OR": "41", "PA": "42", "RI": "44", "SC": "45", "SD": "46",
    "TN": "47", "TX": "48", "UT": "49", "VT": "50", "VA": "51", "WA": "53", "WV": "54",
    "WI": "55", "WY": "56", "PR": "72",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body`` without repeating its expression."""
    return F.transform(F.array(value), body)[0]


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, whatever uses them later.

    Adjacent projections are merged by the optimizer, which would repeat a costly expression inside
    every lambda that reads it. A one-element explode keeps the value as a column of its own.
    """
    box = F.struct(*[v.alias(k) for k, v in columns.items()])
    boxed = df.select("*", F.explode_outer(F.array(box)).alias("_box"))
    return boxed.select(*df.columns, *[F.col("_box")[k].alias(k) for k in columns])


def filled(c: Column | str) -> Column:
    """The value, with '' read as missing."""
    return F.nullif(col(c), F.lit(""))


def has(c: Column | str) -> Column:
    return F.coalesce(col(c) != "", F.lit(False))


def trim(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WS_CHARS))


def plain_spaces(c: Column | str) -> Column:
    """Every white space character as a plain space."""
    return F.translate(col(c), _ODD_WS, " " * len(_ODD_WS))


def squeeze(c: Column | str) -> Column:
    """Runs of white space become one space; the ends are trimmed.

    Only runs are replaced by pattern: single spaces, nearly all of a text, are left in place.
    """
    return F.trim(F.regexp_replace(plain_spaces(c), "  +", " "))


def trimmed_or_null(c: Column | str) -> Column:
    """Trim a present value; a missing or empty one is null (white space only gives '')."""
    return F.when(has(c), trim(c))


def _word(alternatives: str) -> str:
    """Whole-word pattern with ASCII word edges."""
    return rf"(?<![A-Za-z0-9_])(?:{alternatives})(?![A-Za-z0-9_])"


# --- contact fields -------------------------------------------------------------------------


def clean_phone(c: Column | str) -> Column:
    c = col(c)
    digits = F.regexp_replace(c, r"[^0-9]", "")
    local = F.regexp_extract(digits, r"^1?([0-9]{10})\z", 1)
    dashed = F.regexp_replace(local, r"^(...)(...)(....)$", "$1-$2-$3")
    return F.when(has(c), F.coalesce(filled(dashed), trim(c)))


def clean_email(c: Column | str) -> Column:
    value = trim(c)
    return F.when(value.rlike(rf"^[^{WS}@]+@[^{WS}@]+\.[^{WS}@]+\z"), value)


# --- ids and keys ---------------------------------------------------------------------------


def strip_quotes(c: Column | str) -> Column:
    return F.translate(F.coalesce(col(c), F.lit("")), QUOTES, "")


def canonical_name(c: Column | str) -> Column:
    return squeeze(F.lower(strip_quotes(c)))


def canonicalize_office(c: Column | str) -> Column:
    value = F.regexp_replace(canonical_name(c), r" ?/ ?", "/")
    value = F.regexp_replace(value, _word("councilmember"), "council member")
    value = F.regexp_replace(value, _word("city council member"), "council member")
    return F.coalesce(filled(value), F.lit("?"))


def build_id(state, city, office, name) -> Column:
    """``state:city:office:name``, lower case, white space as '-'. A null part reads 'null'."""
    joined = F.concat_ws(
        ":",
        F.coalesce(col(state), F.lit("null")),
        F.coalesce(col(city), F.lit("null")),
        canonicalize_office(office),
        canonical_name(name),
    )
    return F.regexp_replace(plain_spaces(F.lower(joined)), " +", "-")


def jurisdiction_key(state, city, level) -> Column:
    return F.concat_ws(
        ":",
        F.upper(F.coalesce(col(state), F.lit(""))),
        F.lower(F.coalesce(col(city), F.lit(""))),
        F.coalesce(filled(level), F.lit("local")),
    )


def normalize_place(c: Column | str) -> Column:
    value = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), _word("|".join(PLACE_WORDS)), "")
    return F.trim(F.regexp_replace(value, r"[^a-z0-9]+", " "))


def strip_place_suffix(c: Column | str) -> Column:
    """Drop the first suffix of the ordered list that the name ends with, once."""
    c = col(c)

    def cut(suffix: str):
        return F.lower(c).endswith(suffix.lower()), trim(F.left(c, F.length(c) - len(suffix)))

    first, *rest = PLACE_SUFFIXES
    chain = F.when(*cut(first))
    return reduce(lambda w, s: w.when(*cut(s)), rest, chain).otherwise(c)


def state_fips(c: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATE_FIPS.items() for x in pair])
    return F.try_element_at(table, F.upper(F.coalesce(col(c), F.lit(""))))


def expand_states(spec: str | None) -> list[str]:
    """'ALL' (or nothing) is every known state; otherwise a comma list."""
    wanted = (spec or "ALL").strip().upper()
    if wanted == "ALL":
        return list(STATE_FIPS)
    return [s.strip() for s in wanted.split(",") if s.strip()]


def guess_body_name(city, level) -> Column:
    suffix = F.when(col(level) == "county", F.lit("Commissioners Court")).otherwise(F.lit("City Council"))
    return F.concat_ws(" ", col(city), suffix)


def level_from_body(c: Column | str) -> Column:
    return F.when(col(c).rlike("(?i)commissioners court"), F.lit("county")).otherwise(F.lit("local"))


def place_slug(state, city) -> Column:
    """Cache key ``STATE/slug``."""
    slug = F.regexp_replace(F.lower(col(city)), r"[^a-z0-9]+", "-")
    return F.concat_ws("/", F.upper(col(state)), F.regexp_replace(slug, r"^-+|-+\z", ""))


def coord_key(lat, lon) -> Column:
    return F.format_string("%.4f,%.4f", col(lat).cast("double"), col(lon).cast("double"))


def hash_key(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 16)


# --- short texts ----------------------------------------------------------------------------


def excerpt(c: Column | str, limit: int = 300) -> Column:
    value = squeeze(F.coalesce(col(c), F.lit("")))
    return F.when(F.length(value) > limit, F.concat(F.left(value, F.lit(limit)), F.lit("…"))).otherwise(value)


def clip_input(c: Column | str, limit: int | None) -> Column:
    """Trim and clip a submitted field (None: keep all of it); '' when missing."""
    value = trim(F.coalesce(col(c), F.lit("")))
    return value if limit is None else F.left(value, F.lit(limit))


def parse_time(c: Column | str) -> Column:
    """ISO-8601 text (or a timestamp) to a timestamp; unreadable text is null."""
    return F.try_to_timestamp(col(c).cast("string"))
