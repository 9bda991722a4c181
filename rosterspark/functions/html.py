"""HTML columns: visible text, anchors, images, and the text around a match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterspark.functions.text import WS, col, let, squeeze, trim

# Patterns that define what counts as an image, a link and noise.
IMG = r"(?i)<img\b[^>]*>"
SRC = r"""(?i)\bsrc=["']([^"']+)["']"""
ALT = r"""(?i)\balt=["']([^"']*)["']"""
ANCHOR = r"""(?i)<a\b[^>]*href=["']([^"']+)["'][^>]*>([\s\S]*?)</a>"""
NOISE = r"(?i)agenda|minute|video|calendar|meeting|archive|news|press|blog|article|story|stories|event|\.pdf\z"
DECORATION = r"(?i)logo|icon|sprite|favicon"
ROSTER = r"(?i)council ?member|councilmember|city council|mayor|commissioner|alderman|place [0-9]|district [0-9]|precinct [0-9]"
ROSTER_LINK = r"(?i)council|commissioner|elected|mayor|government"
GOVERNMENT_WORDS = r"government|city council|county|commissioners|municipal"
THIN_TEXT = 500
BLOCKED_STATUS = [403, 429, 503]

# Social platforms by host.
SOCIAL_HOSTS = [
    ("twitter", r"(^|\.)(twitter\.com|x\.com)\z"),
    ("facebook", r"(^|\.)facebook\.com\z"),
    ("instagram", r"(^|\.)instagram\.com\z"),
    ("linkedin", r"(^|\.)linkedin\.com\z"),
    ("youtube", r"(^|\.)(youtube\.com|youtu\.be)\z"),
    ("threads", r"(^|\.)threads\.net\z"),
    ("bluesky", r"(^|\.)bsky\.app\z"),
]


def html_to_text(c: Column | str) -> Column:
    """Visible text: scripts, styles and comments dropped, block ends as line breaks."""
    c = col(c)
    for pattern, by in [
        (r"(?i)<script[\s\S]*?</script>", " "),
        (r"(?i)<style[\s\S]*?</style>", " "),
        (r"<!--[\s\S]*?-->", " "),
        (r"(?i)</(p|div|li|tr|h[1-6]|section|article)>", "\n"),
        (r"<[^>]+>", " "),
    ]:
        c = F.regexp_replace(c, pattern, by)
    c = F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    # A single blank is left alone: only tabs and runs need replacing.
    c = F.regexp_replace(c, r"[ \t]{2,}|\t", " ")
    return trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def tag_free(c: Column) -> Column:
    """Markup out, white space collapsed, ends trimmed."""
    return squeeze(F.regexp_replace(c, r"<[^>]+>", " "))


def is_noise_href(c: Column | str) -> Column:
    return col(c).rlike(NOISE)


def platform_of(host: Column, platforms=SOCIAL_HOSTS) -> Column:
    chain = None
    for name, pattern in platforms:
        chain = (F if chain is None else chain).when(host.rlike(f"(?i){pattern}"), F.lit(name))
    return chain


#: Matches whose offsets are summed in one go; a list grows by a copy of itself, so lists of a whole page would cost its square.
OFFSET_BLOCK = 256


def running_sums(steps: Column, block: int = OFFSET_BLOCK) -> Column:
    """For each (gap, tag) the sum of all before it and its own gap: block by block, then each block's sum over the earlier ones."""

    def sums(values, item, add):
        step = F.aggregate(
            values, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, v: F.struct((a["at"] + add(v)).alias("at"), F.concat(a["out"], F.array(a["at"] + item(v))).alias("out")),
        )
        return step

    def joined(blocks):
        before = sums(blocks, lambda b: F.lit(0), lambda b: b["at"])["out"]
        return let(before, lambda bases: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["out"], lambda o: o + F.get(bases, i)))))

    def cut(all_steps):
        starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(all_steps), F.lit(1)) - 1) / F.lit(block)).cast("int"))
        return F.transform(starts, lambda i: sums(F.slice(all_steps, i * block + 1, F.lit(block)), lambda v: v["gap"], lambda v: v["gap"] + v["tag"]))

    return let(steps, lambda all_steps: let(cut(all_steps), joined))


def match_starts(html: Column | str, pattern: str) -> Column:
    """1-based start positions of the matches of ``pattern``, in order.

    The pieces between matches and the matches themselves alternate, so the starts are running
    sums of their lengths; one pass each, inside the JVM.
    """
    pieces = F.split(col(html), pattern, -1)
    tags = F.regexp_extract_all(col(html), F.lit(pattern), F.lit(0))
    lengths = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(tags)), tags,
        lambda p, t: F.struct(F.length(p).alias("gap"), F.length(t).alias("tag")),
    )
    return F.transform(running_sums(lengths), lambda o: o + 1)


def context_window(html: Column | str, start: Column, radius: int = 200) -> Column:
    """Tag-free text from ``radius`` characters before a match to ``radius`` after its start."""
    first = F.greatest(start - radius, F.lit(1))
    return tag_free(F.substring(col(html), first, start + radius - first))


def first_url(c: Column | str) -> Column:
    """First http(s) URL of an answer without trailing punctuation; null for UNKNOWN or none."""
    text = trim(F.coalesce(col(c), F.lit("")))
    found = F.regexp_extract(text, rf"""(https?://[^{WS}"'<>]+)""", 1)
    return F.nullif(F.regexp_replace(found, r"[.,)\]]+\z", ""), F.lit(""))


def looks_like_gov_site(ok: Column, text: Column, url: Column, city: Column) -> Column:
    """Every word of the city name is on the page, and the page or its address reads governmental."""
    low = F.lower(text)
    name = F.regexp_replace(F.lower(city), r"(?<![a-z0-9_])county(?![a-z0-9_])", "")
    words = F.filter(F.split(squeeze(name), " "), lambda w: w != "")
    named = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(low, w))
    return F.coalesce(
        ok & (text != "") & named & (url.rlike(r"(?i)\.gov(?![A-Za-z0-9_])") | low.rlike(GOVERNMENT_WORDS)), F.lit(False)
    )
