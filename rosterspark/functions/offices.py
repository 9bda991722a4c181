"""Column expressions over the nested office list and the fixed-key social struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterspark.functions.text import clean_phone, col, filled, has, let, trimmed_or_null
from rosterspark.functions.urls import absolutize_many, url_parts
from rosterspark.schema import OFFICE, OFFICE_KEYS, SOCIAL_KEYS


def no_offices() -> Column:
    return F.array().cast(f"array<{OFFICE.simpleString()}>")


def normalize_offices(c: Column | str) -> Column:
    """Trim every field, format phones, drop offices without address, phone, fax and hours."""

    def tidy(o):
        text = {k: trimmed_or_null(o[k]) for k in OFFICE_KEYS}
        text["classification"] = F.coalesce(text["classification"], F.lit("other"))
        text["phone"] = clean_phone(o["phone"])
        return F.struct(*[text[k].alias(k) for k in OFFICE_KEYS])

    def useful(o):
        return has(o["address"]) | has(o["phone"]) | has(o["fax"]) | has(o["hours"])

    return F.coalesce(F.filter(F.transform(col(c), tidy), useful), no_offices())


def office_key(o: Column) -> Column:
    """Identity of an office in a list: classification and its first non-empty locator."""
    locator = F.coalesce(*[filled(o[k]) for k in ("address", "city", "phone", "name")], F.lit(""))
    return F.concat(F.coalesce(o["classification"], F.lit("")), F.lit("|"), F.lower(locator))


def _last_filled(group: Column, key: str) -> Column:
    """Last non-empty value of ``key`` in a list of offices; the first entry's value if none is."""
    values = F.transform(group, lambda o: o[key])
    return F.coalesce(
        F.try_element_at(F.filter(values, lambda v: has(v)), F.lit(-1)), F.try_element_at(values, F.lit(1))
    )


def by_key(c: Column, entry) -> Column:
    """``entry(offices)`` per office key, keys in first-seen order."""

    def keyed(pairs):
        def of(k):
            return entry(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["office"]))

        return F.transform(F.array_distinct(F.transform(pairs, lambda p: p["key"])), of)

    return let(F.transform(c, lambda o: F.struct(office_key(o).alias("key"), o.alias("office"))), keyed)


def folded(group: Column, prefer_last: bool = True) -> Column:
    """One office of a group: each field from the last (or first) non-empty value."""

    def fold(offices):
        ordered = offices if prefer_last else F.reverse(offices)
        return F.struct(*[_last_filled(ordered, k).alias(k) for k in OFFICE_KEYS])

    return let(group, lambda g: F.when(F.size(g) == 1, g[0]).otherwise(fold(g)))


def fold_offices(c: Column, prefer_last: bool = True) -> Column:
    """One entry per key, first-seen order; fields from the last (or first) non-empty value."""
    return by_key(c, lambda group: folded(group, prefer_last))


def last_per_key(c: Column) -> Column:
    """One entry per key, first-seen order; the last entry of a key replaces earlier ones."""
    return by_key(c, lambda group: F.element_at(group, -1))


def both_readings(c: Column) -> Column:
    """Per key the folded office and the last one (structs ``folded`` and ``last``)."""
    return by_key(c, lambda group: F.struct(folded(group).alias("folded"), F.element_at(group, -1).alias("last")))


def merge_office_lists(existing: Column | str, incoming: Column | str, incoming_wins: bool = True) -> Column:
    """Merge two office lists by key; matching entries merge field by field, new ones are appended.

    A key repeated inside ``existing`` counts with its last entry only.
    """
    base = last_per_key(F.coalesce(col(existing), no_offices()))
    return fold_offices(F.concat(base, F.coalesce(col(incoming), no_offices())), prefer_last=incoming_wins)


def merge_same_place(*lists: Column) -> Column:
    """Offices of several sources, one per city and phone; an entry with an address is preferred."""

    def key(o):
        return F.concat(
            F.lower(F.coalesce(o["city"], F.lit(""))), F.lit("|"), F.coalesce(o["phone"], F.lit(""))
        )

    def pick(pairs):
        def best(k):
            same = F.filter(pairs, lambda p: p["key"] == k)
            return let(
                same,
                lambda s: F.coalesce(
                    F.try_element_at(F.filter(s, lambda p: has(p["office"]["address"])), F.lit(1)), s[0]
                )["office"],
            )

        return F.transform(F.array_distinct(F.transform(pairs, lambda p: p["key"])), best)

    joined = F.concat(*[F.coalesce(x, no_offices()) for x in lists])
    return let(F.transform(joined, lambda o: F.struct(key(o).alias("key"), o.alias("office"))), pick)


def offices_from_field_offices(c: Column | str) -> Column:
    """Phone-and-city field offices in the common office shape."""

    def shape(o):
        known = {"classification": F.lit("district"), "city": filled(o["city"]), "phone": filled(o["phone"])}
        return F.struct(*[known.get(k, F.lit(None).cast("string")).alias(k) for k in OFFICE_KEYS])

    return F.coalesce(F.transform(col(c), shape), no_offices())


def extra_offices(offices: Column | str, phone: Column | str) -> Column:
    """Offices that say more than the record's own phone number."""
    phone = col(phone)

    def repeats(o):
        return ~has(o["address"]) & ~has(o["hours"]) & ~has(o["fax"]) & has(phone) & F.coalesce(o["phone"] == phone, F.lit(False))

    return F.coalesce(F.filter(col(offices), lambda o: ~repeats(o)), no_offices())
