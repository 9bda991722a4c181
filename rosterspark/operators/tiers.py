"""State and federal tiers: people payloads to cards, terms, offices, committees, social links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.functions.html import platform_of
from rosterspark.functions.offices import no_offices
from rosterspark.functions.text import col, filled, has, null, pin, squeeze
from rosterspark.functions.urls import url_host
from rosterspark.schema import OFFICE_KEYS, SOCIAL_KEYS

# Social hosts of the state tier.
STATE_SOCIAL_HOSTS = [
    ("twitter", r"(^|\.)(twitter|x)\.com\z"),
    ("facebook", r"(^|\.)facebook\.com\z"),
    ("instagram", r"(^|\.)instagram\.com\z"),
    ("linkedin", r"(^|\.)linkedin\.com\z"),
    ("youtube", r"(^|\.)(youtube\.com|youtu\.be)\z"),
]
# Role classes to card areas.
CHAMBERS = {"upper": "StateUpper", "legislature": "StateUpper", "lower": "StateLower"}


def _office(**fields: Column) -> Column:
    return F.struct(*[fields.get(k, null()).alias(k) for k in OFFICE_KEYS])


def _first(items: Column, keep) -> Column:
    return F.try_element_at(F.filter(items, keep), F.lit(1))


# --- state people ---------------------------------------------------------------------------


def with_platforms(links: Column | str) -> Column:
    """Usable links with their social platform (null for other sites)."""
    return F.transform(
        F.filter(col(links), lambda l: has(l["url"])),
        lambda l: F.struct(l["url"].alias("url"), platform_of(url_host(l["url"]), STATE_SOCIAL_HOSTS).alias("platform")),
    )


def classify_social(found: Column) -> Column:
    """First link per platform of ``with_platforms``, five keys always present."""
    def first_of(platform):
        return _first(found, lambda l: l["platform"] == platform)["url"].alias(platform)

    return F.struct(*[first_of(k) for k in SOCIAL_KEYS])


def first_non_social_link(found: Column) -> Column:
    return _first(found, lambda l: l["platform"].isNull())["url"]


def _contact(person: Column, kind: str) -> Column:
    return _first(person["contact_details"], lambda c: (c["type"] == kind) & has(c["value"]))["value"]


def phone_from(person: Column) -> Column:
    voiced = F.filter(person["offices"], lambda o: has(o["voice"]))
    return F.coalesce(
        _first(voiced, lambda o: o["classification"] == "capitol")["voice"],
        F.try_element_at(voiced, F.lit(1))["voice"], _contact(person, "voice"), F.lit(""),
    )


def email_from(person: Column) -> Column:
    return F.coalesce(filled(person["email"]), _contact(person, "email"), F.lit(""))


def offices_from(person: Column) -> Column:
    def shape(o):
        return _office(
            classification=F.coalesce(filled(o["classification"]), F.lit("other")), name=filled(o["name"]),
            address=filled(o["address"]), phone=filled(o["voice"]), fax=filled(o["fax"]),
        )

    useful = lambda o: F.coalesce(o["address"], o["phone"], o["fax"]).isNotNull()
    return F.coalesce(F.filter(F.transform(person["offices"], shape), useful), no_offices())


def _card(people: DataFrame, person: str, state: str, area: Column, district: Column) -> DataFrame:
    p = F.col(person)
    keep = [c for c in people.columns if c not in {person, state}]
    rows = people.filter((p["jurisdiction"]["classification"] == "state") & has(area))
    rows, found = pin(rows, _found=with_platforms(p["links"])), F.col("_found")
    return rows.select(
        *keep, p["id"].alias("id"), p["name"].alias("name"), area.alias("area"), F.col(state).alias("state"),
        F.coalesce(p["party"], F.lit("")).alias("party"), district.alias("district"),
        phone_from(p).alias("phone"), email_from(p).alias("email"),
        F.coalesce(filled(p["openstates_url"]), first_non_social_link(found), F.lit("")).alias("url"),
        F.coalesce(p["image"], F.lit("")).alias("photo_url"),
        classify_social(found).alias("social"), offices_from(p).alias("offices"),
    )


def legislator_cards(people: DataFrame, person: str = "person", state: str = "state") -> DataFrame:
    """Cards of state legislators; other jurisdictions and roles drop out."""
    role = F.col(person)["current_role"]
    chambers = F.create_map(*[F.lit(x) for kv in CHAMBERS.items() for x in kv])
    area = F.try_element_at(chambers, role["org_classification"])
    district = F.when(has(role["district"]), F.concat(F.lit("District "), role["district"])).otherwise(F.lit(""))
    return _card(people, person, state, area, district)


def executive_cards(people: DataFrame, person: str = "person", state: str = "state") -> DataFrame:
    """Cards of statewide executives; '_' in titles reads as a space."""
    role = F.col(person)["current_role"]
    title = F.when(role["title"] == "Lt_Governor", F.lit("Lieutenant Governor")).otherwise(F.translate(role["title"], "_", " "))
    area = F.when(role["org_classification"] == "executive", title)
    return _card(people, person, state, area, F.lit(""))


# --- federal people -------------------------------------------------------------------------


def current_term(terms: Column | str) -> Column:
    return F.try_element_at(col(terms), F.lit(-1))


def dc_office(terms: Column | str) -> Column:
    """Office of the current term; null without address, phone and office."""
    t = current_term(terms)
    known = has(t["address"]) | has(t["phone"]) | has(t["office"])
    return F.when(known, _office(
        classification=F.lit("dc"), name=F.coalesce(filled(t["office"]), F.lit("Washington DC Office")),
        address=filled(t["address"]), phone=filled(t["phone"]), fax=filled(t["fax"]),
    ))


def social_urls(handles: DataFrame, bioguide: str = "bioguide", social: str = "social") -> DataFrame:
    """Profile URLs from handles; people without any drop out."""
    s = F.col(social)

    def at(site, key):
        return F.concat(F.lit(site), filled(s[key]))

    urls = F.struct(
        at("https://twitter.com/", "twitter").alias("twitter"), at("https://facebook.com/", "facebook").alias("facebook"),
        at("https://instagram.com/", "instagram").alias("instagram"),
        F.coalesce(at("https://youtube.com/", "youtube"), at("https://youtube.com/channel/", "youtube_id")).alias("youtube"),
    )
    any_url = F.coalesce(*[urls[k] for k in ("twitter", "facebook", "instagram", "youtube")])
    return handles.filter(has(bioguide) & any_url.isNotNull()).select(F.col(bioguide).alias("bioguide"), urls.alias("social"))


def committee_names(committees: DataFrame) -> DataFrame:
    """committee_id -> name for committees and their subcommittees; a later entry replaces an earlier one.

    ``committees`` has ``seq`` (file order).
    """
    parents = committees.filter(has("thomas_id")).select(
        F.col("thomas_id").alias("committee_id"), F.col("name").alias("committee"), F.struct("seq", F.lit(-1).alias("pos")).alias("_o")
    )
    subs = committees.filter(has("thomas_id")).select("thomas_id", "name", "seq", F.posexplode("subcommittees").alias("pos", "s"))
    subs = subs.filter(has(F.col("s.thomas_id"))).select(
        F.concat("thomas_id", F.col("s.thomas_id")).alias("committee_id"),
        F.concat(F.col("name"), F.lit(" — "), F.col("s.name")).alias("committee"), F.struct("seq", "pos").alias("_o"),
    )
    return parents.unionByName(subs).groupBy("committee_id").agg(F.max_by("committee", "_o").alias("committee"))


def committee_members(membership: DataFrame, names: DataFrame) -> DataFrame:
    """One row per member and committee: bioguide, committee_id, committee, role, seq, pos.

    ``membership`` has ``committee_id``, ``members`` (array) and ``seq``. An unknown id is its own name.
    """
    rows = membership.select("committee_id", "seq", F.posexplode("members").alias("pos", "m")).filter(has(F.col("m.bioguide")))
    return rows.join(names, "committee_id", "left").select(
        F.col("m.bioguide").alias("bioguide"), "committee_id",
        F.coalesce("committee", "committee_id").alias("committee"), filled(F.col("m.title")).alias("role"), "seq", "pos",
    )


def invert_committees(members: DataFrame) -> DataFrame:
    """Per person the list ``{id, name, role}`` in committee order."""
    item = F.struct("seq", "pos", F.col("committee_id").alias("id"), F.col("committee").alias("name"), "role")
    return members.groupBy("bioguide").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda r: F.struct(r["id"].alias("id"), r["name"].alias("name"), r["role"].alias("role"))).alias("committees")
    )


def district_offices_by_person(entries: DataFrame) -> DataFrame:
    """Per person the district offices, named building and suite; people without any drop out.

    ``entries``: bioguide, offices, seq; the last non-empty entry of a person counts.
    """
    def shape(o):
        return _office(
            classification=F.lit("district"), name=filled(F.concat_ws(", ", filled(o["building"]), filled(o["suite"]))),
            city=filled(o["city"]), address=filled(o["address"]), phone=filled(o["phone"]),
            fax=filled(o["fax"]), hours=filled(o["hours"]),
        )

    rows = entries.filter(has("bioguide") & (F.size("offices") > 0))
    listed = rows.select("bioguide", F.transform("offices", shape).alias("offices"), "seq")
    return listed.groupBy("bioguide").agg(F.max_by("offices", "seq").alias("district_offices"))


def federal_details(legislators: DataFrame, committees: DataFrame, offices: DataFrame, bios: DataFrame | None = None) -> DataFrame:
    """Term dates, DC office, committees, district offices and bio per bioguide.

    Each other table has one row per bioguide: three left joins on the same key. The last entry
    of a repeated bioguide counts (``seq``).
    """
    t = current_term("terms")
    base = legislators.filter(has("bioguide")).select(
        "bioguide", filled(t["start"]).alias("term_start"), filled(t["end"]).alias("term_end"), dc_office("terms").alias("dc_office"), "seq"
    )
    row = F.struct("term_start", "term_end", "dc_office")
    base = base.groupBy("bioguide").agg(F.max_by(row, "seq").alias("_r")).select("bioguide", "_r.*")
    rows = base.join(committees, "bioguide", "left").join(offices, "bioguide", "left")
    rows = rows.join(bios, "bioguide", "left") if bios is not None else rows.withColumns({"bio": null(), "bio_source": null()})
    return rows.withColumns({
        "committees": F.coalesce("committees", F.array().cast("array<struct<id:string,name:string,role:string>>")),
        "district_offices": F.coalesce("district_offices", no_offices()),
    })


# --- geography answers ----------------------------------------------------------------------


def _layer(geo: Column, keep) -> Column:
    """First entry of the first layer whose name passes; the map's keys keep answer order."""
    name = F.try_element_at(F.filter(F.map_keys(geo), keep), F.lit(1))
    return F.try_element_at(F.try_element_at(geo, name), F.lit(1))


def geo_projection(answers: DataFrame, geo: str = "geographies", state_hint: Column | None = None) -> DataFrame:
    """Place, county, state and districts of a geography answer.

    ``geo`` is ``map<string, array<struct<BASENAME,NAME,STUSAB>>>``.
    """
    g = F.col(geo)

    def named(layer):
        return F.coalesce(filled(layer["BASENAME"]), filled(layer["NAME"]))

    def has_all(*parts):
        return lambda k: reduce(Column.__and__, [F.contains(F.lower(k), F.lit(p)) for p in parts])

    districts = F.struct(
        filled(_layer(g, has_all("congressional"))["BASENAME"]).alias("congressional"),
        filled(_layer(g, has_all("legislative", "upper"))["BASENAME"]).alias("state_upper"),
        filled(_layer(g, has_all("legislative", "lower"))["BASENAME"]).alias("state_lower"),
    )
    state = filled(_layer(g, lambda k: k == "States")["STUSAB"])
    return answers.withColumns({
        "state": F.coalesce(filled(state_hint), state) if state_hint is not None else state,
        "county": named(_layer(g, lambda k: k == "Counties")),
        "place": named(_layer(g, lambda k: k == "Incorporated Places")),
        "districts": districts,
    })


def is_bare_zip(c: Column | str) -> Column:
    return squeeze(c).rlike(r"^[0-9]{5}(-[0-9]{4})?\z")


def resolve_locations(requests: DataFrame, by_zip: DataFrame, by_address: DataFrame, by_name: DataFrame) -> DataFrame:
    """First answer per request: the ZIP answer for a bare ZIP, else address, else place name.

    ``requests``: request_id, query. The answer tables hold one row per key (zip5 or query) with a
    struct ``geo``.
    """
    rows = requests.withColumn("_zip", F.when(is_bare_zip("query"), F.left(squeeze("query"), F.lit(5))))
    z = by_zip.select(F.col("zip5").alias("_zip"), F.col("geo").alias("_z"))
    a = by_address.select("query", F.col("geo").alias("_a"))
    n = by_name.select("query", F.col("geo").alias("_n"))
    joined = rows.join(z, "_zip", "left").join(a, "query", "left").join(n, "query", "left")
    geo = F.when(F.col("_zip").isNotNull(), F.col("_z")).otherwise(F.coalesce("_a", "_n"))
    return joined.select("request_id", "query", geo.alias("geo"))
