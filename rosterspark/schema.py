"""Declared schemas of the tables (reading never infers them)."""

from __future__ import annotations

from pyspark.sql import types as T

SOCIAL_KEYS = ["twitter", "facebook", "instagram", "linkedin", "youtube"]
OFFICE_KEYS = ["classification", "name", "city", "address", "phone", "fax", "hours"]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _fields(struct: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType(struct.fields + [T.StructField(k, v) for k, v in more.items()])


SOCIAL = _strings(*SOCIAL_KEYS)
OFFICE = _strings(*OFFICE_KEYS)
JURISDICTION_REF = _strings("city", "state")

OFFICIAL = T.StructType(
    _strings("id", "name", "office", "level", "body", "district", "phone", "email", "url", "photo_url").fields
    + [T.StructField("social", SOCIAL), T.StructField("address", T.StringType())]
    + [T.StructField("offices", T.ArrayType(OFFICE))]
    + _strings("hours", "bio", "bio_checked_at").fields
    + [T.StructField("jurisdiction", JURISDICTION_REF)]
    + _strings("source_url", "extracted_at").fields
    + [T.StructField("confidence", T.DoubleType())]
)

SHARD = T.StructType(
    _strings("state", "generated_at").fields
    + [
        T.StructField("count", T.LongType()),
        T.StructField("cities", T.ArrayType(T.StringType())),
        T.StructField("officials", T.ArrayType(OFFICIAL)),
    ]
)

JURISDICTION = _fields(
    _strings("city", "state", "level", "body"),
    urls=T.ArrayType(T.StringType()),
    discovered_at=T.StringType(),
)
JURISDICTION_FILE = T.StructType([T.StructField("jurisdictions", T.ArrayType(JURISDICTION))])

# Extraction responses.
RAW_OFFICIAL = T.StructType(
    _strings("name", "office", "district", "phone", "email", "url", "photo_url").fields
    + [T.StructField("social", SOCIAL), T.StructField("address", T.StringType())]
    + [T.StructField("offices", T.ArrayType(OFFICE))]
    + _strings("hours", "bio").fields
    + [T.StructField("confidence", T.DoubleType())]
)
ROSTER_RESPONSE = T.StructType([T.StructField("officials", T.ArrayType(RAW_OFFICIAL))])
DETAIL_RESPONSE = T.StructType(
    _strings("phone", "email", "url", "photo_url").fields
    + [T.StructField("social", SOCIAL), T.StructField("address", T.StringType())]
    + [T.StructField("offices", T.ArrayType(OFFICE))]
    + _strings("hours", "bio").fields
)
SUBMISSION_RESPONSE = T.StructType(
    [
        T.StructField("is_government_source", T.BooleanType()),
        T.StructField("jurisdiction", _strings("city", "county", "state", "level", "body")),
        T.StructField("officials", T.ArrayType(RAW_OFFICIAL)),
    ]
)

# State tier people.
PERSON = T.StructType(
    _strings("id", "name", "party").fields
    + [
        T.StructField("current_role", _strings("title", "org_classification", "district", "division_id")),
        T.StructField("jurisdiction", _strings("id", "name", "classification")),
    ]
    + _strings("image", "email", "openstates_url").fields
    + [
        T.StructField("links", T.ArrayType(_strings("url", "note"))),
        T.StructField("offices", T.ArrayType(_strings("name", "fax", "voice", "address", "classification"))),
        T.StructField("contact_details", T.ArrayType(_strings("type", "value"))),
    ]
)
PEOPLE_FILE = T.StructType([T.StructField("results", T.ArrayType(PERSON))])

# Federal tier.
TERM = _strings("type", "start", "end", "address", "phone", "fax", "office")
LEGISLATOR = T.StructType(
    [T.StructField("id", _strings("bioguide", "wikipedia")), T.StructField("terms", T.ArrayType(TERM))]
)
COMMITTEE = _fields(
    _strings("thomas_id", "name"), subcommittees=T.ArrayType(_strings("thomas_id", "name"))
)
MEMBERSHIP = T.MapType(T.StringType(), T.ArrayType(_strings("bioguide", "title")))
DISTRICT_OFFICES = T.StructType(
    [
        T.StructField("id", _strings("bioguide")),
        T.StructField(
            "offices", T.ArrayType(_strings("building", "suite", "city", "address", "phone", "fax", "hours"))
        ),
    ]
)
SOCIAL_HANDLES = T.StructType(
    [
        T.StructField("id", _strings("bioguide")),
        T.StructField("social", _strings("twitter", "facebook", "instagram", "youtube", "youtube_id")),
    ]
)
REP = _fields(
    _strings("id", "name", "phone", "url", "photoURL", "party", "state", "district", "reason", "area"),
    field_offices=T.ArrayType(_strings("phone", "city")),
)

# Pages, logs, caches.
PAGE_FETCH = T.StructType(
    _strings("requested_url", "url").fields
    + [T.StructField("ok", T.BooleanType()), T.StructField("status", T.IntegerType())]
    + _strings("html", "error").fields
)
RESOLVED = _strings("state", "county", "place")
SEARCH_LOG = T.StructType(_strings("t", "query", "typed").fields + [T.StructField("resolved", RESOLVED)])
CACHE_ENTRY = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("officials", T.ArrayType(OFFICIAL)),
    ]
    + _strings("source_url", "checked_at", "error").fields
)
