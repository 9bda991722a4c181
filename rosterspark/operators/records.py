"""Normalization, duplicate handling and keyed merges of records.

Every keyed operator is a ``groupBy`` with ``max_by`` / ``min_by`` / ``count``: rows are combined
before the shuffle, so a key that holds a large part of all rows reaches its reducer as one partial
result per input task. ``seq`` is the input order; it must be unique among rows of a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.functions.offices import (
    both_readings, merge_office_lists, normalize_offices, office_key,
)
from rosterspark.functions.text import (
    build_id, clean_email, clean_phone, filled, has, jurisdiction_key, parse_time, pin, trim, trimmed_or_null,
)
from rosterspark.functions.urls import absolutize_many, url_parts
from rosterspark.schema import OFFICE_KEYS, OFFICIAL, SOCIAL_KEYS

# Fields always taken from the newer record.
PROVENANCE = [
    "name", "office", "level", "body", "district", "jurisdiction", "source_url", "extracted_at",
    "confidence", "bio_checked_at",
]
# Fields a duplicate may fill in.
BACKFILL = ["phone", "email", "url", "photo_url", "address", "district", "hours", "bio", "bio_checked_at"]
# Contact fields merged by "not empty wins".
KNOWLEDGE = ["phone", "email", "url", "photo_url", "address", "hours", "bio"]


# --- normalization --------------------------------------------------------------------------


def clean_contacts(df: DataFrame, phone: str = "phone", email: str = "email") -> DataFrame:
    return df.withColumns({phone: clean_phone(phone), email: clean_email(email)})


def record_ids(df: DataFrame, state: str, city: str, office: str, name: str, out: str = "id") -> DataFrame:
    return df.withColumn(out, build_id(state, city, office, name))


def normalize(
    df: DataFrame,
    raw: str = "raw",
    jurisdiction: str = "jurisdiction",
    source_url: str = "source_url",
    extracted_at: str = "extracted_at",
) -> DataFrame:
    """Raw extracted officials (struct ``raw``) to canonical records; blank names are dropped.

    ``jurisdiction`` is a struct with city, state, level and body. Other columns stay in front.
    """
    r, j, page = F.col(raw), F.col(jurisdiction), F.col(source_url)
    keep = [c for c in df.columns if c not in {raw, jurisdiction, source_url, extracted_at}]
    named = df.filter(trim(F.coalesce(r["name"], F.lit(""))) != "")
    rows, urls, social = _with_urls(named, r, page)
    name = trim(r["name"])
    fields = {
        "id": build_id(j["state"], j["city"], r["office"], name),
        "name": name,
        "office": filled(trim(r["office"])),
        "level": F.coalesce(filled(j["level"]), F.lit("local")),
        "body": filled(j["body"]),
        "district": filled(r["district"]),
        "phone": clean_phone(r["phone"]),
        "email": clean_email(r["email"]),
        **urls,
        "social": social,
        "address": trimmed_or_null(r["address"]),
        "offices": normalize_offices(r["offices"]),
        "hours": trimmed_or_null(r["hours"]),
        "bio": trimmed_or_null(r["bio"]),
        "bio_checked_at": F.lit(None).cast("string"),
        "jurisdiction": F.struct(j["city"].alias("city"), j["state"].alias("state")),
        "source_url": page,
        "extracted_at": F.col(extracted_at).cast("string"),
        "confidence": r["confidence"].cast("double"),
    }
    return rows.select(*keep, *[fields[f.name].alias(f.name) for f in OFFICIAL])


def _with_urls(df: DataFrame, raw: Column, page: Column) -> tuple[DataFrame, dict[str, Column], Column]:
    """Resolve the url fields and social links of ``raw`` in one pass; the page address is read once."""
    refs = [raw["url"], raw["photo_url"], *[raw["social"][k] for k in SOCIAL_KEYS]]
    rows = pin(pin(df, _at=url_parts(page)), _urls=absolutize_many(refs, F.col("_at")))
    done = F.col("_urls")
    social = F.struct(*[done[i + 2].alias(k) for i, k in enumerate(SOCIAL_KEYS)])
    return rows, {"url": done[0], "photo_url": done[1]}, social


# --- one row per key ------------------------------------------------------------------------


def _whole_row(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def dedupe_best(df: DataFrame, keys: str | list[str], score: str, seq: str = "seq") -> DataFrame:
    """Highest score per key (missing = 0), first seen on ties; ``seq`` becomes the key's first one."""
    keys = [keys] if isinstance(keys, str) else keys
    rank = F.struct(F.coalesce(F.col(score), F.lit(0)).alias("s"), (-F.col(seq)).alias("q"))
    best = df.groupBy(*keys).agg(F.max_by(_whole_row(df), rank).alias("_r"), F.min(seq).alias("_first"))
    return best.select(*[F.col("_first").alias(c) if c == seq else F.col("_r")[c].alias(c) for c in df.columns])


def latest_per_key(df: DataFrame, keys: str | list[str], seq: str = "seq") -> DataFrame:
    """Last row per key; also the merge rule of one crawl and of jurisdictions of staged records."""
    keys = [keys] if isinstance(keys, str) else keys
    return df.groupBy(*keys).agg(F.max_by(_whole_row(df), F.col(seq)).alias("_r")).select("_r.*")


def first_per_key(df: DataFrame, keys: str | list[str], seq: str = "seq") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else keys
    return df.groupBy(*keys).agg(F.min_by(_whole_row(df), F.col(seq)).alias("_r")).select("_r.*")


def jurisdictions_of(officials: DataFrame, seq: str = "seq") -> DataFrame:
    """Distinct jurisdictions of staged officials; the last official of a key decides."""
    j = F.col("jurisdiction")
    rows = officials.select(
        jurisdiction_key(j["state"], j["city"], "level").alias("key"),
        j["city"].alias("city"), j["state"].alias("state"), "level", "body",
        F.when(has("source_url"), F.array("source_url")).otherwise(F.array().cast("array<string>")).alias("urls"),
        F.col("extracted_at").alias("discovered_at"), seq,
    )
    return latest_per_key(rows, "key", seq)


# --- shared values --------------------------------------------------------------------------


def strip_shared(
    df: DataFrame, batch: list[str], values: list[str], row_key: str, threshold: int = 3, salts: int = 16
) -> DataFrame:
    """Null a value that ``threshold`` or more rows of its batch carry in the same column.

    Values are counted on narrow rows with partial sums. Only shared values meet the rows again;
    that join is salted by row, so one value on a third of all rows spreads over ``salts`` tasks.
    The wide rows shuffle once, on their unique key.
    """
    narrow = df.select(
        *batch, row_key,
        F.inline(F.array(*[F.struct(F.lit(v).alias("_kind"), F.col(v).alias("_value")) for v in values])),
    ).filter(has("_value"))
    same = [*batch, "_kind", "_value"]
    shared = narrow.groupBy(*same).count().filter(F.col("count") >= threshold).drop("count")
    spread = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = narrow.withColumn("_salt", F.pmod(F.xxhash64(row_key), F.lit(salts)).cast("int"))
    on = [salted[c].eqNullSafe(spread[c]) if c in batch else salted[c] == spread[c] for c in [*same, "_salt"]]
    hits = salted.join(spread, reduce(Column.__and__, on), "left_semi")
    flags = hits.groupBy(row_key).agg(F.collect_set("_kind").alias("_shared"))
    joined = df.join(flags, row_key, "left")
    kept = {
        v: F.when(~F.coalesce(F.array_contains("_shared", v), F.lit(False)), F.col(v)) for v in values
    }
    return joined.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in df.columns])


def strip_shared_media(df: DataFrame, batch: list[str], row_key: str = "id", threshold: int = 3) -> DataFrame:
    """Drop photos and social links that several records of a batch share."""
    flat = {f"_s_{k}": F.col("social")[k] for k in SOCIAL_KEYS}
    wide = df.withColumns(flat)
    stripped = strip_shared(wide, batch, ["photo_url", *flat], row_key, threshold)
    social = F.when(F.col("social").isNotNull(), F.struct(*[F.col(f"_s_{k}").alias(k) for k in SOCIAL_KEYS]))
    return stripped.withColumn("social", social).select(*df.columns)


# --- upsert ---------------------------------------------------------------------------------


def _fold(knowledge: list[str], provenance: list[str], order: str) -> list[Column]:
    last = [F.max_by(c, order).alias(c) for c in provenance]
    known = [
        F.coalesce(F.max_by(F.col(c), F.when(has(c), F.col(order))), F.min_by(F.col(c), F.col(order))).alias(c)
        for c in knowledge
    ]
    return last + known


def merge_fields(
    rows: DataFrame, key: str, order: str, knowledge: list[str], provenance: list[str]
) -> DataFrame:
    """Fold the rows of a key in ``order``: provenance from the last row, knowledge from the last
    row that has it ('' and null do not), falling back to what the first row held."""
    return rows.groupBy(key).agg(*_fold(knowledge, provenance, order))


def _stack(existing: DataFrame, incoming: DataFrame, columns: list[str], seq: str) -> DataFrame:
    """Stored rows (order -1) and new rows (order ``seq``) as one table."""
    old = existing.select(*columns, F.lit(-1).cast("bigint").alias("_ord"))
    new = incoming.select(*columns, F.col(seq).cast("bigint").alias("_ord"))
    return old.unionByName(new)


def merge_records(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Upsert canonical records by id; several incoming rows of an id fold in ``seq`` order (>= 0).

    ``existing`` has one row per id. Stored and new rows are stacked and aggregated once on ``id``.
    """
    names = [f.name for f in OFFICIAL]
    rows = _stack(existing, incoming, names, seq)
    flat = rows.select(
        "*", *[F.col("social")[k].alias(f"_s_{k}") for k in SOCIAL_KEYS]
    )
    main = flat.groupBy("id").agg(
        *_fold([*KNOWLEDGE, *[f"_s_{k}" for k in SOCIAL_KEYS]], PROVENANCE, "_ord"),
        F.max(F.col("social").isNotNull()).alias("_has_social"),
        F.min("_ord").alias("_first_ord"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by("offices", "_ord").alias("_first_offices"),
    )
    joined = main.join(_merged_offices(rows), "id", "left")
    first_wins = F.transform(
        F.array_sort(F.coalesce("_groups", F.array().cast(_GROUPS))),
        lambda g: F.when(g["at"]["_ord"] == F.col("_first_ord"), g["from_first"]).otherwise(g["folded"]),
    )
    merged = {
        "social": F.when(F.col("_has_social"), F.struct(*[F.col(f"_s_{k}").alias(k) for k in SOCIAL_KEYS])),
        "offices": F.when(F.col("_n") == 1, F.col("_first_offices")).otherwise(first_wins),
    }
    return joined.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in names])


def fold_incoming(incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """The rows of each id in ``seq`` order as one record, ready to meet a stored one.

    ``offices`` are those of an id that isn't stored yet (its first row counts as the stored one); ``_offices_after`` are
    those that a stored record would take on. Everything else folds alike in both cases.
    """
    names = [f.name for f in OFFICIAL]
    rows = incoming.select(*names, F.col(seq).cast("bigint").alias("_ord"))
    flat = rows.select("*", *[F.col("social")[k].alias(f"_s_{k}") for k in SOCIAL_KEYS])
    main = flat.groupBy("id").agg(
        *_fold([*KNOWLEDGE, *[f"_s_{k}" for k in SOCIAL_KEYS]], PROVENANCE, "_ord"),
        F.max(F.col("social").isNotNull()).alias("_has_social"),
        F.min("_ord").alias("_first_ord"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by("offices", "_ord").alias("_first_offices"),
    )
    # Office lists meet row by row only where an id has several rows.
    several = flat.join(main.filter("_n > 1").select("id"), "id", "left_semi")
    joined = main.join(_merged_offices(several), "id", "left")
    groups = F.array_sort(F.coalesce("_groups", F.array().cast(_GROUPS)))
    alone = F.transform(groups, lambda g: F.when(g["at"]["_ord"] == F.col("_first_ord"), g["from_first"]).otherwise(g["folded"]))
    single = F.col("_n") == 1
    out = {
        "social": F.when(F.col("_has_social"), F.struct(*[F.col(f"_s_{k}").alias(k) for k in SOCIAL_KEYS])),
        "offices": F.when(single, F.col("_first_offices")).otherwise(alone),
    }
    after = F.when(single, F.col("_first_offices")).otherwise(F.transform(groups, lambda g: g["folded"]))
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in names], after.alias("_offices_after"))


def upsert_folded(existing: DataFrame, folded: DataFrame) -> DataFrame:
    """Stored records (one row an id) with ``fold_incoming``'s: one full outer join on id and a merge of the two rows.

    The same as ``merge_records``, but stored rows are neither shuffled nor sorted if they lie bucketed by id.
    """
    names = [f.name for f in OFFICIAL]
    old = existing.select("id", F.struct(*names).alias("_old"))
    new = folded.select("id", F.struct(*names, "_offices_after").alias("_new"))
    both = old.join(new, "id", "full_outer")
    o, n = F.col("_old"), F.col("_new")
    known = lambda a, b: F.when(has(b), b).otherwise(a)
    merged = {c: n[c] for c in PROVENANCE} | {c: known(o[c], n[c]) for c in KNOWLEDGE}
    merged["id"] = F.col("id")
    merged["social"] = F.when(
        o["social"].isNotNull() | n["social"].isNotNull(), F.struct(*[known(o["social"][k], n["social"][k]).alias(k) for k in SOCIAL_KEYS])
    )
    merged["offices"] = merge_office_lists(o["offices"], n["_offices_after"])
    return both.select(*[
        F.when(n["id"].isNull(), o[c]).when(o["id"].isNull(), n[c]).otherwise(merged[c]).alias(c) for c in names
    ])


_OFFICE_STRUCT = "struct<" + ",".join(f"{k}:string" for k in OFFICE_KEYS) + ">"
_GROUPS = (
    f"array<struct<at:struct<_ord:bigint,pos:int>,from_first:{_OFFICE_STRUCT},folded:{_OFFICE_STRUCT}>>"
)


def _merged_offices(rows: DataFrame) -> DataFrame:
    """Per id the offices of all its rows, one entry per office key.

    A key repeated inside the first row of an id counts with its last entry; repeats inside later
    rows fold together. Which row is first is known only at the id, so both readings are carried.
    """
    listed = rows.filter(F.size("offices") > 0).select("id", "_ord", F.posexplode_outer(both_readings(F.col("offices"))).alias("pos", "o"))
    placed = listed.select("id", "_ord", "pos", F.col("o.folded").alias("folded"), F.col("o.last").alias("last"))
    keyed = placed.withColumn("_key", office_key(F.col("folded")))
    aggs: list[Column] = [F.min(F.struct("_ord", "pos")).alias("at")]
    for k in OFFICE_KEYS:
        newest = F.when(has(F.col("folded")[k]), F.col("_ord"))
        aggs += [
            F.max_by(F.col("folded")[k], newest).alias(f"_v_{k}"),
            F.max(newest).alias(f"_o_{k}"),
            F.min_by(F.col("folded")[k], F.col("_ord")).alias(f"_a_{k}"),
            F.min_by(F.col("last")[k], F.col("_ord")).alias(f"_l_{k}"),
        ]
    grouped = keyed.groupBy("id", "_key").agg(*aggs)
    folded = F.struct(*[F.coalesce(F.col(f"_v_{k}"), F.col(f"_a_{k}")).alias(k) for k in OFFICE_KEYS])
    from_first = F.struct(*[
        F.when(F.col(f"_o_{k}") > F.col("at._ord"), F.col(f"_v_{k}")).otherwise(F.col(f"_l_{k}")).alias(k)
        for k in OFFICE_KEYS
    ])
    return grouped.groupBy("id").agg(
        F.collect_list(F.struct("at", from_first.alias("from_first"), folded.alias("folded"))).alias("_groups")
    )


def merge_enrichment(
    records: DataFrame, details: DataFrame, key: str = "id", page: str = "source_url", now: str = "extracted_at"
) -> DataFrame:
    """Fill gaps of records from a detail response (struct ``detail``, one row per id).

    The record wins where it has a value. ``details`` holds ``id``, ``detail``, the page it came
    from and the time; a record with a detail row gets that time as ``bio_checked_at``.
    """
    d = details.select(F.col(key), F.col("detail").alias("_d"), F.col(page).alias("_page"), F.col(now).alias("_now"))
    x = F.col("_d")
    rows, urls, social = _with_urls(records.join(d, key, "left"), x, F.col("_page"))
    found = {
        "phone": clean_phone(x["phone"]), "email": clean_email(x["email"]), **urls,
        "address": trimmed_or_null(x["address"]), "hours": trimmed_or_null(x["hours"]),
        "bio": trimmed_or_null(x["bio"]),
    }
    out = {c: F.when(F.col("_now").isNull() | has(c), F.col(c)).otherwise(v) for c, v in found.items()}
    out["social"] = F.when(F.col("_now").isNull(), F.col("social")).otherwise(
        F.struct(*[
            F.when(has(F.col("social")[k]), F.col("social")[k]).otherwise(social[k]).alias(k) for k in SOCIAL_KEYS
        ])
    )
    out["offices"] = F.when(F.col("_now").isNull(), F.col("offices")).otherwise(
        merge_office_lists("offices", normalize_offices(x["offices"]), incoming_wins=False)
    )
    out["bio_checked_at"] = F.coalesce(F.col("_now").cast("string"), F.col("bio_checked_at"))
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in records.columns])


def merge_reverse(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Fold rows of a key with the earliest non-empty value winning."""
    return rows.groupBy(key).agg(*[
        F.coalesce(F.min_by(F.col(c), F.when(has(c), F.col(order))), F.max_by(F.col(c), F.col(order))).alias(c)
        for c in columns
    ])


# --- duplicate collapse ---------------------------------------------------------------------


def collapse_rows(
    df: DataFrame, key: str, newest: Column, seq: str, base: list[str], backfill: list[str]
) -> DataFrame:
    """One row per key: the newest is the base, its nulls are filled from the newest row that has
    the field; ``_n`` counts the rows collapsed."""
    order = F.struct(newest.alias("t"), (-F.col(seq)).alias("q"))
    return df.withColumn("_order", order).groupBy(key).agg(
        *[F.max_by(c, "_order").alias(c) for c in base],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in backfill],
        F.count(F.lit(1)).alias("_n"),
    )


def collapse_duplicates(officials: DataFrame, seq: str = "seq") -> DataFrame:
    """Recompute ids and collapse the records that now share one; ``_n`` counts them."""
    j = F.col("jurisdiction")
    flat = officials.withColumn("id", build_id(j["state"], j["city"], "office", "name")).withColumns(
        {f"_s_{k}": F.col("social")[k] for k in SOCIAL_KEYS}
    )
    flat = flat.withColumns({
        "_list": F.when(F.size("offices") > 0, F.col("offices")),
        "_any_social": F.col("social").isNotNull().cast("int"),
    })
    names = [f.name for f in OFFICIAL]
    base = [c for c in names if c not in {"id", "social", *BACKFILL}]
    socials = [f"_s_{k}" for k in SOCIAL_KEYS]
    merged = collapse_rows(
        flat.withColumn("_any", F.when(F.col("_any_social") == 1, F.lit(1))),
        "id", parse_time("extracted_at"), seq, base, [*BACKFILL, *socials, "_list", "_any"],
    )
    out = {
        "social": F.when(F.col("_any").isNotNull(), F.struct(*[F.col(f"_s_{k}").alias(k) for k in SOCIAL_KEYS])),
        "offices": F.coalesce("_list", "offices"),
    }
    return merged.select(*[out[c].alias(c) if c in out else F.col(c) for c in names], "_n")


def collapse_report(collapsed: DataFrame) -> DataFrame:
    """Duplicate groups, removed records and totals of a collapse."""
    n = F.col("_n")
    return collapsed.agg(
        F.coalesce(F.sum((n > 1).cast("bigint")), F.lit(0)).alias("groups"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("removed"),
        F.coalesce(F.sum(n), F.lit(0)).alias("before"),
        F.count(F.lit(1)).alias("after"),
    )


# --- coverage and unions --------------------------------------------------------------------


def coverage_stats(df: DataFrame, state: str, city: str) -> DataFrame:
    """Row count and sorted distinct non-empty cities per state.

    Counts are first taken per (state, city), so a big state reaches its reducer as one row per city.
    """
    per_city = df.groupBy(F.col(state).alias("state"), F.col(city).alias("city")).count()
    return per_city.groupBy("state").agg(
        F.sum("count").alias("count"),
        F.sort_array(F.collect_set(F.when(has("city"), F.col("city")))).alias("cities"),
    )


def override_union(base: DataFrame, override: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Union by key where ``override`` replaces ``base`` rows but keeps their position.

    Within one side the last row of a key counts. ``seq`` of the result orders base keys first.
    """
    cols = [c for c in base.columns if c != seq]
    both = base.select(*cols, F.lit(0).alias("_side"), F.col(seq).alias("_seq")).unionByName(
        override.select(*cols, F.lit(1).alias("_side"), F.col(seq).alias("_seq"))
    )
    order = F.struct("_side", "_seq")
    row = F.struct(*[F.col(c) for c in cols])
    picked = both.groupBy(*keys).agg(F.max_by(row, order).alias("_r"), F.min(order).alias("position"))
    return picked.select(*[F.col("_r")[c].alias(c) for c in cols], "position")
