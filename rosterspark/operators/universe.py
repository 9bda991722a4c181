"""Universe of places and counties with population, and coverage measures."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.functions.text import has, strip_place_suffix

# Header names of the public files.
USPS_NAMES = ["USPS", "STATE", "STUSAB"]
PLACE_WIDTH = 5
COUNTY_WIDTH = 3
MATCH_WARNING = 0.5


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """First candidate present, ignoring case; a missing column is an error."""
    by_lower: dict[str, str] = {}
    for name in df.columns:
        by_lower.setdefault(name.lower(), name)
    for candidate in candidates:
        if candidate.lower() in by_lower:
            return by_lower[candidate.lower()]
    raise ValueError(f"none of {candidates} in header {df.columns}")


def latest_year_column(df: DataFrame, prefix: str = "POPESTIMATE") -> str:
    """Column of the highest year; a file without any is an error."""
    years = [int(m[1]) for m in (re.fullmatch(rf"{prefix}(\d{{4}})", c) for c in df.columns) if m]
    if not years:
        raise ValueError(f"no {prefix}<year> column in header {df.columns}")
    return f"{prefix}{max(years)}"


def population_number(c: Column) -> Column:
    """An empty cell counts 0, an absent or unreadable one is null."""
    return F.when(F.trim(c) == "", F.lit(0.0)).otherwise(c.try_cast("double")).cast("bigint")


def padded_geoid(state: Column, geo: Column, width: int) -> Column:
    """Zero-padded state and area code; null when a code is too long."""
    s, g = F.coalesce(state, F.lit("")), F.coalesce(geo, F.lit(""))
    fits = (F.length(s) <= 2) & (F.length(g) <= width)
    return F.when(fits, F.concat(F.lpad(s, 2, "0"), F.lpad(g, width, "0")))


def population_by_geoid(df: DataFrame, area: str, width: int, seq: str = "seq", sumlev: str | None = None) -> DataFrame:
    """geoid -> population of the newest estimate; the last row of a repeated geoid counts.

    ``sumlev`` keeps one summary level of the file first.
    """
    state, geo, pop = resolve_column(df, ["STATE"]), resolve_column(df, [area]), latest_year_column(df)
    rows = df if sumlev is None else df.filter(F.col(resolve_column(df, ["SUMLEV"])) == sumlev)
    rows = rows.select(
        padded_geoid(F.col(state), F.col(geo), width).alias("geoid"), population_number(F.col(pop)).alias("population"), seq
    ).filter("geoid is not null and population is not null")
    return rows.groupBy("geoid").agg(F.max_by("population", seq).alias("population"))


def with_population(areas: DataFrame, population: DataFrame, geoid: str = "geoid") -> DataFrame:
    """Left join; an area without a figure stays with null."""
    return areas.join(population.select(F.col("geoid").alias(geoid), "population"), geoid, "left")


def build_places(places: DataFrame, population: DataFrame, state: str | None = None) -> DataFrame:
    """Active places of a state (or of all) with suffix-free names.

    ``recognized`` tells whether a known suffix was dropped.
    """
    usps, name = resolve_column(places, USPS_NAMES), resolve_column(places, ["NAME"])
    status, geoid = resolve_column(places, ["FUNCSTAT"]), resolve_column(places, ["GEOID"])
    rows = places.filter(F.col(status) == "A")
    if state:
        rows = rows.filter(F.upper(usps) == state.upper())
    short = strip_place_suffix(name)
    rows = rows.select(
        F.upper(usps).alias("state"), F.lit("local").alias("level"), short.alias("name"), F.col(geoid).alias("geoid"),
        F.col(name).alias("raw_name"), (short != F.col(name)).alias("recognized"),
    )
    return with_population(rows.filter(has("name")), population)


def build_counties(counties: DataFrame, population: DataFrame, state: str | None = None) -> DataFrame:
    usps, name, geoid = resolve_column(counties, USPS_NAMES), resolve_column(counties, ["NAME"]), resolve_column(counties, ["GEOID"])
    rows = counties.filter(F.upper(usps) == state.upper()) if state else counties
    rows = rows.select(
        F.upper(usps).alias("state"), F.lit("county").alias("level"), F.col(name).alias("name"), F.col(geoid).alias("geoid"),
        F.col(name).alias("raw_name"), F.lit(True).alias("recognized"),
    )
    return with_population(rows.filter(has("name")), population)


def coverage_metrics(universe: DataFrame, group: list[str], matched: Column | None = None) -> DataFrame:
    """Rows, rows with a figure, their ratio and the warning mark per group."""
    hit = F.col("population").isNotNull() if matched is None else matched
    counts = universe.groupBy(*group).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("matched"))
    ratio = F.col("matched") / F.col("total")
    return counts.withColumns({"ratio": ratio, "low_match": ratio < MATCH_WARNING})


def unrecognized_names(places: DataFrame) -> DataFrame:
    """Distinct place names without a known suffix, to check by eye."""
    return places.filter(~F.col("recognized")).select("state", "raw_name").distinct()


def latest_populated_vintage(listing: DataFrame, probes: DataFrame, fallback: str, kind: str = "year") -> DataFrame:
    """Newest listed folder whose probe file exists, else ``fallback``; one row ``vintage``.

    ``listing``: html; ``probes``: vintage. ``kind`` year reads ``2024_Gazetteer/`` folders, range
    reads ``2020-2024/`` folders ordered by their end.
    """
    pattern = r'href="(\d{4})_Gazetteer/"' if kind == "year" else r'href="(\d{4}-\d{4})/"'
    found = listing.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("vintage")).distinct()
    good = found.join(probes.select("vintage").distinct(), "vintage", "left_semi")
    newest = good.agg(F.max_by("vintage", F.right("vintage", F.lit(4))).alias("vintage"))
    return newest.select(F.coalesce("vintage", F.lit(fallback)).alias("vintage"))
