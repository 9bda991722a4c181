"""Readers of the input files, all with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark import schema as S
from rosterspark.functions.text import has, jurisdiction_key
from rosterspark.operators.records import override_union


def _json(spark: SparkSession, path, schema, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def file_order() -> Column:
    """Position of a row in its input: file by name, then place in the file. Spark packs files into tasks by size, so the
    row number alone doesn't follow their names."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_shards(spark: SparkSession, path: str, names: str = "[A-Z][A-Z].json") -> DataFrame:
    """Officials of all state shard files; ``names`` are two letters, so the index is left out."""
    shards = spark.read.schema(S.SHARD).option("multiLine", True).option("pathGlobFilter", names).json(path)
    return shards.select(F.inline("officials"))


def read_officials(spark: SparkSession, path: str) -> DataFrame:
    """Officials table written by ``upsert_shards``."""
    return spark.read.parquet(path)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Coverage index file: state -> {count, cities, updated} as rows."""
    entry = "struct<count:bigint,cities:array<string>,updated:string>"
    index = spark.read.schema(f"generated_at string, states map<string,{entry}>").option("multiLine", True).json(path)
    return index.select(F.explode("states").alias("state", "e")).select("state", "e.*")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited file with header; cells and header names trimmed, blank lines dropped."""
    return _delimited(spark, path, "|")


def read_popest(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, ",")


def _delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All cells as text: '' for an empty cell, null for one that a short line does not have."""
    reader = spark.read.option("sep", sep).option("quote", "").option("header", True)
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    names = reader.csv(path).columns
    # Spark deals columns by place, so each file's header must be the first one's; a header is a row like the others here.
    columns = ", ".join(f"`{n}` string" for n in [*names, "_short"])
    rows = reader.option("header", False).schema(columns).option("columnNameOfCorruptRecord", "_short").csv(path)
    rows = rows.select("*", file_order().alias("seq"))
    cells = F.size(F.split("_short", "[" + sep + "]"))
    there = [F.coalesce(F.col(f"`{n}`"), F.when(F.col("_short").isNull() | (cells > i), F.lit(""))) for i, n in enumerate(names)]
    rows = rows.select(*[c.alias(n.strip()) for c, n in zip(there, names, strict=True)], "seq")
    plain = [n.strip() for n in names]
    own = F.array_sort(F.array(*[F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")) for n in plain])) == F.array(*[F.lit(n) for n in sorted(plain)])
    same = own & F.forall(F.zip_with(F.array(*[F.trim(F.col(f"`{n}`")) for n in plain]), F.array(*[F.lit(n) for n in plain]), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda ok: ok)
    refused = F.when(own & ~same, F.raise_error(F.lit(f"files below {path} have their columns in different orders"))).otherwise(F.lit(False))
    text = F.concat_ws("", *[F.col(f"`{c}`") for c in plain])
    return rows.filter((text != "") & ~same & ~F.coalesce(refused.cast("boolean"), F.lit(False)))


def read_jurisdictions(spark: SparkSession, seeds: str, discovered: str | None = None) -> DataFrame:
    """Seeds over discovered jurisdictions by key; hand-kept entries win."""
    def load(path):
        rows = _json(spark, path, S.JURISDICTION_FILE).select(F.posexplode("jurisdictions").alias("seq", "j"))
        return rows.select("j.*", "seq").withColumn("key", jurisdiction_key("state", "city", "level"))

    base = load(discovered) if discovered else load(seeds).limit(0)
    return override_union(base, load(seeds), ["key"])


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Universe files of all states as rows state, level, name, population."""
    area = "array<struct<name:string,population:bigint>>"
    files = spark.read.schema(f"state string, places {area}, counties {area}").option("multiLine", True).json(path)
    both = F.concat(
        F.transform("places", lambda p: F.struct(F.lit("local").alias("level"), p["name"].alias("name"), p["population"].alias("population"))),
        F.transform("counties", lambda p: F.struct(F.lit("county").alias("level"), p["name"].alias("name"), p["population"].alias("population"))),
    )
    return files.select("state", F.inline(both))


def read_misses(spark: SparkSession, path: str) -> DataFrame:
    """Misses kept in the discovered-jurisdictions file."""
    fields = "city:string,state:string,level:string,population:bigint,checked_at:string,reason:string"
    rows = spark.read.schema(f"misses array<struct<{fields}>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("misses").alias("seq", "m")).select("m.*", "seq").withColumn(
        "key", jurisdiction_key("state", "city", "level")
    )


def read_people(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """People payloads: struct ``person``, the state, and the order in the file."""
    rows = _json(spark, path, S.PEOPLE_FILE).select(F.posexplode("results").alias("seq", "person"))
    found = F.lit(state) if state else F.upper(F.regexp_extract("person.jurisdiction.id", r"state:([a-z]{2})", 1))
    return rows.withColumn("state", found)


def read_legislators(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, S.LEGISLATOR).withColumn("seq", file_order())
    return rows.select(F.col("id.bioguide").alias("bioguide"), F.col("id.wikipedia").alias("wikipedia"), "terms", "seq")


def read_committees(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, S.COMMITTEE).withColumn("seq", file_order())


def read_membership(spark: SparkSession, path: str) -> DataFrame:
    """Committee membership object: committee id -> members, one row per committee.

    The file is one object of a few hundred committees; it is read as text and parsed as a map.
    """
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.from_json("value", S.MEMBERSHIP).alias("m")).select(F.posexplode("m").alias("seq", "committee_id", "members"))


def read_district_offices(spark: SparkSession, path: str) -> DataFrame:
    rows = _json(spark, path, S.DISTRICT_OFFICES).withColumn("seq", file_order())
    return rows.select(F.col("id.bioguide").alias("bioguide"), "offices", "seq")


def read_social_handles(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, S.SOCIAL_HANDLES).select(F.col("id.bioguide").alias("bioguide"), "social")


def read_reps(spark: SparkSession, path: str) -> DataFrame:
    """Federal payload: rows of ``representatives``."""
    from pyspark.sql import types as T

    payload = T.StructType([T.StructField("representatives", T.ArrayType(S.REP))])
    return _json(spark, path, payload).select(F.posexplode("representatives").alias("seq", "r")).select("seq", "r.*")


def jsonl_rows(lines: DataFrame, schema, column: str = "value") -> DataFrame:
    """Parsed JSON lines; lines that do not parse are dropped."""
    good = lines.filter(F.try_parse_json(column).isNotNull() & has(column))
    return good.select(F.from_json(column, schema).alias("_e")).select("_e.*")


def read_jsonl_log(spark: SparkSession, path: str, schema=S.SEARCH_LOG) -> DataFrame:
    return jsonl_rows(spark.read.text(path), schema)


def read_page_fetches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed fetch results; columns a landing does not have are null."""
    if fmt == "json":
        return _json(spark, path, S.PAGE_FETCH, lines=True)
    df = spark.read.format(fmt).load(path)
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.PAGE_FETCH
    ])


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.CACHE_ENTRY).json(path)
