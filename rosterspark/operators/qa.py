"""Drift between stored and freshly extracted records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterspark.functions.text import has, trim


def group_by_source(records: DataFrame, url: str = "source_url") -> DataFrame:
    """Records per source page; rows without a page are skipped."""
    return records.filter(has(url)).groupBy(url).agg(F.count(F.lit(1)).alias("records"))


def name_changes(stored: DataFrame, fresh: DataFrame, group: str = "source_url", name: str = "name") -> DataFrame:
    """One row per name only one side has: group, name, change ('missing' or 'new').

    Both sides are stacked and counted per (group, name), so no group is gathered anywhere and no
    join is needed.
    """
    def side(df, s, f):
        return df.select(F.col(group).alias(group), F.lower(trim(name)).alias("name"), F.lit(s).alias("_s"), F.lit(f).alias("_f"))

    both = side(stored, 1, 0).unionByName(side(fresh, 0, 1)).groupBy(group, "name").agg(F.max("_s").alias("_s"), F.max("_f").alias("_f"))
    change = F.when(F.col("_f") == 0, F.lit("missing")).when(F.col("_s") == 0, F.lit("new"))
    return both.withColumn("change", change).filter("change is not null").drop("_s", "_f")


def qa_diff(stored: DataFrame, fresh: DataFrame, group: str = "source_url", name: str = "name") -> DataFrame:
    """Per page that disagrees: record counts and the number of missing and new names.

    The names themselves are the rows of ``name_changes``.
    """
    def side(df, s):
        return df.select(F.col(group).alias(group), F.lower(trim(name)).alias("name"), F.lit(s).alias("_s"))

    per_name = side(stored, 0).unionByName(side(fresh, 1)).groupBy(group, "name").agg(
        F.count_if(F.col("_s") == 0).alias("_stored"), F.count_if(F.col("_s") == 1).alias("_fresh")
    )
    counts = per_name.groupBy(group).agg(
        F.sum("_stored").alias("stored_count"), F.sum("_fresh").alias("fresh_count"),
        F.count_if(F.col("_fresh") == 0).alias("missing_from_fresh"), F.count_if(F.col("_stored") == 0).alias("new_in_fresh"),
    )
    return counts.filter("missing_from_fresh > 0 or new_in_fresh > 0")


def qa_lists(stored: DataFrame, fresh: DataFrame, group: str = "source_url", name: str = "name") -> DataFrame:
    """``qa_diff`` with the names as sorted lists, for pages of a review sample."""
    changes = name_changes(stored, fresh, group, name).groupBy(group).agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("change") == kind, F.col("name")))).alias(out)
            for kind, out in (("missing", "missing_names"), ("new", "new_names"))
        ]
    )
    return qa_diff(stored, fresh, group, name).join(changes, group)
