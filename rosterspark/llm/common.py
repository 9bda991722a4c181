"""Shared helpers: staged tables, connected components, tiles of bounded size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session gets one of its own; a cluster must set it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + _OWN_FOLDERS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="staged-"))


class Scratch:
    """Tables of one job, written as Parquet below the shared folder.

    A written table cuts the lineage: a lost executor costs only the tasks of the step that runs. Tables go as soon as a
    later one replaces them; what the frame that a job returns reads stays until the folder is cleared.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self._count = 0
        self._paths: list[str] = []

    def path(self, name: str) -> str:
        self._count += 1
        self._paths.append(f"{self.folder}/{self._count:03d}-{name}")
        return self._paths[-1]

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        self._remove([t.staged_path for t in tables])

    def keep_only(self, *tables: DataFrame) -> None:
        """Drop all others: what is kept was written from them and needs them no more."""
        kept = {t.staged_path for t in tables}
        self._remove([p for p in self._paths if p not in kept])

    def _remove(self, paths: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for text in paths:
            path = jvm.org.apache.hadoop.fs.Path(text)
            path.getFileSystem(conf).delete(path, True)
            self._paths.remove(text)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of undirected edges ``a, b`` (long): rows ``node, root`` with the smallest node as root.

    Alternates two steps until nothing changes: every node hands the smallest node it sees to its larger neighbours,
    then to its smaller ones. Each step is an aggregation by node (combined before the shuffle) and a join, so a hub
    with very many neighbours is never gathered; the driver sees two numbers a round. Nodes without edges give no row.
    """
    a, b = F.col("a"), F.col("b")
    now = scratch.table(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(a, F.min(b)).alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min(b).alias("m"))
        small = large.join(low, "a")
        after = small.select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        after = after.unionByName(low.select("a", F.col("m").alias("b"))).where(a != b).distinct()
        after = scratch.table(after, "edges")
        scratch.drop(now)
        now, before, seen = after, seen, _fingerprint(after)
        if seen == before:
            break
    return now.select(a.alias("node"), b.alias("root")).unionByName(now.select(b.alias("node"), b.alias("root")).distinct())


def tiles(members: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Deal the members of clusters into tiles, so that two members of a cluster in the same or neighbouring bands meet.

    ``members``: cluster long, node long, band int, weight long (at least 1). Small clusters share tiles of about
    ``limit`` weight. A larger one is cut, band by band, into blocks of about half of that by the node's hash; each pair
    of blocks of the same or neighbouring bands is a tile. Returns tile string, cluster, node, block string (null in
    shared tiles). A pair that meets in a tile of two different blocks meets only there.
    """
    total = members.agg(F.sum("weight")).first()[0] or 0
    shares = max(1, -(-int(total) // limit))
    sizes = members.groupBy("cluster").agg(F.sum("weight").alias("cluster_weight"))
    rows = members.join(sizes, "cluster")
    small = rows.where(F.col("cluster_weight") <= limit).select(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(shares)).cast("string")).alias("tile"), "cluster", "node", F.lit(None).cast("string").alias("block"),
    )
    large = rows.where(F.col("cluster_weight") > limit)
    bands = large.groupBy("cluster", "band").agg(F.ceil(F.sum("weight") / F.lit(limit / 2)).cast("int").alias("blocks"))
    bands = scratch.table(bands, "bands")
    near = bands.select("cluster", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("other"), F.col("blocks").alias("other_blocks"))
    plan = bands.join(near, ["cluster", "band"])
    name = lambda band, block: F.concat_ws(":", F.lpad(band.cast("string"), 6, "0"), F.lpad(block.cast("string"), 9, "0"))
    dealt = (
        large.join(plan, ["cluster", "band"])
        .withColumn("block", name(F.col("band"), F.pmod(F.xxhash64("node"), F.col("blocks"))))
        .withColumn("other", F.explode(F.transform(F.sequence(F.lit(0), F.col("other_blocks") - 1), lambda i: name(F.col("other"), i))))
        .select(F.concat_ws("|", F.col("cluster").cast("string"), F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "cluster", "node", "block")
    )
    return small.unionByName(dealt)


def first_of(df: DataFrame, group: list[str], order: list[Column], k: int, spread: str, number: str = "nth") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1. First among the rows of a share by ``spread``, so that no task sorts all of a group."""
    shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    near = df.withColumn("share", F.pmod(F.xxhash64(spread), F.lit(shares))).withColumn(number, place(*group, "share")).where(F.col(number) <= k)
    return near.drop("share", number).withColumn(number, place(*group)).where(F.col(number) <= k)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
