"""Listings of snapshots and groups, the previous snapshot, formats, conflicts.

A snapshot is a row (ns, type, id, time, ...); its files are in manifest_files
(ns, type, id, time, filename, crypt_mode, csum, size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["ns", "type", "id"]


def previous(snapshots: DataFrame) -> DataFrame:
    """Adds prev_time: the newest snapshot of the group strictly before."""
    w = Window.partitionBy(*KEY).orderBy("time")
    times = snapshots.select(*KEY, "time").distinct()
    return times.withColumn("prev_time", F.lag("time").over(w))


def as_of(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """For requests (ns, type, id, at): prev_time, the newest snapshot strictly before at.

    Both sides are unioned and one window per group carries the last snapshot
    forward; requests never meet snapshots pair by pair.
    """
    a = snapshots.select(*KEY, F.col("time").alias("at"), F.lit(1).alias("side"), F.col("time").alias("seen"))
    b = requests.select(*KEY, "at", F.lit(0).alias("side"), F.lit(None).cast("long").alias("seen"))
    w = Window.partitionBy(*KEY).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionByName(b).withColumn("prev_time", F.last("seen", ignorenulls=True).over(w))
    return both.where("side = 0").select(*KEY, "at", "prev_time").distinct()


def latest(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy(*KEY).agg(F.max("time").alias("time"))


def groups(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Per group: last backup, count and the files of the newest."""
    own = files.groupBy(*KEY, "time").agg(F.array_join(F.array_sort(F.collect_set("filename")), ",").alias("files"))  # a handful of files a snapshot
    g = snapshots.select(*KEY, "time").distinct().groupBy(*KEY).agg(F.max("time").alias("time"), F.count("*").alias("n_snapshots"))
    return g.join(own, [*KEY, "time"], "left").withColumnRenamed("time", "last_backup")


def formats(files: DataFrame) -> DataFrame:
    """Per snapshot: 'v1', 'v2' (both streams), or none; and whether any file is encrypted."""
    has = lambda x: F.bool_or(F.endswith("filename", F.lit(x)))
    agg = files.groupBy(*KEY, "time").agg(F.bool_or(F.endswith("filename", F.lit(".pxar.didx"))).alias("one"), has(".mpxar.didx").alias("meta"), has(".ppxar.didx").alias("payload"), F.bool_or(F.col("crypt_mode") == "encrypt").alias("encrypted"))
    return agg.select(*KEY, "time", F.when(F.col("one"), "v1").when(F.col("meta") & F.col("payload"), "v2").otherwise("none").alias("format"), "encrypted")


def conflicts(snapshots: DataFrame) -> DataFrame:
    """Snapshots committed more than once under one key."""
    return snapshots.groupBy(*KEY, "time").agg(F.count("*").alias("n")).where("n > 1")


def namespaces(snapshots: DataFrame, parent: str = "") -> DataFrame:
    """Direct children of a namespace, itself left out."""
    prefix = parent + "/" if parent else ""
    below = snapshots.where(F.startswith("ns", F.lit(prefix)) & (F.col("ns") != parent))
    return below.select(F.concat(F.lit(prefix), F.split(F.substring("ns", len(prefix) + 1, 1 << 20), "/")[0]).alias("ns")).distinct()


def matching(snapshots: DataFrame, kind: str | None = None, name: str | None = None) -> DataFrame:
    """A listing without what a server sends beside the type and id asked for; None asks for all."""
    out = snapshots
    for column, value in (("type", kind), ("id", name)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def newest_first(snapshots: DataFrame, tie: str = "time") -> DataFrame:
    """Adds place, from 1, in the group's listing: the newest first, equal times in the order of tie."""
    return snapshots.withColumn("place", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("time"), tie)))


def in_listing_order(groups: DataFrame) -> DataFrame:
    """Adds place, from 1, in the namespace's listing of its groups (type, id)."""
    own = groups.select(*KEY).distinct()
    return own.withColumn("place", F.row_number().over(Window.partitionBy("ns").orderBy("type", "id")))


def open_at_commit(indexes: DataFrame) -> DataFrame:
    """Snapshots that may not be committed: n indexes of theirs (closed) are still open."""
    return indexes.groupBy(*KEY, "time").agg(F.sum((~F.col("closed")).cast("long")).alias("n")).where("n > 0")


def authorised(wanted: DataFrame, opened: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds allowed to chunks asked for (session, digest): only chunks of indexes the session has opened (session, stream_id)."""
    may = opened.join(entries.select("stream_id", "digest").distinct(), "stream_id").select("session", "digest").distinct().withColumn("allowed", F.lit(True))
    return wanted.join(may, ["session", "digest"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
