"""Archive layout as running sums: where every record of a tree begins.

A node opens with its name, metadata and body; a directory closes with its
table of children. Events in walk order (a directory's close after all below
it) and their sizes give all positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .tree import numbered


def body_size(version: int) -> Column:
    """Bytes after a node's metadata."""
    payload = F.lit(names.PAYLOAD_REF).cast("long") if version == 2 else names.HEADER + F.col("size")
    return F.when(F.col("kind") == "file", payload).when(F.col("kind") == "symlink", names.string_size(F.col("link_target"))).when(F.col("kind").isin("block", "char"), names.DEVICE).otherwise(0)


def open_size(version: int) -> Column:
    named = F.when(F.col("path") == "", 0).otherwise(names.string_size(names.basename(F.col("path"))))
    return named + F.when(F.col("kind") == "hardlink", names.hardlink_size(F.col("link_target"))).otherwise(F.col("meta_size") + body_size(version))


def with_children(nodes: DataFrame) -> DataFrame:
    """Adds n_children to directories."""
    n = nodes.where("path <> ''").groupBy(names.parent(F.col("path")).alias("path")).agg(F.count("*").alias("n_children"))
    return nodes.join(n, "path", "left").withColumn("n_children", F.when(F.col("kind") == "directory", F.coalesce("n_children", F.lit(0))))


def events(nodes: DataFrame, version: int) -> DataFrame:
    """path, phase (0 open, 1 close), key, bytes."""
    rows = with_children(nodes)
    key = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.transform(F.split("path", "/"), lambda c: F.concat(F.lit("0"), c)))
    opened = rows.select("path", "kind", "size", "link_target", F.lit(0).alias("phase"), key.alias("key"), open_size(version).cast("long").alias("bytes"))
    closed = rows.where("kind = 'directory'").select("path", "kind", "size", "link_target", F.lit(1).alias("phase"), F.concat(key, F.array(F.lit("1"))).alias("key"), names.goodbye_size(F.col("n_children")).cast("long").alias("bytes"))
    return opened.unionByName(closed)


def positions(nodes: DataFrame, version: int = 1) -> DataFrame:
    """path, phase, start, bytes of every event; version 2 begins with a version record."""
    placed = numbered(events(nodes, version), F.col("key"), F.col("bytes"), "start")
    lead = names.FORMAT_VERSION if version == 2 else 0
    return placed.select("path", "kind", "size", "link_target", "phase", (F.col("start") + lead).alias("start"), "bytes")


def spans(nodes: DataFrame, version: int = 1) -> DataFrame:
    """path, start, length of each directory's items as its parent's table has them."""
    at = positions(nodes, version)
    whole = at.groupBy("path").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("bytes")).alias("end"), F.max(F.when((F.col("kind") == "file") & F.lit(version == 2), F.col("size")).otherwise(0)).alias("extra"))
    return whole.select("path", "start", (F.col("end") - F.col("start") + F.col("extra")).alias("length"))


def hardlink_offsets(nodes: DataFrame, version: int = 1) -> DataFrame:
    """path, link_target, distance back to the target's start; null for a target that comes later."""
    at = positions(nodes, version).where("phase = 0").select("path", "kind", "link_target", "start")
    target = at.select(F.col("path").alias("link_target"), F.col("start").alias("target_start"))
    back = F.col("start") - F.col("target_start")
    return at.where("kind = 'hardlink'").join(target, "link_target", "left").select("path", "link_target", F.when(back > 0, back).alias("distance"))


def payload_offsets(files: DataFrame, key: Column) -> DataFrame:
    """Adds payload_offset: 16 + the headers and contents of earlier files."""
    placed = numbered(files, key, names.HEADER + F.col("size"), "payload_offset")
    return placed.withColumn("payload_offset", F.col("payload_offset") + names.MARKER)


def estimate(nodes: DataFrame, version: int = 1) -> DataFrame:
    """The archive's bytes, without walking it; version 2: metadata and payload."""
    e = events(nodes, version)
    if version == 1:
        return e.agg(F.sum("bytes").alias("archive_bytes"))
    content = F.sum(F.when((F.col("kind") == "file") & (F.col("phase") == 0), names.HEADER + F.col("size")).otherwise(0))
    return e.agg((F.sum("bytes") + names.FORMAT_VERSION).alias("meta_bytes"), (content + 2 * names.MARKER).alias("payload_bytes"))


def subtree_sizes(nodes: DataFrame) -> DataFrame:
    """path, n_files, bytes of the content below each directory."""
    from ..functions.patterns import ancestors

    up = nodes.where("kind = 'file'").select("size", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("path"))
    return up.groupBy("path").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def directory_items(nodes: DataFrame, version: int = 1) -> DataFrame:
    """path, name, start, length: what each directory's table says of its children, start from the directory's own."""
    at = spans(nodes, version)
    own = at.select(F.col("path").alias("up"), F.col("start").alias("dir_start"))
    below = at.where("path <> ''").withColumn("up", names.parent(F.col("path")))
    return below.join(own, "up").select(F.col("up").alias("path"), names.basename(F.col("path")).alias("name"), (F.col("start") - F.col("dir_start")).alias("start"), "length")


def inside(nodes: DataFrame) -> DataFrame:
    """path, n_children, ok of each directory with children: whether all of them lie inside it."""
    at = spans(nodes, 1)
    own = at.select(F.col("path").alias("up"), F.col("start").alias("a"), (F.col("start") + F.col("length")).alias("b"))
    met = at.where("path <> ''").withColumn("up", names.parent(F.col("path"))).join(own, "up")
    fits = (F.col("start") > F.col("a")) & (F.col("start") + F.col("length") < F.col("b"))
    return met.groupBy(F.col("up").alias("path")).agg(F.count("*").alias("n_children"), F.bool_and(fits).alias("ok"))
