"""How the driver's tables play the engine's roles: trees, snapshots, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import layout, tree
from ..sources.staging import staged

BLOCK = 512
T0 = 1_700_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, snapshot: int = 1) -> DataFrame:
    """doc_id, text, dir, path, mtime_secs of a snapshot of the documents; the second has losses and changes."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"))
    mtime = T0 + F.col("doc_id") * 60
    text = F.col("text")
    if snapshot == 2:
        d = d.where("doc_id % 29 <> 0")
        mtime = mtime + F.when(F.col("doc_id") % 17 == 0, 7).otherwise(0)
        text = F.when(F.col("doc_id") % 13 == 0, F.concat(text, F.lit(" changed"))).otherwise(text)
    folder = F.concat_ws("/", "source", "lang")
    return d.select("doc_id", text.alias("text"), "lang", folder.alias("dir"), F.concat(folder, F.lit("/d"), "doc_id", F.lit(".txt")).alias("path"), mtime.alias("mtime_secs"))


def nodes(spark: SparkSession, sf_dir: str, snapshot: int = 1, links: bool = True) -> DataFrame:
    """The documents as a tree: exact copies are hardlinks of one inode (without links, files of it). A node table is written once and then used."""
    d = documents(spark, sf_dir, snapshot).withColumn("h", F.sha2("text", 256)).withColumn("text", F.octet_length("text").cast("long"))
    inode = d.groupBy("h").agg(F.min("doc_id").alias("ino"), F.count("*").alias("nlink"))
    none = F.lit(None)
    # the second snapshot has changes that leave every size as it was
    later = lambda k, old, new: F.when(F.lit(snapshot == 2) & (F.col("doc_id") % k == 0), new).otherwise(old)
    value = later(35, F.col("lang"), F.upper("lang"))
    xattrs = F.when(F.col("doc_id") % 7 == 0, F.array(F.struct(F.lit("user.lang").alias("name"), F.encode(value, "utf-8").alias("value"))))
    nanos = later(31, F.lit(0), F.lit(5))
    ids = F.array(F.struct(F.lit(1).cast("long").alias("id"), later(33, F.lit(4), F.lit(6)).cast("long").alias("perm")))
    no_ids = F.array().cast("array<struct<id:bigint,perm:bigint>>")
    acl = F.when(F.col("doc_id") % 11 == 0, F.struct(ids.alias("users"), no_ids.alias("groups"), F.lit(4).cast("long").alias("group_obj"), none.cast("bigint").alias("default"), no_ids.alias("default_users"), no_ids.alias("default_groups")))
    mode, uid, gid = F.when(F.col("doc_id") % 5 == 0, 33152).otherwise(33188).cast("long"), F.col("doc_id") % 3, F.col("doc_id") % 4
    files = d.join(inode, "h").select(
        "path", F.lit("file").alias("kind"), mode.alias("mode"), uid.alias("uid"), gid.alias("gid"),
        names.metadata_key(mode, uid, gid, F.col("mtime_secs"), nanos, xattrs, acl, none.cast("binary"), F.lit(0)).alias("meta"),
        "mtime_secs", F.col("text").alias("size"), F.lit(1).cast("long").alias("dev"), "ino", "nlink",
        names.metadata_size(xattrs, acl, none.cast("binary"), F.lit(0)).cast("long").alias("meta_size"),
    )
    files = staged(files, "files")
    long = lambda x: F.lit(x).cast("long")
    folders = tree.with_directories(files).select("path", "kind", long(16877).alias("mode"), long(0).alias("uid"), long(0).alias("gid"), long(T0).alias("mtime_secs"), long(0).alias("size"), long(1).alias("dev"), long(-1).alias("ino"), long(1).alias("nlink"), long(names.ENTRY).alias("meta_size"), none.cast("string").alias("meta"))
    both = files.unionByName(folders)
    return staged(tree.hardlink_targets(both), "nodes") if links else both


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second tree from the pages' addresses: path, kind, page_id."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), r"^[a-z]+://", ""), r"/+\z", "").alias("path"))
    return p.where("path <> ''").withColumn("kind", F.when(F.col("page_id") % 10 == 0, "directory").otherwise("file"))


def chunks(spark: SparkSession, sf_dir: str, snapshot: int = 1, with_data: bool = False) -> DataFrame:
    """The documents' UTF-8 bytes cut into blocks of BLOCK; one stream each. with_data: each with its bytes."""
    d = documents(spark, sf_dir, snapshot).where("text <> ''").select(F.concat(F.lit("d"), "doc_id").alias("stream_id"), F.encode("text", "utf-8").alias("data"), F.octet_length("text").cast("long").alias("n"))
    rows = d.withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    offset = F.col("seq") * BLOCK
    end = F.least(F.col("n"), offset + BLOCK)
    data = F.substring("data", (offset + 1).cast("int"), F.lit(BLOCK))
    return rows.select("stream_id", "seq", offset.alias("offset"), end.alias("end_offset"), (end - offset).alias("size"), F.sha2(data, 256).alias("digest"), *([data.alias("data")] if with_data else []))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as snapshots: ns, type, id, time, notes, event_id."""
    e = table(spark, sf_dir, "events")
    at = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    kind = F.element_at(F.array(F.lit("host"), F.lit("vm"), F.lit("ct")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select("event_type", "user_id", "event_id", "value", F.col("event_type").alias("ns"), kind.alias("type"), F.concat(F.lit("u"), F.col("user_id") % 50).alias("id"), at.alias("time"))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots(spark, sf_dir)
    k = F.col("event_id") % 4
    name = F.when(k == 0, "root.pxar.didx").when(k == 1, "root.mpxar.didx").when(k == 2, "root.ppxar.didx").otherwise("conf.blob")
    mode = F.when(F.col("event_id") % 5 == 0, "encrypt").otherwise("none")
    # snapshots of one day and group share a manifest
    return s.select("ns", "type", "id", F.floor(F.col("time") / 86400).alias("time"), name.alias("filename"), mode.alias("crypt_mode"))


def payload(files: DataFrame) -> DataFrame:
    """path, dir, meta, size, payload_offset of a tree's files in walk order."""
    placed = layout.payload_offsets(files.where("kind = 'file'"), tree.walk_key(F.col("path")))
    return placed.select("path", "meta", "size", "payload_offset")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' sources as blobs: page_id, filename, encoded."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat(F.lit("page"), "page_id", F.lit(".blob")).alias("filename"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("encoded"))
