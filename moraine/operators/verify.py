"""Checks of indexes, chunks and manifests; every finding is a row."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dedup, layout


def dangling(entries: DataFrame, store: DataFrame) -> DataFrame:
    """Index entries whose chunk is not in the store."""
    return entries.join(store.select("digest"), "digest", "left_anti").select("stream_id", "seq", "digest")


def tampered(store: DataFrame) -> DataFrame:
    """Stored chunks (digest, size, data) whose bytes do not match."""
    size, digest = F.octet_length("data"), F.sha2("data", 256)
    return store.where((size != F.col("size")) | (digest != F.col("digest"))).select("digest", F.when(size != F.col("size"), "size").otherwise("digest").alias("problem"))


def tiling(entries: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Per stream: whether the chunks tile it and keep the bounds (the last may be short)."""
    rows = dedup.starts(entries)
    end = rows.groupBy("stream_id").agg(F.max("end_offset").alias("end"))
    inside = (F.col("size") >= least) | (F.col("end_offset") == F.col("end"))
    inside = inside & (F.col("size") <= most) if most else inside
    tiles = (F.col("offset") == F.col("start")) & (F.col("end_offset") - F.col("offset") == F.col("size")) & F.col("ascending")
    return rows.join(end, "stream_id").groupBy("stream_id").agg(F.bool_and(tiles).alias("tiles"), F.bool_and(inside).alias("in_bounds"), F.count("*").alias("n_chunks"))


def verify(entries: DataFrame, manifest: DataFrame, store: DataFrame) -> DataFrame:
    """check, subject, ok for every index: in the manifest, checksum, size, order, chunks present and of the right size.

    entries: stream_id, seq, offset, end_offset, size, digest; manifest: stream_id,
    csum, size; store: digest, size.
    """
    seen = dedup.index_checksum(entries).select("stream_id", "checksum", F.col("size").alias("end"))
    both = manifest.join(seen, "stream_id", "full")
    made = [both.select(F.lit("listed").alias("check"), F.col("stream_id").alias("subject"), (F.col("csum").isNotNull() & F.col("checksum").isNotNull()).alias("ok"))]
    made.append(both.select(F.lit("checksum").alias("check"), F.col("stream_id").alias("subject"), F.coalesce(F.col("csum") == F.col("checksum"), F.lit(False)).alias("ok")))
    made.append(both.select(F.lit("size").alias("check"), F.col("stream_id").alias("subject"), F.coalesce(F.col("size") == F.col("end"), F.lit(False)).alias("ok")))
    ordered = dedup.starts(entries).groupBy("stream_id").agg(F.bool_and("ascending").alias("ok"))
    made.append(ordered.select(F.lit("ascending").alias("check"), F.col("stream_id").alias("subject"), "ok"))
    held = entries.join(store.select("digest", F.col("size").alias("_size")).dropDuplicates(["digest"]), "digest", "left")
    made.append(held.groupBy("stream_id").agg(F.bool_and(F.coalesce(F.col("_size") == F.col("size"), F.lit(False))).alias("ok")).select(F.lit("chunks").alias("check"), F.col("stream_id").alias("subject"), "ok"))
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    return out


def blob_records(blobs: DataFrame) -> DataFrame:
    """What a manifest notes of uploaded blobs (key columns, encoded): size and SHA-256 of the encoded bytes."""
    return blobs.withColumn("size", F.octet_length("encoded").cast("long")).withColumn("csum", F.sha2("encoded", 256)).drop("encoded")


def blobs(held: DataFrame, manifest: DataFrame, *key: str) -> DataFrame:
    """key, problem (missing, unlisted, size, checksum) of blobs (key, encoded) that differ from the manifest (key, size, csum)."""
    seen = blob_records(held).withColumnRenamed("size", "_size").withColumnRenamed("csum", "_csum")
    both = manifest.join(seen, list(key), "full")
    problem = F.when(F.col("_size").isNull(), "missing").when(F.col("size").isNull(), "unlisted").when(F.col("_size") != F.col("size"), "size").when(F.col("_csum") != F.col("csum"), "checksum")
    return both.select(*key, problem.alias("problem")).where("problem is not null")


def identity(manifests: DataFrame) -> DataFrame:
    """Adds same: whether the manifest found under a snapshot's key (type, id, time) names that snapshot (m_type, m_id, m_time)."""
    same = F.lit(True)
    for c in ("type", "id", "time"):
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    return manifests.withColumn("same", same)


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Hex HMAC-SHA-256 of text under a key known to the driver, by Spark's own digest."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "utf-8")), 256))), 256)


def signatures(manifests: DataFrame, key: bytes, fingerprint: str) -> DataFrame:
    """Adds verdict to manifests (canonical, signature, key_fingerprint): ok, unsigned, other key, bad signature."""
    verdict = F.when(F.col("signature").isNull(), "unsigned").when(F.col("key_fingerprint").isNotNull() & (F.col("key_fingerprint") != fingerprint), "other key").when(F.col("signature") != hmac_sha256(F.col("canonical"), key), "bad signature").otherwise("ok")
    return manifests.withColumn("verdict", verdict)


def chunk_bytes(entries: DataFrame, store: DataFrame) -> DataFrame:
    """stream_id, seq, problem of index entries whose chunk in the store (digest, data) is missing or has other bytes."""
    seen = store.select("digest", F.octet_length("data").cast("long").alias("_size"), F.sha2("data", 256).alias("_digest")).dropDuplicates(["digest"])
    both = entries.join(seen, "digest", "left")
    problem = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("size"), "size").when(F.col("_digest") != F.col("digest"), "digest")
    return both.select("stream_id", "seq", problem.alias("problem")).where("problem is not null")


def estimate_holds(nodes: DataFrame, version: int = 1) -> DataFrame:
    """One row: the estimate, where the last record ends, whether they agree."""
    end = layout.positions(nodes, version).agg(F.max(F.col("start") + F.col("bytes")).alias("end"))
    name = "archive_bytes" if version == 1 else "meta_bytes"
    said = layout.estimate(nodes, version).select(F.col(name).alias("estimate"))
    return said.crossJoin(end).withColumn("ok", F.col("estimate") == F.col("end"))  # one row and one row
