"""Chunk dedup, upload statistics and indexes.

Chunks are rows (stream_id, seq, offset, end_offset, size, digest). Of the
places where a digest is new, the first in (stream, seq) order is the one that
is stored; which concurrent stream wins is thereby fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_new(chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds is_new: first here, and its digest not among known (digest).

    The first place of a digest comes from an aggregate that combines before
    the shuffle; a very common chunk is one row per task there, and the join
    that follows can be split where it is skewed.
    """
    first = chunks.groupBy("digest").agg(F.min(F.struct("stream_id", "seq")).alias("_first"))
    if known is not None:
        first = first.join(known.select("digest").distinct(), "digest", "left_anti")
    own = F.struct("stream_id", "seq")
    return chunks.join(first, "digest", "left").withColumn("is_new", F.coalesce(F.col("_first") == own, F.lit(False))).drop("_first")


def upload_stats(marked: DataFrame) -> DataFrame:
    """Per stream: size, chunk_count, new_chunks, new_bytes, reused_chunks."""
    new = F.col("is_new").cast("long")
    return marked.groupBy("stream_id").agg(F.max("end_offset").alias("size"), F.count("*").alias("chunk_count"), F.sum(new).alias("new_chunks"), F.sum(new * F.col("size")).alias("new_bytes"), F.sum(1 - new).alias("reused_chunks"))


def little_endian(value: Column) -> Column:
    """16 hex digits of a non-negative number as a little-endian u64."""
    big = F.lpad(F.lower(F.hex(value)), 16, "0")
    return F.concat(*(F.substring(big, i, 2) for i in range(15, 0, -2)))


def index_checksum(entries: DataFrame, by: str = "stream_id") -> DataFrame:
    """SHA-256 over the ordered (end offset, digest) records of each index.

    A hash over ordered records is one sequence by nature: 80 hex digits a
    chunk are gathered for each stream.
    """
    rec = F.struct("seq", F.concat(little_endian(F.col("end_offset")), F.col("digest")).alias("r"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(rec)), lambda x: x["r"]), "")
    return entries.groupBy(by).agg(F.sha2(F.unhex(whole), 256).alias("checksum"), F.count("*").alias("n_entries"), F.max("end_offset").alias("size"))


def batches(entries: DataFrame, size: int = 128) -> DataFrame:
    """The append requests of each stream: at most size entries each."""
    return entries.groupBy("stream_id", F.floor(F.col("seq") / size).alias("batch")).agg(F.count("*").alias("n_entries"), F.min("offset").alias("first_offset"), F.max("end_offset").alias("end_offset"))


def progress(chunks: DataFrame) -> DataFrame:
    """Running bytes of each stream after each chunk, and whether it is the last."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    return chunks.select("stream_id", "seq", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("done_bytes"), (F.lead("seq").over(w).isNull()).alias("done"))


def starts(entries: DataFrame) -> DataFrame:
    """Adds start: the previous end; and ascending: whether ends ascend strictly."""
    before = F.lag("end_offset", 1, 0).over(Window.partitionBy("stream_id").orderBy("seq"))
    return entries.withColumn("start", before).withColumn("ascending", F.col("end_offset") > F.col("start"))


def stored(chunks: DataFrame) -> DataFrame:
    """How many distinct chunks a store holds and how large they are."""
    return chunks.groupBy("digest").agg(F.max("size").alias("size")).agg(F.count("*").alias("n_chunks"), F.sum("size").alias("n_bytes"))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """digest, size of chunks that two indexes share."""
    return a.select("digest", "size").distinct().join(b.select("digest").distinct(), "digest", "left_semi")


def known_set(*indexes: DataFrame) -> DataFrame:
    out = indexes[0].select("digest")
    for x in indexes[1:]:
        out = out.unionByName(x.select("digest"))
    return out.distinct()


def inject(frames: DataFrame, data_chunks: DataFrame) -> DataFrame:
    """One index from frames: data segments chunked apart, injected chunks as they are.

    frames: stream_id, frame, kind, inject array<struct<digest,size>>;
    data_chunks: stream_id, frame, seq, size, digest. A frame of injected chunks
    ends the data segment before it. Offsets are running sums.
    """
    injected = frames.where("kind = 'inject'").select("stream_id", "frame", F.posexplode("inject").alias("seq", "c")).select("stream_id", "frame", "seq", "c.digest", "c.size", F.lit(True).alias("injected"))
    rows = injected.unionByName(data_chunks.select("stream_id", "frame", "seq", "digest", "size", F.lit(False).alias("injected")))
    w = Window.partitionBy("stream_id").orderBy("frame", "seq")
    end = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("stream_id", (F.row_number().over(w) - 1).alias("seq"), (end - F.col("size")).alias("offset"), end.alias("end_offset"), "size", "digest", "injected")
