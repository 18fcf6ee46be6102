"""A datastore: a folder of Parquet tables with snapshots as the commit point.

chunk_store is laid out by the first byte of the digest, so that a look-up reads
one 256th. Every attempt to commit writes its rows under a number of its own;
they count once the snapshot's row, which is written last, bears that number. A
commit that failed half-way and is tried again so leaves no trace in any result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking
from ..operators import dedup
from .staging import staged

KEY = ("ns", "type", "id", "time")
Ref = tuple[str, str, str, int]
_REF = "ns string, type string, id string, time long, "
SCHEMAS = {
    "snapshots": _REF + "notes string, attempt string",
    "manifest_files": _REF + "filename string, crypt_mode string, csum string, size long, attempt string",
    "index_entries": _REF + "stream_id string, seq long, offset long, end_offset long, size long, digest string, attempt string",
    "upload_stats": _REF + "stream_id string, size long, chunk_count long, new_chunks long, new_bytes long, reused_chunks long, attempt string",
    "streams": _REF + "stream_id string, meta string, attempt string",
    "chunk_store": "digest string, size long, data binary, shard string, attempt string",
}


def is_ref(ref: Ref) -> Column:
    out = F.lit(True)
    for k, v in zip(KEY, ref):
        out = out & (F.col(k) == F.lit(v))
    return out


class Datastore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def written(self, name: str) -> DataFrame:
        """All rows of a table, also those of attempts that failed."""
        at = f"{self.path}/{name}"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(at)

    def table(self, name: str) -> DataFrame:
        """The rows that count."""
        if name == "snapshots":
            return self.written(name)
        return self.written(name).join(self.written("snapshots").select("attempt"), "attempt", "left_semi")

    def append(self, name: str, df: DataFrame) -> None:
        columns = [x.split()[0] for x in SCHEMAS[name].split(", ")]
        out = df.select(*columns).write.mode("append")
        (out.partitionBy("shard") if name == "chunk_store" else out).parquet(f"{self.path}/{name}")

    def snapshots(self) -> DataFrame:
        return self.table("snapshots")

    def entries(self, ref: Ref) -> DataFrame:
        return self.table("index_entries").where(is_ref(ref))

    def previous(self, ns: str, kind: str, name: str, before: int) -> tuple | None:
        """The newest snapshot strictly before, or none."""
        own = self.snapshots().where((F.col("ns") == ns) & (F.col("type") == kind) & (F.col("id") == name) & (F.col("time") < before))
        at = own.agg(F.max("time").alias("t")).first()["t"]
        return None if at is None else (ns, kind, name, at)

    def commit(self, ref: Ref, chunks: DataFrame, notes: str = "", reused: DataFrame | None = None, streams: DataFrame | None = None) -> DataFrame:
        """Store a snapshot's chunks (CHUNKS with data) and its indexes; returns its statistics.

        reused: entries (CHUNKS) that an earlier snapshot has stored; streams:
        stream_id, meta of all streams, for change detection. Only chunks that
        neither the store nor this snapshot has are written; the snapshot's row
        comes last. A second commit of one key is refused.
        """
        if not self.snapshots().where(is_ref(ref)).isEmpty():
            raise ValueError(f"snapshot exists: {ref}")
        attempt = uuid.uuid4().hex
        key = {k: F.lit(v).cast("long" if k == "time" else "string") for k, v in zip(KEY, ref)} | {"attempt": F.lit(attempt)}
        marked = staged(dedup.mark_new(chunks, self.table("chunk_store").select("digest")), "marked")
        every = marked.drop("data")
        if reused is not None:
            every = every.unionByName(reused.select(*chunks.drop("data").columns).withColumn("is_new", F.lit(False)))
        sums = dedup.index_checksum(every.select("stream_id", "seq", "end_offset", "digest"))
        files = sums.select(F.concat("stream_id", F.lit(".didx")).alias("filename"), F.lit("none").alias("crypt_mode"), F.col("checksum").alias("csum"), "size")
        self.append("upload_stats", dedup.upload_stats(every).withColumns(key))
        self.append("index_entries", every.withColumns(key))
        self.append("manifest_files", files.withColumns(key))
        if streams is not None:
            self.append("streams", streams.withColumns(key))
        self.append("chunk_store", marked.where("is_new").withColumn("shard", F.substring("digest", 1, 2)).withColumns(key))
        self.append("snapshots", self.spark.createDataFrame([(*ref, notes, attempt)], SCHEMAS["snapshots"]))
        return self.table("upload_stats").where(is_ref(ref)).drop("attempt")

    def snapshot(self, ref: Ref, streams: DataFrame, avg: int = 4096, notes: str = "") -> DataFrame:
        """Commit streams (stream_id, data, meta): those whose meta is as in the previous snapshot keep its entries.

        Only the others are read, cut and hashed.
        """
        before = self.previous(*ref)
        own = streams.select("stream_id", "meta")
        if before is None:
            return self.commit(ref, chunking.chunk_streams(streams, avg, with_data=True), notes, None, own)
        old = self.table("streams").where(is_ref(before)).select("stream_id", F.col("meta").alias("_meta"))
        same = own.join(old, "stream_id").where(F.col("meta") == F.col("_meta")).select("stream_id")
        changed = streams.join(same, "stream_id", "left_anti")
        reused = self.entries(before).join(same, "stream_id", "left_semi")
        return self.commit(ref, chunking.chunk_streams(changed, avg, with_data=True), notes, reused, own)

    def read_stream(self, ref: Ref, stream_id: str) -> DataFrame:
        """seq, data of a stream's chunks; sort by seq to read it."""
        own = self.entries(ref).where(F.col("stream_id") == stream_id)
        store = self.table("chunk_store").select("digest", "data").dropDuplicates(["digest"])
        return own.join(store, "digest").select("seq", "offset", "data")
