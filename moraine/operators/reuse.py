"""Which unchanged files can be taken from the previous snapshot's payload.

cur: path, meta (digest of all metadata), size, in walk order (tree.in_order);
prev: path, meta, size, payload_offset; chunks: seq, start_offset, end_offset of
the previous payload. Runs and offsets go over the whole walk, whatever the
directories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import before, running

HEADER = 16
THRESHOLD = 0.1


def changed_files(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Adds unchanged and the previous offset; size and all metadata must agree."""
    old = prev.select("path", F.col("meta").alias("_meta"), F.col("size").alias("_size"), "payload_offset")
    both = cur.join(old, "path", "left")
    same = F.coalesce((F.col("_meta") == F.col("meta")) & (F.col("_size") == F.col("size")), F.lit(False))
    return both.withColumn("unchanged", same).withColumn("payload_offset", F.when(same, F.col("payload_offset"))).drop("_meta", "_size")


def runs(files: DataFrame) -> DataFrame:
    """Adds seq (place in the walk) and run_id: consecutive unchanged files at ascending offsets."""
    rows = before(files, ["unchanged", "payload_offset"], "_b")
    brk = ~F.col("unchanged") | F.col("_b").isNull() | ~F.col("_b.unchanged") | (F.col("payload_offset") <= F.col("_b.payload_offset"))
    rows = rows.withColumn("_brk", F.coalesce(brk, F.lit(True)).cast("long"))
    rows = running(rows, F.col("_brk"), "run_id").withColumn("run_id", F.col("run_id") + F.col("_brk"))
    return running(rows, F.lit(1), "seq").drop("_b", "_brk")


def coverage(run_rows: DataFrame, chunks: DataFrame, span: int) -> DataFrame:
    """Per run of unchanged files: its span, its bytes, and the chunks that cover it.

    Runs meet chunks by an equality join on offset div span, both ends and all
    between, then by the exact interval.
    """
    r = run_rows.where("unchanged").groupBy("run_id").agg(
        F.max("seq").alias("last_seq"), F.min("payload_offset").alias("run_start"), F.max(F.col("payload_offset") + HEADER + F.col("size")).alias("run_end"), F.sum(HEADER + F.col("size")).alias("used"), F.count("*").alias("n_files")
    )
    cell = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / span), F.floor((F.col(b) - 1) / span)))
    left = r.withColumn("cell", cell("run_start", "run_end"))
    right = chunks.select("start_offset", "end_offset").withColumn("cell", cell("start_offset", "end_offset"))
    met = left.join(right, "cell").where("start_offset < run_end and end_offset > run_start")
    cover = met.groupBy("run_id").agg(F.min("start_offset").alias("c_start"), F.max("end_offset").alias("c_end"), F.count_distinct("start_offset").alias("n_chunks"))
    return r.join(cover, "run_id", "left").withColumn("total", F.col("c_end") - F.col("c_start"))


def decide(covered: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds reuse and rejected: too much padding, or more used than the chunks hold, is rejected.

    A run that reaches past the previous index is read without counting as rejected.
    """
    threshold = threshold if threshold > 0 else THRESHOLD
    inside = F.coalesce(F.col("c_end") >= F.col("run_end"), F.lit(False))
    fits = (F.col("total") >= F.col("used")) & ((F.col("total") - F.col("used")) / F.col("total") <= threshold)
    return covered.withColumn("reuse", inside & F.coalesce(fits, F.lit(False))).withColumn("rejected", inside & ~F.coalesce(fits, F.lit(False)))


def plan(run_rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Per file: whether it is reused, its place in its run's chunks, the run's total on its last file."""
    both = run_rows.join(decided.select("run_id", "c_start", "total", "reuse", "last_seq"), "run_id", "left")
    reuse = F.coalesce("reuse", F.lit(False)) & F.col("unchanged")
    last = F.col("seq") == F.col("last_seq")
    return both.select("part", "at", "path", "seq", "size", "run_id", reuse.alias("reuse"), F.when(reuse, F.col("payload_offset") - F.col("c_start")).alias("rel"), F.when(reuse & last, F.col("total")).alias("run_total"))


def offsets(planned: DataFrame) -> DataFrame:
    """New payload offset of every file: reads add header and content, a run its chunks at its end."""
    step = F.when(~F.col("reuse"), HEADER + F.col("size")).otherwise(F.coalesce("run_total", F.lit(0)))
    rows = running(planned, step, "_sum")
    return rows.select("path", "seq", "reuse", (HEADER + F.col("_sum") + F.coalesce("rel", F.lit(0))).alias("payload_offset"))


def stats(planned: DataFrame, decided: DataFrame) -> DataFrame:
    """One row: files, reused_files, reused_bytes, injected_bytes, rejected_runs."""
    n = planned.agg(F.count("*").alias("files"), F.sum(F.col("reuse").cast("long")).alias("reused_files"), F.sum(F.when(F.col("reuse"), F.col("size")).otherwise(0)).alias("reused_bytes"), F.sum(F.coalesce("run_total", F.lit(0))).alias("injected_bytes"))
    r = decided.agg(F.coalesce(F.sum(F.col("rejected").cast("long")), F.lit(0)).alias("rejected_runs"))
    return n.join(r)  # one row and one row
