"""Line dedup: later copies of repeated runs of lines are deleted.

The sequence of a document is its lines that hold a word; order is by document,
then by line. A run of lines is deleted where it has `least_words` words or more
and occurs earlier, so the first copy of everything stays.

Lines get ranks in their order. Prefix doubling gives each place the rank of
its next 2, 4, 8 ... lines, by sorting the distinct pairs of ranks that occur
twice or more: the suffixes in the order of their first 2 ** k lines. Places of
equal rank are an interval of the suffix array with that common prefix. Only
intervals of two or more places go on, and pairs rather than places are sorted,
so a line that stands everywhere is one row in a sort.

A run of w lines, 2 ** k <= w < 2 ** (k + 1), is named by the ranks of its first
and its last 2 ** k lines. A place asks for the least runs that start or end
there and have enough words. Every line of a maximal repeated run with enough
words lies in such a least run inside it, so the places in an interval other
than its first tell exactly the lines to delete. Least runs have at most
`least_words` lines, which bounds the rounds.

Null and wordless texts have no lines and stay as they are; lines without words
are never deleted. Null ids come first in the order; rows of one doc_id are
documents in an unspecified order. An empty table gives no rows; other columns
are not read, or pass through keep_first_lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_of, drop, few, filed, fresh, has_bit, id_bitmap, keep, lean, loose, quoted, ready, slices, table

LEAST_WORDS = 8


def worded(text: str | None) -> tuple[list[str], list[int], list[int]]:
    """All lines, the places of those with a word, and their numbers of words."""
    lines = (text or "").split("\n")
    sizes = [len(x.encode().split()) for x in lines]
    places = [i for i, n in enumerate(sizes) if n]
    return lines, places, [sizes[i] for i in places]


def least_runs(sizes: list[int], least_words: int) -> list[list[int]]:
    """For each place, the lengths of the least runs that start there and have enough words.

    A least run loses that property without its first or without its last line.
    """
    total = np.concatenate(([0], np.cumsum(sizes)))
    n = len(sizes)
    out: list[list[int]] = [[] for _ in range(n)]
    ends = np.searchsorted(total, total[:n] + least_words)  # the run from i needs lines i .. ends[i] - 1
    for i, e in enumerate(ends.tolist()):
        if e <= n:
            out[i].append(e - i)
    starts = np.searchsorted(total, total[1:] - least_words, side="right") - 1
    for e, i in enumerate(starts.tolist()):
        if i >= 0 and e + 1 - i not in out[i]:
            out[i].append(e + 1 - i)
    return out


def keyed(docs: DataFrame, doc_id: str) -> tuple[DataFrame, str]:
    """docs with a unique key in the order of doc_id (doc_id itself if it is one), and the key's name."""
    id_, name = F.col(quoted([doc_id])[0]).cast("long"), fresh("_key", docs.columns)
    if docs.groupBy(id_.alias("i")).agg(F.count("*").alias("n")).where("n > 1 or i is null").limit(1).count() == 0:
        return docs.withColumn(name, id_), name
    spread = docs.repartitionByRange(id_, F.xxhash64(F.monotonically_increasing_id())).sortWithinPartitions(id_)
    return keep(spread.withColumn(name, F.monotonically_increasing_id()), "keyed"), name


def in_rank(names: DataFrame, *columns: str) -> DataFrame:
    """Distinct names with an ascending number each."""
    return filed(few(names.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("r", F.monotonically_increasing_id())), "ranks")


def repeated_runs(lines: DataFrame, least_words: int) -> DataFrame:
    """d, p, w, sd, sp: runs that have an earlier copy, and where their first one stands.

    lines: d, p, line (its hash), ws (lengths asked for).
    """
    names = in_rank(lines.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "line")
    level = filed(few(lines.join(names, "line").select("d", "p", "r", "ws")), "level")
    found: list[DataFrame] = []
    span = 1
    while True:
        asked = level.select("d", "p", "r", F.explode(F.filter("ws", lambda w: (w >= span) & (w < 2 * span))).alias("w"))
        last = level.select("d", (F.col("p")).alias("q"), F.col("r").alias("s"))
        runs = asked.withColumn("q", F.col("p") + F.col("w") - span).join(last, ["d", "q"]).select("d", "p", "w", "r", "s") if span > 1 else asked.withColumn("s", F.col("r"))
        runs = filed(few(runs), "runs")
        # a run's first place is one row, dealt apart from the runs, whose hot keys can then be split
        first = loose(runs.groupBy("w", "r", "s").agg(F.min(F.struct("d", "p")).alias("at"), F.count("*").alias("n")).where("n > 1").select("w", "r", "s", "at"))
        found.append(runs.join(first, ["w", "r", "s"]).where(F.struct("d", "p") != F.col("at")).select("d", "p", "w", F.col("at.d").alias("sd"), F.col("at.p").alias("sp")))
        if 2 * span > least_words:
            break
        follow = level.select("d", (F.col("p") - span).alias("p"), F.col("r").alias("y"))
        longer = F.filter("ws", lambda w: w >= 2 * span)
        pairs = filed(few(level.withColumnRenamed("r", "x").join(follow, ["d", "p"]).select("d", "p", "x", "y", longer.alias("ws"))), "pairs")
        names = in_rank(pairs.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y"), "x", "y")
        drop(level)
        level = filed(few(pairs.join(names, ["x", "y"]).select("d", "p", "r", "ws")), "level")
        drop(pairs)
        span *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def deleted(docs: DataFrame, key: str, text: str, least_words: int) -> DataFrame:
    """d and the runs to delete, (p, w, sd, sp) each, of the documents that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                rows = []
                for d, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    lines, places, sizes = worded(x.as_py())
                    for p, (i, ws) in enumerate(zip(places, least_runs(sizes, least_words) if places else ())):
                        rows.append((d, p, hashlib.md5(lines[i].encode(), usedforsecurity=False).digest(), ws))
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["d", "p", "line", "ws"])

    rows = docs.select(F.col(key).alias("d"), F.col(quoted([text])[0]).cast("string").alias("text"))
    lines = filed(rows.mapInArrow(lean(run), "d long, p int, line binary, ws array<int>"), "lines")
    return repeated_runs(lines, least_words).groupBy("d").agg(F.collect_list(F.struct("p", "w", "sd", "sp")).alias("runs"))


def cut(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without its runs, how many lines with words it had and lost."""
    lines, places, _ = worded(text)
    if not runs:
        return text, len(places), 0
    gone = {places[k] for r in runs for k in range(r["p"], r["p"] + r["w"])}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(places), len(gone)


def copies_of(runs: list[dict] | None) -> list[dict]:
    """Runs put together to maximal copies: first and last line, the source and the line there that the first one repeats.

    Runs that overlap or touch and repeat the same stretch of the same source are
    one copy, since all their lines follow each other in both places.
    """
    out: list[dict] = []
    for r in sorted(runs or (), key=lambda r: (r["sd"], r["sp"] - r["p"], r["p"], r["w"])):
        last = out[-1] if out else None
        if last and last["source"] == r["sd"] and last["source_first"] - last["first"] == r["sp"] - r["p"] and r["p"] <= last["last"] + 1:
            last["last"] = max(last["last"], r["p"] + r["w"] - 1)
        else:
            out.append({"first": r["p"], "last": r["p"] + r["w"] - 1, "source": r["sd"], "source_first": r["sp"]})
    return sorted(out, key=lambda x: (x["first"], x["last"], x["source"]))


def split_by_runs(rows: DataFrame, runs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows that surely have no runs, where they lie, their runs null; and the others, joined with their runs.

    Only documents that may lose lines are shuffled. Runs compress well, so that
    their files' size says little about them: they are never broadcast.
    """
    names = rows.columns
    bits = rows.sparkSession.sparkContext.broadcast(id_bitmap(runs, key))
    placed = rows.withColumn(fresh("_bit", names), bit_of(key))

    def part(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = bits.value
            for batch in batches:
                hit = has_bit(flags, batch.column(len(names)))
                yield batch.select(names).filter(pa.array(hit if want else ~hit))

        return placed.mapInArrow(lean(run), rows.schema)

    own = next(x for x in runs.columns if x != key)
    return part(False).withColumn(own, F.lit(None).cast(runs.schema[own].dataType)), part(True).join(runs.hint("merge"), key, "left")


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (first and last line of each stretch, from 0 among lines with words), copies, text.

    copies: the maximal repeated runs behind the stretches, each with its source:
    first, last, source, source_first. source is a doc_id if those are unique and
    not null, else the row's number in their order.
    """
    ready(docs.sparkSession)
    rows, key = keyed(docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text"), "doc_id")
    runs = filed(deleted(rows, key, "text", least_words), "deleted").withColumnRenamed("d", key).withColumnRenamed("runs", "_runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        copy = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("source", pa.int64()), ("source_first", pa.int32())]))
        for big in batches:
            for batch in slices(big, "text"):
                out = []
                for x, own in zip(batch.column(1), batch.column(2).to_pylist()):
                    left, n, gone = cut(x.as_py(), own)
                    merged: list[dict] = []
                    for p, e in sorted((r["p"], r["p"] + r["w"] - 1) for r in own or ()):
                        if merged and p <= merged[-1]["last"] + 1:
                            merged[-1]["last"] = max(merged[-1]["last"], e)
                        else:
                            merged.append({"first": p, "last": e})
                    out.append((n, gone, merged, copies_of(own), left))
                kinds = (pa.int64(), pa.int64(), span, copy, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], ["doc_id", "n_lines", "n_deleted", "deleted", "copies", "text"])

    parts = [x.select("doc_id", "text", "_runs").mapInArrow(lean(run), "doc_id long, n_lines long, n_deleted long, deleted array<struct<first:int,last:int>>, copies array<struct<first:int,last:int,source:bigint,source_first:int>>, text string") for x in split_by_runs(rows, runs, key)]
    return parts[0].unionByName(parts[1])


def keep_first_lines(docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with their later copies cut out; a document that loses its last words goes."""
    ready(docs.sparkSession)
    rows, key = keyed(docs, doc_id)
    own_runs = fresh("_runs", rows.columns)
    runs = filed(deleted(rows, key, text, least_words), "deleted").withColumnRenamed("d", key).withColumnRenamed("runs", own_runs)
    place, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, text):
                found = [cut(x.as_py(), own) for x, own in zip(batch.column(place), batch.column(len(names)).to_pylist())]
                columns = batch.columns[: len(names)]
                columns[place] = pa.array([x[0] for x in found], columns[place].type)
                if n_chars in names:
                    at = names.index(n_chars)
                    size = [len(x[0]) if x[2] else old for x, old in zip(found, columns[at].to_pylist())]
                    columns[at] = pa.array(size, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array([not gone or gone < n for _, n, gone in found], pa.bool_()))

    whole, some = split_by_runs(rows, runs, key)
    return whole.select(*quoted(names)).union(some.select(*quoted(names), own_runs).mapInArrow(lean(run), docs.schema))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
