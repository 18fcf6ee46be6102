"""Packing documents into token sequences: Martello-Toth reduction, then best fit.

Lengths are integers up to the capacity, so an instance is a histogram of at
most `capacity` classes, whatever the number of pieces. The driver packs the
histogram: the reduction fixes sets of at most two classes that dominate every
other set holding their larger item, over and over; best fit decreasing packs
what remains, many equal bins at a time. The plan is a list of ranges: the
pieces numbered first..last of a length go to consecutive sequences, at one
offset. Pieces are numbered within a length by their task and their order in
it, so neither the pieces nor a class of them meet in one place.

Pieces of equal length are interchangeable; which of them goes where depends on
the tasks. A null text is the empty text: its document is one piece, the end id alone. A
null doc_id is passed through. Repeated rows are packed as often as they occur.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import CACHE_ENTRIES, default_path, word_bpe
from .common import few, keep, lean, ready, slices, table

Bin = tuple[tuple[int, int], ...]  # (length, how often) in the order of offsets


def dominant(length: int, count: int, sizes: list[int], have: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """The set with this item that dominates all others with it, if a simple one does.

    sizes: the lengths left, ascending; have: how many of each. A set of one or
    two items dominates if what any other set holds besides the item could be
    exchanged for the partner.
    """
    room = capacity - length
    own = 1 if length <= room and count < 2 else 0  # the only copy is no partner of its own
    at = bisect.bisect_right(sizes, room) - 1
    while at >= 0 and own and sizes[at] == length:
        at -= 1
    if at < 0:
        return (length,)
    best = sizes[at]
    if best == room:
        return length, best
    low: list[int] = []
    for s in sizes:
        low += [s] * min(3, have[s] - (s == length))
        if len(low) >= 3:
            break
    if sum(low[:2]) > room or len(low) < 2:
        return length, best
    if sum(low[:3]) > room or len(low) < 3:  # two partners at most: the best pair must not exceed the best single
        most, i, j = 0, 0, at
        while i <= j:
            pair = sizes[i] + sizes[j]
            if pair > room:
                j -= 1
            else:
                if i != j or have[sizes[i]] - (sizes[i] == length) >= 2:
                    most = max(most, pair)
                i += 1
        if best >= most:
            return length, best
    return None


def reduce_instance(have: dict[int, int], capacity: int) -> tuple[list[tuple[Bin, int]], dict[int, int]]:
    """Bins fixed for good by dominance, and the histogram that is left."""
    have = {s: n for s, n in have.items() if n}
    fixed: list[tuple[Bin, int]] = []
    sizes = sorted(have)
    again = True
    while again and sizes:
        again = False
        for length in sizes[::-1]:
            while have.get(length):
                found = dominant(length, have[length], sizes, have, capacity)
                if found is None:
                    break
                again = True
                need = Counter(found)
                times = min(have[s] // k for s, k in need.items())
                fixed.append((tuple(sorted(need.items(), reverse=True)), times))
                for s, k in need.items():
                    have[s] -= k * times
                    if not have[s]:
                        del have[s]
                        sizes.remove(s)
    return fixed, have


def best_fit(have: dict[int, int], capacity: int) -> list[tuple[Bin, int]]:
    """Best fit decreasing over a histogram; equal bins are kept together."""
    rooms: list[int] = []  # ascending, of the groups below
    groups: dict[int, list[list]] = {}  # room left -> [[bin, how many]]

    def put(room: int, content: Bin, n: int) -> None:
        if n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append([content, n])

    for size in sorted(have, reverse=True):
        left = have[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                put(capacity % size, ((size, each),), left // each)
                if left % each:
                    put(capacity - size * (left % each), ((size, left % each),), 1)
                break
            room = rooms[at]
            content, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // size
            full = min(n, left // each)
            put(room - each * size, (*content, (size, each)), full)
            left -= full * each
            rest = n - full
            if rest and 0 < left < each:
                put(room - left * size, (*content, (size, left)), 1)
                left, rest = 0, rest - 1
            put(room, content, rest)
    return [(content, n) for room in groups for content, n in groups[room]]


def pack_histogram(have: dict[int, int], capacity: int) -> list[tuple[Bin, int]]:
    fixed, rest = reduce_instance(have, capacity)
    return fixed + best_fit(rest, capacity)


def slots(bins: list[tuple[Bin, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first number of a range, its first sequence, its offset."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    given: Counter[int] = Counter()
    first = 0
    for content, times in bins:
        at = 0
        for size, k in content:
            for _ in range(k):
                out.setdefault(size, []).append((given[size], first, at))
                given[size] += times
                at += size
        first += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*rows)) for size, rows in out.items()}


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text", cache: int = CACHE_ENTRIES) -> DataFrame:
    """Tokenize and cut: a row for each piece, numbered within its task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, seen = word_bpe(path, cache), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for big in batches:
            for batch in slices(big, "text"):
                rows = []
                for name, ids in zip(batch.column(0).to_pylist(), bpe.encode_all(batch.column(1).to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        size = len(part) // 4
                        rows.append((name, k, at // 4, size, zlib.crc32(part), task, seen[size]))
                        seen[size] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in _PIECES.split(", ")])

    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text")
    return rows.mapInArrow(lean(run), _PIECES)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", cache: int = CACHE_ENTRIES) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. cache: see word_bpe.
    """
    ready(docs.sparkSession)
    pieces = keep(token_pieces(docs, path, capacity, end_id, doc_id, text, cache), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    # the histogram has at most `capacity` rows
    have = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = slots(pack_histogram(have, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else ():
                first, start, at = plan[int(length[rows[0]])]
                k = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows] = start[k] + number[rows] - first[k]
                offset[rows] = at[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    numbered = pieces.join(base, ["task", "length"]).withColumn("number", F.col("base") + F.col("nth"))
    placed = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return few(placed).mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path())
