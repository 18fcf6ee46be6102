"""Near duplicates by bottom-k sketches of one hash function.

A document's set is its distinct shingles of `size` words. Documents of equal
sets form a class; the class stands for its copies from then on. A class keeps
the k least shingle hashes, its sketch. Inverted lists are kept over every three
neighbouring retained values (for sets of at most 20, over each value too). Two
sets with a similarity of at least 0.8 agree on most of the least values of
their union, so that three in a row are common to both unless that fails in all
of k - 2 places (below 1e-7 at 0.8, and below 1e-8 at 0.85, for k = 48).

Lists are never expanded into all pairs. First every list pairs its least class
with each other one. Pairs of fitting sizes pass if the union sketch (the k
least values of both) estimates enough overlap, and the full sets decide. Then
lists whose classes still lie in different components are searched, in blocks,
for pairs that pass the estimate; a block hands on a spanning forest of them, a
row for each class at most. The forests' components are clusters: every pair
left to decide lies inside one. A cluster's full sets meet in blocks, which
decide every pair by the exact overlaps (a matrix product over shared shingles)
and hand on spanning links. Links within a component change nothing, so no link
between components is lost.

Full sets are made anew for documents in candidate pairs only; a bitmap of
their ids (BITS bits, whatever the input) picks them where the texts lie.

Null texts and texts without words have an empty set, n_shingles 0, and are
linked with nothing. A null doc_id is linked with nothing and is its own
component (null, kept). A document shorter than a shingle is one shingle.
Repeated rows are copies of each other. An empty table gives no rows; other
columns are not read, or pass through keep_one. There every row counts, whatever
its id: rows get a unique key in the order of doc_id, nulls first, if doc_id is
none, and the first row of a group stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bit_of, few, fresh, has_bit, id_bitmap, keep, lean, loose, mix64, quoted, ready, slices, span_hashes, table, text_bytes, word_spans
from .components import components
from .linedup import keyed

K, RUN, SMALL, BLOCK = 48, 3, 20, 1024
#: Parts of a list.
PARTS = 64
#: Shingles in a block of a cluster.
WEIGHT = 1_000_000
MARGIN = 0.3
_ONE, _TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their n + 1 offsets."""
    buf, off = text_bytes(texts)
    buf = LOWER[buf]
    start, end, row = word_spans(buf, off)
    words = span_hashes(buf, start, end)
    n_words = np.bincount(row, minlength=len(texts))
    m = max(0, len(words) - size + 1)
    made = np.zeros(m, np.uint64)
    for j in range(size):
        made = mix64(made * _ONE + words[j : j + m])
    owner = row[:m]
    whole = owner == row[size - 1 :] if m else np.zeros(0, bool)
    made, owner = made[whole], owner[whole]
    first = np.cumsum(n_words) - n_words
    short, owners = [], np.flatnonzero((n_words > 0) & (n_words < size))
    for r in owners.tolist():
        h = np.uint64(n_words[r])
        for w in words[first[r] : first[r] + n_words[r]]:
            h = mix64(np.array([h], np.uint64) * _ONE + w)[0]
        short.append(h)
    if short:
        made, owner = np.concatenate((made, np.array(short, np.uint64))), np.concatenate((owner, owners))
    value = made.view(np.int64)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))


def set_names(value: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set; None for an empty one."""
    u = value.view(np.uint64)
    n = np.diff(off)
    full = np.flatnonzero(n)
    parts = []
    for salt in (_TWO, _THREE):
        total = np.zeros(len(n), np.uint64)
        if len(full):
            total[full] = np.add.reduceat(mix64(u * salt + _ONE), off[:-1][full])
        parts.append(mix64(total + n.astype(np.uint64) * salt))
    both = np.column_stack(parts).astype("<u8").tobytes()
    return [both[16 * i : 16 * i + 16] if k else None for i, k in enumerate(n.tolist())]


def lists(value: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(value, pa.int64()))


def sketches(rows: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, n, name of the set, the k least hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                value, off = shingle_sets(batch.column(1), size)
                n = np.diff(off)
                least = np.arange(len(value)) - np.repeat(off[:-1], n) < k
                cut = np.concatenate(([0], np.cumsum(np.minimum(n, k))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(set_names(value, off), pa.binary()), lists(value[least], cut)], ["doc_id", "n", "name", "sketch"])

    return rows.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, name binary, sketch array<long>")


def postings(heads: DataFrame, small: int) -> DataFrame:
    """key, head for each inverted list a class stands in."""
    runs = F.when(F.size("sketch") >= RUN, F.transform(F.sequence(F.lit(1), F.size("sketch") - RUN + 1), lambda i: F.xxhash64(*(F.element_at("sketch", (i + j).cast("int")) for j in range(RUN))))).otherwise(F.array().cast("array<long>"))
    single = F.when(F.col("n") <= small, F.transform("sketch", lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<long>"))
    return heads.select(F.explode(F.concat(runs, single)).alias("key"), "head")


def may_fit(percent: int) -> F.Column:
    """Whether two set sizes allow the similarity."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def estimated(pairs: DataFrame, heads: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) whose union sketch has enough in common."""
    one = heads.select(F.col("head").alias("a"), F.col("sketch").alias("s_a"))
    two = heads.select(F.col("head").alias("b"), F.col("sketch").alias("s_b"))
    both = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    hit = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    return both.where(hit >= (percent / 100 - MARGIN) * F.size(union)).select("a", "b").distinct()


def full_sets(ids: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles of the documents with these ids (doc_id)."""
    wanted = rows.sparkSession.sparkContext.broadcast(id_bitmap(ids, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = wanted.value
        for big in batches:
            some = big.filter(pa.array(has_bit(flags, big.column(2))))
            for batch in slices(some, "text") if some.num_rows else ():
                value, off = shingle_sets(batch.column(1), size)
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(value, off)], ["doc_id", "shingles"])

    placed = rows.where("doc_id is not null").select("doc_id", "text", bit_of("doc_id").alias("p"))
    return placed.mapInArrow(lean(run), "doc_id long, shingles array<long>").join(ids, "doc_id", "left_semi")


def verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose full sets are similar enough, as (u, v)."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = keep(full_sets(ids, rows, size), "sets")
    pairs = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return pairs.select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("s")).where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def overlaps(listed: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of some sets of numbers, and how many every two have in common."""
    sizes, flat = listed.value_lengths().to_numpy(), listed.flatten().to_numpy()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, code, held = np.unique(flat, return_inverse=True, return_counts=True)
    common = held[code] > 1
    code, owner = code[common], owner[common]
    hits = np.zeros((len(sizes), len(sizes)), np.float32)
    if len(code):
        code = np.unique(code, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        for at in range(0, int(code[-1]) + 1, 1024):  # some values at a time
            a, b = np.searchsorted(code, (at, at + 1024))
            held_by = np.zeros((len(sizes), 1024), np.float32)
            held_by[owner[a:b], code[a:b] - at] = 1
            used = np.unique(owner[a:b])
            some = held_by[used]
            hits[np.ix_(used, used)] += some @ some.T
    return sizes, hits


def forest(may: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Edges of may that join what root does not already hold together."""
    own = {r: i for i, r in enumerate(np.unique(root).tolist())}
    group = np.array([own[r] for r in root.tolist()])
    out: list[tuple[int, int]] = []
    left = np.ones(len(root), bool)
    while left.any():
        start = int(np.flatnonzero(left)[0])
        todo = np.flatnonzero(group == group[start]).tolist()
        left[todo] = False
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(may[i] & left).tolist():
                if left[j]:
                    out.append((i, j))
                    more = np.flatnonzero((group == group[j]) & left)
                    left[more] = False
                    todo += more.tolist()
    return out


def in_blocks(members: DataFrame, by: str, weight: str) -> DataFrame:
    """Rows of groups of any size dealt to pairs of blocks (by, one, two): each two rows of a group meet."""
    parts = members.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(weight) / WEIGHT)).cast("int").alias("parts"))
    dealt = members.join(parts, by).withColumn("block", F.pmod(F.xxhash64("head"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = dealt.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("parts", "block", "other")
    return met.repartition(by, "one", "two")  # else all blocks of a group stay where the join has put them


def across(entries: DataFrame, percent: int, k: int) -> DataFrame:
    """Forests (u, v) of the pairs in a list that pass the estimate. entries: key, one, two, head, root, n, sketch."""

    def run(group: pa.Table) -> pa.Table:
        head, root, n = (group.column(c).to_numpy() for c in ("head", "root", "n"))
        sizes, hits = overlaps(group.column("sketch").combine_chunks())
        # what both sketches share is at least what the union's k least values share
        may = hits >= (percent / 100 - MARGIN) * np.minimum(k, sizes[:, None] + sizes[None, :] - hits)
        may &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        return edges(head, forest(may, root))

    return entries.select("key", "one", "two", "head", "root", "n", "sketch").groupBy("key", "one", "two").applyInArrow(run, "u long, v long").distinct()


def inside(entries: DataFrame, percent: int) -> DataFrame:
    """Forests (u, v) of the true links in a cluster. entries: cluster, one, two, head, root, shingles."""

    def run(group: pa.Table) -> pa.Table:
        head, root = (group.column(c).to_numpy() for c in ("head", "root"))
        sizes, hits = overlaps(group.column("shingles").combine_chunks())
        return edges(head, forest(100 * hits.astype(np.float64) >= percent * (sizes[:, None] + sizes[None, :] - hits), root))

    return entries.select("cluster", "one", "two", "head", "root", "shingles").groupBy("cluster", "one", "two").applyInArrow(run, "u long, v long").distinct()


def edges(head: np.ndarray, pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([int(head[i]) for i, _ in pairs], pa.int64()), "v": pa.array([int(head[j]) for _, j in pairs], pa.int64())})


def whole_clusters(clusters: DataFrame, roots: DataFrame) -> DataFrame:
    """cluster, head, root of all classes to decide: forests join components, so clusters take in their classes.

    A forest links one class of a component for all of them; the pairs behind it
    may be others, so every class of a component in a forest joins its cluster.
    """
    own = clusters.join(roots, "head", "left").withColumn("root", F.coalesce("root", "head"))
    joined = own.select(F.col("cluster").alias("u"), F.col("root").alias("v"))
    # clusters and components that touch are one; numbers of both kinds are ids of classes
    same = components(own.select(F.col("head").alias("u"), F.col("cluster").alias("v")).unionByName(own.select(F.col("head").alias("u"), F.col("root").alias("v"))).unionByName(joined))
    touched = own.select("root").distinct()
    all_ = roots.join(touched, "root", "left_semi").select("head", "root").unionByName(own.select("head", "root")).distinct()
    return keep(few(all_.join(same.select(F.col("node").alias("root"), F.col("root").alias("cluster")), "root")), "clusters")


def classes(docs: DataFrame, size: int, percent: int, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    ready(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text")
    made = keep(sketches(rows, size, k), "sketches")
    linked = made.where("name is not null and doc_id is not null")
    heads = linked.groupBy("name").agg(F.min("doc_id").alias("head"))
    members = keep(linked.join(loose(heads), "name").select("doc_id", "n", "head", F.when(F.col("doc_id") == F.col("head"), F.col("sketch")).alias("sketch")), "members")
    heads = members.where("sketch is not null").select("head", "n", "sketch")
    listed = postings(heads, SMALL)
    # A list is summed up in parts of its own before it meets in one row, and joined in parts. Most lists hold
    # one class: dealt before they are summed up, they take little memory.
    dealt = listed.repartition("key", F.pmod(F.xxhash64("head"), F.lit(PARTS)))
    shared = keep(few(dealt.groupBy("key").agg(F.min("head").alias("a"), F.max("head").alias("most")).where("a < most").drop("most")), "shared")
    entries = keep(few(listed.join(shared, "key").select("key", "a", F.col("head").alias("b"))), "entries")
    size_of = lambda x: heads.groupBy(F.col("head").alias(x)).agg(F.min("n").alias(f"n_{x}"))
    stars = entries.where("a <> b").select("a", "b").distinct().join(size_of("a"), "a").join(size_of("b"), "b").where(may_fit(percent)).select("a", "b")
    stars = keep(few(estimated(stars, heads, percent, k)), "stars")
    links = keep(few(verified(stars, rows, size, percent)), "links")
    roots = keep(few(components(links)), "roots").withColumnRenamed("node", "head")
    # lists whose classes are still in different components
    rooted = entries.select("key", F.col("b").alias("head")).distinct().join(roots, "head", "left").withColumn("root", F.coalesce("root", "head"))
    rooted = keep(few(rooted), "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    sketch_of = heads.dropDuplicates(["head"]).select("head", "n", "sketch")
    spread = in_blocks(rooted.join(mixed, "key", "left_semi").withColumn("w", F.lit(0)), "key", "w").join(sketch_of, "head")
    clusters = keep(few(components(across(spread, percent, k))), "clusters").select(F.col("node").alias("head"), F.col("root").alias("cluster"))
    # a root's classes that stand in no forest are held by the root's other classes
    clusters = whole_clusters(clusters, roots)
    sets = full_sets(clusters.select(F.col("head").alias("doc_id")), rows, size).withColumnRenamed("doc_id", "head").dropDuplicates(["head"])
    met = keep(clusters.join(sets, "head").withColumn("w", F.size("shingles")), "clustered")
    found = inside(in_blocks(met, "cluster", "w"), percent)
    roots = keep(few(components(links.unionByName(found))), "roots")
    label = members.select("doc_id", F.col("n").alias("n_shingles"), "head").join(roots.withColumnRenamed("node", "head"), "head", "left")
    done = label.select("doc_id", "n_shingles", F.coalesce("root", "head").alias("component_id"))
    rest = made.where("name is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without the rows of a group but its first."""
    rows, key = keyed(docs, doc_id)
    lost = fresh("_gone", rows.columns)
    gone = keep(few(classes(rows, size, percent, doc_id=key, text=text).where("not kept").select(F.col("doc_id").alias(lost))), "gone")
    # only documents that may go are shuffled
    bits = docs.sparkSession.sparkContext.broadcast(id_bitmap(gone, lost))
    names = [*docs.columns, key]
    bit = fresh("_bit", names)
    placed = rows.withColumn(bit, bit_of(key)).select(*quoted(names), bit)
    schema = placed.drop(bit).schema

    def part(want: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = bits.value
            for batch in batches:
                hit = has_bit(flags, batch.column(len(names)))
                yield batch.select(names).filter(pa.array(hit if want else ~hit))

        return placed.mapInArrow(lean(run), schema)

    some = part(True)
    return part(False).unionByName(some.join(gone.hint("merge"), some[key] == gone[lost], "left_anti")).drop(key)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), 3, 85)
