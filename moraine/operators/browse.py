"""Reading a tree back: pages of a directory, look-ups, links, ranges, selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, patterns
from ..sources.staging import staged
from .tree import numbered, walk_key

MOST_HOPS = 40


def read_dir(nodes: DataFrame, n: int, skip: int = 0) -> DataFrame:
    """Entries skip + 1 .. skip + n of every directory, by the bytes of their names."""
    rows = nodes.where("path <> ''").select(names.parent(F.col("path")).alias("parent"), names.basename(F.col("path")).alias("name"), "kind")
    at = F.row_number().over(Window.partitionBy("parent").orderBy("name"))
    return rows.withColumn("at", at).where((F.col("at") > skip) & (F.col("at") <= skip + n))


def look_up(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """For paths asked: kind and size, null if there is no such node. Joined on a hash, then on the path."""
    h = nodes.select(F.xxhash64("path").alias("h"), F.col("path").alias("found"), "kind", "size")
    a = asked.select("path", F.xxhash64("path").alias("h"))
    return a.join(h, (a["h"] == h["h"]) & (a["path"] == h["found"]), "left").select("path", "kind", "size")


def resolve_hardlinks(nodes: DataFrame) -> DataFrame:
    """Hardlinks with their target's kind and size; problem tells why one has none."""
    target = nodes.select(F.col("path").alias("link_target"), F.col("kind").alias("target_kind"), F.col("size").alias("target_size"))
    both = nodes.where("kind = 'hardlink'").select("path", "link_target").join(target, "link_target", "left")
    problem = F.when(F.col("target_kind").isNull(), "missing").when(F.col("target_kind") == "hardlink", "link to link").when(F.col("target_kind") == "directory", "link to directory")
    return both.select("path", "link_target", problem.alias("problem"), F.when(problem.isNull(), F.col("target_size")).alias("size"))


def link_path(path: str = "path", target: str = "target") -> F.Column:
    """Where a symlink points, from the root; null if absolute or outside."""
    parts = F.concat(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), F.split(target, "/"))
    start = F.array().cast("array<string>")
    walked = F.aggregate(parts, F.struct(start.alias("at"), F.lit(False).alias("out")), lambda s, c: F.when(c.isin("", "."), s).when(c == "..", F.struct(F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["out"] | (F.size(s["at"]) == 0)).alias("out"))).otherwise(F.struct(F.concat(s["at"], F.array(c)).alias("at"), s["out"].alias("out"))))
    return F.when(F.startswith(target, F.lit("/")) | walked["out"], None).otherwise(F.array_join(walked["at"], "/"))


def resolve_symlinks(nodes: DataFrame, most_hops: int = MOST_HOPS) -> DataFrame:
    """path, resolved, kind of each symlink to a file or directory; null resolved: dangling, outside, a loop or too many hops.

    Every round doubles the hops that a link is followed, so that the rounds
    (one join and one written table each) are few whatever the chains.
    """
    links = nodes.where("kind = 'symlink'").select("path", link_path("path", "link_target").alias("goes"), F.lit(1).alias("hops"))
    known = nodes.select(F.col("path").alias("goes"), F.col("kind").alias("k"))
    now = staged(links.join(known, "goes", "left").select("path", "goes", "k", "hops"), "links")
    on = F.col("k") == "symlink"
    for _ in range(most_hops.bit_length()):
        if now.where(on).isEmpty():
            break
        next_ = now.select(F.col("path").alias("goes"), F.col("goes").alias("g"), F.col("k").alias("l"), F.col("hops").alias("h"))
        both = now.join(next_, "goes", "left")
        now = staged(both.select("path", F.when(on, F.col("g")).otherwise(F.col("goes")).alias("goes"), F.when(on, F.col("l")).otherwise(F.col("k")).alias("k"), (F.col("hops") + F.when(on, F.col("h")).otherwise(0)).alias("hops")), "links")
    ends = F.col("k").isNotNull() & ~on & (F.col("hops") <= most_hops)
    return now.select("path", F.when(ends, F.col("goes")).alias("resolved"), F.when(ends, F.col("k")).alias("kind"))


def read_ranges(ranges: DataFrame, chunks: DataFrame, span: int) -> DataFrame:
    """The parts of chunks that cover byte ranges (range_id, stream_id, a, b): chunk_from, n_bytes.

    An interval join by cells of span bytes, then the exact test; a pair counts
    in the first cell that both touch.
    """
    cell = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / span), F.floor((F.col(y) - 1) / span)))
    left = ranges.where("b > a").withColumn("cell", cell("a", "b"))
    right = chunks.select("stream_id", "seq", "offset", "end_offset", "digest").withColumn("cell", cell("offset", "end_offset"))
    met = left.join(right, ["stream_id", "cell"]).where("offset < b and end_offset > a")
    met = met.where(F.col("cell") == F.floor(F.greatest("a", "offset") / span))
    low, high = F.greatest("a", "offset"), F.least("b", "end_offset")
    return met.select("range_id", "stream_id", "seq", "digest", (low - F.col("offset")).alias("chunk_from"), (high - low).alias("n_bytes"))


def select_paths(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Nodes at or below the paths asked for, by an equality join on the ancestors."""
    up = nodes.withColumn("_up", F.explode(F.concat(F.array(F.lit("")), patterns.ancestors(F.col("path")), F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.array("path")))))
    want = asked.select(F.when(F.col("path") == ".", "").otherwise(F.col("path")).alias("_up")).distinct()
    return up.join(want, "_up", "left_semi").drop("_up").dropDuplicates(["path"])


def restore_steps(nodes: DataFrame) -> DataFrame:
    """step, phase, path: everything is made in walk order, then directories get their metadata, the deepest first.

    The second phase is the walk of the directories backwards, so that nothing
    is written below a directory that is done.
    """
    made = numbered(nodes.select("path", "kind"), walk_order(), F.lit(1), "step").withColumn("phase", F.lit(1))
    total = nodes.agg(F.count("*").alias("n"))  # one row
    folders = numbered(nodes.where("kind = 'directory'").select("path", "kind"), walk_order(), F.lit(1), "at_")
    back = folders.crossJoin(total.crossJoin(nodes.where("kind = 'directory'").agg(F.count("*").alias("d"))))
    closed = back.select("path", "kind", (F.col("n") + F.col("d") - 1 - F.col("at_")).alias("step"), F.lit(2).alias("phase"))
    return made.select("path", "step", "phase").unionByName(closed.select("path", "step", "phase"))


def walk_order() -> F.Column:
    """The root first, then the components of the path."""
    return F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(walk_key(F.col("path")))


def copies(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """What a selective restore makes: path, kind, size, mode, source.

    Selected nodes keep their mode; parents that were not selected get 0755;
    a hardlink becomes a copy of its target's content.
    """
    own = select_paths(nodes, asked)
    target = nodes.select(F.col("path").alias("link_target"), F.col("size").alias("_size"), F.col("mode").alias("_mode"))
    some = own.join(target, "link_target", "left")
    link = F.col("kind") == "hardlink"
    kept = some.select("path", F.when(link, "file").otherwise(F.col("kind")).alias("kind"), F.when(link, F.col("_size")).otherwise(F.col("size")).alias("size"), F.when(link, F.col("_mode")).otherwise(F.col("mode")).alias("mode"), F.when(link, F.col("link_target")).alias("source"))
    up = own.select(F.explode(patterns.ancestors(F.col("path"))).alias("path")).distinct().join(own.select("path"), "path", "left_anti")
    long = lambda x: F.lit(x).cast("long")
    return kept.unionByName(up.select("path", F.lit("directory").alias("kind"), long(0).alias("size"), long(0o40755).alias("mode"), F.lit(None).cast("string").alias("source")))
