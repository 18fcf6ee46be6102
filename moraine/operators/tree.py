"""Trees of nodes as tables: roots, links, duplicates, exclusion.

A node is a row with path ('' is the root), kind, stat columns and extras.
Walk order is depth first, siblings by the bytes of their names: the order of
the path's components, not of the path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, patterns
from ..sources.staging import staged


def walk_key(path: Column) -> Column:
    return F.split(path, "/")


def with_directories(files: DataFrame, path: str = "path") -> DataFrame:
    """path, kind of all directories that the files' paths imply, the root too."""
    up = files.select(F.explode(F.concat(F.array(F.lit("")), patterns.ancestors(F.col(path)))).alias("path"))
    return up.distinct().withColumn("kind", F.lit("directory"))


def ancestry(nodes: DataFrame) -> DataFrame:
    """path, ancestor, distance: a row for each proper ancestor but the root."""
    up = nodes.select("path", F.posexplode(patterns.ancestors(F.col("path"))).alias("i", "ancestor"))
    return up.select("path", "ancestor", (names.depth(F.col("path")) - F.col("i") - 1).alias("distance"))


def virtual_root(roots: DataFrame) -> DataFrame:
    """Nodes of several roots (root, path, ...) under one; names must differ."""
    return roots.withColumn("path", names.join_path(F.col("root"), F.col("path"))).drop("root")


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """Names that occur more than once in a directory."""
    n = nodes.where("path <> ''").select(names.parent(F.col("path")).alias("parent"), names.basename(F.col("path")).alias("name"))
    return n.groupBy("parent", "name").agg(F.count("*").alias("n")).where("n > 1")


def hardlink_targets(nodes: DataFrame) -> DataFrame:
    """Adds link_target: the first path in walk order of a multi-link inode, null for itself.

    The targets come from a partial aggregate, not a window, so that an inode
    with very many links is not gathered in one task.
    """
    multi = nodes.where("kind = 'file' and nlink > 1")
    first = multi.groupBy("dev", "ino").agg(F.min_by("path", walk_key(F.col("path"))).alias("_first"))
    linked = multi.join(first, ["dev", "ino"])  # other nodes are not shuffled
    is_link = F.col("_first") != F.col("path")
    linked = linked.withColumn("link_target", F.when(is_link, F.col("_first"))).withColumn("kind", F.when(is_link, F.lit("hardlink")).otherwise(F.col("kind"))).drop("_first")
    single = nodes.where("not coalesce(kind = 'file' and nlink > 1, false)").withColumn("link_target", F.lit(None).cast("string"))
    return single.unionByName(linked)


def prune(nodes: DataFrame, texts: Sequence[str], veto=None) -> DataFrame:
    """The nodes that the patterns (and a further predicate) leave; the root stays."""
    gone = patterns.pruned(patterns.parse_all(texts), F.col("path"), F.col("kind") == "directory", veto)
    return nodes.where((F.col("path") == "") | ~gone)


def exclude_audit(nodes: DataFrame, texts: Sequence[str]) -> DataFrame:
    """The topmost excluded nodes: excluded, with no excluded directory above."""
    ps = patterns.parse_all(texts)
    own = patterns.excluded(ps, F.col("path"), F.col("kind") == "directory")
    above = F.exists(patterns.ancestors(F.col("path")), lambda a: patterns.excluded(ps, a, F.lit(True)))
    return nodes.where((F.col("path") != "") & own & ~above)


def parse_exclude_lines(lines: DataFrame) -> DataFrame:
    """Parsed patterns of exclude files: scope_dir, line_no, line to regex, include, dir_only.

    Lines are trimmed; blank ones and comments are skipped; an anchored line is
    anchored at the directory that holds the file.
    """
    t = F.regexp_replace("line", r"^[ \t\r\x0B\f]+|[ \t\r\x0B\f]+\z", "")
    df = lines.withColumn("t", t).where((F.col("t") != "") & ~F.startswith("t", F.lit("#")))
    df = df.withColumn("include", F.startswith("t", F.lit("!"))).withColumn("t", F.regexp_replace("t", r"^!", ""))
    df = df.withColumn("anchored", F.startswith("t", F.lit("/"))).withColumn("t", F.regexp_replace("t", r"^/", ""))
    df = df.withColumn("dir_only", F.endswith("t", F.lit("/"))).withColumn("t", F.regexp_replace("t", r"/\z", ""))
    return df.where("t <> ''").select("scope_dir", "line_no", "include", "anchored", "dir_only", F.col("t").alias("body"))


def scoped_verdicts(nodes: DataFrame, scoped: DataFrame) -> DataFrame:
    """path, excluded: by patterns that hold below their scope directory only.

    scoped: scope_dir, line_no, include, dir_only, regex. The deepest scope and
    in it the last line decides. Nodes meet the scopes above them by an equality
    join on the ancestor, not by comparing paths.
    """
    up = nodes.where("path <> ''").select("path", "kind", F.explode(F.concat(F.array(F.lit("")), patterns.ancestors(F.col("path")))).alias("scope_dir"))
    hit = up.join(scoped, "scope_dir").where(F.expr("path rlike regex") & (~F.col("dir_only") | (F.col("kind") == "directory")))
    order = F.struct(names.depth(F.col("scope_dir")).alias("a"), F.col("line_no").alias("b"))
    return hit.groupBy("path").agg((~F.max_by("include", order)).alias("excluded"))


def outer_lines(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """Patterns that hold everywhere, as scoped ones before all lines of exclude files."""
    rows = [("", k - len(texts), p.include, p.dir_only, p.regex) for k, p in enumerate(map(patterns.parse, texts))]
    return spark.createDataFrame(rows, "scope_dir string, line_no int, include boolean, dir_only boolean, regex string")


def prune_scoped(nodes: DataFrame, scoped: DataFrame, outer: Sequence[str] = ()) -> DataFrame:
    """Nodes without those excluded by scoped patterns, and without what lies below.

    outer patterns and the lines of exclude files are one list, outer ones
    first: the last match decides.
    """
    if outer:
        scoped = scoped.unionByName(outer_lines(nodes.sparkSession, outer))
    gone = scoped_verdicts(nodes, scoped).where("excluded").select("path")
    below = ancestry(nodes).join(gone.withColumnRenamed("path", "ancestor"), "ancestor", "left_semi").select("path").distinct()
    return nodes.join(gone, "path", "left_anti").join(below, "path", "left_anti")


def covered(paths: DataFrame) -> DataFrame:
    """Requested paths that another requested path (or '.') does not cover."""
    asked = paths.select(F.when(F.col("path") == ".", "").otherwise(F.col("path")).alias("path")).distinct()
    up = asked.where("path <> ''").select("path", F.explode(F.concat(F.array(F.lit("")), patterns.ancestors(F.col("path")))).alias("ancestor"))
    hidden = up.join(asked.withColumnRenamed("path", "ancestor"), "ancestor", "left_semi").select("path").distinct()
    return asked.join(hidden, "path", "left_anti")


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change of nodes added, removed or changed (kind, size or mtime)."""
    a, b = (x.select("path", F.struct("kind", "size", "mtime_secs").alias(n)) for x, n in ((old, "a"), (new, "b")))
    both = a.join(b, "path", "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def in_order(df: DataFrame, key: Column) -> DataFrame:
    """df written once in the order of key, dealt to ranges: adds part (the range) and at (ascends with key)."""
    dealt = df.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key").drop("_key")
    return staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")


def running(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over all earlier rows of in_order.

    The sums of the ranges (a row each) are summed up among themselves, then
    each range inside: no task sees more than a range, however the keys lie.
    """
    rows = rows.withColumn("_v", value.cast("long"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("part").agg(F.sum("_v").alias("_s")).select("part", F.coalesce(F.sum("_s").over(over), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, "part").withColumn(name, F.col("_from") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_from")


def before(rows: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Adds a struct of the columns' values in the row before, in the order of in_order; null in the first row."""
    own = F.struct(*columns)
    last = rows.groupBy("part").agg(F.max_by(own, "at").alias("_l"))
    edge = last.select("part", F.lag("_l").over(Window.orderBy("part")).alias("_edge"))  # a row for each range
    inside = F.lag(own).over(Window.partitionBy("part").orderBy("at"))
    return rows.join(edge, "part").withColumn(name, F.coalesce(inside, F.col("_edge"))).drop("_edge")


def numbered(df: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    """Adds the exclusive running sum of value in the order of key."""
    return running(in_order(df, key), value, name).drop("part", "at")


def stream_nodes(streams: DataFrame) -> DataFrame:
    """Nodes of contents that no file system holds (name, size): files of mode 0644 that belong to user 0."""
    long = lambda x: F.lit(x).cast("long")
    return streams.select(F.col("name").alias("path"), F.lit("file").alias("kind"), long(0o100644).alias("mode"), long(0).alias("uid"), long(0).alias("gid"), F.col("size").cast("long").alias("size"))


class Archive:
    """Collects trees and streams, then makes them one tree.

    One directory alone becomes the root itself; anything else goes under a
    virtual root, each part by its own name.
    """

    def __init__(self) -> None:
        self.parts: list[tuple[str, DataFrame, bool]] = []

    def add_directory(self, nodes: DataFrame, name: str = "") -> "Archive":
        """nodes: a tree with its root ''; name: what it is called under a virtual root."""
        self.parts.append((name, nodes, True))
        return self

    def add_directories(self, named: dict[str, DataFrame]) -> "Archive":
        for name in sorted(named, key=str.encode):
            self.add_directory(named[name], name)
        return self

    def add_files(self, nodes: DataFrame) -> "Archive":
        """Files or links, each called by its path."""
        self.parts.append(("", nodes, False))
        return self

    def add_streams(self, streams: DataFrame) -> "Archive":
        return self.add_files(stream_nodes(streams))

    def compose(self, *columns: str) -> DataFrame:
        """path, kind and the columns of the whole tree (null where a part has none); names must differ."""
        if len(self.parts) == 1 and self.parts[0][2] and not self.parts[0][0]:
            return self.parts[0][1].select("path", "kind", *columns)
        names_ = [n for n, _, is_dir in self.parts if is_dir]
        if "" in names_ or len(set(names_)) < len(names_) or any("/" in n or n in (".", "..") for n in names_):
            raise ValueError("directories under a virtual root need names of their own")
        out: DataFrame | None = None
        for name, nodes, is_dir in self.parts:
            path = F.when(F.col("path") == "", F.lit(name)).otherwise(F.concat(F.lit(name + "/"), "path")) if is_dir else F.col("path")
            part = nodes.select(path.alias("path"), *(c for c in ("kind", *columns) if c in nodes.columns))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError("an archive needs a part")
        return out


def unreadable(nodes: DataFrame) -> DataFrame:
    """path, warning of nodes that an archive can't hold as they are: names that are no names, kinds that are none."""
    name = names.basename(F.col("path"))
    kinds = ("directory", "file", "symlink", "hardlink", "block", "char", "fifo", "socket")
    warning = F.when(~F.col("kind").isin(*kinds), F.concat(F.lit("unsupported kind "), "kind")).when((F.col("path") != "") & ~names.name_valid(name), "bad name").when(F.octet_length(name) > 255, "long name")
    return nodes.select("path", warning.alias("warning")).where("warning is not null")
