"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, names, patterns
from ..operators import browse, dedup, layout, reuse, snapshots, tree, verify
from ..sources import archives, formats
from ..sources.staging import staged
from . import model as m

Query = Callable[[SparkSession, str], DataFrame]
AVG, SPAN = 1024, 4096
#: Documents of one archive or catalog of the format queries.
GROUP = 64
#: The key of the signature queries and its name.
KEY, KEY_NAME = b"a key for the driver's tables", "own"

#: Pattern lists of the pattern queries, over the documents' paths.
PATTERN_LISTS = {
    "pattern_literal": ["d7.txt", "/src1/en", "en/d11.txt"],
    "pattern_glob": ["d1*.txt", "/src?/e*", "*5.txt"],
    "pattern_doublestar": ["src1/**/d*1.txt", "/src2/**", "**/fr/*"],
    "pattern_class": ["d[0-3]*.txt", "[^a-z]*", "src[!1]", "d[]9]*"],
    "pattern_dironly": ["en/", "d2*/", "/src3/"],
    "pattern_last_wins": ["*.txt", "!d*1.txt", "d*11.txt", "!/src0/**"],
}
OUTER = ["d*7.txt", "/src2/de", "!d*77.txt"]
PRUNE = ["de/", "!src1/de", "/src2", "!/src2/en/*", "d*3.txt", "!d*13.txt"]


def prev_chunks(prev: DataFrame) -> DataFrame:
    """The previous snapshot's payload in chunks of SPAN bytes."""
    end = prev.agg(F.max(F.col("payload_offset") + 16 + F.col("size")).alias("n"))
    return end.where("n is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SPAN))).alias("seq"), "n").select("seq", (F.col("seq") * SPAN).alias("start_offset"), F.least(F.col("n"), (F.col("seq") + 1) * SPAN).alias("end_offset"))


def run_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The second snapshot's files in runs, and the first one's payload."""
    prev = staged(m.payload(m.nodes(spark, sf)), "payload")
    cur = m.nodes(spark, sf, 2).where("kind = 'file'").select("path", "meta", "size")
    cur = tree.in_order(cur, tree.walk_key(F.col("path")))
    return staged(reuse.runs(reuse.changed_files(cur, prev)), "runs"), prev


def covered_runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, prev = run_rows(spark, sf)
    return rows, staged(reuse.coverage(rows, prev_chunks(prev), SPAN), "coverage")


def pattern_query(texts: list[str], spark: SparkSession, sf: str) -> DataFrame:
    n = m.nodes(spark, sf)
    return n.where("path <> ''").select("path", patterns.excluded(patterns.parse_all(texts), F.col("path"), F.col("kind") == "directory").alias("excluded"))


def scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Exclude lines in some directories: scope_dir, line_no, include, dir_only, regex."""
    rows = [("src0", 0, "d*2.txt"), ("src0", 1, "!d*22.txt"), ("src0/en", 0, "/d1*.txt"), ("src1", 0, "fr/"), ("", 0, "*9.txt"), ("src1/en", 0, "  # nothing"), ("src1/en", 1, " !*9.txt\r")]
    parsed = tree.parse_exclude_lines(spark.createDataFrame(rows, "scope_dir string, line_no int, line string"))
    made = []
    for r in parsed.collect():  # exclude lines, not data: one expression each
        body = f"{r.scope_dir}/{r.body}" if r.anchored and r.scope_dir else r.body
        made.append((r.scope_dir, r.line_no, r.include, r.dir_only, patterns.Pattern(body, r.anchored).regex))
    return spark.createDataFrame(made, "scope_dir string, line_no int, include boolean, dir_only boolean, regex string")


def scoped_exclude_hardlinks(spark: SparkSession, sf: str) -> DataFrame:
    """Outer patterns and exclude lines as one list, links made of what is left."""
    left = tree.prune_scoped(m.nodes(spark, sf, links=False), scoped(spark, sf), OUTER)
    return tree.hardlink_targets(left).select("path", "kind", "link_target")


def labelled_out(spark: SparkSession, sf: str) -> DataFrame:
    """A further predicate: documents labelled toxic are left out."""
    toxic = m.table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return m.documents(spark, sf).join(toxic, "doc_id", "left_anti").select("path")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """All paths, the same with an ending that none has, and the directories of one language."""
    d = m.documents(spark, sf)
    return d.select("path").unionByName(d.select(F.concat("path", F.lit(".missing")).alias("path"))).unionByName(d.where("lang = 'en'").select(F.col("dir").alias("path")))


def symlinks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and links beside them: to a neighbour, to another link, outside, in a loop."""
    d = m.documents(spark, sf)
    files = d.select("path", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("link_target"))
    k = F.col("doc_id") % 6
    link = F.when(k == 0, F.concat(F.lit("d"), "doc_id", F.lit(".txt"))).when(k == 1, F.concat(F.lit("../"), "lang", F.lit("/l"), F.col("doc_id"), F.lit(".x"))).when(k == 2, F.lit("/etc/none")).when(k == 3, F.lit("../../../up")).when(k == 4, F.concat(F.lit("l"), "doc_id")).otherwise(F.lit("./missing"))
    links = d.select(F.concat("dir", F.lit("/l"), "doc_id").alias("path"), F.lit("symlink").alias("kind"), link.alias("link_target"))
    more = d.where("doc_id % 6 = 1").select(F.concat("dir", F.lit("/l"), "doc_id", F.lit(".x")).alias("path"), F.lit("symlink").alias("kind"), F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("link_target"))
    return files.unionByName(links).unionByName(more)


def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return m.nodes(spark, sf).select("path", "kind", "mode", "uid", "gid", "mtime_secs", "size", "nlink", "link_target")


def tree_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return tree.ancestry(m.nodes(spark, sf))


def tree_totals(spark: SparkSession, sf: str) -> DataFrame:
    return m.nodes(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def virtual_root(spark: SparkSession, sf: str) -> DataFrame:
    a = m.documents(spark, sf).select(F.lit("docs").alias("root"), "path")
    b = m.page_nodes(spark, sf).select(F.lit("pages").alias("root"), "path")
    both = tree.virtual_root(a.unionByName(b))
    return both.groupBy(F.split("path", "/")[0].alias("root")).agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


def hardlink_targets(spark: SparkSession, sf: str) -> DataFrame:
    return m.nodes(spark, sf).where("kind = 'hardlink'").select("path", "link_target")


def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    p = m.page_nodes(spark, sf).withColumn("path", F.concat_ws("/", F.split("path", "/")[0], F.concat(F.lit("p"), F.col("page_id") % 7)))
    return tree.duplicate_names(p)


def prune_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return tree.prune(m.nodes(spark, sf), PRUNE).select("path")


def on_exclude_audit(spark: SparkSession, sf: str) -> DataFrame:
    return tree.exclude_audit(m.nodes(spark, sf), PRUNE).select("path")


def scoped_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return tree.prune_scoped(m.nodes(spark, sf), scoped(spark, sf)).select("path")


def covered_paths(spark: SparkSession, sf: str) -> DataFrame:
    return tree.covered(asked(spark, sf))


def valid_names(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return m.page_nodes(spark, sf).select("page_id", names.path_valid(p).alias("path_ok"), names.name_valid(names.basename(p)).alias("name_ok"), names.windows_name_valid(names.basename(p)).alias("windows_ok"), names.basename(p).alias("name"), names.parent(p).alias("parent"), names.depth(p).alias("depth"))


def index_names(spark: SparkSession, sf: str) -> DataFrame:
    n = m.table(spark, sf, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "_"), F.element_at(F.array(*map(F.lit, ("", ".pxar", ".didx", ".mpxar.didx", ".ppxar"))), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("n"))
    return n.select("p_partkey", names.index_name(F.col("n")).alias("index_name"), names.split_stem(F.col("n")).alias("stem"))


def metadata_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return m.nodes(spark, sf).select("path", "meta_size", layout.open_size(1).cast("long").alias("v1_bytes"), layout.open_size(2).cast("long").alias("v2_bytes"))


def estimate_v1(spark: SparkSession, sf: str) -> DataFrame:
    return layout.estimate(m.nodes(spark, sf), 1)


def estimate_v2(spark: SparkSession, sf: str) -> DataFrame:
    return layout.estimate(m.nodes(spark, sf), 2)


def v1_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return layout.positions(m.nodes(spark, sf), 1).select("path", "phase", "start", "bytes")


def v2_payload_refs(spark: SparkSession, sf: str) -> DataFrame:
    return m.payload(m.nodes(spark, sf)).select("path", "payload_offset", "size")


def dir_spans(spark: SparkSession, sf: str) -> DataFrame:
    return layout.spans(m.nodes(spark, sf), 2)


def hardlink_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return layout.hardlink_offsets(m.nodes(spark, sf), 1)


def subtree_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return layout.subtree_sizes(m.nodes(spark, sf))


def wide_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as directories, lines as files: sizes of each order's directory."""
    line = m.table(spark, sf, "lineitem")
    return line.groupBy(F.concat(F.lit("o"), "l_orderkey").alias("path")).agg(F.count("*").alias("n_children"), names.goodbye_size(F.count("*")).alias("table_bytes"), F.sum(names.string_size(F.concat(F.lit("l"), "l_linenumber")) + names.ENTRY).alias("open_bytes"))


def cdc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = m.documents(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("stream_id"), F.encode("text", "utf-8").alias("data"))
    return chunking.chunk_streams(d, AVG)


def cdc_bounds_check(spark: SparkSession, sf: str) -> DataFrame:
    return verify.tiling(cdc_chunks(spark, sf), AVG // 4, AVG * 4)


def cdc_size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return cdc_chunks(spark, sf).groupBy(F.floor(F.col("size") / 256).alias("cell")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def cdc_new_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """What the second snapshot adds to the first."""
    d = m.documents(spark, sf, 2).select(F.concat(F.lit("d"), "doc_id").alias("stream_id"), F.encode("text", "utf-8").alias("data"))
    marked = dedup.mark_new(chunking.chunk_streams(d, AVG), cdc_chunks(spark, sf))
    return dedup.upload_stats(marked)


def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return m.chunks(spark, sf)


def dedup_intra(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.mark_new(m.chunks(spark, sf)).select("stream_id", "seq", "digest", "is_new")


def dedup_previous(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.mark_new(m.chunks(spark, sf, 2), m.chunks(spark, sf)).select("stream_id", "seq", "is_new")


def upload_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.upload_stats(dedup.mark_new(m.chunks(spark, sf, 2), m.chunks(spark, sf)))


def index_entries(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.starts(m.chunks(spark, sf)).select("stream_id", "seq", "start", "end_offset", "ascending", "digest")


def index_checksum(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.index_checksum(m.chunks(spark, sf))


def index_batches(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.batches(m.chunks(spark, sf), 4)


def progress_running(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.progress(m.chunks(spark, sf))


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.stored(m.chunks(spark, sf))


def known_set(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.known_set(m.chunks(spark, sf), m.chunks(spark, sf, 2))


def common_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.common(m.chunks(spark, sf), m.chunks(spark, sf, 2))


def inject_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Even blocks come as injected chunks, odd ones as data."""
    c = m.chunks(spark, sf)
    frames = c.where("seq % 2 = 0").select("stream_id", F.col("seq").alias("frame"), F.lit("inject").alias("kind"), F.array(F.struct("digest", "size")).alias("inject"))
    data = c.where("seq % 2 = 1").select("stream_id", F.col("seq").alias("frame"), F.lit(0).alias("seq"), "size", "digest")
    return dedup.inject(frames, data)


def list_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return m.snapshots(spark, sf).groupBy("ns", "type").agg(F.count_distinct("id").alias("n_groups"), F.count("*").alias("n"), F.max("time").alias("newest"))


def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.latest(m.snapshots(spark, sf))


def previous_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.previous(m.snapshots(spark, sf))


def snapshot_as_of(spark: SparkSession, sf: str) -> DataFrame:
    s = m.snapshots(spark, sf)
    asks = s.select("ns", "type", "id", (F.col("time") + F.col("event_id") % 3600).alias("at"))
    return snapshots.as_of(asks, s)


def list_groups(spark: SparkSession, sf: str) -> DataFrame:
    files = m.manifest_files(spark, sf)
    return snapshots.groups(files.select("ns", "type", "id", "time"), files)


def format_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.formats(m.manifest_files(spark, sf))


def commit_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.conflicts(m.manifest_files(spark, sf))


def namespaces(spark: SparkSession, sf: str) -> DataFrame:
    s = m.snapshots(spark, sf).select(F.concat_ws("/", "ns", "type", "id").alias("ns"))
    return snapshots.namespaces(s, "click").unionByName(snapshots.namespaces(s))


def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return run_rows(spark, sf)[0].select("path", "unchanged", "payload_offset")


def reuse_runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_rows(spark, sf)[0].select("path", "seq", "unchanged", "run_id")


def run_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return covered_runs(spark, sf)[1]


def reuse_plan(spark: SparkSession, sf: str) -> DataFrame:
    rows, cover = covered_runs(spark, sf)
    return reuse.plan(rows, reuse.decide(cover, 0.5)).drop("part", "at")


def reuse_offsets(spark: SparkSession, sf: str) -> DataFrame:
    rows, cover = covered_runs(spark, sf)
    return reuse.offsets(reuse.plan(rows, reuse.decide(cover, 0.5)))


def reuse_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows, cover = covered_runs(spark, sf)
    decided = reuse.decide(cover, 0.5)
    return reuse.stats(reuse.plan(rows, decided), decided)


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    cover = covered_runs(spark, sf)[1]
    grid = cover.withColumn("threshold", F.explode(F.array(*(F.lit(x) for x in (0.05, 0.1, 0.25, 0.5, 0.9)))))
    fits = (F.col("c_end") >= F.col("run_end")) & (F.col("total") >= F.col("used")) & ((F.col("total") - F.col("used")) / F.col("total") <= F.col("threshold"))
    return grid.groupBy("threshold").agg(F.sum(fits.cast("long")).alias("reused_runs"), F.sum(F.when(fits, F.col("n_files")).otherwise(0)).alias("reused_files"))


def readdir_page(spark: SparkSession, sf: str) -> DataFrame:
    return browse.read_dir(m.nodes(spark, sf), 5, 2)


def lookup_path(spark: SparkSession, sf: str) -> DataFrame:
    return browse.look_up(m.nodes(spark, sf), asked(spark, sf).distinct())


def resolve_hardlink(spark: SparkSession, sf: str) -> DataFrame:
    return browse.resolve_hardlinks(m.nodes(spark, sf))


def resolve_symlink(spark: SparkSession, sf: str) -> DataFrame:
    return browse.resolve_symlinks(symlinks(spark, sf))


def read_range(spark: SparkSession, sf: str) -> DataFrame:
    d = m.documents(spark, sf)
    ranges = d.select(F.col("doc_id").alias("range_id"), F.concat(F.lit("d"), "doc_id").alias("stream_id"), (F.col("doc_id") % 700).alias("a"), (F.col("doc_id") % 700 + 900).alias("b"))
    return browse.read_ranges(ranges, m.chunks(spark, sf), m.BLOCK)


def restore_selection(spark: SparkSession, sf: str) -> DataFrame:
    return browse.select_paths(m.nodes(spark, sf), tree.covered(asked(spark, sf))).select("path", "kind")


def tree_diff(spark: SparkSession, sf: str) -> DataFrame:
    return tree.tree_diff(m.nodes(spark, sf), m.nodes(spark, sf, 2))


def verify_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of indexes against a manifest and a store with some wrong entries."""
    c = m.chunks(spark, sf)
    manifest = dedup.index_checksum(c).select("stream_id", F.when(F.substring("stream_id", -1, 1) == "3", F.lit("0")).otherwise(F.col("checksum")).alias("csum"), (F.col("size") + F.when(F.substring("stream_id", -1, 1) == "4", 1).otherwise(0)).alias("size"))
    store = c.where("substring(digest, 1, 2) <> '7f'").groupBy("digest").agg(F.max("size").alias("size"))
    return verify.verify(c, manifest, store)


def dangling_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = m.chunks(spark, sf)
    return verify.dangling(c, c.where("substring(digest, 1, 1) <> '7'").select("digest"))


def tampered_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = m.documents(spark, sf)
    data = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    store = d.select(F.when(F.col("doc_id") % 8 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"), F.encode(data, "utf-8").alias("data"))
    return verify.tampered(store).groupBy("digest", "problem").agg(F.count("*").alias("n"))


def preludes(spark: SparkSession, sf: str) -> DataFrame:
    return m.documents(spark, sf).select("doc_id", F.sha2(names.prelude_json(F.col("text")), 256).alias("digest"))


def declared_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Contents cut or filled up to a declared size, with what is to be told about it."""
    size, actual = (F.col("doc_id") % 40) * 50, F.octet_length("text").cast("long")
    d = m.documents(spark, sf).select("doc_id", size.alias("size"), actual.alias("actual"), F.hex(names.sized(F.encode("text", "utf-8"), size)).alias("h"))
    return d.select("doc_id", "size", (F.length("h") / 2).cast("long").alias("written"), F.sha2("h", 256).alias("digest"), names.size_warning(F.col("actual"), F.col("size")).alias("warning"))


def snapshot_paths(spark: SparkSession, sf: str) -> DataFrame:
    s = m.snapshots(spark, sf)
    return s.select("event_id", names.snapshot_path(F.col("type"), F.col("id"), F.col("time")).alias("path"), names.comment(F.concat("ns", F.lit("\nmore"))).alias("comment"))


def blob_names(spark: SparkSession, sf: str) -> DataFrame:
    n = m.table(spark, sf, "part").select("p_partkey", F.element_at(F.array(F.lit(""), F.lit("index.json"), F.lit("a/b"), F.col("p_name"), F.concat("p_name", F.lit(".blob"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("n"))
    return n.select("p_partkey", names.blob_name(F.col("n")).alias("blob_name"))


def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return m.documents(spark, sf).select("doc_id", names.colon_hex(F.sha2(F.concat(F.sha2("path", 256), F.lit("key")), 256)).alias("fingerprint"), F.sha2(F.concat("text", F.lit("key")), 256).alias("keyed_digest"))


def reserved_children(spark: SparkSession, sf: str) -> DataFrame:
    """The tree without the reserved child of its root; deeper ones stay."""
    p = m.documents(spark, sf).select(F.when(F.col("doc_id") % 9 == 0, ".pxarexclude-cli").when(F.col("doc_id") % 9 == 1, F.concat("dir", F.lit("/.pxarexclude-cli"))).otherwise(F.col("path")).alias("path"))
    return p.where(~names.reserved_child(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


def restore_order(spark: SparkSession, sf: str) -> DataFrame:
    return browse.restore_steps(m.nodes(spark, sf))


def restore_copies(spark: SparkSession, sf: str) -> DataFrame:
    """A restore of all hardlinks and of one language's directories."""
    n = m.nodes(spark, sf)
    some = n.where("kind = 'hardlink'").select("path").unionByName(m.documents(spark, sf).where("lang = 'de'").select(F.col("dir").alias("path")))
    return browse.copies(n, some)


def listing_filter(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.matching(m.snapshots(spark, sf), "vm", "u7").select("event_id", "ns", "time")


def newest_first(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.newest_first(m.snapshots(spark, sf), "event_id").select("event_id", "place")


def listing_order(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.in_listing_order(m.snapshots(spark, sf))


def unclosed_indexes(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.open_at_commit(m.snapshots(spark, sf).withColumn("closed", F.col("value") >= 1))


def authorised_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A session for each source opens its English documents' indexes and asks for all chunks of all its documents."""
    d = m.documents(spark, sf).select(F.split("dir", "/")[0].alias("session"), "lang", F.concat(F.lit("d"), "doc_id").alias("stream_id"))
    c = staged(m.chunks(spark, sf), "chunks")
    wanted = d.join(c, "stream_id").select("session", "digest").distinct()
    return snapshots.authorised(wanted, d.where("lang = 'en'").select("session", "stream_id"), c)


def blob_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return verify.blob_records(m.blobs(spark, sf))


def verify_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Blobs against a manifest with wrong sizes, wrong sums, missing and unlisted ones."""
    listed = verify.blob_records(m.blobs(spark, sf)).where("page_id % 11 <> 0")
    size = F.col("size") + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0)
    csum = F.when(F.col("page_id") % 5 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("csum"))
    return verify.blobs(m.blobs(spark, sf).where("page_id % 13 <> 0"), listed.withColumn("size", size).withColumn("csum", csum), "page_id", "filename")


def manifest_identity(spark: SparkSession, sf: str) -> DataFrame:
    s = m.snapshots(spark, sf)
    k = F.col("event_id") % 9
    found = s.select("event_id", "type", "id", "time", F.when(k == 1, "host").otherwise(F.col("type")).alias("m_type"), F.when(k == 2, F.lit(None)).otherwise(F.col("id")).alias("m_id"), (F.col("time") + F.when(k == 3, 1).otherwise(0)).alias("m_time"))
    return verify.identity(found).select("event_id", "same")


def manifest_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests signed rightly, with another key, over another text, or not."""
    canonical = F.concat(F.lit('{"backup-id":"'), "id", F.lit('","backup-time":'), "time", F.lit(',"backup-type":"'), "type", F.lit('"}'))
    s = m.snapshots(spark, sf).select("event_id", canonical.alias("canonical"))
    k = F.col("event_id") % 6
    own = verify.hmac_sha256(F.col("canonical"), KEY)
    signed = s.withColumn("signature", F.when(k == 0, F.lit(None)).when(k == 1, verify.hmac_sha256(F.col("canonical"), b"other")).when(k == 2, verify.hmac_sha256(F.concat("canonical", F.lit(" ")), KEY)).otherwise(own))
    signed = signed.withColumn("key_fingerprint", F.when(k == 3, F.lit("other")).when(k == 4, F.lit(None)).otherwise(F.lit(KEY_NAME)))
    return verify.signatures(signed, KEY, KEY_NAME).select("event_id", "signature", "verdict")


def chunk_content(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as chunks, against a store in which some are lost, cut or changed."""
    d = m.documents(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("stream_id"), F.lit(0).alias("seq"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("digest"), "text")
    first = F.substring("digest", 1, 1)
    data = F.when(first == "1", F.concat("text", F.lit("x"))).when(first == "2", F.translate("text", "e", "i")).otherwise(F.col("text"))
    return verify.chunk_bytes(d.drop("text"), d.where(first != "0").select("digest", F.encode(data, "utf-8").alias("data")))


def estimate_check(spark: SparkSession, sf: str) -> DataFrame:
    n = m.nodes(spark, sf)
    return verify.estimate_holds(n, 1).withColumn("version", F.lit(1)).unionByName(verify.estimate_holds(n, 2).withColumn("version", F.lit(2)))


def children_inside(spark: SparkSession, sf: str) -> DataFrame:
    return layout.inside(m.nodes(spark, sf))


def directory_items(spark: SparkSession, sf: str) -> DataFrame:
    return layout.directory_items(m.nodes(spark, sf), 1)


def root_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and pages as named directories beside streams of the benchmark's texts."""
    docs = m.nodes(spark, sf).select("path", "kind", "size")
    pages = m.page_nodes(spark, sf).select("path", "kind")
    streams = m.table(spark, sf, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("name"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    return tree.Archive().add_directories({"pages": pages, "docs": docs}).add_streams(streams).compose("size")


def stream_nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = m.table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("name"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    return tree.stream_nodes(p)


def node_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings as rows: pages whose addresses make no names, and kinds that no archive holds."""
    p = m.page_nodes(spark, sf)
    kind = F.when(F.col("page_id") % 8 == 0, "door").otherwise(F.col("kind"))
    name = F.when(F.col("page_id") % 9 == 0, F.concat("path", F.lit("/.."))).when(F.col("page_id") % 9 == 1, F.concat("path", F.repeat(F.lit("x"), 256))).otherwise(F.col("path"))
    return tree.unreadable(p.select(name.alias("path"), kind.alias("kind"))).groupBy("warning").agg(F.count("*").alias("n"))


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    """The documents dealt to archives of GROUP files at most."""
    return m.documents(spark, sf).withColumn("archive", F.concat(F.lit("a"), F.floor(F.col("doc_id") / GROUP)))


def written(spark: SparkSession, sf: str, version: int) -> DataFrame:
    none = F.lit(None)
    n = grouped(spark, sf).select("archive", "path", F.lit("file").alias("kind"), F.lit(33188).cast("long").alias("mode"), (F.col("doc_id") % 3).alias("uid"), F.lit(0).cast("long").alias("gid"), "mtime_secs", F.lit(0).alias("mtime_nanos"), none.cast("string").alias("link_target"), F.array(F.struct(F.lit("user.lang").alias("name"), F.encode("lang", "utf-8").alias("value"))).alias("xattrs"), F.encode("text", "utf-8").alias("data"))
    return formats.write_archives(n, version)


def archive_entries(spark: SparkSession, sf: str, version: int) -> DataFrame:
    """Archives of the documents, written and decoded."""
    n = archives.decode_many(written(spark, sf, version))
    return n.select("archive", "path", "kind", "mode", "uid", "mtime_secs", "size", "payload_offset", F.decode(F.get("xattrs", F.lit(0))["value"], "utf-8").alias("attribute"), F.sha2("data", 256).alias("digest"))


def archive_v1_entries(spark: SparkSession, sf: str) -> DataFrame:
    return archive_entries(spark, sf, 1)


def archive_v2_entries(spark: SparkSession, sf: str) -> DataFrame:
    return archive_entries(spark, sf, 2)


def archive_refs_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Archives whose metadata alone is decoded, against the lengths of their payloads."""
    a = staged(written(spark, sf, 2), "archives")
    n = staged(archives.decode_many(a, metadata_only=True).select("archive", "path", "kind", "size", "payload_offset"), "entries")
    bad = formats.unresolved(n, a.select("archive", F.octet_length("payload").alias("n"))).groupBy("archive").agg(F.count("*").alias("bad"))
    files = n.where("kind = 'file'").groupBy("archive").agg(F.count("*").alias("n_files"))
    return files.join(bad, "archive", "left").select("archive", "n_files", F.col("bad").isNull().alias("ok"))


def catalog_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogs of the documents, written and decoded."""
    rows = grouped(spark, sf).select(F.col("archive").alias("name"), F.col("doc_id").alias("seq"), "path", F.lit("f").alias("letter"), F.octet_length("text").cast("long").alias("size"), F.col("mtime_secs").alias("mtime"))
    return formats.read_catalogs(formats.write_catalogs(rows)).drop("seq")


def index_records(spark: SparkSession, sf: str) -> DataFrame:
    """Index files of the documents' chunks, written and parsed."""
    return formats.read_indexes(formats.write_indexes(m.chunks(spark, sf).withColumnRenamed("stream_id", "name")))


def frame_records(spark: SparkSession, sf: str) -> DataFrame:
    """Frame streams in which even chunks are injected and odd ones come as data."""
    c = m.chunks(spark, sf, with_data=True).withColumnRenamed("stream_id", "name")
    even = F.col("seq") % 2 == 0
    rows = c.select("name", "seq", F.when(even, "inject").otherwise("data").alias("kind"), F.when(~even, F.col("data")).alias("data"), F.when(even, F.col("digest")).alias("digest"), "size")
    return formats.read_frames(formats.write_frames(rows)).select("name", "seq", "kind", F.coalesce("digest", F.sha2("data", 256)).alias("digest"), "size")


def blob_records(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as blobs, framed and decoded."""
    plain = m.blobs(spark, sf).select(F.concat(F.lit("p"), "page_id").alias("name"), F.col("encoded").alias("data"))
    return formats.read_blobs(formats.write_blobs(plain)).select("name", "size", F.sha2("data", 256).alias("digest"))


NAMED = (
    archive_v1_entries, archive_v2_entries, archive_refs_resolve, catalog_entries, index_records, frame_records, blob_records,
    scoped_exclude_hardlinks,
    restore_order, restore_copies, listing_filter, newest_first, listing_order, unclosed_indexes, authorised_chunks, blob_uploads, verify_blobs, manifest_identity, manifest_signatures, chunk_content,
    estimate_check, children_inside, directory_items, root_composition, stream_nodes, node_warnings,
    preludes, declared_sizes, snapshot_paths, blob_names, fingerprints, reserved_children,
    tree_nodes, tree_ancestors, tree_totals, virtual_root, hardlink_targets, duplicate_names, prune_subtree, on_exclude_audit, scoped_exclude, labelled_out, covered_paths, valid_names, index_names,
    metadata_sizes, estimate_v1, estimate_v2, v1_offsets, v2_payload_refs, dir_spans, hardlink_offsets, subtree_sizes, wide_tree,
    cdc_chunks, cdc_bounds_check, cdc_size_histogram, cdc_new_bytes, fixed_chunks, dedup_intra, dedup_previous, upload_stats, index_entries, index_checksum, index_batches, progress_running, stored_chunks, known_set, common_chunks, inject_frames,
    list_snapshots, latest_snapshot, previous_snapshot, snapshot_as_of, list_groups, format_resolution, commit_conflicts, namespaces,
    changed_files, reuse_runs, run_coverage, reuse_plan, reuse_offsets, reuse_stats, threshold_sweep,
    readdir_page, lookup_path, resolve_hardlink, resolve_symlink, read_range, restore_selection, tree_diff, verify_snapshot, dangling_chunks, tampered_chunks,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMED} | {k: partial(pattern_query, v) for k, v in PATTERN_LISTS.items()}
