import os

import pytest

from moraine.functions import chunking
from moraine.sources import archives
from moraine.sources.fstree import FsTree
from moraine.sources.store import Datastore
from moraine.streaming import incremental


def test_tree_source(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub" / "inner").mkdir(parents=True)
    (root / "b.txt").write_text("hello")
    (root / "sub" / "data.bin").write_bytes(b"\0" * 40)
    os.symlink("../b.txt", root / "sub" / "link")
    os.link(root / "b.txt", root / "sub" / "hard")
    (root / "cache").mkdir()
    (root / "cache" / "x.tmp").write_text("x")
    spark.dataSource.register(FsTree)
    df = spark.read.format("fstree").option("path", str(root)).option("exclude", "cache/\n*.bin").load()
    got = {r.path: r for r in df.collect()}
    assert set(got) == {"", "b.txt", "sub", "sub/inner", "sub/link", "sub/hard"}
    assert got["b.txt"].ino == got["sub/hard"].ino and got["b.txt"].nlink == 2 and got["sub/link"].link_target == "../b.txt"


def test_store_and_stream(spark, tmp_path):
    store = Datastore(spark, f"file://{tmp_path}/store")
    texts = [("s", b"first text " * 500), ("t", b"second text " * 400)]
    df = spark.createDataFrame(texts, "stream_id string, data binary")
    chunks = incremental.chunks_with_data(df, 256)
    one = {r.stream_id: r for r in store.commit(("n", "host", "h", 1), chunks).collect()}
    assert one["s"].size == len(texts[0][1]) and one["s"].new_chunks + one["s"].reused_chunks == one["s"].chunk_count
    two = store.commit(("n", "host", "h", 2), chunks).collect()
    assert sum(r.new_chunks for r in two) == 0 and len(two) == 2
    with pytest.raises(ValueError):
        store.commit(("n", "host", "h", 2), chunks)
    assert store.previous("n", "host", "h", 2) == ("n", "host", "h", 1) and store.previous("n", "host", "h", 1) is None
    back = b"".join(bytes(r.data) for r in store.read_stream(("n", "host", "h", 2), "s").orderBy("seq").collect())
    assert back == texts[0][1]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        incremental.snapshot_stream(stream, store, "m", "live", f"{tmp_path}/cp", 256).awaitTermination()
    live = store.snapshots().where("ns = 'm'").collect()
    assert len(live) == 1
    assert store.entries(("m", "host", "live", live[0].time)).count() == chunks.count()
    assert chunking.chunk_streams(df, 256).count() == chunks.count()


def test_one_file_and_warnings(spark, tmp_path):
    (tmp_path / "f.txt").write_text("hello")
    spark.dataSource.register(FsTree)
    one = spark.read.format("fstree").option("file", "true")
    got = one.option("path", str(tmp_path / "f.txt")).option("as", "name.txt").load().collect()
    assert [(r.path, r.kind, r.size, r.warning, r.quota_id) for r in got] == [("name.txt", "file", 5, None, None)]
    with pytest.raises(Exception, match="(?i)directory"):
        one.option("path", str(tmp_path)).load().collect()


def test_extras_of_an_archive_come_back(spark):
    acl = {"users": [{"id": 7, "perm": 5}], "groups": [], "group_obj": 4, "default": {"user_obj": 7, "group_obj": 5, "other": 0, "mask": None}, "default_users": [], "default_groups": [{"id": 3, "perm": 1}]}
    stat = {"uid": 1, "gid": 2, "mtime_secs": 3, "mtime_nanos": 4}
    nodes = [{"path": "", "kind": "directory", "mode": 0o40755, **stat}, {"path": "d", "kind": "char", "mode": 0o20600, "rdev": [5, 1], **stat}]
    nodes.append({"path": "f", "kind": "file", "mode": 0o100644, "data": b"x", "xattrs": [{"name": "user.a", "value": b"\0b"}], "acl": acl, "fcaps": b"caps", "quota_id": 9, **stat})
    meta, payload = archives.encode(nodes, 2)
    got = {r.path: r for r in archives.decode_many(spark.createDataFrame([("a", meta, payload)], "archive string, meta binary, payload binary")).collect()}
    f = got["f"].asDict(recursive=True)
    assert f["acl"] == acl and [(x["name"], bytes(x["value"])) for x in f["xattrs"]] == [("user.a", b"\0b")] and bytes(f["fcaps"]) == b"caps" and f["quota_id"] == 9 and bytes(f["data"]) == b"x"
    assert got["d"].rdev == [5, 1] and got["d"].acl is None


def test_a_failed_commit_leaves_no_trace(spark, tmp_path, monkeypatch):
    store = Datastore(spark, f"file://{tmp_path}/s'tore")
    df = spark.createDataFrame([("s", b"some text " * 300, "m1"), ("t'", b"other text " * 300, "m2")], "stream_id string, data binary, meta string")
    append = store.append

    def fails(name, rows):
        if name == "snapshots":
            raise OSError("lost")
        append(name, rows)

    monkeypatch.setattr(store, "append", fails)
    with pytest.raises(OSError):
        store.snapshot(("n'", "host", "h", 1), df, 256)
    monkeypatch.setattr(store, "append", append)
    one = store.snapshot(("n'", "host", "h", 1), df, 256).collect()
    assert sum(r.new_chunks for r in one) > 0 and len(one) == 2
    assert store.table("manifest_files").count() == 2 and store.entries(("n'", "host", "h", 1)).count() == sum(r.chunk_count for r in one)
    later = df.where("stream_id = 's'").unionByName(spark.createDataFrame([("t'", b"other text " * 300 + b"more", "m3")], df.schema))
    two = {r.stream_id: r for r in store.snapshot(("n'", "host", "h", 2), later, 256).collect()}
    assert two["s"].new_chunks == 0 and two["s"].chunk_count == {r.stream_id: r for r in one}["s"].chunk_count and 0 < two["t'"].new_chunks < two["t'"].chunk_count
    back = b"".join(bytes(r.data) for r in store.read_stream(("n'", "host", "h", 2), "s").orderBy("seq").collect())
    assert back == b"some text " * 300
