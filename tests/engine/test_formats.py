"""Encodings, chunking and patterns against known values and invariants."""

import hashlib
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.functions import chunking, codecs, patterns
from moraine.sources import archives

NUMBERS = {0: "00", 127: "7f", 128: "8001", 300: "ac02", 16383: "ff7f", 16384: "808001", (1 << 64) - 1: "ffffffffffffffffff01"}
SIGNED = {0: "00", 1: "01", 100: "64", -1: "8100", -100: "e400", -300: "ac8200"}


def test_varints():
    for v, h in NUMBERS.items():
        assert codecs.varint(v).hex() == h and codecs.read_varint(bytes.fromhex(h)) == (v, len(h) // 2)
    for v, h in SIGNED.items():
        assert codecs.signed_varint(v).hex() == h and codecs.read_varint(bytes.fromhex(h), signed=True) == (v, len(h) // 2)
    with pytest.raises(codecs.FormatError):
        codecs.read_varint(b"\x80" * 12)


def test_siphash_reference_vector():
    key = bytes(range(16))
    k0, k1 = int.from_bytes(key[:8], "little"), int.from_bytes(key[8:], "little")
    assert codecs.siphash24(bytes(range(15)), k0, k1) == 0xA129CA6149BE45E5


@given(st.integers(0, 200))
def test_search_tree_order(n):
    order = codecs.bst_order(n)
    assert sorted(order) == list(range(n))
    for i, r in enumerate(order):
        for child, sign in ((2 * i + 1, -1), (2 * i + 2, 1)):
            if child < n:
                assert (order[child] - r) * sign > 0


def test_goodbye():
    data = codecs.goodbye([(30, 0, 5), (10, 8, 5), (20, 16, 5)], 0, 100)
    hashes = [int.from_bytes(data[at : at + 8], "little") for at in range(16, len(data), 24)]
    assert len(data) == 112 and hashes == [20, 10, 30, codecs.GOODBYE_TAIL]
    assert len(codecs.goodbye([], 0, 0)) == 40


def test_catalog_bytes():
    data = codecs.encode_catalog([("a/d/g", "f", 300, -1), ("a/d", "d", 0, 0), ("a/f", "f", 5, 100)])
    assert data[:8] == codecs.CATALOG_MAGIC
    assert codecs.decode_catalog(data) == [("a", "d", None, None), ("a/d", "d", None, None), ("a/d/g", "f", 300, -1), ("a/f", "f", 5, 100)]
    for wrong in (b"x" * 40, data[:12], data[:-8] + b"\xff" * 8):
        with pytest.raises(codecs.FormatError):
            codecs.decode_catalog(wrong)


def test_catalog_tables_come_as_directories_close():
    rows = [("a", "d", 0, 0), ("a/x", "d", 0, 0), ("a/x/f", "f", 1, 1), ("b", "d", 0, 0), ("b/g", "f", 2, 2), ("c", "f", 3, 3)]
    data = codecs.encode_catalog(rows)
    inner = b"\x01f\x01f\x01\x01"
    assert data[8:].startswith(bytes([len(inner)]) + inner)  # a/x closes first, then a, b and the root
    assert data.index(b"f\x01f\x01") < data.index(b"d\x01x") < data.index(b"f\x01g\x02") < data.index(b"d\x01a")
    assert [x[0] for x in codecs.decode_catalog(data)] == [x[0] for x in rows]


def test_index_round_trip():
    entries = [(10, hashlib.sha256(b"a").hexdigest()), (25, hashlib.sha256(b"b").hexdigest())]
    data = codecs.render_index(entries)
    assert codecs.parse_index(data) == entries and len(data) == 4096 + 80
    for wrong in (data[:100], b"x" + data[1:], data[:-1]):
        with pytest.raises(codecs.FormatError):
            codecs.parse_index(wrong)


@given(st.binary(max_size=3000))
@settings(max_examples=50)
def test_blob_round_trip(plain):
    assert codecs.decode_blob(codecs.encode_blob(plain)) == plain
    assert len(codecs.encode_blob(plain)) <= len(plain) + 12


def test_blob_errors():
    good = codecs.encode_blob(b"hello" * 100)
    for wrong in (good[:5], b"y" * 40, good[:-1] + b"\0", codecs.BLOB_ENCRYPTED + good[8:]):
        with pytest.raises(codecs.FormatError):
            codecs.decode_blob(wrong)


def test_frames():
    frames = [("data", b"abc", []), ("inject", b"", [("00" * 32, 7), ("ff" * 32, 9)]), ("data", b"x", [])]
    data = codecs.encode_frames([*frames, ("data", b"", [])])
    assert codecs.decode_frames(data) == frames and codecs.encode_frames([]) == b""
    assert codecs.decode_frames(b"plain") == [("data", b"plain", [])]
    with pytest.raises(codecs.FormatError):
        codecs.decode_frames(data[:-1])


def test_canonical_json():
    text = json.dumps({"b": [1, {"z": "é\"\\\n\x01", "a": True}], "a": -3, "signature": "x", "unprotected": None})
    assert codecs.canonical_json(text) == '{"a":-3,"b":[1,{"a":true,"z":"é\\"\\\\\\n\\u0001"}]}'
    for wrong in ('{"a":null}', '{"a":1.5}', '{"a":1e3}', "[]"):
        with pytest.raises(codecs.FormatError):
            codecs.canonical_json(wrong)
    assert codecs.sign(text, b"k" * 32) != codecs.sign(text, b"j" * 32)
    assert len(codecs.fingerprint(b"k" * 32, b"label")) == 95


def test_acl_round_trip():
    raw = codecs.encode_posix_acl([("user_obj", 7, 0), ("user", 4, 1001), ("user", 6, 1000), ("group_obj", 5, 0), ("mask", 6, 0), ("other", 0, 0)])
    acl = codecs.acl_struct(raw, None)
    assert [u["id"] for u in acl["users"]] == [1000, 1001] and acl["group_obj"] == 5 and acl["default"] is None
    assert codecs.acl_struct(None, raw)["default"] == {"user_obj": 7, "group_obj": 5, "other": 0, "mask": 6}
    assert codecs.acl_struct(None, None) is None


def tree():
    d = {"mode": 0o40755, "uid": 0, "gid": 0, "mtime_secs": -5, "mtime_nanos": 7, "kind": "directory"}
    f = d | {"mode": 0o100644, "kind": "file"}
    return [d | {"path": ""}, f | {"path": "b.txt", "data": b"hello"}, d | {"path": "sub"}, f | {"path": "sub/data", "data": b"\0" * 3000, "xattrs": [{"name": "user.a", "value": b"v"}]}, d | {"path": "sub/empty"}, f | {"path": "sub/link", "kind": "symlink", "mode": 0o120777, "link_target": "../b.txt"}, f | {"path": "sub/z", "kind": "hardlink", "link_target": "b.txt"}, f | {"path": "a.fifo", "kind": "fifo", "mode": 0o10644}]


@pytest.mark.parametrize("version", [1, 2])
def test_archive_round_trip(version):
    meta, payload = archives.encode(tree(), version)
    rows = list(archives.decode(meta, payload if version == 2 else None))
    got = {r["path"]: r for r in rows}
    assert [r["path"] for r in rows] == ["", "a.fifo", "b.txt", "sub", "sub/data", "sub/empty", "sub/link", "sub/z"]
    assert got["b.txt"]["data"] == b"hello" and got["sub/data"]["size"] == 3000 and got["sub/link"]["link_target"] == "../b.txt"
    assert got["sub/z"]["payload_offset"] == got["b.txt"]["start"] and got[""]["mtime_secs"] == -5
    with pytest.raises(codecs.FormatError):
        list(archives.decode(meta[:-24]))


def test_archive_layout_equals_bytes(spark):
    from pyspark.sql import functions as F

    from moraine.operators import layout

    nodes = [n for n in tree()]
    rows = [(n["path"], n["kind"], len(n.get("data") or b""), n.get("link_target"), len(codecs.metadata(n))) for n in nodes]
    df = spark.createDataFrame(rows, "path string, kind string, size long, link_target string, meta_size long")
    for version in (1, 2):
        meta, payload = archives.encode(nodes, version)
        at = layout.positions(df, version)
        assert at.agg(F.max(F.col("start") + F.col("bytes"))).first()[0] == len(meta)
        want = {r["path"]: r["start"] for r in archives.decode(meta)}
        assert {r.path: r.start for r in at.where("phase = 0").collect()} == want
        if version == 2:
            assert tuple(layout.estimate(df, 2).first()) == (len(meta), len(payload))


def test_many_archives(spark):
    meta, payload = archives.encode(tree(), 2)
    df = spark.createDataFrame([("x", meta, payload), ("y", meta, payload)], "archive string, meta binary, payload binary")
    assert archives.decode_many(df).where("data is not null").count() == 4
    assert archives.decode_many(df, True).where("data is not null").count() == 0


def plain_ends(data, avg):
    """Chunk ends by the definition, byte by byte."""
    table, out, start, mask = chunking.default_table().tolist(), [], 0, 2 * avg - 1
    for i in range(len(data)):
        h = 0
        for k in range(64):
            if i - k >= 0:
                t, r = table[data[i - k]], k % 32
                h ^= (t << r | t >> (32 - r)) & 0xFFFFFFFF if r else t
        size = i + 1 - start
        if size >= max(avg // 4, 65) and h & mask >= mask - 2 or size == 4 * avg:
            out.append(i + 1)
            start = i + 1
    return out + ([len(data)] if start < len(data) else [])


def test_chunks_equal_the_definition():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 700, 3000):
        data = bytes(rng.randrange(256) for _ in range(n))
        assert chunking.ends(data, 256) == plain_ends(data, 256)
        assert chunking.ends(data, 256, block=100) == plain_ends(data, 256)


@given(st.binary(max_size=6000), st.lists(st.integers(1, 900), min_size=1, max_size=20))
@settings(max_examples=40, deadline=None)
def test_chunks_do_not_depend_on_segments(data, sizes):
    c, out, at, k = chunking.Chunker(256), [], 0, 0
    while at < len(data):
        out += c.feed(data[at : at + sizes[k % len(sizes)]])
        at += sizes[k % len(sizes)]
        k += 1
    out += c.finish()
    assert out == chunking.ends(data, 256)
    assert all(b - a <= 1024 for a, b in zip([0, *out], out))


def test_averages():
    for wrong in (3, 100, 128, 6 << 20):
        with pytest.raises(ValueError):
            chunking.check_average(wrong)
    assert chunking.check_average(0) == 4 << 20
    assert len(set(chunking.default_table().tolist())) == 256 and chunking.default_table().dtype == np.uint32


CASES = [
    ("*.log", "x/y.log", False, True), ("*.log", "y.log/x", False, False), ("p/q", "r/p/q", False, True), ("/p/q", "r/p/q", False, False), ("tmp/", "r/tmp", True, True), ("tmp/", "tmp", False, False),
    ("**", "r/s", False, True), ("r/**", "r", True, False), ("r/**", "r/s/t", False, True), ("r/**/t", "r/t", False, True), ("r**t", "r/t", False, False), ("?", "ñ", False, True),
    ("[!k]", "k", False, True), ("[^k]", "k", False, False), ("[^k]", "m", False, True), ("[]k]", "]", False, True), ("[b-d]z", "cz", False, True), ("[d-b]z", "cz", False, False), ("[/]", "/", False, False), ("r[/]t", "r/t", False, False),
    ("\\*k", "*k", False, True), ("\\*k", "kk", False, False), ("r\\/t", "r/t", False, False), ("*", "", True, False), ("k", "r/k", False, True), ("k", "rk", False, False), ("/*", "r/s", False, False),
]


def test_patterns(spark):
    from pyspark.sql import functions as F

    import duckdb

    df = spark.createDataFrame([(c[1], c[2]) for c in CASES], "path string, is_dir boolean")
    for text, path, is_dir, want in CASES:
        p = patterns.parse(text)
        assert p.matches(path, is_dir) == want, (text, path)
        sql = p.sql("path", "is_dir")
        assert duckdb.execute(f"select coalesce({sql}, false) from (select ? as path, ? as is_dir)", [path, is_dir]).fetchone()[0] == want, (text, path)
    row = df.select(*(F.col("path"), F.col("is_dir")), *(patterns.parse(c[0]).column(F.col("path"), F.col("is_dir")).alias(f"c{i}") for i, c in enumerate(CASES))).collect()
    for i, c in enumerate(CASES):
        assert [r[f"c{i}"] for r in row if r.path == c[1] and r.is_dir == c[2]][0] == c[3], c
    for text in ("*.tmp", "!keep", "/abs", "cache/", "!/a/b/"):
        assert str(patterns.parse(text)) == text
    for wrong in ("", "!", "/", "a\nb", "[a", "a\\"):
        with pytest.raises(patterns.PatternError):
            patterns.parse(wrong)
