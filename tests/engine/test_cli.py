import os

from moraine import cli
from moraine.functions import codecs
from moraine.sources import archives


def test_archive_of_a_tree(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub" / "deep").mkdir(parents=True)
    (src / "a.txt").write_text("aa")
    os.link(src / "a.txt", src / "sub" / "hard")
    (src / "sub" / "x.tmp").write_text("x")
    (src / "sub" / ".pxarexclude").write_text("# no\n/deep\n")
    for extra, version in (([], 1), (["-payload", str(tmp_path / "p")], 2)):
        assert cli.main([*extra, "-catalog", str(tmp_path / "c"), "-exclude", "*.tmp", "-pxarexclude", str(tmp_path / "o"), str(src)]) == 0
        payload = (tmp_path / "p").read_bytes() if version == 2 else None
        got = {r["path"]: r for r in archives.decode((tmp_path / "o").read_bytes(), payload)}
        told = {".pxarexclude-cli"} if version == 1 else set()
        assert set(got) - told == {"", "a.txt", "sub", "sub/.pxarexclude", "sub/hard"} and told <= set(got)
        assert archives.told_patterns((tmp_path / "o").read_bytes()) == ["*.tmp"]
        assert got["a.txt"]["data"] == b"aa" and got["sub/hard"]["kind"] == "hardlink"
        assert [x[0] for x in codecs.decode_catalog((tmp_path / "c").read_bytes())] == ["a.txt", "sub", "sub/.pxarexclude", "sub/hard"]


def build(tmp_path, src, *options):
    assert cli.main([*options, str(tmp_path / "o"), str(src)]) == 0
    return {r["path"]: r for r in archives.decode((tmp_path / "o").read_bytes())}


def test_hardlinks_are_made_of_what_is_left(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a").mkdir(parents=True)
    (src / "b").mkdir()
    (src / "a" / "x").write_text("data")
    os.link(src / "a" / "x", src / "b" / "y")
    os.link(src / "a" / "x", src / "b" / "z")
    (src / "a" / ".pxarexclude").write_text("x\n")
    got = build(tmp_path, src, "-pxarexclude")
    assert "a/x" not in got and got["b/y"]["data"] == b"data" and got["b/z"]["kind"] == "hardlink" and got["b/z"]["link_target"] == "b/y"


def test_outer_patterns_and_exclude_files_are_one_list(spark, tmp_path):
    src = tmp_path / "src"
    (src / "a" / "gone").mkdir(parents=True)
    for name in ("keep.tmp", "other.tmp", "gone/f"):
        (src / "a" / name).write_text("t")
    (src / "top.tmp").write_text("t")
    (src / "a" / ".pxarexclude").write_text("!keep.tmp\n/gone\n")
    (src / "a" / "gone" / ".pxarexclude").write_text("!*\n")
    assert set(build(tmp_path, src, "-exclude", "*.tmp", "-pxarexclude")) == {"", ".pxarexclude-cli", "a", "a/.pxarexclude", "a/keep.tmp"}
    assert set(build(tmp_path, src, "-exclude", "*.tmp")) == {"", ".pxarexclude-cli", "a", "a/.pxarexclude", "a/gone", "a/gone/.pxarexclude", "a/gone/f"}


def test_patterns_are_told(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for name in ("z", "cache", ".pxarexclude-cli"):
        (src / name).write_text("user's")
    got = build(tmp_path, src, "-exclude", "*.tmp", "-exclude", "!keep.tmp", "-exclude", "/cache")
    assert list(got) == ["", "z", ".pxarexclude-cli"]
    own = got[".pxarexclude-cli"]
    assert own["data"] == b"*.tmp\n!keep.tmp\n/cache\n" and own["mode"] == 0o100600 and own["mtime_secs"] == 0 and own["uid"] == os.getuid()
    assert set(build(tmp_path, src)) == {"", "cache", "z"}
    assert cli.main(["-payload", str(tmp_path / "p"), "-exclude", 'a"\\b', str(tmp_path / "o"), str(src)]) == 0
    meta = (tmp_path / "o").read_bytes()
    assert archives.told_patterns(meta) == ['a"\\b'] and b'{"exclude-patterns":"a\\"\\\\b\\n"}' in meta
