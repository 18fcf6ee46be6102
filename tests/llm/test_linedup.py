import os
import random
import shutil
import subprocess
import sys
from collections import Counter

from moraine.llm import linedup


def brute(rows, least):
    """Lines to delete: in a run with enough words that occurs earlier."""
    docs = []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, places, sizes = linedup.worded(t)
        docs.append(([lines[k] for k in places], sizes))
    out = []
    for d, (lines, sizes) in enumerate(docs):
        gone = set()
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(sizes[s:e]) >= least and any(o[k : k + e - s] == lines[s:e] for c, (o, _) in enumerate(docs[: d + 1]) for k in range(len(o) if c < d else s)):
                    gone |= set(range(s, e))
        out.append((len(lines), len(gone), [x for k, x in enumerate(lines) if k not in gone]))
    return out


def check(docs, rows, least):
    got = linedup.dedup_lines(docs(rows), least).collect()
    key = lambda x: (x[0] is not None, x[0] or 0)
    found = sorted(((r.doc_id, r.n_lines, r.n_deleted, tuple(x for x in (r.text or "").split("\n") if x.encode().split()), sum(s.last - s.first + 1 for s in r.deleted)) for r in got), key=key)
    want = [(i, a, b, tuple(c), b) for (i, _), (a, b, c) in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), brute(rows, least))]
    assert Counter(found) == Counter(want)


def test_equals_brute_force(docs):
    rng = random.Random(1)
    pool = [" ".join(rng.choices("a b c d".split(), k=rng.randint(1, 5))) for _ in range(12)] + ["", " "]
    for least in (3, 8, 13):
        rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(25)]
        rows += [(30, None), (31, ""), (32, "\n\n"), (33, "x\ny\nz\n" * 10)]
        check(docs, rows, least)


def test_copies_have_their_sources(docs):
    rng = random.Random(5)
    pool = [" ".join(rng.choices("a b c d e f".split(), k=rng.randint(2, 9))) for _ in range(30)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 9)))) for i in range(20)]
    rows += [(40, "\n\n".join(rows[3][1].split("\n") + ["between them"] + rows[4][1].split("\n"))), (41, rows[3][1])]
    lines = {i: [x for x in t.split("\n") if x] for i, t in rows}
    for r in linedup.dedup_lines(docs(rows), 8).collect():
        covered = set()
        for c in r.copies:
            n = c.last - c.first + 1
            assert (c.source, c.source_first) < (r.doc_id, c.first)
            assert lines[c.source][c.source_first : c.source_first + n] == lines[r.doc_id][c.first : c.last + 1]
            covered |= set(range(c.first, c.last + 1))
        assert covered == {k for s in r.deleted for k in range(s.first, s.last + 1)}
        if r.doc_id == 41 and sum(len(x.split()) for x in lines[3]) >= 8:
            assert len(covered) == len(lines[3])


def test_repeated_and_null_ids(docs):
    line = "one two three four five six seven eight nine"
    rows = [(None, line), (1, line + "\nother words are here now and they are many"), (1, line + "\nother words are here now and they are many"), (2, "tiny"), (3, "tiny")]
    check(docs, rows, 8)


def test_pipeline_stage(docs):
    line = "one two three four five six seven eight nine"
    df = docs([(1, line), (2, line), (3, line + "\nmore"), (4, None), (5, "")])
    kept = linedup.keep_first_lines(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect() if r.text) == [(1, line, len(line)), (3, "more", 4)]
    assert {r.doc_id for r in kept.collect()} == {1, 3, 4, 5}


def test_very_long_and_empty(docs):
    rows = [(1, "\n".join(f"line {i} with enough words to be counted on its own" for i in range(3000))), (2, "line 7 with enough words to be counted on its own")]
    got = {r.doc_id: r.n_deleted for r in linedup.dedup_lines(docs(rows)).collect()}
    assert got == {1: 0, 2: 1}
    assert linedup.dedup_lines(docs([])).collect() == []


def test_clashing_names(docs):
    line = "one two three four five six seven eight nine"
    df = docs([(1, line), (2, line), (3, line + "\nmore"), (3, "x")])
    for names in (("_key", "_bit"), ("_runs", "_KEY"), ("key", "d")):
        own = df.withColumnRenamed("task", names[0]).withColumnRenamed("rank", names[1])
        got = linedup.keep_first_lines(own)
        assert got.columns == own.columns
        assert sorted((r.text, r[5], r[6]) for r in got.collect()) == [("more", "extra", 7), (line, "extra", 7), ("x", "extra", 7)]


OWN_SESSION = """
import sys
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from moraine.llm import common, linedup

spark = SparkSession.builder.master("local[2,2]").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
line = "one two three four five six seven eight nine"
rows = [(1, line), (2, line + "\\nmore"), (3, None), (4, "tiny")]
got = linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
assert sorted((r.doc_id, r.n_deleted) for r in got) == [(1, 0), (2, 1), (3, 0), (4, 0)]

def fails_once(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"x": b"x" * common.GROUP_BYTES}]] * b.num_rows, pa.list_(pa.struct([("x", pa.binary())])))], ["id", "xs"])
    if TaskContext.get().attemptNumber() == 0:
        raise ValueError("first attempt")

kept = common.filed(spark.range(4).repartition(2).mapInArrow(fails_once, "id long, xs array<struct<x:binary>>"), "again")
assert sorted((r.id, len(r.xs[0].x)) for r in kept.collect()) == [(i, common.GROUP_BYTES) for i in range(4)]
assert common.filed(kept.where("id > 9"), "none").collect() == []
"""


def test_tables_start_no_commands(tmp_path):
    """Each command that the JVM starts counts its memory twice for a moment; a failed attempt adds no rows."""
    told, real = tmp_path / "told", shutil.which("chmod")
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/chmod").write_text(f'#!/bin/sh\necho "$*" >> {told}\nexec {real} "$@"\n')
    (tmp_path / "bin/chmod").chmod(0o755)
    env = os.environ | {"PATH": f"{tmp_path}/bin:{os.environ['PATH']}"}
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(name, None)
    done = subprocess.run([sys.executable, "-c", OWN_SESSION, str(tmp_path / "shared")], env=env, capture_output=True, text=True, timeout=300)
    assert [x for x in told.read_text().split("\n") if "/moraine/" in x] == []
    assert done.returncode == 0, done.stderr[-2000:]
