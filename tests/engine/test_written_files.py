"""Files that are written and read as columns of bytes: one sorted stream of rows, bounded batches."""

import hashlib

import pytest

from moraine.functions import codecs
from moraine.plans import queries
from moraine.sources import formats

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def digest(k):
    return hashlib.sha256(str(k).encode()).hexdigest()


@pytest.fixture
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_frames_need_no_join_and_no_call_for_each_file(spark):
    found = plan(queries.frame_records(spark, SF))
    assert "Join" not in found and "FlatMapGroups" not in found and "MapInArrow" in found


def test_frames_over_batches(spark, short_batches):
    frames = {"a": [b"x"], "b": [b"%d" % k for k in range(10)], "c": [None, b"y"], None: [b"z", b"", b"w"]}
    rows = [(name, k, "data" if k % 2 else "inject", x if k % 2 else None, None if k % 2 else digest(k), k) for name, parts in frames.items() for k, x in enumerate(parts)]
    got = formats.write_frames(spark.createDataFrame(rows[::-1], "name string, seq long, kind string, data binary, digest string, size long").repartition(3)).collect()
    want = {name: codecs.encode_frames([("data", x or b"", []) if k % 2 else ("inject", b"", [(digest(k), k)]) for k, x in enumerate(parts)]) for name, parts in frames.items()}
    assert len(got) == len(want) and {r.name: bytes(r.data) for r in got} == want


def test_indexes_and_catalogs_need_no_call_for_each_file(spark):
    for query in (queries.index_records, queries.catalog_entries):
        found = plan(query(spark, SF))
        assert "FlatMapGroups" not in found and "MapInArrow" in found


def test_indexes_over_batches(spark, short_batches):
    sizes = {"a": 1, "b": 10, "c": 2, None: 4}
    rows = [(name, k, (k + 1) * (1 << 53) + k, digest(k)) for name, n in sizes.items() for k in range(n)]
    got = formats.write_indexes(spark.createDataFrame(rows[::-1], "name string, seq long, end_offset long, digest string").repartition(3)).collect()
    want = {name: codecs.render_index([((k + 1) * (1 << 53) + k, digest(k)) for k in range(n)]) for name, n in sizes.items()}
    assert len(got) == len(want) and {r.name: bytes(r.data) for r in got} == want
