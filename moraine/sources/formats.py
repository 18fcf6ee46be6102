"""Catalogs, indexes, frame streams, blobs and archives as columns of bytes: read into rows, written from rows.

Each reader takes (name string, data binary), one file a row, and yields rows in
the file's order; a file is one sequence and is decoded by one task, different
files by different ones. Bytes that break their format raise FormatError; a null
file yields no rows. Each writer takes rows of one file a group, bounded by the
caller, and yields (name, data).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from . import archives

CATALOG = "name string, seq long, path string, letter string, size long, mtime long"
INDEX = "name string, seq long, start_offset long, end_offset long, digest string"
FRAMES = "name string, seq long, kind string, data binary, digest string, size long"
BLOBS = "name string, data binary, size long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _read(files: DataFrame, schema: str, rows: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    fields = [x.split() for x in schema.split(", ")]
    names, kinds = [x[0] for x in fields], [_KINDS[x[1]] for x in fields]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                if data.is_valid:
                    key = name.as_py()
                    for row in rows(data.as_py()):
                        yield key, *row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return archives.handed_on(read(batches), names, kinds)

    return files.select("name", "data").mapInArrow(run, schema)


def read_catalogs(files: DataFrame) -> DataFrame:
    """CATALOG rows, depth first."""
    return _read(files, CATALOG, lambda data: ((i, *r) for i, r in enumerate(codecs.decode_catalog(data))))


def read_indexes(files: DataFrame) -> DataFrame:
    """INDEX rows: each chunk with the bytes of the stream that it covers."""

    def rows(data: bytes) -> Iterator[tuple]:
        start = 0
        for i, (end, digest) in enumerate(codecs.parse_index(data)):
            yield i, start, end, digest
            start = end

    return _read(files, INDEX, rows)


def read_frames(files: DataFrame, magic: bytes = codecs.FRAME_MAGIC) -> DataFrame:
    """FRAMES rows: a data frame with its bytes, or a row for each injected chunk with digest and size; seq counts frames."""

    def rows(data: bytes) -> Iterator[tuple]:
        for i, (kind, body, chunks) in enumerate(codecs.decode_frames(data, magic)):
            if kind == "data":
                yield i, kind, body, None, len(body)
            for digest, size in chunks:
                yield i, kind, None, digest, size

    return _read(files, FRAMES, rows)


def read_blobs(files: DataFrame) -> DataFrame:
    """BLOBS: the plain bytes of framed ones."""
    return _read(files, BLOBS, lambda data: [(plain, len(plain)) for plain in [codecs.decode_blob(data)]])


def write_blobs(plain: DataFrame, compress: bool = True) -> DataFrame:
    """(name, data) framed, of (name, data) plain."""
    return _read(plain, "name string, data binary", lambda data: [(codecs.encode_blob(data, compress),)])


def _write(rows: DataFrame, made: Callable[[list[tuple]], bytes]) -> DataFrame:
    """(name, data) of rows (name, order, ...); made gets the rest of a file's rows in order.

    Files are told apart in one sorted stream: a call for each would cost more than the small ones do.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        name, part = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, archives.ROWS):
                keys, _, *columns = (c.to_pylist() for c in batch.slice(at, archives.ROWS).columns)
                for key, row in zip(keys, zip(*columns)):
                    if part and key != name:
                        yield name, made(part)
                        part = []
                    name = key
                    part.append(row)
        if part:
            yield name, made(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return archives.handed_on(files(batches), ["name", "data"], [pa.string(), pa.binary()])

    name, order = rows.columns[:2]
    return rows.repartition(name).sortWithinPartitions(name, F.col(order).asc_nulls_last()).mapInArrow(run, "name string, data binary")


def write_catalogs(rows: DataFrame) -> DataFrame:
    """Catalogs of (name, seq, path, letter, size, mtime)."""
    return _write(rows.select("name", "seq", "path", "letter", "size", "mtime"), lambda r: codecs.encode_catalog([(path, letter, int(size or 0), int(mtime or 0)) for path, letter, size, mtime in r]))


def write_indexes(rows: DataFrame) -> DataFrame:
    """Indexes of (name, seq, end_offset, digest)."""
    return _write(rows.select("name", "seq", "end_offset", "digest"), lambda r: codecs.render_index([(int(end), digest) for end, digest in r]))


def write_frames(rows: DataFrame, magic: bytes = codecs.FRAME_MAGIC) -> DataFrame:
    """Frame streams of (name, seq, kind, data, digest, size): a frame a row."""

    def made(r: list[tuple]) -> bytes:
        return codecs.encode_frames([("data", data or b"", []) if kind == "data" else ("inject", b"", [(digest, int(size))]) for kind, data, digest, size in r], magic)

    return _write(rows.select("name", "seq", "kind", "data", "digest", "size"), made)


def write_archives(nodes: DataFrame, version: int = 1) -> DataFrame:
    """(archive, meta, payload) of nodes (archive, path, kind, mode, uid, gid, mtime_secs, mtime_nanos, link_target, xattrs, data), a tree a group.

    Directories that nodes imply but lack, the root among them, are made plain.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.astype(object).where(part.notna(), None).to_dict("records")
        have = {r["path"] for r in rows}
        up = {"/".join(p.split("/")[:i]) for p in have if p for i in range(p.count("/") + 1)} | {""}
        plain = {"kind": "directory", "mode": 0o40755, "uid": 0, "gid": 0, "mtime_secs": 0, "mtime_nanos": 0}
        rows += [plain | {"path": p} for p in up - have]
        for r in rows:
            r |= {k: int(r[k]) for k in ("mode", "uid", "gid", "mtime_secs", "mtime_nanos") if r.get(k) is not None}
            r["xattrs"] = list(r["xattrs"]) if r.get("xattrs") is not None else None
        meta, payload = archives.encode(rows, version)
        return pd.DataFrame({"archive": [part["archive"].iloc[0]], "meta": [meta], "payload": [payload]})

    picked = nodes.select("archive", "path", "kind", "mode", "uid", "gid", "mtime_secs", "mtime_nanos", "link_target", "xattrs", "data")
    return picked.groupBy("archive").applyInPandas(run, "archive string, meta binary, payload binary")


def unresolved(nodes: DataFrame, payload_bytes: DataFrame) -> DataFrame:
    """Payload references of decoded files (archive, path, payload_offset, size) that end beyond their payload (archive, n)."""
    end = F.col("payload_offset") + archives.MARKER + F.col("size")
    refs = nodes.where("kind = 'file' and payload_offset is not null")
    return refs.join(payload_bytes, "archive", "left").where(F.col("n").isNull() | (end + archives.MARKER > F.col("n"))).select("archive", "path", "payload_offset", "size")
