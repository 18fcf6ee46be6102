"""Content-defined chunks: a rolling hash over 64 bytes, cut where it ends in ones.

The hash at a byte is the exclusive or of the table values of the last 64 bytes,
each rotated by its age; 64 rotations are the identity on 32 bits, so it depends
on these bytes alone and every place can be tested at once. A place may end a
chunk when its size is at least avg / 4 (and more than the window) and the hash
masked with 2 * avg - 1 is at least mask - 2; a chunk ends in any case at 4 * avg.

The table of 256 values is a parameter. Boundaries agree with another tool's
only when its table is given; the default is made from a rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 64
DEFAULT_AVG = 4 << 20


def default_table() -> np.ndarray:
    """The first 32 bits of the MD5 of each byte's decimal number."""
    return np.array([int(hashlib.md5(str(b).encode(), usedforsecurity=False).hexdigest()[:8], 16) for b in range(256)], np.uint32)


def check_average(avg: int) -> int:
    """A usable average: a power of two of 256 at least; 0 is the default."""
    avg = avg or DEFAULT_AVG
    if avg < 256 or avg & (avg - 1):
        raise ValueError(f"average chunk size {avg} is no power of two from 256 on")
    return avg


def hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hash at every byte, of the 64 bytes up to it (fewer at the start)."""
    h = table[data]
    step = 1
    while step < WINDOW:
        old = h.copy()
        turn = step % 32
        shifted = old[:-step] if step < len(old) else old[:0]
        if turn:
            shifted = (shifted << np.uint32(turn)) | (shifted >> np.uint32(32 - turn))
        h[step:] ^= shifted
        step *= 2
    return h


def candidates(data: np.ndarray, avg: int, table: np.ndarray) -> np.ndarray:
    """Ends (exclusive) at which the hash allows a cut, whatever the chunk's size."""
    mask = np.uint32(2 * avg - 1)
    at = np.flatnonzero((hashes(data, table) & mask) >= mask - np.uint32(2)) + 1
    return at[at >= WINDOW]


def select_ends(cuts: Sequence[int], n: int, avg: int) -> list[int]:
    """The ends of the chunks of n bytes, from all allowed cuts in order."""
    least, most = max(avg // 4, WINDOW + 1), 4 * avg
    out: list[int] = []
    start = 0
    for c in [*cuts, n]:
        while c - start > most:
            start += most
            out.append(start)
        if c > start and (c - start >= least or c == n):
            out.append(c)
            start = c
    return out


def ends(data: bytes | np.ndarray, avg: int = DEFAULT_AVG, table: np.ndarray | None = None, block: int = 1 << 22) -> list[int]:
    """Chunk ends of a whole stream; long ones are hashed in blocks that overlap by the window."""
    avg = check_average(avg)
    table = default_table() if table is None else table
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes | memoryview) else data
    found: list[np.ndarray] = []
    for at in range(0, len(data), block):
        halo = min(at, WINDOW - 1)
        cut = candidates(data[at - halo : at + block], avg, table) + at - halo
        found.append(cut[cut > at])
    return select_ends(np.concatenate(found).tolist() if found else [], len(data), avg)


class Chunker:
    """A stream given in any segments; yields the ends as soon as they are settled."""

    def __init__(self, avg: int = DEFAULT_AVG, table: np.ndarray | None = None):
        self.avg, self.table = check_average(avg), default_table() if table is None else table
        self.tail = np.zeros(0, np.uint8)
        self.seen = self.start = 0

    def feed(self, segment: bytes) -> list[int]:
        data = np.concatenate((self.tail, np.frombuffer(segment, np.uint8)))
        base = self.seen - len(self.tail)
        cuts = [c + base for c in candidates(data, self.avg, self.table).tolist() if c + base > self.seen]
        self.seen += len(segment)
        self.tail = data[-(WINDOW - 1) :]
        least, most, out = max(self.avg // 4, WINDOW + 1), 4 * self.avg, []
        for c in [*cuts, self.seen]:
            while c - self.start > most or c - self.start == most and c == self.seen:
                self.start += most
                out.append(self.start)
            if c - self.start >= least and c in cuts:
                self.start = c
                out.append(c)
        return out

    def finish(self) -> list[int]:
        if self.seen > self.start:
            self.start = self.seen
            return [self.seen]
        return []


CHUNKS = "stream_id string, seq long, offset long, end_offset long, size long, digest string"


def chunk_streams(streams: DataFrame, avg: int, key: bytes = b"", table: Sequence[int] | None = None, with_data: bool = False) -> DataFrame:
    """CHUNKS of streams (stream_id string, data binary), with_data each with its bytes. key makes digests keyed."""
    check_average(avg)
    fixed = None if table is None else list(table)
    schema = CHUNKS + ", data binary" if with_data else CHUNKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = default_table() if fixed is None else np.array(fixed, np.uint32)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = [x.split()[0] for x in schema.split(", ")]
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch, rows = big.slice(at, 256), []
                for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    data, start = x.as_py() or b"", 0
                    for seq, end in enumerate(ends(data, avg, values)):
                        part = data[start:end]
                        rows.append((name, seq, start, end, end - start, hashlib.sha256(part + key).hexdigest(), *((part,) if with_data else ())))
                        start = end
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return streams.select("stream_id", "data").mapInArrow(run, schema)
