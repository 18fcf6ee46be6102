import random
import zlib
from collections import Counter

import numpy as np
import pytest

from moraine.llm import packing
from moraine.llm.bpe import default_path, word_bpe


def optimum(items, capacity):
    """The fewest bins, by exhaustive search."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        seen = set()
        for k, room in enumerate(bins):
            if room >= items[i] and room not in seen:
                seen.add(room)
                bins[k] -= items[i]
                go(i + 1, bins)
                bins[k] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.randint(8, 40)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        fixed, rest = packing.reduce_instance(Counter(items), capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (optimum(left, capacity) if left else 0) == optimum(items, capacity)


def test_bins_hold_everything_once():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.randint(5, 300)
        have = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 400)))
        bins = packing.pack_histogram(have, capacity)
        total = Counter()
        for content, n in bins:
            assert sum(s * k for s, k in content) <= capacity
            for s, k in content:
                total[s] += k * n
        assert total == have


@pytest.mark.parametrize("capacity", [16, 2048])
def test_documents(docs, capacity):
    rows = [(i, "the of words " * (i * 7 % 90)) for i in range(60)] + [(7, None), (8, ""), (8, ""), (None, "x"), (99, "long " * 9000)]
    got = packing.pack_documents(docs(rows), default_path(), capacity).collect()
    bpe = word_bpe(default_path())
    want = Counter()
    for i, t in rows:
        ids = bpe.encode(t or "") + bytes(4)
        for k in range(0, len(ids) // 4, capacity):
            part = ids[4 * k : 4 * (k + capacity)]
            want[i, k // capacity, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) <= 1.02 * np.ceil(sum(r.length for r in got) / capacity) + 1


def test_empty(docs):
    assert packing.pack_documents(docs([]), default_path()).collect() == []
