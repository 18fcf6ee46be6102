import random
import re
from collections import Counter

import pytest

from moraine.llm import neardup
from moraine.llm.components import components


def brute(rows, size, percent):
    """(doc_id, n, component, kept) by comparing every two documents."""
    sets = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                if 100 * min(len(sets[a]), len(sets[b])) < percent * max(len(sets[a]), len(sets[b])):
                    continue
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = i if r not in least else min(least[r], i)
    return Counter((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(len(words))
        if rng.random() < 0.4:
            words[k] = rng.choice("new other changed".split()) + str(rng.randrange(99))
        elif rng.random() < 0.5 and len(words) > 2:
            del words[k]
        else:
            words.insert(k, "added" + str(rng.randrange(99)))
    return words


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(docs, size, percent):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.choice([4, 6, 8, 12, 20, 40, 90, 300]))
        if rng.random() < 0.4:
            words += passage
        texts += [" ".join(edited(rng, words, rng.choice([0, 0, 1, 1, 2, 3, 5, 9]))) for _ in range(rng.randint(1, 8))]
    texts += ["", None, "Only", "only", "Only two", " \n", "passage " + " ".join(passage)]
    rows = [(i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    rows += [(500, rows[0][1]), (501, rows[1][1]), (501, rows[1][1]), (None, rows[2][1]), (502, "very long text " * 9000), (503, "Very long text " * 8000)]
    got = neardup.classes(docs(rows), size, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, size, percent)


def test_large_groups_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(80):
        rows.append((i, " ".join(passage + [f"x{rng.randrange(10)}y{j}" for j in range(rng.choice([2, 6, 10, 14]))])))
    got = neardup.classes(docs(rows), 3, 85).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute(rows, 3, 85)


def test_keep_one(docs):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "something else here altogether now"), (4, None), (None, "z")]
    df = docs(rows)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]


def test_keep_one_of_rows_without_own_ids(docs):
    a, b, c, d = "a b c d e f g h", "i j k l m n o p", "q r s t u v w x", "short one"
    df = docs([(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (3, c), (3, d), (3, d), (3, None), (3, None)])
    got = neardup.keep_one(df)
    assert got.columns == df.columns
    assert Counter(r.text for r in got.collect()) == {a: 1, b: 1, c: 1, d: 1, None: 2}


def test_empty(docs):
    assert neardup.classes(docs([]), 3, 85).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, 900 + i) for i in range(50)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)] + [(3, None), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


def test_clashing_names(docs):
    a = "a b c d e f g h"
    df = docs([(1, a), (2, a), (3, "else entirely here"), (None, a)])
    for names in (("_key", "_bit"), ("_gone", "_KEY"), ("key", "_runs")):
        own = df.withColumnRenamed("task", names[0]).withColumnRenamed("rank", names[1])
        got = neardup.keep_one(own)
        assert got.columns == own.columns
        assert sorted((r.text, r[5], r[6]) for r in got.collect()) == [(a, "extra", 7), ("else entirely here", "extra", 7)]
