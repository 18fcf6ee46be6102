import math
import random
import re
import zlib
from collections import Counter

import pytest

from moraine.llm import ppm


def brute(rows, order):
    """(doc_id, held_out, n_tokens, n_known, N, base, score), straight from the definitions."""
    docs = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        docs.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, words))
    c = Counter(w for _, held, ws in docs if not held for w in [*ws, "\n"])
    n, v = sum(c.values()), len(c)
    trie: dict[bytes, Counter] = {}
    for w, k in c.items():
        s = b" \n" if w == "\n" else b" " + w.encode() + b" "
        for j in range(1, len(s)):
            for a in range(max(0, j - order), j + 1):
                trie.setdefault(s[a:j], Counter())[s[j]] += k

    def p(symbol, ctx, out):
        left = {x: k for x, k in trie.get(ctx, {}).items() if x not in out}
        total = sum(left.values()) + len(left)
        if symbol in left:
            return left[symbol] / total
        escape = len(left) / total if left else 1
        return escape * (p(symbol, ctx[1:], out | left.keys()) if ctx else 1 / (256 - len(out | left.keys())))

    def score(w):
        s = b" \n" if w == "\n" else b" " + w.encode() + b" "
        return sum(math.log10(p(s[j], s[max(0, j - order) : j], frozenset())) for j in range(1, len(s)))

    out = []
    for i, held, ws in docs:
        ws = [*ws, "\n"]
        out.append((i, held, len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), sum(map(score, ws))))
    return out


@pytest.mark.parametrize("head", [3, 100000])
def test_equals_brute_force(docs, head):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(50)] + [(60, None), (61, ""), (62, "A\x1cb C\tD\nzq"), (62, "tie"), (62, "tie"), (None, "no id"), (63, "w" * 3000)]
    got = ppm.score_texts(docs(rows), head=head).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows, ppm.ORDER), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_probabilities_sum_to_one():
    trie = {b"": ({97: 3, 32: 2}, 5), b"a": ({98: 1}, 1)}
    total = sum(10 ** ppm.symbols_log10(bytes([97, x]), trie, 3) for x in range(256))
    assert total == pytest.approx(1)


def test_held_out_bits_per_byte(spark):
    sf = "/root/testdata/sf0.01"
    sizes = {r.doc_id: len(r.text.encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = ppm.op9_ppm_score(spark, sf).where("held_out").collect()
    assert -sum(r.score for r in got) / math.log10(2) / sum(sizes[r.doc_id] for r in got) < 2.6


def test_empty(docs):
    assert ppm.score_texts(docs([])).collect() == []


def test_no_context_is_dropped(docs):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(25000)]
    rows = [(i, " ".join(words[i * 100 : i * 100 + 100])) for i in range(250)]
    assert len({w[max(0, j - k) : j] for w in (f" {w} " for w in words) for j in range(1, 10) for k in range(6)}) > 150_000
    got = {r.doc_id: r.score for r in ppm.score_texts(docs(rows), head_grams=50).collect()}
    assert got == {x[0]: pytest.approx(x[6], rel=1e-9) for x in brute(rows, ppm.ORDER)}


@pytest.mark.parametrize("head_grams", [5, 100000])
def test_contexts_cross_blanks(docs, head_grams):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 4))) for _ in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(40)] + [(40, None), (41, "one two three"), (42, "three two one"), (43, "zq\nzq")]
    coded = {i: b"".join(b" " + w.encode() for w in (t or "").split()) + b" \n" for i, t in rows}
    trie: dict[bytes, Counter] = {}
    for i, s in coded.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for j in range(1, len(s)):
                for a in range(max(0, j - ppm.ORDER), j + 1):
                    trie.setdefault(s[a:j], Counter())[s[j]] += 1
    plain = {k: (dict(v), sum(v.values())) for k, v in trie.items()}
    got = {r.doc_id: r.score for r in ppm.score_texts(docs(rows), head_grams=head_grams, across=True).collect()}
    assert got == {i: pytest.approx(ppm.symbols_log10(s, plain), rel=1e-9) for i, s in coded.items()}


def test_order_of_words_matters(spark, docs, tmp_path):
    rows = [(i, "the old man went home") for i in range(20)] + [(20, "home went man old the")]
    docs(rows).write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in ppm.op9_ppm_score(spark, f"file://{tmp_path}").collect()}
    assert got[20] < got[0] - 1
