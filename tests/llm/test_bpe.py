import hashlib
import random

import numpy as np
import pytest

from moraine.llm.bpe import WordBpe, bpe_digest, default_path, word_bpe

tokenizers = pytest.importorskip("tokenizers")
ODD = ["", "a", "Hello World's 123 don't", "ΑΣΣ σΣ İstanbul ǅ ß ﬁ", "a\x1cb\x1f c\x85d\xa0e​f", "<|endoftext|>x<|startoftext|> <|endof", "éa ́ x", "日本語テキスト", "\x00\x01", "a" * 3000, "᠎ ﻿ x", "'S 'LL it'S", "½ ² ٣ Ⅷ"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_equals_the_library(library):
    rng = random.Random(5)
    mixed = [chr(c) for c in [*range(32, 127), 0xE9, 0xDF, 0x3A3, 0x130, 0x301, 0x4E00, 0x1F600, 0x661, 0x1C, 0x85]]
    texts = ODD + ["".join(rng.choices(mixed, k=rng.randint(1, 60))) for _ in range(1500)] + ["".join(rng.choices("theinanrsto", k=rng.randint(1, 30))) for _ in range(1500)]
    bpe = word_bpe(default_path())
    for x in texts:
        ids = library.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode(x), "<u4").tolist() == ids, x
        assert bpe.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def test_query_rows(docs, library):
    rows = [*enumerate(ODD), (50, None), (51, "twice"), (51, "twice"), (None, "no id"), (52, "very long text " * 20000)]
    got = sorted(map(tuple, bpe_digest(docs(rows), default_path()).collect()), key=str)
    want = []
    for i, x in rows:
        ids = library.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty(docs):
    assert bpe_digest(docs([]), default_path()).collect() == []


@pytest.mark.parametrize("cache", [5, 300_000])
def test_texts_together(library, monkeypatch, cache):
    rng = random.Random(6)
    signs = ["'", "'s", "'re", "'LL", "'d", "''", "#'t", "'v", "'ve\u00e9", "1'm2", "\u0301", " \u0301", "\n", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", "\u2001", "\u2028", "\u3000", "\u200b"]
    signs += ["\u03a3", "\u0130", "\xdf", "e\u0301", "\u8a9e", "\U0001f600", "\xbd", "\xb2", "\u0663", "a", "The", "ing", "x" * 70, "<|", "<|endoftext|>", " ", "  "]
    texts = [*ODD, None, "l'", "'", "'l", "x'r", *("".join(rng.choices(signs, k=rng.randint(1, 12))) for _ in range(1500)), "long row " * 130_000]
    want = [np.array(library.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    bpe, made = WordBpe(default_path(), cache), []
    monkeypatch.setattr(bpe.known, "make", lambda x: made.append(x) or bpe.word_bytes(x))
    assert [x for at in range(0, len(texts), 200) for x in bpe.encode_all(texts[at : at + 200])] == want
    assert bpe.encode_all([]) == [] and bpe.encode_all([None, ""]) == [b"", b""]
    made.clear()
    assert bpe.encode_all(["zqxj Kvwq, kvwq " * 500] * 3)[0] == bpe.encode("zqxj kvwq, kvwq " * 500)
    assert cache == 5 or sorted(made) == [",", "kvwq", "zqxj"]  # each distinct word once, however often it stands there
