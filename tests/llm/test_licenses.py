import re

from moraine.llm import licenses

ODD = [(1, None), (2, ""), (3, "Licensed under CC BY-NC 4.0."), (4, "x All rights reserved. all RIGHTS, reserved"), (5, "GNU General Public License, version 3"), (6, "cc cc by by cc by"), (7, "général public license"), (8, "MIT license " + "word " * 50000 + "cc by"), (8, "dup"), (8, "dup"), (None, "Released under the MIT License."), (9, "apache license"), (10, "Licensed under the Apache License, Version 2.0.")]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def by_brute_templates(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    found = set()
    for label, wording, phrases in licenses.TEMPLATES:
        placed = [(next(i for i in range(99) if wording.split()[i : i + len(p.split())] == p.split()), p.split()) for p in phrases]
        for offset in range(-40, len(words)):
            if all(offset + k >= 0 and words[offset + k : offset + k + len(p)] == p for k, p in placed):
                found.add(label)
    return found


def test_scan(docs):
    got = licenses.scan_licenses(docs(ODD)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, str(x))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in ODD), key=key)
    by = {r.doc_id: r for r in got}
    assert by[10].labels == "apache-2.0" and by[10].score == 1 and by[9].labels == "" and by[9].score == 0
    assert by[3].labels == "cc-by,cc-by-nc" and by[5].labels == "gpl,gpl-3.0" and by[None].labels == "mit"
    for (i, t), r in ((x, by[x[0]]) for x in ODD if x[0] != 8):
        assert set(filter(None, r.labels.split(","))) == set(filter(None, r.base_labels.split(","))) | by_brute_templates(t), i


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in licenses.op8_license_scan(spark, "/root/testdata/sf0.001").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])


def test_empty(docs):
    assert licenses.scan_licenses(docs([])).collect() == []
