import re
from collections import Counter

from moraine.llm import quality

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (5, "a b c d e f g h i j k"), (6, "w x y z q " * 30), (7, "x\ny\nx\nx \n\nx"), (8, "é ü # * $% &|<> – …" * 9), (9, "long words " * 40000), (9, "tie"), (9, "tie"), (None, "null id with quite a few words to pass the rule of ten")]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_numbers(docs):
    got = quality.judge(docs(ODD)).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert found == Counter((i, *brute(t)) for i, t in ODD)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_bad_host_goes(docs, spark):
    good = [(i, f"plain words number {i} go here with a few more of them {i * 7}") for i in range(40)]
    junk = [(100 + i, "buy buy " * 30) for i in range(40)] + [(200, good[0][1])]
    both = docs(good, lambda i: "good").unionByName(docs(junk, lambda i: "junk")).unionByName(docs([(300, good[1][1])], lambda i: None))
    got = {r.doc_id: r.kept for r in quality.judge(both).collect()}
    assert all(got[i] for i, _ in good) and not got[200] and not got[100] and got[300]
    kept = quality.keep_good(both)
    assert kept.columns == both.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_empty(docs):
    assert quality.judge(docs([])).collect() == [] and quality.keep_good(docs([])).collect() == []


def test_query_equals_sql(spark, same):
    same(quality.op4_quality_rules(spark, "/root/testdata/sf0.001"), quality.ORACLE)


def test_null_host_is_not_the_empty_name(docs):
    good = [(i, f"plain words number {i} go here with a few more of them {i * 7}") for i in range(30)]
    junk = [(100 + i, "buy buy " * 30) for i in range(30)] + [(200, good[0][1])]
    both = docs(good, lambda i: None).unionByName(docs(junk, lambda i: ""))
    got = {r.doc_id: r.kept for r in quality.judge(both).collect()}
    assert all(got[i] for i, _ in good) and not got[200]
    clash = both.withColumnRenamed("task", "_bad_host")
    assert sorted(r.doc_id for r in quality.keep_good(clash).collect()) == [i for i, _ in good]
