import itertools
import random
import re
import zlib

from moraine.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(docs, spark, n=300):
    clean = "the meeting went on with many kind words about gardens and houses number".split()
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = " ".join(clean[(i + k) % len(clean)] for k in range(12))
        rows.append((i, text + (" you idiot" if i % 2 else " total moron") if bad else text + f" {i}"))
        labels.append((i, 1, int(bad)))
    return docs, rows, labels


def test_restores_and_scores(docs, spark):
    docs, rows, labels = corpus(docs, spark)
    odd = [(1000, "an 1d10t"), (1001, "you i d i o t"), (1002, "m0r0n"), (1003, "mooooron!"), (1004, "kind gardens"), (1005, None), (1006, ""), (1006, ""), (None, "what an id*ot"), (1007, "kind words " * 30000)]
    ls = spark.createDataFrame([*labels, (5000, 1, 1), (None, 1, 1), (7, None, None)], LABELS)
    got = toxicity.scored(docs(rows + odd), ls).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    for i, _ in rows:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    right = sum(by[i].predicted == t for i, _, t in labels if by[i].held_out)
    assert right == sum(by[i].held_out for i, _, _ in labels)
    assert all(by[i].predicted == 1 for i in (1000, 1001, 1002, 1003, None))
    assert all(by[i].predicted == 0 and 0 <= by[i].score <= 1 for i in (1004, 1005, 1006, 1007))
    df = docs(rows + odd)
    kept = toxicity.keep_clean(df, ls)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.5}


def test_without_labels_or_rows(docs, spark):
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in toxicity.scored(docs([(1, "x")]), none).collect()] == [0.0]
    assert toxicity.scored(docs([]), none).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)


LEXICON = {"=idiot": 5.0, "^idio": 4.0, "=ass": 3.0, "=stupid": 4.0, "^stupi": 4.0}


def scorer(docs):
    words = "the meeting went on with many kind words about gardens and houses idiot idiot ass ass stupid stupid".split()
    letters = toxicity.Letters(toxicity.letter_counts(docs([(i, " ".join(words)) for i in range(50)]).select("doc_id", "text")))
    return toxicity.Scorer(letters, LEXICON)


def test_every_hidden_word_is_decoded(docs):
    s = scorer(docs)
    for w in ("st" + "u" * 40 + "pid", "i" + "d" * 40 + "10t", "a55", "a$$", "idi**", "idio**", "**iot", "*d!ot", "*diot", "**idiot**", "idiot", "!d!0t", "st*p!d", "xxx" * 20):
        assert (s.weigh(w) > 0) == (w != "xxx" * 20), w


def test_words_left_undecoded_say_nothing(docs):
    s, rng = scorer(docs), random.Random(2)
    hits = 0
    for _ in range(4000):
        w = "".join(rng.choices("idot10*!s$a5tup.", k=rng.randint(2, 7)))
        if rng.random() < 0.5:
            w = "".join(rng.choice((c, c, c * 3, "*")) for c in rng.choice(("idiot", "ass", "stupid", "1d10t")))
        want = max((LEXICON.get(f, 0.0) for r in toxicity.readings(w, s.letters) for f in toxicity.features(r)), default=0.0)
        assert s.weigh(w) == want, w
        hits += want > 0
    assert hits > 100


def test_words_inside_spaced_runs(docs):
    s = scorer(docs)
    for x in ("you are a s t u p i d man", "what a i d i o t", "y o u a r e a n i d i o t", "y o u 1 d 1 0 t", "a s s", "you a $ $", "é t u i d i o t", "a i.d.i.o.t", "s t * p i d y o u"):
        assert s.measure(x)[1] > 0, x
    for x in ("a b c", "1 2 3 4 5 6", "k i n d w o r d s", "| " * 5000, "* " * 5000, "plan a i d"):
        assert s.measure(x)[1] == 0, x


def test_spaced_insults_are_predicted(docs, spark):
    docs, rows, labels = corpus(docs, spark)
    odd = [(1000, "kind words about a i d i o t"), (1001, "y o u a r e a m o r o n")]
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs(rows + odd), spark.createDataFrame(labels, LABELS)).collect()}
    assert got[1000] == got[1001] == 1


def likeliest(letters, token):
    """The cheapest word of a token's lattice, by trying every way through it."""
    steps = []
    for run in re.finditer(r"(.)\1*", token):
        c, k = run[1], len(run[0])
        if c in toxicity.APART or c.isspace():
            continue
        if c == "*":
            steps += [[(x, 1.5) for x in "abcdefghijklmnopqrstuvwxyz"] + [("", 6.0)] * (k > 1)] * min(k, 6)
            continue
        ways = []
        for x in toxicity.LEET.get(c, "") + (c if c in toxicity.CODE else ""):
            paid = 0.0 if x == c else 0.7
            ways.append((x, paid + (1.0 if k == 2 else 0.0)))
            ways += [(x * 2, paid + (0.0 if k == 2 else 0.3))] * (k > 1)
        steps.append(ways or [("", 4.0)])
    best = None
    for way in itertools.product(*steps):
        word, cost, older, before = "".join(x for x, _ in way), sum(p for _, p in way), 0, 0
        for z in [*map(toxicity.CODE.get, word), 0]:
            cost += letters.cost[((older if before else 0) * toxicity.WIDTH + before) * toxicity.WIDTH + z]
            older, before = before, z
        best = min(best or (cost, word), (cost, word))
    return best[1]


def test_viterbi_equals_every_way_through_the_lattice(docs):
    letters, rng = scorer(docs).letters, random.Random(7)
    for _ in range(400):
        token = "".join(rng.choices("idot10!s$a5tup.|gé", k=rng.randint(1, 5)))
        token = "".join(rng.choice((c, c, c * 2, c * 3)) for c in token)
        if rng.random() < 0.4:
            token += rng.choice(("*", "**", "*d", "*!"))
        assert letters.restore(token) == likeliest(letters, token), token


def test_counts_handed_on_after_the_last_text(docs, spark, monkeypatch):
    _, rows, labels = corpus(docs, spark, 100)
    whole = [r.score for r in toxicity.scored(docs(rows), spark.createDataFrame(labels, LABELS)).orderBy("doc_id").collect()]
    monkeypatch.setattr(toxicity, "FLUSH", 1)
    assert [r.score for r in toxicity.scored(docs(rows), spark.createDataFrame(labels, LABELS)).orderBy("doc_id").collect()] == whole
