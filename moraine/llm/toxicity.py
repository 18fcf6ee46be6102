"""Toxicity scores of texts restored by a noisy-channel decoder.

Three passes. The first counts letter trigrams of all words of all documents:
the character language model. The second fits the classifier on a bounded
sample of labelled documents (SAMPLE rows of each label, those with the least
hashes of doc_id): features are whole words and word beginnings; those far more
frequent in toxic texts, by the log-likelihood ratio, form a lexicon of at most
LEXICON entries; two numbers of a text, its lexicon hits and its strongest one,
enter a logistic regression. The third scores every whole text.

Words that may hide something (digits or signs among letters, letters three
times over, stars, letters set apart by blanks or dots) are also decoded: their
characters span a lattice (a sign stands for the letters it resembles, a run
for one or two letters, a star for any letter, a dot for nothing), and Viterbi
finds the likeliest word under the trigrams, over all pairs of last letters. A
run costs what one letter costs, so words of any length are decoded; stars
at a word's ends are tried as letters and as marks; a run of stars stands for
six letters at most. Words are left undecoded only if no reading of their characters'
classes begins with an entry of the lexicon, which changes no score. In a run of
three or more letters set apart, words may begin and end anywhere: entries of
three letters and more are looked for from each letter on. A word counts by what it says or by
what it is restored to, whichever is stronger.

Null texts are empty and get a score like any other; null labels and labels of
unknown documents teach nothing; a null doc_id is passed through, as not held
out. Repeated rows give repeated rows; of equal texts, one teaches. Without
labelled rows all scores are 0. An empty table gives no rows; other columns are
not read, or pass through keep_clean.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket5, few, keep, lean, ready, slices, table

SAMPLE, LEXICON = 6000, 5000
LEAST_LLR, LEAST_LOG_ODDS, LEAST_DOCS = 12.0, 2.0, 5
PREFIXES = (4, 5, 6, 7)
FLUSH = 200_000
CACHE_ENTRIES = 50_000

# Signs and the letters they stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "+": "t", "|": "li", "(": "c", "€": "e", "£": "l"}
APART = "._-~'`^"
_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
WIDTH = 64
CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}
_TABLE = np.zeros(0x250, np.int64)
for _c, _i in CODE.items():
    _TABLE[ord(_c)] = _i
_ONE = "[" + re.escape(_LETTERS + "".join(LEET) + "*") + "]"
_SPACED = re.compile(rf"(?<!\S)(?:{_ONE}(?:[ \t]+|[._-])){{2,}}{_ONE}(?![^\s.,;:!?])")
_MANY = re.compile(r"([^*])\1{3,}|(\*)\*{6,}")
#: Letters of the least entry that is looked for inside a run of letters set apart.
LEAST_SPACED = 3
_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$!+|*(") + "«»“”„¿¡…–—"


class Letters:
    """Interpolated trigram costs, from counts of (letter, letter, letter)."""

    def __init__(self, counts: np.ndarray):
        n3 = counts.reshape(WIDTH, WIDTH, WIDTH).astype(float)
        n2, n1 = n3.sum(0), n3.sum((0, 1))
        p1 = (n1 + 1) / (n1.sum() + WIDTH)
        p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
        p3 = (n3 + 5 * p2) / (n3.sum(2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).ravel().tolist()
        self.table: np.ndarray | None = None

    def restore(self, token: str) -> str:
        """The likeliest word behind a token."""
        # the best cost and way to each two last letters; a way is its last step and the way before
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for run in re.finditer(r"(.)\1*", token):
            c, k = run[1], len(run[0])
            if c in APART or c.isspace():
                continue
            if c == "*":
                for _ in range(min(k, 6)):
                    states = self.any_letter(states, k > 1)
                continue
            options = []
            for x in LEET.get(c, "") + (c if c in CODE else ""):
                paid = 0.0 if x == c else 0.7
                options += [(x, paid + (0 if k == 1 else 1.0 if k == 2 else 0.0))]
                if k > 1:
                    options += [(x * 2, paid + (0.0 if k == 2 else 0.3))]
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, way) in states.items():
                for add, paid in options or [("", 4.0)]:
                    p, q, total = a, b, cost + paid
                    for x in add:
                        z = CODE[x]
                        total += self.cost[((p if q else 0) * WIDTH + q) * WIDTH + z]
                        p, q = q, z
                    old = after.get((p, q))
                    if old is None or total < old[0]:
                        after[p, q] = (total, (add, way))
            states = after
        way = min(((cost + self.cost[((a if b else 0) * WIDTH + b) * WIDTH], i, way) for i, ((a, b), (cost, way)) in enumerate(states.items())))[2]
        found = []
        while way:
            found.append(way[0])
            way = way[1]
        return "".join(reversed(found))

    def any_letter(self, states: dict[tuple[int, int], tuple[float, tuple]], none: bool) -> dict[tuple[int, int], tuple[float, tuple]]:
        """The states after a star: one more letter of a to z, or none at a cost."""
        if self.table is None:
            self.table = np.array(self.cost).reshape(WIDTH, WIDTH, WIDTH)
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        ended: dict[int, list[tuple[int, float, tuple]]] = {}
        for (a, b), (cost, way) in states.items():
            ended.setdefault(b, []).append((a if b else 0, cost, way))
        for b, own in ended.items():
            total = np.array([x[1] for x in own])[:, None] + self.table[[x[0] for x in own], b, 1:27] + 1.5
            best = total.argmin(0)
            for z, i in enumerate(best.tolist(), 1):
                after[b, z] = (float(total[i, z - 1]), (_LETTERS[z - 1], own[i][2]))
        if none:
            for at, (cost, way) in states.items():
                if at not in after or cost + 6.0 < after[at][0]:
                    after[at] = (cost + 6.0, way)
        return after


def _canonical() -> dict[int, str]:
    """One letter for each class of characters that may stand for each other; '' for what restoring drops."""
    kind = {c: c for c in _LETTERS}
    for sign, letters in LEET.items():
        one = kind[letters[0]]
        for c in letters[1:]:
            kind = {k: one if v == kind[c] else v for k, v in kind.items()}
        kind[sign] = one
    return {ord(k): v for k, v in kind.items()}


_CANON = _canonical()
_DROPPED = re.compile("[^" + re.escape("".join(CODE) + "".join(LEET)) + "]")
_TWICE = re.compile(r"(.)\1+")


def skeleton(text: str) -> str:
    """What all readings of a token have in common: classes of its characters, runs as one."""
    return _TWICE.sub(r"\1", _DROPPED.sub("", text).translate(_CANON))


def suspicious(word: str) -> bool:
    """Whether a word has signs among letters, a star, or a letter three times over."""
    return not word.isalpha() and any(c.isalpha() for c in word) or "***" in word or re.search(r"(.)\1\1", word) is not None or any(c in "@$!*" for c in word)


class Able:
    """Skeletons of a lexicon's entries, to tell the words that no reading of leads to an entry."""

    def __init__(self, lexicon: dict[str, float]):
        # restoring gives letters of CODE only
        self.bones = frozenset(skeleton(f[1:]) for f in lexicon if f[1:] and CODE.keys() >= set(f[1:]))
        self.sizes = tuple(sorted({len(x) for x in self.bones}))
        follow: dict[str, set[str]] = {}
        for x in self.bones:
            for k in range(len(x)):
                follow.setdefault(x[:k], set()).add(x[k])
        self.follow = {k: frozenset(v) for k, v in follow.items()}

    def __contains__(self, token: str) -> bool:
        """Whether some reading of the token may begin with an entry; a star is any letter, or merges with its neighbour."""
        if "*" not in token:
            bones = skeleton(token)
            return any(bones[:k] in self.bones for k in self.sizes)
        at = {""}
        for part in re.findall(r"\*+|[^*]+", token):
            if part[0] == "*":
                for _ in range(min(len(part), 6)):
                    at |= {x + c for x in at for c in self.follow.get(x, ())}
                    if not self.bones.isdisjoint(at):
                        return True
            else:
                for i, c in enumerate(skeleton(part)):
                    # what a run across the star has in common with its neighbour is said once
                    at = {x + c for x in at if c in self.follow.get(x, ())} | ({x for x in at if x[-1:] == c} if i == 0 else set())
                    if not self.bones.isdisjoint(at):
                        return True
            if not at:
                return False
        return False


def readings(word: str, letters: Letters, able: Able | None = None) -> list[str]:
    """What a lower-case word may say: itself, and what it is restored to, with and without the stars and signs around it.

    able: what may matter; other words are not restored, since no reading would.
    """
    bare = word.strip(_STRIP)
    plain = bare.strip("*")
    out = [plain] if plain else []
    for x in dict.fromkeys((bare, bare.rstrip("!(|+"), plain, plain.rstrip("!(|+"))):
        if x.strip("*") and suspicious(x) and (able is None or x in able):
            out.append(letters.restore(x))
    return out


def features(reading: str) -> list[str]:
    return ["=" + reading, *("^" + reading[:k] for k in PREFIXES if len(reading) >= k)]


def lower(text: str | None) -> str:
    return unicodedata.normalize("NFC", text or "").lower()


def apart(text: str) -> list[str]:
    """Letters set apart, put together."""
    return ["".join(m[0].split()) for m in _SPACED.finditer(text)]


def letter_counts(rows: DataFrame) -> np.ndarray:
    """Trigram counts over all texts; WIDTH ** 3 numbers whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH**3, np.int64)
        for big in batches:
            for batch in slices(big, "text"):
                text = "\n".join(x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()).lower()
                cp = np.frombuffer((text + "\n").encode("utf-32-le"), np.uint32)
                code = np.where(cp < 0x250, _TABLE[np.minimum(cp, 0x24F)], np.where(cp < 0x2000, WIDTH - 1, 0))
                before = np.concatenate(([0], code[:-1]))
                older = np.where(before == 0, 0, np.concatenate(([0, 0], code[:-2]))) if len(code) > 1 else np.zeros_like(code)
                total += np.bincount((older * WIDTH + before) * WIDTH + code, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    counts = np.zeros(WIDTH**3, np.int64)
    for r in rows.select("text").mapInArrow(lean(run), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] = r["n"]
    return counts


class Scorer:
    """Hits of a text in the lexicon, and its score."""

    def __init__(self, letters: Letters, lexicon: dict[str, float], weights: tuple[float, float, float] | None = None):
        self.letters, self.lexicon, self.weights = letters, lexicon, weights
        self.able = Able(lexicon)
        self.inside = tuple(sorted({len(f) - 1 for f in lexicon if len(f) > LEAST_SPACED}))
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def weigh(self, word: str) -> float:
        return max((self.lexicon.get(f, 0.0) for r in readings(word, self.letters, self.able) for f in features(r)), default=0.0)

    def spaced(self, run: str) -> float:
        """The strongest entry in a run of letters set apart, whose words may begin and end anywhere.

        From each letter on, what comes next is read as a word; longer repeats of
        a sign than restoring tells apart are shortened first.
        """
        run = _MANY.sub(lambda m: m[1] * 3 if m[1] else "*" * 6, "".join(c for c in run if c not in APART))
        reach = 3 * max(self.inside, default=0)
        most = 0.0
        for i in range(len(run) - LEAST_SPACED + 1):
            for r in readings(run[i : i + reach], self.letters, self.able):
                most = max(most, *(self.lexicon.get(kind + r[:k], 0.0) for k in self.inside if k <= len(r) for kind in "=^"), 0.0)
        return most

    def strength(self, word: str) -> float:
        """Of a word, or of a run of letters set apart, which begins with a blank."""
        found = self.young.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self.spaced(word[1:]) if word[0] == " " else self.weigh(word)
                if len(word) > 64:
                    return found
            if len(self.young) >= CACHE_ENTRIES:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def measure(self, text: str | None) -> tuple[float, float]:
        """log(1 + hits) and the strongest hit."""
        text = lower(text)
        get, words = self.young.get, text.split()
        found = [self.strength(w) if (x := get(w)) is None else x for w in words]
        found += [self.strength(" " + x) for x in apart(text)]
        hits = sum(1 for x in found if x)
        return math.log1p(hits), max(found, default=0.0)

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        hits, most = self.measure(text)
        z = self.weights[0] + self.weights[1] * hits + self.weights[2] * most
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def labelled_sample(rows: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """text, toxic of at most per_label rows of each label, without repeated texts."""
    own = labels.selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic").where(F.col("toxic").isin(0, 1) & (bucket5("doc_id") != 0))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = own.where("toxic = 1").orderBy(*by_hash).limit(per_label).unionByName(own.where("toxic = 0").orderBy(*by_hash).limit(per_label))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most 2 * per_label ids
    found = rows.join(F.broadcast(ids), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return keep(few(found.groupBy("text").agg(F.max("toxic").alias("toxic"))), "labelled")


def learn_lexicon(sample: DataFrame, letters: Letters, size: int = LEXICON) -> dict[str, float]:
    """Log odds of the features most telling of toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            every = seen[0] | seen[1]
            return pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), *(pa.array([seen[k][f] for f in every], pa.int64()) for k in (1, 0))], ["feature", "t", "c"])

        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                text = lower(text.as_py())
                own = {f for w in {*text.split(), *apart(text)} for r in readings(w, letters) for f in features(r)}
                seen[toxic].update(own)
                seen[toxic]["#"] += 1
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield out()
                    seen = {0: Counter(), 1: Counter()}
        yield out()

    counts = keep(few(sample.mapInArrow(lean(run), "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))), "features")
    sums = counts.where("feature = '#'").first()
    if sums is None or not sums["t"] or not sums["c"]:
        return {}
    all_t, all_c = float(sums["t"]), float(sums["c"])
    odds = F.log((F.col("t") + 0.5) / (all_t + 1)) - F.log((F.col("c") + 0.5) / (all_c + 1))
    both = F.col("t") + F.col("c")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    share = all_t / (all_t + all_c)
    llr = part(F.col("t").cast("double"), both * share) + part(F.col("c").cast("double"), both * (1 - share))
    best = counts.where(f"t >= {LEAST_DOCS} and feature <> '#'").select("feature", odds.alias("odds"), llr.alias("llr")).where((F.col("odds") >= LEAST_LOG_ODDS) & (F.col("llr") >= LEAST_LLR))
    return {r["feature"]: r["odds"] for r in best.orderBy(F.desc("llr"), "feature").limit(size).collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Newton's method for logistic regression with a constant."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def train(rows: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Scorer:
    """Learn from rows (doc_id, text) and their labels."""
    letters = Letters(letter_counts(rows))
    sample = labelled_sample(rows, labels, per_label)
    lexicon = learn_lexicon(sample, letters)
    plain = Scorer(letters, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [plain.measure(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()), batch.column(1)], ["hits", "most", "toxic"])

    # 2 * per_label rows of three numbers at most
    seen = [tuple(r) for r in sample.mapInArrow(lean(run), "hits double, most double, toxic int").collect()]
    if not seen or not lexicon:
        return Scorer(letters, lexicon)
    data = np.array(sorted(seen))
    return Scorer(letters, lexicon, fit_logistic(data[:, :2], data[:, 2]))


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    sc = ready(docs.sparkSession).sparkContext
    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text")
    model = sc.broadcast(train(rows, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value
        for big in batches:
            for batch in slices(big, "text"):
                found = [scorer.score(x.as_py()) for x in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(bucket5("doc_id") == 0, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held, "text").mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, most: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with a score below most, unchanged."""
    sc = ready(docs.sparkSession).sparkContext
    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text")
    model = sc.broadcast(train(rows, labels))
    place, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value
        for big in batches:
            for batch in slices(big, text):
                yield batch.filter(pa.array([scorer.score(x.as_py()) < most for x in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(lean(run), schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
