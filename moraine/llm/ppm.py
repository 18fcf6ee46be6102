"""Language-model scores: prediction by partial matching over bytes of texts.

A text is its words (A-Z lower-cased) and an end. The model codes each word
byte by byte and then a blank; the end is one symbol where a word would start.
A context is up to `order` bytes, back to the blank before the text: blanks and
earlier words count, so that the order of words matters. With across=False it
ends at the blank before the word, and each word is coded on its own. A symbol not seen in a context costs an escape
(distinct / (total + distinct)) and is looked for in the context less its
oldest byte, among the symbols not yet excluded; below the empty context all
remaining symbols are equally likely. Probabilities of all texts sum to one.

The trie is pretrained on the training documents, and no context is dropped at
any size. It is kept as a table of grams (a context of up to `order` bytes and
the byte after it) with their counts. A symbol's probability depends on its gram
alone, so every distinct gram is scored once, where all grams that end their
context in the same two bytes meet; shorter contexts are 65536 numbers. What has
followed a context has followed all shorter ones at its end, so the symbols
excluded at a context are those of the next longer one.

The `head_grams` most frequent grams and the `head` most frequent words are sent
to the workers with their scores; all others are joined by a shuffle, so every
byte of every text is scored from counts over all training texts.

The base score is a smoothed unigram over the same tokens.

Null texts are empty: one token, the end. A null doc_id trains and is passed
through; repeated rows count and are scored as often as they occur; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, bucket5, keep, lean, ready, slices, table

ORDER, HEAD, HEAD_GRAMS = 5, 150_000, 700_000
BLANK, END = 0x20, 0x0A
_LOWER = LOWER.tobytes()
#: Distinct words that a task sums up before it hands them on.
FLUSH = 200_000
Trie = dict[bytes, tuple[dict[int, int], int]]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def symbols_log10(s: bytes, trie: Trie, order: int = ORDER) -> float:
    """log10 of the probability of s after its first byte."""
    total, p = 0.0, 1.0
    for i in range(1, len(s)):
        symbol, ctx = s[i], s[max(0, i - order) : i]
        out: set[int] = set()
        while True:
            node = trie.get(ctx)
            if node is not None:
                counts, n = node
                kinds, hit = len(counts), counts.get(symbol)
                if out:
                    for x in out & counts.keys():
                        n -= counts[x]
                        kinds -= 1
                if hit:
                    p *= hit / (n + kinds)
                    break
                if kinds:
                    p *= kinds / (n + kinds)
                    out |= counts.keys()
            if not ctx:
                p /= 256 - len(out)
                break
            ctx = ctx[1:]
        if p < 1e-200:
            total += math.log10(p)
            p = 1.0
    return total + math.log10(p)


def count_words(rows: DataFrame) -> DataFrame:
    """word, c (in training texts), c_all: of all texts; the word '\\n' counts the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            every = seen[True] + seen[False]
            return pa.RecordBatch.from_arrays([pa.array(list(every), pa.binary()), pa.array([seen[False][w] for w in every], pa.int64()), pa.array(list(every.values()), pa.int64())], ["word", "c", "c_all"])

        seen = {True: Counter(), False: Counter()}
        for big in batches:
            for batch in slices(big, "text"):
                for held, x in zip(batch.column(1).to_pylist(), batch.column(2)):
                    seen[held].update(words_of(x.as_py()))
                    seen[held][b"\n"] += 1
                if len(seen[False]) + len(seen[True]) > FLUSH:
                    yield out()
                    seen = {True: Counter(), False: Counter()}
        yield out()

    return rows.mapInArrow(lean(run), "word binary, c long, c_all long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def coded_bytes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts (blank, words with a blank after each, end) and n + 1 offsets; a text's first blank is not coded."""
    parts = [b" ".join((b"", *ws, b"\n")) for ws in words]
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=off[1:])
    return np.frombuffer(b"".join(parts), np.uint8), off


def grams_of(buf: np.ndarray, off: np.ndarray, order: int, across: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each coded byte, and its place: length of the context, then its bytes, then the symbol.

    across: contexts reach back to the text's first blank, not just to the word's.
    """
    first = np.zeros(len(buf), bool)
    first[off[:-1]] = True
    place = np.arange(len(buf))
    start = np.zeros(len(buf), np.int64)
    start[1:] = np.maximum.accumulate(np.where(first if across else buf == BLANK, place, 0))[:-1]
    length = np.minimum(place - start, order)
    gram = buf.astype(np.int64)
    for k in range(1, order + 1):
        gram[k:] |= np.where(length[k:] >= k, buf[:-k].astype(np.int64) << (8 * k), 0)
    gram |= length << (8 * (order + 1))
    return gram[~first], place[~first]


def summed(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their counts."""
    if not len(key):
        return key, *counts
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at], *(np.add.reduceat(c[order], at) for c in counts)


def count_grams(rows: DataFrame, order: int, across: bool) -> DataFrame:
    """gram, c (in training texts), c_all: of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for big in batches:
            for batch in slices(big, "text"):
                words, held = [words_of(x.as_py()) for x in batch.column(2)], batch.column(1).to_pylist()
                for out in (True, False):
                    own = [ws for ws, h in zip(words, held) if h == out]
                    if own:
                        gram, n = np.unique(grams_of(*coded_bytes(own), order, across)[0], return_counts=True)
                        seen = [np.concatenate(x) for x in zip(seen, (gram, n * (not out), n))]
                if len(seen[0]) > 2_000_000:
                    seen = list(summed(*seen))
                    if len(seen[0]) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in seen], ["gram", "c", "c_all"])
                        seen = [np.zeros(0, np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in summed(*seen)], ["gram", "c", "c_all"])

    return rows.mapInArrow(lean(run), "gram long, c long, c_all long").groupBy("gram").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def grams_log10(gram: np.ndarray, c: np.ndarray, shorter: np.ndarray, order: int) -> np.ndarray:
    """log10 of the probability of each gram's symbol.

    gram: all grams whose contexts end in the same two bytes, of any number of
    such pairs. shorter: counts of (byte, symbol) over all training texts.
    """
    two = shorter.reshape(256, 256)
    none = two.sum(0)
    symbol, reach = gram & 255, gram >> (8 * (order + 1))
    lp, done = np.zeros(len(gram)), np.zeros(len(gram), bool)
    more = np.zeros(len(gram), np.int64)  # kinds of symbols in the next longer context
    lost = np.zeros(len(gram), np.int64)  # and what they make up in this one
    longer: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(order, 1, -1):
        own = (reach >= k) & (c > 0)
        levels[k] = summed(gram[own] & ((1 << (8 * (k + 1))) - 1), c[own])
    levels[1] = np.arange(65536), shorter
    levels[0] = np.arange(256), none
    for k in range(order, -1, -1):
        entry, n = levels[k]
        entry, n = entry[n > 0], n[n > 0]
        ctx, at, kinds_of = np.unique(entry >> 8, return_index=True, return_counts=True)
        here = reach >= k
        full = gram & ((1 << (8 * (k + 1))) - 1)

        def find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(asked), np.int64)
            i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
            return np.where(keys[i] == asked, values[i], 0)

        hit = find(entry, n, full)
        kinds = find(ctx, kinds_of, full >> 8)
        total = find(ctx, np.add.reduceat(n, at) if len(n) else n, full >> 8)
        if len(longer[0]):
            # what the symbols of the next longer contexts make up here
            above, first = np.unique(longer[0] >> 8, return_index=True)
            mass = np.add.reduceat(find(entry, n, longer[0] & ((1 << (8 * (k + 1))) - 1)), first)
            lost = np.where(reach > k, find(above, mass, (gram & ((1 << (8 * (k + 2))) - 1)) >> 8), 0)
        left, left_kinds = total - lost, kinds - more
        active = here & ~done
        found, missed = active & (hit > 0), active & (hit == 0) & (left_kinds > 0)
        lp[found] += np.log10(hit[found] / (left + left_kinds)[found])
        lp[missed] += np.log10(left_kinds[missed] / (left + left_kinds)[missed])
        done |= found
        more, longer = np.where(here, kinds, 0), (entry, n)
        lost = np.zeros(len(gram), np.int64)
    return lp - np.where(done, 0.0, np.log10(np.where(done, 1, 256 - more)))


def score_grams(grams: DataFrame, order: int) -> DataFrame:
    """gram, c_all, lp."""
    counts = np.zeros(65536, np.int64)
    for r in grams.where("c > 0").groupBy(F.col("gram").bitwiseAND(F.lit(65535)).alias("k")).agg(F.sum("c").alias("n")).collect():
        counts[r["k"]] = r["n"]
    shorter = grams.sparkSession.sparkContext.broadcast(counts)  # 65536 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[2]), pa.array(grams_log10(x[0], x[1], shorter.value, order), pa.float64())], ["gram", "c_all", "lp"])

        held = np.zeros((3, 0), np.int64)
        for batch in batches:
            held = np.concatenate((held, np.stack([batch.column(i).to_numpy() for i in range(3)])), axis=1)
            ends = (held[0] >> 8) & 65535
            whole = int(np.searchsorted(ends, ends[-1])) if len(ends) else 0  # the last group may go on
            if whole > 50_000:
                yield out(held[:, :whole])
                held = held[:, whole:]
        if held.shape[1]:
            yield out(held)

    ends = F.shiftright("gram", 8).bitwiseAND(F.lit(65535))
    dealt = grams.select("gram", "c", "c_all", ends.alias("ends")).repartition("ends").sortWithinPartitions("ends").select("gram", "c", "c_all")
    return dealt.mapInArrow(lean(run), "gram long, c_all long, lp double")


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def hashed(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A table with open addressing: the number of the key in each slot, or -1; and its bits."""
    bits = max(4, int(len(keys)).bit_length() + 1)
    slots = np.full(1 << bits, -1, np.int64)
    left = np.arange(len(keys))
    at = ((keys.view(np.uint64) * _GOLD) >> np.uint64(64 - bits)).astype(np.int64)
    while len(left):
        free = slots[at] < 0
        slot, i = np.unique(at[free], return_index=True)
        slots[slot] = left[free][i]
        lost = slots[at] != left
        left, at = left[lost], (at[lost] + 1) & ((1 << bits) - 1)
    return slots, bits


def look_up(asked: np.ndarray, keys: np.ndarray, slots: np.ndarray, bits: int) -> np.ndarray:
    """The numbers of the keys asked for; -1 for those that are none."""
    out = np.full(len(asked), -1, np.int64)
    at = ((asked.view(np.uint64) * _GOLD) >> np.uint64(64 - bits)).astype(np.int64)
    left = np.arange(len(asked))
    while len(left):
        i = slots[at]
        same = (i >= 0) & (keys[i] == asked[left])
        out[left[same]] = i[same]
        go = (i >= 0) & ~same
        left, at = left[go], (at[go] + 1) & ((1 << bits) - 1)
    return out


def least_grade(scored: DataFrame, grade: F.Column, head: int) -> int:
    """The least grade that no more than head rows reach, from a histogram of at most 16 * 64 rows."""
    seen = 0
    for r in scored.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).orderBy(F.desc("g")).collect():
        seen += r["n"]
        if seen > head:
            return r["g"] + 1
    return 0


def score_texts(docs: DataFrame, order: int = ORDER, head: int = HEAD, head_grams: int = HEAD_GRAMS, across: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. order: 2 to 6."""
    sc = ready(docs.sparkSession).sparkContext
    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text")
    rows = rows.select("doc_id", F.coalesce(bucket5("doc_id") == 1, F.lit(False)).alias("held_out"), "text")
    words = keep(count_words(rows), "words")
    sums = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0
    coded = keep(score_grams(keep(count_grams(rows, order, across), "grams"), order), "coded")
    base = F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (v + 1)))
    scored = words.select("word", "c_all", (F.col("c") > 0).alias("known"), base.alias("base"))
    # the most frequent words and grams, `head` and `head_grams` of them at most
    grade = F.floor(F.log2(F.col("c_all").cast("double")) * 16)
    least, least_gram = least_grade(scored, grade, head), least_grade(coded, grade, head_grams)
    common = {bytes(r["word"]): (r["known"], r["base"]) for r in scored.where((grade >= least) | (F.col("word") == F.lit(b"\n"))).toLocalIterator()}
    names = sc.broadcast((list(common), np.array([x[0] for x in common.values()] + [0], np.int64), np.array([x[1] for x in common.values()] + [0.0])))
    most = coded.where(grade >= least_gram).select("gram", "lp").toArrow().combine_chunks()
    keys = most.column("gram").to_numpy()
    often = sc.broadcast((keys, np.append(most.column("lp").to_numpy(), 0.0), *hashed(keys)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, known, base_of = names.value
        keys, lp_of, slots, bits = often.value
        number = {w: i for i, w in enumerate(listed)}
        row = TaskContext.get().partitionId() << 40
        for big in batches:
            for batch in slices(big, "text"):
                texts, out = [words_of(x.as_py()) for x in batch.column(2)], []
                buf, off = coded_bytes(texts)
                gram, place = grams_of(buf, off, order, across)
                i = look_up(gram, keys, slots, bits)
                lps = np.zeros(len(buf))
                lps[place] = lp_of[i]
                lps = np.add.reduceat(lps, off[:-1]).tolist()
                far = i < 0
                cut = np.searchsorted(place[far], off)
                grams = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(gram[far], pa.int64()))
                for words, lp in zip(texts, lps):
                    words.append(b"\n")
                    at = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                    rare = Counter(compress(words, (at < 0).tolist()))
                    out.append((row, len(words), int(known[at].sum()), float(base_of[at].sum()), lp, [{"word": w, "tf": k} for w, k in rare.items()]))
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), kinds)), grams], ["doc_id", "held_out", "row", "n_tokens", "known", "base", "lp", "rare", "grams"])

    matched = keep(rows.mapInArrow(lean(match), "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, lp double, rare array<struct<word:binary,tf:long>>, grams array<long>"), "matched")
    rare = matched.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    rare = rare.join(scored.where(grade < least), "word").select("row", (F.col("known").cast("long") * F.col("tf")).alias("known"), (F.col("base") * F.col("tf")).alias("base"), F.lit(0.0).alias("lp"))
    far = matched.select("row", F.explode("grams").alias("gram")).join(coded.where(grade < least_gram), "gram")
    rare = rare.unionByName(far.select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "lp"))
    rare = rare.groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("lp").alias("lp"))
    zero = lambda c: F.coalesce(rare[c], F.lit(0))
    return matched.drop("rare", "grams").join(rare, "row", "left").select(
        matched["doc_id"], "held_out", "n_tokens", (matched["known"] + zero("known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (matched["base"] + zero("base")).alias("base_score"), (matched["lp"] + zero("lp")).alias("score"),
    )


def op9_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), across=True)
