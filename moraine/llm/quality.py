"""Quality rules by host: rule failures, shrunk by an empirical beta prior, decide hosts.

Every document is measured once. A document fails if it breaks a base rule
(too few words, too many words in repeated five-word windows) or one of the
softer rules (symbols, repeated lines, word length). Failures are counted by
host; a beta prior is fitted to all hosts' failure rates by the method of
moments, each host's rate is shrunk towards it, and a host whose shrunk rate
exceeds `most` is rejected with all its documents. A document that breaks a
base rule goes in any case; a document that breaks only a soft rule stays
unless its host goes.

Null texts have no words (and so fail); null hosts form one host of their own,
the empty name another; a null doc_id is passed through; repeated rows count as
often as they occur; texts are measured whole, however long; a host whose rate
equals the bound stays. An empty table gives no rows. Other columns are not read, or pass through keep_good.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, fresh, keep, lean, ready, slices, table, text_bytes

LEAST_WORDS = 10
MOST_REPEAT_PERCENT = 20
MOST_SYMBOL_PERCENT = 10
MOST_DUP_LINE_PERCENT = 50
WORD_LENGTH = (2, 16)
MOST_FAILED = 0.5
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = False
NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of so many words that occur twice or more."""
    windows = list(zip(*(words[k:] for k in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    n = end = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            n += i + size - max(i, end)
            end = i + size
    return n


def measure(texts: pa.Array) -> list[tuple[int, ...]]:
    """NUMBERS of each text."""
    buf, off = text_bytes(texts)

    def counted(flags: np.ndarray) -> list[int]:
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flags[buf], out=total[1:])
        return (total[off[1:]] - total[off[:-1]]).tolist()

    data, rows = buf.tobytes(), []
    for a, b, chars, symbols in zip(off[:-1].tolist(), off[1:].tolist(), counted(_INSIDE), counted(_SYMBOLS)):
        doc = data[a:b]
        words = doc.split()
        lines = [x for x in doc.split(b"\n") if x and not x.isspace()]
        rows.append((len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)))
    return rows


def base_failed() -> F.Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))


def any_failed() -> F.Column:
    return (
        base_failed()
        | (100 * F.col("n_symbols") > MOST_SYMBOL_PERCENT * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > MOST_DUP_LINE_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < WORD_LENGTH[0] * F.col("n_words"))
        | (F.col("word_chars") > WORD_LENGTH[1] * F.col("n_words"))
    )


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and NUMBERS of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, "text"):
                found = zip(*measure(batch.column(2)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in found)], ["doc_id", "host", *NUMBERS])

    ready(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{host}` as string) host", f"cast(`{text}` as string) text")
    return rows.mapInArrow(lean(run), "doc_id long, host string, " + ", ".join(f"{x} long" for x in NUMBERS))


def host_verdicts(found: DataFrame, most: float = MOST_FAILED) -> DataFrame:
    """Per host: n, failed, its shrunk failure rate, and whether it is bad."""
    hosts = found.groupBy("host").agg(F.count("*").alias("n"), F.sum(any_failed().cast("long")).alias("failed"))
    hosts = keep(few(hosts), "hosts")
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("h"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff")).first()
    if not all_["n"]:
        return hosts.select("host", "n", "failed", F.lit(0.0).alias("rate"), F.lit(False).alias("bad"))
    mean = all_["f"] / all_["n"]
    within = mean * (1 - mean)
    spread = all_["ff"] / all_["n"] - mean * mean - within * all_["h"] / all_["n"]
    strength = 1e6 if spread <= 0 else min(1e6, max(2.0, within / spread - 1))
    rate = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate > most).alias("bad"))


def judge(docs: DataFrame, most: float = MOST_FAILED, **names: str) -> DataFrame:
    """NUMBERS, base_failed, the host's rate and kept for every document."""
    found = keep(measured(docs, **names), "measured")
    bad = host_verdicts(found, most).select(F.col("host").alias("of"), "rate", "bad")
    return found.join(bad, F.col("host").eqNullSafe(F.col("of"))).select("doc_id", *NUMBERS, base_failed().alias("base_failed"), F.col("rate").alias("host_rate"), (~base_failed() & ~F.col("bad")).alias("kept"))


def keep_good(docs: DataFrame, most: float = MOST_FAILED, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that pass, unchanged. Texts are measured again where they lie, not shuffled."""
    own = fresh("_bad_host", docs.columns)
    bad = host_verdicts(keep(measured(docs, doc_id, text, host), "measured"), most).where("bad").select(F.col("host").alias(own))
    place, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, text):
                fine = [x[0] >= LEAST_WORDS and 100 * x[4] <= MOST_REPEAT_PERCENT * x[0] for x in measure(batch.column(place))]
                yield batch.filter(pa.array(fine, pa.bool_()))

    kept = docs.mapInArrow(lean(run), schema)
    return kept.join(bad, kept[host].cast("string").eqNullSafe(bad[own]), "left_anti")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = rf"""
with d as materialized (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
e as (select r, ws, unnest(generate_series(1, len(ws) - 4)) as p from w where len(ws) >= 5),
g as (select r, p, count(*) over (partition by r, array_to_string(ws[p : p + 4], ' ')) as c from e),
k as (select r, unnest([p, p + 1, p + 2, p + 3, p + 4]) as q from g where c > 1),
rep as (select r, count(distinct q) as n from k group by r),
m as (
  select d.r, doc_id, host, len(ws)::bigint as n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(ls) as n_lines
  from d join w using (r) left join rep using (r)),
f as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words as base_failed from m),
a as (select *, base_failed or 100 * n_symbols > {MOST_SYMBOL_PERCENT} * n_words or 100 * n_dup_lines > {MOST_DUP_LINE_PERCENT} * n_lines
    or word_chars < {WORD_LENGTH[0]} * n_words or word_chars > {WORD_LENGTH[1]} * n_words as failed from f),
h as (select host, count(*)::double as n, count(*) filter (failed)::double as f from a group by host),
s as (select sum(f) / sum(n) as mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2 - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) as spread from h),
v as (select host, (f + mean * st) / (n + st) > {MOST_FAILED} as bad from h, (select mean, case when spread <= 0 then 1e6 else least(1e6, greatest(2.0, mean * (1 - mean) / spread - 1)) end as st from s))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not bad as kept from a join v on a.host is not distinct from v.host
"""
