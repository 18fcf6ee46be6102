"""Licence scan with a positional index of rare licence words.

Template words are indexed by (template, position). One pass counts in how many
documents each template word occurs; their inverse frequencies rank the words.
A document looks up its rarest licence words, and for every template whose key
words it holds that template's rarest key word; each place of such a word with
each posting votes for a template at an offset. An offset counts if every key
phrase of the template stands there word for word; its score is the share of
the template's words that stand there. Base phrases are found at all places.

Null texts are empty; a null doc_id is passed through; repeated rows give
repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ready, slices, table

# Phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label, wording of public licence notices, key phrases that must be there.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "the gnu lesser general public license", ("gnu lesser general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", ("permission to use copy modify", "with or without fee")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    ("reserved", "copyright all rights reserved", ("all rights reserved",)),
)
RAREST = 12
_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


class Index:
    """Templates, their postings and the document frequencies of their words."""

    def __init__(self, templates=TEMPLATES, df: dict[bytes, int] | None = None, n_docs: int = 0):
        self.labels = [t[0] for t in templates]
        self.words = [t[1].encode().split() for t in templates]
        self.keys = [self.placed(w, t[2]) for w, t in zip(self.words, templates)]
        self.vocabulary = frozenset(w for ws in self.words for w in ws)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            for q, w in enumerate(ws):
                self.postings[w].append((t, q))
        df = df or {}
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 0.5)) for w in self.vocabulary}
        self.needed = [frozenset(w for _, phrase in keys for w in phrase) for keys in self.keys]
        self.rarest = [min(need, key=lambda w: (-self.idf[w], w)) for need in self.needed]
        self.base = [(tuple(p.encode().split()), label) for p, label in BASE.items()]

    @staticmethod
    def placed(words: list[bytes], phrases: tuple[str, ...]) -> list[tuple[int, list[bytes]]]:
        """Each key phrase with its first place in the template."""
        out = []
        for phrase in phrases:
            p = phrase.encode().split()
            out.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
        return out

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, str, str, float]:
        """n_base, first_word, last_word, base_labels, labels, score."""
        have = set(words)
        places: list[int] = []
        labels: set[str] = set()
        for phrase, label in self.base:
            if have.issuperset(phrase):
                found = [i for i, w in enumerate(words) if w == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase]
                if found:
                    places += found
                    labels.add(label)
        more, score = set(labels), 0.0
        able = {t for t, need in enumerate(self.needed) if have.issuperset(need)}
        if able:
            seen = sorted(have & self.vocabulary, key=lambda w: (-self.idf[w], w))[:RAREST]
            look = {self.rarest[t] for t in able} | set(seen)
            votes: Counter[tuple[int, int]] = Counter()
            for p, w in enumerate(words):
                if w in look:
                    for t, q in self.postings[w]:
                        if t in able:
                            votes[t, p - q] += 1
            for t, offset in votes:
                if all(words[max(0, offset + k) : max(0, offset + k + len(phrase))] == phrase for k, phrase in self.keys[t]):
                    wanted = self.words[t]
                    same = sum(words[offset + k] == w for k, w in enumerate(wanted) if 0 <= offset + k < len(words))
                    score = max(score, same / len(wanted))
                    more.add(self.labels[t])
        join = lambda x: ",".join(sorted(x))
        return len(places), min(places, default=None), max(places, default=None), join(labels), join(more), score


def licence_word_counts(rows: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("text")):
                df.update(vocabulary.intersection(words_of(x.as_py())))
                n += 1
        df[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in df]), pa.array(list(df.values()), pa.int64())], ["word", "n"])

    # one row for each template word at most
    found = {r["word"].encode(): r["n"] for r in rows.select("text").mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found, found.pop(b"", 0)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    ready(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text")
    df, n = licence_word_counts(rows, Index(templates).vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, df, n)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        for big in batches:
            for batch in slices(big, "text"):
                found = []
                for x in batch.column(1):
                    words = words_of(x.as_py())
                    found.append((len(words), *index.scan(words)))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found), kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return rows.mapInArrow(lean(run), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
