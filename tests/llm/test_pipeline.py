"""The pipeline equals its stages' plain versions, one after the other."""

import random
from collections import Counter

import corpus_pipeline
import test_linedup
import test_neardup
import test_quality

from moraine.llm import toxicity
from moraine.llm.bpe import default_path, word_bpe


def fixture(spark, docs, at):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(words, k=12))
    rows, labels = [], []
    for i in range(120):
        text = "\n".join(" ".join(rng.choices(words, k=rng.randint(6, 30))) for _ in range(rng.randint(1, 5)))
        if i % 6 == 0:
            text += "\nyou stupid idiot"
        if i % 7 == 1:
            text += "\n" + line
        if i % 10 == 3:
            text = "short text"
        if i % 10 == 4 and rows:
            text = rows[-3][1].replace("w1 ", "x1 ").replace("\n", " ")
        rows.append((i, text))
        labels.append((i, 1, int(i % 6 == 0 and i % 10 not in (3, 4))))
    rows += [(200, None), (201, "")]
    docs(rows).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return rows


def test_pipeline(spark, docs, tmp_path):
    rows = fixture(spark, docs, tmp_path)
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    bad = {r.doc_id for r in toxicity.scored(docs(rows), labels).where("score >= 0.5").collect()}
    assert bad and len(bad) < 40
    left = [(i, t) for i, t in rows if i not in bad]
    left = [(i, t) for i, t in left if not test_quality.brute(t)[-1]]
    cut = [(i, "\n".join(kept), n, gone) for (i, _), (n, gone, kept) in zip(left, test_linedup.brute(left, 8))]
    left = [(i, t) for i, t, n, gone in cut if not gone or gone < n]
    keep = {k[0] for k in test_neardup.brute(left, 5, 80) if k[3]}
    left = [(i, t) for i, t in left if i in keep]
    bpe = word_bpe(default_path())
    assert Counter((r.doc_id, r.length) for r in got) == Counter((i, len(bpe.encode(t)) // 4 + 1) for i, t in left)


def test_stages_keep_the_columns(spark, docs, tmp_path):
    fixture(spark, docs, tmp_path)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
