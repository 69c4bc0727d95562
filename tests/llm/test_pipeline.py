import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import bpe

FR = "le chat dort sur la table avec une pomme rouge et il regarde la lune dans le ciel noir".split()
EN = "the cat sleeps on the table with a red apple and it looks at the moon in the black sky".split()


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(8)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        words = FR if i % 3 == 0 else EN
        body = text(words, 40)
        if i % 5 == 0:
            body += " you moron. worthless scum. " + text(words, 5)
        rows.append((i, body, "fr" if i % 3 == 0 else "en", "s", len(body), 0.5))
        labels.append((i, 1, int(i % 5 == 0)))
    item = text(EN, 14)
    extra = [(1000, None), (1001, ""), (1002, "12 34 ..."), (1003, text(EN, 20) + " " + item + " " + text(EN, 20)), (1004, rows[1][1]), (1005, rows[1][1] + " more"), (1006, "short"), (1007, "word " * 8000), (1008, text(EN, 30)), (1008, text(EN, 31)), (None, text(FR, 50))]
    rows += [(i, t, None, None, None, None) for i, t in extra]
    path = tempfile.mkdtemp(prefix="quillstone-") + "/sf"
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage_takes_what_it_should(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == columns
        ids[name] = {r["doc_id"] for r in docs.collect()}
    assert before - ids["toxicity"] == {i for i in range(300) if i % 5 == 0}
    assert ids["toxicity"] - ids["language"] == {1000, 1001, 1002, 1007}  # 1007 is one word of neither language
    gone = ids["language"] - ids["near_dedup"]
    assert {1004, 1005} <= gone and not gone & {1, 1003, 1006, 1008, None} and None in ids["near_dedup"]
    assert ids["near_dedup"] - ids["decontamination"] == {1003}
    assert docs.where("doc_id = 1008").count() == 1
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    own, texts = bpe.coder(bpe.vocabulary_path()), {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(out) == len(texts) and all(r["ids"] == own.ids(texts[r["doc_id"]]) and own.text(r["ids"]) == texts[r["doc_id"]] for r in out)


def test_the_whole_run_and_empty_tables(spark, folder):
    from pathlib import Path

    from quillstone.llm._store import shared_folder

    shared = Path(shared_folder(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    assert corpus_pipeline.run(spark, folder).count() > 100
    assert [p.name.partition("-")[0] + p.name[5:9] for p in set(shared.iterdir()) - before] == ["stage-bpe"]
    empty = tempfile.mkdtemp(prefix="quillstone-") + "/sf"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(os.path.join(empty, f"{name}.parquet"))
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_carry_columns_of_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 OR doc_id > 999").withColumn("my col", F.lit(1)).withColumn("a.b`c", F.lit("x")).withColumn("n_hit", F.lit(0)).withColumn("lang_rejected", F.lit(True))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == columns
    assert docs.count() > 20
