"""The pipeline's stages on the smallest tables, and planted cases through all of them."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_run_keeps_the_contract(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.dtypes == docs.dtypes and 0 < after.count() <= before.count()
        before = after
    out = corpus_pipeline.run(spark, SMALL)
    assert 0 < out.count() <= docs.count() and "taken" in out.columns


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    folder = tmp_path_factory.mktemp("corpus")
    text = lambda n: " ".join(f"v{rng.randrange(50000)}" for _ in range(n))
    passage, item = text(60), text(30)
    base = text(120)
    changed = base.split(" ")
    changed[30] = "other"
    texts = {i: text(80) for i in range(30)} | {40: f"{text(50)}\n{passage}", 41: f"{text(50)}\n{passage}", 42: base, 43: base, 44: " ".join(changed), 45: f"{text(40)} {item} {text(40)}", 46: ""}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts, passage, item


def test_planted_cases(spark, planted):
    folder, texts, passage, item = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert all(kept[i] == texts[i] for i in range(30)) and kept[40] == texts[40] and kept[46] == ""
    assert kept[41] == texts[41].split("\n")[0] and 43 not in kept and 44 not in kept and kept[42] == texts[42]
    assert item not in kept[45] and kept[45].startswith(texts[45][:100])


def test_toxicity_stage_learns_from_all_labelled_rows(spark, tmp_path, monkeypatch):
    docs = spark.range(4400).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.lit("en").alias("lang"))
    docs.selectExpr("doc_id", "1 AS quality", "CAST(doc_id % 2 AS INT) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    learned = []
    monkeypatch.setattr(corpus_pipeline.toxic, "train", lambda *given: learned.append(given[-1]))
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == 4400
    ties = {r.doc_id: r.tie for r in docs.select("doc_id", F.xxhash64("text").alias("tie")).collect()}
    assert learned == [sum(zlib.crc32(str(i).encode()) % 5 != 0 and tie % 4 != 0 for i, tie in ties.items())]
