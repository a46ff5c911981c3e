from pathlib import Path

import pytest

import corpus_pipeline
from tableops.llm import jaccard
from tests.llm.test_jaccard import plain_groups

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_each_stage_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_copies", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        assert kept.columns == docs.columns
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in kept.collect()}
        assert after.items() <= before.items() and len(after) >= 0.8 * len(before)
        if name == "near_copies":
            least = [(i, c, n) for i, n, c in plain_groups([(i, r["text"]) for i, r in before.items()], jaccard.Rule())]
            assert set(after) == {i for i, c, n in least if i == c or not n}
        docs = kept
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in placed} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, FOLDER).count() == len(placed)


def test_stages_take_odd_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (10**6, ""), (10**6, ""), (10**6 + 1, "Это русский текст о погоде и природе"), (10**6 + 2, "xqzk vwpj kqxz zzqx jjwv"), (None, "the of and to " * 20000)], "doc_id long, text string")
    rows = docs.unionByName(odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "n_chars": F.lit(None).cast("long")}))
    rows = rows.unionByName(docs.limit(20)).withColumns({c: F.lit("clash") for c in ("id", "score", "lang_pred", "h", "n", "component")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.written(stage(spark, rows, FOLDER), name)
        assert kept.columns == rows.columns
        if name == "language":
            assert kept.where((F.col("doc_id") >= 10**6) | F.col("text").isNull()).count() == 0
        assert stage(spark, rows.limit(0), FOLDER).count() == 0
        rows = kept
    assert rows.count() >= 0.8 * docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).select("doc_id").distinct().count() >= 0.8 * docs.count()
