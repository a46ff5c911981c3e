"""The three trained models: what they learn, and what they do with odd rows."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tableops.llm import language, quality, toxicity
from tableops.llm.frames import held_out
from tableops.llm.queries import op6_language, op7_toxicity, op9_quality

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (2, ""), (3, " \t1 % "), (None, "some words here"), (5, "word " * 200_000)]


def test_toxicity_learns_a_word_list(spark):
    rng = random.Random(4)
    data = []
    for i in range(1500):
        w = [rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.randrange(10, 60))]
        bad = i % 5 == 0
        if bad:
            w[:2] = [rng.choice(("Vile,", "FOUL", "grimly")), rng.choice(("vileness", "foul"))]
            rng.shuffle(w)
        data.append((i, " ".join(w), int(bad)))
    frame = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    learned = frame.where(~held_out(F.col("doc_id")))
    model = toxicity.fit(learned.select("doc_id", "text"), learned.select("doc_id", "toxic"))
    assert 0 < len(model.places) < 5000
    found = toxicity.scored(frame.where(held_out(F.col("doc_id"))), model).collect()
    assert np.mean([(r["score"] >= 0.7) == bool(r["toxic"]) for r in found]) > 0.97
    odd = spark.createDataFrame([(i, t, 0.0) for i, t in ODD], "doc_id long, text string, score double")
    out = toxicity.scored(odd, model, score="tox").collect()
    assert len(out) == len(ODD) and all(0 <= r["tox"] <= 1 for r in out) and len({r["tox"] for r in out if not (r["text"] or "").strip()}) == 1
    assert toxicity.without_toxic(odd, model).columns == odd.columns and toxicity.scored(odd.limit(0), model, score="tox").count() == 0


def test_toxicity_without_labels_of_both_kinds(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert all(r["score"] < 1e-9 for r in toxicity.scored(frame, toxicity.fit(frame, none)).collect())
    only = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, toxic int")
    assert all(r["score"] > 1 - 1e-9 for r in toxicity.scored(frame, toxicity.fit(frame, only)).collect())


def test_features_do_not_depend_on_the_batch():
    texts = ["You are vile", None, "vile vile are", "", "x y z"]
    places, of, n = toxicity.features(pa.array(texts))
    for i, text in enumerate(texts):
        alone, _, _ = toxicity.features(pa.array([text], pa.string()))
        assert sorted(places[of == i]) == sorted(alone)
    assert n == 5


def test_languages(spark):
    rng = random.Random(8)
    parts = {"aa": ("lor", "emi", "psu"), "bb": ("zwo", "ich", "und"), "cc": ("é", "çais", "eau")}
    data = [(i, lang, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(12))) for i, lang in enumerate(rng.choices(list(parts), k=600))]
    frame = spark.createDataFrame(data, "doc_id long, lang string, text string")
    model = language.fit(frame.where(~held_out(F.col("doc_id"))))
    found = language.predicted(frame.where(held_out(F.col("doc_id"))), model).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.99 and all(0 <= r["score"] <= 1 for r in found)
    odd = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, score string")
    out = language.predicted(odd, model, score="p").collect()
    assert [r["lang_pred"] == "und" and r["p"] == 0 for r in out] == [not any(c.isalpha() for c in t or "") for _, t in ODD]
    kept = language.of_languages(odd, model, least=0)
    assert kept.columns == odd.columns and kept.count() == 2
    empty = language.fit(odd.withColumn("lang", F.lit(None)))
    assert {r["lang_pred"] for r in language.predicted(odd, empty, score="p").collect()} == {"und"}
    assert language.predicted(odd.limit(0), model, score="p").count() == 0


def test_label_model_finds_the_good_labellers():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.6, 0.5])
    votes = np.where(rng.random((20_000, 8)) < right, good[:, None], ~good[:, None])
    codes = np.where(votes, 1, 2) @ (3 ** np.arange(8))
    posterior, rates, share = quality.label_model(np.bincount(codes, minlength=quality.PATTERNS))
    assert abs(share - 0.8) < 0.05 and np.abs(rates[0, :, 1] - right).max() < 0.05
    assert ((posterior[codes] >= 0.5) == good).mean() > 0.95


def test_quality_of_odd_rows(spark):
    rng = random.Random(5)
    fine = [" ".join(rng.choice("abcdef") * rng.randrange(1, 5) + "." * (rng.random() < 0.1) for _ in range(80)) for _ in range(80)]
    junk = ["SALE!! " * 60, "a | b | " * 40, "same " * 80, "x%%% y$$$ " * 40] * 5
    frame = spark.createDataFrame([(i, t, "k") for i, t in enumerate(fine + junk)] + [(i, t, "k") for i, t in ODD[:4]], "doc_id long, text string, score string")
    found = quality.scored(frame, quality.fit(frame), score="q").collect()
    marks = {r["doc_id"]: r["q"] for r in found if r["text"] and len(r["text"]) > 20}
    assert min(marks[i] for i in range(80)) > 0.5 > max(marks[i] for i in range(80, 100))
    assert all(r["q"] == 0 and r["weak_label"] == 0 for r in found if not (r["text"] or "").strip())
    none = frame.limit(0)
    assert quality.scored(none, quality.fit(none), score="q").count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_held_out_rows_of_the_test_tables(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    lang = op6_language(spark, FOLDER).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.where("lang = lang_pred").count() >= 0.97 * lang.count()
    toxic = op7_toxicity(spark, FOLDER).where("held_out").join(labels, "doc_id")
    assert toxic.where("toxic = 0 and predicted = 1").count() == 0 and toxic.where("toxic = predicted").count() >= 0.85 * toxic.count()
    good = op9_quality(spark, FOLDER).join(labels, "doc_id")
    assert good.where("quality = predicted").count() >= 0.95 * good.count()


def test_language_rejects_what_it_never_learned(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    foreign = ["Это русский текст о погоде и природе", "日本語の文章です、東京へ行きました", "xqzk vwpj kqxz zzqx jjwv", "ภาษาไทยเป็นภาษาที่ใช้", "0x1f 0x2e", "{}"]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    assert language.of_languages(odd, model).count() == 0
    clean = docs.where(held_out(F.col("doc_id")))
    assert language.of_languages(clean, model).count() >= 0.99 * clean.count()
    scores = [r["score"] for r in language.predicted(clean, model, keep=["doc_id"]).collect()]
    assert len({round(s, 4) for s in scores}) > 20


@pytest.mark.parametrize("module", [language, quality, toxicity])
def test_learning_takes_a_bounded_number_of_rows(spark, monkeypatch, module):
    from tableops.llm.frames import sampled_rows

    one_id = spark.range(500).select(F.lit(7).cast("long").alias("id"), F.concat(F.lit("text "), F.col("id") % 100).alias("text"))
    marks = spark.createDataFrame([(7, 1)], "id long, mark int")
    for found in (sampled_rows(one_id, 20, 100), sampled_rows(one_id, 20, 100, marks)):
        rows = found.collect()
        assert len(rows) == len({r["text"] for r in rows}) == 20
    assert sampled_rows(one_id, 20, 3).count() == 0
    assert module.Fitting().most_bytes == 1 << 20


def test_names_that_are_taken_are_refused(spark):
    docs = spark.createDataFrame([(1, "some text", "en", 0.5)], "doc_id long, text string, lang string, score double")
    with pytest.raises(ValueError, match="score"):
        language.predicted(docs, language.fit(docs))
    with pytest.raises(ValueError, match="score"):
        quality.scored(docs, quality.fit(docs))
