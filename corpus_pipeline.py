"""From raw documents to packed training sequences, one written table after another.

Each stage gets what the stage before it kept. The first four return the columns of ``documents``:

1. ``toxicity`` drops documents that score 0.7 or more.
2. ``language`` drops documents without a letter and those that score below 0.5 in every learned language: text in other
   scripts and languages, junk, data.
3. ``near_copies`` keeps one document of each group that is linked by five-word shingles (0.8 or more).
4. ``decontamination`` drops documents that hold a benchmark item.
5. ``packing`` places the token ids of the rest in sequences of 4,096.

Nulls, repeated rows, empty tables and further columns are treated as the stages' operators say: a missing or
empty text is clean, has no language and goes in stage 2; equal rows are copies of each other, of which one stays; an
empty table passes through all stages; columns beside doc_id and text are carried along as they are.

Models are fitted on the stage's own input, on the two thirds of ids that are not held out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.llm import decontaminate, jaccard, language, packing, toxicity
from tableops.llm.frames import held_out
from tableops.llm.queries import table, tokenizer_json
from tableops.plans.scratch import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = ~held_out(F.col("doc_id"))
    model = toxicity.fit(docs.where(learned), table(spark, sf_dir, "labels").where(learned))
    return toxicity.without_toxic(docs, model, least=0.7)


def of_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.of_languages(docs, language.fit(docs.where(~held_out(F.col("doc_id")))), least=0.5)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_near_copies(docs, jaccard.Rule(size=5, under=80, over=100))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = packing.packed_documents(docs, tokenizer_json(), end_id=1, remembered=300_000, forget=True)
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("language", of_known_language),
    ("near_copies", without_near_copies),
    ("decontamination", without_leaks),
    ("packing", packed),
]

#: Trained models and tokenizers are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
