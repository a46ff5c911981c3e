"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableops.llm.texts import slices

#: Bytes that are broadcast at most: 16 for each value, and what texts and lists hold besides.
MOST_SENT = 32 << 20


def sent_if_small(df: DataFrame) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its rows are counted to be small together."""
    sizes = [F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary")] + [F.size(c) * 16 for c, kind in df.dtypes if kind.startswith("array")]
    row = sum((F.coalesce(x, F.lit(0)) for x in sizes), F.lit(16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= MOST_SENT else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids kept for evaluation; a missing id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def with_text_columns(df: DataFrame, text: str, fields: dict[str, T.DataType], work: Callable, keep: list[str] | None = None) -> DataFrame:
    """Add the columns that ``work`` makes of the text column, one Arrow batch at a time.

    ``work`` gets the texts of up to 1 MB and returns one array for each field. ``keep`` names
    the columns that go through; all by default. A new column's name must be free. No shuffle.
    """
    keep = df.columns if keep is None else keep
    if taken := {c.lower() for c in keep} & {c.lower() for c in fields}:
        raise ValueError(f"the table has columns called {sorted(taken)}; give other names for the new ones")
    small_batches(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tokens()
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                made = [pa.array(x) for x in work(part.column(text))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + made, names=[*keep, *fields])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def sampled_rows(rows: DataFrame, most: int, most_bytes: int, marks: DataFrame | None = None) -> DataFrame:
    """At most ``most`` different rows of (id, text, ...) of up to ``most_bytes`` each, the same ones on every run.

    Rows are taken by the hash of id and text, so that an id that many rows share does not count for
    all of them. With ``marks`` (one row for each id) only marked rows are taken, and their columns added.
    Texts stay where they are until the sample, a list of hashes, is known. Adds ``h``, the hash.
    """
    hashed = rows.withColumn("h", F.xxhash64("id", "text"))
    keys = hashed.where(F.col("id").isNotNull() & (F.octet_length("text") <= most_bytes)).select("id", "h")
    if marks is not None:
        keys = keys.join(marks, "id")
    chosen = F.broadcast(keys.drop("id").dropDuplicates(["h"]).orderBy("h").limit(most))
    return hashed.join(chosen, "h").dropDuplicates(["h"])


def small_batches(spark: SparkSession) -> None:
    """Have Spark send texts to Python tasks in batches of 8 MB, unless the session asks for another size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(name, "8m")


def forget_tokens() -> None:
    """Drop what tokenizers of earlier tasks remember in this Python worker."""
    for name in ("_tableops_encoders", "_tableops_aligners"):
        if sys.modules.pop(name, None):
            pa.default_memory_pool().release_unused()
