"""Token ids in ORC files, in ascending order of document ids.

Each row is a document: its id, how many ids, where it starts among those of its file part, and
the ids themselves. Integer columns are stored as ORC run lengths (direct, delta or patched) in
stripes; every stripe has row indexes, and Bloom filters on the document id, so a reader skips
stripes and row groups by metadata and many readers share a file by stripes.

The documents are dealt out by ranges of their ids and sorted within each; the text travels, not the ids,
which are made where they are written; there are as many ranges as their bytes ask for. A part knows its number, so that a small table with the
number of ids of each part gives every document its place in the whole.

Defined results: a missing or empty text is the end id alone. A missing id sorts first. Rows that
repeat an id follow one another, ordered by their text; which of two rows that are the same comes
first makes no difference. An empty table makes files without rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableops.llm.frames import sent_if_small, small_batches
from tableops.llm.texts import slices
from tableops.llm.tokens import encoder, lists
from tableops.plans.scratch import written

#: Options of the ORC writer: rows of a row group, Bloom filters, bytes of a stripe.
OPTIONS = {
    "orc.row.index.stride": "10000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.stripe.size": str(64 << 20),
    "compression": "zstd",
}
SCHEMA = "doc_id long, part int, place long, start long, n_tokens long, ids array<int>"


#: Bytes of text that a task encodes and writes, about.
PART_BYTES = 256 << 20
#: Bytes of text that are encoded at a time.
ENCODED_BYTES = 2 << 20


def write(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode all texts and write them to ORC files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, start, place = TaskContext.get().partitionId(), encoder(tokenizer_json), 0, 0
        for batch in batches:
            for rows in slices(batch, "text", ENCODED_BYTES):
                own = [np.append(ids, np.uint32(end_id)) for ids in encode(rows.column("text").to_pylist())]
                n = np.array([len(x) for x in own], np.int64)
                starts = start + np.cumsum(n) - n
                columns = [rows.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(place + np.arange(len(n))), pa.array(starts), pa.array(n), lists(own)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "place", "start", "n_tokens", "ids"])
                start, place = start + int(n.sum()), place + len(n)

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not parts:
        total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    dealt = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "tie")
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written documents, ``start`` counted over all files: doc_id, start, n_tokens, ids."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    totals = sent_if_small(written(totals, "totals"))  # one row for each file part
    return rows.join(totals, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def checked(found: DataFrame) -> DataFrame:
    """Read documents with ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) for their ids."""
    from tableops.llm.tokens import crc32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            sums = [crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
