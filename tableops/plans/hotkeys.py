"""Finding keys that hold so many rows, or so many bytes, that one task must not own them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tableops.columns import col, free_name
from tableops.plans.scratch import written

# A key below this many rows and this many bytes is left to one task.
HOT_ROWS = 2_000_000
HOT_BYTES = 2 << 30
SAMPLE = 0.01
# The rows of a key are weighed from this part of ``hot_rows`` on.
WEIGHED = 100
# With keys that give many rows go those that give this part of them.
WITH = 10
# Copies of one row may give this many times the rows of a task before they are dealt out.
ALIKE = 4


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    hot_rows: int | None = HOT_ROWS,
    sample: float = SAMPLE,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame | None:
    """Keys with about ``hot_rows`` rows or ``hot_bytes`` bytes, as a table: hash, rows, bytes; None if there are none.

    A 1 % sample of the key columns alone is counted first, partially
    aggregated before its shuffle. Only if some key has a ``WEIGHED``-th of
    ``hot_rows`` does a second pass weigh the sampled rows of such keys. One
    number of each pass reaches the driver; the hashes stay a table in the
    scratch folder, however many there are. It only chooses between two exact
    ways of computing the same rows, so neither a missed key nor a colliding
    hash can change a result. ``hot_rows=None`` skips all of it.
    """
    if hot_rows is None:
        return None
    least = max(1.0, hot_rows * sample / WEIGHED)
    counts = _sampled(df.select(_hash(keys).alias("_hot")), sample).groupBy("_hot").agg(F.count("*").alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) < least:
        return None
    often = written(counts.filter(F.col("_n") >= least).select("_hot"), "often")
    weights = _sampled(df, sample).select(_hash(keys).alias("_hot"), row_bytes(df).alias("_size"))
    sums = weights.join(often, "_hot", "left_semi").groupBy("_hot").agg(F.count("*").alias("n"), F.sum("_size").alias("size"))
    scaled = sums.select("_hot", *[(F.col(c) / F.lit(sample)).alias(c) for c in ("n", "size")])
    hot = written(scaled.filter((F.col("n") >= max(1.0 / sample, hot_rows)) | (F.col("size") >= hot_bytes)), "hot")
    return None if hot.isEmpty() else hot


def widest(hot: DataFrame) -> float:
    """Bytes of a row, on average, of the hot key where they are most."""
    return hot.agg(F.max(F.col("size") / F.col("n"))).first()[0]


def largest(hot: DataFrame) -> float:
    """Rows of the hot key that has most."""
    return hot.agg(F.max("n")).first()[0]


def parted(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys are not in ``hot``, and those whose keys are."""
    same, hashes = _hash(keys) == F.col("_hot"), hot.select("_hot")
    return df.join(hashes, same, "left_anti"), df.join(hashes, same, "left_semi")


def fan_out(a: DataFrame, key_a: str, b: DataFrame, key_b: str, sample: float, pairs: int | None) -> DataFrame | None:
    """Keys that give about ``pairs`` rows or more when A and B are joined, as a table: hash, pairs, rows in B (matches); None if none.

    Where there are, keys that give a ``WITH``-th of it come with them, as many of these together make a task's rows, too.
    Both sides' keys are counted in a sample, partially aggregated before the shuffle. There are at most as many such keys as the
    result has times ``pairs / WITH`` rows. Like the hot keys they choose between ways to the same rows.
    """
    if pairs is None:
        return None
    n_a = _sampled(a.select(_hash([key_a]).alias("_hot")), sample).groupBy("_hot").agg(F.count("*").alias("_n"))
    n_b = _sampled(b.select(_hash([key_b]).alias("_hot")), sample).groupBy("_hot").agg(F.count("*").alias("_m"))
    product = F.col("_n").cast("double") * F.col("_m") / F.lit(sample * sample if sample < 1 else 1.0)
    heavy = n_a.join(n_b, "_hot").select("_hot", product.alias("pairs"), (F.col("_m") / F.lit(sample)).alias("matches")).filter(F.col("pairs") >= pairs / WITH)
    heavy = written(heavy, "heavy")
    return heavy if (heavy.agg(F.max("pairs")).first()[0] or 0) >= pairs else None


def salted(df: DataFrame, key: str, heavy: DataFrame, side: int, salt: str, copied: bool) -> DataFrame:
    """Rows of the ``heavy`` keys with one of the key's salts each, one for ``side`` rows in A, or ``copied`` once for every salt.

    The salt is a hash of the row, so that a task that is run again gives the same ones.
    """
    salts = heavy.select(F.col("_hot"), F.ceil(F.col("pairs") / F.col("matches") / F.lit(side)).cast("bigint").alias("_salts"))
    one = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)) if copied else F.pmod(row_hash(df), F.col("_salts"))
    known = df.join(salts, _hash([key]) == F.col("_hot"))
    return known.select(*[col(c) for c in df.columns], one.alias(salt))


def dealt(df: DataFrame, key: str, heavy: DataFrame, sample: float, pairs: int, most: int) -> DataFrame:
    """Rows of the ``heavy`` keys, key by key, in tasks that make about ``pairs`` rows each; ``most`` tasks at most.

    The rows to be made, key after key, are a line that is cut into tasks; a row's place in its key's part is a hash of it, so that a
    task that is run again gives the same ones. Where many copies of one row are found in a sample, a round-robin deal goes before,
    which Spark makes the same again, too, and the row's place depends on its part of that.
    """
    total = heavy.agg(F.sum("pairs")).first()[0]
    each = max(float(pairs), total / most)
    tasks = int(total / each) + 1
    copies = _sampled(df, sample).groupBy(_hash([key]).alias("_hot"), row_hash(df).alias("_row")).agg(F.count("*").alias("_n"))
    alike = copies.filter("_n > 1").join(heavy, "_hot").agg(F.max(F.col("_n") * F.col("matches"))).first()[0] or 0
    deals = min(tasks, int(alike / sample / each / ALIKE) + 1)
    size, start, turn = (free_name(n, df.columns) for n in ("_size", "_start", "_turn"))
    before = Window.orderBy("_hot").rowsBetween(Window.unboundedPreceding, -1)
    line = heavy.select("_hot", F.col("pairs").alias(size), F.coalesce(F.sum("pairs").over(before), F.lit(0.0)).alias(start))
    turned = df.repartition(deals).withColumn(turn, row_hash(df, F.spark_partition_id())) if deals > 1 else df.withColumn(turn, row_hash(df))
    placed = turned.join(line, _hash([key]) == F.col("_hot"))
    place = col(start) + col(size) * (F.pmod(col(turn), F.lit(1 << 20)) / F.lit(1 << 20))
    task = F.least(F.floor(place / F.lit(each)), F.lit(tasks - 1)).cast("int")
    return placed.withColumn(turn, task).repartitionById(tasks, col(turn)).select(*[col(c) for c in df.columns])


def _sampled(df: DataFrame, sample: float) -> DataFrame:
    return df.sample(fraction=sample, seed=11) if sample < 1 else df


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[col(k) for k in keys])


def row_hash(df: DataFrame, *more: Column) -> Column:
    """A hash of the row, without the columns that Spark can't hash: maps, and what holds them."""
    plain = [f.name for f in df.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(*more, *[col(c) for c in plain], F.lit(0))


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: those of texts and, through JSON, of nested values; 8 for any other value."""
    sizes = [F.lit(8 * len(df.columns)).cast("bigint")]
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(col(field.name)).cast("bigint"))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.octet_length(F.to_json(F.struct(col(field.name)))).cast("bigint"))
    return sum((F.coalesce(s, F.lit(0)) for s in sizes[1:]), sizes[0])
