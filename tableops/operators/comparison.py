"""Compare two tables on keys, with numeric tolerance and per-column statistics.

Rows are paired by key and, where a key repeats, by occurrence number. Most
keys take the plain road: both tables are stacked, sent once by key, numbered
and folded into one record per pair. Keys that hold millions of rows, or
gigabytes, would make that one task's work, so they take a second road that spreads a single
key over many tasks and yields the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tableops.columns import (
    as_list,
    col,
    comparable_key_types,
    dtype,
    is_floating,
    is_numeric,
    is_text,
    missing_to_null,
    require,
    require_unique,
)
from tableops.functions import approx_equal, clean_text, exact_gap
from tableops.plans.hotkeys import HOT_BYTES, HOT_ROWS, SAMPLE, hot_keys, largest, parted, widest
from tableops.plans.scratch import written

# Occurrences of a hot key are matched in blocks of this many, or fewer where rows are long.
BLOCK = 1 << 16
# A hot key is cut into chunks of about a (CHUNKS)th of ``hot_rows`` different rows, or of ``hot_bytes`` where rows are
# long, by this many sampled rows a chunk. Keys with more than (MOST_CHUNKS) chunks of that size get
# larger ones, up to (CHUNK) rows: so many are sorted in no time, and more borders only cost time.
CHUNKS = 8
SAMPLED = 32
MOST_CHUNKS = 64
CHUNK = 1 << 16
# Chunks, or groups of chunks, that a row is compared with at a time.
FAN = 32


def align_keys(b: DataFrame, keys_a: Sequence[str], keys_b: Sequence[str]) -> DataFrame:
    """Rename B's keys to A's names, position by position."""
    if not keys_a or not keys_b:
        raise ValueError("give at least one key column for each table")
    if len(keys_a) != len(keys_b):
        raise ValueError("both tables need the same number of key columns")
    keys_b = require(b, keys_b, "key of B")
    require_unique(keys_a, "keys of A")
    require_unique(keys_b, "keys of B")
    renames = dict(zip(keys_b, keys_a))
    names = [renames.get(c, c) for c in b.columns]
    require_unique(names, "keys of B renamed to those of A")
    return b if names == b.columns else b.toDF(*names)


def compare(
    a: DataFrame,
    b: DataFrame,
    keys_a: str | Iterable[str],
    keys_b: str | Iterable[str] | None = None,
    order_by: str | Iterable[str] = (),
    ignore: str | Iterable[str] = (),
    abs_tol: float = 0.0001,
    rel_tol: float = 0.0,
    tidy_text: bool = True,
    hot_rows: int | None = HOT_ROWS,
    hot_sample: float = SAMPLE,
    hot_bytes: int = HOT_BYTES,
) -> CompareResult:
    """Match table A with table B; see :class:`CompareResult` for the outputs.

    ``order_by`` (columns of both tables, in A's naming) numbers the rows of a
    repeated key; the other columns break ties. ``ignore`` columns may order
    rows but are neither compared nor returned. Text is tidied in the outputs
    only, after matching.
    """
    keys_a = require(a, keys_a, "key of A")
    b = align_keys(b, keys_a, as_list(keys_b) if keys_b is not None else keys_a)
    keys = list(keys_a)
    key_names = {k.lower() for k in keys}
    ordering = [c for c in as_list(order_by) if c.lower() not in key_names]
    hidden = {c.lower() for c in as_list(ignore)}
    if hidden & key_names:
        raise ValueError("a key column cannot be ignored")
    for name in hidden:
        if name not in {c.lower() for c in [*a.columns, *b.columns]}:
            raise ValueError(f"unknown column to ignore {name!r}")

    in_b = {c.lower(): c for c in b.columns if c.lower() not in key_names | hidden}
    shared = [c for c in a.columns if c.lower() in in_b and _is_bulky(a, c) == _is_bulky(b, in_b[c.lower()])]
    layout_a = _Layout.of(a, key_names, ordering, shared)
    layout_b = _Layout.of(b, key_names, ordering, shared)
    targets = [comparable_key_types(dtype(a, k), dtype(b, require(b, k)[0])) for k in keys]
    tagged = _tag(a, keys, targets, layout_a, "a", layout_b).unionByName(_tag(b, keys, targets, layout_b, "b", layout_a))
    key_columns = [f"_k{i}" for i in range(len(keys))]
    hot = hot_keys(tagged, key_columns, hot_rows, hot_sample, hot_bytes)
    long_rows, few = (0, 0) if hot is None else (int(hot_bytes / widest(hot) // CHUNKS), int(largest(hot) // MOST_CHUNKS))
    chunk_rows = min(max((hot_rows or 0) // CHUNKS, min(CHUNK, few)), long_rows)
    order = F.struct(*layout_a.border("_a"), *layout_b.border("_b"))
    return CompareResult(
        matched=_match(tagged, key_columns, order, hot, max(1, chunk_rows), max(1, min(BLOCK, long_rows))),
        keys=keys,
        fields_a={f.name: f.dataType for f in a.schema if f.name.lower() not in hidden},
        fields_b={f.name: f.dataType for f in b.schema if f.name.lower() not in hidden},
        abs_tol=abs_tol,
        rel_tol=rel_tol,
        tidy_text=tidy_text,
    )


@dataclass(frozen=True)
class _Layout:
    """The non-key columns of a table, packed in the order that sorts its rows.

    Requested order columns come first. Ties are broken by the columns both
    tables have, then by the table's own: in each of the two groups by those of
    fixed width and a hash of the bulky ones. At last stand the bulky columns
    themselves, so that only identical rows tie.
    """

    df: DataFrame
    requested: list[str]
    shared: list[str]
    own: list[str]

    @classmethod
    def of(cls, df: DataFrame, key_names: set[str], ordering: Sequence[str], shared: Sequence[str]) -> _Layout:
        requested = require(df, ordering, "order column")
        common = [c for c in require(df, shared) if c not in requested]
        own = [c for c in df.columns if c.lower() not in key_names and c not in requested and c not in common]
        return cls(df, requested, common, own)

    def _narrow(self, names: Sequence[str]) -> list[str]:
        return [c for c in names if not _is_bulky(self.df, c)]

    def _bulky(self, names: Sequence[str]) -> list[str]:
        return [c for c in names if _is_bulky(self.df, c)]

    def _hash(self, names: Sequence[str]) -> Column:
        bulky = [col(c) for c in self._bulky(names)]
        return F.xxhash64(*bulky) if bulky else F.lit(0).cast("bigint")

    def fields(self) -> list[Column]:
        return [
            # The marker keeps the record non-empty for tables made of keys only.
            F.lit(True).alias("_here"),
            *[col(c) for c in [*self.requested, *self._narrow(self.shared)]],
            self._hash(self.shared).alias("_hash"),
            *[col(c) for c in self._narrow(self.own)],
            self._hash(self.own).alias("_own_hash"),
            *[col(c) for c in self._bulky([*self.shared, *self.own])],
        ]

    def row_type(self) -> T.StructType:
        return self.df.select(F.struct(*self.fields()).alias("row")).schema["row"].dataType

    def border(self, parent: str) -> list[Column]:
        """Columns ordering rows as the packed row does, up to its hashes: what only follows ties in them is left out."""
        names = ["_here", *self.requested, *self._narrow(self.shared), "_hash", *self._narrow(self.own), "_own_hash"]
        return [col(c, parent).alias(f"{parent}{i}") for i, c in enumerate(names)]


def _is_bulky(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), (T.StringType, T.BinaryType, T.ArrayType, T.StructType))


def _tag(
    df: DataFrame,
    keys: Sequence[str],
    targets: Sequence[str | None],
    layout: _Layout,
    side: str,
    other: _Layout,
) -> DataFrame:
    """Keys under private names, the side, and the row packed in ``_a`` or ``_b``."""
    key_columns = []
    for i, (key, target) in enumerate(zip(keys, targets)):
        value = missing_to_null(df, require(df, key)[0])
        key_columns.append((value.cast(target) if target else value).alias(f"_k{i}"))
    packed = F.struct(*layout.fields()).alias(f"_{side}")
    empty = F.lit(None).cast(other.row_type()).alias("_b" if side == "a" else "_a")
    return df.select(*key_columns, F.lit(side).alias("_side"), packed, empty)


def _match(tagged: DataFrame, keys: list[str], order: Column, hot: DataFrame | None, chunk_rows: int, block: int) -> DataFrame:
    if hot is None:
        return _match_by_key(tagged, keys)
    usual, spread = parted(tagged, keys, hot)
    return _match_by_key(usual, keys).unionByName(_match_spread(spread, keys, order, chunk_rows, block))


def _match_by_key(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """One shuffle: numbering and folding both reuse the partitioning by key."""
    occurrence = Window.partitionBy(*keys, "_side").orderBy("_a", "_b")
    numbered = tagged.repartition(*keys).withColumn("_occ", F.row_number().over(occurrence).cast("bigint"))
    return _fold(numbered, [*keys, "_occ"])


def _fold(numbered: DataFrame, by: list[str]) -> DataFrame:
    """One record per (key, occurrence); a side without that row is NULL."""
    folded = numbered.groupBy(*by).agg(
        F.first("_a", ignorenulls=True).alias("_a"), F.first("_b", ignorenulls=True).alias("_b")
    )
    return folded.select([c for c in folded.columns if c != "_block"])


def _borders(copies: DataFrame, keys: list[str], order: Column, chunk_rows: int) -> DataFrame:
    """Chunks of each key and side in row order, as a table: number, lowest row and the one that is beyond.

    The rows are sampled by a hash of their whole order, so the borders are the
    same on every run, and every ``SAMPLED``-th row of the sample is one. A key's
    first chunk has no lowest row and its last none beyond.
    """
    by = [*keys, "_side"]
    step = min(SAMPLED, chunk_rows)
    sample = copies.select(*by, order.alias("_low")).filter(F.pmod(F.xxhash64("_low"), F.lit(chunk_rows // step)) == 0)
    in_order = Window.partitionBy(*by).orderBy("_low")
    points = sample.withColumn("_i", F.row_number().over(in_order)).filter(F.col("_i") % step == 0).drop("_i")
    points = written(points, "points")
    nothing = F.lit(None).cast(points.schema["_low"].dataType)
    first = points.groupBy(*by).agg(F.min("_low").alias("_beyond")).select(*by, nothing.alias("_low"), "_beyond")
    others = points.withColumn("_beyond", F.lead("_low").over(in_order))
    numbered = first.unionByName(others).withColumn("_number", (F.row_number().over(in_order) - 1).cast("bigint"))
    return written(numbered, "borders")


def _chunked(copies: DataFrame, keys: list[str], order: Column, chunk_rows: int) -> DataFrame:
    """The rows with the number of the chunk they fall into, 0 in keys too small to be cut.

    They are looked up in groups of groups first, ``FAN`` in a group, and then within
    their group, so a row meets ``FAN`` ranges for each digit of the number of chunks.
    """
    borders = _borders(copies, keys, order, chunk_rows)
    by = [*keys, "_side"]
    last = borders.agg(F.max("_number")).first()[0] or 0
    widths = [1]
    while widths[-1] * FAN <= last:
        widths.append(widths[-1] * FAN)
    rows = copies.withColumns({"_order": order, "_chunk": F.lit(0).cast("bigint")})
    for width in reversed(widths):
        ranges = borders.groupBy(*by, F.expr(f"_number div {width}").alias("_found")).agg(
            F.min_by("_low", "_number").alias("_low"), F.max_by("_beyond", "_number").alias("_beyond")
        )
        ranges = ranges.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(by)], F.expr(f"_found div {FAN}").alias("_up"), "_found", "_low", "_beyond")
        same = [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(by)]
        same.append(F.col("_chunk") == (F.col("_up") if width < widths[-1] else F.lit(0)))
        same.append(F.col("_low").isNull() | (F.col("_order") >= F.col("_low")))
        same.append(F.col("_beyond").isNull() | (F.col("_order") < F.col("_beyond")))
        found = rows.join(ranges, reduce(lambda x, y: x & y, same), "left")
        rows = found.select(*copies.columns, "_order", F.coalesce("_found", F.lit(0)).alias("_chunk"))
    return rows.drop("_order")


def _match_spread(tagged: DataFrame, keys: list[str], order: Column, chunk_rows: int, block: int) -> DataFrame:
    """The same pairs for keys too big for one task.

    Identical rows are interchangeable, so they travel as one row with a
    count. Borders taken from a sample cut each key into chunks in row order; the
    running total over the chunk sizes says at which occurrence a chunk
    starts, and a window inside the chunk does the rest. Both sides are finally
    cut at the same block borders, and every block is matched on its own.
    """
    copies = tagged.groupBy(*keys, "_side", "_a", "_b").agg(F.count("*").alias("_n"))
    chunked = written(_chunked(written(copies, "copies"), keys, order, chunk_rows), "compare")

    # At most one row per chunk border and key; Spark broadcasts them if they are small.
    sizes = chunked.groupBy(*keys, "_side", "_chunk").agg(F.sum("_n").alias("_rows"))
    earlier = Window.partitionBy(*keys, "_side").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)],
        F.col("_side").alias("_oside"),
        F.col("_chunk").alias("_ochunk"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)]
    same += [F.col("_side") == F.col("_oside"), F.col("_chunk") == F.col("_ochunk")]
    inside = (
        Window.partitionBy(*keys, "_side", "_chunk")
        .orderBy("_a", "_b")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counted = chunked.withColumn("_upto", F.sum("_n").over(inside))
    placed = counted.join(offsets, reduce(lambda x, y: x & y, same)).select(
        *keys,
        "_a",
        "_b",
        (F.col("_base") + F.col("_upto") - F.col("_n")).alias("_from"),
        (F.col("_base") + F.col("_upto") - 1).alias("_to"),
    )

    size = F.lit(block)
    pieces = placed.withColumn("_block", F.explode(F.sequence(F.expr(f"_from div {block}"), F.expr(f"_to div {block}"))))
    low = F.greatest(F.col("_from"), F.col("_block") * size)
    high = F.least(F.col("_to"), (F.col("_block") + 1) * size - 1)
    numbered = pieces.repartition(*keys, "_block").withColumn("_occ", F.explode(F.sequence(low + 1, high + 1)))
    return _fold(numbered.select(*keys, "_block", "_occ", "_a", "_b"), [*keys, "_block", "_occ"])


def _distance(x: Column, y: Column, floating: bool) -> Column:
    """Absolute difference; NULL where there is none to speak of."""
    gap = F.abs(x.cast("double") - y.cast("double")) if floating else exact_gap(x, y).cast("double")
    return F.when(x.eqNullSafe(y), F.when(x.isNotNull(), F.lit(0.0))).otherwise(F.when(~F.isnan(gap), gap))


@dataclass(frozen=True)
class CompareResult:
    """Lazy outputs of one comparison; they all read the same ``matched`` rows.

    Call :meth:`persist` before using several of them.
    """

    matched: DataFrame
    keys: list[str]
    fields_a: dict[str, T.DataType]
    fields_b: dict[str, T.DataType]
    abs_tol: float
    rel_tol: float
    tidy_text: bool

    def __post_init__(self) -> None:
        compared = [f"{x}{end}" for x, _ in self.shared for end in ("_a", "_b", "_match")]
        require_unique([*self.keys, *compared, *self.columns_only_a, *self.columns_only_b, "all_match"], "compare")

    def persist(self) -> CompareResult:
        self.matched.persist()
        return self

    def unpersist(self) -> None:
        self.matched.unpersist()

    # -- columns -----------------------------------------------------------

    @property
    def shared(self) -> list[tuple[str, str]]:
        """Compared columns, as (name in A, name in B)."""
        in_b = {c.lower(): c for c in self.fields_b}
        skip = {k.lower() for k in self.keys}
        return [(c, in_b[c.lower()]) for c in self.fields_a if c.lower() in in_b and c.lower() not in skip]

    @property
    def columns_only_a(self) -> list[str]:
        in_b = {c.lower() for c in self.fields_b}
        return [c for c in self.fields_a if c.lower() not in in_b]

    @property
    def columns_only_b(self) -> list[str]:
        in_a = {c.lower() for c in self.fields_a}
        return [c for c in self.fields_b if c.lower() not in in_a]

    def _key(self, i: int) -> Column:
        return F.col(f"_k{i}")

    def _shown(self, value: Column, data_type: T.DataType) -> Column:
        return clean_text(value) if self.tidy_text and is_text(data_type) else value

    def _equal(self, in_a: str, in_b: str) -> Column:
        return approx_equal(
            col(in_a, "_a"), col(in_b, "_b"), self.fields_a[in_a], self.fields_b[in_b], self.abs_tol, self.rel_tol
        )

    def _all_equal(self) -> Column:
        return reduce(lambda x, y: x & y, [self._equal(x, y) for x, y in self.shared], F.lit(True))

    def _key_columns(self) -> list[Column]:
        return [self._shown(self._key(i), self.fields_a[k]).alias(k) for i, k in enumerate(self.keys)]

    def _with_flags(self, pairs: DataFrame) -> DataFrame:
        columns = self._key_columns()
        for x, y in self.shared:
            columns.append(self._shown(col(x, "_a"), self.fields_a[x]).alias(f"{x}_a"))
            columns.append(self._shown(col(y, "_b"), self.fields_b[y]).alias(f"{x}_b"))
            columns.append(self._equal(x, y).alias(f"{x}_match"))
        columns += [self._shown(col(c, "_a"), self.fields_a[c]).alias(c) for c in self.columns_only_a]
        columns += [self._shown(col(c, "_b"), self.fields_b[c]).alias(c) for c in self.columns_only_b]
        flags = [col(f"{x}_match") for x, _ in self.shared]
        return pairs.select(*columns).withColumn("all_match", reduce(lambda x, y: x & y, flags, F.lit(True)))

    def _one_side(self, fields: dict[str, T.DataType], side: str) -> list[Column]:
        place = {k.lower(): i for i, k in enumerate(self.keys)}
        return [
            self._shown(self._key(place[c.lower()]) if c.lower() in place else col(c, side), t).alias(c)
            for c, t in fields.items()
        ]

    # -- rows --------------------------------------------------------------

    @cached_property
    def only_a(self) -> DataFrame:
        """Rows of A without a partner in B, with A's columns."""
        return self.matched.filter(F.col("_b").isNull()).select(*self._one_side(self.fields_a, "_a"))

    @cached_property
    def only_b(self) -> DataFrame:
        """Rows of B without a partner in A, with B's columns."""
        return self.matched.filter(F.col("_a").isNull()).select(*self._one_side(self.fields_b, "_b"))

    @cached_property
    def both(self) -> DataFrame:
        """Paired rows: both values and a match flag per column, and ``all_match``."""
        return self._with_flags(self._paired())

    def _paired(self) -> DataFrame:
        return self.matched.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())

    def samples(self, n: int = 10) -> DataFrame:
        """The first ``n`` pairs that differ, by key and occurrence."""
        order = [self._key(i) for i in range(len(self.keys))] + [F.col("_occ")]
        first = self._paired().filter(~self._all_equal()).orderBy(*order).limit(n)
        return self._with_flags(first)

    # -- statistics --------------------------------------------------------

    def summary(self) -> DataFrame:
        """One row of counts and the verdict ``matches``."""
        in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
        equal = self._all_equal()
        counts = self.matched.agg(
            F.count_if(in_a).alias("rows_a"),
            F.count_if(in_b).alias("rows_b"),
            F.count_if(in_a & ~in_b).alias("only_a"),
            F.count_if(in_b & ~in_a).alias("only_b"),
            F.count_if(in_a & in_b).alias("both"),
            F.count_if(in_a & in_b & equal).alias("both_equal"),
            F.count_if(in_a & in_b & ~equal).alias("both_different"),
        )
        return counts.select(
            "*",
            F.lit(len(self.shared)).alias("columns_shared"),
            F.lit(len(self.columns_only_a)).alias("columns_only_a"),
            F.lit(len(self.columns_only_b)).alias("columns_only_b"),
            (
                (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("both_different") == 0)
            ).alias("matches"),
        )

    def matches(self) -> bool:
        """Do all rows pair up and agree in every shared column?"""
        return self.summary().first()["matches"]

    def column_stats(self) -> DataFrame:
        """One row per shared column, from a single aggregate over the pairs."""
        if not self.shared:
            raise ValueError("the tables share no column besides the keys")
        aggregates, rows = [], []
        for i, (x, y) in enumerate(self.shared):
            va, vb, equal = col(x, "_a"), col(y, "_b"), self._equal(x, y)
            numbers = is_numeric(self.fields_a[x]) and is_numeric(self.fields_b[y])
            floating = any(is_floating(t) or isinstance(t, T.BooleanType) for t in (self.fields_a[x], self.fields_b[y]))
            gap = _distance(va, vb, floating) if numbers else F.lit(None).cast("double")
            aggregates += [
                F.count_if(equal).alias(f"equal{i}"),
                F.count_if(~equal).alias(f"different{i}"),
                F.count_if(va.isNull() != vb.isNull()).alias(f"one_null{i}"),
                F.max(gap).alias(f"gap{i}"),
            ]
            rows.append(
                F.struct(
                    F.lit(x).alias("column"),
                    F.col(f"equal{i}").alias("n_equal"),
                    F.col(f"different{i}").alias("n_different"),
                    F.col(f"one_null{i}").alias("n_one_missing"),
                    F.col(f"gap{i}").alias("max_difference"),
                )
            )
        return self._paired().agg(*aggregates).select(F.inline(F.array(*rows)))

    def report(self, n: int = 10) -> str:
        """Readable text: counts, per-column statistics, first rows that differ or stand alone."""
        parts = [("Summary", self.summary().collect())]
        if self.shared:
            parts.append(("Columns", self.column_stats().collect()))
        parts.append((f"First {n} pairs that differ", self.samples(n).collect()))
        for side, alone in (("A", self.only_a), ("B", self.only_b)):
            first = alone.orderBy(*[col(k) for k in self.keys]).limit(n)
            parts.append((f"First {n} rows only in {side}", first.collect()))
        lines = []
        for title, rows in parts:
            lines += [title, "-" * len(title)]
            lines += [", ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in rows] or ["none"]
            lines.append("")
        return "\n".join(lines)
