"""Reading and writing delimited text."""

from __future__ import annotations

import csv
import re
import warnings
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F, types as T

from tableops.columns import col, free_name
from tableops.functions import as_text
from tableops.sources.ingest import null_tokens, promote_numeric
from tableops.sources.records import ends_inside, records, split_states

#: Columns that give the place of a row: its file, the split of the file, a number that rises within the split.
ORDER = ("_file", "_split", "_row")
SEPARATORS = (",", ";", "\t", "|")
BOM = "\ufeff"

# A quote inside a quoted cell is doubled, blanks belong to the cell.
READ_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
WRITE_OPTIONS = {
    **READ_OPTIONS,
    "emptyValue": "",
}


def detect_sep(spark: SparkSession, path: str | Sequence[str], lines: int = 200) -> str:
    """Separator that cuts the first records into the same number of cells.

    Quoted cells are left out of the count, line breaks in them included; a quote within a cell
    is no quote. A file without any separator reads as one column, with a comma.
    """
    head = "\n".join(row.value for row in spark.read.text(path).limit(lines).collect())
    best, best_score = SEPARATORS[0], (0.0, 0)
    for separator in SEPARATORS:
        # A quoted cell stands between separators or line ends; the last one may be cut off by the limit.
        bare = re.sub(rf'(?:(?<=^)|(?<={re.escape(separator)}))"(?:[^"]|"")*(?:"|\Z)', "", head, flags=re.M)
        counts = Counter(line.count(separator) for line in bare.split("\n") if line.strip())
        if counts:
            usual = max(counts, key=lambda n: (counts[n], n))
            score = (counts[usual] / counts.total(), usual)
            if usual and score > best_score:
                best, best_score = separator, score
    return best


def survey(spark: SparkSession, path: str | Sequence[str]) -> tuple[list[str], bool]:
    """The distinct first lines of all files, and whether any line has an odd number of quotes.

    Such a line can begin a cell that spans lines. One pass; a row per file is summed up by first line
    before anything reaches the driver.
    """
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = lines.select("value", (quotes % 2 == 1).alias("odd"), place.alias("place"), F.col("_metadata.file_path").alias("file"))
    files = lines.groupBy("file").agg(F.min_by("value", "place").alias("first"), F.bool_or("odd").alias("odd"))
    firsts = files.groupBy(F.rtrim(F.ltrim("first", F.lit(BOM)), F.lit("\r")).alias("first")).agg(F.bool_or("odd").alias("odd"))
    found = firsts.select("first", F.expr("bool_or(odd) OVER ()").alias("odd")).orderBy("first").limit(1000).collect()
    return [row.first for row in found], any(row.odd for row in found)


def needs_multi_line(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Does any line hold an odd number of quotes, so that a cell may span lines?"""
    return survey(spark, path)[1]


def normalize_header(cells: Sequence[str | None], strip: bool = True) -> list[str]:
    """Column names from header cells: blanks get a place name, repeats a number."""
    names: list[str] = []
    taken: set[str] = set()
    repeats: dict[str, int] = {}
    for i, cell in enumerate(cells):
        name = (cell or "").lstrip(BOM)
        name = name.strip() if strip else name
        name = name if name else f"Unnamed: {i}"
        candidate, n = name, repeats.get(name.lower(), 0)
        while candidate.lower() in taken:
            n += 1
            candidate = f"{name}.{n}"
        repeats[name.lower()] = n
        taken.add(candidate.lower())
        names.append(candidate)
    return names


def read_header(spark: SparkSession, path: str | Sequence[str], sep: str) -> list[str | None]:
    """Cells of the first line, as they stand in the file."""
    first = spark.read.options(**READ_OPTIONS).option("sep", sep).csv(path).first()
    if first is None:
        raise ValueError(f"no data in {path!r}")
    return list(first)


def read_headers(spark: SparkSession, path: str | Sequence[str], sep: str, states: DataFrame) -> list[str]:
    """Up to three distinct first records of the files, whose cells may span lines."""
    for whole in (False, True):
        firsts = records(spark, path, sep, states, first_split=not whole).where((F.col("start") == 0) & (F.col("n") == 0))
        cut_off = F.bool_or(ends_inside(F.col("record"), sep, False)).over(Window.partitionBy())
        found = firsts.select("record").distinct().select("record", cut_off.alias("cut")).orderBy("record").limit(3).collect()
        if not any(r["cut"] for r in found):  # else a header goes on beyond the first split
            break
    return [r["record"] for r in found]


def read_cells(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str,
    names: Sequence[str],
    spans: bool = False,
    source: str | None = None,
    ordered: bool = False,
    states: DataFrame | None = None,
) -> DataFrame:
    """All cells as text under the given names, headers skipped, nothing inferred.

    ``spans`` says that cells hold line breaks: records are then put together from the splits of a file (see
    ``records``), in as many tasks as without, and ``states`` tells how the splits begin; a quoted cell that does
    not close is refused, with the name of its file. ``source`` names a column for
    the file a row comes from. A row with a cell to the right of the header ends the query with an error that
    names the file; rows that are too short are filled up with missing cells.
    """
    beyond = free_name("_beyond_header", names)
    if spans:
        found = records(spark, path, sep, states).where((F.col("start") > 0) | (F.col("n") > 0))
        ddl = ", ".join(f"c{i} string" for i in range(len(names) + 1))
        record = F.from_csv("record", ddl, {**READ_OPTIONS, "sep": sep, "multiLine": "true"})
        place = free_name("_place", [*names, beyond])
        columns = [F.col(f"cells.c{i}").alias(n) for i, n in enumerate([*names, beyond])]
        cells = found.select(record.alias("cells"), F.struct("file", "start", "n").alias("at")).select(*columns, F.col("at").alias(place))
        file, split, row = (F.col(place)[k] for k in ("file", "start", "n"))
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, beyond]])
        reader = spark.read.schema(schema).options(**READ_OPTIONS)
        cells = reader.options(sep=sep, header=True, enforceSchema=True).csv(path)
        file, split, row = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    start = F.concat_ws(sep, *[F.left(F.coalesce(col(n), F.lit("")), F.lit(40)) for n in names[:3]])
    told = F.concat(F.lit("a row has more cells than the header: "), file, F.lit(", row starting "), start)
    fits = F.when(col(beyond).isNotNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True))
    place = [file.alias(ORDER[0]), split.alias(ORDER[1]), row.alias(ORDER[2])]
    kept = [col(n) for n in names] + ([file.alias(source)] if source else []) + (place if ordered else [])
    return cells.filter(fits).select(*kept)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str | None = None,
    multi_line: bool | str = "auto",
    promote: bool = True,
    decimal_comma: bool = True,
    ordered: bool = False,
) -> DataFrame:
    """Read files of one layout: header, missing-value words, numeric columns.

    Line breaks within quoted cells stay as they are. ``sep=None`` looks at the first lines. ``multi_line="auto"`` looks for cells
    that span lines. Files whose headers differ are refused (see :func:`read_exports`), and so are rows
    with more cells than the header. ``promote`` turns a column into numbers (or
    booleans) when every cell that is not missing can be read as such. ``ordered`` adds ``_file``,
    ``_split`` and ``_row``, which together order the rows as the files do.
    """
    if not path:
        raise ValueError("no path given")
    paths = path if isinstance(path, str) else list(path)
    if sep is None:
        sep = detect_sep(spark, paths)
    firsts, odd = survey(spark, paths)
    spans = odd if multi_line == "auto" else bool(multi_line)
    states = split_states(spark, paths, sep) if spans else None
    if spans:  # a first line may be the beginning of a header only
        firsts = read_headers(spark, paths, sep, states)
        if not firsts:
            raise ValueError(f"no data in {path!r}")
    if len(firsts) > 1:
        raise ValueError(f"files under {path!r} have different headers; read them with read_exports: {firsts[:3]}")
    names = normalize_header(next(csv.reader([firsts[0]], delimiter=sep)) if spans else read_header(spark, paths, sep))
    if len(names) <= 1:
        warnings.warn(f"{path!r} was read as a single column; check the separator", stacklevel=2)
    if taken := set(ORDER) & {n.lower() for n in names} if ordered else None:
        raise ValueError(f"the files have columns called {sorted(taken)}")
    cells = read_cells(spark, paths, sep, names, spans, ordered=ordered, states=states)
    cells = null_tokens(cells, names)
    return promote_numeric(cells, names, decimal_comma=decimal_comma) if promote else cells


def printable(df: DataFrame, bom: bool) -> DataFrame:
    """Cells as they shall stand in a file, and the mark on the first name.

    Moments read ``2024-01-31 13:05:00``, flags True or False, numbers without an exponent. The header is
    the first thing in each part file, so the byte order mark is, too; only where
    the first name has to be quoted is the mark left out, since it would land within the quotes.
    """
    bom = bom and not any(c in df.columns[0] for c in '",;|\t\r\n') if df.columns else False
    moments = (T.TimestampType, T.TimestampNTZType)
    cells = []
    for i, field in enumerate(df.schema):
        shown = isinstance(field.dataType, (*moments, T.BooleanType, T.DoubleType, T.FloatType))
        cell = as_text(col(field.name), field.dataType) if shown else col(field.name)
        cells.append(cell.alias(BOM + field.name if bom and i == 0 else field.name))
    return df.select(*cells)


def write_csv(df: DataFrame, path: str, bom: bool = True, sep: str = ",", mode: str = "errorifexists") -> bool:
    """Write with a header in every file; returns False, writing nothing, for no rows.

    Where the folder must be new, rows are counted as they are written, and a folder without any is
    removed. Other modes may find files that have to stay, so they look for a first row beforehand.
    """
    fresh = mode.lower() in ("error", "errorifexists", "default")
    if not fresh and df.isEmpty():
        return False
    seen = Observation()
    counted = printable(df, bom).observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.options(**WRITE_OPTIONS).options(header=True, sep=sep).mode(mode).csv(path)
    if fresh and not seen.get["rows"]:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return False
    return True
