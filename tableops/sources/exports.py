"""Reading many exports whose headers differ in order or content."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tableops.columns import free_name
from tableops.sources.csv import SEPARATORS, detect_sep, needs_multi_line, normalize_header, read_cells
from tableops.sources.ingest import null_tokens
from tableops.sources.remote import file_opener

SOURCE = "source_file"


def header_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``header`` (first record) of every file; only file heads are read."""

    open_file = file_opener()

    # Nested so that it travels by value, like the opener.
    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for uri in batch["path"]:
                head, end = b"", -1
                with open_file(uri) as stream:
                    while end < 0 and (more := stream.read(1 << 16)):
                        head += more
                        end = head.find(b"\n")
                        # A line break between quotes is part of a name.
                        while end >= 0 and head.count(b'"', 0, end) % 2:
                            end = head.find(b"\n", end + 1)
                line = head[:end] if end >= 0 else head
                lines.append(line.decode("utf-8", "replace").rstrip("\r").lstrip("\ufeff"))
            yield pd.DataFrame({"path": batch["path"], "header": lines})

    # Selecting the path alone keeps the file contents out of the scan.
    paths = spark.read.format("binaryFile").load(path).select("path")
    return paths.mapInPandas(heads, "path string, header string")


def _header_sep(header: str) -> str | None:
    """The separator of a header line, unless several could be it."""
    bare = re.sub('"[^"]*"', "", header)
    found = [s for s in SEPARATORS if s in bare]
    return found[0] if len(found) == 1 else None


def read_exports(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool | str = "auto") -> DataFrame:
    """All exports under ``path`` as one table of text cells plus ``source_file``.

    A plain directory read would assign cells by position from one file's
    header. Files are grouped by header line instead, each layout is read
    with its own names, and the layouts are combined by name; a column that a
    layout lacks is NULL there. ``multi_line`` is as for ``read_csv``.
    """
    if not path:
        raise ValueError("no path given")
    # File names, like those the driver lists for any read; layouts are few.
    layouts: dict[str, list[str]] = {}
    for row in header_lines(spark, path).collect():
        layouts.setdefault(row.header, []).append(row.path)
    if not layouts:
        raise ValueError(f"no files under {path!r}")
    spans = needs_multi_line(spark, path) if multi_line == "auto" else bool(multi_line)
    tables, found = [], {}
    for header in sorted(layouts):
        files = sorted(layouts[header])
        separator = sep or _header_sep(header) or detect_sep(spark, files[0])
        found[header] = separator, files, normalize_header(next(csv.reader([header], delimiter=separator), [""]), strip=False)
    source = free_name(SOURCE, *[names for _, _, names in found.values()])
    for separator, files, names in found.values():
        cells = read_cells(spark, files, separator, names, spans, source)
        tables.append(null_tokens(cells, names))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)
