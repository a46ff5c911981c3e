"""Reading many .xlsx workbooks: the first sheet of each, header in its first row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tableops.sources.exports import SOURCE
from tableops.sources.ingest import null_tokens
from tableops.sources.remote import file_opener

ROW = "row_number"


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """``source_file``, ``row_number`` and ``cells`` (header to text) of every data row.

    A workbook is opened by one task, which streams its rows; a sheet ends at
    about a million rows, so none is too big for that.
    """

    open_file = file_opener()

    # Nested so that it travels by value, like the opener.
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import zipfile
        from datetime import datetime, timedelta
        from xml.etree.ElementTree import iterparse

        # The built-in number formats that show a date or time.
        date_formats = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

        def elements(book, member, tag):
            with book.open(member) as stream:
                for _, element in iterparse(stream):
                    if element.tag.rpartition("}")[2] == tag:
                        yield element
                        element.clear()

        def text_of(element):
            # Phonetic hints (rPh) stand beside the text and do not belong to it.
            own = [e for e in element if e.tag.rpartition("}")[2] != "rPh"]
            return "".join(t.text or "" for e in own for t in e.iter() if t.tag.rpartition("}")[2] == "t")

        def date_styles(book):
            if "xl/styles.xml" not in book.namelist():
                return set()
            formats = set(date_formats)
            for e in elements(book, "xl/styles.xml", "numFmt"):
                shown = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", ""))
                if re.search("[ymdhs]", shown, re.IGNORECASE):
                    formats.add(int(e.get("numFmtId")))
            for block in elements(book, "xl/styles.xml", "cellXfs"):
                return {i for i, xf in enumerate(block) if int(xf.get("numFmtId", 0)) in formats}
            return set()

        def first_sheet(book):
            sheet = next(elements(book, "xl/workbook.xml", "sheet"))
            wanted = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            for link in elements(book, "xl/_rels/workbook.xml.rels", "Relationship"):
                if link.get("Id") == wanted:
                    target = link.get("Target")
                    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            raise ValueError("workbook without a first sheet")

        def place(reference):
            number = 0
            for letter in re.match("[A-Z]+", reference).group():
                number = number * 26 + ord(letter) - 64
            return number - 1

        def value_of(cell, shared, dates, epoch):
            kind = cell.get("t", "n")
            if kind == "inlineStr":
                return "".join(text_of(e) for e in cell if e.tag.rpartition("}")[2] == "is")
            raw = next((e.text for e in cell if e.tag.rpartition("}")[2] == "v"), None)
            if raw is None or kind == "e":
                return None
            if kind == "s":
                return shared[int(raw)]
            if kind == "b":
                return "True" if raw == "1" else "False"
            if kind == "n" and int(cell.get("s", 0)) in dates:
                return str(epoch + timedelta(milliseconds=round(float(raw) * 86_400_000)))
            return raw

        def sheet_rows(book):
            names = book.namelist()
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = [text_of(e) for e in elements(book, "xl/sharedStrings.xml", "si")]
            dates = date_styles(book)
            properties = next(elements(book, "xl/workbook.xml", "workbookPr"), None)
            from_1904 = properties is not None and properties.get("date1904") in ("1", "true")
            epoch = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
            last = 0
            for row in elements(book, first_sheet(book), "row"):
                number = int(row.get("r", last + 1))
                # Rows that were left empty are not stored but count as rows.
                for missing in range(last + 1, number) if last else ():
                    yield missing, {}
                cells, at = {}, -1
                for cell in row:
                    at = place(cell.get("r")) if cell.get("r") else at + 1
                    cells[at] = value_of(cell, shared, dates, epoch)
                last = number
                yield number, cells

        def header_names(cells):
            names = {}
            for i in range(max(cells, default=-1) + 1):
                name = (cells.get(i) or "").strip() or f"Unnamed: {i}"
                unique, n = name, 0
                while unique.lower() in names:
                    n += 1
                    unique = f"{name}.{n}"
                names[unique.lower()] = (i, unique)
            return dict(names.values())

        for batch in batches:
            for uri in batch["path"]:
                with open_file(uri, seekable=True) as file, zipfile.ZipFile(file) as book:
                    header, out = None, []
                    for number, cells in sheet_rows(book):
                        if header is None:
                            header = header_names(cells)
                            continue
                        # Cells right of the header get the name of their place.
                        beyond = {f"Unnamed: {i}": v for i, v in cells.items() if i not in header and v is not None}
                        out.append((uri, number, {**beyond, **{name: cells.get(i) for i, name in header.items()}}))
                        if len(out) == 5000:
                            yield pd.DataFrame(out, columns=["source_file", "row_number", "cells"])
                            out = []
                    if out:
                        yield pd.DataFrame(out, columns=["source_file", "row_number", "cells"])

    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path")
    return paths.mapInPandas(rows, f"{SOURCE} string, {ROW} bigint, cells map<string,string>")


def read_workbooks(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """First sheets of all workbooks under ``path`` as one table of text cells.

    Columns are matched by header; a column a workbook lacks is NULL there.
    Without ``names`` the headers are looked up first, in one more pass. Give
    the result to ``promote_numeric`` for typed columns.
    """
    if not path:
        raise ValueError("no path given")
    rows = workbook_rows(spark, path)
    if names is None:
        found = rows.select(F.explode(F.map_keys("cells")).alias("name")).distinct().orderBy("name").collect()
        names = [row.name for row in found]
    if not names:
        raise ValueError(f"no columns in the workbooks under {path!r}")
    cells = rows.select(SOURCE, ROW, *[F.element_at("cells", F.lit(n)).alias(n) for n in names])
    return null_tokens(cells, list(names))
