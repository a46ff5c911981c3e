import zipfile

import pytest
from pyspark.sql import functions as F

from tableops import (
    dedupe,
    detect_sep,
    fill_missing,
    filter_eq,
    normalize_header,
    null_tokens,
    numeric_cells,
    preview,
    preview_files,
    promote_numeric,
    read_csv,
    read_exports,
    read_file,
    read_parquet_ordered,
    read_parts,
    read_workbooks,
    split_write,
    summarize,
    unify,
    write_csv,
)
from tableops.sources.csv import needs_multi_line
from tests.conftest import rows


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def test_upload_with_semicolons(spark, tmp_path):
    path = put(tmp_path / "u.csv", "id;price ;name;flag\n1;1,5;Silva, J;True\n2;;;\n3;2,25;B;False\n", "utf-8-sig")
    df = read_csv(spark, path)
    assert df.dtypes == [("id", "bigint"), ("price", "double"), ("name", "string"), ("flag", "boolean")]
    assert rows(df) == [(1, 1.5, "Silva, J", True), (2, None, None, None), (3, 2.25, "B", False)]


def test_one_column_file(spark, tmp_path):
    path = put(tmp_path / "one.csv", "a\n1\n2\n")
    with pytest.warns(UserWarning, match="single column"):
        df = read_csv(spark, path)
    assert (df.dtypes, rows(df)) == ([("a", "bigint")], [(1,), (2,)])


def test_header_repair(spark, tmp_path):
    assert normalize_header(["a", "a", None, " c ", "a.1", "A"]) == ["a", "a.1", "Unnamed: 2", "c", "a.1.1", "A.2"]
    assert normalize_header(["﻿id", " x "], strip=False) == ["id", " x "]
    path = put(tmp_path / "h.csv", "a,a,,c\n1,2,3,4\n")
    df = read_csv(spark, path)
    assert (df.columns, rows(df)) == (["a", "a.1", "Unnamed: 2", "c"], [(1, 2, 3, 4)])


def test_missing_words(spark, tmp_path):
    path = put(tmp_path / "m.csv", 'a,b,c\nNA,x," NA"\n,None,#N/A\n5,"",nan\n')
    assert rows(read_csv(spark, path)) == [(5, None, None), (None, "x", " NA"), (None, None, None)]


@pytest.mark.parametrize("text, expected", [
    ("a;b\n1,5;2,5\n3,5;4,5\n", ";"),
    ("a,b\n\"x;y;z\",1\n\"p;q;r\",2\n", ","),
    ("a\tb\n1\t2\n", "\t"),
    ("a|b|c\n1|2,0|3\n", "|"),
    ("a\n1\n", ","),
])
def test_detect_sep(spark, tmp_path, text, expected):
    assert detect_sep(spark, put(tmp_path / "s.csv", text)) == expected


def test_cells_over_several_lines(spark, tmp_path):
    path = put(tmp_path / "q.csv", 'a,b\n1,"x\ny, ""z"""\n2,w\n')
    assert needs_multi_line(spark, path)
    assert rows(read_csv(spark, path)) == [(1, 'x\ny, "z"'), (2, "w")]
    assert not needs_multi_line(spark, put(tmp_path / "p.csv", 'a,b\n1,"x, ""z"""\n'))


def test_one_meaning_of_a_record(spark, tmp_path):
    stray = 'id,t\n1,5" pipe\n2,x\n3,y\n4,z\n5,6" tube\n6,q\n'
    want = [(1, '5" pipe'), (2, "x"), (3, "y"), (4, "z"), (5, '6" tube'), (6, "q")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("7", "40", "333", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            for multi_line in (True, "auto"):
                assert rows(read_csv(spark, put(tmp_path / f"{split}{multi_line}.csv", stray), multi_line=multi_line)) == want
            assert rows(read_csv(spark, put(tmp_path / f"{split}.csv", '\n\nid;t\n1;"a,\nb,c"\n2;"d,""\n"\n'))) == [(1, "a,\nb,c"), (2, 'd,"\n')]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rows_beyond_the_header_are_refused(spark, tmp_path):
    ragged = read_csv(spark, put(tmp_path / "r.csv", "a,b\n1,2\n3,4,5\n"), promote=False)
    with pytest.raises(Exception, match="more cells than the header"):
        ragged.collect()
    assert rows(read_csv(spark, put(tmp_path / "s.csv", "a,b\n1,2\n3\n4,5,\n"))) == [(1, 2), (3, None), (4, 5)]


def test_headers_that_differ_are_refused(spark, tmp_path):
    put(tmp_path / "in" / "1.csv", "a,b\n1,2\n")
    put(tmp_path / "in" / "2.csv", "b,a\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_csv(spark, str(tmp_path / "in"))


def test_rows_in_file_order(spark, tmp_path):
    path = put(tmp_path / "o.csv", "a,b\n" + "".join(f"{i * 7 % 50},{i}\n" for i in range(50)))
    found = read_csv(spark, path, ordered=True).orderBy("_file", "_split", "_row").collect()
    assert [r.b for r in found] == list(range(50))
    first = dedupe(read_csv(spark, put(tmp_path / "p.csv", "k,v\nx,z\nx,a\n"), ordered=True), "k", order_by=["_file", "_split", "_row"])
    assert [r.v for r in first.collect()] == ["z"]


def test_plain_numbers_and_mark(spark, tmp_path):
    df = spark.createDataFrame([(12345678.9, 1e16), (0.0001, -2.5e-7), (float("inf"), 5.0)], "x double, y double").coalesce(1)
    assert write_csv(df, str(tmp_path / "n"))
    (file,) = (tmp_path / "n").glob("part-*")
    assert file.read_text(encoding="utf-8") == "\ufeffx,y\n12345678.9,10000000000000000.0\n0.0001,-0.00000025\nInfinity,5.0\n"
    assert write_csv(df.withColumnRenamed("x", "a,b"), str(tmp_path / "q"))
    (file,) = (tmp_path / "q").glob("part-*")
    assert file.read_text(encoding="utf-8").startswith('"a,b",y\n')


def test_private_names_are_free(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3), (1, 1.0, 4)], "_metric int, _row_number double, _key_a int")
    assert dedupe(df, "_metric", order_by="_row_number").columns == df.columns
    assert rows(summarize(df, "_metric", "_row_number", ["sum"])) == [(1, 3.0)]
    assert rows(unify(df, df.select("_metric", F.lit(7).alias("z")).distinct(), "_metric", "_metric")) == [(1, 1.0, 4, 7), (1, 2.0, 3, 7)]
    put(tmp_path / "in" / "1.csv", "source_file,b\n1,2\n")
    assert read_exports(spark, str(tmp_path / "in")).columns == ["source_file", "b", "_source_file"]


def test_literals_that_do_not_fit(spark):
    df = spark.sql("SELECT 8L AS n, 1.01BD AS d, date'2024-01-01' AS day, true AS flag")
    for wrong in (("n", 8.5), ("n", "8.5"), ("d", "1.005"), ("day", "2024-01-01 10:00:00"), ("flag", "yes"), ("n", "x")):
        assert filter_eq(df, [wrong]).count() == 0
    for right in (("n", 8), ("n", "8"), ("n", 8.0), ("d", "1.01"), ("d", 1.01), ("day", "2024-01-01"), ("flag", "True"), ("flag", True)):
        assert filter_eq(df, [right]).count() == 1
    filled = fill_missing(spark.sql("SELECT CAST(NULL AS decimal(9,2)) AS d, CAST(NULL AS double) AS x"), "1.005")
    assert rows(filled) == [("1.005", 1.005)]


def test_sums_are_rounded_once(spark):
    df = spark.createDataFrame([("a", 0.004)] * 2 + [("b", 1e18), ("b", 0.5), ("c", float("inf")), ("d", 1e200), ("d", 1.0)], "k string, v double")
    found = {r.k: (r.v_sum, r.v_mean) for r in summarize(df, "k", "v", ["sum", "mean"], places=2).collect()}
    assert found == {"a": (0.01, 0.004), "b": (1e18, 5e17), "c": (float("inf"), float("inf")), "d": (1e200, 5e199)}


def test_read_file(spark, tmp_path):
    assert rows(read_file(spark, put(tmp_path / "f.CSV", "a;b\n1;2,5\n"))) == [(1, 2.5)]
    for bad in ("", "x.ods", "x"):
        with pytest.raises(ValueError):
            read_file(spark, bad)


def test_empty_input(spark, tmp_path):
    for call in (lambda: read_csv(spark, ""), lambda: read_exports(spark, ""), lambda: read_workbooks(spark, "")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        read_csv(spark, put(tmp_path / "e.csv", ""), sep=",", multi_line=False)


def test_write_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you', " pad "), (2, "line\nbreak", None)], "id int, t string, u string")
    path = str(tmp_path / "out")
    assert write_csv(df.coalesce(1), path) is True
    (part,) = [p for p in (tmp_path / "out").iterdir() if p.name.endswith(".csv")]
    assert part.read_bytes() == b'\xef\xbb\xbfid,t,u\n1,"say ""hi"", you", pad \n2,"line\nbreak",\n'
    assert rows(read_csv(spark, path)) == rows(df.withColumn("id", F.col("id").cast("bigint")))
    assert write_csv(df.limit(0), str(tmp_path / "none")) is False
    assert not (tmp_path / "none").exists()


def test_moments_and_flags_in_csv(spark, tmp_path):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ'2024-01-31 13:05:00' AS t, TIMESTAMP_NTZ'2024-01-31 13:05:00.25' AS u, "
        "DATE'2024-01-31' AS d, true AS f, 2.5D AS x"
    )
    path = tmp_path / "out"
    write_csv(df, str(path))
    (part,) = path.glob("*.csv")
    assert part.read_text("utf-8-sig") == (
        "t,u,d,f,x\n2024-01-31 13:05:00,2024-01-31 13:05:00.25,2024-01-31,True,2.5\n"
    )
    split_write(df, "f", str(tmp_path / "parts"), format="csv")
    assert rows(read_parts(spark, str(tmp_path / "parts"), df.schema, format="csv").drop("part_key")) == rows(df)


def test_numeric_cells_keep_the_text(spark):
    df = spark.createDataFrame([("1,5",), ("x",), (None,)], "v string")
    assert rows(numeric_cells(df, "v")) == [("1,5", 1.5), ("x", None), (None, None)]
    with pytest.raises(ValueError):
        numeric_cells(df.withColumn("v_num", F.lit(1)), "v")


def test_promote(spark):
    df = spark.createDataFrame(
        [("1", "1", "a,b", "True", None, "9" * 25, " 7 "), ("2", "1,5", "2", None, None, "1", "8")],
        "i string, d string, t string, f string, e string, big string, pad string",
    )
    out = promote_numeric(df)
    assert [t for _, t in out.dtypes] == ["bigint", "double", "string", "boolean", "double", "double", "bigint"]
    assert [r.t for r in out.collect()] == ["a,b", "2"]
    assert promote_numeric(df, "i").dtypes[1:] == df.dtypes[1:]
    assert [t for _, t in promote_numeric(df, "d", decimal_comma=False).dtypes][1] == "string"


def test_null_tokens_only_where_asked(spark):
    df = spark.createDataFrame([("NA", "NA", 1)], "a string, b string, n int")
    assert rows(null_tokens(df, "a")) == [(None, "NA", 1)]


def test_exports_are_read_by_name(spark, tmp_path):
    put(tmp_path / "in" / "1.csv", "a,b.x\n1,one\n", "utf-8-sig")
    put(tmp_path / "in" / "2 more.csv", "b.x,a\r\ntwo,2\r\n")
    put(tmp_path / "in" / "3.csv", "a;c\n3;x,y\n")
    put(tmp_path / "in" / "4.csv", "a,b.x\n4,NA\n")
    df = read_exports(spark, str(tmp_path / "in"))
    name = F.regexp_extract("source_file", "([^/]*)$", 1)
    assert rows(df.select("a", "`b.x`", "c", name)) == [
        ("1", "one", None, "1.csv"), ("2", "two", None, "2%20more.csv"),
        ("3", None, "x,y", "3.csv"), ("4", None, None, "4.csv"),
    ]


def test_exports_with_line_breaks(spark, tmp_path):
    put(tmp_path / "in" / "1.csv", 'a,"b\nb"\n1,"x\ny"\n')
    put(tmp_path / "in" / "2.csv", '"b\nb",a\nz,2\n')
    assert rows(read_exports(spark, str(tmp_path / "in")).select("a", "b\nb")) == [("1", "x\ny"), ("2", "z")]


def test_file_order_and_preview(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50).coalesce(1).select((F.col("id") * 7 % 50).alias("v")).write.parquet(path)
    df = read_parquet_ordered(spark, path)
    assert [r.v for r in preview(df, ["_file", "_row"], 3).collect()] == [0, 7, 14]
    with pytest.raises(ValueError):
        preview(df, [])


SHEET = """<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c><c r="C1" t="s"><v>0</v></c></row>
<row r="2"><c r="A2"><v>1.5</v></c><c r="B2" s="1"><v>45292.5</v></c><c r="C2" t="s"><v>1</v></c></row>
<row r="4"><c r="A4"><v>2</v></c><c r="C4" t="b"><v>1</v></c><c r="AA4" t="str"><v>far</v></c></row>
</sheetData></worksheet>"""


def workbook(path, sheet=SHEET):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t> n </t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    workbook(tmp_path / "b c.xlsx", SHEET.replace(">when<", ">other<"))
    df = read_workbooks(spark, str(tmp_path))
    assert df.columns == ["source_file", "row_number", "Unnamed: 26", "n", "n.1", "other", "when"]
    first = df.filter(F.col("source_file").endswith("a.xlsx")).drop("source_file", "other")
    assert rows(first) == [
        (2, None, "1.5", "rich", "2024-01-01 12:00:00"),
        (3, None, None, None, None),
        (4, "far", "2", "True", None),
    ]
    assert promote_numeric(df.select("n")).dtypes == [("n", "double")]
    assert df.filter("other is not null").count() == 1
    single = read_file(spark, str(tmp_path / "a.xlsx"))
    assert single.dtypes == [("Unnamed: 26", "string"), ("n", "double"), ("n.1", "string"), ("when", "string")]
    assert read_workbooks(spark, str(tmp_path), ["n"]).columns == ["source_file", "row_number", "n"]


def test_a_quote_that_does_not_close_is_refused(spark, tmp_path):
    (tmp_path / "good.csv").write_text('id,t\n1,"a\nb"\n2,5" pipe\n3,"say ""x"", y"\n')
    assert read_csv(spark, str(tmp_path), sep=",").count() == 3
    (tmp_path / "bad.csv").write_text('id,t\n1,"abc\n2,x\n3,y\n4,z')
    with pytest.raises(ValueError, match="bad.csv"):
        read_csv(spark, str(tmp_path), sep=",")


def test_odd_quotes_beyond_a_thousand_headers(spark, tmp_path):
    for i in range(1001):
        (tmp_path / f"{i:04}.csv").write_text(f"h{i:04},t\n1,2\n")
    (tmp_path / "z.csv").write_text('z,t\n1,"a\nb"\n')
    assert needs_multi_line(spark, str(tmp_path))


def in_splits(spark, size, work):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "0")
        return work()
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def odd_cell(rng):
    kind = rng.random()
    if kind < 0.4:
        return "".join(rng.choice('ab,;"\n\r\n x') for _ in range(rng.randrange(0, 40)))
    return "long\r\n" * rng.randrange(1, 900) if kind < 0.44 else rng.choice(["plain", "", "5 in", "é日", "0"])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_is_read_in_many_splits(spark, tmp_path, end):
    import csv
    import random

    rng = random.Random(len(end))
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as out:
            table = [[str(i), odd_cell(rng), odd_cell(rng)] for i in range(250)]
            csv.writer(out, lineterminator=end).writerows([["id", "a\r\nb", "c"], *table])
            if name == "a":
                want = table
            else:
                want = sorted([tuple(x) for x in want + table])

    def read():
        df = read_csv(spark, str(tmp_path), sep=",", promote=False, ordered=True)
        assert df.columns == ["id", "a\r\nb", "c", "_file", "_split", "_row"]
        found = df.orderBy("_file", "_split", "_row").collect()
        assert len({r["_split"] for r in found}) > 10
        assert [int(r["id"]) for r in found] == [*range(250)] * 2
        return sorted((r[0], r[1] or "", r[2] or "") for r in found)

    assert in_splits(spark, "2k", read) == want


def test_headers_are_compared_as_records(spark, tmp_path):
    (tmp_path / "one.csv").write_text('"a\nx",b,c\n1,2,3\n')
    (tmp_path / "two.csv").write_text('"a\ny",c,b\n1,2,3\n')
    with pytest.raises(ValueError, match="different headers"):
        read_csv(spark, str(tmp_path), sep=",")
    (tmp_path / "two.csv").write_text('"a\nx",b,c\n4,5,6\n')
    for size in ("4", "1m"):  # a header beyond the first split, and within it
        df = in_splits(spark, size, lambda: read_csv(spark, str(tmp_path), sep=","))
        assert df.columns == ["a\nx", "b", "c"]
        assert in_splits(spark, size, lambda: rows(df)) == [(1, 2, 3), (4, 5, 6)]


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Python workers that start in another folder, and know no path to the package, read spanning cells."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "q.csv").write_text('id,t\n1,"a\nb"\n2,"c"\n')
    code = f"""
import os, sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from tableops import read_csv
print("rows", sorted(tuple(r) for r in read_csv(spark, {str(tmp_path / "data")!r}, sep=",").collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows [(1, 'a\\nb'), (2, 'c')]" in done.stdout, done.stderr[-2000:]


def test_preview_opens_no_more_files_than_it_needs(spark, tmp_path):
    for i in range(8):
        spark.range(i * 3, i * 3 + 3).coalesce(1).write.parquet(str(tmp_path / f"part={i}"))
    broken = [next((tmp_path / f"part={i}").glob("*.parquet")) for i in range(2, 8)]
    whole = [f.read_bytes() for f in broken]
    spark.read.parquet(str(tmp_path)).count()
    for f in broken:  # a file that is opened now ends the query
        f.write_bytes(b"PAR1" + b"x" * (f.stat().st_size - 4))
        (f.parent / f".{f.name}.crc").unlink()
    assert [r["id"] for r in preview_files(spark, str(tmp_path), 3).collect()] == [0, 1, 2]
    assert [tuple(r) for r in preview_files(spark, str(tmp_path), 5).collect()] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)]
    with pytest.raises(Exception):  # noqa: B017
        preview_files(spark, str(tmp_path), 7).collect()
    for f, data in zip(broken, whole, strict=True):
        f.write_bytes(data)
    assert [r["id"] for r in preview_files(spark, str(tmp_path), 20).collect()] == list(range(20))
    assert preview_files(spark, str(tmp_path), 99).count() == 24


def test_write_csv_computes_its_input_once(spark, tmp_path):
    rows_seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for batch in batches:
            rows_seen.add(batch.num_rows)
            yield batch

    table = spark.range(100).repartition(4, "id").mapInArrow(through, "id long")
    assert write_csv(table, str(tmp_path / "new")) and rows_seen.value == 100
    assert not write_csv(table.where("id < 0"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert not write_csv(table.where("id < 0"), str(tmp_path / "new"), mode="overwrite")
    assert read_csv(spark, str(tmp_path / "new")).count() == 100
