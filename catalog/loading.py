from contextlib import contextmanager

from pyspark.sql import functions as F

from catalog.registry import query
from tableops import null_tokens, numeric_cells, preview_files, promote_numeric, read_csv, read_exports, write_csv
from tableops.operators import dedupe
from tableops.plans.scratch import scratch_path, written
from tableops.sources.csv import ORDER

MONEY = "decimal(18,2)"
# Bytes of text in one long file, about: a task writes each of them.
LONG_FILE = 256 << 20


@contextmanager
def split_size(spark, size):
    """Read files in splits of about ``size`` bytes for a while."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        yield
    finally:
        for n in names:
            spark.conf.set(n, before[n])


def typed_in(t):
    """Customers as somebody might have typed them: all cells are text."""
    balance = F.replace(F.col("c_acctbal").cast(MONEY).cast("string"), F.lit("."), F.lit(","))
    return t("customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.when(F.col("c_nationkey") != 3, balance).alias("balance"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Silva, J")).otherwise(balance).alias("mixed"),
        F.when(F.col("c_acctbal") < 0, F.lit("True")).otherwise(F.lit("False")).alias("in_debt"),
        F.lit(None).cast("string").alias("nothing"),
    )


TYPED = """d AS (
    SELECT CAST(c_custkey AS VARCHAR) AS id,
           replace(CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR), '.', ',') AS text, *
    FROM customer),
    i AS (SELECT id, CASE WHEN c_nationkey <> 3 THEN text END AS balance,
                 CASE WHEN c_mktsegment = 'BUILDING' THEN 'Silva, J' ELSE text END AS mixed,
                 c_acctbal < 0 AS in_debt, CAST(NULL AS DOUBLE) AS nothing FROM d)"""


@query(f"""
    WITH {TYPED}
    SELECT id, balance, mixed, TRY_CAST(replace(balance, ',', '.') AS DOUBLE) AS balance_num,
           TRY_CAST(replace(mixed, ',', '.') AS DOUBLE) AS mixed_num FROM i
""", name="numeric_cells")
def numeric_cells_customer(t):
    return numeric_cells(typed_in(t).select("id", "balance", "mixed"), ["balance", "mixed"])


@query(f"""
    WITH {TYPED}
    SELECT CAST(id AS BIGINT) AS id, CAST(replace(balance, ',', '.') AS DOUBLE) AS balance, mixed, in_debt, nothing FROM i
""", name="promote_numeric")
def promote_numeric_customer(t):
    return promote_numeric(typed_in(t))


@query("""
    SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_type END AS kind FROM events
""")
def null_tokens_events(t):
    word = F.when(F.col("event_type") == "error", "N/A").when(F.col("event_type") == "view", "")
    return null_tokens(t("events").select("event_id", word.otherwise(F.col("event_type")).alias("kind")))


@query("""
    SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer
""")
def csv_roundtrip(t):
    path = scratch_path(t.spark, "csv")
    write_csv(t("customer"), path, bom=True, sep=";")
    return read_csv(t.spark, path)


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def csv_long_cells_in_splits(t):
    """The same from many files, which are read in parallel."""
    path = scratch_path(t.spark, "csv")
    write_csv(t("documents").repartition(16, "doc_id"), path)
    back = read_csv(t.spark, path, multi_line=True)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 7")
def preview_in_file_order(t):
    """The first rows of a table written in order as many files, found without opening all of them."""
    path = scratch_path(t.spark, "ordered")
    t("events").select("event_id", "user_id", "event_type").repartitionByRange(16, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return preview_files(t.spark, path, 7)


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def csv_one_long_file_in_splits(t):
    """One file with line breaks in most records, read by many tasks: splits are far smaller than the file.

    A file has one writer, so above ``LONG_FILE`` bytes of text there are more of them, each as many splits long.
    """
    path = scratch_path(t.spark, "csv")
    size = t("documents").agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = -(-size // LONG_FILE) or 1
    write_csv(t("documents").coalesce(1) if files == 1 else t("documents").repartition(files), path)
    with split_size(t.spark, max(1 << 16, size // files // 64)):
        back = read_csv(t.spark, path)
        kept = written(back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars"), "long-file")
    return kept


@query("""
    SELECT doc_id AS "doc id", replace(text, chr(10), chr(13) || chr(10)) = text AS same_breaks, n_chars FROM documents
""")
def csv_two_line_headers(t):
    """Headers and cells over several lines, with carriage returns in the cells."""
    path = scratch_path(t.spark, "csv")
    crlf = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    write_csv(t("documents").select(F.col("doc_id").alias("doc\nid"), crlf.alias("the\ntext"), "n_chars"), path)
    back = read_csv(t.spark, path).withColumnRenamed("doc\nid", "doc_id").join(t("documents").select("doc_id", "text"), "doc_id")
    same = F.col("the\ntext") == F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return back.where(same).select(F.col("doc_id").alias("doc id"), (F.col("the\ntext") == F.col("text")).alias("same_breaks"), "n_chars")


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents")
def csv_long_cells(t):
    """Cells with line breaks, quotes and separators in them."""
    path = scratch_path(t.spark, "csv")
    write_csv(t("documents"), path)
    back = read_csv(t.spark, path)
    return back.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


@query("""
    SELECT CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'swapped' ELSE 'short' END AS layout,
           CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice AS o_totalprice_num,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority
    FROM orders
""", name="read_exports")
def exports_of_three_layouts(t):
    """Exports whose columns are swapped or absent, read by name in one go."""
    path = scratch_path(t.spark, "exports")
    columns = ["o_orderkey", "o_totalprice", "o_orderpriority"]
    layouts = {"full": ("F", columns), "swapped": ("O", columns[::-1]), "short": ("P", columns[:2])}
    for name, (status, chosen) in layouts.items():
        write_csv(t("orders").filter(F.col("o_orderstatus") == status).select(chosen), f"{path}/layout={name}")
    back = numeric_cells(read_exports(t.spark, f"{path}/*"), "o_totalprice")
    layout = F.regexp_extract("source_file", "layout=([^/]*)/", 1)
    return back.select(layout.alias("layout"), "o_orderkey", "o_totalprice_num", "o_orderpriority")


@query("""
    SELECT doc_id, md5(doc_id || ',5" pipe ' || n_chars) AS note_md5, n_chars FROM documents
""")
def csv_stray_quotes(t):
    """Inch marks inside cells that are not quoted, an odd number of them in a line."""
    path = scratch_path(t.spark, "csv")
    line = F.concat_ws(";", F.col("doc_id"), F.concat(F.col("doc_id"), F.lit(',5" pipe '), F.col("n_chars")), F.col("n_chars"))
    header = t.spark.range(1).select(F.lit("doc_id;note;n_chars").alias("value"))
    header.union(t("documents").select(line)).coalesce(1).write.text(path)
    return read_csv(t.spark, path).select("doc_id", F.md5("note").alias("note_md5"), "n_chars")


@query("""
    SELECT CAST(event_id AS BIGINT) AS event_id, user_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY file_row_number) = 1
""".replace("file_row_number", "event_id % 7, event_id"))
def dedupe_first_in_csv(t):
    """Events in a file whose order no column tells: the first row of each group in the file stays."""
    path = scratch_path(t.spark, "csv")
    rows = t("events").select("event_id", "user_id", "event_type")
    write_csv(rows.orderBy(F.col("event_id") % 7, "event_id").coalesce(1), path)
    read = read_csv(t.spark, path, ordered=True)
    return dedupe(read, ["user_id", "event_type"], order_by=ORDER).drop(*ORDER)
