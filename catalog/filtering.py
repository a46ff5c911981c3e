from catalog.registry import query
from tableops import column_profile, distinct_values, filter_eq, keep_and_rename, preview, read_parquet_ordered, shape, total


@query("SELECT * FROM events WHERE event_type = 'purchase' AND user_id = 8")
def filter_and(t):
    return filter_eq(t("events"), [("event_type", "purchase"), ("user_id", "8")])


@query("SELECT * FROM orders WHERE o_orderstatus = 'F'")
def filter_blank_skipped(t):
    return filter_eq(t("orders"), [("o_orderpriority", ""), ("o_orderstatus", "F"), ("o_custkey", None)])


@query("""
    SELECT count(*) AS n_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
           format('{:,.2f}', CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)) AS total_text
    FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
""")
def filter_total(t):
    rows = filter_eq(t("orders"), [("o_orderstatus", "F"), ("o_orderpriority", "1-URGENT")])
    return total(rows, "o_totalprice", places=2)


@query("SELECT DISTINCT c_mktsegment AS value FROM customer", name="distinct_values")
def distinct_texts(t):
    return distinct_values(t("customer"), "c_mktsegment")


@query("SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS value FROM lineitem")
def distinct_numbers(t):
    return distinct_values(t("lineitem"), "l_linenumber")


@query("""
    SELECT position, name, kind, (SELECT count(*) FROM part) AS n_rows
    FROM (VALUES (0, 'p_partkey', 'numeric'), (1, 'p_name', 'text'), (2, 'p_brand', 'text'),
                 (3, 'p_type', 'text'), (4, 'p_size', 'numeric'), (5, 'p_retailprice', 'numeric')) v(position, name, kind)
""", name="column_profile")
def profile_columns(t):
    return column_profile(t("part"))


@query("SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def profile_shape(t):
    return shape(t("lineitem"))


@query("SELECT s_name AS supplier, s_suppkey, s_acctbal AS balance FROM supplier", name="keep_and_rename")
def rename_columns(t):
    return keep_and_rename(
        t("supplier"), ["s_name", "s_suppkey", "s_acctbal"], {"s_name": "supplier", "s_acctbal": "balance"}
    )


@query("SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def preview_rows(t):
    return preview(t("orders"), ["o_totalprice", "o_orderkey"])


@query("SELECT * FROM lineitem LIMIT 5")
def preview_file_order(t):
    """The rows that stand first in the file."""
    lines = read_parquet_ordered(t.spark, f"{t.folder}/lineitem.parquet")
    return preview(lines, ["_file", "_row"]).drop("_file", "_row")


@query("SELECT event_id, user_id FROM events WHERE user_id = 9 AND false")
def filter_literal_must_fit(t):
    """A value the column's type would round matches nothing."""
    return filter_eq(t("events").select("event_id", "user_id"), [("user_id", "8.5")])
