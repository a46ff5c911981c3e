from pyspark.sql import functions as F

from catalog.registry import query
from tableops import compare

VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINE = ["l_orderkey", "l_linenumber"]
ORDER = ["l_partkey", "l_suppkey"]


def lines_before(t):
    """First delivery: no lines at the highest discount."""
    return t("lineitem").filter(F.col("l_discount") < 0.1)


def lines_after(t):
    """Second delivery: no returned lines, some prices moved, some flags changed."""
    moved = (
        F.when(F.col("l_tax") == 0, F.col("l_extendedprice") + 0.00005)
        .when(F.col("l_tax") >= 0.08, F.col("l_extendedprice") + 1.0)
        .otherwise(F.col("l_extendedprice"))
    )
    flag = F.when(F.col("l_quantity") > 49, None).otherwise(F.col("l_linestatus"))
    kept = t("lineitem").filter(F.col("l_returnflag") != "R")
    return kept.withColumns({"l_extendedprice": moved, "l_linestatus": flag})


def lines(t):
    return compare(lines_before(t), lines_after(t), LINE, order_by=ORDER)


_REST = ", ".join(ORDER + VALUES)
_SHARED = ORDER + VALUES
LINES_SQL = f"""
    a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_REST}) AS occ
          FROM lineitem WHERE l_discount < 0.1),
    moved AS (SELECT * REPLACE (
                 CASE WHEN l_tax = 0 THEN l_extendedprice + 0.00005 WHEN l_tax >= 0.08 THEN l_extendedprice + 1.0
                      ELSE l_extendedprice END AS l_extendedprice,
                 CASE WHEN l_quantity > 49 THEN NULL ELSE l_linestatus END AS l_linestatus)
              FROM lineitem WHERE l_returnflag <> 'R'),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_REST}) AS occ FROM moved),
    j AS (SELECT {", ".join(f"a.{c} AS {c}_a, b.{c} AS {c}_b" for c in LINE + _SHARED)}, a.occ AS occ_a, b.occ AS occ_b
          FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.occ = b.occ)
"""


def _match(column):
    a, b = f"{column}_a", f"{column}_b"
    if column in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        return f"COALESCE({a} IS NOT DISTINCT FROM {b} OR abs({a} - {b}) <= 0.0001, false)"
    return f"({a} IS NOT DISTINCT FROM {b})"


_ALL_MATCH = " AND ".join(_match(c) for c in _SHARED)
_PAIRED = "occ_a IS NOT NULL AND occ_b IS NOT NULL"
_BOTH = (
    "l_orderkey_a AS l_orderkey, l_linenumber_a AS l_linenumber, "
    + ", ".join(f"{c}_a, {c}_b, {_match(c)} AS {c}_match" for c in _SHARED)
    + f", ({_ALL_MATCH}) AS all_match"
)


def _side(side, missing):
    columns = ", ".join(f"{c}_{side} AS {c}" for c in LINE + _SHARED)
    return f"WITH {LINES_SQL} SELECT {columns} FROM j WHERE occ_{missing} IS NULL"


@query(_side("a", "b"))
def compare_only_a(t):
    return lines(t).only_a


@query(_side("b", "a"))
def compare_only_b(t):
    return lines(t).only_b


@query(f"WITH {LINES_SQL} SELECT {_BOTH} FROM j WHERE {_PAIRED}")
def compare_both(t):
    return lines(t).both


@query(f"""
    WITH {LINES_SQL}
    SELECT {_BOTH} FROM j WHERE {_PAIRED} AND NOT ({_ALL_MATCH})
    ORDER BY l_orderkey_a, l_linenumber_a, occ_a LIMIT 10
""")
def compare_samples(t):
    return lines(t).samples(10)


_COUNTS = f"""
    SELECT count(occ_a) AS rows_a, count(occ_b) AS rows_b,
           count(*) FILTER (occ_b IS NULL) AS only_a, count(*) FILTER (occ_a IS NULL) AS only_b,
           count(*) FILTER ({_PAIRED}) AS both,
           count(*) FILTER ({_PAIRED} AND {_ALL_MATCH}) AS both_equal,
           count(*) FILTER ({_PAIRED} AND NOT ({_ALL_MATCH})) AS both_different,
           9 AS columns_shared, 0 AS columns_only_a, 0 AS columns_only_b
    FROM j
"""


@query(f"""
    WITH {LINES_SQL}, c AS ({_COUNTS})
    SELECT *, (only_a = 0 AND only_b = 0 AND both_different = 0) AS matches FROM c
""")
def compare_summary(t):
    return lines(t).summary()


def _stat(column):
    a, b = f"{column}_a", f"{column}_b"
    gap = "CAST(NULL AS DOUBLE)"
    if column not in ("l_returnflag", "l_linestatus", "l_shipdate"):
        gap = f"max(abs(CAST({a} AS DOUBLE) - CAST({b} AS DOUBLE)))"
    return f"""
        SELECT '{column}' AS "column", count(*) FILTER ({_match(column)}) AS n_equal,
               count(*) FILTER (NOT {_match(column)}) AS n_different,
               count(*) FILTER (({a} IS NULL) <> ({b} IS NULL)) AS n_one_missing, {gap} AS max_difference
        FROM j WHERE {_PAIRED}"""


@query(f"WITH {LINES_SQL} " + " UNION ALL ".join(_stat(c) for c in _SHARED))
def compare_column_stats(t):
    return lines(t).column_stats()


@query("""
    WITH a AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'),
         b AS (SELECT * REPLACE (CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_totalprice END AS o_totalprice)
               FROM orders WHERE o_orderpriority <> '1-URGENT')
    SELECT a.o_orderkey, a.o_totalprice AS o_totalprice_a, b.o_totalprice AS o_totalprice_b,
           abs(a.o_totalprice - b.o_totalprice) <= 0.0001 AS o_totalprice_match,
           a.o_custkey, a.o_orderstatus, a.o_orderdate, a.o_orderpriority, b.o_orderpriority AS urgency,
           abs(a.o_totalprice - b.o_totalprice) <= 0.0001 AS all_match
    FROM a JOIN b ON a.o_orderkey = b.o_orderkey
""")
def compare_renamed_keys(t):
    a = t("orders").filter(F.col("o_orderstatus") != "P")
    price = F.when(F.col("o_orderpriority") == "5-LOW", 0.0).otherwise(F.col("o_totalprice"))
    b = (
        t("orders")
        .filter(F.col("o_orderpriority") != "1-URGENT")
        .select(F.col("o_orderkey").alias("id"), price.alias("o_totalprice"), F.col("o_orderpriority").alias("urgency"))
    )
    return compare(a, b, ["o_orderkey"], ["id"]).both


_TEXTS_SQL = r"""
    WITH a AS (SELECT doc_id, lang, text FROM documents WHERE lang <> 'de'),
         b AS (SELECT doc_id, CASE WHEN source = 'src1' THEN upper(lang) ELSE lang END AS lang,
                      CASE WHEN source = 'src2' THEN text || ' ' ELSE text END AS text
               FROM documents WHERE source <> 'src0')
    SELECT a.doc_id, a.lang AS lang_a, b.lang AS lang_b, a.lang = b.lang AS lang_match,
           md5({0}) AS text_a, md5({1}) AS text_b, a.text = b.text AS text_match,
           a.lang = b.lang AND a.text = b.text AS all_match
    FROM a JOIN b ON a.doc_id = b.doc_id
"""
_TIDY = r"trim(regexp_replace(replace({0}, chr(160), ' '), '[^\x20-\x7E\x{{C0}}-\x{{FF}}]', '', 'g'))"


@query(_TEXTS_SQL.format(_TIDY.format("a.text"), _TIDY.format("b.text")))
def compare_documents(t):
    a = t("documents").filter(F.col("lang") != "de").select("doc_id", "lang", "text")
    b = (
        t("documents")
        .filter(F.col("source") != "src0")
        .select(
            "doc_id",
            F.when(F.col("source") == "src1", F.upper("lang")).otherwise(F.col("lang")).alias("lang"),
            F.when(F.col("source") == "src2", F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text"),
        )
    )
    both = compare(a, b, "doc_id").both
    return both.withColumns({"text_a": F.md5("text_a"), "text_b": F.md5("text_b")})


@query("""
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS occ FROM events),
         b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS occ
               FROM events WHERE user_id <> 8)
    SELECT a.event_type, a.event_id AS event_id_a, b.event_id AS event_id_b, a.event_id = b.event_id AS event_id_match,
           a.value AS value_a, b.value AS value_b, abs(a.value - b.value) <= 0.0001 AS value_match,
           a.event_id = b.event_id AND abs(a.value - b.value) <= 0.0001 AS all_match
    FROM a JOIN b ON a.event_type = b.event_type AND a.occ = b.occ
""")
def compare_hot_keys(t):
    """Five keys hold all the rows; each is spread over many tasks."""
    events = t("events").select("event_type", "event_id", "value", "user_id")
    a, b = events.drop("user_id"), events.filter(F.col("user_id") != 8).drop("user_id")
    return compare(a, b, "event_type", order_by="event_id", hot_rows=100, hot_sample=1.0).both


@query("""
    WITH j AS (SELECT o_orderkey, 12345678901234560000 + o_orderkey + CAST(0.01 AS DECIMAL(38,2)) AS a,
                      12345678901234560000 + o_orderkey + CAST(CASE WHEN o_custkey % 3 = 0 THEN 0.99 ELSE 0.01 END AS DECIMAL(38,2)) AS b
               FROM orders)
    SELECT o_orderkey, a = b AS amount_match FROM j
""")
def compare_big_decimals(t):
    """Amounts that a floating number could not tell apart."""
    base = F.lit("12345678901234560000").cast("decimal(38,2)") + F.col("o_orderkey")
    cents = F.when(F.col("o_custkey") % 3 == 0, "0.99").otherwise("0.01").cast("decimal(3,2)")
    a = t("orders").select("o_orderkey", (base + F.lit("0.01").cast("decimal(3,2)")).cast("decimal(38,2)").alias("amount"))
    b = t("orders").select("o_orderkey", (base + cents).cast("decimal(38,2)").alias("amount"))
    return compare(a, b, "o_orderkey").both.select("o_orderkey", "amount_match")
