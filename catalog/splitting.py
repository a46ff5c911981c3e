from pyspark.sql import functions as F

from catalog.registry import query
from tableops import manifest, read_parts, split_write
from tableops.plans.scratch import scratch_path

SLUG = r"replace(trim(regexp_replace({0}, '[^\p{{L}}\p{{N}}_\s-]+', '', 'g')), ' ', '_')"


@query(f"""
    SELECT o_orderpriority AS part_key, {SLUG.format("o_orderpriority")} AS slug, count(*) AS n_rows,
           true AS written, false AS collides
    FROM orders GROUP BY o_orderpriority
""")
def split_manifest(t):
    return manifest(t("orders"), "o_orderpriority")


def awkward_segments(t):
    """Segment names with a gap, an empty value and two spellings of one label."""
    segment = F.col("c_mktsegment")
    spelled = (
        F.when(F.col("c_nationkey") < 5, F.concat(F.lit("/"), segment))
        .when(F.col("c_nationkey") == 7, F.lit(""))
        .otherwise(segment)
    )
    return t("customer").withColumn("segment", F.nullif(spelled, F.lit("BUILDING")))


SEGMENTS = """s AS (
    SELECT *, nullif(CASE WHEN c_nationkey < 5 THEN '/' || c_mktsegment WHEN c_nationkey = 7 THEN ''
                          ELSE c_mktsegment END, 'BUILDING') AS segment FROM customer)"""


@query(f"""
    WITH {SEGMENTS},
    k AS (SELECT segment, {SLUG.format("segment")} AS slug, count(*) AS n_rows FROM s GROUP BY segment)
    SELECT CASE segment WHEN '' THEN '__EMPTY__' ELSE segment END AS part_key, slug, n_rows,
           segment IS NOT NULL AS written,
           segment IS NOT NULL AND count(*) OVER (PARTITION BY slug) > 1 AS collides
    FROM k
""")
def split_manifest_awkward(t):
    return manifest(awkward_segments(t), "segment")


@query("SELECT *, o_orderpriority AS part_key FROM orders")
def split_roundtrip(t):
    orders = t("orders")
    path = scratch_path(t.spark, "split")
    split_write(orders, "o_orderpriority", path)
    return read_parts(t.spark, path, orders.schema)


@query(f"""
    WITH {SEGMENTS}
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, nullif(segment, '') AS segment,
           CASE segment WHEN '' THEN '__EMPTY__' ELSE segment END AS part_key
    FROM s WHERE segment IS NOT NULL
""")
def split_roundtrip_csv(t):
    customers = awkward_segments(t)
    path = scratch_path(t.spark, "split")
    split_write(customers, "segment", path, format="csv")
    return read_parts(t.spark, path, customers.schema, format="csv")


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, n_chars, lang AS part_key FROM documents")
def split_roundtrip_documents(t):
    """Whole texts, line breaks and quotes in them, through CSV parts."""
    documents = t("documents")
    path = scratch_path(t.spark, "split")
    split_write(documents, "lang", path, format="csv")
    back = read_parts(t.spark, path, documents.schema, format="csv")
    return back.withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")
