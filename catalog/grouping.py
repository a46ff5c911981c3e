from pyspark.sql import functions as F

from catalog.registry import query
from tableops import summarize

MONEY = "decimal(18,2)"
ALL = ["sum", "mean", "count", "max", "min"]


@query("""
    SELECT l_returnflag, l_linestatus,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS l_extendedprice_sum,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(l_extendedprice) AS l_extendedprice_mean,
           count(l_extendedprice) AS l_extendedprice_count,
           max(l_extendedprice) AS l_extendedprice_max,
           min(l_extendedprice) AS l_extendedprice_min
    FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def summarize_lineitem(t):
    return summarize(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", ALL, places=2)


@query("""
    SELECT l_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS l_quantity_sum,
           count(l_quantity) AS l_quantity_count
    FROM lineitem GROUP BY l_suppkey
""")
def summarize_many_groups(t):
    return summarize(t("lineitem"), "l_suppkey", "l_quantity", ["sum", "count"], places=2)


@query("""
    WITH e AS (
        SELECT nullif(event_type, 'error') AS kind, user_id,
               CASE event_type WHEN 'view' THEN 'n/d' WHEN 'click' THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || 'd'
                    ELSE CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS amount
        FROM events),
    n AS (SELECT kind, TRY_CAST(amount AS DOUBLE) AS amount FROM e WHERE kind IS NOT NULL)
    SELECT kind, COALESCE(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE), 0) AS amount_sum,
           CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / nullif(count(amount), 0) AS amount_mean,
           count(amount) AS amount_count, max(amount) AS amount_max, min(amount) AS amount_min
    FROM n GROUP BY kind
""")
def summarize_null_keys(t):
    text = F.col("value").cast(MONEY).cast("string")
    events = t("events").select(
        F.nullif("event_type", F.lit("error")).alias("kind"),
        F.when(F.col("event_type") == "view", "n/d")
        .when(F.col("event_type") == "click", F.concat(text, F.lit("d")))
        .otherwise(text)
        .alias("amount"),
    )
    return summarize(events, "kind", "amount", ALL, places=2)


@query("""
    SELECT n_regionkey, CAST(sum(n_regionkey) AS BIGINT) AS n_regionkey_sum, count(n_regionkey) AS n_regionkey_count
    FROM nation GROUP BY n_regionkey
""")
def summarize_key_is_metric(t):
    return summarize(t("nation"), "n_regionkey", "n_regionkey", ["sum", "count"])


@query("""
    SELECT l_suppkey, CAST(round(sum(CAST(l_tax / 100 AS DECIMAL(18,6))), 2) AS DOUBLE) AS part_sum,
           round(CAST(sum(CAST(l_tax / 100 AS DECIMAL(18,6))) AS DOUBLE) / count(*), 9) AS part_mean
    FROM lineitem GROUP BY l_suppkey
""")
def summarize_small_parts(t):
    """Many values below the last place that is asked for."""
    parts = t("lineitem").select("l_suppkey", F.round(F.col("l_tax") / 100, 6).alias("part"))
    return summarize(parts, "l_suppkey", "part", ["sum", "mean"], places=2).withColumn("part_mean", F.round("part_mean", 9))
