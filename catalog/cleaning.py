from pyspark.sql import functions as F

from catalog.registry import query
from tableops import CleanSpec, clean, dedupe, drop_missing, fill_missing, report, standardize
from tableops.functions import clean_text as clean_text_cell
from tableops.functions import strip_ws


def gappy_events(t):
    """Events with gaps in three columns of different types."""
    return t("events").select(
        "event_id",
        F.nullif("user_id", F.lit(8)).alias("user_id"),
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("value"),
        F.when(F.col("event_type") != "view", F.col("ts")).alias("ts"),
    )


GAPPY = """g AS (
    SELECT event_id, nullif(user_id, 8) AS user_id, nullif(event_type, 'error') AS event_type,
           CASE WHEN event_type <> 'signup' THEN value END AS value,
           CASE WHEN event_type <> 'view' THEN ts END AS ts
    FROM events)"""

SPACE = "||".join(
    f"chr({n})"
    for n in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)


@query("""
    SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1
""")
def dedupe_first(t):
    return dedupe(t("events"), ["user_id", "event_type"], order_by="event_id")


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedupe_rows(t):
    return dedupe(t("events").select("user_id", "event_type"))


@query("""
    SELECT doc_id, lang, source, md5(text) AS text_md5 FROM documents
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1
""")
def dedupe_documents(t):
    first = dedupe(t("documents"), "text", order_by="doc_id")
    return first.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query(f"""
    WITH {GAPPY} SELECT * FROM g
    WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL
""")
def drop_null_rows(t):
    return drop_missing(gappy_events(t))


@query(f"""
    WITH {GAPPY} SELECT event_id, COALESCE(user_id, 0) AS user_id, COALESCE(event_type, '0') AS event_type,
        COALESCE(value, 0) AS value, COALESCE(regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '\\.$', ''), '0') AS ts FROM g
""")
def fill_nulls_typed(t):
    # ts cannot hold '0', so it comes out as text.
    return fill_missing(gappy_events(t), "0")


@query(f"""
    SELECT doc_id, md5(trim(text, {SPACE})) AS stripped, md5(upper(replace(text, 'ß', 'SS'))) AS upper_md5,
           md5(lower(text)) AS lower_md5
    FROM documents
""")
def standardize_text(t):
    text = t("documents").select("doc_id", *[F.col("text").alias(c) for c in ("stripped", "upper_md5", "lower_md5")])
    for column, action in (("stripped", "strip"), ("upper_md5", "upper"), ("lower_md5", "lower")):
        text = standardize(text, column, [action])
    return text.select("doc_id", *[F.md5(c).alias(c) for c in text.columns[1:]])


CLEAN_SQL = r"trim(regexp_replace(replace({0}, chr(160), ' '), '[^\x20-\x7E\x{{C0}}-\x{{FF}}]', '', 'g'))"


@query(f"SELECT doc_id, md5({CLEAN_SQL.format('text')}) AS text_md5 FROM documents")
def clean_text(t):
    return t("documents").select("doc_id", F.md5(clean_text_cell(F.col("text"))).alias("text_md5"))


@query(f"SELECT page_id, md5({CLEAN_SQL.format('html')}) AS html_md5, md5(trim(html, {SPACE})) AS stripped FROM pages")
def clean_html(t):
    return t("pages").select(
        "page_id",
        F.md5(clean_text_cell(F.col("html"))).alias("html_md5"),
        F.md5(strip_ws(F.col("html"))).alias("stripped"),
    )


STEPS = CleanSpec(
    duplicates=("user_id", "event_type"), order_by=("event_id",), missing="drop", text_actions=("strip", "upper")
)

STEPS_SQL = f"""{GAPPY},
    d AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1),
    n AS (SELECT * FROM d WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL),
    c AS (SELECT event_id, user_id, upper(trim(event_type)) AS event_type, value, ts FROM n)"""


@query(f"WITH {STEPS_SQL} SELECT * FROM c")
def clean_in_order(t):
    return clean(gappy_events(t), STEPS)


@query(f"""
    WITH {STEPS_SQL}
    SELECT (SELECT count(*) FROM g) AS rows_before, (SELECT count(*) FROM c) AS rows_after
""")
def clean_report(t):
    before = gappy_events(t)
    return report(before, clean(before, STEPS))
