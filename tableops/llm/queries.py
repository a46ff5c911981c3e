"""Registered queries of this package and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.llm import alignment, decontaminate, html_text, jaccard, language, manifest, neighbours, packing, quality, repeats, token_files, toxicity, urls
from tableops.llm.frames import held_out
from tableops.plans.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """The text of a public tokenizer file, read once where the query is built."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


#: Rules that the url query is asked to apply.
URL_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]


@query
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = urls.judged(table(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.grouped(table(spark, folder, "documents"), jaccard.Rule(size=4, under=85, over=100))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    placed = packing.packed_documents(table(spark, folder, "documents"), tokenizer_json(), end_id=1)
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


@query
def op4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, k=10)


@query
def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages")).drop("path")


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    found = language.predicted(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    found = toxicity.scored(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(table(spark, folder, "documents"), path, tokenizer_json(), end_id=2)
    return token_files.checked(token_files.read(spark, path))


@query
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = quality.scored(docs, quality.fit(docs), keep=["doc_id"])
    return found.select("doc_id", "score", "weak_label", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.found(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "similarity", "start", "words")


@query
def op11_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents"))


@query
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    found = alignment.aligned(table(spark, folder, "documents"), tokenizer_json("byte_bpe_50k.json"), model)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return manifest.manifest(table(spark, folder, "documents"), tampered, {"n_chars": F.col("n_chars") + 1}, ["doc_id", "source", "lang", "n_chars", "text"])


#: Words, shingles and links as the Jaccard join defines them; components by following links.
SQL["op2_jaccard_join"] = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), items AS (
  SELECT r, len(s) AS n, unnest(s) AS item FROM sets
), pairs AS (
  SELECT a.r AS a, b.r AS b FROM items a JOIN items b ON a.item = b.item AND a.r <> b.r
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
)
SELECT x.doc_id, len(x.s) AS n_shingles, min(y.doc_id) AS component_id
FROM sets x JOIN reach ON reach.a = x.r JOIN sets y ON y.r = reach.b GROUP BY x.r, x.doc_id, x.s
"""

#: Leaves, levels and siblings by plain recursion; CRC-32 bit by bit.
SQL["op13_merkle_manifest"] = """
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, source, n_chars, text,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS crc
  FROM documents
), parts AS (
  SELECT *, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
      || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
    coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail, coalesce(xor(crc, 4294967295::BIGINT) % 7 = 0, false) AS tampered
  FROM rows
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(octet_length(encode((n_chars + 1)::VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS forged
  FROM parts
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), lower_tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lower_tree WHERE n > 1 GROUP BY lang, level, pos // 2
), subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lower_tree WHERE n = 1
), upper_tree AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY level, pos // 2
), climb AS (
  SELECT lang, pos AS leaf_pos, 0 AS tree, 0 AS level, pos, n, coalesce(forged, leaf) AS h, '' AS proof FROM placed
  UNION ALL
  SELECT c.lang, c.leaf_pos, CASE WHEN c.tree = 0 AND c.n = 1 THEN 1 ELSE c.tree END,
    CASE WHEN c.tree = 0 AND c.n = 1 THEN 0 ELSE c.level + 1 END,
    CASE WHEN c.tree = 0 AND c.n = 1 THEN s.pos ELSE c.pos // 2 END,
    CASE WHEN c.tree = 0 AND c.n = 1 THEN s.n ELSE (c.n + 1) // 2 END,
    CASE WHEN c.tree = 0 AND c.n = 1 THEN c.h WHEN c.pos % 2 = 1 THEN sha256(coalesce(l.h, u.h) || c.h) ELSE sha256(c.h || coalesce(l.h, u.h, '')) END,
    c.proof || CASE WHEN c.tree = 0 AND c.n = 1 THEN '' ELSE coalesce(l.h, u.h, '') END
  FROM climb c
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang
  LEFT JOIN lower_tree l ON c.tree = 0 AND c.n > 1 AND l.lang IS NOT DISTINCT FROM c.lang AND l.level = c.level AND l.pos = xor(c.pos, 1)
  LEFT JOIN upper_tree u ON c.tree = 1 AND u.level = c.level AND u.pos = xor(c.pos, 1)
  WHERE c.tree = 0 OR c.n > 1
), top AS (
  SELECT h AS root FROM upper_tree WHERE n = 1
)
SELECT p.doc_id, p.leaf, s.subroot, t.root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.root AS verified
FROM placed p JOIN climb c ON c.tree = 1 AND c.n = 1 AND c.leaf_pos = p.pos AND c.lang IS NOT DISTINCT FROM p.lang
JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN top t
"""
