"""Queries of the retrieval family, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import TOKEN, padded
from tidewell.operators import chat, retrieval, scoring
from tidewell.sources import text_files
from tidewell.sources.tables import table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gram_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.gram_counts(items(spark, sf_dir), "query_id")


def text_df(rows: DataFrame) -> DataFrame:
    return scoring.text_df(rows.select(padded(F.col("text")).alias("padded")), "padded")


def gram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_df(docs(spark, sf_dir))


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.tfidf_topk(docs(spark, sf_dir), items(spark, sf_dir), k=3)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_topk(docs(spark, sf_dir), items(spark, sf_dir), 3).select("query_id", "doc_id", F.col("score").alias("bm25"))


def memory_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.memory_blend(docs(spark, sf_dir), items(spark, sf_dir))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.vector_topk(rows, queries)


def hash_embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hash_topk(docs(spark, sf_dir), items(spark, sf_dir))


def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = docs(spark, sf_dir), items(spark, sf_dir)
    return retrieval.with_one_more(retrieval.tfidf_topk(d, q, 3, 0.3), retrieval.hash_topk(d, q, 4, 0.3))


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_files.chunks(docs(spark, sf_dir)).select("doc_id", "section", "part", F.md5("text").alias("digest"))


def fusion_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = text_files.chunks(docs(spark, sf_dir)).select(
        F.concat_ws("-", "doc_id", "section", "part").alias("chunk_id"), F.col("doc_id").alias("source"), F.length("text").alias("length"), "title", "text", F.when(F.col("part") == 0, 1.12).otherwise(1.0).alias("weight"),
    )
    q = items(spark, sf_dir)
    # Both wordings of a question are searched in one pass, and its hashed grams too.
    wordings = [q.select(F.struct("query_id", F.lit(w).alias("share")).alias("query_id"), F.concat("text", F.lit(more)).alias("text")) for w, more in ((1.0, ""), (0.42, " data model"))]
    found, near = (df.withColumns({"query_id": F.col("query_id.query_id"), "share": F.col("query_id.share")}) for df in retrieval.chunk_searches(parts, wordings[0].unionByName(wordings[1]), wordings[0], 4, 0.42))
    hits = retrieval.fused([(found.withColumn("score", F.col("score") * F.col("share")), 1.0)], "source", "length")
    return retrieval.with_vector_hits(retrieval.context(hits), near).select("query_id", "chunk_id", F.round("score", 4).alias("score"), "place")


def example_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = docs(spark, sf_dir).select("doc_id", "text", F.col("lang").alias("answer"))
    return retrieval.example_block(lexical_topk(spark, sf_dir), texts).select("query_id", F.md5("block").alias("digest"))


def chat_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_context(table(spark, sf_dir, "conversations"), 5).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def short_followup_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.focused(table(spark, sf_dir, "conversations"), 60).select("conv_id", "turn", F.md5("focus").alias("digest"))


QUERIES = {f.__name__: f for f in (
    gram_tf, gram_df, lexical_topk, bm25_topk, memory_blend, vector_topk, hash_embedding_topk, hybrid_merge, doc_chunks, fusion_context, example_block, chat_context, short_followup_focus,
)}

NORMAL = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


def grams_sql(key: str, source: str) -> str:
    return f"""SELECT {key}, gram, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)))) AS gram
    FROM (SELECT {key}, ' ' || {NORMAL} || ' ' AS t FROM {source})) WHERE trim(gram) <> '' GROUP BY 1, 2"""


LEXICAL_SQL = f"""d AS ({grams_sql('doc_id', 'documents')}), q AS ({grams_sql('item_id', 'benchmark')}),
n AS (SELECT greatest(count(*), 1) AS n FROM documents),
idf AS (SELECT gram, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM d, n GROUP BY gram, n),
dw AS (SELECT doc_id, gram, (1 + ln(tf)) * idf AS w FROM d JOIN idf USING (gram)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
qw AS (SELECT item_id, gram, (1 + ln(tf)) * coalesce(idf, ln(1 + n) + 1) AS w FROM q CROSS JOIN n LEFT JOIN idf USING (gram)), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
scores AS (SELECT item_id AS query_id, doc_id, round(sum(dw.w * qw.w) / any_value(dn.norm) / any_value(qn.norm), 4) AS score
  FROM dw JOIN qw USING (gram) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY 1, 2),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS place FROM scores)"""

TOKENS = f"CASE WHEN len(regexp_extract_all(lower(text), '{TOKEN}')) > 0 THEN regexp_extract_all(lower(text), '{TOKEN}') ELSE ['empty'] END"
COMPACT = "regexp_replace(lower(text), '\\s+', '', 'g')"
BM25_SQL = f"""t AS (SELECT doc_id, {TOKENS} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
tf AS (SELECT doc_id, token, any_value(size) AS size, count(*) AS tf FROM (SELECT doc_id, len(t) AS size, unnest(t) AS token FROM t) GROUP BY 1, 2),
idf AS (SELECT token, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 0) AS idf FROM tf, n GROUP BY token, n),
q AS (SELECT item_id, token, count(*) AS qtf FROM (SELECT item_id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY 1, 2),
bm AS (SELECT item_id AS query_id, doc_id, sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS bm25 FROM q JOIN idf USING (token) JOIN tf USING (token) CROSS JOIN n GROUP BY 1, 2)"""


def sets_sql(name: str, made: str) -> str:
    return f"""{name} AS (SELECT item_id AS query_id, doc_id, count(*) / any_value(size) AS {name} FROM
  (SELECT item_id, len(g) AS size, unnest(g) AS g FROM (SELECT item_id, list_distinct({made}) AS g FROM (SELECT *, {COMPACT} AS c FROM benchmark))) JOIN (SELECT doc_id, unnest(list_distinct({made})) AS g FROM (SELECT *, {COMPACT} AS c FROM documents)) USING (g) GROUP BY 1, 2)"""


PAIRS = "CASE WHEN length(c) >= 2 THEN list_transform(range(1, length(c)), lambda i: substring(c, i, 2)) WHEN c <> '' THEN [c] ELSE [] END"
TRIMMED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
ORACLE_SQL = {
    "gram_tf": grams_sql("item_id AS query_id", "benchmark").replace("SELECT item_id AS query_id, gram", "SELECT query_id, gram").replace("SELECT item_id AS query_id, unnest", "SELECT query_id, unnest"),
    "gram_df": f"SELECT gram, count(*) AS df FROM ({grams_sql('doc_id', 'documents')}) GROUP BY 1",
    "lexical_topk": f"WITH {LEXICAL_SQL} SELECT query_id, doc_id, score, place FROM hits WHERE place <= 3",
    "bm25_topk": f"""WITH {BM25_SQL} SELECT query_id, doc_id, bm25 FROM (
  SELECT query_id, doc_id, round(bm25, 4) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 4) DESC, doc_id) AS place FROM bm) WHERE place <= 3""",
    "memory_blend": f"""WITH {BM25_SQL}, {sets_sql('overlap', PAIRS)}, {sets_sql('recall', TOKENS)},
top AS (SELECT query_id, max(bm25) AS top FROM bm GROUP BY 1),
blend AS (SELECT query_id, doc_id, 0.42 * coalesce(bm25 / CASE WHEN top = 0 THEN 1 ELSE top END, 0) + 0.36 * coalesce(overlap, 0) + 0.22 * coalesce(recall, 0) AS raw
  FROM overlap FULL JOIN recall USING (query_id, doc_id) LEFT JOIN bm USING (query_id, doc_id) LEFT JOIN top USING (query_id))
SELECT query_id, doc_id, score, place FROM (
  SELECT query_id, doc_id, round(raw, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 4) DESC, doc_id) AS INT) AS place FROM blend WHERE raw >= 0.34) WHERE place <= 2""",
    "vector_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 4) AS score FROM v JOIN v q ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS place FROM s) WHERE place <= 5""",
    "example_block": f"""WITH {LEXICAL_SQL} SELECT query_id, md5(string_agg('"' || text || '" -> ' || lang, chr(10) ORDER BY place)) AS digest
FROM hits JOIN documents USING (doc_id) WHERE place <= 3 GROUP BY 1""",
    "chat_context": f"""WITH c AS (SELECT conv_id, turn, role, {TRIMMED} AS text FROM conversations WHERE role IN ('user', 'assistant')),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM c WHERE text <> ''),
k AS (SELECT *, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS first_user, arg_max(role, turn) OVER (PARTITION BY conv_id) AS last_role FROM r WHERE back <= 5)
SELECT conv_id, turn, role, md5(text) AS digest FROM k WHERE turn >= first_user AND last_role = 'user'""",
    "short_followup_focus": f"""WITH u AS (SELECT conv_id, turn, {TRIMMED} AS text, lag({TRIMMED}) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(CASE WHEN length(text) < 60 AND coalesce(before, '') <> '' THEN trim(before || ' ' || text) ELSE text END) AS digest FROM u""",
}
