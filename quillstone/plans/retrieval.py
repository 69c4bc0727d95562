"""Queries of embeddings, similarity and cached solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import retrieval as R
from quillstone.operators.catalogue import canonical_ids, published
from quillstone.operators.common import joined, merged, newer
from quillstone.plans.registry import query
from quillstone.plans.roles import bank, edges, leaves, roots, table

SIM = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("label", "subject")


def _query(spark: SparkSession, d: str) -> list[float]:
    return list(_vectors(spark, d).where("vec_id = 0").first()["embedding"])


@query(f"SELECT * FROM (SELECT e.vec_id, e.label AS subject, round({SIM}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE similarity >= 0.2 ORDER BY similarity DESC, vec_id LIMIT 5")
def match_question(spark: SparkSession, d: str) -> DataFrame:
    return R.match_vector(_vectors(spark, d), _query(spark, d), threshold=0.2).select("vec_id", "subject", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT * FROM (SELECT e.vec_id, round({SIM}, 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 0) WHERE similarity >= 0.1 ORDER BY similarity DESC, vec_id LIMIT 5")
def nearest_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Grounding chunks of one subject, nearest first."""
    return R.match_vector(_vectors(spark, d), _query(spark, d), threshold=0.1, subject=0).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""
SELECT query_id, vec_id, round(s, 4) AS similarity, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, {SIM} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, e.vec_id) AS rank
  FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, embeddings e WHERE e.vec_id <> q.vec_id AND {SIM} >= 0.2) WHERE rank <= 5""")
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all: the five nearest with a similarity of 0.2 or more."""
    v = _vectors(spark, d)
    return R.search(v, v.where("vec_id % 20 = 0"), threshold=0.2).select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"), "rank")


CANDIDATES = """
groups AS (SELECT question_id, max(question_id) OVER (PARTITION BY body, kind, answer) AS canonical_id FROM bank),
candidates AS (
  SELECT 'mcq' AS source, canonical_id AS group_id, body || coalesce(chr(10) || opts, '') AS text FROM groups JOIN bank USING (question_id)
    LEFT JOIN (SELECT question_id, string_agg(topic_id || ': ' || source, chr(10) ORDER BY topic_id) AS opts FROM edges WHERE topic_id <> 12 GROUP BY question_id) o USING (question_id) WHERE status = 'approved' AND question_id = canonical_id
  UNION ALL SELECT 'structured', root, string_agg(flag || marks, ' ' ORDER BY n, flag || marks) FROM leaves JOIN roots USING (root) WHERE state <> 'P' GROUP BY root)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    q = bank(spark, d)
    heads = published(q).join(canonical_ids(q).where("question_id = canonical_id").select("question_id"), "question_id", "left_semi")
    options = edges(spark, d).where("topic_id <> 12").groupBy("question_id").agg(joined(["topic_id"], F.concat_ws(": ", "topic_id", "source"), "\n").alias("opts"))
    mcq = heads.join(options, "question_id", "left").select(F.lit("mcq").alias("source"), F.col("question_id").alias("group_id"), F.concat("body", F.coalesce(F.concat(F.lit("\n"), "opts"), F.lit(""))).alias("text"))
    shown = roots(spark, d).where("state <> 'P'").select("root")
    trees = leaves(spark, d).join(shown, "root", "left_semi").groupBy("root").agg(joined(["n"], F.concat("flag", "marks"), " ").alias("text"))
    return mcq.unionByName(trees.select(F.lit("structured").alias("source"), F.col("root").alias("group_id"), "text"))


@query(f"WITH {CANDIDATES} SELECT source, group_id, text FROM candidates")
def embed_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d)


@query(f"WITH {CANDIDATES} " + """
SELECT group_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'missing_text' WHEN group_id % 3 = 0 THEN 'new' WHEN group_id % 3 = 1 THEN 'unchanged' ELSE 'stale' END AS state FROM candidates WHERE source = 'mcq'""")
def embed_plan(spark: SparkSession, d: str) -> DataFrame:
    """Stored hashes: none for every third group, the present one for the next, an old one for the rest."""
    mcq = _candidates(spark, d).where("source = 'mcq'").select("group_id", "text")
    stored = mcq.where("group_id % 3 > 0").select("group_id", F.when(F.col("group_id") % 3 == 1, F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit(".")), 256)).alias("stored_hash"))
    return R.embedding_plan(mcq, stored)


@query("""
SELECT coalesce(n.vec_id, o.vec_id) AS vec_id, CASE WHEN n.vec_id IS NOT NULL THEN len(n.embedding) ELSE len(o.embedding) END AS dim, sha256(coalesce(n.vec_id, o.vec_id)::VARCHAR) AS hash, CASE WHEN n.vec_id IS NOT NULL THEN 'm2' ELSE 'm1' END AS model
FROM (SELECT * FROM embeddings WHERE vec_id % 3 <> 0) o FULL JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) n ON o.vec_id = n.vec_id""")
def embed_merge(spark: SparkSession, d: str) -> DataFrame:
    """New vectors written over stored ones by question, with their hash and model."""
    v = _vectors(spark, d).select("vec_id", "embedding", F.sha2(F.col("vec_id").cast("string"), 256).alias("hash"))
    old, new = v.where("vec_id % 3 <> 0").withColumn("model", F.lit("m1")), v.where("vec_id % 2 = 0").withColumn("model", F.lit("m2"))
    return merged(old, new, ["vec_id"], {c: newer(c) for c in ("embedding", "hash", "model")}).select("vec_id", F.size("embedding").alias("dim"), "hash", "model")


@query("SELECT question_id FROM bank WHERE status = 'approved' AND question_id NOT IN (SELECT part FROM leaves WHERE part IS NOT NULL AND flag = 'R' AND n = 1)")
def solution_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Approved questions without a stored solution; each has one computation to come."""
    cached = leaves(spark, d).where("flag = 'R' AND n = 1 AND part IS NOT NULL").select(F.col("part").alias("question_id"))
    return published(bank(spark, d)).select("question_id").join(cached, "question_id", "left_anti")


GRAMS = "list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))"


@query(f"""
WITH t AS (SELECT text, {GRAMS} AS g FROM (SELECT DISTINCT body AS text, '  ' || lower(body) || ' ' AS p FROM bank)),
q AS (SELECT text AS query, g FROM t WHERE text IN (SELECT body FROM bank WHERE question_id % 20 = 0)),
s AS (SELECT query, text, len(list_intersect(q.g, t.g)) AS n, len(q.g) AS nq, len(t.g) AS nt FROM q, t)
SELECT query, text, round(n / (nq + nt - n), 4) AS similarity FROM s WHERE round(n / (nq + nt - n), 4) >= 0.3""")
def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy search of question text by trigrams: every twentieth question's text against all."""
    q = bank(spark, d)
    return R.fuzzy_search(q.select(F.col("body").alias("text")), q.where("question_id % 20 = 0").select(F.col("body").alias("query")))
