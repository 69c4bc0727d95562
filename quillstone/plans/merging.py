"""Queries of merges, replacements and state transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import merging as M
from quillstone.operators.common import merged, newer, replaced
from quillstone.plans.registry import query
from quillstone.plans.roles import bank, docs, edges, leaves, roots, table, topics


def _old(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("approved", "rejected", "needs_review", "extracted"))), (k % 4).cast("int") + 1)
    flags = F.when(k % 5 == 0, F.array(F.lit("unmatched_mark_scheme"))).when(k % 5 == 1, F.array(F.lit("low_confidence"), F.lit("unmatched_mark_scheme"))).otherwise(F.array().cast("array<string>"))
    return docs(spark, d).where("doc_id % 3 <> 0").select(k.alias("key"), F.col("text"), F.when(k % 2 == 0, F.col("source")).alias("scheme"), status.alias("status"), flags.alias("flags"))


def _new(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    flags = F.when(k % 4 == 0, F.array(F.lit("unmatched_mark_scheme"))).when(k % 7 == 0, F.array(F.lit("sparse"))).otherwise(F.array().cast("array<string>"))
    return docs(spark, d).where("doc_id % 2 = 0").select(k.alias("key"), F.concat(F.lit("*"), "text").alias("text"), F.when(k % 10 == 0, F.lit("new")).alias("scheme"), F.lit(None).cast("string").alias("status"), flags.alias("flags"))


SNAPSHOTS = """
old AS (SELECT doc_id AS key, text, CASE WHEN doc_id % 2 = 0 THEN source END AS scheme, ['approved', 'rejected', 'needs_review', 'extracted'][doc_id % 4 + 1] AS status,
  CASE doc_id % 5 WHEN 0 THEN ['unmatched_mark_scheme'] WHEN 1 THEN ['low_confidence', 'unmatched_mark_scheme'] ELSE [] END AS flags FROM documents WHERE doc_id % 3 <> 0),
new AS (SELECT doc_id AS key, '*' || text AS text, CASE WHEN doc_id % 10 = 0 THEN 'new' END AS scheme,
  CASE WHEN doc_id % 4 = 0 THEN ['unmatched_mark_scheme'] WHEN doc_id % 7 = 0 THEN ['sparse'] ELSE [] END AS flags FROM documents WHERE doc_id % 2 = 0)"""


@query(f"WITH {SNAPSHOTS}, " + """
both_sides AS (
  SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NOT NULL THEN n.text ELSE o.text END AS text, coalesce(n.scheme, o.scheme) AS scheme, o.status AS o_status, coalesce(o.flags, []) AS o_flags,
    n.key IS NULL OR coalesce(o.status IN ('approved', 'rejected'), false) AS keeps,
    list_distinct(list_filter(coalesce(o.flags, []), lambda f: f <> 'unmatched_mark_scheme') || coalesce(n.flags, [])) AS joint, coalesce(o.scheme <> '', false) AS had FROM old o FULL JOIN new n ON o.key = n.key),
ruled AS (SELECT *, CASE WHEN had THEN list_filter(joint, lambda f: f <> 'unmatched_mark_scheme') ELSE joint END AS j FROM both_sides)
SELECT key, text, scheme, CASE WHEN keeps THEN o_status WHEN len(j) > 0 THEN 'needs_review' ELSE 'extracted' END AS status, array_to_string(list_sort(CASE WHEN keeps THEN o_flags ELSE j END), ',') AS flags FROM ruled""")
def merge_questions(spark: SparkSession, d: str) -> DataFrame:
    return M.merge_questions(_old(spark, d), _new(spark, d)).withColumn("flags", F.array_join("flags", ","))


@query("""
SELECT coalesce(o.paper, n.paper) AS paper, coalesce(n.slug, o.slug) AS slug, coalesce(n.kind, o.kind) AS kind FROM
  (SELECT paper, 'p-' || paper AS slug, min(priority) AS kind FROM roots WHERE root % 2 = 0 GROUP BY paper) o
  FULL JOIN (SELECT paper, 'q-' || paper AS slug, CASE WHEN paper % 3 <> 0 THEN max(priority) END AS kind FROM roots WHERE root % 3 = 0 GROUP BY paper) n ON o.paper = n.paper""")
def merge_papers(spark: SparkSession, d: str) -> DataFrame:
    r = roots(spark, d)
    old = r.where("root % 2 = 0").groupBy("paper").agg(F.min("priority").alias("kind")).select("paper", F.concat_ws("-", F.lit("p"), "paper").alias("slug"), "kind")
    new = r.where("root % 3 = 0").groupBy("paper").agg(F.max("priority").alias("kind")).select("paper", F.concat_ws("-", F.lit("q"), "paper").alias("slug"), F.when(F.col("paper") % 3 != 0, F.col("kind")).alias("kind"))
    return merged(old, new, ["paper"], {"slug": newer("slug"), "kind": F.coalesce("n_kind", "o_kind")})


@query("""
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.n_chars ELSE o.n_chars END AS byte_size, coalesce(n.url, o.url) AS url FROM
  (SELECT doc_id, n_chars, source AS url FROM documents WHERE doc_id % 3 <> 0) o
  FULL JOIN (SELECT doc_id, n_chars + 1 AS n_chars, CASE WHEN doc_id % 4 = 0 THEN lang END AS url FROM documents WHERE doc_id % 2 = 0) n ON o.doc_id = n.doc_id""")
def merge_documents(spark: SparkSession, d: str) -> DataFrame:
    old = docs(spark, d).where("doc_id % 3 <> 0").select("doc_id", F.col("n_chars").alias("byte_size"), F.col("source").alias("url"))
    new = docs(spark, d).where("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") + 1).alias("byte_size"), F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("url"))
    return merged(old, new, ["doc_id"], {"byte_size": newer("byte_size"), "url": F.coalesce("n_url", "o_url")})


@query("""
SELECT question_id, topic_id, source FROM edges WHERE question_id NOT IN (SELECT question_id FROM bank WHERE question_id % 5 = 0)
UNION ALL SELECT question_id, (question_id + t) % 10, 'new' FROM bank, (SELECT unnest([1, 2]) AS t) WHERE question_id % 5 = 0""")
def replace_children(spark: SparkSession, d: str) -> DataFrame:
    new = bank(spark, d).where("question_id % 5 = 0").select("question_id", F.explode(F.array((F.col("question_id") + 1) % 10, (F.col("question_id") + 2) % 10)).alias("topic_id"), F.lit("new").alias("source"))
    return replaced(edges(spark, d).select("question_id", "topic_id", "source"), new, ["question_id"])


@query("SELECT n_nationkey AS version, n_regionkey AS subject, n_nationkey = m AS is_current FROM nation JOIN (SELECT n_regionkey, max(n_nationkey) AS m FROM nation GROUP BY n_regionkey) USING (n_regionkey)")
def promote_current(spark: SparkSession, d: str) -> DataFrame:
    """One version of each subject is current: the named one, here the latest; all others are demoted."""
    n = table(spark, d, "nation")
    named = n.groupBy("n_regionkey").agg(F.max("n_nationkey").alias("m"))
    return n.join(named, "n_regionkey").select(F.col("n_nationkey").alias("version"), F.col("n_regionkey").alias("subject"), (F.col("n_nationkey") == F.col("m")).alias("is_current"))


@query("""
SELECT coalesce(o.code, n.code) AS code, CASE WHEN n.code IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(o.topic_id, n.topic_id) AS topic_id, o.code IS NOT NULL AS kept_identity FROM
  (SELECT code, topic_id, 'old ' || code AS title FROM topics WHERE topic_id % 3 <> 0) o FULL JOIN (SELECT code, topic_id + 500 AS topic_id, 'new ' || code AS title FROM topics WHERE topic_id % 2 = 0) n ON o.code = n.code""")
def merge_topics(spark: SparkSession, d: str) -> DataFrame:
    """A retitled topic keeps its identity, as the code is the key."""
    t = topics(spark, d)
    old = t.where("topic_id % 3 <> 0").select("code", "topic_id", F.concat(F.lit("old "), "code").alias("title"))
    new = t.where("topic_id % 2 = 0").select("code", (F.col("topic_id") + 500).alias("topic_id"), F.concat(F.lit("new "), "code").alias("title"))
    return merged(old, new, ["code"], {"title": newer("title"), "topic_id": F.coalesce("o_topic_id", "n_topic_id"), "kept_identity": F.col("in_old")})


@query("""
SELECT 'component' AS grain, coalesce(o.p_brand, n.p_brand) AS key, coalesce(n.low, o.low) AS low, coalesce(n.high, o.high) AS high FROM
  (SELECT p_brand, min(p_size) AS low, max(p_size) AS high FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand) o FULL JOIN (SELECT p_brand, min(p_size) + 1 AS low, max(p_size) + 1 AS high FROM part WHERE p_partkey % 3 = 0 AND p_size > 40 GROUP BY p_brand) n USING (p_brand)
UNION ALL SELECT 'combination', coalesce(o.p_type, n.p_type), coalesce(n.low, o.low), coalesce(n.high, o.high) FROM
  (SELECT p_type, min(p_size) AS low, max(p_size) AS high FROM part WHERE p_partkey % 2 = 0 GROUP BY p_type) o FULL JOIN (SELECT p_type, min(p_size) + 1 AS low, max(p_size) + 1 AS high FROM part WHERE p_partkey % 3 = 0 AND p_size > 40 GROUP BY p_type) n USING (p_type)""")
def merge_thresholds(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")

    def grain(name: str, key: str) -> DataFrame:
        old = part.where("p_partkey % 2 = 0").groupBy(F.col(key).alias("key")).agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))
        new = part.where("p_partkey % 3 = 0 AND p_size > 40").groupBy(F.col(key).alias("key")).agg((F.min("p_size") + 1).alias("low"), (F.max("p_size") + 1).alias("high"))
        return merged(old, new, ["key"], {"low": newer("low"), "high": newer("high")}).withColumn("grain", F.lit(name))

    return grain("component", "p_brand").unionByName(grain("combination", "p_type"))


LEAF_STATUS = "CASE flag WHEN 'R' THEN 'needs_review' WHEN 'N' THEN 'extracted' ELSE 'approved' END"


def _leaf_status():
    return F.when(F.col("flag") == "R", "needs_review").when(F.col("flag") == "N", "extracted").otherwise("approved")


@query(f"""
SELECT label, price, marks, CASE WHEN decision IS NOT NULL AND status <> 'approved' THEN decision ELSE status END AS new_status, decision IS NOT NULL AND status <> 'approved' AS moved, decision IS NOT NULL AND status = 'approved' AS conflict
FROM (SELECT *, {LEAF_STATUS} AS status, CASE WHEN root % 7 = 0 THEN 'approved' WHEN root % 7 = 1 THEN 'rejected' END AS decision FROM leaves)""")
def decision_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = leaves(spark, d).select("root", "label", "price", "marks", _leaf_status().alias("status"))
    decisions = roots(spark, d).where("root % 7 IN (0, 1)").select("root", F.when(F.col("root") % 7 == 0, "approved").otherwise("rejected").alias("decision"))
    return M.cascade(rows, decisions).select("label", "price", "marks", "new_status", "moved", "conflict")


@query("SELECT question_id, topic_id, source FROM edges e WHERE NOT (NOT is_primary AND source = 'verifier' AND EXISTS (SELECT 1 FROM bank b WHERE b.question_id = e.question_id AND b.status = 'approved'))")
def approve_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """On approval the verifier's secondary tags go; editorial ones stay."""
    tags = edges(spark, d)
    gone = tags.where("NOT is_primary AND source = 'verifier'").join(bank(spark, d).where("status = 'approved'").select("question_id"), "question_id", "left_semi")
    return tags.join(gone.select("question_id", "topic_id", "source"), ["question_id", "topic_id", "source"], "left_anti").select("question_id", "topic_id", "source")


@query("""
WITH chosen AS (SELECT question_id, question_id % 7 + 10 AS topic_id FROM bank WHERE question_id % 11 = 0)
SELECT question_id, topic_id, source, confidence FROM edges e WHERE NOT (is_primary AND question_id IN (SELECT question_id FROM chosen)) AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.question_id = e.question_id AND c.topic_id = e.topic_id)
UNION ALL SELECT question_id, topic_id, 'human', 100 FROM chosen""")
def retag(spark: SparkSession, d: str) -> DataFrame:
    chosen = bank(spark, d).where("question_id % 11 = 0").select("question_id", (F.col("question_id") % 7 + 10).alias("topic_id"))
    return M.retagged(edges(spark, d), chosen).select("question_id", "topic_id", "source", "confidence")


@query("""
WITH target AS (SELECT question_id, confidence FROM bank WHERE paper = 'Brand#3'), chosen AS (SELECT question_id, (question_id + ordinal) % 10 AS topic_id FROM bank WHERE paper = 'Brand#3')
SELECT question_id, before_topic, topic_id AS after_topic, before_topic <> topic_id AS changed, 'needs_review' AS status FROM (SELECT question_id, topic_id AS before_topic FROM edges WHERE is_primary AND question_id IN (SELECT question_id FROM target)) JOIN chosen USING (question_id)""")
def retag_paper(spark: SparkSession, d: str) -> DataFrame:
    """A named paper's tags are all replaced, with their image before, and every row returns to review."""
    paper = bank(spark, d).where("paper = 'Brand#3'")
    before = edges(spark, d).where("is_primary").join(paper.select("question_id"), "question_id", "left_semi").select("question_id", F.col("topic_id").alias("before_topic"))
    after = paper.select("question_id", ((F.col("question_id") + F.col("ordinal")) % 10).alias("after_topic"))
    return before.join(after, "question_id").select("*", (F.col("before_topic") != F.col("after_topic")).alias("changed"), F.lit("needs_review").alias("status"))


@query("SELECT root, CASE WHEN count(*) FILTER (flag = 'R') > 0 THEN 'needs_review' ELSE 'extracted' END AS status FROM leaves GROUP BY root")
def undo_decision(spark: SparkSession, d: str) -> DataFrame:
    flags = leaves(spark, d).groupBy("root").agg(F.collect_set(F.when(F.col("flag") == "R", F.col("flag"))).alias("flags"))
    return flags.select("root", M.undone(F.col("flags")).alias("status"))


@query("SELECT question_id, CASE WHEN status IN ('extracted', 'needs_review') AND status <> 'needs_review' AND confidence >= 75 THEN 'approved' ELSE status END AS status FROM bank")
def bulk_approve(spark: SparkSession, d: str) -> DataFrame:
    """Undecided rows without flags (a flag shows as needs_review) whose primary tag reaches the floor."""
    tag = edges(spark, d).where("is_primary").select("question_id", F.col("confidence").alias("tag_confidence"))
    rows = bank(spark, d).join(tag, "question_id", "left")
    ready = (F.col("status") == "extracted") & (F.col("tag_confidence") >= 75)
    return rows.select("question_id", F.when(ready, "approved").otherwise(F.col("status")).alias("status"))


@query("""
WITH clean AS (SELECT root FROM leaves GROUP BY root HAVING count(*) FILTER (flag = 'R') = 0)
SELECT r.paper, count(*) AS approved, count(*) FILTER (50 + r.root % 50 < 75) AS below_floor, count(*) FILTER (b.question_id IS NULL) AS untagged
FROM roots r JOIN clean USING (root) LEFT JOIN bank b ON b.question_id = r.root WHERE r.state <> 'F' GROUP BY r.paper""")
def bulk_approve_tree(spark: SparkSession, d: str) -> DataFrame:
    """Whole subtrees without a flag are approved; low and missing tags are counted, not gated on."""
    has_parts = leaves(spark, d).select("root", "flag")
    clean = has_parts.select("root").distinct().join(has_parts.where("flag = 'R'"), "root", "left_anti")
    tags = bank(spark, d).select(F.col("question_id").alias("root"), F.lit(True).alias("tagged"))
    rows = roots(spark, d).where("state <> 'F'").join(clean, "root", "left_semi").join(tags, "root", "left")
    return rows.groupBy("paper").agg(F.count(F.lit(1)).alias("approved"), F.count_if(50 + F.col("root") % 50 < 75).alias("below_floor"), F.count_if(F.col("tagged").isNull()).alias("untagged"))


@query("""
WITH given AS (SELECT question_id * 2 AS question_id, ordinal - 3 AS marks FROM bank), own AS (SELECT question_id, CASE WHEN question_id % 4 = 0 THEN ordinal END AS marks FROM bank)
SELECT o.question_id, coalesce(o.marks, CASE WHEN g.marks > 0 THEN g.marks END) AS marks, 'known' AS state FROM own o LEFT JOIN given g USING (question_id)
UNION ALL SELECT g.question_id, g.marks, CASE WHEN g.marks > 0 THEN 'unknown' ELSE 'invalid' END FROM given g WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.question_id = g.question_id) OR g.marks <= 0""")
def apply_marks(spark: SparkSession, d: str) -> DataFrame:
    """Given marks fill only what is still null, if positive; unknown ids and invalid marks are reported."""
    q = bank(spark, d)
    own = q.select("question_id", F.when(F.col("question_id") % 4 == 0, F.col("ordinal")).alias("marks"))
    given = q.select((F.col("question_id") * 2).alias("question_id"), (F.col("ordinal") - 3).alias("given"))
    filled = own.join(given.where("given > 0"), "question_id", "left").select("question_id", F.coalesce("marks", "given").alias("marks"), F.lit("known").alias("state"))
    state = F.when(F.col("given") > 0, "unknown").otherwise("invalid")
    wrong = given.where("given <= 0").unionByName(given.where("given > 0").join(own, "question_id", "left_anti"))
    return filled.unionByName(wrong.select("question_id", F.col("given").alias("marks"), state.alias("state")))


@query("SELECT question_id, topic_id, CASE WHEN NOT is_primary AND abs(confidence / 100.0 - 0.6) < 0.001 THEN 'verifier' ELSE source END AS source FROM edges")
def relabel_source(spark: SparkSession, d: str) -> DataFrame:
    tags = edges(spark, d)
    found = ~F.col("is_primary") & (F.abs((F.col("confidence") / 100).cast("float").cast("double") - 0.6) < 0.001)
    return tags.select("question_id", "topic_id", F.when(found, "verifier").otherwise(F.col("source")).alias("source"))


@query("""
SELECT c_custkey AS user_id, c_mktsegment AS plan FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT DISTINCT o_custkey, 'free' FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 = 0)""")
def default_rows(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("plan"))
    return M.defaults_inserted(own, table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")), "user_id", plan=F.lit("free"))


@query(f"WITH {SNAPSHOTS} " + """
SELECT key, array_to_string(list_sort(list_distinct(list_filter(flags, lambda f: f <> 'unmatched_mark_scheme') || ['verifier_disagreed'])), ',') AS flags FROM old""")
def flag_updates(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array_union(F.array_remove("flags", "unmatched_mark_scheme"), F.array(F.lit("verifier_disagreed")))
    return _old(spark, d).select("key", F.array_join(F.array_sort(flags), ",").alias("flags"))
