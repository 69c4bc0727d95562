"""Queries of duplicate folding, matching, reading of grids, and reconciliation of sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import bracket_marks, normalise
from quillstone.operators import curation as U
from quillstone.operators.catalogue import canonical_ids
from quillstone.operators.common import joined
from quillstone.plans.registry import query
from quillstone.plans.roles import bank, docs, leaves, lines, roots, table
from quillstone.plans.strings import NORM

SITTINGS = "2000 + doc_id % 25 AS year, source AS paper, doc_id % 40 AS ordinal"
DUPES = f"""
normed AS (SELECT doc_id, lang, n_chars, {SITTINGS}, {NORM.format('text')} AS norm FROM documents),
keyed AS (SELECT *, CASE WHEN length(norm) < 60 THEN 'solo:' || doc_id ELSE norm || chr(1) || lang END AS key FROM normed),
grouped AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY key ORDER BY year DESC, paper DESC, ordinal DESC, doc_id DESC) AS canonical_id FROM keyed)"""


def _sittings(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions of a sitting: year, paper and ordinal say which of a group is the newest."""
    k = F.col("doc_id")
    return docs(spark, d).select("doc_id", "text", "lang", "n_chars", (2000 + k % 25).alias("year"), F.col("source").alias("paper"), (k % 40).alias("ordinal"))


def _duplicates(rows: DataFrame) -> DataFrame:
    return U.duplicates(rows, id_col="doc_id", text_col="text", answer_col="lang", newest=["year", "paper", "ordinal"])


@query(f"WITH {DUPES} SELECT doc_id, canonical_id FROM grouped")
def dedupe_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups as membership: each document and the one that stands for its group."""
    return _duplicates(_sittings(spark, d))


@query(f"WITH {DUPES} SELECT doc_id, CASE WHEN doc_id <> canonical_id THEN canonical_id END AS canonical_id FROM grouped")
def dedupe_apply(spark: SparkSession, d: str) -> DataFrame:
    rows = _sittings(spark, d)
    return U.pointers(rows, _duplicates(rows), "doc_id")


@query(f"WITH {DUPES.replace('FROM documents', 'FROM documents WHERE n_chars BETWEEN 500 AND 5000')} SELECT canonical_id, count(*) AS n FROM grouped GROUP BY canonical_id")
def scope_then_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The scope is cut first, so that a group's head is always in scope."""
    scoped = _sittings(spark, d).where("n_chars BETWEEN 500 AND 5000")
    return _duplicates(scoped).groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH groups AS (SELECT question_id, max(question_id) OVER (PARTITION BY body, kind, answer) AS canonical_id FROM bank) SELECT g.question_id, sha256(b.body || b.question_id) AS value FROM groups g JOIN bank b ON b.question_id = g.canonical_id")
def fanout_canonical(spark: SparkSession, d: str) -> DataFrame:
    """A value worked out once for each group's canonical row, and given to all members."""
    q = bank(spark, d)
    groups = canonical_ids(q)
    heads = q.join(groups.where("question_id = canonical_id").select("question_id"), "question_id", "left_semi")
    made = heads.select(F.col("question_id").alias("canonical_id"), F.sha2(F.concat("body", F.col("question_id").cast("string")), 256).alias("value"))
    return groups.join(made, "canonical_id").select("question_id", "value")


@query("""
WITH groups AS (SELECT question_id, max(question_id) OVER (PARTITION BY body, kind, answer) AS canonical_id FROM bank), options AS (SELECT question_id, count(*) AS n FROM edges GROUP BY question_id)
SELECT g.question_id, coalesce(CASE WHEN b.question_id % 3 = 0 THEN b.body END, CASE WHEN o.n >= 2 THEN c.body || ' *' END) AS text
FROM groups g JOIN bank b USING (question_id) JOIN bank c ON c.question_id = g.canonical_id LEFT JOIN options o ON o.question_id = g.canonical_id""")
def copy_from_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Empty texts are filled from the canonical row, if it has two options or more; a text that is there stays."""
    from quillstone.plans.roles import edges

    q, groups = bank(spark, d), canonical_ids(bank(spark, d))
    rich = edges(spark, d).groupBy("question_id").count().where("count >= 2").select(F.col("question_id").alias("canonical_id"))
    source = q.select(F.col("question_id").alias("canonical_id"), F.concat("body", F.lit(" *")).alias("given")).join(rich, "canonical_id", "left_semi")
    own = q.select("question_id", F.when(F.col("question_id") % 3 == 0, F.col("body")).alias("own"))
    return groups.join(own, "question_id").join(source, "canonical_id", "left").select("question_id", F.coalesce("own", "given").alias("text"))


ENTRIES = """
q AS (SELECT root % 100 AS doc, root || '(' || n || ')' AS label, part * 10 + n AS question_id FROM leaves WHERE part % 2 = 0),
e AS (SELECT root % 100 AS doc, root || '(' || n || ')' AS label, supp * 1000000 + root AS entry_id FROM leaves WHERE part % 3 = 0),
q1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc, label) AS c FROM q) WHERE c = 1), e1 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc, label) AS c FROM e) WHERE c = 1),
m AS (SELECT doc, label, question_id, entry_id FROM q1 JOIN e1 USING (doc, label))"""


@query(f"WITH {ENTRIES} " + """
SELECT doc, label, question_id, entry_id, 'matched' AS outcome FROM m
UNION ALL SELECT doc, label, question_id, NULL, 'question_left' FROM q WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc = q.doc AND m.question_id = q.question_id)
UNION ALL SELECT doc, label, NULL, entry_id, 'entry_left' FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc = e.doc AND m.entry_id = e.entry_id)""")
def match_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = leaves(spark, d).withColumn("doc", F.col("root") % 100)
    q = rows.where("part % 2 = 0").select("doc", "label", (F.col("part") * 10 + F.col("n")).alias("question_id"))
    e = rows.where("part % 3 = 0").select("doc", "label", (F.col("supp") * 1000000 + F.col("root")).alias("entry_id"))
    return U.matched(q, e)


@query("SELECT b.question_id, g.answer, g.question_id IS NULL AS unmatched FROM bank b LEFT JOIN (SELECT question_id * 2 AS question_id, answer FROM bank WHERE question_id % 5 <> 0) g USING (question_id)")
def match_answers(spark: SparkSession, d: str) -> DataFrame:
    q = bank(spark, d)
    grid = q.where("question_id % 5 <> 0").select((F.col("question_id") * 2).alias("question_id"), "answer", F.lit(False).alias("no"))
    return q.select("question_id").join(grid, "question_id", "left").select("question_id", "answer", F.coalesce("no", F.lit(True)).alias("unmatched"))


@query("""
SELECT a.question_id, array_to_string(list_filter([CASE WHEN a.year <> b.year THEN 'year' END, CASE WHEN a.kind <> b.kind THEN 'kind' END, CASE WHEN a.answer <> b.answer THEN 'answer' END, CASE WHEN a.subject_id <> b.subject_id THEN 'subject' END, CASE WHEN a.paper <> b.paper THEN 'paper' END], lambda x: x IS NOT NULL), ',') AS differs
FROM bank a JOIN bank b ON b.question_id = a.question_id + 1 WHERE a.question_id % 2 = 0""")
def pair_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """In which of five attributes two documents that belong together disagree."""
    names = {"year": "year", "kind": "kind", "answer": "answer", "subject": "subject_id", "paper": "paper"}
    a = bank(spark, d).where("question_id % 2 = 0").select("question_id", *(F.col(c).alias(f"a_{c}") for c in names.values()))
    b = bank(spark, d).select((F.col("question_id") - 1).alias("question_id"), *(F.col(c).alias(f"b_{c}") for c in names.values()))
    differs = F.filter(F.array(*(F.when(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(n)) for n, c in names.items())), lambda x: x.isNotNull())
    return a.join(b, "question_id").select("question_id", F.array_join(differs, ",").alias("differs"))


SYNC = """
approved AS (SELECT doc_id AS key FROM labels WHERE quality = 1), private AS (SELECT doc_id AS key, n_chars AS etag FROM documents),
public AS (SELECT doc_id AS key, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS etag FROM documents WHERE doc_id % 4 <> 0)"""


@query(f"WITH {SYNC} " + """
SELECT key, CASE WHEN a.key IS NULL THEN 'remove' WHEN p.key IS NULL THEN 'missing_source' WHEN u.key IS NOT NULL AND u.etag = p.etag THEN 'unchanged' ELSE 'copy' END AS action
FROM approved a FULL JOIN public u USING (key) LEFT JOIN private p USING (key)""")
def sync_plan(spark: SparkSession, d: str) -> DataFrame:
    """What to copy, remove or leave between a private and a public store; an unknown etag counts as changed."""
    want = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("key"), F.lit(True).alias("wanted"))
    private = docs(spark, d).select(F.col("doc_id").alias("key"), F.col("n_chars").alias("have"), F.lit(True).alias("source"))
    etag = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    public = docs(spark, d).where("doc_id % 4 <> 0").select(F.col("doc_id").alias("key"), etag.alias("shown"), F.lit(True).alias("public"))
    both = want.join(public, "key", "full_outer").join(private, "key", "left")
    action = F.when(F.col("wanted").isNull(), "remove").when(F.col("source").isNull(), "missing_source").when(F.col("public") & (F.col("shown") == F.col("have")), "unchanged").otherwise("copy")
    return both.select("key", action.alias("action"))


@query(f"WITH {SYNC} SELECT regexp_replace('crops/' || (key % 10) || '/' || key || '.png', '/[^/]*$', '') AS folder, count(*) AS missing FROM approved WHERE key NOT IN (SELECT key FROM public) GROUP BY 1")
def missing_assets(spark: SparkSession, d: str) -> DataFrame:
    """Recorded keys that are not in the store's listing, by folder."""
    path = F.concat(F.lit("crops/"), F.col("doc_id") % 10, F.lit("/"), "doc_id", F.lit(".png"))
    recorded = table(spark, d, "labels").where("quality = 1").select("doc_id", path.alias("path"))
    listed = docs(spark, d).where("doc_id % 4 <> 0").select("doc_id")
    return recorded.join(listed, "doc_id", "left_anti").groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("missing"))


@query("SELECT root, trim(string_agg(flag || marks, ' ' ORDER BY n, flag || marks)) AS text FROM leaves WHERE flag <> '' GROUP BY root")
def subtree_text(spark: SparkSession, d: str) -> DataFrame:
    return leaves(spark, d).where("flag <> ''").groupBy("root").agg(F.trim(joined(["n"], F.concat("flag", "marks"), " ")).alias("text"))


@query("""
SELECT root, count(*) AS leaves, string_agg(label, ',' ORDER BY n, label) AS labels FROM leaves WHERE flag = 'A' AND marks % 10 = 0 GROUP BY root""")
def marks_worksheet(spark: SparkSession, d: str) -> DataFrame:
    """Leaves with a scheme (A) but no marks, under their question."""
    return leaves(spark, d).where("flag = 'A' AND marks % 10 = 0").groupBy("root").agg(F.count(F.lit(1)).alias("leaves"), joined(["n"], F.col("label"), ",").alias("labels"))


@query("""
WITH sums AS (SELECT root, sum(marks)::BIGINT AS total, sum(CASE WHEN n % 2 = 0 THEN marks ELSE marks + 1 END)::BIGINT AS bracketed FROM leaves GROUP BY root)
SELECT root, total, printed, CASE WHEN total = printed THEN 'agrees' WHEN bracketed = printed THEN 'corrected' ELSE 'review' END AS outcome FROM (SELECT s.*, total + root % 3 AS printed FROM sums s)""")
def marks_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """A question's printed total against its leaves' marks; the brackets' marks are proposed only if they add up to it."""
    text = F.concat(F.lit("x ["), F.when(F.col("n") % 2 == 0, F.col("marks")).otherwise(F.col("marks") + 1), F.lit("]"))
    sums = leaves(spark, d).groupBy("root").agg(F.sum("marks").alias("total"), F.sum(bracket_marks(text)).alias("bracketed")).withColumn("printed", F.col("total") + F.col("root") % 3)
    outcome = F.when(F.col("total") == F.col("printed"), "agrees").when(F.col("bracketed") == F.col("printed"), "corrected").otherwise("review")
    return sums.select("root", "total", "printed", outcome.alias("outcome"))


@query("SELECT doc_id, line_no FROM lines WHERE length(line) < 40")
def sparse_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).where(F.length("line") < 40).select("doc_id", "line_no")


@query(f"WITH normed AS (SELECT doc_id, source, {NORM.format('text')} AS norm FROM documents) SELECT max(doc_id) AS canonical_id, count(DISTINCT source) AS sources FROM normed WHERE length(norm) >= 60 GROUP BY norm HAVING count(DISTINCT source) > 1")
def inconsistent_tags(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the same text whose members carry different primary tags (here, sources)."""
    rows = docs(spark, d).select("doc_id", "source", normalise(F.col("text")).alias("norm")).where(F.length("norm") >= U.LEAST_CHARS)
    groups = rows.groupBy(F.sha2("norm", 256).alias("key")).agg(F.max("doc_id").alias("canonical_id"), F.size(F.collect_set("source")).cast("bigint").alias("sources"))
    return groups.where("sources > 1").drop("key")


@query("SELECT root FROM roots WHERE root NOT IN (SELECT root FROM leaves)")
def childless_roots(spark: SparkSession, d: str) -> DataFrame:
    return roots(spark, d).join(leaves(spark, d), "root", "left_anti").select("root")
