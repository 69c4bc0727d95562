"""Queries of the catalogue views, joins, aggregates and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import catalogue as C
from quillstone.operators.common import joined, latest_by
from quillstone.plans.registry import query
from quillstone.plans.roles import attempts, bank, docs, edges, leaves, roots, spans, table, topics
from quillstone.sources.files import stored

GROUPS = "groups AS (SELECT question_id, max(question_id) OVER (PARTITION BY body, kind, answer) AS canonical_id FROM bank)"
CODES = "codes AS (SELECT question_id, string_agg(code, ',' ORDER BY is_primary DESC, code) AS topic_codes FROM edges JOIN topics USING (topic_id) GROUP BY question_id)"
ALSO = """also AS (
  SELECT canonical_id, question_id, year, paper, others FROM groups JOIN (SELECT canonical_id, count(*) - 1 AS others FROM groups GROUP BY canonical_id) USING (canonical_id) JOIN bank USING (question_id) WHERE others > 0)"""


@query("SELECT r_name AS level, n_name AS subject, n_nationkey AS subject_id, coalesce(nullif(n_name, 'NATION_0'), 'none') AS description FROM nation JOIN region ON n_regionkey = r_regionkey")
def v_subjects(spark: SparkSession, d: str) -> DataFrame:
    subjects, levels = table(spark, d, "nation"), table(spark, d, "region")
    return subjects.join(levels, subjects["n_regionkey"] == levels["r_regionkey"]).select(
        F.col("r_name").alias("level"), F.col("n_name").alias("subject"), F.col("n_nationkey").alias("subject_id"), F.coalesce(F.nullif("n_name", F.lit("NATION_0")), F.lit("none")).alias("description")
    )


TOPIC_COUNTS = f"""{GROUPS},
topic_counts AS (SELECT topic_id, count(*) AS n FROM edges JOIN groups USING (question_id) JOIN bank USING (question_id) WHERE status = 'approved' AND question_id = canonical_id GROUP BY topic_id)"""


def _topic_counts(spark: SparkSession, d: str) -> DataFrame:
    q = bank(spark, d)
    listed = C.published(q).join(C.canonical_ids(q).where("question_id = canonical_id").select("question_id"), "question_id", "left_semi").select("question_id")
    return edges(spark, d).join(listed, "question_id", "left_semi").groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))


LEAF_MARKS = "leaf_marks AS (SELECT root, sum(marks)::BIGINT AS leaf_sum FROM leaves GROUP BY root)"


def _question_marks(spark: SparkSession, d: str) -> DataFrame:
    """A structured question is worth its leaves' marks, else its own, else nothing; a multiple-choice one is worth 1."""
    sums = leaves(spark, d).groupBy("root").agg(F.sum("marks").alias("leaf_sum"))
    q = bank(spark, d).select("question_id", "kind", "ordinal", F.col("question_id").alias("root"))
    worth = F.when(F.col("kind") == "ECONOMY", F.lit(1)).otherwise(F.coalesce("leaf_sum", F.col("ordinal").cast("bigint"), F.lit(0)))
    return q.join(sums, "root", "left").select("question_id", worth.cast("bigint").alias("marks"))


@query(f"WITH {TOPIC_COUNTS}, {LEAF_MARKS}, worth AS (SELECT question_id, CASE WHEN kind = 'ECONOMY' THEN 1 ELSE coalesce(leaf_sum, ordinal, 0) END::BIGINT AS marks FROM bank LEFT JOIN leaf_marks ON root = question_id), " + """
topic_sums AS (SELECT topic_id, sum(marks)::BIGINT AS m FROM edges JOIN worth USING (question_id) GROUP BY topic_id)
SELECT topic_id, code, subject_id, coalesce(n, 0) AS question_count, coalesce(m, 0) AS total_marks FROM topics LEFT JOIN topic_counts USING (topic_id) LEFT JOIN topic_sums USING (topic_id)""")
def v_topics(spark: SparkSession, d: str) -> DataFrame:
    sums = edges(spark, d).join(_question_marks(spark, d), "question_id").groupBy("topic_id").agg(F.sum("marks").alias("m"))
    return topics(spark, d).join(_topic_counts(spark, d), "topic_id", "left").join(sums, "topic_id", "left").select("topic_id", "code", "subject_id", F.coalesce("n", F.lit(0)).alias("question_count"), F.coalesce("m", F.lit(0)).alias("total_marks"))


@query(f"WITH {LEAF_MARKS}" + """
SELECT topic_id, sum(CASE WHEN kind = 'ECONOMY' THEN 1 ELSE coalesce(leaf_sum, ordinal, 0) END)::BIGINT AS marks, min(ordinal) AS low, max(ordinal) AS high
FROM edges JOIN bank USING (question_id) LEFT JOIN leaf_marks ON root = question_id GROUP BY topic_id""")
def topic_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = edges(spark, d).join(_question_marks(spark, d), "question_id").join(bank(spark, d).select("question_id", "ordinal"), "question_id")
    return rows.groupBy("topic_id").agg(F.sum("marks").alias("marks"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"))


@query("""
SELECT topic_id, code, marks FROM (SELECT topic_id, sum(ordinal)::BIGINT AS marks FROM edges JOIN bank USING (question_id) GROUP BY topic_id) JOIN topics USING (topic_id)
WHERE n_objectives > 0 AND marks > 0 ORDER BY marks DESC, code LIMIT 5""")
def highest_value_topics(spark: SparkSession, d: str) -> DataFrame:
    sums = edges(spark, d).join(bank(spark, d).select("question_id", "ordinal"), "question_id").groupBy("topic_id").agg(F.sum("ordinal").alias("marks"))
    return topics(spark, d).where("n_objectives > 0").join(sums, "topic_id").where("marks > 0").orderBy(F.desc("marks"), "code").limit(5).select("topic_id", "code", "marks")


@query(f"WITH {CODES} SELECT question_id, topic_codes FROM codes")
def topic_codes(spark: SparkSession, d: str) -> DataFrame:
    return C.topic_codes(edges(spark, d), topics(spark, d))


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return roots(spark, d).groupBy("paper").agg(F.mode("priority", True).alias("paper_type"), F.count(F.lit(1)).alias("questions"), F.min(F.year("o_orderdate")).alias("year"))


MODE = """
types AS (
  SELECT paper, paper_type FROM (SELECT paper, priority AS paper_type, row_number() OVER (PARTITION BY paper ORDER BY count(*) DESC, priority) AS rn FROM roots GROUP BY paper, priority) WHERE rn = 1),
papers AS (SELECT paper, paper_type, questions, year FROM (SELECT paper, count(*) AS questions, min(year(o_orderdate))::INT AS year FROM roots GROUP BY paper) JOIN types USING (paper))"""


@query(f"WITH {MODE} SELECT paper, paper_type FROM papers")
def paper_type(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).select("paper", "paper_type")


@query(f"WITH {MODE} SELECT paper, year, CASE WHEN paper % 5 = 0 THEN 'stored' ELSE paper_type END AS paper_type, questions, coalesce(documents, '') AS documents FROM papers LEFT JOIN (SELECT root % 1500 AS paper, string_agg(DISTINCT flag, '|' ORDER BY flag) AS documents FROM leaves GROUP BY root % 1500) USING (paper)")
def v_papers(spark: SparkSession, d: str) -> DataFrame:
    """A stored type wins over the mode of the questions' types; documents are listed by type."""
    kinds = leaves(spark, d).groupBy((F.col("root") % 1500).alias("paper")).agg(F.array_join(F.array_sort(F.collect_set("flag")), "|").alias("documents"))
    stored = F.when(F.col("paper") % 5 == 0, F.lit("stored"))
    return _papers(spark, d).join(kinds, "paper", "left").select("paper", "year", F.coalesce(stored, "paper_type").alias("paper_type"), "questions", F.coalesce("documents", F.lit("")).alias("documents"))


@query(f"WITH {MODE} SELECT paper, paper_type, questions FROM papers WHERE paper_type IN ('1-URGENT', '5-LOW') AND questions > 0")
def playable_papers(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).where(F.col("paper_type").isin("1-URGENT", "5-LOW") & (F.col("questions") > 0)).select("paper", "paper_type", "questions")


@query(f"WITH {MODE} SELECT year, string_agg(paper, '|' ORDER BY paper) AS papers FROM papers GROUP BY year")
def papers_by_year(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d).groupBy("year").agg(joined(["paper"], F.col("paper")).alias("papers"))


@query("SELECT conv_id, string_agg(turn || '=' || role, '|' ORDER BY turn) AS options FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY conv_id, turn) GROUP BY conv_id")
def options_map(spark: SparkSession, d: str) -> DataFrame:
    """A map of option to content for each owner; flattened here for comparison."""
    rows = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    made = rows.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("options"))
    return made.select("conv_id", F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("options"))


#: Questions' assets and trees, read by both dialects: a part of a question has a sub-part for every fifth supplier.
_PART = "CAST(root AS STRING) AS root, CAST(root AS STRING) || '(' || n || ')' AS id, n, max(marks) AS marks, min(flag) AS flag, min(part) AS part, min(supp) AS supp"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Stored, as trees, assets and tags read them some ten times."""
    return stored(leaves(spark, d).groupBy("root", "n").agg(F.max("marks").alias("marks"), F.min("flag").alias("flag"), F.min("part").alias("part"), F.min("supp").alias("supp")).select(F.col("root").cast("string").alias("root"), F.concat("root", F.lit("("), "n", F.lit(")")).alias("id"), "n", "marks", "flag", "part", "supp"))


def _tree(spark: SparkSession, d: str, parts: DataFrame) -> DataFrame:
    top = roots(spark, d).selectExpr("CAST(root AS STRING) AS id", "CAST(NULL AS STRING) AS parent", "CAST(root AS STRING) AS root", "0 AS ordinal", "CAST(NULL AS INT) AS max_marks", "priority AS mark_scheme_text", "CAST(NULL AS STRING) AS review_flag")
    first = parts.selectExpr("id", "root AS parent", "root", "n * 10 AS ordinal", "marks AS max_marks", "flag || part AS mark_scheme_text", "nullif(flag, 'N') AS review_flag")
    below = parts.where("supp % 5 = 0").selectExpr("id || '(i)' AS id", "id AS parent", "root", "n * 10 + 1 AS ordinal", "marks + 1 AS max_marks", "CAST(supp AS STRING) AS mark_scheme_text", "nullif(flag, 'A') AS review_flag")
    return top.unionByName(first).unionByName(below)


def _assets(parts: DataFrame) -> DataFrame:
    """Crops of questions, of their parts' mark schemes, and of some questions' own; some boxes have no width."""
    box = ("10.0 AS x0", "20.0 AS y0", "CASE WHEN part % 7 = 0 THEN 10.0 ELSE 26.0 END AS x1", "21.0 + supp % 50 AS y1")
    one = lambda rows, owner, kind, order: rows.selectExpr(f"{owner} AS owner", f"'{kind}' AS kind", f"{order} AS sort_order", "supp % 4 AS page_number", "part || '-' || n AS storage_key", *box)
    made = one(parts, "root", "question_crop", "n % 3").unionByName(one(parts.where("part % 2 = 0"), "id", "mark_scheme_crop", "1")).unionByName(one(parts.where("part % 4 = 0"), "id", "mark_scheme_crop", "0"))
    return made.unionByName(one(parts.where("n = 1 AND part % 3 = 0"), "root", "mark_scheme_crop", "0"))


def _crop_text(name: str):
    """Crops flattened for the comparison alone."""
    shown = lambda c: F.concat_ws(":", c["page_number"], c["storage_key"], F.coalesce(c["aspect_ratio"].cast("decimal(12,4)").cast("string"), F.lit("-")))
    return F.array_join(F.transform(name, shown), ";")


def _part_text(part):
    crops = F.transform(part["mark_scheme_crops"], lambda c: F.concat_ws(":", c["page_number"], c["storage_key"], F.coalesce(c["aspect_ratio"].cast("decimal(12,4)").cast("string"), F.lit("-"))))
    return F.concat_ws("/", part["display_label"], part["max_marks"], part["mark_scheme_text"], F.coalesce(part["review_flag"], F.lit("-")), F.array_join(crops, ";"))


NESTED = f"""
parts_ AS (SELECT {_PART} FROM leaves GROUP BY root, n),
tree AS (
  SELECT root::VARCHAR AS id, NULL::VARCHAR AS parent, root::VARCHAR AS root, 0 AS ordinal, NULL::INT AS max_marks, priority AS mark_scheme_text, NULL::VARCHAR AS review_flag FROM roots
  UNION ALL SELECT id, root, root, n * 10, marks, flag || part, nullif(flag, 'N') FROM parts_ UNION ALL SELECT id || '(i)', id, root, n * 10 + 1, marks + 1, supp::VARCHAR, nullif(flag, 'A') FROM parts_ WHERE supp % 5 = 0),
assets AS (
  SELECT owner, kind, sort_order, supp % 4 AS page_number, part || '-' || n AS storage_key, coalesce(round((1.0 + supp % 50) / CASE WHEN part % 7 <> 0 THEN 16.0 END, 4)::DECIMAL(12, 4)::VARCHAR, '-') AS ratio
  FROM (SELECT *, root AS owner, 'question_crop' AS kind, n % 3 AS sort_order FROM parts_ UNION ALL SELECT *, id, 'mark_scheme_crop', 1 FROM parts_ WHERE part % 2 = 0
    UNION ALL SELECT *, id, 'mark_scheme_crop', 0 FROM parts_ WHERE part % 4 = 0 UNION ALL SELECT *, root, 'mark_scheme_crop', 0 FROM parts_ WHERE n = 1 AND part % 3 = 0)),
crop_texts AS (SELECT owner, kind, string_agg(page_number || ':' || storage_key || ':' || ratio, ';' ORDER BY sort_order, page_number, storage_key) AS crops FROM assets GROUP BY owner, kind),
leaf_texts AS (
  SELECT t.root, string_agg(id || '/' || max_marks || '/' || mark_scheme_text || '/' || coalesce(review_flag, '-') || '/' || coalesce(crops, ''), '|' ORDER BY ordinal, id) AS parts, string_agg(DISTINCT review_flag, ',' ORDER BY review_flag) AS flags
  FROM tree t LEFT JOIN crop_texts c ON c.owner = t.id AND c.kind = 'mark_scheme_crop' WHERE parent IS NOT NULL AND id NOT IN (SELECT parent FROM tree WHERE parent IS NOT NULL) GROUP BY t.root),
nested AS (
  SELECT t.id, t.mark_scheme_text, coalesce(q.crops, '') AS crops, coalesce(l.parts, '') AS parts, coalesce(m.crops, '') AS mark_scheme_crops, coalesce(l.flags, '') AS flags
  FROM tree t LEFT JOIN crop_texts q ON q.owner = t.id AND q.kind = 'question_crop' LEFT JOIN crop_texts m ON m.owner = t.id AND m.kind = 'mark_scheme_crop' LEFT JOIN leaf_texts l ON l.root = t.id WHERE t.parent IS NULL)"""


@query(
    f"WITH {GROUPS}, {CODES}, {ALSO}, {NESTED}"
    """, options AS (SELECT question_id, string_agg(option || '=' || option || body, '|' ORDER BY option) AS options FROM (SELECT question_id, body, unnest(['A', 'B', 'C', 'D']) AS option, unnest([0, 1, 2, 3]) AS k FROM bank WHERE question_id % 9 <> 0) WHERE (question_id + k) % 5 <> 0 GROUP BY question_id),
first AS (SELECT owner, arg_min({'k': storage_key, 'r': ratio}, (sort_order, page_number, storage_key)) AS crop FROM assets WHERE kind = 'question_crop' GROUP BY owner)
SELECT question_id, bank.paper, ordinal, answer, coalesce(options, '') AS options, crop.k AS crop_storage_key, nullif(crop.r, '-') AS crop_aspect_ratio, topic_codes, canonical_id, coalesce(others, 0) AS others
FROM bank LEFT JOIN codes USING (question_id) LEFT JOIN (SELECT question_id, canonical_id, others FROM also) a USING (question_id) LEFT JOIN options USING (question_id) LEFT JOIN first ON owner = question_id::VARCHAR
WHERE status = 'approved' AND answer <> 0"""
)
def v_mcq(spark: SparkSession, d: str) -> DataFrame:
    """Questions with a key (here, an answer but 0), their options, first crop and topics, and the duplicate group whose sittings ``also_in`` lists."""
    q = bank(spark, d)
    letters = F.explode(F.array(*(F.struct(F.lit(c).alias("option"), F.lit(k).alias("k")) for k, c in enumerate("ABCD"))))
    options = q.where("question_id % 9 <> 0").select("question_id", "body", letters.alias("o")).where("(question_id + o.k) % 5 <> 0").select("question_id", "o.option", F.concat("o.option", "body").alias("content"))
    rows = C.published(q).select("question_id", "paper", "ordinal", "answer", F.nullif("answer", F.lit(0)).alias("correct_option"))
    assets = _assets(_parts(spark, d)).withColumn("owner", F.expr("try_cast(owner AS BIGINT)"))
    view = C.mcq_view(rows, options, assets).drop("correct_option")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    view = view.withColumn("options", shown).withColumn("crop_aspect_ratio", F.col("crop_aspect_ratio").cast("decimal(12,4)").cast("string"))
    return view.join(C.topic_codes(edges(spark, d), topics(spark, d)), "question_id", "left").join(C.also_in(C.canonical_ids(q), q).select("question_id", "canonical_id", "others"), "question_id", "left").withColumn("others", F.coalesce("others", F.lit(0)))


@query(f"WITH {GROUPS}, {ALSO} SELECT canonical_id, question_id, year, paper, others FROM also")
def also_in(spark: SparkSession, d: str) -> DataFrame:
    q = bank(spark, d)
    return C.also_in(C.canonical_ids(q), q)


@query("SELECT question_id, paper, ordinal FROM bank WHERE status = 'approved' AND question_id % 4 = 1")
def publish_gate(spark: SparkSession, d: str) -> DataFrame:
    """Approved questions of published subjects (here the subject 1), by a semi-join on the subjects."""
    subjects = table(spark, d, "nation").where("n_nationkey = 1").select(F.col("n_nationkey").cast("bigint").alias("subject_id"))
    return C.published(bank(spark, d)).join(subjects, "subject_id", "left_semi").select("question_id", "paper", "ordinal")


@query(f"WITH {GROUPS} SELECT question_id, paper FROM bank JOIN groups USING (question_id) WHERE status = 'approved' AND question_id = canonical_id AND question_id IN (SELECT question_id FROM edges WHERE topic_id = 4)")
def questions_by_topic(spark: SparkSession, d: str) -> DataFrame:
    """Chosen by the tags first, decorated afterwards; duplicates are folded for browsing."""
    q = bank(spark, d)
    tagged = edges(spark, d).where("topic_id = 4").select("question_id")
    return C.published(q).join(tagged, "question_id", "left_semi").join(C.canonical_ids(q).where("question_id = canonical_id"), "question_id", "left_semi").select("question_id", "paper")


@query(f"WITH {CODES} SELECT question_id, topic_codes FROM bank JOIN codes USING (question_id) WHERE status = 'approved' AND question_id IN (SELECT question_id FROM edges WHERE topic_id IN (3, 12))")
def questions_by_topics(spark: SparkSession, d: str) -> DataFrame:
    tags = edges(spark, d)
    chosen = tags.where(F.col("topic_id").isin(3, 12)).select("question_id").distinct()
    ids = C.published(bank(spark, d)).select("question_id").join(chosen, "question_id", "left_semi")
    return ids.join(C.topic_codes(tags.join(chosen, "question_id", "left_semi"), topics(spark, d)), "question_id")


@query("SELECT paper, question_id, ordinal FROM bank WHERE status = 'approved'")
def paper_questions(spark: SparkSession, d: str) -> DataFrame:
    """A paper's own listing keeps duplicates."""
    return C.published(bank(spark, d)).select("paper", "question_id", "ordinal")


@query("""
WITH q AS (SELECT question_id, nullif(question_id % 4, 0) AS variant, ordinal FROM bank), r AS (SELECT variant, ordinal, count(*) AS papers FROM q GROUP BY variant, ordinal)
SELECT question_id, papers FROM q JOIN r ON q.ordinal = r.ordinal AND q.variant IS NOT DISTINCT FROM r.variant""")
def paper_lookup(spark: SparkSession, d: str) -> DataFrame:
    """How many papers have a question's number and variant, where a missing variant matches a missing one."""
    q = bank(spark, d).select("question_id", F.nullif(F.col("question_id") % 4, F.lit(0)).alias("variant"), "ordinal")
    r = q.groupBy(F.col("variant").alias("r_variant"), F.col("ordinal").alias("r_ordinal")).agg(F.count(F.lit(1)).alias("papers"))
    return q.join(r, (F.col("ordinal") == F.col("r_ordinal")) & F.col("variant").eqNullSafe(F.col("r_variant"))).select("question_id", "papers")


@query("SELECT DISTINCT question_id, paper, kind FROM bank WHERE question_id IN (SELECT question_id FROM attempts)")
def question_meta(spark: SparkSession, d: str) -> DataFrame:
    asked = attempts(spark, d).where(F.col("question_id").cast("string").rlike(r"^\d+$")).select("question_id").distinct()
    return bank(spark, d).join(asked, "question_id", "left_semi").select("question_id", "paper", "kind")


@query("SELECT question_id, topic_id AS tagged_topic, false AS all_rows FROM bank JOIN edges USING (question_id) WHERE NOT is_primary UNION ALL SELECT question_id, topic_id, true FROM bank LEFT JOIN (SELECT * FROM edges WHERE NOT is_primary) USING (question_id)")
def tagged_or_all(spark: SparkSession, d: str) -> DataFrame:
    q, tags = bank(spark, d).select("question_id"), edges(spark, d).where("NOT is_primary").select("question_id", F.col("topic_id").alias("tagged_topic"))
    load = lambda tagged_only: q.join(tags, "question_id", "inner" if tagged_only else "left").withColumn("all_rows", F.lit(not tagged_only))
    return load(True).unionByName(load(False))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND length(text) > 0")
def untagged(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where(F.length("text") > 0).join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT root, label, n, marks FROM leaves UNION ALL SELECT root, root::VARCHAR, 0, 0 FROM roots r WHERE NOT EXISTS (SELECT 1 FROM leaves l WHERE l.root = r.root)")
def leaf_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.leaf_rows(roots(spark, d), leaves(spark, d))


@query(f"WITH {NESTED} SELECT id, parts FROM nested")
def question_parts(spark: SparkSession, d: str) -> DataFrame:
    """The leaves nested under their question, each with its crops; a question without parts has an empty list, not null."""
    parts = _parts(spark, d)
    view = C.structured_view(_tree(spark, d, parts), _assets(parts))
    return view.select("id", F.array_join(F.transform("parts", _part_text), "|").alias("parts"))


@query(f"WITH {NESTED} SELECT id, mark_scheme_text, crops, parts, mark_scheme_crops FROM nested WHERE id IN (SELECT root::VARCHAR FROM roots WHERE state <> 'P')")
def v_structured(spark: SparkSession, d: str) -> DataFrame:
    """Structured questions with crops, parts with their crops, and mark-scheme crops, all nested; flattened for the comparison."""
    open_ = roots(spark, d).where("state <> 'P'").select(F.col("root").cast("string").alias("id"))
    parts = _parts(spark, d)
    view = C.structured_view(_tree(spark, d, parts), _assets(parts)).join(open_, "id", "left_semi")
    return view.select("id", "mark_scheme_text", _crop_text("crops").alias("crops"), F.array_join(F.transform("parts", _part_text), "|").alias("parts"), _crop_text("mark_scheme_crops").alias("mark_scheme_crops"))


@query("SELECT part AS owner, arg_min(supp, n * 1000000 + supp) AS asset FROM leaves GROUP BY part")
def first_asset(spark: SparkSession, d: str) -> DataFrame:
    return C.first_asset(leaves(spark, d).select(F.col("part").alias("owner"), F.col("n").alias("sort_order"), F.lit(1).alias("page"), F.col("supp").alias("asset")))


@query("SELECT root, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM leaves GROUP BY root")
def subtree_flags(spark: SparkSession, d: str) -> DataFrame:
    """The distinct flags of a whole subtree, from array columns as the views keep them."""
    rows = leaves(spark, d).select("root", F.array("flag").alias("flags"))
    return rows.groupBy("root").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))), ",").alias("flags"))


REVIEW = f"""{NESTED},
proposals AS (
  SELECT root, string_agg(code || ':T' || code || ':' || confidence, '|' ORDER BY confidence DESC, code) AS topics, max(confidence) AS confidence
  FROM (SELECT DISTINCT root, part % 10 AS topic_id, 50 + (supp * 7 + part) % 50 AS confidence FROM parts_ WHERE root::BIGINT % 6 <> 0) JOIN topics USING (topic_id) GROUP BY root),
review AS (
  SELECT n.id::BIGINT AS root, r.paper, list_contains(string_split(flags, ','), 'R') AS is_flagged, flags, parts, crops, coalesce(p.topics, '') AS proposed_topics, p.confidence
  FROM nested n JOIN roots r ON r.root::VARCHAR = n.id LEFT JOIN proposals p ON p.root = n.id WHERE r.state <> 'F')"""


def _review(spark: SparkSession, d: str) -> DataFrame:
    """One row for each undecided question; a flagged leaf (R) lifts the whole."""
    named = topics(spark, d).withColumn("title", F.concat(F.lit("T"), "code"))
    parts = _parts(spark, d)
    tags = parts.where("CAST(root AS BIGINT) % 6 <> 0").select(F.col("root").alias("question_id"), (F.col("part") % 10).alias("topic_id"), (50 + (F.col("supp") * 7 + F.col("part")) % 50).alias("confidence")).distinct()
    view = C.review_view(_tree(spark, d, parts), _assets(parts), C.proposed_topics(tags, named))
    undecided = roots(spark, d).where("state <> 'F'").select(F.col("root").cast("string").alias("id"), "root", "paper")
    return view.join(undecided, "id").withColumn("is_flagged", F.array_contains("flags", "R")).withColumn("confidence", F.col("primary_topic_confidence"))


@query(f"WITH {REVIEW} SELECT * FROM review")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """What awaits a decision, with nested crops, parts and proposed topics; flattened for the comparison."""
    shown = F.array_join(F.transform("proposed_topics", lambda t: F.concat_ws(":", t["code"], t["title"], t["confidence"])), "|")
    return _review(spark, d).select("root", "paper", "is_flagged", F.array_join("flags", ",").alias("flags"), F.array_join(F.transform("parts", _part_text), "|").alias("parts"), _crop_text("crops").alias("crops"), shown.alias("proposed_topics"), "confidence")


@query(f"WITH {REVIEW} SELECT root, is_flagged, confidence, (SELECT count(*) FROM review) AS total FROM review ORDER BY is_flagged DESC, confidence ASC NULLS FIRST, root LIMIT 200 OFFSET 200")
def review_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of two hundred, flagged and least certain first, with the exact total."""
    rows = stored(_review(spark, d).select("root", "is_flagged", "confidence"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc("is_flagged"), F.asc_nulls_first("confidence"), "root").offset(200).limit(200)
    return page.select("root", "is_flagged", "confidence", total.scalar().alias("total"))


@query("""
WITH primary_ AS (SELECT question_id, min(code || ':T' || code || ':' || confidence || ':' || source) AS topic FROM edges JOIN topics USING (topic_id) WHERE is_primary GROUP BY question_id)
SELECT root, state, decided, topic AS primary_topic FROM (SELECT root, state, CASE WHEN root % 11 = 0 THEN NULL ELSE o_orderdate END AS decided FROM roots WHERE state <> 'P') LEFT JOIN primary_ ON question_id = root ORDER BY decided DESC NULLS LAST, root LIMIT 300""")
def decided_log(spark: SparkSession, d: str) -> DataFrame:
    """The latest three hundred decisions with the primary topic as one struct, null where there is none."""
    decided = F.when(F.col("root") % 11 != 0, F.col("o_orderdate"))
    log = roots(spark, d).where("state <> 'P'").select("root", "state", decided.alias("decided")).orderBy(F.desc_nulls_last("decided"), "root").limit(300)
    tagged = C.primary_topics(edges(spark, d), topics(spark, d).withColumn("title", F.concat(F.lit("T"), "code"))).withColumnRenamed("question_id", "root")
    t = F.col("primary_topic")
    shown = F.when(t.isNotNull(), F.concat_ws(":", t["code"], t["title"], t["confidence"], t["source"]))
    return log.join(tagged, "root", "left").select("root", "state", "decided", shown.alias("primary_topic"))


@query("SELECT r.root, r.paper FROM roots r WHERE EXISTS (SELECT 1 FROM bank b WHERE b.question_id = r.root AND b.status = 'approved')")
def asset_is_public(spark: SparkSession, d: str) -> DataFrame:
    """An asset is public if its required parent is; a missing parent hides it."""
    parents = C.published(bank(spark, d)).select(F.col("question_id").alias("root"))
    return roots(spark, d).join(parents, "root", "left_semi").select("root", "paper")


@query("SELECT s.n_nationkey AS session, b.question_id, b.paper FROM nation s JOIN bank b ON b.year - 2000 = s.n_nationkey AND b.subject_id = s.n_nationkey % 4")
def session_fanout(spark: SparkSession, d: str) -> DataFrame:
    """A session's document stands for every paper of its subject and session."""
    sessions = table(spark, d, "nation").select(F.col("n_nationkey").alias("session"), (F.col("n_nationkey") + 2000).alias("year"), (F.col("n_nationkey") % 4).cast("bigint").alias("subject_id"))
    return bank(spark, d).join(sessions, ["year", "subject_id"]).select("session", "question_id", "paper")


BANDS = """bands AS (
  SELECT p_brand, p_type, low, coalesce(lag(low) OVER (PARTITION BY p_brand ORDER BY low DESC, p_type) - 1, 100) AS high, row_number() OVER (PARTITION BY p_brand ORDER BY low DESC, p_type) AS rank
  FROM (SELECT p_brand, p_type, max(p_size) AS low FROM part GROUP BY p_brand, p_type))"""


def _bands(spark: SparkSession, d: str) -> DataFrame:
    """Each band ends one below where the band above begins; the top one ends at the maximum."""
    lows = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").alias("low"))
    w = Window.partitionBy("p_brand").orderBy(F.desc("low"), "p_type")
    return lows.select("p_brand", "p_type", "low", F.coalesce(F.lag("low").over(w) - 1, F.lit(100)).alias("high"), F.row_number().over(w).alias("rank"))


@query(f"WITH {BANDS} SELECT p_brand, p_type, low, high, rank FROM bands")
def grade_bands(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d)


@query(f"WITH {BANDS} SELECT question_id, p_type AS grade FROM bank JOIN bands ON paper = p_brand AND confidence BETWEEN low AND high")
def grade_lookup(spark: SparkSession, d: str) -> DataFrame:
    b = _bands(spark, d)
    return bank(spark, d).join(b, (F.col("paper") == F.col("p_brand")) & F.col("confidence").between(F.col("low"), F.col("high"))).select("question_id", F.col("p_type").alias("grade"))


@query(f"WITH {TOPIC_COUNTS} " + """
SELECT 'subject' AS page, n_name AS key FROM nation UNION ALL SELECT 'paper', paper FROM (SELECT DISTINCT paper FROM bank WHERE status = 'approved')
UNION ALL SELECT 'topic', code FROM topics JOIN topic_counts USING (topic_id) WHERE n_objectives > 0 AND n > 0""")
def page_inventory(spark: SparkSession, d: str) -> DataFrame:
    subjects = table(spark, d, "nation").select(F.lit("subject").alias("page"), F.col("n_name").alias("key"))
    papers = C.published(bank(spark, d)).select(F.lit("paper").alias("page"), F.col("paper").alias("key")).distinct()
    listed = topics(spark, d).where("n_objectives > 0").join(_topic_counts(spark, d).where("n > 0"), "topic_id", "left_semi")
    return subjects.unionByName(papers).unionByName(listed.select(F.lit("topic").alias("page"), F.col("code").alias("key")))


LINKS = "links AS (SELECT DISTINCT topic_id AS old, CASE WHEN topic_id % 7 = 3 THEN NULL ELSE topic_id + 1000 END AS new FROM edges WHERE topic_id % 3 = 0 UNION ALL SELECT DISTINCT topic_id + 1000, topic_id + 2000 FROM edges WHERE topic_id % 6 = 0)"


@query(f"WITH {LINKS} " + """
SELECT question_id, coalesce(CASE WHEN b.old IS NOT NULL THEN b.new ELSE t1 END) AS topic_id FROM (
  SELECT question_id, CASE WHEN a.old IS NOT NULL THEN a.new ELSE e.topic_id END AS t1 FROM edges e LEFT JOIN links a ON e.topic_id = a.old WHERE is_primary) x LEFT JOIN links b ON x.t1 = b.old
WHERE CASE WHEN b.old IS NOT NULL THEN b.new ELSE t1 END IS NOT NULL""")
def topic_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """Old topics carried to the current version over at most two hops; withdrawn ones drop out."""
    tags = edges(spark, d)
    known = tags.select("topic_id").distinct()
    links = known.where("topic_id % 3 = 0").select(F.col("topic_id").alias("old"), F.when(F.col("topic_id") % 7 != 3, F.col("topic_id") + 1000).alias("new"))
    links = links.unionByName(known.where("topic_id % 6 = 0").select((F.col("topic_id") + 1000).alias("old"), (F.col("topic_id") + 2000).alias("new")))
    at = tags.where("is_primary").select("question_id", "topic_id")
    for _ in range(2):
        at = at.join(links, at["topic_id"] == links["old"], "left").select("question_id", F.when(F.col("old").isNotNull(), F.col("new")).otherwise(F.col("topic_id")).alias("topic_id"))
    return at.where("topic_id IS NOT NULL")


@query("SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM spans GROUP BY doc_id, page")
def region_union(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d).groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("SELECT root, label, marks FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY n DESC, part DESC, supp DESC, marks DESC, price DESC) AS rn FROM leaves) WHERE rn = 1")
def latest_part(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(leaves(spark, d), ["root"], *(F.desc(c) for c in ("n", "part", "supp", "marks", "price"))).select("root", "label", "marks")
