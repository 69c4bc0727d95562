import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import catalogue, common, curation, learner, merging, outline, retrieval, tagging


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- duplicates and matching


def test_duplicates_need_the_same_text_and_answer(spark):
    text = "A long enough question about the refraction of light in a block of glass, with numbers 12"
    columns = "id bigint, text string, answer string, year int, ordinal int"
    df = spark.createDataFrame([(20, "7 " + text, "A", 2019, 1), (11, text.upper(), "A", 2024, 1), (12, text, "D", 2020, 1), (1, "short", "A", 1, 1), (2, "short", "A", 1, 1), (3, None, "A", 1, 1), (4, text, None, 1, 9), (5, text, None, 1, 2), (6, text, None, None, None)], columns)
    names = {"id_col": "id", "text_col": "text", "answer_col": "answer", "newest": ["year", "ordinal"]}
    got = curation.duplicates(df, **names)
    assert rows(got) == [(1, 1), (11, 11), (12, 12), (2, 2), (20, 11), (3, 3), (4, 4), (5, 4), (6, 4)]
    assert rows(curation.pointers(df, got, "id").where("canonical_id IS NOT NULL")) == [(20, 11), (5, 4), (6, 4)]
    assert curation.duplicates(df.limit(0), **names).count() == 0


def test_canonical_ids_tell_null_from_empty(spark):
    df = spark.createDataFrame([(1, "a", "k", None), (2, "a", "k", None), (3, "a", "k", 1), (4, None, "k", 1), (5, "", "k", 1), (6, None, "k", 1)], "question_id bigint, body string, kind string, answer int")
    groups = catalogue.canonical_ids(df)
    assert rows(groups) == [(1, 2), (2, 2), (3, 3), (4, 6), (5, 5), (6, 6)]
    shown = catalogue.also_in(groups, df.withColumn("year", F.lit(2000)).withColumn("paper", F.lit("p")))
    assert rows(shown.select("canonical_id", "question_id", "others")) == [(2, 1, 1), (2, 2, 1), (6, 4, 1), (6, 6, 1)]


def test_two_claimants_of_a_label_both_go(spark):
    q = spark.createDataFrame([(1, "1(a)", 10), (1, "1(b)", 11), (1, "2", 12), (2, "1(a)", 13)], "doc int, label string, question_id bigint")
    e = spark.createDataFrame([(1, "1(a)", 20), (1, "1(b)", 21), (1, "1(b)", 22), (2, "9", 23)], "doc int, label string, entry_id bigint")
    got = curation.matched(q, e)
    assert rows(got.where("outcome = 'matched'").select("question_id", "entry_id")) == [(10, 20)]
    assert rows(got.where("outcome = 'entry_left'").select("entry_id")) == [(21,), (22,), (23,)]
    assert rows(got.where("outcome = 'question_left'").select("question_id")) == [(11,), (12,), (13,)]


# --- learner


LOG = "seq bigint, user_id bigint, question_id bigint, is_correct boolean, time_ms bigint, created_at timestamp"


def log(spark, *attempts):
    from datetime import datetime

    return spark.createDataFrame([(*a, datetime(2024, 1, 1)) for a in attempts], LOG)


def test_the_latest_answer_counts(spark):
    a = log(spark, (2, 1, 1, False, 30), (5, 1, 1, True, 10), (3, 1, 2, None, 5), (4, 1, 3, False, None))
    assert rows(learner.current_answers(a).select("question_id", "seq")) == [(1, 5), (2, 3), (3, 4)]
    edges = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "question_id bigint, topic_id bigint")
    got = learner.topic_mastery(a, edges).collect()
    assert [(r["attempted"], r["correct"], r["accuracy"], r["median_ms"]) for r in got] == [(2, 1, 0.5, 10)]


def test_a_revision_queue_is_that_of_brute_force(spark):
    """One topic has nearly all questions, and one user has tried most of them."""
    rng = random.Random(4)
    questions = [(q, rng.choice(["approved", "approved", "extracted"])) for q in range(300)]
    edges = [(q, 0) for q in range(300)] + [(q, 1 + q % 3) for q in range(0, 300, 5)]
    answers = [(1, q, rng.choice([True, False, None])) for q in range(0, 280)] + [(2, q, False) for q in range(0, 300, 40)] + [(3, 7, True)]
    weak = [(1, 0), (1, 2), (2, 0), (2, 1), (3, 3)]
    of = lambda data, schema: spark.createDataFrame(data, schema)
    got = learner.revision_queue(of(weak, "user_id bigint, topic_id bigint"), of(answers, "user_id bigint, question_id bigint, is_correct boolean"), of(edges, "question_id bigint, topic_id bigint"), of(questions, "question_id bigint, status string"))
    known, right = dict(questions), {(u, q): c for u, q, c in answers}
    want = []
    for user in (1, 2, 3):
        pool = {q for q, t in edges if (user, t) in weak and known[q] == "approved"}
        ranked = sorted((1 if (user, q) not in right else 0, q) for q in pool if (user, q) not in right or right[user, q] is False)
        want += [(user, q, rank, i + 1) for i, (rank, q) in enumerate(ranked[:20])]
    assert rows(got) == sorted(want, key=str)


def test_quota_stops_at_the_limit(spark):
    a = spark.createDataFrame([(s, 1) for s in range(1, 6)], "seq bigint, user_id bigint").withColumn("day", F.lit("2024-01-01").cast("date"))
    assert [r["admitted"] for r in learner.quota_ledger(a, 3).orderBy("seq").collect()] == [True, True, True, False, False]


def test_a_refused_request_leaves_the_counter(spark):
    rng = random.Random(2)
    asked = [(u, s, rng.randrange(1, 5)) for u in range(8) for s in range(12)]
    df = spark.createDataFrame(asked, "user_id bigint, seq bigint, amount bigint").withColumn("day", F.lit("2024-01-01").cast("date"))
    used, want = {}, {}
    for u, s, n in asked:
        ok = used.get(u, 0) + n <= 9
        used[u] = used.get(u, 0) + n * ok
        want[u, s] = (ok, used[u])
    assert {(r["user_id"], r["seq"]): (r["admitted"], r["used"]) for r in learner.quota_ledger_mixed(df, 9).collect()} == want


def test_days_of_one_task_are_scanned_together(spark):
    """Days that share a task and a batch don't share a counter, users and days may be null, and no Python call is one day's."""
    asked = [(u, d, s, a) for u in (None, 1, 2) for d in (None, "2024-01-01", "2024-01-02") for s, a in enumerate((4, 3, None, 1, 2))]
    df = spark.createDataFrame(asked, "user_id bigint, day string, seq bigint, amount bigint").withColumn("day", F.col("day").cast("date")).orderBy(F.rand(1))
    ledger = learner.quota_ledger_mixed(df, 5)
    got = {(r["user_id"], r["day"] and str(r["day"]), r["seq"]): (r["admitted"], r["used"]) for r in ledger.collect()}
    each = [(True, 4), (False, 4), (None, 4), (True, 5), (False, 5)]
    assert got == {(u, d, s): each[s] for u, d, s, _ in asked}
    assert "FlatMapGroupsInPandas" not in ledger._jdf.queryExecution().executedPlan().toString()


def test_bins(spark):
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate([3, 3, 9, 1, 4, 6])] + [(2, 0, 1)], "doc_id bigint, place int, height int")
    got = learner.packed(df, 6).orderBy("doc_id", "place").collect()
    assert [r["bin"] for r in got] == [0, 0, 1, 2, 2, 3, 0]
    assert learner.packed(df.limit(0), 6).count() == 0


# --- merges


FLAGS = "key bigint, text string, scheme string, status string, flags array<string>"


def test_decided_rows_keep_status_and_flags(spark):
    old = spark.createDataFrame([(1, "a", "s", "approved", ["x"]), (2, "b", None, "needs_review", ["unmatched_mark_scheme"]), (3, "c", "s", "needs_review", ["unmatched_mark_scheme", "y"]), (4, "d", None, "extracted", None)], FLAGS)
    new = spark.createDataFrame([(1, "A", None, None, ["z"]), (2, "B", "t", None, []), (3, "C", None, None, ["unmatched_mark_scheme"]), (5, "E", None, None, ["q"])], FLAGS)
    got = {r["key"]: (r["text"], r["scheme"], r["status"], r["flags"]) for r in merging.merge_questions(old, new).collect()}
    assert got == {1: ("A", "s", "approved", ["x"]), 2: ("B", "t", "extracted", []), 3: ("C", "s", "needs_review", ["y"]), 4: ("d", None, "extracted", []), 5: ("E", None, "needs_review", ["q"])}
    again = merging.merge_questions(merging.merge_questions(old, new), new)
    assert {r["key"]: (r["text"], r["scheme"], r["status"], r["flags"]) for r in again.collect()} == got


def test_a_cascade_moves_only_open_rows(spark):
    leaves = spark.createDataFrame([("1", "1(a)", "extracted"), ("1", "1(b)", "approved"), ("10", "10(a)", "extracted")], "root string, label string, status string")
    got = merging.cascade(leaves, spark.createDataFrame([("1", "rejected")], "root string, decision string"))
    assert rows(got.select("label", "new_status", "moved", "conflict")) == [("1(a)", "rejected", True, False), ("1(b)", "approved", False, True), ("10(a)", "extracted", False, False)]


def test_children_are_replaced_as_a_whole(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p int, v string")
    new = spark.createDataFrame([(1, "z")], "p int, v string")
    assert rows(common.replaced(old, new, ["p"])) == [(1, "z"), (2, "c")]
    assert rows(common.replaced(old, new.limit(0), ["p"])) == rows(old)


# --- tagging


@pytest.mark.parametrize(("own", "model", "want"), [((1, [2]), (1, []), "agreed"), ((1, [2]), (2, [9]), "reordered"), ((1, []), (3, [1]), "reordered"), ((1, [5]), (3, [5]), "disagreed")])
def test_structured_outcomes(spark, own, model, want):
    df = spark.createDataFrame([(*own, *model)], "p int, s array<int>, mp int, ms array<int>")
    assert df.select(tagging.structured_outcome(*(F.col(c) for c in df.columns))).first()[0] == want


def test_a_second_opinion_never_undoes_an_approval(spark):
    df = spark.createDataFrame([(1, 95, "extracted", 1), (1, 60, "needs_review", 1), (1, 95, "approved", 2), (1, 95, "extracted", 2)], "topic int, confidence int, status string, answer int")
    got = [(r["outcome"], r["new_confidence"], r["new_status"], r["new_flag"]) for r in tagging.second_opinion(df).collect()]
    assert got == [("agreed", 95, "extracted", False), ("agreed", 90, "extracted", False), ("disagreed", 74, "approved", False), ("disagreed", 74, "needs_review", True)]


# --- layout


def test_islands_and_gaps(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 2, 4), ("a", 13, 20), ("a", 24, 30), ("b", 0, 1)], "k string, y0 int, y1 int")
    assert rows(common.islands(df, ["k"], "y0", "y1", 3)) == [("a", 0, 20, 3), ("a", 24, 30, 1), ("b", 0, 1, 1)]
    numbers = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4), ("b", 0)], "k string, n int")
    assert rows(common.gaps(numbers, ["k"], "n")) == [("a", 2), ("a", 3)]


def test_rows_of_overlapping_lines(spark):
    """A tall line joins a short one by the short one's height; only the row before is looked at; blank lines are none."""
    lines = [(1, 0, 0, "b", 0, 10, 50), (1, 0, 1, "a", 2, 12, 10), (1, 0, 2, "c", 20, 30, 0), (1, 0, 3, " ", 20, 30, 0), (1, 0, 4, "tall", 29, 89, 9), (1, 0, 5, "low", 27, 31, 0), (1, 0, 6, "d", 0, 10, 0), (1, 1, 0, "x\t\x07y", 0, 0, 0), (1, 1, 1, "z", 0, 0, 0)]
    df = spark.createDataFrame(lines, "doc_id bigint, page int, line_no int, line string, y0 int, y1 int, x0 int")
    assert rows(outline.visual_rows(df).select("page", "row", "text")) == [(0, 0, "a b"), (0, 1, "c"), (0, 2, "low tall"), (0, 3, "d"), (1, 0, "x y"), (1, 1, "z")]


# --- catalogue and retrieval


def test_pages_of_one_task_are_scanned_together(spark):
    """A row goes on neither across pages nor across documents, but does across batches; no Python call is one page's."""
    lines = [(d, p, n, f"{p}.{n}", 0 if n < 2 else 50, 10 if n < 2 else 60, 9 - n) for d in range(40) for p in range(3) for n in range(4)]
    df = spark.createDataFrame(lines, "doc_id bigint, page int, line_no int, line string, y0 int, y1 int, x0 int").orderBy(F.rand(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = outline.visual_rows(df)
        got = rows(found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(((d, p, r, f"{p}.{2 * r + 1} {p}.{2 * r}") for d in range(40) for p in range(3) for r in range(2)), key=str)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_prefix_is_not_a_parent(spark):
    df = spark.createDataFrame([("1(a)",), ("10(a)",), ("1",)], "l string")
    assert [r[0] for r in df.select(catalogue.in_subtree(F.col("l"), F.lit("1"))).collect()] == [True, False, False]


@pytest.mark.parametrize("block", [2048, 3])
def test_search_is_exact(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    m = np.random.default_rng(1).normal(size=(200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<float>").repartition(5)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for q in range(0, 200, 20):
        s = unit @ unit[q]
        s[q] = -2
        want |= {(q, int(i)) for i in sorted(range(200), key=lambda i: -s[i])[:5] if s[i] >= 0.5}
    assert {(r["query_id"], r["vec_id"]) for r in retrieval.search(df, df.where("vec_id % 20 = 0"), threshold=0.5).collect()} == want


def test_search_passes_over_null_and_ragged_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [1.0]), (5, []), (6, [0.0, 0.0]), (7, [2.0])], "vec_id bigint, embedding array<float>")
    assert {(r["query_id"], r["vec_id"]) for r in retrieval.search(df, df, threshold=0.5).collect()} == {(1, 2), (2, 1), (4, 7), (7, 4)}
    assert retrieval.search(df, df.limit(0), threshold=0.5).count() == retrieval.search(df.limit(0), df, threshold=0.5).count() == 0


def test_fuzzy_search_is_that_of_brute_force(spark):
    """Half of all texts share a long beginning."""
    rng = random.Random(3)
    texts = [("the common beginning of " if i % 2 else "") + "".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 25))) for i in range(120)] + ["", None, "a", "A"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")

    def grams(t):
        p = "  " + t.lower() + " "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    asked = [t for t in texts[::7] if t is not None]
    want = {(q, t): round(len(grams(q) & grams(t)) / len(grams(q) | grams(t)), 4) for q in asked for t in texts if t is not None}
    got = {(r["query"], r["text"]): r["similarity"] for r in retrieval.fuzzy_search(df, spark.createDataFrame([(t,) for t in asked], "query string")).collect()}
    assert got == {k: v for k, v in want.items() if v >= 0.3}


def test_a_plan_embeds_only_what_changed(spark):
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, " "), (4, "d")], "group_id bigint, text string")
    import hashlib

    stored = spark.createDataFrame([(1, hashlib.sha256(b"a").hexdigest()), (2, "old")], "group_id bigint, stored_hash string")
    assert rows(retrieval.embedding_plan(c, stored)) == [(1, "unchanged"), (2, "stale"), (3, "missing_text"), (4, "new")]


# --- sources


def test_reports_snapshots_and_replays(spark, tmp_path):
    from quillstone.sources import files

    df = spark.createDataFrame([(2, "b"), (0, "c"), (1, "a")], "rank int, t string").repartition(3)
    files.write_report(df, f"{tmp_path}/report", "rank")
    got = [line for p in sorted((tmp_path / "report").glob("part-*.csv")) for line in p.read_text().splitlines()[1:]]
    assert got == ["0,c", "1,a", "2,b"]
    one, two = files.swap_snapshot(df, f"{tmp_path}/snap"), files.swap_snapshot(df.where("rank = 1"), f"{tmp_path}/snap")
    assert (one.count(), two.count()) == (3, 1)
    tags = spark.createDataFrame([(1, 7), (2, 7)], "question_id bigint, topic_id bigint")
    answers = spark.createDataFrame([(1, 7, 0.9), (2, 8, 0.9), (3, 7, 0.9)], files.ANSWERS)
    assert rows(files.replayed(spark, answers, tags).select("question_id", "outcome")) == [(1, "agreed"), (2, "disagreed"), (3, "unknown")]
    now = files.manifest(spark, f"{tmp_path}/report")
    assert {r["state"] for r in files.changed_documents(now, now).collect()} == {"same"}
    files.write_view(spark.createDataFrame([(2001, "b"), (2003, "a"), (2003, "A")], "year int, paper string"), f"{tmp_path}/view", "v_papers")
    shown = [line for p in sorted((tmp_path / "view").glob("part-*.csv")) for line in p.read_text().splitlines()[1:]]
    assert shown == ["2003,A", "2003,a", "2001,b"]


def test_copies_of_a_vector_stand_in_line_by_their_ids(spark):
    """More equal vectors than are asked for, in one batch and over several blocks of the corpus: the smallest ids win."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100, 140)] + [(7, [3.0, 2.0, 1.0]), (1, [1.0, 2.0, 3.1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    found = retrieval.search(df, df.where("vec_id IN (120, 7)"), threshold=0.5)
    assert rows_of(found.where("query_id = 120")) == [(100, 1), (101, 2), (102, 3), (103, 4), (104, 5)]
    assert [r[0] for r in rows_of(found.where("query_id = 7"))] == [100, 101, 102, 103, 104]


def rows_of(found):
    return [(r["vec_id"], r["rank"]) for r in found.orderBy("rank").collect()]


def test_ties_over_blocks_of_the_corpus(spark, monkeypatch):
    import numpy as np

    q = np.ones((1, 4), np.float32)
    v = np.ones((50, 4), np.float32)
    whole = retrieval._best(np.array([99]), q, np.arange(49, -1, -1), v, 0.9, 5).to_pydict()
    assert whole["vec_id"] == [0, 1, 2, 3, 4] and len(set(whole["similarity"])) == 1


def test_a_text_of_dirt_alone_becomes_null(spark):
    from quillstone.functions.text import clean_column

    df = spark.createDataFrame([("\x01\x02",), ("a\x07 b",), ("",), (None,), ("plain  text",), (" \x0b ",)], "t string")
    assert [r[0] for r in df.select(clean_column(F.col("t"))).collect()] == [None, "a b", "", None, "plain  text", None]


def test_which_documents_are_wanted(spark):
    from quillstone.sources import names

    stems = ["9702_s19_qp_12", "9702_s19_gt", "9702_s19_ms_12", "9702_w21_qp_4", "9702_s05_qp_12", "9702_m20_qp_32", "nonsense", None]
    df = spark.createDataFrame([(s,) for s in stems], "s string")
    chosen = lambda **o: [r["s"] for r in df.where(names.wanted(names.parsed_name(F.col("s")), **{"doc_types": ("qp", "gt"), "years": (2019, 2021), **o})).collect()]
    assert chosen() == ["9702_s19_qp_12", "9702_s19_gt", "9702_w21_qp_4", "9702_m20_qp_32"]
    assert chosen(components=(1, 4)) == ["9702_s19_qp_12", "9702_s19_gt", "9702_w21_qp_4"]
    assert chosen(years=(2021, 2021)) == ["9702_w21_qp_4"]


def test_decisions_kept_as_a_map(spark, tmp_path):
    from quillstone.sources import files

    for name, text in (("a", '{"1": "1.1", "2": "9.9", "7": "1.2", "3": null}'), ("b", '["no", "map"]'), ("c", "{}")):
        (tmp_path / f"sheet={name}").mkdir()
        (tmp_path / f"sheet={name}" / "decisions.json").write_text(text)
    sheet = spark.createDataFrame([("a", "1", 10), ("a", "1", 11), ("a", "2", 12), ("a", "3", 13), ("a", "4", 14), ("c", "1", 20)], "sheet string, position string, question_id int")
    closed = spark.createDataFrame([("1.1",), ("1.2",)], "code string")
    got = files.applied_decisions(sheet, files.decisions_map(spark, str(tmp_path)), closed)
    want = [("a", "1", 10, "1.1", "applied"), ("a", "1", 11, "1.1", "applied"), ("a", "2", 12, "9.9", "unknown_code"), ("a", "3", 13, None, "malformed"), ("a", "4", 14, None, "skipped"), ("a", "7", None, "1.2", "unknown_position"), ("b", None, None, None, "malformed"), ("c", "1", 20, None, "skipped")]
    # An empty object has no decision at all, and is no less a map for it.
    assert sorted((tuple(r) for r in got.where("NOT (sheet = 'c' AND position IS NULL)").collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_numbers_go_on_over_ranges(spark, partitions):
    """One key has nearly all rows: it is numbered by several ranges, none of which is another's."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 50 == 0, 1).otherwise(2).alias("k"), ((F.col("id") * 7919) % 3001).alias("o"))
        got = common.numbered(df, "k", "o", "n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k in (1, 2):
        own = sorted((r["o"], r["n"]) for r in got if r["k"] == k)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert len(got) == 3000
