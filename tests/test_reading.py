"""Syllabus outlines, mark schemes, threshold tables and answer grids, on examples of their rules."""

import pytest

from quillstone.operators import reading as R


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- outlines


def outline(spark, *given):
    """Rows as (page, text) with size, weight and left edge by a letter: C chapter, S section, T topic, plain, > indented."""
    style = {"C": (18.0, True, 62.0), "S": (13.0, True, 62.0), "T": (10.0, True, 62.0), "-": (10.0, False, 62.0), ">": (10.0, False, 85.0)}
    made = [(1, p, i, text, *style[kind]) for i, (p, kind, text) in enumerate(given)]
    found = R.syllabus_outline(spark.createDataFrame(made, "doc_id int, page int, row_no int, text string, size double, bold boolean, x0 double"))
    return {(r["section"], r["topic"], r["subtopic"]): (r["level"], r["title"], list(r["objectives"])) for r in found.collect()}


def test_three_levels_with_wrapped_objectives(spark):
    got = outline(
        spark, (1, "C", "3 Subject content"), (1, "S", "1 Motion"), (1, "T", "1.1 Speed"), (1, "-", "1 define speed"), (1, ">", "as a rate"), (1, "-", "2 use graphs"),
        (1, "-", "1.1.1 Slopes"), (1, "-", "1 read a slope"), (1, ">", "of a"), (1, ">", "curve"), (1, "T", "1.2 Force"), (1, ">", "nothing is open yet"), (1, "-", "3 weigh"), (1, "S", "2 Heat"), (1, "-", "4 belongs nowhere"), (1, "T", "2.1 Warm"),
    )
    assert got == {
        ("1", None, None): (1, "Motion", []),
        ("1", "1.1", None): (2, "Speed", ["define speed as a rate", "use graphs"]),
        ("1", "1.1", "1.1.1"): (3, "Slopes", ["read a slope of a curve"]),
        ("1", "1.2", None): (2, "Force", ["weigh"]),
        ("2", None, None): (1, "Heat", []),
        ("2", "2.1", None): (2, "Warm", []),
    }


def test_a_continued_heading_is_the_same_node(spark):
    got = outline(
        spark, (1, "C", "3 Subject content"), (1, "S", "1 Motion"), (1, "T", "1.1 Speed"), (1, "-", "1 first"), (2, "S", "1 Motion continued"), (2, "T", "1.1 Speed CONTINUED "),
        (2, ">", "goes on"), (2, "-", "2 second"), (2, "T", "1.2 Other"), (3, "S", "2 Next"), (3, "T", "1.1 Not that one"), (3, "-", "5 here"),
    )
    assert got[("1", "1.1", None)] == (2, "Speed", ["first goes on", "second"])
    assert got[("2", "1.1", None)] == (2, "Not that one", ["here"])


def test_only_the_content_chapter_is_read(spark):
    got = outline(
        spark, (1, "C", "2 About"), (1, "S", "8 Skipped"), (2, "S", "1 On a page whose chapter comes below"), (2, "C", "3 Subject content overview"), (2, "T", "1.1 Read"), (2, ">", "4 indented"),
        (3, "-", "1.1.2 Sub"), (3, "T", "9 not a topic"), (4, "C", "4 Assessment"), (4, "T", "1.5 Skipped"), (5, "S", "7 Skipped"),
    )
    assert set(got) == {("1", None, None), ("1", "1.1", None), ("1", "1.1", "1.1.2")}
    assert outline(spark, (1, "S", "1 No chapter at all")) == {}
    assert outline(spark, (1, "C", "3 Subject content"), (1, "T", "1.1 No section"), (1, "-", "1.1.1 No topic"), (1, "-", "1 none")) == {}


# --- mark schemes


def scheme(spark, *pages):
    made = [(1, p, i, line) for p, page in enumerate(pages) for i, line in enumerate(page)]
    return R.scheme_lines(spark.createDataFrame(made, "doc_id int, page int, line_no int, line string"))


def entries(spark, *lines):
    found = R.scheme_entries(scheme(spark, ["©", *lines]))
    return [tuple(r) for r in found.orderBy("entry").select("label", "content", "marks").collect()]


def test_what_every_page_repeats_is_dropped(spark):
    got = scheme(spark, ["9702/11", "© a board", "1 principle", "Question"], ["cover, no notice", "2"], ["© a board", "Page 2 of 3", "Answer", "Section C", "Section CC", " 1 ", "", "Marks", "end"])
    assert rows(got, "at", "line") == [(1, "Section CC"), (2, "1"), (3, "end")]
    assert rows(scheme(spark, ["© a board", "no table", "1"]), "line") == [("1",), ("no table",)]


def test_a_path_is_kept_by_level(spark):
    assert entries(spark, "1", "(a)", "sun", "M1", "(b)", "(i)", "moon", "B2", "A1", "(ii)", "star", "(c) tide", "2(a)", "rock", "M1", "(i)", "sand") == [
        ("1(a)", "sun", 1), ("1(b)(i)", "moon", 3), ("1(b)(ii)", "star", None), ("1(c)", "tide", None), ("2(a)", "rock", 1), ("2(a)(i)", "sand", None)]


def test_labels_printed_again_are_taken_off(spark):
    assert entries(spark, "M1", "1(a)(i)1 one", "1(a)(i)2 two", "1( a )( ii )", "three", "((b)(v)", "four") == [("1(a)(i)", "1 one 2 two", None), ("1(a)(ii)", "three", None), ("1(b)(v)", "four", None)]


def test_i_v_and_x_are_parts_only_where_none_is_open(spark):
    assert entries(spark, "M1", "3", "(i)", "one", "(ii)", "two", "4 (b)", "x", "(v)", "y", "(x)", "z") == [("3(i)", "one", None), ("3(i)(ii)", "two", None), ("4(b)", "x", None), ("4(b)(v)", "y", None), ("4(b)(x)", "z", None)]


def test_numbers_that_are_no_questions(spark):
    # A smaller one, a quantity, a nuclide's mass, an exponent printed before its base.
    assert entries(spark, "A1", "5", "(a)", "x", "4", "11 250 J", "9", "4Be", "8", "3.0 10", "6", "(a)", "y") == [("5(a)", "x 4 11 250 J 9 4Be 8 3.0 10", None), ("6(a)", "y", None)]
    assert entries(spark, "[2]", "B3 note", "(a)", "x", "B2", "A4", "y") == [("B3", "note", None), ("B3(a)", "x y", 6)]


def test_lone_numbers_are_marks_where_no_code_is(spark):
    assert entries(spark, "1(a)", "sun", "2", "1(b)", "moon", "1", "3") == [("1(a)", "sun", 2), ("1(b)", "moon", 4)]
    assert entries(spark, "1(a)", "sun [1]", "2", "(a)", "x") == [("1(a)", "sun [1]", None), ("2(a)", "x", None)]
    assert entries(spark, "text before any label", "3") == []


# --- thresholds


def bands(spark, text):
    lines = [(1, i, line) for i, line in enumerate(text.split("\n"))]
    return R.threshold_tables(spark.createDataFrame(lines, "doc_id int, line_no int, line string"))


COMPONENT = "Component 11\n80\n 60 \n50\n40\n30\n20\n"
PAIR = "AX\n200\n11, 21,31\n150\n120\n100\n80\n60\n40\n"
LISTED = "12, 22\n100\n90\n80\n70\n60\n50\n40\n"


def test_both_tables_and_both_layouts(spark):
    got = bands(spark, "Grades\n" + COMPONENT + "\nComponent 4\n40\n30\n25\n20\n15\n10\nA*\nA\n" + PAIR + LISTED)
    assert got.where("problem IS NOT NULL").count() == 0
    assert rows(got.where("grain = 'component' AND variant = 1"), "component", "grade", "low", "high") == [(1, "A", 60, 80), (1, "B", 50, 59), (1, "C", 40, 49), (1, "D", 30, 39), (1, "E", 20, 29)]
    assert rows(got.where("component = 4"), "variant", "grade", "low", "high")[0] == (None, "A", 30, 40)
    assert rows(got.where("combination = 'AX'"), "components", "grade", "low", "high") == [("11, 21,31", g, lo, hi) for g, lo, hi in (("A", 120, 149), ("A*", 150, 200), ("B", 100, 119), ("C", 80, 99), ("D", 60, 79), ("E", 40, 59))]
    assert rows(got.where("combination = '12,22'"), "components", "grade", "low")[1] == ("12, 22", "A*", 90)


def test_a_head_s_numbers_are_no_heads(spark):
    # 80 and 60 would be lists of one component; so would what follows a list's maximum.
    got = bands(spark, COMPONENT + "A*\n" + LISTED + PAIR)
    assert rows(got.where("grain = 'combination'").select("combination").distinct()) == [("12,22",), ("AX",)]


@pytest.mark.parametrize("text, problem", [
    (COMPONENT, "a table is missing"), ("A*\n" + PAIR, "a table is missing"), ("nothing", "a table is missing"), (COMPONENT + "A*\nB\nC", "a table is missing"),
    (COMPONENT.replace("40", "n/a") + "A*\n" + PAIR, "not numbers"), (COMPONENT + "A*\n" + PAIR + "11\n", "not numbers"), ("A*\n" + COMPONENT + PAIR, "not numbers"),
])
def test_anything_else_is_refused_whole(spark, text, problem):
    assert rows(bands(spark, text), "grade", "problem") == [(None, problem)]


# --- answer grids


def grid(spark, *pages):
    made = [(1, p, i, line) for p, page in enumerate(pages) for i, line in enumerate(page.split("|"))]
    return R.answer_grid(spark.createDataFrame(made, "doc_id int, page int, line_no int, line string"))


def test_a_page_s_head_chooses_its_layout(spark):
    got = grid(spark, "Question|Answer|Marks|1|A|1| 2 |b|1|3|F|1|4|C|x|Page 9", "5070|C|Question Number|KEY|21|D|5|E|22|dd|7|A", "No head|8|A|1", "question\tanswer  mark|9|c|1|10|D|1")
    assert rows(got, "number", "answer") == [(1, "A"), (10, "D"), (2, "B"), (21, "D"), (5, "E"), (7, "A"), (9, "C")]


def test_conflicts_go_and_repeats_stay(spark):
    got = grid(spark, "Question|Answer|Marks|1|A|1|2|B|1|01|a|1", "Question Number|Key|2|C|3|D")
    assert rows(got, "number", "answer") == [(1, "A"), (3, "D")]
    assert rows(grid(spark, "Question|Answer|Marks|1|A|2|B|3|C|4"), "number", "answer") == [(1, "A"), (3, "C")]  # rows that overlap


def test_a_grid_is_held_against_what_is_expected(spark):
    made = [(1, n, "A") for n in (1, 2, 3)] + [(2, n, "B") for n in (2, 4, 5, 9)]
    expected = spark.createDataFrame([(1, 3), (2, 6), (3, 2)], "doc_id int, n int")
    got = R.grid_problems(spark.createDataFrame(made, "doc_id int, number int, answer string"), expected)
    assert rows(got) == [(2, "count", 4, 6), (2, "missing", 1, 1), (2, "missing", 3, 3), (2, "missing", 6, 6), (2, "start", 2, 2), (3, "count", 0, 2)]


def test_bands_are_stored_and_looked_up(spark):
    found = bands(spark, COMPONENT + "Component 2\n40\n30\n25\n20\n15\n10\nA*\n" + PAIR)
    units = R.band_units(found)
    assert rows(units.where("grade = 'A'"), "grain", "unit", "low", "high") == [("combination", "AX", 120, 149), ("component", "1-1", 60, 80), ("component", "2", 30, 40)]
    stored = spark.createDataFrame([(1, "component", "1-1", "A", 1, 2), (1, "component", "1-1", "U", 0, 19), (9, "component", "1-1", "A", 3, 4)], units.schema)
    after = R.upserted_bands(stored, units)
    assert rows(after.where("unit = '1-1' AND grade IN ('A', 'U')"), "doc_id", "grade", "low", "high", "is_new") == [(1, "A", 60, 80, False), (1, "U", 0, 19, False), (9, "A", 3, 4, False)]
    assert after.where("is_new").count() == units.count() - 1
    marks = spark.createDataFrame([(1, "1-1", 80), (1, "1-1", 60), (1, "1-1", 59), (1, "1-1", 19), (1, "1-1", 81), (1, "2", 30), (2, "2", 30)], "doc_id int, unit string, mark int")
    assert rows(R.graded(marks, units), "doc_id", "unit", "mark", "grade") == [(1, "1-1", 19, None), (1, "1-1", 59, "B"), (1, "1-1", 60, "A"), (1, "1-1", 80, "A"), (1, "1-1", 81, None), (1, "2", 30, "A"), (2, "2", 30, None)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_read_once(spark):
    """A branch for each kind of row would read, sort and scan all lines as often."""
    lines = spark.createDataFrame([(1, 0, 0, "1")], "doc_id int, page int, line_no int, line string")
    expected = spark.createDataFrame([(1, 3)], "doc_id int, n int")
    scans = lambda df: plan_of(df).count("LogicalRDD")
    assert scans(R.threshold_tables(lines)) == scans(R.answer_grid(lines)) == 1 and scans(R.grid_problems(R.answer_grid(lines), expected)) == 2


def test_long_runs_of_overlapping_rows(spark):
    """Of rows two apart every other one is taken, run by run."""
    page = "Question|Answer|Marks|1|A|2|B|3|C|4|D|5|E|x|6|A|7|B|8"
    assert rows(grid(spark, page), "number", "answer") == [(1, "A"), (3, "C"), (6, "A")]
