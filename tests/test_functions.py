import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.sources import names as N


def apply(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_normalise(spark):
    got = apply(spark, T.normalise, "Name TWO gases; say why!", "Crème brûlée", "12 6 apples fall", "co-op  map\tend", None, "")
    assert got == ["name two gases say why", "creme brulee", "6 apples fall", "coop  mapend", None, ""]


#: Texts with what extraction leaves behind, and what is to be left of them.
CLEANED = [
    ("a gas is given off. [2] 14 ,\x03\x03 \x04,", "a gas is given off. [2]"),
    ("the rock cools 9 BLANK PAGE ,\x05\x06, slowly", "the rock cools slowly"),
    ("score \x0e of \x0f ten", "score of ten"),
    ("no\x00thing", "nothing"),
    ("line\x0btwo\x7f", "line two"),
    ("\x1f", ""),
    ("tab\tand\n\nlines  as they were", "tab\tand\n\nlines  as they were"),
    ("", ""),
    (None, None),
]
WITH_SYMBOLS = [
    ("2Mg + O2 \x01 2MgO", "2Mg + O2 → 2MgO"),
    ("Zn2+  +  2OH–  \x01\t Zn(OH)2  solid", "Zn2+ + 2OH– → Zn(OH)2 solid"),
    ("AgNO3(aq) \x01 (products)", "AgNO3(aq) → (products)"),
    ("\x01 names the valve ; \x01 says why", "✓ names the valve ; ✓ says why"),
    ("row 2 \x01\x01 \x01 wrong", "row 2 ✓✓ ✓ wrong"),
    ("x \x01 lower case", "x ✓ lower case"),
    ("tab\tand\n\nlines  as they were", "tab\tand\n\nlines  as they were"),
]


def test_control_characters_are_cleaned(spark):
    once = apply(spark, T.clean_extracted, *(x for x, _ in CLEANED))
    assert once == [want for _, want in CLEANED]
    assert apply(spark, T.clean_extracted, *once) == once
    assert apply(spark, lambda c: T.clean_extracted(c, symbols=True), *(x for x, _ in WITH_SYMBOLS)) == [want for _, want in WITH_SYMBOLS]


def test_page_furniture(spark):
    yes = ["7", "31 ,\x04\x05,", "   ", ",\x02,", "8 Blank page", "blank \n PAGE", "", "2 , BLANK PAGE , 3"]
    no = ["blank page, then answer", "7 cm", "Q", "give two reasons", "(b) 7"]
    assert apply(spark, T.is_furniture, *yes, *no, None) == [True] * len(yes) + [False] * len(no) + [None]


def test_pages_without_content(spark):
    cover = "Certificate of something\nBIOLOGY\nThis document consists of 8 printed pages and a sheet."
    yes = [cover, "BLANK PAGE\nNothing is printed on this side of the sheet.", "List of formulae\narea = side squared, volume = side cubed"]
    no = ["A page of prose that says nothing about itself at all.", cover + "\nName a cell. [3]", cover + "\n7 Name a cell", "3 Name the part\nA root\nB stem\nC leaf\nD seed and more", cover + "\nC) leaf", "blank page", "", None]
    assert apply(spark, T.is_non_content, *yes, *no) == [True] * len(yes) + [False] * len(no)


def test_labels(spark):
    asked = ["9(b)(iv)", "9 (b) (iv)", "9(B)(IV)", "  9( b )( iv )", "31", "2(c)", "C4", "c4", "(b)", "Section A", "9(b)(4)", "6(or)(b)"]
    assert apply(spark, T.normalise_label, *asked) == ["9(b)(iv)"] * 4 + ["31", "2(c)", "C4", None, None, None, "9(b)", "6(or)(b)"]
    assert apply(spark, T.root_label, "23(c)(v)", "4") == ["23", "4"]
    assert apply(spark, T.own_label, "23(c)(v)", "4") == ["(v)", "4"]
    assert apply(spark, T.folded_label, "6(b)(ii)(x)", "4") == ["6(b)(ii)", "4"]


def test_marks(spark):
    assert apply(spark, T.bracket_marks, "one [2] two [3] ", "none", "[4] not at the end") == [5, None, None]
    assert apply(spark, T.code_marks, "4 in all", "B1 C2 A3", "none given", "5*", "1ft\nM2 if 7.5 seen", "B2dep\nM1FT", "6 *", "34y", "456") == [4, 6, None, 5, 1, 3, 6, None, None]


def test_slugs_and_spaces(spark):
    assert apply(spark, T.slug, "Señal: ¡Ondas!", "", "***", "x  y", "Cell walls", "Naïve sorting, part 2", "Sound / light", "?") == ["senal-ondas", "topic", "topic", "x-y", "cell-walls", "naive-sorting-part-2", "sound-light", "topic"]
    assert apply(spark, T.collapse_spaces, " a\t\n b ", "\u2002a\x07\u2002\xa0b", "") == ["a b", "a b", ""]


def test_durations(spark):
    df = spark.createDataFrame([(0,), (59_999,), (60_000,), (6_123_000,)], "ms bigint")
    assert [tuple(r) for r in df.select(T.duration(F.col("ms")), T.clock(F.col("ms"))).collect()] == [("0s", "00:00"), ("59s", "00:59"), ("1m 0s", "01:00"), ("102m 3s", "102:03")]


def test_json_is_repaired(spark):
    assert apply(spark, T.repaired_json, '```json\n{"a": 1,}\n```', '{"a": [1, 2, ]}') == ['{"a": 1}', '{"a": [1, 2]}']


@pytest.mark.parametrize(
    ("stem", "want"),
    [
        ("2281_s07_qp_21", ("2281", "may_june", 2007, "qp", 2, 1)),
        ("0610_m24_ms_42", ("0610", "feb_march", 2024, "ms", 4, 2)),
        ("9231_w11_in_3", ("9231", "oct_nov", 2011, "in", 3, None)),
        ("9231_s11_er", ("9231", "may_june", 2011, "er", None, None)),
        ("0610_w93_gt", ("0610", "oct_nov", 1993, "gt", None, None)),
        ("0610_w89_ci_1", ("0610", "oct_nov", 2089, "ci", 1, None)),
        (" 2281_M00_QP_5\t", ("2281", "feb_march", 2000, "qp", 5, None)),
        ("228_s07_qp_21", None),
        ("2281_a07_qp_21", None),
        ("2281_s07_xx", None),
        ("2281_s7_qp_21", None),
        ("2281_s07_qp_213", None),
        ("2281-s07-qp", None),
        ("", None),
    ],
)
def test_names_are_parsed_and_rebuilt_or_refused(spark, stem, want):
    df = spark.createDataFrame([(stem,)], "stem string").select("stem", N.parsed_name(F.col("stem")).alias("p")).select("stem", "p.*")
    r = df.first()
    if want is None:
        assert r["syllabus"] is None and r["year"] is None
        return
    assert tuple(r)[1:] == want
    columns = [F.col(c) for c in ("syllabus", "season", "year", "doc_type", "component", "variant")]
    assert df.select(N.built_name(*columns)).first()[0] == stem.strip().lower() + ".pdf"


def test_keys_of_documents_and_pictures(spark):
    df = spark.createDataFrame([("2281", 2007, "may_june", 2, 1), ("0610", 2023, "feb_march", 4, None)], "s string, y int, t string, c int, v int")
    prefix = N.storage_prefix(*(F.col(c) for c in "sytcv"))
    assert [r[0] for r in df.select(prefix).collect()] == ["papers/2281/2007-mj/p21", "papers/0610/2023-fm/p4"]
    p = F.lit("papers/2281/2007-mj/p21")
    keys = (N.document_key(p, F.lit("er")), N.crop_key(p, F.lit(4)), N.structured_crop_key(p, F.lit("7"), F.lit(0)), N.structured_crop_key(p, F.lit("7"), F.lit(3)), N.mark_scheme_crop_key(p, F.lit("5(d)(ii)"), F.lit(0)), N.mark_scheme_crop_key(p, F.lit("5"), F.lit(2)))
    assert [k.removeprefix("papers/2281/2007-mj/p21/") for k in df.select(*keys).first()] == ["er.pdf", "crops/4.png", "crops/7.png", "crops/7.3.png", "crops/ms-5-d-ii.png", "crops/ms-5.2.png"]


def test_vectors_as_text(spark):
    values = [0.25, -1.0, 1e-5, 123456789.0, 0.1 + 0.2, 0.0, 1e20, 12.5, 0.0001, -3.14159265, 0.12890625, 0.12890635, -12.890625, 1.5]
    df = spark.createDataFrame([(values,), ([],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(T.vector_text(F.col("v"))).collect()] == ["[" + ",".join(f"{x:.7g}" for x in values) + "]", "[]", None]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]
