"""Reading of line streams: syllabus outlines, mark schemes, grade-threshold tables and answer grids.

A document's lines are one ordered group; what a line means depends on lines before it only through running values, so
everything is windows and aggregates by document, and a fold over the few table heads of a threshold document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.common import joined, merged, newer

# Sizes of type and the gutter's edge in points, what a heading says, and the grades of each table.
CHAPTER_SIZE, SECTION_SIZE, GUTTER_X = 16.0, 12.0, 75.0
CONTENT_CHAPTER = "subject content"
COMPONENT_GRADES, COMBINATION_GRADES = ("A", "B", "C", "D", "E"), ("A*", "A", "B", "C", "D", "E")
LATE_ROMANS = ("i", "v", "x")

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def _matched(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The group where the whole pattern is found, else null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def syllabus_outline(rows: DataFrame) -> DataFrame:
    """The topic tree of a syllabus: ``doc_id, level, section, topic, subtopic, title, objectives, first_row``, a row for each node.

    Rows have ``doc_id, page, row_no, text, size, bold, x0``. Chapter headings (large, bold) turn the content on or off
    from their page on. In the gutter, a large bold "n title" opens a section, a bold "n.n title" a topic in it, a plain
    "n.n.n title" a subtopic in that; a heading closes the levels below it. A plain "n text" opens an objective of the
    innermost open topic; any other row goes on with that node's last objective. A heading met again, "continued" or not,
    is the same node: it keeps its first title and gathers more objectives.
    """
    heading = _matched("text", r"^(\d+)\s+(.+)$", 2)
    chapter = (F.col("size") >= CHAPTER_SIZE) & F.col("bold") & heading.isNotNull()
    says = F.when(chapter, F.struct("page", "row_no", F.startswith(F.lower(heading), F.lit(CONTENT_CHAPTER)).alias("content")))
    pages = Window.partitionBy("doc_id").orderBy("page").rangeBetween(*_SO_FAR)
    body = rows.withColumn("chapter", F.max(says).over(pages)).where(F.col("chapter.content") & (F.col("size") < CHAPTER_SIZE))
    gutter = F.col("x0") < GUTTER_X
    section = F.when(gutter & F.col("bold") & (F.col("size") >= SECTION_SIZE), _matched("text", r"^(\d+)\s+.+$"))
    topic = F.when(gutter & F.col("bold"), _matched("text", r"^(\d+\.\d+)\s+.+$"))
    subtopic = F.when(gutter & ~F.col("bold"), _matched("text", r"^(\d+\.\d+\.\d+)\s+.+$"))
    objective = F.when(gutter & ~F.col("bold"), _matched("text", r"^\d+\s+(.+)$"))
    title = F.regexp_replace(_matched("text", r"^[\d.]+\s+(.+)$"), r"(?i)\s+continued\s*$", "")
    body = body.select("doc_id", "row_no", "text", section.alias("s"), topic.alias("t"), subtopic.alias("u"), objective.alias("o"), title.alias("title"))
    order = Window.partitionBy("doc_id").orderBy("row_no").rowsBetween(*_SO_FAR)
    body = body.withColumn("section", F.last("s", ignorenulls=True).over(order)).withColumn("s_run", F.count("s").over(order))
    in_section = Window.partitionBy("doc_id", "s_run").orderBy("row_no").rowsBetween(*_SO_FAR)
    body = body.withColumn("t", F.when(F.col("section").isNotNull() & F.col("s").isNull(), F.col("t")))
    body = body.withColumn("topic", F.last("t", ignorenulls=True).over(in_section)).withColumn("t_run", F.count("t").over(in_section))
    in_topic = Window.partitionBy("doc_id", "s_run", "t_run").orderBy("row_no").rowsBetween(*_SO_FAR)
    body = body.withColumn("u", F.when(F.col("topic").isNotNull(), F.col("u"))).withColumn("subtopic", F.last("u", ignorenulls=True).over(in_topic))
    node = ["doc_id", "section", "topic", "subtopic"]
    opens = F.coalesce("s", "t", "u").isNotNull()
    heads = body.where(opens).groupBy(*node).agg(F.min_by("title", "row_no").alias("title"), F.min("row_no").alias("first_row"))
    text = body.where("topic IS NOT NULL").where(~opens)
    in_node = Window.partitionBy(*node).orderBy("row_no").rowsBetween(*_SO_FAR)
    text = text.withColumn("item", F.count("o").over(in_node)).where("item > 0")
    items = text.groupBy(*node, "item").agg(joined(["row_no"], F.coalesce("o", "text"), " ").alias("text"))
    lists = items.groupBy(*node).agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda i: i["text"]).alias("objectives"))
    on = [F.col(f"h.{c}").eqNullSafe(F.col(f"l.{c}")) for c in node]
    level = F.when(F.col("h.topic").isNull(), 1).when(F.col("h.subtopic").isNull(), 2).otherwise(3)
    none = F.array().cast("array<string>")
    return heads.alias("h").join(lists.alias("l"), on, "left").select(*(F.col(f"h.{c}").alias(c) for c in node), level.alias("level"), "title", F.coalesce("objectives", none).alias("objectives"), "first_row")


def scheme_lines(lines: DataFrame) -> DataFrame:
    """The lines of a mark scheme without what every page repeats: ``doc_id, at, line``.

    Lines have ``doc_id, page, line_no, line``. Of each page what follows its copyright line counts (a page without one has
    none), of the document what follows its first table head; table heads, page numbers and section headings go.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    trimmed = lines.select("doc_id", "page", "line_no", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line"))
    content = trimmed.withColumn("past", F.coalesce(F.max(F.startswith("line", F.lit("©"))).over(page), F.lit(False))).where("past")
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    content = content.withColumn("table", F.max(F.col("line") == "Question").over(order.rowsBetween(*_SO_FAR))).withColumn("any", F.max(F.col("line") == "Question").over(Window.partitionBy("doc_id")))
    kept = content.where("table OR NOT any").where(~F.col("line").isin("Question", "Answer", "Marks", "") & ~F.col("line").rlike(r"^Page \d+ of \d+$|^Section [A-Z]$"))
    return kept.select("doc_id", F.row_number().over(order).alias("at"), "line")


def scheme_entries(lines: DataFrame) -> DataFrame:
    """A mark scheme's entries: ``doc_id, entry, label, content, marks``; ``entry`` numbers them in order.

    Lines as of ``scheme_lines``. A label path of question, part and sub-part is kept by level: a question must count up
    and closes both levels below it, a part closes the sub-part; a label that is open already is only taken off its line.
    A question's number stands before a part, or alone if the document writes marks as codes or in brackets (where it
    does not, such numbers are marks), and not before the sign of a nuclide or the base of a power of ten, or begins with a
    letter. (i), (v) and (x) are parts only where a question has none yet. Marks are those of codes (M2) and lone numbers;
    null if there are none. Entries without text are dropped.
    """
    w = Window.partitionBy("doc_id").orderBy("at")
    whole = Window.partitionBy("doc_id")
    line = F.regexp_replace("line", r"\(\(([a-z]+)\)", "($1)")
    line = F.regexp_replace(F.regexp_replace(line, r"\(\s+", "("), r"\s+\)", ")")
    line = F.regexp_replace(F.regexp_replace(line, r"(?i)(?<=[0-9)])(\([a-z]+\))", " $1"), r"(?<=\))(\d)", " $1")
    codes = F.max(F.col("line").rlike(r"(?i)^[BMCA]\d$") | F.col("line").rlike(r"\[\d{1,2}\]")).over(whole)
    rows = lines.select("doc_id", "at", codes.alias("coded"), F.lead("line").over(w).alias("after"), F.col("line").alias("raw"), line.alias("line"))
    code = _matched("line", r"(?i)^[BMCA](\d)$").cast("int")
    tokens = F.filter(F.split("line", r"\s+"), lambda t: t != "")
    rows = rows.select("*", code.alias("code"), tokens.alias("t"))
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    part_like = r"^\(([a-z]|ii|iii|iv|vi|vii|viii|ix)\)$"
    alone = F.size("t") == 1
    physics = F.coalesce(F.col("after").rlike(r"^\d{1,3}[A-Z][a-z]?$") | F.col("after").rlike(r"^\d+(\.\d+)?\s+10\b"), F.lit(False))
    shaped = first.rlike(r"^[A-Z]?\d{1,2}$") & (first.rlike("^[A-Z]") | (alone & F.col("coded")) | (~alone & second.rlike(part_like))) & ~(alone & physics)
    ordinal = F.when(F.col("code").isNull() & shaped, F.regexp_extract(first, r"(\d+)$", 1).cast("int"))
    rows = rows.withColumn("ordinal", ordinal).withColumn("highest", F.max("ordinal").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new_root = F.col("ordinal").isNotNull() & (F.col("highest").isNull() | (F.col("ordinal") > F.col("highest")))
    rows = rows.withColumn("root_at", F.when(new_root, first)).withColumn("root", F.last("root_at", ignorenulls=True).over(w.rowsBetween(*_SO_FAR))).withColumn("r_run", F.count("root_at").over(w.rowsBetween(*_SO_FAR)))
    took_root = F.col("ordinal").isNotNull() & (new_root | (first == F.lag("root").over(w)))
    rows = rows.withColumn("i", F.when(took_root, 1).otherwise(0))
    at_i = F.when(F.col("code").isNull(), F.get("t", F.col("i")))
    rows = rows.withColumn("p", _matched(at_i, r"^\(([a-z])\)$"))
    in_root = Window.partitionBy("doc_id", "r_run").orderBy("at")
    earlier = F.count("p").over(in_root.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("part_at", F.when(~F.col("p").isin(*LATE_ROMANS) | (earlier == 0), F.col("p")))
    rows = rows.withColumn("part", F.last("part_at", ignorenulls=True).over(in_root.rowsBetween(*_SO_FAR)))
    new_part = F.col("part_at").isNotNull() & ~F.col("part_at").eqNullSafe(F.lag("part").over(in_root))
    rows = rows.withColumn("new_part", new_part).withColumn("p_run", F.sum(F.col("new_part").cast("int")).over(in_root.rowsBetween(*_SO_FAR)))
    rows = rows.withColumn("i", F.col("i") + F.when(F.col("part_at").isNotNull(), 1).otherwise(0))
    at_i = F.when(F.col("code").isNull(), F.get("t", F.col("i")))
    rows = rows.withColumn("sub_at", _matched(at_i, r"^\((i|ii|iii|iv|v|vi|vii|viii|ix|x)\)$"))
    in_part = Window.partitionBy("doc_id", "r_run", "p_run").orderBy("at")
    rows = rows.withColumn("sub", F.last("sub_at", ignorenulls=True).over(in_part.rowsBetween(*_SO_FAR)))
    new_sub = F.col("sub_at").isNotNull() & ~F.col("sub_at").eqNullSafe(F.lag("sub").over(in_part))
    rows = rows.withColumn("i", F.col("i") + F.when(F.col("sub_at").isNotNull(), 1).otherwise(0))
    opens = F.col("root_at").isNotNull() | F.col("new_part") | new_sub
    rows = rows.withColumn("entry", F.sum(opens.cast("int")).over(w.rowsBetween(*_SO_FAR))).where("root IS NOT NULL")
    bare = F.when((F.col("i") == 0) & ~F.col("coded"), _matched("line", r"^(\d{1,2})$").cast("int"))
    marks = F.coalesce("code", bare)
    rest = F.when(F.col("i") > 0, F.array_join(F.slice("t", F.col("i") + 1, F.size("t")), " ")).otherwise(F.col("line"))
    content = F.when(marks.isNull(), F.nullif(rest, F.lit("")))
    level = lambda c: F.coalesce(F.concat(F.lit("("), c, F.lit(")")), F.lit(""))
    rows = rows.select("doc_id", "entry", "at", F.concat("root", level("part"), level("sub")).alias("label"), content.alias("content"), marks.alias("marks"))
    texts = F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("at", "content"))))
    found = rows.groupBy("doc_id", "entry").agg(F.min_by("label", "at").alias("label"), F.array_join(F.transform(texts, lambda r: r["content"]), " ").alias("content"), F.nullif(F.sum("marks"), F.lit(0)).alias("marks"))
    return found.where("content <> ''").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry")).alias("entry"), "label", "content", "marks")


def threshold_tables(lines: DataFrame) -> DataFrame:
    """Grade bands of both tables of a document: ``doc_id, grain, component, variant, combination, components, grade, low, high, problem``.

    Lines have ``doc_id, line_no, line``. Up to the first line "A*", a line "Component nn" is followed by its maximum and five
    least marks; after it, a pair of capitals by its maximum, components and six marks, or a list of components by its
    maximum and six. What a head has taken can't be a head itself. A band ends below the one above it. A document without
    both tables, or with anything but numbers in one, has one row, with ``problem`` and nothing else: it is refused whole.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.select("doc_id", "line_no", F.regexp_replace("line", r"^\s+|\s+$", "").alias("line")).where("line <> ''")
    rows = rows.withColumn("at", F.row_number().over(w)).withColumn("starred", F.coalesce(F.max(F.col("line") == "A*").over(w.rowsBetween(*_SO_FAR)), F.lit(False))).withColumn("next", F.collect_list("line").over(w.rowsBetween(1, 8)))
    component = F.when(~F.col("starred"), _matched("line", r"^Component (\d+)$"))
    pair = F.when(F.col("starred"), _matched("line", r"^([A-Z]{2})$"))
    listed = F.when(F.col("starred"), _matched("line", r"^(\d{1,2}(?:,\s*\d{1,2})*)$"))
    part = lambda begin, n: F.slice("next", begin, n)
    numbers = F.when(component.isNotNull(), part(1, 6)).when(pair.isNotNull(), F.concat(part(1, 1), part(3, 6))).otherwise(part(1, 7))
    head = F.struct(
        "at",
        F.when(component.isNotNull(), 7).when(pair.isNotNull(), 9).otherwise(8).alias("long"),
        component.alias("component"),
        F.coalesce(pair, F.regexp_replace(listed, " ", "")).alias("combination"),
        F.when(pair.isNotNull(), F.get("next", F.lit(1))).otherwise(listed).alias("components"),
        numbers.alias("numbers"),
    )
    heads = rows.select("doc_id", F.when(F.coalesce(component, pair, listed).isNotNull(), head).alias("head"))
    each = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list("head")).alias("heads"))
    kind = rows.select(head.alias("h")).schema["h"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{kind}>").alias("kept"))
    take = lambda s, h: F.when(h["at"] >= s["free"], F.struct((h["at"] + h["long"]).alias("free"), F.concat(s["kept"], F.array(h)).alias("kept"))).otherwise(s)
    each = each.select("doc_id", F.aggregate("heads", start, take, lambda s: s["kept"]).alias("kept"))
    whole = lambda h: (F.size(h["numbers"]) == F.when(h["component"].isNotNull(), 6).otherwise(7)) & F.forall(h["numbers"], lambda v: v.rlike(r"^\d{1,9}$"))
    missing = ~F.exists("kept", lambda h: h["component"].isNotNull()) | ~F.exists("kept", lambda h: h["combination"].isNotNull())
    problem = F.when(~F.forall("kept", whole), "not numbers").when(missing, "a table is missing")
    each = each.withColumn("problem", problem)
    # One pass: a document that is refused goes on as one head of nulls.
    kept = each.select("doc_id", "problem", F.explode(F.when(F.col("problem").isNull(), F.col("kept")).otherwise(F.array(F.lit(None).cast(kind)))).alias("h")).select("doc_id", "problem", "h.*")

    def bands(grades: Sequence[str]) -> Column:
        marks = F.transform("numbers", lambda v: v.cast("int"))
        names = F.array(*map(F.lit, grades))
        return F.transform(F.sequence(F.lit(1), F.lit(len(grades))), lambda i: F.struct(F.element_at(names, i).alias("grade"), F.element_at(marks, i + 1).alias("low"), (F.element_at(marks, i) - F.when(i > 1, 1).otherwise(0)).alias("high")))

    none = F.array(F.lit(None).cast("struct<grade:string,low:int,high:int>"))
    code, combined = F.col("component"), F.col("combination").isNotNull()
    found = kept.select(
        "doc_id",
        F.when(code.isNotNull(), "component").when(combined, "combination").alias("grain"),
        F.substring(code, 1, 1).cast("int").alias("component"),
        F.when(F.length(code) == 2, F.substring(code, 2, 1).cast("int")).alias("variant"),
        "combination",
        F.when(combined, F.col("components")).alias("components"),
        F.explode(F.when(code.isNotNull(), bands(COMPONENT_GRADES)).when(combined, bands(COMBINATION_GRADES)).otherwise(none)).alias("b"),
        "problem",
    )
    return found.select("doc_id", "grain", "component", "variant", "combination", "components", "b.grade", "b.low", "b.high", "problem")


def band_units(found: DataFrame) -> DataFrame:
    """Accepted bands keyed for storing: ``doc_id, grain, unit, grade, low, high``.

    The unit is a component with its variant, if it has one, or a combination; a unit that a document prints twice has the
    greater marks.
    """
    unit = F.coalesce("combination", F.concat_ws("-", F.col("component").cast("string"), F.col("variant").cast("string")))
    rows = found.where("problem IS NULL").select("doc_id", "grain", unit.alias("unit"), "grade", "low", "high")
    return rows.groupBy("doc_id", "grain", "unit", "grade").agg(F.max("low").alias("low"), F.max("high").alias("high"))


def upserted_bands(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored bands with fresh ones in their place, at both grains; grades that fresh documents don't name stay."""
    return merged(stored, fresh, ["doc_id", "grain", "unit", "grade"], {"low": newer("low"), "high": newer("high"), "is_new": ~F.col("in_old")})


def graded(marks: DataFrame, bands: DataFrame) -> DataFrame:
    """``doc_id, unit, mark, grade``: the band that a mark lies in, both ends included; null if in none.

    A unit has a handful of bands, which become one array, so marks are not joined with every band of theirs.
    """
    lists = bands.groupBy("doc_id", "unit").agg(F.collect_list(F.struct("grade", "low", "high")).alias("bands"))
    hit = F.filter("bands", lambda b: F.col("mark").between(b["low"], b["high"]))
    return marks.join(lists, ["doc_id", "unit"], "left").select("doc_id", "unit", "mark", F.array_max(F.transform(hit, lambda b: b["grade"])).alias("grade"))


def answer_grid(lines: DataFrame) -> DataFrame:
    """``doc_id, number, answer`` of a mark scheme's answer grid; lines have ``doc_id, page, line_no, line``.

    A page's head chooses its layout: "question answer mark(s)" rows of number, letter and marks, "question number key" rows
    of number and letter after the first line "key"; a page with neither is passed over. Letters are A to E in either
    case. Of three-part rows that overlap, two apart, the odd ones of a run are kept, as a scan that skips what it has
    taken would. A number with two different answers is dropped.
    """
    page = Window.partitionBy("doc_id", "page")
    w = page.orderBy("line_no")
    rows = lines.select("doc_id", "page", "line_no", F.regexp_replace("line", r"^\s+|\s+$", "").alias("token")).where("token <> ''")
    # A head is at most four words long, which may stand on as many lines; it begins on one that says "question".
    near = F.concat_ws(" ", "token", *(F.lead("token", i).over(w) for i in (1, 2, 3)))
    rows = rows.withColumn("flat", near).withColumn("answer", F.upper(F.lead("token").over(w))).withColumn("marks", F.lead("token", 2).over(w)).withColumn("at", F.row_number().over(w))
    rows = rows.withColumn("key", F.max(F.lower("token") == "key").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    flat = F.when(F.contains(F.lower("token"), F.lit("question")), F.lower(F.regexp_replace("flat", r"\s+", " ")))
    says = lambda pattern: F.coalesce(F.max(flat.rlike(pattern)).over(page), F.lit(False))
    rows = rows.withColumn("modern", says("question answer marks?")).withColumn("legacy", says("question number key")).withColumn("any_key", F.max(F.lower("token") == "key").over(page)).where("modern OR legacy")
    pair = F.col("token").rlike(r"^\d{1,9}$") & F.col("answer").rlike("^[A-E]$")
    fits = F.when(F.col("modern"), F.col("marks").rlike(r"^\d+$")).otherwise(F.coalesce("key", F.lit(False)) | ~F.col("any_key"))
    # All pairs of a page are of one layout. Those of a run are two apart, so every other one is four from the run's first.
    rows = rows.where(pair & fits).select("doc_id", "page", "modern", "at", "token", "answer")
    in_order = page.orderBy("at")
    rows = rows.withColumn("first", F.when(F.coalesce(F.col("at") - F.lag("at").over(in_order) != 2, F.lit(True)), F.col("at")))
    rows = rows.withColumn("first", F.last("first", ignorenulls=True).over(in_order.rowsBetween(*_SO_FAR))).where("NOT modern OR (at - first) % 4 = 0")
    grid = rows.groupBy("doc_id", F.col("token").cast("int").alias("number")).agg(F.min("answer").alias("answer"), F.max("answer").alias("other"))
    return grid.where("answer = other").drop("other")


def grid_problems(grid: DataFrame, expected: DataFrame) -> DataFrame:
    """Why a grid is not to be trusted: ``doc_id, kind, first, last``; ``expected`` has ``doc_id, n``.

    ``count``: answers found and expected; ``missing``: a run of numbers up to the expected one; ``start``: the first number
    if it isn't 1. A document whose grid is empty has the first alone.
    """
    counted = grid.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("found"), F.array_sort(F.collect_list("number")).alias("numbers"))
    both = expected.select("doc_id", F.col("n").cast("int").alias("n")).join(counted, "doc_id", "left")
    row = lambda kind, first, last: F.struct(F.lit(kind).alias("kind"), first.cast("int").alias("first"), last.cast("int").alias("last"))
    found, least, n = F.coalesce("found", F.lit(0)), F.get("numbers", F.lit(0)), F.col("n")
    edges = F.concat(F.filter("numbers", lambda x: x.between(1, n)), F.array(n + 1))
    before = lambda i: F.coalesce(F.when(i > 0, F.get("edges", i - 1)), F.lit(0))
    missing = F.filter(F.transform("edges", lambda x, i: F.when(x > before(i) + 1, row("missing", before(i) + 1, x - 1))), lambda r: r.isNotNull())
    whole = F.array(F.when(found != n, row("count", found, n)), F.when(least != 1, row("start", least, least)))
    told = F.concat(F.filter(whole, lambda r: r.isNotNull()), F.coalesce(missing, F.array().cast("array<struct<kind:string,first:int,last:int>>")))
    return both.withColumn("edges", edges).select("doc_id", F.explode(told).alias("r")).select("doc_id", "r.*")
