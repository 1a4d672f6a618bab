"""Grids of placed words on golden pages, and rows of cells between delimiters."""

import pytest

from lectern.operators import tables as tb

SCHEMA = "page long, x double, y double, width double, height double, text string"


def page(number, *rows):
    """(number, x, y, width, height, text) of rows (y, (x, text), ...); a sign is 6 wide, a line 12 high."""
    return [(number, float(x), float(y), 6.0 * len(t), 12.0, t) for y, *cells in rows for x, t in cells]


def row(y, *texts):
    return (y, *zip((50, 220, 400), texts))


def four(y, *texts):
    return (y, *zip((50, 130, 330, 410), texts))


ABC = [row(20, "A", "B", "C"), row(40, "1", "2", "3"), row(60, "4", "5", "6")]
GOLDEN = {
    "grid": ([row(20, "Drug", "Mechanism", "Effect"), row(40, "Atropine", "Muscarinic antagonist", "Increased HR"), row(60, "Propranolol", "beta1 blocker", "Decreased HR")], [("STRONG", "Drug\tMechanism\tEffect\nAtropine\tMuscarinic antagonist\tIncreased HR\nPropranolol\tbeta1 blocker\tDecreased HR")]),
    "merged row": ([row(20, "Drug", "Mechanism", "Effect"), (40, (50, "Merged heading"), (400, "Outcome")), row(60, "Atropine", "Antagonist", "Increased HR")], [("LIMITED", "Drug Mechanism Effect\nMerged heading Outcome\nAtropine Antagonist Increased HR")]),
    "spanning title": ([(20, (50, "Therapeutics by receptor and response")), row(40, "Drug", "Receptor", "Response"), row(60, "Atropine", "M1", "Tachycardia")], [("LIMITED", "Therapeutics by receptor and response\nDrug Receptor Response\nAtropine M1 Tachycardia")]),
    "prose in two columns": ([(20, (50, "Left-column prose sentence"), (320, "Right-column prose sentence")), (40, (50, "More explanatory prose"), (320, "More explanatory prose")), (90, (50, "Ordinary paragraph without a table"))], []),
    "two columns": ([(20, (50, "Nerve"), (300, "Function")), (40, (50, "Vagus"), (300, "Parasympathetic")), (60, (50, "Radial"), (300, "Wrist extension"))], [("STRONG", "Nerve\tFunction\nVagus\tParasympathetic\nRadial\tWrist extension")]),
    "a sentence in a cell": ([*ABC, row(80, "7", "ends here.", "9")], []),
    "side by side": ([four(20, "Drug", "Dose", "Nerve", "Act"), four(40, "A", "1mg", "Vagus", "Slow"), four(60, "B", "2mg", "Radial", "Extend")], [("LIMITED", "Drug Dose Nerve Act\nA 1mg Vagus Slow\nB 2mg Radial Extend")]),
    "words over each other": ([(y, (50, "Aspirin"), (70, a), (300, "Relief")) for y, a in ((20, "5mg"), (40, "6mg"), (60, "7mg"))], [("LIMITED", "\n".join(f"Aspirin{a} Relief" for a in ("5mg", "6mg", "7mg")))]),
    "two tables": ([*ABC, (110, (50, "Paragraph that parts two regions")), *((y + 140, *cells) for y, *cells in ABC)], [("STRONG", "A\tB\tC\n1\t2\t3\n4\t5\t6")] * 2),
    "a shifted column": ([row(20, "A", "B", "C"), row(40, "1", "2", "3"), (60, (50, "4"), (229, "5"), (400, "6"))], [("LIMITED", "A B C\n1 2 3\n4 5 6")]),
    "two rows": (ABC[:2], [("LIMITED", "A B C\n1 2 3")]),
    "one row": (ABC[:1], []),
    # baselines that creep: each word is near the one before, the third is too far from the first
    "creeping baseline": ([(20, (50, "A")), (25, (220, "B")), (30, (400, "C"))], []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [w for n, (content, _) in enumerate(GOLDEN.values()) for w in page(n, *content)]
    rows += [(99, None, 5.0, 1.0, 1.0, "no place"), (99, 1.0, float("nan"), 1.0, 1.0, "no place"), (99, 1.0, 5.0, 1.0, 1.0, " "), (99, 1.0, 5.0, 1.0, 1.0, None)]
    rows += [(None, *w[1:]) for w in page(0, *ABC)]
    words = spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)
    return words, tb.position_tables(words).orderBy("page", "table_no").collect()


@pytest.mark.parametrize("n", range(len(GOLDEN)), ids=list(GOLDEN))
def test_golden_pages(found, n):
    assert [(r.quality, r.content) for r in found[1] if r.page == n] == list(GOLDEN.values())[n][1]


def test_words_without_place_and_page(found):
    assert [(r.page, r.rows, r.columns, r.quality) for r in found[1] if r.page in (99, None)] == [(None, 3, 3, "STRONG")]


def test_cells_make_the_tables(found):
    words, tables = found
    content = {}
    for r in sorted(tb.position_cells(words).collect(), key=lambda r: (r.page or -1, r.table_no, r.row_no, r.column_no)):
        content.setdefault((r.page, r.table_no), {}).setdefault(r.row_no, []).append(r.text)
    sep = {"STRONG": "\t", "LIMITED": " "}
    assert {(r.page, r.table_no): r.content for r in tables} == {k: "\n".join(sep[q].join(x) for x in v.values()) for k, v in content.items() for q in [next(r.quality for r in tables if (r.page, r.table_no) == k)]}


def test_row_goes_by_its_first_word(spark):
    words = spark.createDataFrame(page(1, (20, (50, "A")), (25, (220, "B")), (30, (400, "C"))), SCHEMA)
    assert [(r.row_no, r.y, [x.text for x in r.cells]) for r in tb.text_rows(words, ["page"]).orderBy("row_no").collect()] == [(1, 20.0, ["A", "B"]), (2, 30.0, ["C"])]


def test_no_words(spark):
    assert tb.position_tables(spark.createDataFrame([], SCHEMA)).count() == 0


def test_delimited_content(spark):
    lines = ["| a | b |", "|c|d|", "x\ty", " z \tw", "one | two", "a||b", "p\tq|r", "", None]
    df = spark.createDataFrame([("m", 1, n, t) for n, t in enumerate(lines)], "material_id string, page_number long, line_no long, line string")
    assert sorted((r.first_line, r.rows, r.width, r.content) for r in tb.delimited_tables(df).collect()) == [(0, 2, 2, "a | b\nc | d"), (2, 2, 2, "x\ty\nz\tw")]


def test_tables_are_shuffled_by_page_only(spark):
    """the texts of tables were dealt once more than their rows."""
    words = spark.createDataFrame([(p, float(y), float(x), 10.0, 5.0, f"w{x}") for p in (1, None) for y in (0, 12, 24) for x in (0, 100)], "page long, y double, x double, width double, height double, text string")
    found = tb.position_tables(words)
    assert sorted((r.page or 0, r.table_no, r.rows, r.quality, r.content) for r in found.collect()) == [(p, 1, 3, "STRONG", "\n".join(["w0\tw100"] * 3)) for p in (0, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2
