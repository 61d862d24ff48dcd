import random

import pytest
from pyspark.sql import functions as F

from evidenta.functions import text as X
from evidenta.operators import selection, tables

GRID = "header array<string>, rows array<array<string>>"


@pytest.mark.parametrize(("header", "values", "index"), [("S.no", ["01", "02", "03"], True), ("#", ["1", "2", "3"], True), ("", ["1", "2", "3"], True), ("No.", ["0", "1", "2"], True), ("Fold", ["1", "2", "3"], False), ("No.", ["1", "3", "4"], False), ("No.", ["2", "3", "4"], False), ("ID", ["1", "2", ""], False), ("Epochs", ["10", "20", "30"], False), ("No.", ["1"], False)])
def test_index_columns(spark, header, values, index):
    df = spark.createDataFrame([(header, values)], "h string, v array<string>")
    assert df.select(tables.is_index(F.col("h"), F.col("v"))).first()[0] is index


def problem(spark, header, body):
    df = spark.createDataFrame([(header, body)], GRID)
    return df.select(tables.problem(F.col("header"), F.col("rows"))).first()[0]


def test_grid_problems(spark):
    good = [["a", "1.0"], ["b", "2.0"]]
    assert problem(spark, ["Model", "Dice"], good) is None
    assert problem(spark, ["Model"], good) == "too_few_columns:1" and problem(spark, ["Model", "Dice"], good[:1]) == "too_few_body_rows:1"
    assert problem(spark, ["Model", "1.0"], good) == "header_has_no_words" and problem(spark, ["Model", "x" * 61], good) == "header_cell_too_long"
    assert problem(spark, ["Model", "Dice"], [["a", "y" * 201], ["b", "2"]]) == "prose_like_cell"
    assert problem(spark, ["Model", "Dice"], [["a\nb\nc", "1.0\n2.0\n3.0"], ["d", "4"]]) == "stacked_records"
    line = "and so the text of a paragraph goes on"
    assert problem(spark, ["Model", "Text"], [["", line], [None, line]]) == "wrapped_text_rows"


def test_grid_and_cells(spark):
    rows = [(["Model", "Dice", None], [["", "WT", "TC"], ["U-Net", "85.1", "7.2"], [None, "86", None], ["Ours", "91.4"]])]
    made = spark.createDataFrame(rows, GRID).select(tables.grid(F.col("header"), F.col("rows")).alias("g")).select("g.*")
    assert made.first()["header"] == ["Model", "Dice / WT", "Dice / TC"]
    got = [(r["row_label"], r["column_header"], r["value"], r["row"], r["col"]) for r in tables.cells(made).orderBy("row", "col").collect()]
    assert got == [("U-Net", "Dice / WT", "85.1", 1, 1), ("U-Net", "Dice / TC", "7.2", 1, 2), ("U-Net", "Dice / WT", "86", 2, 1), ("Ours", "Dice / WT", "91.4", 3, 1)]
    index = spark.createDataFrame([(["#", "Score", "Name"], [["1", "5", "ab"], ["2", "6", "cd"]])], "header array<string>, body array<array<string>>")
    assert {(r["row_label"], r["value"]) for r in tables.cells(index).collect()} == {("ab", "1"), ("ab", "5"), ("cd", "2"), ("cd", "6")}


def test_captions_pair_one_to_one(spark):
    captions = spark.createDataFrame([(1, 0, 0.0, 100.0, 50.0, 110.0), (1, 1, 0.0, 200.0, 50.0, 210.0), (1, 2, 500.0, 200.0, 550.0, 210.0)], "page int, caption_no int, x0 double, y0 double, x1 double, y1 double")
    grids = spark.createDataFrame([(1, 0, 0.0, 120.0, 60.0, 190.0), (1, 1, 0.0, 240.0, 60.0, 300.0), (1, 2, 0.0, 900.0, 60.0, 950.0)], "page int, grid_no int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["caption_no"], r["grid_no"], r["gap"]) for r in tables.pair_captions(captions, grids, ["page"]).collect()}
    assert got == {(0, 0, 10.0), (1, 1, 30.0)}


def test_greedy_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(p, k, rng.choice([0.5, 1.0, 1.5]), rng.randrange(200, 3000), [rng.choice(["1.5", "22", "37", "0.9"]) for _ in range(rng.randrange(4))]) for p in range(8) for k in range(20)]
    want = set()
    for p in range(8):
        taken = []
        for _, k, _, n, a in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[2], r[1])):
            main = max({*a}, key=lambda x: (a.count(x), -a.index(x))) if a else None
            if len(taken) >= 10:
                break
            if taken and sum(t[1] for t in taken) + n > 9000 or a and any(len({*a} & t[2]) / len({*a}) > 0.8 for t in taken) or main and sum(t[3] == main for t in taken) >= 2:
                continue
            taken.append((k, n, {*a}, main))
        want |= {(p, t[0]) for t in taken}
    df = spark.createDataFrame(rows, "paper_id int, chunk_index int, score double, n_chars int, anchors array<string>")
    assert {tuple(r) for r in selection.greedy(df).collect()} == want


def test_queries_and_selection(spark):
    chunks = spark.createDataFrame([(1, 0, "results", "heading", "4 Results of the study"), (1, 1, "results", "paragraph", "We see Dice and accuracy of 91.5, and dice again. " + "word " * 1500), (1, 2, "results", "table", "Table 1. Scores of models. More text"), (1, 3, "references", "table", "Reference list of models"), (1, 4, "method", "paragraph", "word " * 1500), (2, 0, "method", "paragraph", "short paper")], "paper_id int, chunk_index int, section string, block_type string, text string")
    assert {tuple(r) for r in selection.own_queries(chunks).collect()} == {(1, "Dice accuracy results score table"), (1, "4 Results of the study"), (1, "Table 1")} - {(1, "Table 1")} | {(1, "Dice accuracy results score table")}
    vectors = spark.createDataFrame([(1, k, [float(k), 1.0]) for k in range(5)], "paper_id int, chunk_index int, vector array<double>")
    queries = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [-1.0, 0.0])], "paper_id int, query_no int, query_vector array<double>")
    ranks = selection.best_ranks(vectors, queries, 2)
    assert {tuple(r) for r in ranks.collect()} == {(1, 4, 0), (1, 3, 1), (1, 0, 0), (1, 1, 1)}
    aware = selection.content_aware(chunks, ranks)
    assert {r["chunk_index"] for r in aware.collect()} <= {0, 1, 3, 4}
    got = selection.select(chunks, ranks, aware).collect()
    assert {r["mode"] for r in got if r["paper_id"] == 2} == {"passthrough"} and {r["mode"] for r in got if r["paper_id"] == 1} == {"content_aware"}
    assert sum(r["take"] for r in got if r["paper_id"] == 1) <= 2500
    legacy = selection.select(chunks.drop("block_type"), ranks, aware).where("paper_id = 1").collect()
    assert {r["mode"] for r in legacy} == {"legacy_fallback"} and [r["chunk_index"] for r in legacy][:2] == [0, 1]


def test_text_rules(spark):
    df = spark.createDataFrame([("x",)], "t string")
    val = lambda c: df.select(c).first()[0]
    assert val(X.section(F.lit(" 3 Experimental Setup"))) == "experimental_setup" and val(X.section(F.lit(""))) == "body" and val(X.section(F.lit("Odd Title"))) == "odd title"
    assert val(X.is_heading(F.lit("2.1 Our Thing"))) and val(X.is_heading(F.lit("Related Work of ours"))) and not val(X.is_heading(F.lit("we did a thing")))
    assert val(X.is_table_caption(F.lit("Table 2: x"))) and not val(X.is_table_caption(F.lit("tables are")))
    assert val(X.dataset_names(F.lit("We evaluated on COCO and the FooBar dataset, M&Ms too; The Results dataset"))) == ["COCO", "FooBar", "M&Ms"]
    assert val(X.empirical(F.lit("A survey of 20 participants"))) and not val(X.empirical(F.lit("A proof of a theorem"))) and not val(X.empirical(F.lit(" ")))
    assert val(X.domain(F.lit("patients in a clinical hospital cohort"))) == "biomed" and val(X.domain(F.lit("a benchmark"))) == "cs_ml"
    assert val(X.loops(F.lit("abcd" * 200))) and not val(X.loops(F.lit("x")))
    assert val(X.prompt_phrases(F.lit("in a 5-HOUR work session"))) == ["5-hour work session"]
    assert val(X.external_link(F.lit(""), F.lit("2401.1"))) == "https://arxiv.org/abs/2401.1" and val(X.external_link(F.lit(None).cast("string"), F.lit(None).cast("string"))) is None
    assert val(X.normal_title(F.lit("A “B”–c.  "))) == 'a "b"-c' and val(X.without_tag(F.lit("Title (tag)"))) == "Title"
