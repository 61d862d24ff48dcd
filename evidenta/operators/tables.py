"""Grids of tables as arrays of rows: their cleaning, checks and cells; and the pairing of captions with grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidenta.functions import text as X

#: Limits of a grid, and the shapes of index columns.
COLUMNS, ROWS, HEADER_CHARS, CELL_CHARS, WRAPPED_CHARS = 2, 2, 60, 200, 30
INDEX_VALUE = r"^\(?(\d{1,3})\)?[.)]?$"
INDEX_HEADER = r"(?i)^(?:s\.?\s*no\.?|sl\.?\s*no\.?|sr\.?\s*no\.?|no\.?|nr\.?|#|index|idx|id|rank|serial(?:\s*no\.?)?)$"
WORD = r"\p{L}{2,}"
#: The largest gap between caption and grid, the least share of the narrower that both cover, and the handicap of a grid above.
GAP, SHARED, ABOVE = 60.0, 0.3, 0.5

_none = lambda kind: F.array().cast(f"array<{kind}>")


def carried(values: Column) -> Column:
    """An array in which a null repeats the last value before it."""
    last = lambda a, x: F.concat(a, F.array(F.coalesce(x, F.element_at(a, -1))))
    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, 1), last)).otherwise(values)


def grid(header: Column, rows: Column) -> Column:
    """(header, body): a header cell that a merged one covers repeats it, rows are as wide as the header, and a second row of
    headers above rows of numbers is folded into the first as "top / sub" (K2)."""
    names = F.transform(carried(header), X.one_line)
    wide = F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.size(names) - F.size(r), F.lit(0)))), 1, F.size(names)))
    digit = lambda r: F.exists(r, lambda c: X.text_of(c).rlike(r"\d"))
    second = (F.size(wide) > ROWS) & ~digit(F.get(wide, F.lit(0))) & F.forall(F.slice(wide, 2, F.greatest(F.size(wide) - 1, F.lit(1))), digit)
    folded = F.zip_with(names, F.transform(F.get(wide, F.lit(0)), X.one_line), lambda h, s: F.when((h != "") & (s != "") & (h != s), F.concat(h, F.lit(" / "), s)).when(h != "", h).otherwise(s))
    return F.when(second, F.struct(folded.alias("header"), F.slice(wide, 2, F.size(wide)).alias("body"))).otherwise(F.struct(names.alias("header"), wide.alias("body")))


def problem(header: Column, body: Column) -> Column:
    """Why a grid is no table of records; null if it is one."""
    lines = lambda c: F.filter(F.split(X.text_of(c), r"\r\n|\r|\n"), lambda x: X.strip(x) != "")
    shape = lambda x: F.regexp_replace(X.strip(x), r"\d+", "9")

    def stacked(r: Column) -> Column:
        k = F.size(lines(F.get(r, F.lit(0))))
        beside = lambda c: (F.size(lines(c)) == k) & F.forall(lines(c), lambda x: x.rlike(r"\d")) & (F.size(F.array_distinct(F.transform(lines(c), shape))) == 1)
        return (k >= 2) & F.exists(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(1))), beside)

    rest = F.slice(header, 2, F.greatest(F.size(header) - 1, F.lit(1)))
    wrapped = lambda r: (X.text_of(F.get(r, F.lit(0))) == "") & F.exists(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(1))), lambda c: X.text_of(c).rlike(r"^\p{Ll}") & (F.length(X.one_line(c)) >= WRAPPED_CHARS))
    return (
        F.when(F.size(header) < COLUMNS, F.concat(F.lit("too_few_columns:"), F.size(header).cast("string")))
        .when(F.size(body) < ROWS, F.concat(F.lit("too_few_body_rows:"), F.size(body).cast("string")))
        .when(F.exists(header, lambda h: F.length(h) > HEADER_CHARS), "header_cell_too_long")
        .when(~F.exists(rest, lambda h: h.rlike(WORD)), "header_has_no_words")
        .when(F.exists(body, lambda r: F.exists(r, lambda c: F.length(X.one_line(c)) > CELL_CHARS)), "prose_like_cell")
        .when(F.exists(body, stacked), "stacked_records")
        .when(F.size(F.filter(body, wrapped)) >= 2, "wrapped_text_rows")
    )


def is_index(header: Column, values: Column) -> Column:
    """Whether a column counts its rows: whole numbers in order from 0 or 1, zero-padded, or under such a header or none."""
    full = F.forall(values, lambda v: X.text_of(v).rlike(INDEX_VALUE))
    numbers = F.transform(values, lambda v: F.regexp_extract(X.text_of(v), INDEX_VALUE, 1).try_cast("int"))
    first = F.get(numbers, F.lit(0))
    in_order = F.forall(F.transform(numbers, lambda n, i: n - i == first), lambda x: x)
    padded = F.exists(values, lambda v: X.text_of(v).rlike(r"^\(?0\d"))
    return (F.size(values) >= ROWS) & full & first.isin(0, 1) & F.coalesce(in_order, F.lit(False)) & (padded | (X.text_of(header) == "") | header.rlike(INDEX_HEADER))


def label_column(header: Column, body: Column) -> Column:
    """Which column names the rows: the first, or if that is an index, the first whose values are all words and differ."""
    column = lambda k: F.transform(body, lambda r: F.get(r, k))
    names = lambda v: (F.size(v) >= ROWS) & F.forall(v, lambda x: X.text_of(x).rlike(WORD)) & (F.size(F.array_distinct(v)) == F.size(v))
    later = F.when(F.size(header) > 1, F.sequence(F.lit(1), F.size(header) - 1)).otherwise(_none("int"))
    found = F.get(F.filter(later, lambda k: names(column(k))), F.lit(0))
    return F.when(is_index(F.get(header, F.lit(0)), column(F.lit(0))), F.coalesce(found, F.lit(0))).otherwise(F.lit(0))


def cells(tables: DataFrame, header: str = "header", body: str = "body") -> DataFrame:
    """A row for every filled cell under a header: row_label, column_header, value, row, col (K3); other columns pass through."""
    kept = [c for c in tables.columns if c not in (header, body)]
    lab = tables.withColumn("__label", label_column(F.col(header), F.col(body)))
    # a label that spans rows is carried down; beyond the first row an empty text stays empty
    labels = carried(F.transform(F.col(body), lambda r, i: F.when((i == 0) & F.get(r, F.col("__label")).isNull(), "").otherwise(F.get(r, F.col("__label")))))
    rows = lab.withColumn("__labels", labels).select(*kept, header, "__label", "__labels", F.posexplode(body).alias("r", "__row"))
    each = rows.select(*kept, header, "__label", X.one_line(F.get("__labels", F.col("r"))).alias("row_label"), (F.col("r") + 1).alias("row"), F.posexplode("__row").alias("col", "raw"))
    named = each.select(*kept, "row_label", F.get(header, F.col("col")).alias("column_header"), X.one_line(F.col("raw")).alias("value"), "row", "col", "__label")
    return named.where("col <> __label and value <> '' and column_header <> ''").drop("__label")


def pair_captions(captions: DataFrame, grids: DataFrame, page: list[str]) -> DataFrame:
    """(page, caption_no, grid_no, gap): captions with the grid beside them, one to one by ascending gap.

    `captions` has the columns of `page`, caption_no, x0, y0, x1, y1, `grids` the same with grid_no. A grid above its caption
    takes a handicap. Which pair is taken depends on those before it, so a page is one group; a page has few of both.
    """
    a, b = captions.alias("a"), grids.alias("b")
    gap = F.when(F.col("b.y0") >= F.col("a.y1"), F.col("b.y0") - F.col("a.y1")).when(F.col("a.y0") >= F.col("b.y1"), F.col("a.y0") - F.col("b.y1")).otherwise(0.0)
    both = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    narrow = F.least(F.col("a.x1") - F.col("a.x0"), F.col("b.x1") - F.col("b.x0"))
    rank = gap + F.when(F.col("b.y0") < F.col("a.y0"), ABOVE).otherwise(0.0)
    near = a.join(b, page).where((gap <= GAP) & (both >= SHARED * narrow)).select(*page, "caption_no", "grid_no", gap.alias("gap"), rank.alias("rank"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used_c, used_g, out = set(), set(), []
        for r in pdf.sort_values(["rank", "caption_no", "grid_no"]).itertuples():
            if r.caption_no not in used_c and r.grid_no not in used_g:
                used_c.add(r.caption_no)
                used_g.add(r.grid_no)
                out.append(r.Index)
        return pdf.loc[out].drop(columns="rank")

    return near.groupBy(*page).applyInPandas(greedy, near.drop("rank").schema)
