"""Documents as blocks: lines of pages, and articles in JATS."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenta.functions import text as X

BLOCKS = "block_no int, section string, node string, block_type string, text string, header array<string>, body array<array<string>>"


def page_blocks(lines: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, block_no, page, section, block_type, text): lines in reading order with the section that they stand in.

    `lines` has paper, page, x, y and text. A line is read by its band of three points, then from the left; a heading names the
    section up to the next one.
    """
    w = Window.partitionBy(paper).orderBy("page", F.bround(F.col("y") / 3, 0), "x")
    named = lines.where(X.strip(F.col("text")) != "").withColumn("heading", X.is_heading(F.col("text")) & (F.length("text") <= 80))
    label = F.last(F.when(F.col("heading"), X.section(F.regexp_replace("text", r"^\s*[\dIVXivx.]+\s+", ""))), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    kind = F.when(F.col("heading"), "heading").when(X.is_table_caption(F.col("text")), "table").when(F.col("text").rlike(r"(?i)^\s*fig(ure|\.)\s*\d"), "figure_caption").otherwise("paragraph")
    return named.select(paper, (F.row_number().over(w) - 1).alias("block_no"), "page", F.coalesce(label, F.lit("body")).alias("section"), kind.alias("block_type"), X.strip(F.col("text")).alias("text"))


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _text(e: ET.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def _grid(table: ET.Element) -> tuple[list[str], list[list[str]]]:
    """Header (the first row) and body of a table; a cell that spans columns is followed by empty ones."""
    rows = []
    for tr in (e for e in table.iter() if _name(e) == "tr"):
        row: list[str] = []
        for cell in (c for c in tr if _name(c) in ("td", "th")):
            row += [_text(cell)] + [""] * (int(cell.get("colspan") or 1) - 1)
        rows.append(row)
    return (rows[0], rows[1:]) if rows else ([], [])


def jats(data: str | bytes | None) -> list[dict]:
    """Blocks of an article: abstract, headings, paragraphs, tables and captions, with section and node path; none if it is no XML."""
    try:
        root = ET.fromstring(data or "")
    except ET.ParseError:
        return []
    out: list[dict] = []

    def add(section: str, node: str, kind: str, text: str, header=None, body=None) -> None:
        if text or header:
            out.append({"block_no": len(out), "section": section, "node": node, "block_type": kind, "text": text, "header": header, "body": body})

    def canonical(label: str, default: str) -> str:
        low = label.strip().lower()
        return next((name for name, words in X.SECTIONS if any(w in low for w in words)), default)

    def walk(e: ET.Element, section: str, node: str) -> None:
        seen: dict[str, int] = {}
        for child in e:
            kind = _name(child)
            seen[kind] = seen.get(kind, 0) + 1
            at = f"{node}/{kind}[{seen[kind]}]"
            if kind == "sec":
                title = _text(next((c for c in child if _name(c) == "title"), None))
                own = canonical(title, section) if title else section
                add(own, at, "heading", title)
                walk(child, own, at)
            elif kind == "p":
                add(section, at, "paragraph", _text(child))
            elif kind in ("table-wrap", "fig"):
                caption = " ".join(x for x in (_text(next((c for c in child if _name(c) == n), None)) for n in ("label", "caption")) if x)
                table = next((c for c in child.iter() if _name(c) == "table"), None)
                add(section, at, "table" if kind == "table-wrap" else "figure_caption", caption, *(_grid(table) if table is not None else ()))
            elif kind != "title":
                walk(child, section, at)

    for e in root.iter():
        if _name(e) == "abstract":
            add("abstract", "abstract", "abstract", _text(e))
        elif _name(e) == "body":
            walk(e, "body", "body")
    return out


def jats_blocks(articles: DataFrame, paper: str = "paper_id", xml: str = "xml") -> DataFrame:
    """(paper, block...): the blocks of every article (S8); one that is no XML gives none. Articles are read one at a time."""
    kind = dict(articles.dtypes)[paper]
    schema = pa.schema([(paper, pa.string()), ("block_no", pa.int32()), ("section", pa.string()), ("node", pa.string()), ("block_type", pa.string()), ("text", pa.string()), ("header", pa.list_(pa.string())), ("body", pa.list_(pa.list_(pa.string())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = [{paper: key.as_py()} | b for b in jats(data.as_py())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    made = articles.select(F.col(paper).cast("string").alias(paper), xml).mapInArrow(run, f"{paper} string, {BLOCKS}")
    return made.withColumn(paper, F.col(paper).cast(kind))


def with_fallback(blocks: DataFrame, abstracts: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Blocks of papers, and for a paper without any its abstract as the only one."""
    rest = abstracts.where(X.strip(F.col("abstract")) != "").join(blocks.select(paper).distinct(), paper, "left_anti")
    single = rest.select(paper, F.lit(0).alias("block_no"), F.lit("abstract").alias("section"), F.lit("abstract").alias("block_type"), X.strip(F.col("abstract")).alias("text"))
    return blocks.select(paper, "block_no", "section", "block_type", "text").unionByName(single)


def summary(blocks: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, n_blocks, sections, has_results, has_method, n_tables) of each document (A3)."""
    return blocks.groupBy(paper).agg(F.count("*").alias("n_blocks"), F.array_sort(F.collect_set("section")).alias("sections"), F.bool_or(F.col("section") == "results").alias("has_results"), F.bool_or(F.col("section") == "method").alias("has_method"), F.count_if(F.col("block_type") == "table").alias("n_tables"))
