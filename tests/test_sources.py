import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evidenta.operators import clustering, tables as T
from evidenta.sources import documents, search, tables


def test_backoff_and_bounds():
    waits, answers = [], iter([(429, {"Retry-After": "7"}, b""), (503, {}, b""), (500, {"retry-after": "900"}, b""), (200, {}, b"ok")])
    assert search.get("u", lambda u: next(answers), waits.append) == b"ok" and waits == [7.0, 2.0, 60.0]
    assert search.get("u", lambda u: (400, {}, b"")) is None
    with pytest.raises(OSError, match="404"):
        search.get("u", lambda u: (404, {}, b""))
    with pytest.raises(OSError, match="503"):
        search.get("u", lambda u: (503, {}, b""), lambda s: None)
    assert not search.fetched("nowhere://x")["ok"] and search.fetched("u", lambda u: (200, {"Content-Type": "a/b; c"}, b"x"))["content_type"] == "a/b"


def test_paged_search(spark, tmp_path):
    rows = [{"paperId": str(k), "title": f"T{k}", "year": 2000 + k % 10, "extra": 1} for k in range(230)]
    for k in range(0, 500, 100):
        (tmp_path / f"page-{k}.json").write_text(json.dumps({"data": rows[k : k + 100]}))
    search.register(spark)
    df = spark.read.format("paper_search").option("address", f"file://{tmp_path}/page-{{offset}}.json").option("pool", 500).load()
    assert df.count() == 230 and df.rdd.getNumPartitions() == 5
    few = spark.read.format("paper_search").schema("paperId string, year int").option("address", f"file://{tmp_path}/page-{{offset}}.json").option("pool", 100).option("years", "2003-2004").load()
    assert few.count() == 20 and few.columns == ["paperId", "year"]


def test_table_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/papers.json").write_text(json.dumps([{"id": 1, "names": ["a", 'b "c"']}, {"id": 2, "names": None}]))
    df = tables.read_json_table(spark, f"{tmp_path}/in/papers.json", "id int, names array<string>")
    assert df.count() == 2
    tables.write_csv(df, f"{tmp_path}/csv")
    assert {tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").collect()} == {("1", 'a; b "c"'), ("2", None)}
    tables.write_vectors(df.withColumn("paper_id", F.col("id")), f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").count() == 2
    m = tables.manifest(spark, f"{tmp_path}/in", ("papers.json",)).collect()
    assert [r["sha256"] for r in m] == [hashlib.sha256((tmp_path / "in/papers.json").read_bytes()).hexdigest()]
    with pytest.raises(FileNotFoundError, match="other"):
        tables.manifest(spark, f"{tmp_path}/in", ("other.json",))
    (tmp_path / "in/my_first paper.pdf").write_bytes(b"%PDF")
    r = tables.uploads(spark, f"{tmp_path}/in").first()
    assert r["title"] == "my first paper" and len(r["paperId"]) == 12
    page = tables.html_report(spark.createDataFrame([("<b>", ["x", "y"])], "a string, b array<string>"), "T&C")
    assert "<td>&lt;b&gt;</td><td>x; y</td>" in page and "T&amp;C" in page


ARTICLE = """<article><front><abstract><p>We say   this.</p></abstract></front><body>
<sec><title>2 Materials and Methods</title><p>First.</p><sec><title>Inner part</title><p>Second.</p></sec></sec>
<sec><title>Results</title><table-wrap><label>Table 1</label><caption>Scores</caption><table><tr><th>Model</th><th>Dice</th><th>IoU</th></tr><tr><td>U-Net</td><td colspan="2">85.1</td></tr><tr><td>Ours</td><td>91.4</td><td>80</td></tr></table></table-wrap><fig><caption>A figure</caption></fig></sec></body></article>"""


def test_jats_blocks_and_cells(spark):
    df = spark.createDataFrame([(1, ARTICLE), (2, "no xml"), (3, None)], "paper_id long, xml string")
    got = documents.jats_blocks(df)
    assert [(r["section"], r["block_type"], r["text"]) for r in got.orderBy("block_no").collect()] == [
        ("abstract", "abstract", "We say this."), ("method", "heading", "2 Materials and Methods"), ("method", "paragraph", "First."), ("method", "heading", "Inner part"), ("method", "paragraph", "Second."),
        ("results", "heading", "Results"), ("results", "table", "Table 1 Scores"), ("results", "figure_caption", "A figure"),
    ]
    cells = T.cells(got.where("header is not null").select("paper_id", F.col("text").alias("caption"), "header", "body"))
    assert {(r["row_label"], r["column_header"], r["value"]) for r in cells.collect()} == {("U-Net", "Dice", "85.1"), ("Ours", "Dice", "91.4"), ("Ours", "IoU", "80")}
    abstracts = spark.createDataFrame([(1, "a"), (2, " only this "), (3, "")], "paper_id long, abstract string")
    full = documents.with_fallback(got, abstracts)
    assert [r["text"] for r in full.where("paper_id = 2").collect()] == ["only this"] and full.where("paper_id = 3").count() == 0
    s = documents.summary(full).where("paper_id = 1").first()
    assert (s["n_blocks"], s["sections"], s["has_results"], s["has_method"], s["n_tables"]) == (8, ["abstract", "method", "results"], True, True, 1)


def test_page_blocks(spark):
    lines = [(1, 1, 0.0, 10.0, "Abstract"), (1, 1, 50.0, 31.0, "right"), (1, 1, 0.0, 30.0, "left"), (1, 1, 0.0, 50.0, "3 Results"), (1, 2, 0.0, 5.0, "Table 2: x"), (1, 2, 0.0, 9.0, " ")]
    got = documents.page_blocks(spark.createDataFrame(lines, "paper_id int, page int, x double, y double, text string"))
    assert [(r["section"], r["block_type"], r["text"]) for r in got.orderBy("block_no").collect()] == [("abstract", "heading", "Abstract"), ("abstract", "paragraph", "left"), ("abstract", "paragraph", "right"), ("results", "heading", "3 Results"), ("results", "table", "Table 2: x")]


def test_clusters(spark):
    rows = [(k, [float(10 * (k % 3)) + 0.1 * (k // 3), float(k % 3)]) for k in range(18)]
    df = spark.createDataFrame(rows, "paper_id int, vec array<double>")
    out, score = clustering.cluster(df, "vec", 3, seeds=(42,))
    assert out.count() == 18 and score > 0.9 and len({(r["paper_id"] % 3, r["cluster"]) for r in out.collect()}) == 3
    assert clustering.cluster(df.limit(4), "vec", 6, seeds=(42,))[0].select("cluster").distinct().count() <= 3
    assert sorted(r["cluster"] for r in clustering.cluster(df.limit(2), "vec")[0].collect()) == [0, 1]
    flat = df.withColumn("flat", F.array(F.lit(0.0), F.lit(1.0)))
    assert clustering.with_fallback(flat, "flat", "vec", k=3, seeds=(42,))[2] == "topic" and clustering.with_fallback(flat, "vec", "flat", k=3, seeds=(42,))[2] == "method"
