import duckdb
import pytest

import __spark_entry__ as entry
from evidenta.plans import catalogue

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return [plain(x) for x in v] if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    result = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(plain(list(r))) for r in df.select(*names).collect()) == sorted(str(plain(list(r))) for r in result.fetchall())


def test_vector_search_takes_every_50th_row(spark):
    e = spark.read.parquet(f"{DIR}/embeddings.parquet")
    probes = {r["vec_id"] for r in e.where("vec_id % 50 = 0").collect()}
    assert len(probes) > 1
    for name, k in (("vector_topk_every_50th", 10), ("vector_topk_every_50th_within_group", 5)):
        rows = catalogue.QUERIES[name](spark, DIR).collect()
        assert {r["probe"] for r in rows} == probes and len(rows) == k * len(probes)
        assert all(r["vec_id"] == r["probe"] for r in rows if r["rank"] == 1)


def test_clean_text_cuts_back_matter(spark):
    from evidenta.functions import text as X

    cases = {"Body\nReferences\n[1] x": "Body", "a\n  ACKNOWLEDGMENTS \nb": "a", "a\nAcknowledgements\nb\nBibliography\nc": "a", "see References\nb": "see References\nb", "a\n\n\n\nb": "a\n\nb", "no heading": "no heading", "": ""}
    df = spark.createDataFrame([(x,) for x in cases], "text string")
    assert {r["text"]: r["v"] for r in df.select("text", X.clean(df.text).alias("v")).collect()} == cases


def test_json_in_fences_and_braces(spark, tmp_path):
    cases = {'{"k": 1}': 1, ' {"k": 1}\n': 1, 'So:\n```json\n{"k": 2}\n```\nend': 2, '```\n{"k": 5}\n``` or {': 5, 'It is {"k": 3} indeed': 3, '{"k": 4} trailing': 4, "[1]": None, "none": None, "{k": None, "": None, None: None}
    spark.createDataFrame([(n, x) for n, x in enumerate(cases)], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["k"] for r in catalogue.json_tolerant_parse(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_event_windows_stream(spark, tmp_path):
    from evidenta.streaming.events import event_windows

    source = spark.read.parquet(f"{DIR}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    q = event_windows(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, event_windows(source).collect()))
