from pyspark.sql import functions as F

from evidenta.functions import text as X


def test_patterns_of_names_run_only_where_their_letters_are(spark):
    texts = ["We use coco, ſST-2 and ıMDB; KITTI too", "İSIC, M&MS", "tested on the AB12 and evaluated on XYZ", "no CoCoNut benchmark", "the AB-1 corpus", "", None, "ms-coco PASCAL voc"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    quoted = lambda n: "".join("\\" + x if not x.isalnum() and x != " " else x for x in n)
    t = X.text_of(F.col("t"))
    plain = F.array_compact(F.array(*(F.when(t.rlike(rf"(?iU)\b{quoted(n)}\b"), F.lit(n)) for n in X.DATASETS)))
    said = F.flatten(F.array(*(F.regexp_extract_all(t, F.lit(p), 1) for p in X.DATASET_PHRASES)))
    named = F.filter(said, lambda x: ~x.isin(*X.NO_DATASETS) & (x.rlike("[0-9]") | x.rlike("[A-Z].*[A-Z]")))
    out = df.select(X.dataset_names(F.col("t")).alias("a"), F.array_sort(F.array_distinct(F.concat(plain, named))).alias("b"))
    rows = out.collect()
    assert all(r["a"] == r["b"] for r in rows) and {"COCO", "SST-2", "IMDB", "KITTI"} <= {*rows[0]["a"]} and "AB12" in rows[2]["a"]
    plan = df.select(X.dataset_names(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains") + plan.count("contains(") >= len(X.DATASETS)


def test_white_space_at_ends_and_in_runs(spark):
    texts = [" a  b ", "a b", " a b\n", "a\n\nb", "\x85", "", " ", "a\x1cb", "a   b\n ", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    t = X.text_of(F.col("t"))
    rows = df.select(X.strip(F.col("t")).alias("a"), F.regexp_replace(t, rf"^{X.SPACE}+|{X.SPACE}+$", "").alias("b"), X.collapse(F.col("t")).alias("c"), F.trim(F.regexp_replace(F.lower(t), X.SPACE + "+", " ")).alias("d"), X.one_line(F.col("t")).alias("e")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] == r["e"] for r in rows)
