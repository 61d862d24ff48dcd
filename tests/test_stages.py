from pyspark.sql import functions as F

from evidenta.functions import scores as S
from evidenta.functions.vectors import dot, first_filled, hashed_embedding
from evidenta.operators import stages


def test_stages_stop_at_the_first_failure(spark, tmp_path):
    done = []
    work = [("one", lambda: done.append(1)), ("two", lambda: 1 / 0), ("three", lambda: done.append(3))]
    stages.run(spark, "j", work, f"{tmp_path}/audit")
    rows = spark.read.parquet(f"{tmp_path}/audit").orderBy("started_at").collect()
    assert [(r["stage"], r["status"]) for r in rows] == [("one", "done"), ("two", "error")] and done == [1] and "ZeroDivision" in rows[1]["error"]
    assert stages.preflight({"a": {"b": 1}}, {"a.b": int, "a.c": str, "a": str}) == ["a.c is missing", "a is no str"]
    assert stages.has_model(["x:latest", "y:7b"], "x") and stages.has_model(["y:7b"], "y:3b") and not stages.has_model(["y:7b"], "z")


def test_embeddings_and_fallback_fields(spark):
    df = spark.createDataFrame([(["a", "b", "a"], " m ", None), ([], "", "")], "t array<string>, m string, s string")
    r = df.select(hashed_embedding(F.col("t")).alias("v"), first_filled(F.col("m"), F.col("s")).alias("f")).select(dot(F.col("v"), F.col("v")).alias("n"), "f").collect()
    assert [round(x["n"], 9) for x in r] == [1.0, 0.0] and [x["f"] for x in r] == ["m", ""]


def test_malformed_anchors(spark):
    cases = [("3.2", "3.2 Methods of ours", True), ("12", "step 12: Return it", True), ("50", "we use 1,500 and 250", True), ("9.9", "nothing here", False), ("4.0", "licensed under CC BY 4.0 terms", True), ("91.4", "Dice of 91.4 in all", True)]
    df = spark.createDataFrame(cases, "v string, w string, l boolean")
    got = [r[0] for r in df.select(S.malformed(F.col("v"), F.col("w"), F.col("l"))).collect()]
    assert got == [["M2_SECTION_NUMBER"], ["M3_PSEUDOCODE_LINE"], ["M4_SUBTOKEN_OF_LONGER_NUMBER"], ["M5_VALUE_NOT_IN_TARGET_CHUNK"], ["M6_LICENCE_VERSION"], []]
