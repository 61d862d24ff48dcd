import random

from pyspark.sql import functions as F

from evidenta.functions.vectors import dot
from evidenta.operators import retrieval


def test_top_k_blocks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 40)
    monkeypatch.setattr(retrieval, "PROBES", 7)
    monkeypatch.setattr(retrieval, "SLICE", 3)
    rng = random.Random(8)
    vector = lambda: [rng.choice([0.0, 1.0, 0.5, rng.random() * 1e-5, rng.random()]) for _ in range(4)]
    same = vector()
    rows = [(k, k % 3, same if k % 4 == 0 else vector()) for k in range(300)] + [(301, 0, None), (302, 1, [1.0, None, 0.0, 2.0]), (303, 4, None), (306, 5, None), (311, 5, [1.0, 2.0, 0.5, 0.0]), (304, 2, [float("nan"), 0.0, 0.0, 0.0]), (305, 4, [1.0, 0.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "id long, g int, v array<float>")
    probes = e.where("id % 10 = 0 or id > 300").select(F.col("id").alias("p"), F.col("v").alias("p_vector"), "g")
    for group in ("g", None):
        a, b = (e, probes) if group else (e.withColumn("g", F.lit(0)), probes.withColumn("g", F.lit(0)))
        plain = [(r["p"], r["g"], r["id"], r["s"]) for r in a.join(b, "g").select("p", "g", "id", F.round(dot(F.col("v"), F.col("p_vector")), 5).alias("s")).collect()]
        order = lambda r: (r[3] is None, -float("inf") if r[3] is None or r[3] != r[3] else -r[3], r[2])
        want = {(p, r[2], str(r[3]), n + 1) for p in {r[0] for r in plain} for n, r in enumerate(sorted((r for r in plain if r[0] == p), key=order)[:6])}
        got = retrieval.top_k_blocks(e, probes if group else probes.drop("g"), "id", "v", "p", 6, group).collect()
        assert {(r["p"], r["id"], str(r["score"]), r["rank"]) for r in got} == want and len(got) == len(want)
