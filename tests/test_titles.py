import random

import __spark_entry__ as entry
from evidenta.functions.claims import similarity
from evidenta.operators import records, relational

DIR = "/root/testdata/sf0.001"


def test_closest_titles_by_brute_force(spark):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcé ") for _ in range(n))

    def edited(x):
        x = list(x)
        for _ in range(rng.randrange(1 + len(x) // 6)):
            k = rng.randrange(len(x) + 1)
            x[k : k + rng.randrange(2)] = [rng.choice("abcé ")] * rng.randrange(2)
        return "".join(x)

    real = [(g, say(n), 10 * n + g) for n in (0, 1, 5, 9, 10, 11, 18, 19, 20, 24, 30, 47, 70) for g in (1, 2) for _ in range(3)] + [(1, None, 5), (None, "abc", 6), (2, "a", None)]
    cited = [(g, edited(x)) for g, x, _ in real if x is not None for _ in range(6)] + [(1, None), (3, "abc"), (None, "abc")]
    want = {}
    for g, a in cited:
        if g is None or a is None:
            continue
        found = [(round(similarity(a, b), 6), -1 if k is None else 1 / (1 + k), k) for h, b, k in real if h == g and b is not None and abs(len(a) - len(b)) <= 2]
        if (best := max((x for x in found if x[0] >= 0.9), key=lambda x: x[:2], default=None)) is not None:
            want[g, a] = (best[2], best[0])
    got = relational.closest_titles(spark.createDataFrame(cited, "g int, cited string"), spark.createDataFrame(real, "g int, real string, real_id int"), "g").collect()
    assert {(r["g"], r["cited"]): (r["real_id"], r["ratio"]) for r in got} == want and len({len(a) for _, a in want}) > 12


def test_title_fuzzy_takes_every_customer(spark):
    keys = {r[0]: r[1] for r in spark.read.parquet(f"{DIR}/customer.parquet").select("c_custkey", "c_name").collect()}
    got = entry.queries()["title_fuzzy"](spark, DIR).collect()
    assert {(r["c_custkey"], r["real_id"], r["cited"]) for r in got} == {(k, k, x.replace("Cust", "Cuts")) for k, x in keys.items()}


def test_best_match_compares_each_set_of_tokens_once(spark):
    rng = random.Random(5)
    names = ["a b", "b c", "c d a", "d", "a b c d", "e f"]
    rows = lambda first: [(first + k, rng.choice(names).split()) for k in range(400)] + [(first, ["a", "e"]), (first, ["a", "b"]), (first + 1, None)]
    a, b = rows(0), rows(1000)
    want, of = {}, lambda x, key: [{*t} for k, t in x if k == key and t]
    right = {o: of(b, o) for o in {x[0] for x in b}}
    for k in {x[0] for x in a}:
        left = of(a, k)
        n = {o: sum(len(t & u) for t in left for u in us) for o, us in right.items()}
        best = max(n, key=lambda o: (n[o], -o))
        if n[best] >= 2:
            want[k] = (best, n[best])
    df = lambda x, key: spark.createDataFrame(x, f"{key} int, tokens array<string>")
    out = records.best_match(df(a, "k"), df(b, "other"), "k", "other", "tokens")
    assert {r["k"]: (r["other"], r["shared"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution()
    out.collect()
    joined = [m.apply("numOutputRows").value() for m in joins(plan.executedPlan())]
    assert joined and max(joined) < 1000  # 400 rows on each side, of a handful of sets


def joins(node):
    """Metrics of the joins of an executed plan."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return joins(node.executedPlan())
    inner = [node.plan()] if hasattr(node, "plan") and "QueryStage" in name else [node.children().apply(k) for k in range(node.children().size())]
    return ([node.metrics()] if "Join" in name else []) + [m for x in inner for m in joins(x)]
