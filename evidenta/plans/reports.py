"""Queries of filters, records and report measures over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidenta.functions import text as X
from evidenta.operators import records
from evidenta.plans.catalogue import query
from evidenta.sources.tables import table as t


@query("SELECT event_id, user_id FROM events WHERE user_id::VARCHAR = '7'")
def category_filter(s, d):
    return t(s, d, "events").where(F.col("user_id").cast("string") == "7").select("event_id", "user_id")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> ''")
def with_abstract(s, d):
    return t(s, d, "documents").where("text is not null and text <> ''").select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE n_chars >= 1000")
def full_text_filter(s, d):
    return t(s, d, "documents").where("n_chars >= 1000").select("doc_id", "source")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * 10 >= 150 AND l_extendedprice / 100 >= 150 AND l_quantity * 10 * (l_extendedprice / 100) >= 40000")
def figure_sizes(s, d):
    """Images of 150 points and 40,000 square points or more."""
    w, h = F.col("l_quantity") * 10, F.col("l_extendedprice") / 100
    return t(s, d, "lineitem").where((w >= 150) & (h >= 150) & (w * h >= 40000)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (WHERE o_totalprice > 300000 AND o_orderstatus <> 'F') AS open_large FROM orders GROUP BY o_orderstatus")
def status_filters(s, d):
    return t(s, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"), F.count_if((F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") != "F")).alias("open_large"))


@query("SELECT o_orderkey, CASE WHEN share >= 0.8 THEN 'scanned' WHEN share > 0.2 THEN 'mixed' ELSE 'born_digital' END AS kind FROM (SELECT l_orderkey AS o_orderkey, avg((l_discount >= 0.05)::INT) AS share FROM lineitem GROUP BY 1)")
def document_kinds(s, d):
    """Documents by the share of their pages that are images."""
    share = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg((F.col("l_discount") >= 0.05).cast("int")).alias("share"))
    return share.select("o_orderkey", F.when(F.col("share") >= 0.8, "scanned").when(F.col("share") > 0.2, "mixed").otherwise("born_digital").alias("kind"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 1 AND doc_id % 5 >= 2")
def reusable_cache(s, d):
    """Cached records that may be used again: every third has another version, every fourth another text."""
    docs = t(s, d, "documents").select("doc_id", "text")
    h = F.substring(F.sha2(F.concat(X.text_of(F.col("text")), F.when(F.col("doc_id") % 4 == 1, "!").otherwise("")), 256), 1, 16)
    cached = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "v1").otherwise("v2").alias("prompt_version"), h.alias("text_hash"), F.array().cast("array<string>").alias("flags"), (F.col("doc_id") % 5).alias("filled"))
    return records.reusable(cached, docs, "v2", "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT (doc_id % 3 <> 0 AND doc_id % 4 <> 1 AND doc_id % 5 >= 2)")
def to_extract(s, d):
    return records.to_extract(t(s, d, "documents").select("doc_id", "text"), reusable_cache(s, d), "doc_id").select("doc_id")


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 30 THEN 'new ' || p_brand ELSE p_brand END AS p_brand FROM part")
def recategorised(s, d):
    p = t(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return records.merged(p.drop("p_size"), p.where("p_size > 30").select("p_partkey", F.concat(F.lit("new "), "p_brand").alias("p_brand")), "p_partkey")


@query("SELECT user_id, a = b AS equal FROM (SELECT user_id, list_sort(list(event_type) FILTER (WHERE event_id % 2 = 0)) AS x, list_sort(list(event_type) FILTER (WHERE event_id % 2 = 1)) AS y, coalesce(x, []) AS a, coalesce(y, []) AS b FROM events GROUP BY user_id)")
def parser_consensus(s, d):
    e = t(s, d, "events")
    return records.bag_equal(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["event_type"], "user_id")


_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"WITH a AS (SELECT p_partkey, unnest({_TOK.format('p_name')}) AS t FROM part WHERE p_partkey % 10 = 0), b AS (SELECT p_partkey AS other, unnest({_TOK.format('p_name')}) AS t FROM part WHERE p_partkey % 10 = 1), s AS (SELECT p_partkey, other, count(*) AS shared FROM a JOIN b USING (t) GROUP BY ALL HAVING count(*) >= 2) SELECT p_partkey, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY shared DESC, other) AS rn FROM s) WHERE rn = 1")
def caption_match(s, d):
    tokens = F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z0-9]+"), 0).alias("tokens")
    p = t(s, d, "part")
    return records.best_match(p.where("p_partkey % 10 = 0").select("p_partkey", tokens), p.where("p_partkey % 10 = 1").select(F.col("p_partkey").alias("other"), tokens), "p_partkey", "other", "tokens")


@query("SELECT l_returnflag, round(avg((l_quantity > 5)::INT), 4) AS lax, round(avg((l_quantity > 25)::INT), 4) AS strict, round(avg((l_discount > 0.02)::INT) FILTER (WHERE l_quantity > 25), 4) AS provenance, round(avg((l_tax > 0.04)::INT) FILTER (WHERE l_quantity > 25), 4) AS bindable FROM lineitem GROUP BY l_returnflag")
def fidelity_block(s, d):
    """Rates of survival, and of provenance and binding among what survives strictly."""
    rate = lambda test, among="true": F.round(F.avg(F.when(F.expr(among), F.expr(test).cast("int"))), 4)
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(rate("l_quantity > 5").alias("lax"), rate("l_quantity > 25").alias("strict"), rate("l_discount > 0.02", "l_quantity > 25").alias("provenance"), rate("l_tax > 0.04", "l_quantity > 25").alias("bindable"))


@query("SELECT l_linestatus, sum(h)::BIGINT AS hits, sum(n)::BIGINT AS n, round(sum(h) / sum(n), 6) AS micro, round(avg(h / n), 6) AS macro FROM (SELECT l_linestatus, l_orderkey, count(*) FILTER (WHERE l_discount > 0.05) AS h, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_linestatus")
def pooled_counts(s, d):
    """Rates over all values and as a mean of papers' rates."""
    each = t(s, d, "lineitem").groupBy("l_linestatus", "l_orderkey").agg(F.count_if(F.col("l_discount") > 0.05).alias("h"), F.count("*").alias("n"))
    return each.groupBy("l_linestatus").agg(F.sum("h").alias("hits"), F.sum("n").alias("n"), F.round(F.sum("h") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("h") / F.col("n")), 6).alias("macro"))


@query("SELECT l_returnflag, count(*) AS fired, min(l_discount) AS least, median(l_discount) AS middle, max(l_discount) AS most, round(avg((l_tax <= 0.06)::INT), 4) AS precision FROM lineitem WHERE l_quantity > 40 GROUP BY l_returnflag")
def parity_gate_precision(s, d):
    """How often the parity gate fired and was right, and the deficits behind it."""
    return t(s, d, "lineitem").where("l_quantity > 40").groupBy("l_returnflag").agg(F.count("*").alias("fired"), F.min("l_discount").alias("least"), F.median("l_discount").alias("middle"), F.max("l_discount").alias("most"), F.round(F.avg((F.col("l_tax") <= 0.06).cast("int")), 4).alias("precision"))


@query("SELECT event_type, count(*) AS n, round(avg(((value > 100) = (event_id % 2 = 0))::INT), 4) AS agreement FROM events GROUP BY ROLLUP (event_type)")
def agreement_by_class(s, d):
    """Agreement of two verdicts for each class of mutation and for all."""
    same = (F.col("value") > 100) == (F.col("event_id") % 2 == 0)
    return t(s, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.round(F.avg(same.cast("int")), 4).alias("agreement"))


@query("SELECT o_orderstatus AS arm, o_orderpriority AS status, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS unbound FROM orders GROUP BY ALL")
def binder_histogram(s, d):
    return t(s, d, "orders").groupBy(F.col("o_orderstatus").alias("arm"), F.col("o_orderpriority").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("unbound"))


@query("SELECT key, kind, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key, 'BIGINT' AS kind FROM events) GROUP BY ALL")
def key_profile(s, d):
    """Keys of JSON objects with the kinds of their values."""
    e = t(s, d, "events").select(F.explode(F.from_json("props", "map<string,variant>")).alias("key", "value"))
    return e.select("key", F.schema_of_variant("value").alias("kind")).groupBy("key", "kind").agg(F.count("*").alias("n"))


@query("SELECT field, count(value) AS present, count(*) FILTER (WHERE try_cast(value AS DOUBLE) IS NOT NULL) AS numeric FROM (UNPIVOT (SELECT doc_id::VARCHAR AS doc_id, lang, source, n_chars::VARCHAR AS n_chars FROM documents) ON doc_id, lang, source, n_chars INTO NAME field VALUE value) GROUP BY field")
def field_presence(s, d):
    """How many values each field of a raw table has, and how many are numbers."""
    fields = ["doc_id", "lang", "source", "n_chars"]
    long = t(s, d, "documents").select(*(F.col(f).cast("string").alias(f) for f in fields)).unpivot([], fields, "field", "value").where("value is not null")
    return long.groupBy("field").agg(F.count("value").alias("present"), F.count_if(F.col("value").try_cast("double").isNotNull()).alias("numeric"))


@query("SELECT conv_id, turn, CASE WHEN text LIKE '%a%' AND lag(role) OVER w = role THEN NULL ELSE lag(text) OVER w END AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def sentence_context(s, d):
    """The sentence before, unless the rule that resets it holds."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    reset = F.col("text").contains("a") & F.coalesce(F.lag("role").over(w) == F.col("role"), F.lit(False))
    return t(s, d, "conversations").select("conv_id", "turn", F.when(~reset, F.lag("text").over(w)).alias("context"))


@query("SELECT p_brand, p_name, p_partkey, row_number() OVER (ORDER BY p_brand, p_name, p_partkey) AS place FROM part WHERE p_size = 7")
def category_title_order(s, d):
    """Order by category and title (O2), of the parts of one size."""
    return t(s, d, "part").where("p_size = 7").select("p_brand", "p_name", "p_partkey", F.row_number().over(Window.orderBy("p_brand", "p_name", "p_partkey")).alias("place"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://doi.org/10.1/' || page_id WHEN page_id % 3 = 1 THEN 'https://arxiv.org/abs/' || page_id END AS link FROM pages")
def external_links(s, d):
    p = t(s, d, "pages")
    doi = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("10.1/"), F.col("page_id").cast("string"))).otherwise("")
    return p.select("page_id", X.external_link(doi, F.when(F.col("page_id") % 3 == 1, F.col("page_id").cast("string"))).alias("link"))


@query("SELECT c_custkey, list_aggregate(list_filter([c_name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END, NULL], lambda x: x <> ''), 'string_agg', ', ') AS authors, '- ' || c_name || ' (' || c_nationkey || '): ' || c_mktsegment AS line FROM customer")
def author_lines(s, d):
    """Names of authors, and the line of a prompt."""
    names = F.filter(F.array("c_name", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")), F.lit(None).cast("string")), lambda x: x != "")
    return t(s, d, "customer").select("c_custkey", F.array_join(names, ", ").alias("authors"), F.format_string("- %s (%d): %s", "c_name", "c_nationkey", "c_mktsegment").alias("line"))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1997")
def year_range(s, d):
    return t(s, d, "orders").where(F.year("o_orderdate").between(1995, 1997)).select("o_orderkey")


@query("SELECT event_id, true AS parsed, ['summary'] AS missing, list_filter(json_keys(props), lambda x: x <> 'k') AS extra FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, false, ['k', 'summary'], [] FROM events WHERE event_id % 2 = 1")
def schema_conformance(s, d):
    e = t(s, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("So: ```json\n"), "props", F.lit("\n```"))).otherwise("no object").alias("said"))
    return e.select("event_id", records.conformance(F.col("said"), ["k", "summary"]).alias("c")).select("event_id", "c.*")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'truncated' WHEN event_id % 4 = 1 THEN 'invalid_json' WHEN event_id % 4 = 2 THEN 'wrong_shape' ELSE 'ok' END AS kind FROM events")
def response_classes(s, d):
    r = F.col("event_id") % 4
    said = F.when(r == 1, "{broken").when(r == 2, F.col("props")).otherwise('{"k": 1, "summary": "x"}')
    return t(s, d, "events").select("event_id", records.response_class(said, F.when(r == 0, "length").otherwise("stop"), ["k", "summary"]).alias("kind"))


@query("SELECT p_partkey, p_name || ' scores ' || (p_size + 7) || ' points' AS mutant FROM part")
def numeric_mutants(s, d):
    claim = F.concat("p_name", F.lit(" scores "), F.col("p_size").cast("string"), F.lit(" points"))
    return t(s, d, "part").select("p_partkey", records.perturbed(claim).alias("mutant"))


@query("SELECT source, round(100 * (c - a), 4) AS confounded, round(100 * (b - a), 4) AS routing, round(100 * (c - b), 4) AS isolated FROM (SELECT source, avg((n_chars > 3000)::INT) AS a, avg((n_chars > 2000)::INT) AS b, avg((n_chars > 1000)::INT) AS c FROM documents GROUP BY source)")
def arm_decomposition(s, d):
    """Differences of three arms in percentage points (Q2)."""
    arm = lambda n: F.avg((F.col("n_chars") > n).cast("int"))
    g = t(s, d, "documents").groupBy("source").agg(arm(3000).alias("a"), arm(2000).alias("b"), arm(1000).alias("c"))
    pp = lambda x, y, n: F.round(100 * (F.col(x) - F.col(y)), 4).alias(n)
    return g.select("source", pp("c", "a", "confounded"), pp("b", "a", "routing"), pp("c", "b", "isolated"))


@query("SELECT user_id % 2 AS arm, count(DISTINCT user_id) AS papers, count(*) FILTER (WHERE event_type = 'purchase') AS returned, count(*) FILTER (WHERE event_type = 'error') AS wrong, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def arm_summary(s, d):
    e = t(s, d, "events").groupBy((F.col("user_id") % 2).alias("arm"))
    return e.agg(F.count_distinct("user_id").alias("papers"), F.count_if(F.col("event_type") == "purchase").alias("returned"), F.count_if(F.col("event_type") == "error").alias("wrong"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT source, kind, count(*) AS n FROM (SELECT source, CASE WHEN n_chars >= 1000 THEN 'FULL_TEXT' WHEN n_chars >= 200 THEN 'ABSTRACT_ONLY' WHEN n_chars > 0 THEN 'METADATA_ONLY' ELSE 'FAILED' END AS kind FROM documents) GROUP BY ALL")
def source_disposition(s, d):
    n = F.col("n_chars")
    kind = F.when(n >= 1000, "FULL_TEXT").when(n >= 200, "ABSTRACT_ONLY").when(n > 0, "METADATA_ONLY").otherwise("FAILED")
    return t(s, d, "documents").groupBy("source", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, bool_and(a IS NOT DISTINCT FROM b) AS same FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS a, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS b FROM documents)")
def determinism(s, d):
    """The same ranks twice (Q13): the two rankings are worked out apart and joined."""
    ranks = lambda n: t(s, d, "documents").select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("n_chars", "doc_id")).alias(n))
    return ranks("a").join(ranks("b"), "doc_id", "full").agg(F.count("*").alias("n"), F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


@query("SELECT o_orderkey, list_sort(list(DISTINCT l_linenumber))[1:3] AS places FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_orderkey")
def value_places(s, d):
    """The first three places at which a claim's value stands in a table (Q15)."""
    li = t(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return t(s, d, "orders").select("o_orderkey").join(li, "o_orderkey").groupBy("o_orderkey").agg(F.slice(F.array_sort(F.collect_set("l_linenumber")), 1, 3).alias("places"))


@query("SELECT c_custkey, c_name = x.name AND n_name IS NOT NULL AS passed, coalesce(k, 0) AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey JOIN (SELECT c_custkey AS id, c_name AS name FROM customer) x ON x.id = c_custkey")
def stage_checks(s, d):
    """Parity of two stages' rows by id, and how many rows hang on each."""
    c = t(s, d, "customer")
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    k = t(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    again = c.select("c_custkey", F.col("c_name").alias("name"))
    j = c.join(n, "c_nationkey", "left").join(k, "c_custkey", "left").join(again, "c_custkey")
    return j.select("c_custkey", ((F.col("c_name") == F.col("name")) & F.col("n_name").isNotNull()).alias("passed"), F.coalesce("k", F.lit(0)).alias("orders"))
