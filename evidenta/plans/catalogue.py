"""The query catalogue: named queries over the test tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidenta.functions import text as X
from evidenta.functions.vectors import dot
from evidenta.operators import chunking, relational, retrieval
from evidenta.sources.tables import table as t
from evidenta.streaming.events import event_windows as windows_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# relational


def _sold(s: SparkSession, d: str) -> DataFrame:
    lines = t(s, d, "lineitem").select("l_orderkey", "l_partkey")
    orders = t(s, d, "orders").select("o_orderkey", "o_custkey")
    customers = t(s, d, "customer").select("c_custkey", "c_mktsegment")
    parts = t(s, d, "part").select("p_partkey", "p_brand")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == customers.c_custkey).join(parts, F.col("l_partkey") == parts.p_partkey)


_GAP = """WITH f AS (SELECT c_mktsegment, p_brand, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT a.c_mktsegment, b.p_brand, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT c_mktsegment FROM f) a CROSS JOIN (SELECT DISTINCT p_brand FROM f) b LEFT JOIN f ON f.c_mktsegment = a.c_mktsegment AND f.p_brand = b.p_brand"""


@query(_GAP)
def gap_matrix(s, d):
    return relational.gap_matrix(_sold(s, d), "c_mktsegment", "p_brand")


_SPARSE = """WITH f AS (SELECT o_custkey % 97 AS category, p_brand, count(l_partkey) AS n FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45) ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT a.category, b.p_brand FROM (SELECT DISTINCT category FROM f) a CROSS JOIN (SELECT DISTINCT p_brand FROM f WHERE p_brand IS NOT NULL) b ANTI JOIN f ON f.category = a.category AND f.p_brand = b.p_brand"""


@query(_SPARSE)
def candidate_gaps(s, d):
    """Pairs of a category and an item that no paper has: categories without any item are among them."""
    lines = t(s, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    facts = t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 97).alias("category")).join(lines, "o_orderkey", "left").join(t(s, d, "part").select("p_partkey", "p_brand"), "p_partkey", "left")
    return relational.gap_matrix(facts, "category", "p_brand").where("n = 0").drop("n")


@query("SELECT o_orderkey, c_name, n_name, r_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def corpus_table(s, d):
    o, c = t(s, d, "orders"), t(s, d, "customer")
    n, r = t(s, d, "nation"), t(s, d, "region")
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice")


@query("SELECT * FROM (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY coalesce(c_acctbal, 0) DESC, c_custkey) AS rank FROM customer) WHERE rank <= 20")
def catalog_ranked(s, d):
    return relational.first_n(t(s, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), ["c_mktsegment"], [F.coalesce("c_acctbal", F.lit(0.0)).desc(), "c_custkey"], 20)


@query("SELECT * FROM part WHERE p_partkey = 7")
def record_lookup(s, d):
    return t(s, d, "part").where("p_partkey = 7")


@query("SELECT * FROM part WHERE p_partkey IN (7, 11)")
def pair_lookup(s, d):
    return t(s, d, "part").where(F.col("p_partkey").isin(7, 11))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_partkey, p_name, p_brand, p_type)), '#12')")
def row_text_filter(s, d):
    return t(s, d, "part").where(F.lower(F.concat_ws(" ", "p_partkey", "p_name", "p_brand", "p_type")).contains("#12")).select("p_partkey", "p_name")


@query("SELECT DISTINCT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def missing_ids(s, d):
    return relational.missing(t(s, d, "documents"), t(s, d, "labels"), "doc_id")


@query("SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def id_symdiff(s, d):
    return relational.symmetric_difference(t(s, d, "customer").select(F.col("c_custkey").alias("k")), t(s, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def fk_integrity(s, d):
    return t(s, d, "lineitem").select("l_orderkey").join(t(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").agg(F.count("*").alias("orphans"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(s, d):
    return relational.duplicate_keys(t(s, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT doc_id FROM documents WHERE lang = 'fr' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def union_hits(s, d):
    return t(s, d, "documents").where("lang = 'fr'").select("doc_id").union(t(s, d, "labels").where("toxic = 1").select("doc_id")).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def bag_difference(s, d):
    of = lambda flag: t(s, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"))
    return of("R").exceptAll(of("A"))


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedupe_first_wins(s, d):
    return relational.first_wins(t(s, d, "documents").select("doc_id", "text"), [F.lower("text")], ["doc_id"])


@query("SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS rn FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)) WHERE rn = 1")
def dominant_value(s, d):
    return relational.dominant(t(s, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT conv_id, turn, role, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations) WHERE rank <= 2")
def first_n_per_group(s, d):
    return relational.first_n(t(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 2)


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def previous_turn(s, d):
    return t(s, d, "conversations").select("conv_id", "turn", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def carry_forward(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t(s, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), True).over(w).alias("carried"))


# text


@query("SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> ''))::INT AS n_words FROM documents")
def doc_word_totals(s, d):
    return t(s, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).alias("n_words"))


@query("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, bool_or(n_chars > 5000) AS has_long FROM documents GROUP BY ALL")
def doc_summary(s, d):
    return t(s, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.bool_or(F.col("n_chars") > 5000).alias("has_long"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY ALL")
def source_counts(s, d):
    return t(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')"
_CHUNKS = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 41, 0) // 180 + 1)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, i::INT AS chunk_index, len(w[i * 180 + 1 : i * 180 + 220])::INT AS n_words, array_to_string(w[i * 180 + 1 : i * 180 + 220], ' ') AS chunk FROM s"""


@query(_CHUNKS)
def chunk_windows(s, d):
    return chunking.chunk_windows(t(s, d, "documents"), "doc_id", "text")


@query(f"WITH c AS ({_CHUNKS}), r AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id ORDER BY chunk_index) - n_words AS before FROM c) SELECT doc_id, chunk_index, before::BIGINT AS before, least(n_words, 2500 - before)::BIGINT AS take FROM r WHERE before < 2500")
def assemble_budget(s, d):
    return chunking.running_budget(chunk_windows(s, d).select("doc_id", "chunk_index", "n_words"), "doc_id", ["chunk_index"], "n_words", 2500).select("doc_id", "chunk_index", "before", "take")


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, CASE WHEN len(w) <= 100 THEN array_to_string(w, ' ') ELSE array_to_string(w[1:75], ' ') || ' [...] ' || array_to_string(w[len(w) - 24 :], ' ') END AS context FROM w")
def head_tail_budget(s, d):
    return t(s, d, "documents").select("doc_id", chunking.head_tail(X.words(F.col("text")), 100).alias("context"))


@query("SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g')) AS v FROM documents")
def whitespace_norm(s, d):
    return t(s, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("v"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?is)\\n\\s*(references|acknowledge?ments|bibliography)\\s*\\n.*$', ''), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g'), '^[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+|[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+$', '', 'g') AS v FROM documents")
def clean_text(s, d):
    return t(s, d, "documents").select("doc_id", X.clean(F.col("text")).alias("v"))


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::INT AS n FROM documents")
def sentence_split(s, d):
    return t(s, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n"))


@query("SELECT page_id, regexp_extract_all(coalesce(html, ''), '\\d+\\.\\d+|\\b\\d{2,}\\b') AS anchors FROM pages")
def anchor_tokens(s, d):
    return t(s, d, "pages").select("page_id", X.anchors(F.col("html")).alias("anchors"))


_STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_SIG = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9-]*'), lambda x: length(x) >= 4 AND x NOT IN ({_STOPS})))"


@query(f"SELECT doc_id, list_sort({_SIG}) AS tokens FROM documents")
def sig_tokens(s, d):
    return t(s, d, "documents").select("doc_id", F.array_sort(X.sig_tokens(F.col("text"))).alias("tokens"))


@query("SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS h FROM documents")
def content_hash(s, d):
    return t(s, d, "documents").select("doc_id", F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16).alias("h"))


@query("SELECT doc_id FROM documents ORDER BY sha256(doc_id::VARCHAR), doc_id LIMIT 20")
def deterministic_sample(s, d):
    return t(s, d, "documents").select("doc_id").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id").limit(20)


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def json_tolerant_parse(s, d):
    return t(s, d, "events").select("event_id", F.get_json_object(X.json_object(F.col("props")), "$.k").cast("long").alias("k"))


# vectors


@query("WITH p AS (SELECT label, min(vec_id) AS probe FROM embeddings GROUP BY label), q AS (SELECT p.label, probe, embedding AS pv FROM p JOIN embeddings ON vec_id = probe), s AS (SELECT probe, e.label, vec_id, round(list_dot_product(e.embedding::DOUBLE[], pv::DOUBLE[]), 5) AS score FROM embeddings e JOIN q USING (label)) SELECT probe, label, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY probe, label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5")
def vector_topk_within_group(s, d):
    e = t(s, d, "embeddings")
    probes = e.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("m")).select("label", F.col("m.vec_id").alias("probe"), F.col("m.embedding").alias("probe_vector"))
    return retrieval.top_k(e, probes, "label", "vec_id", "embedding", "probe", 5)


@query("WITH q AS (SELECT embedding AS pv FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], pv::DOUBLE[]), 5) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_global(s, d):
    e = t(s, d, "embeddings")
    probe = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("pv")))  # one row
    return e.crossJoin(probe).select("vec_id", F.round(dot(F.col("embedding"), F.col("pv")), 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


_EVERY_50TH = "WITH q AS (SELECT vec_id AS probe, label, embedding AS pv FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT probe, {group}vec_id, round(list_dot_product(e.embedding::DOUBLE[], pv::DOUBLE[]), 5) AS score FROM q JOIN embeddings e ON {on}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"


def _every_50th(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("probe"), F.col("embedding").alias("probe_vector"), "label")


@query(_EVERY_50TH.format(group="e.label, ", on="e.label = q.label", k=5))
def vector_topk_every_50th_within_group(s, d):
    e = t(s, d, "embeddings")
    return retrieval.top_k_blocks(e, _every_50th(e), "vec_id", "embedding", "probe", 5, "label")


@query(_EVERY_50TH.format(group="", on="true", k=10))
def vector_topk_every_50th(s, d):
    e = t(s, d, "embeddings")
    return retrieval.top_k_blocks(e, _every_50th(e).drop("label"), "vec_id", "embedding", "probe", 10)


@query("SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INT AS pos FROM embeddings) GROUP BY ALL")
def mean_pool(s, d):
    return retrieval.mean_pool(t(s, d, "embeddings"), "label", "embedding")


# measures


@query("SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS both, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS good, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS bad, round(avg((quality = toxic)::INT), 4) AS agreement FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def confusion_matrix(s, d):
    j = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "lang"), "doc_id")
    cell = lambda q, x: F.count_if((F.col("quality") == q) & (F.col("toxic") == x))
    return j.groupBy("lang").agg(cell(1, 1).alias("both"), cell(1, 0).alias("good"), cell(0, 1).alias("bad"), F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 4).alias("agreement"))


@query("SELECT lang, source, avg(n_chars) AS mean, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def length_slices(s, d):
    return t(s, d, "documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.avg("n_chars").alias("mean"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, name, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) ON quantity, discount, tax INTO NAME name VALUE value)")
def cells_unpivot(s, d):
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")).unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "name", "value")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(s, d):
    return windows_of(t(s, d, "events"))
