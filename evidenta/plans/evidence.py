"""Queries of the evidence, selection and measurement operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidenta.functions import claims as C
from evidenta.functions import scores as S
from evidenta.functions import text as X
from evidenta.operators import chunking, gate, metrics, relational, selection, tables
from evidenta.plans.catalogue import query
from evidenta.sources.tables import stored
from evidenta.sources.tables import table as t

#: White space of X.SPACE for the SQL engine.
_WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_sql_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"

# sections, headings and captions: labels that the rules tell apart
_LABELS = ("1 Introduction", "Materials and Methods", "Our Approach", "Experimental Setup", "4.2 Results", "Main Findings", "Related Work", "Threats to Validity", "Ablation study", "Conclusions", "ABSTRACT", "References", "Appendix A", "Table 2: scores", "Tab. IV", "tables of it", "III. Proof Sketch", "we did this", "")


def _labelled(s, d) -> DataFrame:
    return t(s, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("doc_id") % len(_LABELS) + 1).cast("int")).alias("label"))


_LABELLED = f"(SELECT doc_id, ({_sql_list(_LABELS)})[doc_id % {len(_LABELS)} + 1] AS label FROM documents)"
_SECTION = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(label), '{w}')''' for w in ws)} THEN '{name}'" for name, ws in X.SECTIONS) + " ELSE coalesce(nullif(substr(lower(trim(label)), 1, 40), ''), 'body') END"


@query(f"SELECT doc_id, {_SECTION} AS section FROM {_LABELLED}")
def section_canonical(s, d):
    return _labelled(s, d).select("doc_id", X.section(F.col("label")).alias("section"))


@query(f"SELECT doc_id, regexp_matches(label, '{X.NAMED_HEADING}') OR regexp_matches(label, '{X.NUMBERED_HEADING}') AS heading, regexp_matches(label, '{X.TABLE_CAPTION}') AS caption FROM {_LABELLED}")
def caption_detect(s, d):
    return _labelled(s, d).select("doc_id", X.is_heading(F.col("label")).alias("heading"), X.is_table_caption(F.col("label")).alias("caption"))


@query(f"SELECT doc_id, CASE WHEN b >= 4 AND b > c THEN 'biomed' ELSE 'cs_ml' END AS domain FROM (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?i){X.BIOMEDICAL}')) AS b, len(regexp_extract_all(coalesce(text, ''), '(?i){X.COMPUTING}')) AS c FROM documents)")
def domain_routing(s, d):
    return t(s, d, "documents").select("doc_id", X.domain(F.col("text")).alias("domain"))


# the SQL engine's \\b knows ASCII letters only, so others are made one
@query("SELECT doc_id, " + " OR ".join(f"regexp_matches(v, '{p}')" for p in X.EMPIRICAL) + r" AS empirical FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\x00-\x7F]', 'x', 'g') AS v FROM documents)")
def empirical_text(s, d):
    return t(s, d, "documents").select("doc_id", X.empirical(F.col("text")).alias("empirical"))


_NAMED = "text || CASE WHEN doc_id % 3 = 0 THEN ' We evaluated on COCO and the FooBar dataset, imagenet too.' WHEN doc_id % 3 = 1 THEN ' On the Results dataset, M&Ms.' ELSE '' END"
_PHRASED = ", ".join(f"regexp_extract_all(v, '{p}', 1)" for p in X.DATASET_PHRASES)


@query(f"SELECT doc_id, list_sort(list_distinct(list_concat(list_filter({_sql_list(X.DATASETS)}, lambda n: regexp_matches(regexp_replace(v, '[^\\x00-\\x7F]', 'x', 'g'), '(?i)\\b' || n || '\\b')), list_filter(flatten([{_PHRASED}]), lambda x: x NOT IN ({', '.join(repr(w) for w in X.NO_DATASETS)}) AND (regexp_matches(x, '[0-9]') OR regexp_matches(x, '[A-Z].*[A-Z]')))))) AS names FROM (SELECT doc_id, coalesce({_NAMED}, '') AS v FROM documents)")
def dictionary_match(s, d):
    return t(s, d, "documents").select("doc_id", X.dataset_names(F.expr(_NAMED)).alias("names"))


@query(f"SELECT conv_id, turn, list_filter({_sql_list(X.PROMPT_PHRASES)}, lambda p: contains(lower(v), lower(p))) AS phrases FROM (SELECT conv_id, turn, text || CASE WHEN turn = 1 THEN ' 5-HOUR work session' ELSE '' END AS v FROM conversations) WHERE len(list_filter({_sql_list(X.PROMPT_PHRASES)}, lambda p: contains(lower(v), lower(p)))) > 0")
def phrase_leak_scan(s, d):
    said = F.concat("text", F.when(F.col("turn") == 1, " 5-HOUR work session").otherwise(""))
    return t(s, d, "conversations").select("conv_id", "turn", X.prompt_phrases(said).alias("phrases")).where("size(phrases) > 0")


@query("SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '\\d+\\.\\d+|\\b\\d{2,}\\b'))::INT AS n FROM pages")
def anchor_counts(s, d):
    return t(s, d, "pages").select("page_id", F.size(X.anchors(F.col("html"))).alias("n"))


@query()
def anchor_offsets(s, d):
    return t(s, d, "pages").select("page_id", F.explode(X.valid_anchors(F.col("html"))).alias("a")).select("page_id", "a.value", "a.pos")


_STOPPED = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_TITLE_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda x: x NOT IN " + _STOPPED + "))"


@query(f"WITH p AS (SELECT a.p_partkey, {_TITLE_TOKENS.format('a.p_name')} AS x, {_TITLE_TOKENS.format('b.p_name')} AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT p_partkey, CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / least(len(x), len(y)) ELSE 0 END::DOUBLE AS similarity FROM p")
def title_similarity(s, d):
    p = t(s, d, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(after, "p_partkey").select("p_partkey", X.title_similarity(F.col("p_name"), F.col("other")).alias("similarity"))


@query("SELECT event_id, replace(replace(lower(replace(v, '−', '-')), ' ', ''), '*', '') AS v FROM (SELECT event_id, '−' || value::DECIMAL(18,2)::VARCHAR || ' *' AS v FROM events)")
def number_normalised(s, d):
    return t(s, d, "events").select("event_id", X.numbers_normalised(F.concat(F.lit("−"), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" *"))).alias("v"))


# fuzzy titles

_CITED = "CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '.' WHEN 1 THEN p_name || ' [' || p_brand || ']' WHEN 2 THEN '“' || p_name || '”' ELSE 'no such part' END"


@query(f"WITH c AS (SELECT p_partkey, {_CITED} AS cited FROM part), r AS (SELECT lower(p_name) AS title, min(p_partkey) AS real FROM part GROUP BY 1), n AS (SELECT p_partkey, lower(regexp_replace(replace(replace(cited, '“', '\"'), '”', '\"'), '\\.$', '')) AS a, lower(trim(regexp_replace(cited, '\\s*[\\[\\(][^\\]\\)]*[\\]\\)]\\s*$', ''))) AS b FROM c) SELECT n.p_partkey, CASE WHEN x.real IS NOT NULL THEN 1 WHEN y.real IS NOT NULL THEN 2 END AS tier, coalesce(x.real, y.real) AS real FROM n LEFT JOIN r x ON x.title = a LEFT JOIN r y ON y.title = b")
def title_tiers(s, d):
    """Cited titles by equal title, else by title without a note in brackets (J14, tiers 1 and 2)."""
    cited = t(s, d, "part").select("p_partkey", F.expr(_CITED).alias("cited"))
    real = t(s, d, "part").select(X.normal_title(F.col("p_name")).alias("title"), F.col("p_partkey").alias("real")).groupBy("title").agg(F.min("real").alias("real"))
    return relational.title_tiers(cited, real, "p_partkey", "cited")


@query()
def title_fuzzy(s, d):
    """Names of customers with two letters swapped against the real ones of their nation (J14, tier 3; F23)."""
    c = t(s, d, "customer").select("c_nationkey", F.col("c_name").alias("real"), F.col("c_custkey").alias("real_id"))
    cited = t(s, d, "customer").select("c_nationkey", "c_custkey", F.regexp_replace("c_name", "Cu(s)(t)", "Cu$2$1").alias("cited"))
    scored = cited.join(relational.closest_titles(cited, c, "c_nationkey"), ["c_nationkey", "cited"])
    return scored.groupBy("c_custkey", "cited").agg(F.max_by("real_id", F.struct("ratio", -F.col("real_id"))).alias("real_id"), F.max("ratio").alias("ratio"))


# predicates and scores

_LINE = "l_orderkey, l_linenumber"


@query(f"SELECT {_LINE}, title >= 0.6 OR (doi AND title >= 0.3) OR (names >= 0.5 AND title >= 0.4) AS passed, round(least(1.0, 0.5 * title + CASE WHEN doi THEN 0.2 ELSE 0 END + 0.2 * names + CASE WHEN l_returnflag = 'N' THEN 0.25 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 0.05 ELSE 0 END), 3) AS confidence FROM (SELECT *, l_discount * 10 AS title, l_linestatus = 'O' AS doi, l_tax * 10 AS names FROM lineitem)")
def identity_predicate(s, d):
    title, doi, names = F.col("l_discount") * 10, F.col("l_linestatus") == "O", F.col("l_tax") * 10
    conf = S.confidence(title, doi, names, F.col("l_returnflag") == "N", F.col("l_returnflag") == "R")
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.identity(title, doi, names).alias("passed"), conf.alias("confidence"))


@query("SELECT page_id, 'html_or_error_page' AS reason FROM pages WHERE regexp_matches(lower(ltrim(substr(html, 1, 400))), '^(<!doctype html|<html)') UNION ALL SELECT page_id, CASE WHEN octet_length(encode(coalesce(html, ''))) = 0 THEN 'empty_response' ELSE 'other' END FROM pages WHERE NOT coalesce(regexp_matches(lower(ltrim(substr(html, 1, 400))), '^(<!doctype html|<html)'), false)")
def content_validate(s, d):
    p = t(s, d, "pages").select("page_id", X.text_of(F.col("html")).alias("html"))
    one = F.lit(1)
    found = S.content(F.lit("jats"), F.col("html"), F.octet_length("html"), one, one, one)
    return p.select("page_id", found["reason"].alias("reason")).withColumn("reason", F.when(F.col("reason").isin("html_or_error_page", "empty_response"), F.col("reason")).otherwise("other"))


@query("SELECT p_partkey, n >= 2 AS usable, p_size > 45 OR n <= 1 AS weak FROM (SELECT *, (a <> '')::INT + (b <> '')::INT + (c <> '')::INT + (e <> '')::INT AS n FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS a, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_brand END AS b0, trim(b0) AS b, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS c, CASE WHEN p_size % 7 < 4 THEN '' ELSE 'x' END AS e FROM part))")
def usability(s, d):
    blank = lambda test, c, x: F.when(F.expr(test), x).otherwise(F.col(c) if c != "x" else F.lit("x"))
    core = [blank("p_size % 2 = 0", "p_name", ""), blank("p_size % 3 = 0", "p_brand", " "), blank("p_size % 5 = 0", "p_type", ""), blank("p_size % 7 < 4", "x", "")]
    return t(s, d, "part").select("p_partkey", S.usable(core).alias("usable"), S.weak(core, F.col("p_size") > 45).alias("weak"))


@query("SELECT doc_id, greatest(2048, least(8192, ((floor(n * 1.4)::BIGINT + 1024) // 512 + 1) * 512)) AS context FROM (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) AS n FROM documents)")
def context_sizes(s, d):
    return t(s, d, "documents").select("doc_id", S.context_size(F.size(X.words(F.col("text"))), 1024).alias("context"))


@query(f"SELECT {_LINE}, round(1.0 / (1.0 + l_linenumber) + 0.6 * least(l_quantity / greatest(l_extendedprice, 1) * 40.0, 1.0) + 0.5 * CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END, 6) AS score FROM lineitem")
def candidate_score(s, d):
    score = S.passage_score(F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("SELECT event_type, CASE WHEN r = 0 THEN 'INFO' WHEN n / r < 0.5 OR n / r > 2 THEN 'WARN' ELSE 'OK' END AS status FROM (SELECT event_type, count(*) FILTER (WHERE event_id % 3 = 0) AS n, count(*) FILTER (WHERE event_id % 3 = 1 AND event_type <> 'error') * (1 + 2 * (event_type = 'click')::INT) AS r FROM events GROUP BY event_type)")
def drift_band(s, d):
    e = t(s, d, "events").groupBy("event_type").agg(F.count_if(F.expr("event_id % 3 = 0")).alias("n"), F.count_if(F.expr("event_id % 3 = 1 and event_type <> 'error'")).alias("r"))
    ref = F.col("r") * F.when(F.col("event_type") == "click", 3).otherwise(1)
    return e.select("event_type", S.drift(F.col("n"), ref).alias("status"))


# orders and windows

@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['purchase', 'click', 'view', 'error', 'signup'], event_type) NULLS LAST, event_id) AS rn FROM events WHERE value >= 50) WHERE rn = 1")
def source_priority(s, d):
    order = F.array(*map(F.lit, ("purchase", "click", "view", "error", "signup")))
    place = F.nullif(F.array_position(order, F.col("event_type")), F.lit(0))
    return relational.first_n(t(s, d, "events").where("value >= 50").select("user_id", "event_id", "event_type", place.alias("place")), ["user_id"], [F.col("place").asc_nulls_last(), "event_id"], 1).drop("rank", "place")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_extendedprice / 3000, 0), l_quantity, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem")
def reading_order(s, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.bround(F.col("l_extendedprice") / 3000, 0), "l_quantity", "l_linenumber", "l_partkey", "l_suppkey")
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("SELECT source, arg_max(doc_id, (n_chars, length(coalesce(lang, '')), doc_id)) AS main FROM documents GROUP BY source")
def main_file(s, d):
    return t(s, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", F.length(X.text_of(F.col("lang"))), "doc_id")).alias("main"))


@query("SELECT conv_id, turn, conv_id || ':' || (row_number() OVER w - 1) AS block_id, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS char_end FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def block_offsets(s, d):
    """Numbers and offsets of blocks."""
    return chunking.block_offsets(t(s, d, "conversations"), "conv_id", "turn", "text")


_F11 = f"""WITH b AS (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS w FROM conversations), s AS (SELECT *, unnest(range(greatest(len(w) - 5, 0) // 15 + 1)) AS i FROM b WHERE len(w) > 0), c AS (SELECT conv_id, turn, i, w[i * 15 + 1 : i * 15 + 20] AS p, array_to_string(w[1 : i * 15], ' ') AS before FROM s WHERE i = 0 OR len(w) > i * 15 + 5)
SELECT conv_id, turn, i::INT AS chunk_index, (length(before) + (i > 0)::INT)::INT AS char_start, (length(before) + (i > 0)::INT + length(array_to_string(p, ' ')))::INT AS char_end, array_to_string(p, ' ') AS chunk FROM c"""


@query(_F11)
def block_chunks_with_spans(s, d):
    return chunking.block_chunks(t(s, d, "conversations"), ["conv_id", "turn"], "text", 20, 5)


@query("SELECT conv_id, role, string_agg(text, ' ' ORDER BY turn) AS context FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 300 GROUP BY ALL")
def section_context(s, d):
    c = t(s, d, "conversations").select("conv_id", F.col("turn").alias("passage_no"), F.col("role").alias("section"), "text")
    return gate.section_context(c, "conv_id", 300).select("conv_id", F.col("section").alias("role"), "context")


@query("SELECT user_id, count(*) >= 2 AND min(event_id) IN (0, 1) AND max(event_id) - min(event_id) = count(*) - 1 AS is_index FROM events GROUP BY user_id UNION ALL SELECT -1 - o_custkey, count(*) >= 2 AND min(n) IN (0, 1) AND max(n) - min(n) = count(*) - 1 FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_custkey")
def index_columns(s, d):
    e = t(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("v"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = t(s, d, "orders").select((-1 - F.col("o_custkey")).alias("user_id"), F.row_number().over(w).cast("long").alias("n")).groupBy("user_id").agg(F.array_sort(F.collect_list("n")).alias("v"))
    return e.unionByName(o).select("user_id", tables.is_index(F.lit("#"), F.transform("v", lambda x: x.cast("string"))).alias("is_index"))


# joins

@query("SELECT a.l_orderkey, a.l_linenumber AS word, b.l_linenumber AS box FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity >= b.l_quantity - 5 AND a.l_quantity <= b.l_quantity + 5 AND a.l_discount >= b.l_discount - 0.02 AND a.l_discount <= b.l_discount + 0.02 AND (a.l_partkey, a.l_suppkey, a.l_linenumber) <> (b.l_partkey, b.l_suppkey, b.l_linenumber)")
def bbox_contains(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    a, b = li.alias("a"), li.alias("b")
    inside = F.col("a.l_quantity").between(F.col("b.l_quantity") - 5, F.col("b.l_quantity") + 5) & F.col("a.l_discount").between(F.col("b.l_discount") - 0.02, F.col("b.l_discount") + 0.02)
    other = F.struct("a.l_partkey", "a.l_suppkey", "a.l_linenumber") != F.struct("b.l_partkey", "b.l_suppkey", "b.l_linenumber")
    return a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & inside & other).select("a.l_orderkey", F.col("a.l_linenumber").alias("word"), F.col("b.l_linenumber").alias("box"))


@query("SELECT conv_id, turn, box FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o DESC, box) AS rn FROM (SELECT a.conv_id, a.turn, b.turn AS box, least(a.turn * 10 + length(a.text) % 50, b.turn * 25 + 25) - greatest(a.turn * 10, b.turn * 25) AS o FROM conversations a JOIN conversations b USING (conv_id)) WHERE o > 0) WHERE rn = 1")
def argmax_overlap(s, d):
    c = t(s, d, "conversations")
    a = c.select("conv_id", "turn", (F.col("turn") * 10).alias("x0"), (F.col("turn") * 10 + F.length("text") % 50).alias("x1"))
    b = c.select("conv_id", F.col("turn").alias("box"), (F.col("turn") * 25).alias("y0"), (F.col("turn") * 25 + 25).alias("y1"))
    o = F.least("x1", "y1") - F.greatest("x0", "y0")
    return a.join(b, "conv_id").withColumn("o", o).where("o > 0").groupBy("conv_id", "turn").agg(F.max_by("box", F.struct("o", -F.col("box"))).alias("box"))


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 500) OR doc_id + 1 IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def delivered_anchors(s, d):
    """Anchors whose target or alternate is among the delivered ones."""
    anchors = t(s, d, "labels").select("doc_id", F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 1)).alias("chunk"))
    delivered = t(s, d, "documents").where("n_chars > 500").select(F.col("doc_id").alias("chunk"))
    return anchors.join(delivered, "chunk", "left_semi").select("doc_id").distinct()


@query("SELECT l.l_orderkey, l.l_linenumber, x.l_linenumber AS chunk FROM lineitem l JOIN lineitem x USING (l_orderkey) WHERE l.l_returnflag = 'R' AND x.l_linenumber NOT IN (l.l_linenumber, l.l_linenumber + 1)")
def mutant_chunks(s, d):
    """Mutants with their paper's chunks, but those dropped."""
    li = t(s, d, "lineitem")
    m = li.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1).alias("dropped"))
    return m.join(li.select("l_orderkey", F.col("l_linenumber").alias("chunk")), "l_orderkey").where("not array_contains(dropped, chunk)").drop("dropped")


@query("SELECT coalesce(a.e::VARCHAR, CASE WHEN a.u IS NULL THEN 'missing' ELSE 'null' END) AS before, coalesce(b.e::VARCHAR, CASE WHEN b.u IS NULL THEN 'missing' ELSE 'null' END) AS after, count(*) AS n FROM (SELECT user_id AS u, max(event_type) AS e FROM events WHERE event_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT user_id AS u, max(event_type) AS e FROM events WHERE event_id % 2 = 1 GROUP BY 1) b ON a.u = b.u GROUP BY ALL")
def arm_transitions(s, d):
    half = lambda k: t(s, d, "events").where(f"event_id % 2 = {k}").groupBy("user_id").agg(F.max("event_type").alias("v"))
    return metrics.transitions(half(0), half(1), "user_id", "v")


@query("SELECT a.o_custkey, a.o_orderpriority, count(*) AS agreed FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus AND round(a.o_totalprice, -4) = round(b.o_totalprice, -4) AND a.o_orderkey < b.o_orderkey GROUP BY ALL")
def reader_pairs(s, d):
    """Pairs of rows of two readers that agree on a composite key."""
    o = t(s, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", F.round("o_totalprice", -4).alias("price"), "o_orderkey")
    key = ["o_custkey", "o_orderpriority", "o_orderstatus", "price"]
    return o.join(o.withColumnRenamed("o_orderkey", "other"), key).where("o_orderkey < other").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("agreed"))


# sets

@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS both, (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)) AS either, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_first")
def artifact_overlap(s, d):
    return relational.overlap(t(s, d, "documents").select("doc_id"), t(s, d, "labels").select("doc_id"))


@query("SELECT 'nation' AS suite, n_nationkey::BIGINT AS id, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT 'region', r_regionkey, r_name, NULL FROM region UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def probe_suites(s, d):
    """Suites of several sources as one table."""
    n = t(s, d, "nation").select(F.lit("nation").alias("suite"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    r = t(s, d, "region").select(F.lit("region").alias("suite"), F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    p = t(s, d, "supplier").select(F.lit("supplier").alias("suite"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return n.unionByName(r, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)


@query("SELECT p_partkey, list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i) AS names FROM (SELECT p_partkey, [p_name, p_brand, upper(p_type), p_type, upper(p_name)] AS v FROM part)")
def case_insensitive_merge(s, d):
    return t(s, d, "part").select("p_partkey", metrics.merge_first_casing(F.array("p_name", "p_brand"), F.array(F.upper("p_type"), F.col("p_type"), F.upper("p_name"))).alias("names"))


# measures

@query("SELECT source, tp, fp, fn, tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 3) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 3) END AS sensitivity, CASE WHEN tn + fp > 0 THEN round(tn / (tn + fp), 3) END AS specificity FROM (SELECT source, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic <> 0) AS fn, count(*) FILTER (WHERE quality <> 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality <> 1 AND toxic <> 0) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY source)")
def confusion_rates(s, d):
    j = t(s, d, "labels").join(t(s, d, "documents").select("doc_id", "source"), "doc_id")
    return metrics.confusion(j, F.col("quality") == 1, F.col("toxic") == 0, ["source"])


@query("SELECT lang, round(avg((quality IS NOT DISTINCT FROM nullif(toxic, 0))::INT), 4) AS agreement, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def reader_agreement(s, d):
    j = t(s, d, "documents").select("doc_id", "lang").join(t(s, d, "labels").withColumn("toxic", F.nullif("toxic", F.lit(0))), "doc_id", "left")
    return metrics.agreement(j, "quality", "toxic", ["lang"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg((l_linenumber <= 2)::INT), 4) AS recall_2, round(avg((l_linenumber <= 5)::INT), 4) AS recall_5 FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def recall_at_k_slices(s, d):
    return metrics.recall_at(t(s, d, "lineitem"), "l_linenumber", [2, 5], ["l_returnflag", "l_linestatus"])


@query("SELECT l_returnflag, round(a, 4) AS delivered, round(r, 4) AS random, round(a / r, 4) AS ratio FROM (SELECT l_returnflag, avg((l_discount > 0.05)::INT) AS a, avg(least(10, l_quantity) / l_quantity) AS r FROM lineitem GROUP BY 1)")
def delivery_vs_random(s, d):
    return metrics.delivery(t(s, d, "lineitem"), F.col("l_discount") > 0.05, F.lit(10), F.col("l_quantity"), ["l_returnflag"])


@query("SELECT lang, round(avg(n_chars), 4) AS mean, median(n_chars) AS median, list_sort(list(n_chars))[floor(0.95 * (count(*) - 1))::INT + 1] AS p95, max(n_chars) AS most FROM documents GROUP BY lang")
def words_p95(s, d):
    # of a language's rows the one at the index is found by its number in order, so no list of all is made
    w = Window.partitionBy("lang").orderBy("n_chars", "doc_id")
    r = t(s, d, "documents").select("lang", "n_chars", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("lang")).alias("n"))
    at = F.floor(F.lit(0.95) * (F.col("n") - 1)) + 1
    return r.groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("mean"), F.median("n_chars").alias("median"), F.max(F.when(F.col("rn") == at, F.col("n_chars"))).alias("p95"), F.max("n_chars").alias("most"))


_PLAIN = "regexp_replace(html, '<[^>]*>', ' ', 'g')"


@query(f"SELECT page_id, count(*) AS n, round(avg(contains({_PLAIN}, a)::INT), 4) AS survival FROM (SELECT page_id, html, unnest(regexp_extract_all(coalesce(html, ''), '\\d+\\.\\d+|\\b\\d{{2,}}\\b')) AS a FROM pages) GROUP BY page_id")
def survival_rate(s, d):
    p = t(s, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("plain"), F.explode(X.anchors(F.col("html"))).alias("a"))
    return p.groupBy("page_id").agg(F.count("*").alias("n"), F.round(F.avg(F.expr("contains(plain, a)").cast("int")), 4).alias("survival"))


@query(f"SELECT location, count(*) AS n, round(avg(ok::INT), 4) AS rate, bool_and(ok) AS parity FROM (SELECT CASE WHEN page_id % 3 = 0 THEN 'table' WHEN page_id % 3 = 1 THEN 'caption' ELSE 'prose' END AS location, contains({_PLAIN}, a) AS ok FROM (SELECT page_id, html, unnest(regexp_extract_all(coalesce(html, ''), '\\d+\\.\\d+|\\b\\d{{2,}}\\b')) AS a FROM pages)) GROUP BY ROLLUP (location)")
def parity_by_location(s, d):
    place = F.when(F.col("page_id") % 3 == 0, "table").when(F.col("page_id") % 3 == 1, "caption").otherwise("prose")
    p = t(s, d, "pages").select(place.alias("location"), F.regexp_replace("html", "<[^>]*>", " ").alias("plain"), F.explode(X.anchors(F.col("html"))).alias("a"))
    ok = F.expr("contains(plain, a)")
    return p.rollup("location").agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("int")), 4).alias("rate"), F.bool_and(ok).alias("parity"))


@query("SELECT label, count(*) AS size FROM embeddings GROUP BY label")
def cluster_sizes(s, d):
    return t(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("size"))


@query("SELECT round(avg(score), 2) AS average, count(*) FILTER (WHERE score >= 8) AS supported FROM (SELECT greatest(0, 10 - 2 * (p_size % 8)) AS score FROM part)")
def verifier_scores(s, d):
    score = S.verifier_score(F.col("p_size") % 8)
    return t(s, d, "part").select(score.alias("score")).agg(F.round(F.avg("score"), 2).alias("average"), F.count_if(F.col("score") >= 8).alias("supported"))


@query("SELECT lang, source, quality, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (quality), (lang, source))")
def acquisition_summary(s, d):
    j = t(s, d, "documents").select("doc_id", "lang", "source", "n_chars").join(t(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.groupingSets([["lang"], ["source"], ["quality"], ["lang", "source"]], "lang", "source", "quality").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT field, count(*) FILTER (WHERE trim(coalesce(value, '')) <> '') AS filled, count(*) AS n, round(avg((trim(coalesce(value, '')) <> '')::INT), 4) AS share FROM (SELECT unnest(['text', 'lang', 'source']) AS field, unnest([text, lang, source]) AS value FROM documents) GROUP BY field")
def field_coverage(s, d):
    return metrics.coverage(t(s, d, "documents"), ["text", "lang", "source"])


@query("SELECT p1, p2, p3, count(*) FILTER (WHERE quality >= p1 AND toxic <= p2 AND doc_id % 3 <= p3) AS returned FROM labels, (SELECT unnest([0, 1]) AS p1), (SELECT unnest([0, 1]) AS p2), (SELECT unnest([0, 1, 2]) AS p3) GROUP BY ALL")
def param_sweep(s, d):
    """The number returned at each point of a grid of settings (G14): a row meets every point in one pass."""
    points = F.explode(F.array(*(F.struct(F.lit(a).alias("p1"), F.lit(b).alias("p2"), F.lit(c).alias("p3")) for a in (0, 1) for b in (0, 1) for c in (0, 1, 2)))).alias("p")
    ok = (F.col("quality") >= F.col("p1")) & (F.col("toxic") <= F.col("p2")) & (F.col("doc_id") % 3 <= F.col("p3"))
    return t(s, d, "labels").select("doc_id", "quality", "toxic", points).select("*", "p.*").groupBy("p1", "p2", "p3").agg(F.count_if(ok).alias("returned"))


@query("SELECT (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) = 0 AS labels_known, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) = 0 AS ids_unique, (SELECT count(*) FROM lineitem WHERE l_quantity <= 0) = 0 AS quantities_positive, (SELECT count(*) FROM documents WHERE lang IS NULL) = 0 AS langs_known")
def run_invariants(s, d):
    docs, labels = t(s, d, "documents"), t(s, d, "labels")
    return metrics.invariants({"labels_known": labels.join(docs, "doc_id", "left_anti"), "ids_unique": relational.duplicate_keys(docs, ["doc_id"]), "quantities_positive": t(s, d, "lineitem").where("l_quantity <= 0"), "langs_known": docs.where("lang is null")})


@query("SELECT p_partkey, path, before, after FROM (SELECT p_partkey, 'p_brand' AS path, p_brand AS before, CASE WHEN p_size > 40 THEN 'other' ELSE p_brand END AS after FROM part UNION ALL SELECT p_partkey, 'p_type', p_type, p_type FROM part) WHERE before IS DISTINCT FROM after")
def structural_diff(s, d):
    p = t(s, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return metrics.structural_diff(p, p.withColumn("p_brand", F.when(F.col("p_size") > 40, "other").otherwise(F.col("p_brand"))), "p_partkey", ("p_size",))


_WRAP = "SELECT kind, table_id, row, col, probe FROM (SELECT *, coalesce(lead(value) OVER w, first_value(value) OVER w) AS probe FROM (SELECT '{kind}' AS kind, * FROM c) WINDOW w AS (PARTITION BY {part} ORDER BY {order})) WHERE probe IS DISTINCT FROM value"


@query("WITH c AS (SELECT o_custkey AS table_id, o_orderkey AS row, unnest(['price', 'priority', 'status']) AS col, unnest([floor(o_totalprice)::BIGINT::VARCHAR, o_orderpriority, o_orderstatus]) AS value FROM orders) SELECT 'correct' AS kind, table_id, row, col, value AS probe FROM c UNION ALL " + " UNION ALL ".join(_WRAP.format(kind=k, part=p, order=o) for k, p, o in (("wrong_column", "table_id, row", "col"), ("wrong_row", "table_id, col", "row"), ("cross_table", "row, col", "table_id"))))
def cell_probes(s, d):
    o = t(s, d, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("row"), F.floor("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return metrics.probes(o.unpivot(["table_id", "row"], ["price", "priority", "status"], "col", "value"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id) <= 10 AS held_out FROM documents")
def hold_out_split(s, d):
    w = Window.partitionBy("lang").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id")
    return t(s, d, "documents").select("doc_id", (F.row_number().over(w) <= 10).alias("held_out"))


@query("SELECT c_mktsegment, n_regionkey, n FROM (SELECT c_mktsegment, n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)")
def map_pivot(s, d):
    """Counts as a map for each category (K6), read back as rows."""
    n = t(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    counts = t(s, d, "customer").join(n, "c_nationkey").groupBy("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"))
    maps = counts.groupBy("c_mktsegment").agg(F.map_from_entries(F.collect_list(F.struct("n_regionkey", "n"))).alias("m"))
    return maps.select("c_mktsegment", F.explode("m").alias("n_regionkey", "n"))


@query("SELECT doc_id, CASE WHEN q IS NULL OR (a = 1 AND b = 1) OR (a <> b AND doc_id % 5 = 0) THEN 'human' WHEN a = 0 AND b = 0 AND doc_id % 2 = 0 THEN 'provisional_N' WHEN a = b THEN CASE WHEN a = 0 THEN 'N' ELSE 'Y' END ELSE 'human' END AS target FROM (SELECT doc_id, quality AS a, toxic AS b, quality AS q FROM labels)")
def judge_routing(s, d):
    """Labels go to a human where judges differ or both are unsure (here: both 1)."""
    judge = lambda x, other: F.when((F.col(x) == 1) & (F.col(other) == 1), "UNCERTAIN").when(F.col(x) == 0, "N").otherwise("Y")
    return t(s, d, "labels").select("doc_id", metrics.routing(judge("quality", "toxic"), judge("toxic", "quality"), F.col("doc_id") % 2 == 0).alias("target"))


@query("SELECT source, lang, CASE WHEN lang IS NULL OR n < 5 THEN 'UNMEASURED' WHEN mean >= 1500 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT source, lang, avg(n_chars) AS mean, count(*) AS n FROM documents GROUP BY ALL)")
def criteria(s, d):
    g = t(s, d, "documents").groupBy("source", "lang").agg(F.avg("n_chars").alias("mean"), F.count("*").alias("n"))
    return g.select("source", "lang", metrics.criterion(F.when(F.col("lang").isNotNull(), F.col("mean")), F.lit(1500.0), F.col("n") >= 5).alias("verdict"))


@query("SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity > 10 AND l_discount <= 0.03 THEN 'bound_lost' END, CASE WHEN l_tax > 0.02 AND l_returnflag = 'R' THEN 'returned_lost' END], lambda x: x IS NOT NULL) AS lost FROM lineitem")
def regression_reasons(s, d):
    before = {"bound": F.col("l_quantity") > 10, "returned": F.col("l_tax") > 0.02}
    after = {"bound": F.col("l_discount") > 0.03, "returned": F.col("l_returnflag") != "R"}
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", metrics.regressions(before, after).alias("lost"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn % 7 = 1")
def every_nth(s, d):
    """Every seventh row of a group, in order (Q12)."""
    w = Window.partitionBy("lang").orderBy("doc_id")
    return t(s, d, "documents").select("doc_id", "lang", F.row_number().over(w).alias("rn")).where("rn % 7 = 1").drop("rn")


@query("SELECT doc_id, 'passthrough' AS mode FROM documents WHERE len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) BETWEEN 1 AND 2500 UNION ALL SELECT doc_id, 'legacy' FROM documents WHERE len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '')) > 2500")
def passthrough_split(s, d):
    """Papers by how their context is chosen (R6): chunks without overlap, the first three are the selection."""
    docs = t(s, d, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    chunks = chunking.chunk_windows(docs, "paper_id", "text", 220, 0).select("paper_id", "chunk_index", F.col("chunk").alias("text"))
    return selection.select(chunks, chunks.where("chunk_index < 3")).select(F.col("paper_id").alias("doc_id"), "mode").distinct()


@query()
def greedy_budget_select(s, d):
    pages = t(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    chunks = chunking.chunk_windows(pages, "doc_id", "text", 60, 0).withColumn("anchors", F.transform(X.valid_anchors(F.col("chunk")), lambda x: x["value"]))
    score = S.passage_score(F.col("chunk_index"), F.size("anchors"), F.col("n_words"), F.lit(0.0))
    return selection.greedy(chunks.select("doc_id", "chunk_index", score.alias("score"), F.length("chunk").alias("n_chars"), "anchors"), "doc_id", 10, 2000)


@query()
def cell_bind(s, d):
    """Claims made from prices of parts, bound to a table of their brand's."""
    p = t(s, d, "part").select("p_brand", "p_partkey", "p_name", F.format_string("%.2f", F.col("p_size") + 0.25).alias("size"), F.format_string("%.2f", F.col("p_retailprice") % 90 + 0.5).alias("rate"))
    cells = p.select("p_brand", F.col("p_partkey").alias("cell_no"), F.col("p_name").alias("row_label"), F.lit("Accuracy (%)").alias("column_header"), F.col("rate").alias("value"), F.lit("Table 1: Main results").alias("caption"))
    cells = cells.unionByName(p.select("p_brand", (F.col("p_partkey") + 10**9).alias("cell_no"), F.col("p_name").alias("row_label"), F.lit("Size").alias("column_header"), F.col("size").alias("value"), F.lit("Table 1: Main results").alias("caption")))
    said = F.when(F.col("p_partkey") % 3 == 0, F.col("size")).otherwise(F.col("rate"))
    claims = p.select("p_brand", F.lit("results").alias("field"), F.col("p_partkey").alias("claim_no"), F.concat("p_name", F.lit(" reaches accuracy "), said).alias("value"))
    return gate.bind(claims, cells, "p_brand").select("p_brand", "claim_no", "binding", "table_kind")


@query()
def range_checks(s, d):
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("a Dice of "), F.format_string("%.1f", F.col("l_quantity") * 3)).alias("claim"))
    return li.select("l_orderkey", "l_linenumber", C.range_check("claim")["value"].alias("impossible"))


@query()
def attributions(s, d):
    said = F.when(F.col("turn") % 3 == 0, "We see that ").when(F.col("turn") % 3 == 1, "Smith et al. see that ").otherwise("")
    c = t(s, d, "conversations").select("conv_id", "turn", "role", F.concat(said, F.col("text")).alias("text"))
    none = F.lit(None).cast("int")
    return c.select("conv_id", "turn", C.attribute("text", F.substring("text", 1, 30), F.lit("paragraph"), F.lit("results"), none, F.lit(None).cast("array<string>"))["attribution"].alias("attribution"))


@query()
def supporting_sentences(s, d):
    c = t(s, d, "conversations")
    return c.select("conv_id", "turn", C.support(F.element_at(X.sentences(F.col("text")), -1), F.col("text")).alias("sentence"))


def _gate_items(s, d) -> DataFrame:
    docs = t(s, d, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    chunk = chunking.chunk_windows(docs, "paper_id", "text").select("paper_id", F.col("chunk_index").alias("passage_no"), F.when(F.col("chunk_index") == 0, "abstract").otherwise("results").alias("section"), F.lit("paragraph").alias("block_type"), F.col("chunk").alias("text"))
    # cut once, and not again for each use
    cut = docs.withColumn("s", X.sentences(F.col("text")))
    said = F.when(F.size("s") >= 3, F.slice("s", -3, 3)).otherwise(F.col("s"))
    records = cut.select("paper_id", said.alias("datasets"), F.filter("s", lambda x: F.length(x) < 30).alias("metrics"), F.col("text").alias("results"), F.when(F.col("paper_id") % 10 == 0, "ABSTRACT_ONLY").otherwise("FULL_TEXT").alias("status"))
    labels = t(s, d, "labels")
    cells = labels.select(F.col("doc_id").alias("paper_id"), F.lit(0).alias("cell_no"), F.lit("ours").alias("row_label"), F.lit("Score").alias("column_header"), F.col("quality").cast("string").alias("value"), F.lit("Table 1: Results").alias("caption"))
    return gate.gate(records, stored(chunk), cells)


@query()
def gate_claims(s, d):
    """Every claim of every document through the whole gate: sentences with numbers, short ones as metrics, the last three as datasets."""
    return _gate_items(s, d)


@query()
def gate_stats(s, d):
    return gate.statistics(_gate_items(s, d))


@query()
def gate_monitor(s, d):
    records = t(s, d, "documents").select(F.col("doc_id").alias("paper_id"), F.when(F.col("doc_id") % 10 == 0, "ABSTRACT_ONLY").otherwise("FULL_TEXT").alias("status"))
    return gate.monitor(_gate_items(s, d), records)
