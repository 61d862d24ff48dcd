"""The evidence gate: every claim of a paper is returned with its evidence, or abstains with its reason.

All tests are columns computed first; the decision is the first rule that fails. Claims meet the table cells of their paper by
numbers they share. They meet its passages in buckets of papers, where a paper with many has them found by their words, so work
doesn't grow as claims times passages.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidenta.functions import claims as C
from evidenta.functions import text as X
from evidenta.sources.tables import stored

#: Sections whose passages are preferred, and characters of a span and of a section's context.
PREFERRED, SPAN, CONTEXT = ("results", "experimental_setup", "discussion"), 400, 6000
FIELDS = ("datasets", "metrics", "results")
#: Groups that papers are dealt into, and passages of a paper up to which each is looked through.
BUCKETS, FEW = 1 << 13, 12

_WORD = re.compile(r"[a-z0-9][a-z0-9\-]*")


def acquisition_status(status: Column, has_full_text: Column) -> Column:
    """The recorded status, else one by whether there is a full text."""
    return F.coalesce(F.nullif(status, F.lit("")), F.when(F.coalesce(has_full_text, F.lit(False)), "FULL_TEXT").otherwise("NO_ACCESSIBLE_FULL_TEXT"))


def explode_claims(records: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, field, claim_no, value, full_text): a row for every dataset, metric and sentence of the results (G1).

    `records` has datasets and metrics (arrays), results (text) and status. Sentences of fewer than twelve characters or without
    a digit are left out; without a full text the results are one claim of 300 characters.
    """
    full = F.col("status") == "FULL_TEXT"
    said = F.transform(X.sentences(X.strip(F.col("results"))), X.strip)
    stated = F.filter(said, lambda s: (F.length(s) >= 12) & s.rlike("(?U)\\d"))
    whole = F.array_remove(F.array(F.substring(X.strip(F.col("results")), 1, 300)), "")
    listed = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), X.strip), lambda x: x != "")
    values = {"datasets": listed(F.col("datasets")), "metrics": listed(F.col("metrics")), "results": F.when(full, stated).otherwise(whole)}
    numbered = lambda field: lambda x, i: F.struct(F.lit(field).alias("field"), i.alias("claim_no"), x.alias("value"))
    each = F.concat(*(F.transform(v, numbered(field)) for field, v in values.items()))
    return records.select(paper, F.coalesce(full, F.lit(False)).alias("full_text"), F.explode(each).alias("c")).select(paper, "full_text", "c.*")


def ground(claims: DataFrame, passages: DataFrame, paper: str = "paper_id", only: Column | None = None) -> DataFrame:
    """Add passage_no of the passage that states a claim, or null.

    A passage states a value that it holds, letter case and white space apart. If a result has numbers, all of them stand in
    the passage and two of its tokens do; without numbers four fifths of its tokens do, and two at least. Passages outside the
    abstract come first, then those of PREFERRED sections, then the first in order. A value of fewer than four characters is
    never grounded.

    `claims` has paper, field, claim_no and value, and of them those are looked for that `only` holds for; `passages` has paper,
    passage_no, section and text. Both meet in buckets of papers.
    """
    value = X.collapse(F.col("value")) if only is None else F.when(only, X.collapse(F.col("value")))
    numbers = F.when(F.col("field") == "results", F.array_distinct(X.anchors(F.col("value")))).otherwise(F.array().cast("array<string>"))
    bucket = F.pmod(F.xxhash64(paper), F.lit(BUCKETS)).alias("__bucket")
    section = F.coalesce("section", F.lit(""))
    c = claims.select("*", F.when(F.length(value) >= 4, value).alias("__v"), numbers.alias("__numbers"), bucket)
    p = passages.select(paper, "passage_no", (section == "abstract").alias("a"), (~section.isin(*PREFERRED)).alias("b"), X.collapse(F.col("text")).alias("p"), bucket)
    own, kind = claims.columns, next(x for x in passages.schema if x.name == "passage_no")
    schema = T.StructType([*claims.schema, T.StructField("passage_no", kind.dataType)])

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        papers: dict[object, list] = defaultdict(list)
        for row in zip(*(right[n].to_pylist() for n in (paper, "a", "b", "passage_no", "p")), strict=True):
            papers[row[0]].append(row[1:])
        papers = {k: Passages(x) for k, x in papers.items() if k is not None}
        asked = zip(*(left[n].to_pylist() for n in (paper, "__v", "__numbers")), strict=True)
        found = [papers[k].best(v, numbers) if v is not None and k in papers else None for k, v, numbers in asked]
        return left.select(own).append_column("passage_no", pa.array(found, right.schema.field("passage_no").type))

    return c.groupBy("__bucket").cogroup(p.groupBy("__bucket")).applyInArrow(pair, schema)


class Passages:
    """The passages of a paper in order of preference, and which of them state a value. Many are found by their words."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2]))
        self.numbers, self.texts = [r[2] for r in rows], [r[3] for r in rows]
        self.few = len(rows) <= FEW
        self.sets: dict[int, set] = {}
        self.by_piece = self.by_word = None

    def words(self, k: int) -> set:
        if k not in self.sets:
            self.sets[k] = {*_WORD.findall(self.texts[k])}
        return self.sets[k]

    def places(self, pieces) -> dict[str, list[int]]:
        out = defaultdict(list)
        for k in range(len(self.texts)):
            for x in pieces(k):
                out[x].append(k)
        return out

    def holding(self, v: str) -> int | None:
        """The first that holds a value. One of three words or more holds whole words of the passage between its ends."""
        inner = v.split(" ")[1:-1]
        if self.few or not inner:
            return next((k for k, text in enumerate(self.texts) if v in text), None)
        if self.by_piece is None:
            self.by_piece = self.places(lambda k: {*self.texts[k].split(" ")})
        return next((k for k in min((self.by_piece.get(w, ()) for w in inner), key=len) if v in self.texts[k]), None)

    def best(self, v: str, numbers: list[str]) -> object:
        """passage_no of the first that states the value: holds it, or has enough of its tokens and its numbers."""
        held = self.holding(v)
        end = len(self.texts) if held is None else held
        tokens = {x for x in _WORD.findall(v) if len(x) >= 4 and x not in X.STOP_WORDS} if end else ()
        if len(tokens) >= 2:
            if self.few:
                shared = ((k, len(tokens & self.words(k))) for k in range(end))
            else:
                if self.by_word is None:
                    self.by_word = self.places(lambda k: {*_WORD.findall(self.texts[k])})
                shared = sorted(Counter(k for x in tokens for k in self.by_word.get(x, ()) if k < end).items())
            for k, n in shared:
                if n >= 2 and (all(x in self.texts[k] for x in numbers) if numbers else 5 * n >= 4 * len(tokens)):
                    return self.numbers[k]
        return None if held is None else self.numbers[held]


def distinct_cells(cells: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Cells by row label, column header, value and caption, the first of each in order of cell_no (A10)."""
    names = ["row_label", "column_header", "value", "caption"]
    same = [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names]
    return cells.select(paper, "cell_no", *same).groupBy(paper, *names).agg(F.min("cell_no").alias("cell_no"))


def bind(claims: DataFrame, cells: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Add binding (its status) and table_kind: whether a claim's number stands in the cell that its subject and metric imply.

    pdf_only: the paper has no cells; no_number: the claim has none; not_bindable: no column of the paper names its metric;
    bound: the first of its numbers that any cell has stands under such a column, in a row of the claim's subject;
    wrong_cell: it stands elsewhere; not_a_table_claim: no cell has any of its numbers.

    `cells` has paper, cell_no, row_label, column_header, value and caption. Numbers meet cells by an equi-join on the number.
    """
    key = [paper, "field", "claim_no"]
    own = distinct_cells(cells, paper).withColumn("metrics", C.metric_tokens("column_header"))
    # a paper's metrics are words of one vocabulary; claims are read for theirs only where there are cells to bind them to
    columns = own.groupBy(paper).agg(F.array_distinct(F.flatten(F.collect_set("metrics"))).alias("columns"))
    numbers = X.anchors(F.col("value"))
    c = claims.join(columns, paper, "left").withColumn("__numbers", numbers)
    may = F.col("columns").isNotNull() & (F.size("__numbers") > 0)
    c = c.withColumn("named", C.metric_tokens(F.when(may, F.col("value"))))
    # a cell has a number if that is all of it but its marks, or stands in it as a whole
    bare = F.regexp_replace("value", r"(?U)[^\d.\-]", "")
    within = F.regexp_extract_all("value", F.lit(r"(?U)(?<![\d.])\d+(?:\.\d+)?(?!\d)"), 0)
    # 82.1 stands in 82.15 for no rule, but 82 stands before the point of 82.1
    heads = F.transform(within, lambda x: F.substring_index(x, ".", 1))
    numbered = own.select(paper, "cell_no", "row_label", "caption", "metrics", F.explode(F.array_distinct(F.concat(F.array(bare), within, heads))).alias("number"))
    met = c.where("columns is not null").select(*key, C.subject(F.col("value")).alias("subject"), "named", F.posexplode("__numbers").alias("number_no", "number")).join(numbered, [paper, "number"])
    in_column = F.arrays_overlap("named", "metrics")
    letters = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    by_word = F.arrays_overlap(X.all_words(F.col("subject")), X.all_words(F.col("row_label"))) | letters(F.col("row_label")).contains(F.substring(letters(F.col("subject")), 1, 12))
    on_row = F.when(F.col("subject").isNull(), F.lower("row_label").rlike("(?i)" + C.OWN_ROW)).otherwise((F.size(X.all_words(F.col("subject"))) > 0) & by_word)
    case = F.when(in_column & on_row, 0).when(in_column, 1).otherwise(2)
    first = met.groupBy(*key).agg(F.min(F.struct("number_no", case.alias("case"), "cell_no", "caption")).alias("m")).select(*key, "m.case", F.col("m.caption").alias("caption"))
    first = first.join(table_kinds(own, paper).withColumnRenamed("kind", "__kind"), [paper, "caption"], "left").drop("caption")
    out = c.join(first, key, "left")
    status = F.when(F.col("columns").isNull(), "pdf_only").when(F.size("__numbers") == 0, "no_number").when(~F.arrays_overlap("named", "columns"), "not_bindable").when(F.col("case") == 0, "bound").when(F.col("case").isNotNull(), "wrong_cell").otherwise("not_a_table_claim")
    return out.withColumn("binding", status).withColumn("table_kind", F.when(F.col("binding") == "bound", F.col("__kind"))).drop("columns", "__numbers", "named", "case", "__kind")


def table_kinds(cells: DataFrame, paper: str = "paper_id") -> DataFrame:
    """(paper, caption, kind) of each table."""
    named = cells.withColumn("__metrics", F.size(C.metric_tokens("column_header")) > 0)
    sets = named.groupBy(paper, "caption").agg(F.collect_set("column_header").alias("headers"), F.collect_set("row_label").alias("rows"), F.count_distinct(F.when(F.col("__metrics"), F.col("column_header"))).alias("n"))
    return sets.select(paper, "caption", C.table_kind(F.col("caption"), F.col("headers"), F.col("rows"), F.col("n")).alias("kind"))


def guard(claims: DataFrame, cells: DataFrame, passages: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Add in_table: whether a number of the claim is a whole number of a cell or of a table's text in its paper."""
    key = [paper, "field", "claim_no"]
    of_cells = distinct_cells(cells, paper).select(paper, F.explode(X.numeric_tokens(F.col("value"))).alias("number"))
    of_texts = passages.where("block_type = 'table'").select(paper, F.explode(X.numeric_tokens(F.col("text"))).alias("number"))
    tokens = of_cells.unionByName(of_texts).distinct()
    hit = claims.where(F.col("value").rlike(r"(?U)\d")).select(*key, F.explode(X.claim_numbers(F.col("value"))).alias("number")).join(tokens, [paper, "number"], "left_semi").select(*key).distinct()
    return claims.join(hit.withColumn("in_table", F.lit(True)), key, "left").withColumn("in_table", F.coalesce("in_table", F.lit(False)))


def section_context(passages: DataFrame, paper: str = "paper_id", limit: int = CONTEXT) -> DataFrame:
    """(paper, section, context): passages of a section in order until they hold `limit` characters, the one that does included."""
    w = Window.partitionBy(paper, "section").orderBy("passage_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(X.text_of(F.col("text")))).over(w), F.lit(0))
    kept = passages.withColumn("__before", before).where(F.col("__before") < limit)
    return kept.groupBy(paper, "section").agg(F.array_sort(F.collect_list(F.struct("passage_no", X.text_of(F.col("text")).alias("t")))).alias("a")).select(paper, "section", F.array_join(F.transform("a", lambda x: x["t"]), " ").alias("context"))


def gate(records: DataFrame, passages: DataFrame, cells: DataFrame, guarded: bool = True, paper: str = "paper_id") -> DataFrame:
    """All claims of `records` with final, reason and their evidence.

    The first rule that fails gives the reason: full text, sanity, range, binding, kind of the bound table, the guard (if
    `guarded`: a number of a table must be bound to it), grounding, attribution. `records` may have surnames (an array) of
    the authors; `passages` has paper, passage_no, section, block_type and text.
    """
    claims = explode_claims(records, paper).withColumn("sane", C.sane(F.col("field"), F.col("value")))
    quantity = F.col("field").isin("metrics", "results")
    # claims are read several times
    claims = stored(claims.withColumn("range", C.range_check(F.when(quantity & F.col("value").rlike("[0-9]"), F.col("value")))))
    tested = guard(bind(claims, cells, paper), cells, passages, paper)
    texts = passages.select(paper, "passage_no", "section", "block_type", "text")
    number = quantity & (F.size(X.anchors(F.col("value"))) > 0)
    bound_to = lambda kind: number & (F.col("binding") == "bound") & (F.col("table_kind") == kind)
    early = (
        F.when(~F.col("full_text"), "no_validated_full_text")
        .when(~F.col("sane"), "value_failed_sanity_check")
        .when(F.col("range").isNotNull(), "metric_value_out_of_range")
        .when(number & (F.col("binding") == "pdf_only"), "unverifiable_binding")
        .when(number & (F.col("binding") == "wrong_cell"), "binding_wrong_cell")
        .when(bound_to("ablation"), "bound_to_ablation_table")
        .when(bound_to("other"), "bound_to_other_table")
        .when(F.lit(guarded) & number & F.col("binding").isin("not_bindable", "not_a_table_claim") & F.col("in_table"), "table_value_unbound")
    )
    # only claims that pass all this need a passage, and those that have one its text
    found = ground(tested.withColumn("early", early), passages, paper, F.col("early").isNull()).withColumnRenamed("passage_no", "at")
    open_ = stored(found.withColumn("early", F.coalesce("early", F.when(F.col("at").isNull(), "evidence_span_not_found_in_paper_chunks"))))
    # the context of a section is asked for by quantities only
    asking = open_.where(quantity & F.col("at").isNotNull()).select(paper).distinct()
    strong = section_context(passages.join(asking, paper, "left_semi"), paper).select(paper, "section", C.cues(F.col("context")).alias("strong"))
    full = open_.join(texts.withColumnRenamed("passage_no", "at"), [paper, "at"], "left").join(strong, [paper, "section"], "left")
    full = full.join(records.select(paper, "surnames"), paper, "left") if "surnames" in records.columns else full.withColumn("surnames", F.lit(None).cast("array<string>"))
    full = full.withColumn("evidence_span", F.substring(C.support("value", "text"), 1, SPAN)).withColumn("whose", C.attribute(F.when(quantity, F.col("text")), "value", "block_type", "section", "strong", "surnames"))
    reason = F.coalesce("early", F.when(F.col("whose.attribution") == "CITED_PAPER", "attributed_to_cited_work").when(F.col("whose.attribution") == "UNKNOWN", "ownership_unverified"))
    out = full.withColumn("reason", reason)
    explicit = F.col("reason").isNull() | F.col("reason").isin("attributed_to_cited_work", "ownership_unverified", "bound_to_ablation_table", "bound_to_other_table")
    status = F.when(explicit, "EXPLICIT").when(F.col("reason") == "no_validated_full_text", "MISSING").otherwise("UNSUPPORTED")
    final = F.when(F.col("reason").isNull(), "RETURNED").otherwise("ABSTAINED")
    return out.select(paper, "field", "claim_no", "value", final.alias("final"), "reason", status.alias("evidence_status"), explicit.alias("provenance_valid"), F.when(number, F.col("binding")).alias("binding"), "table_kind", F.col("at").alias("passage_no"), "evidence_span", F.coalesce("whose.attribution", F.lit("UNKNOWN")).alias("attribution"), F.coalesce("whose.confidence", F.lit(0.0)).alias("attribution_confidence"), F.col("range.metric").alias("range_metric"))


def statistics(items: DataFrame) -> DataFrame:
    """(field, returned, abstained, explicit, own, cited, unknown, return_rate): one row for each field and one for all (A5)."""
    count = lambda c: F.count_if(c)
    returned = count(F.col("final") == "RETURNED")
    return items.rollup("field").agg(returned.alias("returned"), count(F.col("final") == "ABSTAINED").alias("abstained"), count(F.col("evidence_status") == "EXPLICIT").alias("explicit"), count("provenance_valid").alias("provenance_valid"), *(count(F.col("attribution") == a).alias(n) for a, n in (("OWN_PAPER", "own"), ("CITED_PAPER", "cited"), ("UNKNOWN", "unknown"))), F.round(returned / F.count("*"), 4).alias("return_rate"))


def monitor(items: DataFrame, records: DataFrame, reference: int | None = None, low: float = 0.5, high: float = 2.0, paper: str = "paper_id") -> DataFrame:
    """One row of four signals and the worst of them.

    A: the number returned against a reference; B: quantities returned that aren't the paper's own; C: explicit evidence whose
    provenance is valid; D: claims returned without a full text.
    """
    with_status = items.join(records.select(paper, (F.col("status") == "FULL_TEXT").alias("full")), paper, "left")
    returned = F.col("final") == "RETURNED"
    sums = with_status.agg(F.count_if(returned).alias("returned"), F.count_if(returned & F.col("field").isin("metrics", "results") & (F.col("attribution") != "OWN_PAPER")).alias("not_own"), F.count_if(F.col("evidence_status") == "EXPLICIT").alias("checked"), F.count_if((F.col("evidence_status") == "EXPLICIT") & F.col("provenance_valid")).alias("valid"), F.count_if(returned & ~F.coalesce("full", F.lit(False))).alias("leaks"))
    share = F.col("returned") / F.lit(reference)
    a = F.lit("INFO") if reference is None else F.when((share < low) | (share > high), "WARN").otherwise("OK")
    out = sums.select("*", a.alias("a"), F.when(F.col("not_own") == 0, "OK").otherwise("FAIL").alias("b"), F.when(F.col("checked") == 0, "WARN").when(F.col("valid") == F.col("checked"), "OK").otherwise("FAIL").alias("c"), F.when(F.col("leaks") == 0, "OK").otherwise("CRITICAL").alias("d"))
    order = F.array(*map(F.lit, ("OK", "WARN", "FAIL", "CRITICAL")))
    places = F.array(*(F.greatest(F.array_position(order, F.col(x)), F.lit(1).cast("long")) for x in "abcd"))
    return out.withColumn("overall", F.element_at(order, F.array_max(places).cast("int")))
